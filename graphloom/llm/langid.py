"""Hierarchical language identification: family first, then one-versus-one linear SVMs within the family.

A text's features are the shares of its hashed letter trigrams (lower-cased, runs
of letters with a space at each end). One-versus-rest linear SVMs over the
families name the family; within it every pair of languages has a linear SVM of
its own, and the language with most wins, then the largest sum of margins, is
predicted. The machines are fitted from a sample of labelled rows bounded per
language, one machine a task; everything else is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.frames import crc_bucket, tables, written
from graphloom.llm.words import batches, utf8

#: Families of some languages by ISO code; a language that isn't here is a family of its own.
FAMILIES = {
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "ne", "pa", "gu"),
}
UNKNOWN = "und"
BUCKETS = 1 << 13
PER_LANGUAGE = 400
BATCH_BYTES = 1 << 20  # a text's trigrams take some twenty times its bytes
_U = np.uint64
_FOLD = np.full(256, 0x20, np.uint8)  # bytes of letters stand for themselves, all else is a space
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.split("-")[0].lower() in langs), lang)


def _trigrams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, text of each): of bytes, within one text, with at most one space and that at an end."""
    folded = _FOLD[data].astype(np.uint32)
    if len(data) > 1:  # capitals of Latin-1: C3 80 .. C3 9E
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded[1:][wide] += 0x20
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = folded[:-2], folded[1:-1], folded[2:]
    ok = (b != 0x20) & ((a != 0x20) | (c != 0x20))
    for edge in (1, 2):  # trigrams over the end of a text
        at = offsets[1:-1] - edge
        ok[at[(at >= 0) & (at < n - 2)]] = False
    at = np.flatnonzero(ok)
    code = (a[at] << np.uint32(16)) | (b[at] << np.uint32(8)) | c[at]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(buckets).bit_length() + 1)
    return bucket.astype(np.int64), np.searchsorted(offsets, at, "right") - 1


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def lettered(text: Column) -> Column:
    """Whether a text holds a letter; false for null."""
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


@dataclass
class LanguageModel:
    """``weights[k]`` and ``bias[k]``: a machine's; ``families``, ``languages`` and ``pairs`` say what they tell apart."""

    families: list[str]
    languages: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, machines)."""
        bucket, doc = _trigrams(data, offsets, self.weights.shape[1])
        n = len(offsets) - 1
        counts = np.bincount(doc, minlength=n).astype(np.float64)
        out = np.empty((n, len(self.weights)))
        for k, w in enumerate(self.weights):
            out[:, k] = np.bincount(doc, weights=w[bucket], minlength=n)
        return out / np.maximum(counts, 1)[:, None] + self.bias

    def predict(self, margins: np.ndarray) -> tuple[list[str], list[float]]:
        by_family: dict[str, list[str]] = {f: [x for x in self.languages if family_of(x) == f] for f in self.families}
        at = {p: len(self.families) * (len(self.families) > 1) + k for k, p in enumerate(self.pairs)}
        langs, scores = [], []
        for row in margins.tolist():
            family, score = self.families[0], 1.0
            if len(self.families) > 1:
                top = max(range(len(self.families)), key=lambda k: (row[k], -k))
                family, score = self.families[top], _logistic(row[top])
            wins = {x: [0, 0.0] for x in by_family[family]}
            for a, b in combinations(by_family[family], 2):
                m = row[at[a, b]]
                wins[a if m >= 0 else b][0] += 1
                wins[a][1] += m
                wins[b][1] -= m
            best = max(sorted(wins), key=lambda x: wins[x])
            own = [row[at[p]] if p[0] == best else -row[at[p]] for p in self.pairs if best in p and family_of(p[0]) == family == family_of(p[1])]
            langs.append(best)
            scores.append(min([score, *map(_logistic, own)]))
        return langs, scores


def _logistic(m: float) -> float:
    return float(1 / (1 + np.exp(-max(-30.0, min(30.0, 2 * m)))))


@dataclass
class _Sample:
    """Labelled texts as sparse rows: row k has the features ``at[edges[k]:edges[k + 1]]`` with ``share``."""

    names: np.ndarray
    kin: np.ndarray
    edges: np.ndarray
    at: np.ndarray
    share: np.ndarray
    buckets: int

    def machine(self, kind: str, a: str, b: str) -> tuple[np.ndarray, float]:
        """A family against the rest, or language a against language b."""
        if kind == "family":
            rows, y = np.arange(len(self.names)), np.where(self.kin == a, 1.0, -1.0)
        else:
            rows = np.flatnonzero((self.names == a) | (self.names == b))
            y = np.where(self.names[rows] == a, 1.0, -1.0)
        return self._svm(rows, y)

    def _svm(self, rows: np.ndarray, y: np.ndarray, epochs: int = 30, penalty: float = 1.0) -> tuple[np.ndarray, float]:
        """Linear SVM with squared hinge loss by dual coordinate descent; classes weigh alike. y in {-1, 1}."""
        n = len(rows)
        cells = [(self.at[i:j], self.share[i:j]) for i, j in zip(self.edges[rows].tolist(), self.edges[rows + 1].tolist())]
        weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) * penalty
        extra = 1 / (2 * weight)
        square = np.array([v @ v + 1 for _, v in cells]) + extra
        alpha, w, bias = np.zeros(n), np.zeros(self.buckets), 0.0
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(n).tolist():
                at, v = cells[i]
                gradient = y[i] * (w[at] @ v + bias) - 1 + alpha[i] * extra[i]
                new = max(0.0, alpha[i] - gradient / square[i])
                if new != alpha[i]:
                    step = (new - alpha[i]) * y[i]
                    w[at] += step * v
                    bias += step
                    alpha[i] = new
        return w, float(bias)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, buckets: int = BUCKETS) -> LanguageModel | None:
    """Fit on rows with a non-null ``lang`` and a letter in their text; None if there are none.

    The sample is bounded: of each language the texts with the ``per_language`` smallest hashes, copies counting once, of
    which the whole text is used. Its trigram counts are collected and sent to the tasks that fit the machines: some
    kilobytes a text, so a megabyte a language. Any number of languages is told apart.
    """
    rows = labelled.where(F.col(f"`{lang}`").isNotNull() & lettered(F.col(f"`{text}`"))).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text") / F.lit(float(1 << 64)) + 0.5)  # 0 to 1
    hashes = written(rows.select("lang", "h").distinct(), "hashes")  # of distinct texts: copies hash alike
    counts = {r["lang"]: r["count"] for r in hashes.groupBy("lang").count().collect()}
    if not counts:
        return None
    # the smallest hashes of each language, without moving texts: sorted up to a cut that leaves about four times the
    # bound, and that is lifted where it leaves too few
    cuts, limits = {k: min(1.0, 4 * per_language / n) for k, n in counts.items()}, {}
    while todo := sorted(set(counts) - set(limits)):
        cut = F.create_map(*[x for k in todo for x in (F.lit(k), F.lit(cuts[k]))])[F.col("lang")]
        least = hashes.where(F.col("h") <= cut).groupBy("lang").agg(F.slice(F.array_sort(F.collect_list("h")), 1, per_language).alias("least"))
        found = {r["lang"]: (r["n"], r["most"]) for r in least.select("lang", F.size("least").alias("n"), F.element_at("least", -1).alias("most")).collect()}
        for k in todo:
            if found.get(k, (0, None))[0] >= min(per_language, counts[k]):
                limits[k] = found[k][1]
            else:
                cuts[k] = min(1.0, 4 * cuts[k])

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text", BATCH_BYTES):
            bucket, doc = _trigrams(*utf8(batch.column("text")), buckets)
            cells = []
            for d in range(batch.num_rows):
                at, n = np.unique(bucket[doc == d], return_counts=True)
                cells.append({"at": at.tolist(), "share": (n / max(1, n.sum())).tolist()})
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "h": batch.column("h"), "at": pa.array([c["at"] for c in cells], pa.list_(pa.int32())), "share": pa.array([c["share"] for c in cells], pa.list_(pa.float32()))})

    most = F.create_map(*[x for k, m in sorted(limits.items()) for x in (F.lit(k), F.lit(m))])[F.col("lang")]
    chosen = rows.where(F.col("h") <= most).groupBy("lang", "text").agg(F.first("h").alias("h"))
    got = sorted(((r["lang"], r["h"], r["at"], r["share"]) for r in chosen.mapInArrow(features, "lang string, h double, at array<int>, share array<float>").collect()), key=lambda r: r[:2])
    names = np.array([r[0] for r in got])
    sample = _Sample(
        names,
        np.array([family_of(n) for n in names.tolist()]),
        np.cumsum([0, *[len(r[2]) for r in got]]),
        np.concatenate([np.array(r[2], np.int64) for r in got]),
        30.0 * np.concatenate([np.array(r[3], np.float64) for r in got]),  # shares are small numbers; the machines see lengths near one
        buckets,
    )
    families, languages = sorted(set(sample.kin.tolist())), sorted(set(names.tolist()))
    pairs = [(a, b) for f in families for a, b in combinations([n for n in languages if family_of(n) == f], 2)]
    jobs = [("family", f, "") for f in families] if len(families) > 1 else []
    jobs += [("pair", a, b) for a, b in pairs]
    machines = _fitted(labelled.sparkSession, sample, jobs)
    weights = np.array([30.0 * w for w, _ in machines]).reshape(len(machines), buckets)
    return LanguageModel(families, languages, pairs, weights, np.array([b for _, b in machines]))


def _fitted(spark: SparkSession, sample: _Sample, jobs: list[tuple[str, str, str]]) -> list[tuple[np.ndarray, float]]:
    """The machines, each fitted by a task of its own."""
    if not jobs:
        return []
    sent = spark.sparkContext.broadcast(sample)

    def fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in batch.column("id").to_pylist():
                w, bias = sent.value.machine(*jobs[k])
                yield pa.RecordBatch.from_pydict({"id": pa.array([k], pa.int64()), "w": pa.array([w.astype("<f8").tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    rows = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(fit, "id long, w binary, bias double").collect()
    return [(np.frombuffer(r["w"], "<f8"), r["bias"]) for r in sorted(rows, key=lambda r: r["id"])]


def identify(documents: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``documents`` with lang_pred and score (0 to 1, the least certain of the decisions taken).

    Texts that are null or hold no letter get ``und`` and 0, as do all if there is no model. All columns stay; those of
    these two names are replaced. Only the text counts.
    """
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    rows = documents.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("_text"))
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def predict(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in batches(it, "_text", BATCH_BYTES):
            lettered = [_has_letter(t) for t in batch.column("_text").to_pylist()]
            langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            if machine and any(lettered):
                found = machine.predict(machine.margins(*utf8(batch.column("_text"))))
                langs = [x if ok else UNKNOWN for x, ok in zip(found[0], lettered)]
                scores = [x if ok else 0.0 for x, ok in zip(found[1], lettered)]
            out = {c: batch.column(c) for c in batch.schema.names if c != "_text"}
            yield pa.RecordBatch.from_pydict(out | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([f for f in rows.schema.fields if f.name != "_text"]).add("lang_pred", StringType()).add("score", DoubleType())
    out = rows.mapInArrow(predict, schema)
    return out.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(kept)], "lang_pred", "score")


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(crc_bucket(doc_id, parts) == part, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: learn from three quarters of the labelled documents, predict for all."""
    documents = tables(spark, sf_dir, "documents")
    model = train(documents.where(~held_out(F.col("doc_id"))))
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model).drop("text")

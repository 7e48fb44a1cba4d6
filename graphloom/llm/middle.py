"""Fill-in-the-middle: documents cut into prefix, middle and suffix and put together in another order.

The cuts are found without a Python object per character. A text is its UTF-8
bytes; ``bytes.translate`` turns it into a class mask, one byte a place, which is
read as one big integer. Shifted boolean operations on it mark the byte at which
each unit (code point or word) ends, ``bit_count`` gives the number of units, and
the k-th mark is found by halving: the lower half's count tells which half holds
it. All of it is linear in the text. Where to cut and in which form depends on
the document's id alone, so a lost task makes the same rows again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from graphloom.llm.frames import tables
from graphloom.llm.words import batches

SEED, TRANSFORMED, SUFFIX_FIRST = 1, 90, 20  # the latter in percent
_CONTINUES = bytes(0x80 <= b <= 0xBF for b in range(256))
_SPACE = bytes(b == 0x20 or 0x09 <= b <= 0x0D for b in range(256))


class Marks(NamedTuple):
    """What stands before each part; none may begin another, and their first characters occur nowhere else in them."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def checked(self) -> Marks:
        """Marks that can't be met where a part joins one: a text without them is then told apart from them again."""
        heads = {m[:1] for m in self}
        if not all(self) or any(h in m[1:] for h in heads for m in self) or any(a.startswith(b) for a in self for b in self if a is not b):
            raise ValueError(f"marks that may run into each other: {tuple(self)}")
        return self


def unit_ends(data: bytes, unit: str = "char") -> int:
    """The last byte of each unit as bit 8 * place. Units: "char", code points; "word", words with the white space behind them."""
    if not data:
        return 0
    last = 1 << 8 * (len(data) - 1)
    if unit == "char":
        goes_on = int.from_bytes(data.translate(_CONTINUES), "little") >> 8
        return int.from_bytes(b"\1" * len(data), "little") ^ goes_on
    if unit == "word":
        space = int.from_bytes(data.translate(_SPACE), "little")
        return (space ^ (space & (space >> 8))) | last
    raise ValueError(f"no unit {unit!r}")


def place_after(ends: int, k: int, size: int) -> int:
    """Bytes of the first ``k`` units of ``size`` bytes, by halving."""
    if not k:
        return 0
    at = 0
    while size > 1:
        half = size >> 1
        low = ends & ((1 << 8 * half) - 1)
        below = low.bit_count()
        if k <= below:
            ends, size = low, half
        else:
            ends, size, at, k = ends >> 8 * half, size - half, at + half, k - below
    return at + 1


def draws(key: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    found = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(found[k : k + 8], 16) for k in range(0, 32, 8))


def transform(data: bytes, key: str, marks: Marks, unit: str, seed: int, share: int, suffix_first: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, those of the prefix, of the middle, output)"""
    ends = unit_ends(data, unit)
    n = ends.bit_count()
    h1, h2, h3, h4 = draws(key, seed)
    p, s, m = (x.encode() for x in marks)
    if not data or h3 % 100 >= share or p in data or s in data or m in data:
        return n, "plain", None, None, data
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (place_after(ends, k, len(data)) for k in (first, second))
    if h4 % 100 < suffix_first:
        return n, "spm", first, second - first, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return n, "psm", first, second - first, b"".join((p, data[:a], s, data[b:], m, data[a:b]))


def transformed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", marks: Marks = Marks(), unit: str = "char", seed: int = SEED, share: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(``doc_id``, n, form, prefix_chars, middle_chars, output) of every row; the lengths are in units.

    Forms: "plain" leaves a text as it is; "psm" has the prefix, the suffix, then the middle, each behind its mark; "spm"
    has the suffix first. Plain are empty texts, those that hold a mark, and all but ``share`` percent of ids; ``suffix_first``
    percent of the others are spm. Null texts count as empty, a null id as no digits; rows alike give rows alike, an empty
    table none, other columns are left out whatever their names. Texts that are no valid UTF-8 are cut where a byte does
    not continue a code point. Rows stay where they are: there is no shuffle.
    """
    marks.checked()
    rows = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("_key"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("_text"))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "_text"):
            done = [transform(t, k, marks, unit, seed, share, suffix_first) for t, k in zip(batch.column("_text").to_pylist(), batch.column("_key").to_pylist())]
            n, form, prefix, middle, out = zip(*done)
            made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *made], ["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = documents.select(F.col(f"`{doc_id}`")).schema[0].dataType
    fields = [StructField("_id", kind), StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType())]
    schema = StructType(fields).add("output", "binary")
    return rows.mapInArrow(cut, schema).withColumn("output", F.col("output").cast("string")).withColumnRenamed("_id", doc_id)


def restored(form: Column, output: Column, marks: Marks = Marks()) -> Column:
    """The text of which ``output`` was made."""
    marks.checked()
    p, s, m = marks
    middle = F.substring_index(output, m, -1)
    head = F.substring_index(output, m, 1)
    psm = F.concat(F.substring(F.substring_index(head, s, 1), len(p) + 1, 1 << 30), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring(F.substring_index(head, p, 1), len(s) + 1, 1 << 30))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every document, and what is rebuilt from its output."""
    made = transformed(tables(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))

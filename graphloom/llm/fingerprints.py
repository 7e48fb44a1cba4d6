"""Canonical exact fingerprints, in DataFrame operations only.

A text is made canonical (Unicode NFKC, full case folding, runs of white space as
one space, trimmed) and hashed twice with xxHash under different seeds: 128
bits. Texts that share a hash with another are compared byte by byte: of each
such bucket the least and the greatest canonical text are aggregated, partially
before the shuffle, so a bucket with a third of all rows is no single task's. If
they are equal so is all between; a bucket with different texts numbers them.

The normaliser and the case folding are those of the ICU library that Spark
itself ships, called by SQL's ``reflect``; texts of ASCII alone skip them, as for
these folding is lowering.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import spans as S
from graphloom.llm.frames import shuffle_width, small, tables, written

SAMPLED = 20  # rows a range that its bounds are taken from
#: White space but the space, in ASCII and, after NFKC, beyond it.
_WHITE, _WIDE_WHITE = "\t\n\x0b\x0c\r", "\t\n\x0b\x0c\r\x85\u1680\u2028\u2029"

Digest = Callable[[Column], Column]


def canonical(text: Column) -> Column:
    """The canonical form of a non-null text. Each step's value is bound, so that none is computed twice."""
    ascii_only = lambda t: F.octet_length(t) == F.length(t)
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))

    def spaced(t: Column, white: str) -> Column:
        for c in white:
            t = F.replace(t, F.lit(c), F.lit(" "))
        return t

    def single(t: Column) -> Column:
        return F.trim(F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t))

    def whole(t: Column) -> Column:
        return S.bound(F.when(ascii_only(t), spaced(t, _WHITE)).otherwise(spaced(t, _WIDE_WHITE)), single)

    return S.bound(F.when(ascii_only(text), F.lower(text)).otherwise(again), whole)


def digest128(canon: Column) -> Column:
    """32 hexadecimal digits of two xxHash values."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0") for seed in (1, 2)])


def unequal_buckets(rows: DataFrame) -> DataFrame:
    """(h, least, greatest) of the buckets that hold different texts. ``rows``: (h, canon)."""
    return rows.groupBy("h").agg(F.min("canon").alias("least"), F.max("canon").alias("greatest")).where("least != greatest")


def variants(rows: DataFrame, unequal: DataFrame) -> DataFrame:
    """(h, canon, variant): the different texts of each unequal bucket, numbered from 1 in their order."""
    distinct = rows.join(unequal.select("h"), "h", "left_semi").distinct()
    return distinct.withColumn("variant", F.row_number().over(Window.partitionBy("h").orderBy("canon")))


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Digest = digest128) -> DataFrame:
    """``documents`` with ``fingerprint``: equal for two rows if and only if their canonical texts are equal.

    Null texts count as empty. All columns stay; one named ``fingerprint`` is replaced; repeated rows get the same.
    """
    kept = [c for c in documents.columns if c != "fingerprint"]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), canonical(body).alias("canon")).withColumn("h", digest(F.col("canon")))
    hashes = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared = rows.select("h", "canon").join(small(written(hashes, "shared")), "h", "left_semi")
    unequal = written(unequal_buckets(shared), "unequal")
    mark = F.col("h")
    if not unequal.isEmpty():
        numbered = variants(shared, unequal)
        rows = rows.join(numbered, ["h", "canon"], "left")
        mark = F.when(F.coalesce("variant", F.lit(1)) > 1, F.concat("h", F.lit("-"), "variant")).otherwise(F.col("h"))
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], mark.alias("fingerprint"))


def with_next(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Digest = digest128) -> DataFrame:
    """(_id, body, b, h) and the same of the next row by descending id, the first coming after the last: next_id, next_body, next_b, next_h.

    Rows are ranged by id and text hash into many small windows, by bounds from a sample; each window also gets a copy of
    the row that follows its last, so one shuffle does. Rows with equal ids follow by their texts' hashes, so that many
    rows with one id or none are many windows; rows alike in both are one window. Null ids come last. Ids may be of any
    type that has an order.
    """
    spark = documents.sparkSession
    ranges = 4 * shuffle_width(spark)
    rows = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("b", F.xxhash64(F.lit(3), "body"))
    place = F.struct("_id", "b")  # null ids are the least
    sample = rows.select("_id", "b", F.xxhash64(F.lit(5), "_id", "b").alias("o")).distinct().orderBy("o").limit(SAMPLED * ranges)
    places = f"array<struct<_id:{dict(rows.dtypes)['_id']},b:bigint>>"
    picked = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda k: F.get("s", F.floor(k * F.size("s") / ranges).cast("int")))
    found = sample.agg(F.array_sort(F.collect_list(place)).alias("s")).select(F.to_json(F.array_distinct(F.filter(picked, lambda x: x.isNotNull())))).first()[0]
    held = F.from_json(F.lit(found or "[]"), places)  # a constant to the plan
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(ranges.bit_length()))])
    bucket = F.aggregate(steps, F.lit(0), lambda at, k: F.when((at + k <= F.size(held)) & (F.get(held, at + k - 1) <= place), at + k).otherwise(at))
    placed = rows.withColumn("bucket", bucket)
    heads = placed.groupBy("bucket").agg(F.max(place).alias("m"))
    # the first row of a window follows the last row of the window above it; the very first follows the very last
    above = F.lead("bucket").over(Window.orderBy("bucket"))  # one row per range
    first = F.first("bucket").over(Window.orderBy("bucket"))
    targets = F.broadcast(heads.select(F.col("m._id").alias("_m"), F.col("m.b").alias("_b"), F.coalesce(above, first).alias("bucket")))
    copies = rows.join(targets, rows["_id"].eqNullSafe(F.col("_m")) & (rows["b"] == F.col("_b"))).select("_id", "body", "b", "bucket", F.lit(True).alias("copy"))
    own = placed.withColumn("copy", F.lit(False)).unionByName(copies)
    hashed = own.withColumn("h", digest(canonical(F.col("body"))))
    order = Window.partitionBy("bucket").orderBy("copy", F.col("_id").desc_nulls_last(), F.desc("b"))
    led = hashed.select("*", *[F.lead(c).over(order).alias(f"next_{c.strip('_')}") for c in ("_id", "body", "b", "h")])
    return led.where("not copy").drop("copy", "bucket")


def edited_text(body: Column, following: Column) -> Column:
    """The last third of the code points (rounded down) replaced by as many from the start of ``following``."""
    n = F.length(body)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(body, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def edited_fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Digest = digest128) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    An exact fingerprint's likeness is 1 or 0. Null texts count as empty; an only row is its own next; repeated rows follow
    each other. An empty table gives no rows.
    """
    led = with_next(documents, doc_id, text, digest)
    made = led.withColumn("edited", edited_text(F.col("body"), F.col("next_body")))
    marks = written(
        made.select(
            "_id", "b", "h", "next_id", "next_b", "next_h",
            F.length("body").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            digest(canonical(F.col("edited"))).alias("he"),
        ),
        "digests",
    )
    hashes = marks.select("h").union(marks.select(F.col("he").alias("h"))).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared = small(written(hashes, "shared"))
    rows = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    originals = rows.select("_id", F.xxhash64(F.lit(3), "body").alias("b"), canonical(F.col("body")).alias("canon")).withColumn("h", digest(F.col("canon")))
    originals = originals.join(shared, "h", "left_semi")
    pairs = small(written(marks.join(shared.withColumnRenamed("h", "he"), "he", "left_semi").select("_id", "b", "next_id", "next_b", "he").distinct(), "edited"))
    hashed = rows.withColumn("rb", F.xxhash64(F.lit(3), "body")).withColumnRenamed("_id", "rid")
    first = hashed.join(pairs, F.col("rid").eqNullSafe(F.col("_id")) & (F.col("rb") == F.col("b"))).select("_id", "b", "next_id", "next_b", "he", "body").distinct()
    second = hashed.join(pairs, F.col("rid").eqNullSafe(F.col("next_id")) & (F.col("rb") == F.col("next_b"))).select("_id", "b", "next_id", "next_b", F.col("body").alias("following")).distinct()
    keys = ["_id", "b", "next_id", "next_b"]
    met = first.alias("x").join(second.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    changed = met.select(*[F.col(f"x.{k}").alias(k) for k in keys], F.col("x.he").alias("h"), canonical(edited_text(F.col("x.body"), F.col("y.following"))).alias("canon"))
    both = originals.select("h", "canon").union(changed.select("h", "canon"))
    unequal = written(unequal_buckets(both), "unequal")
    mark, mark_edited, mark_next = F.col("h"), F.col("he"), F.col("next_h")
    if not unequal.isEmpty():
        numbered = variants(both, unequal).where("variant > 1")
        own = originals.join(numbered, ["h", "canon"]).select("_id", "b", F.concat("h", F.lit("-"), "variant").alias("f")).distinct()
        theirs = changed.join(numbered, ["h", "canon"]).select(*keys, F.concat("h", F.lit("-"), "variant").alias("fe")).distinct()
        m = marks.alias("m")
        m = m.join(own.alias("o"), F.col("m._id").eqNullSafe(F.col("o._id")) & (F.col("m.b") == F.col("o.b")), "left").select("m.*", "f").alias("m")
        m = m.join(own.withColumnRenamed("f", "fn").alias("o"), F.col("m.next_id").eqNullSafe(F.col("o._id")) & (F.col("m.next_b") == F.col("o.b")), "left").select("m.*", "fn").alias("m")
        marks = m.join(theirs.alias("t"), [F.col(f"m.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], "left").select("m.*", "fe")
        mark, mark_edited, mark_next = F.coalesce("f", "h"), F.coalesce("fe", "he"), F.coalesce("fn", "next_h")
    return marks.select(
        F.col("_id").alias(doc_id),
        "n_chars",
        "edited_sha256",
        mark.alias("fingerprint"),
        mark_edited.alias("edited_fingerprint"),
        (mark == mark_edited).cast("double").alias("near_edited"),
        (mark == mark_next).cast("double").alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document's fingerprint, its edited text's, and how alike they are."""
    return edited_fingerprints(tables(spark, sf_dir, "documents"))

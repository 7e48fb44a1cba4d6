"""Rows that every operator must stand: nulls, empties, long and repeated texts, shared ids."""

from __future__ import annotations

import random


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "béta", "Gamma", "delta,", "eps.", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]) + str(rng.randrange(50)) for _ in range(n))


LONG = prose(99, 30000)
ROWS = [
    (0, None, "en", "a"),
    (1, "", "en", "a"),
    (2, "   \n\t ", None, None),
    (3, "one two", "en", "a"),
    (4, prose(4, 200), "en", "a"),
    (5, prose(4, 200), "en", "b"),
    (5, prose(4, 200), "en", "b"),  # a row that repeats
    (6, prose(4, 200) + " tail", "de", "b"),
    (7, LONG, "de", "a"),
    (8, "x" * 50000, "de", "a"),
    (9, "!!! ??? ---", "fr", None),
    (10, prose(10, 60) + " " + prose(4, 80), "fr", "c"),
    (11, "Müller straße ＡＢＣ  ﬁne text", "de", "c"),
]


def documents(spark, rows=ROWS, extra: bool = True):
    """With columns whose names are those of results."""
    df = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for name in ("score", "spans", "hits", "fingerprint", "start", "_text", "_id", "v", "h", "queue", "n_words"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return documents(spark).limit(0)

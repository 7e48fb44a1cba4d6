"""Documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, jaccard, langid, packing, secrets
from graphloom.llm import spans as S
from graphloom.llm.frames import tables, written

#: Rows of an Arrow batch: ten thousand texts, Spark's default, are tens of megabytes in each of the processes that hold them.
ARROW_ROWS = 1000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Not expressible in SQL: the stages hold trained machines, MinHash and a tokenizer.
ORACLE_SQL = None


def _small_batches(spark: SparkSession) -> None:
    """From now on, as a stage's rows are only read after it has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language (null, or without a letter) go; a missing ``lang`` is filled in, by ``und`` if no text is labelled."""
    _small_batches(spark)
    kept = docs.select(*COLUMNS).where(langid.lettered(F.col("text")))
    found = langid.identify(kept, langid.train(docs))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least id."""
    _small_batches(spark)
    return jaccard.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    _small_batches(spark)
    clean = decontaminate.decontaminated(docs.select(*COLUMNS), tables(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    _small_batches(spark)
    found = secrets.find_secrets(docs.select(*COLUMNS))
    clean = found.withColumn("text", S.redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 in the proportions of the sources."""
    _small_batches(spark)
    import public_tokenizers

    return packing.packed(packing.tokenized(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

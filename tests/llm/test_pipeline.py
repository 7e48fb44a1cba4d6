import pytest

import corpus_pipeline
from graphloom.llm.frames import written
from graphloom.llm.queries import oracle_sql, queries
from tests.llm.cases import ROWS, documents, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    secret = "here token = abcdefgh12345678 stays out " + prose(70, 90)
    rows = ROWS + [(30, secret, "en", "a"), (31, prose(71, 40) + " " + prose(900, 30), "en", "b")]
    documents(spark, rows, extra=False).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, prose(900, 30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: {r.doc_id for r in seen[name].collect()}
    assert ids("language_id") == {i for i, *_ in ROWS} - {0, 1, 2, 9} | {30, 31}
    assert ids("near_duplicates") == ids("language_id") - {5, 6}
    assert ids("decontamination") == ids("near_duplicates") == ids("secrets")
    texts = {r.doc_id: r.text for r in seen["secrets"].collect()}
    assert "[REDACTED]" in texts[30] and "abcdefgh12345678" not in texts[30] and prose(900, 30)[:40] not in texts[31]
    assert {r.doc_id for r in seen["packing"].collect()} == ids("secrets")


def test_run_and_registry(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert [len([q for q in queries() if q.startswith(f"op{n}_")]) for n in range(1, 11)] == [1] * 10
    assert set(oracle_sql()) <= set(queries())


def test_documents_without_a_known_language_stay(spark):
    """No labels at all, labels on letterless texts alone, and ``und`` as a label: every text with a letter stays."""
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    texts = [(1, "one two"), (2, "trois quatre"), (3, None), (4, "!!!")]
    for labels in ([None] * 4, [None, None, "en", "en"], ["und", None, None, None]):
        rows = [(i, t, g, None) for (i, t), g in zip(texts, labels)]
        got = stage(spark, documents(spark, rows, extra=False), "").collect()
        assert {(r.doc_id, r.lang) for r in got} == {(1, "und"), (2, "und")}

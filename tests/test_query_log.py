"""Many queries at once: the rows of plain BM25, without a row for each match."""

import pytest
from pyspark.sql import functions as F

from tamarack import queries
from tamarack.operators import retrieve

# "common" has idf 0, w0 to w6 are in every seventh text each.
TEXTS = [f"common w{i % 7} w{i % 5} v{i % 11} " + f"x{i} " * (i % 4) for i in range(150)] + ["", None, "common", "lonely word"]
ASKED = [f"w{i % 7} v{i % 11} w{i % 3} {'common' if i % 2 else ''} no{i}" for i in range(300)] + ["common", "lonely", "common lonely", "x7 x7 w1", "", "zzz"]


def _tables(spark):
    docs = spark.createDataFrame([(1000 - 3 * i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    return docs, spark.createDataFrame(list(enumerate(ASKED)), "qid bigint, text string")


def _moved(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("size", [10_000, 100])
def test_same_rows(spark, monkeypatch, size):
    monkeypatch.setattr(retrieve, "BLOCK_POSTINGS", size)
    docs, asked = _tables(spark)
    rows = lambda f, k: sorted(map(tuple, f(docs, asked, k=k).collect()))
    for k in (5, 200):
        assert rows(retrieve.bm25_many, k) == rows(retrieve.bm25, k)


def test_matches_are_not_rows(spark, tmp_path):
    docs, asked = _tables(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    asked.select(F.col("qid").alias("query_id"), F.col("text").alias("q_text")).write.parquet(f"{tmp_path}/query_log.parquet")
    before = _moved(spark)
    assert queries.QUERIES["bm25_query_log"](spark, str(tmp_path)).count() > 1000
    assert _moved(spark) - before < 10_000  # matches: about 300 queries x 3 terms x 20 texts

"""Near-duplicates by whole texts, and by the first characters and words only."""

from pyspark.sql import functions as F

from tamarack.functions.text import simhash, simhash_whole
from tamarack.operators import dedup
from tamarack.streaming.ingest import StreamIngest

HEAD = " ".join(f"head{i}" for i in range(220))
TEXTS = [HEAD + " " + " ".join(f"{x}{i}" for i in range(800)) for x in ("tail", "other")]


def test_whole_texts(spark, tmp_path):
    d = spark.createDataFrame([(i, f"http://{i}", t, 0, "en") for i, t in enumerate([*TEXTS, TEXTS[0]])], "rec_id bigint, url string, text string, crawl_ts bigint, lang string")
    flags = lambda **k: [r["is_dup"] for r in dedup.greedy_dedup(d, "rec_id", **k).orderBy("rec_id").collect()]
    assert flags(whole=False) == [False, True, True] and flags() == [False, False, True]
    assert [r["rec_id"] for r in dedup.ingest(d, whole=False).collect()] == [0]
    assert sorted(r["rec_id"] for r in dedup.ingest(d).collect()) == [0, 1]
    s = StreamIngest(spark, str(tmp_path / "ix"))
    s.process(d.where("rec_id < 1"), 0)
    s.process(d.where("rec_id >= 1"), 1)
    assert s.index.table("segments").agg(F.sum("num_docs")).first()[0] == 2


def test_blocks_make_no_difference(spark):
    d = spark.createDataFrame([(0, " ".join(f"w{i % 7}" for i in range(20_000))), (1, " ".join(f"w{i}" for i in range(7)))], "doc_id bigint, text string")
    a, b = d.select(simhash_whole("text").alias("f"), simhash("text").alias("g")).collect()
    assert b["f"] == b["g"] == a["f"]

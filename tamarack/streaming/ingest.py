"""Streaming ingest: files of records become segments, each micro-batch once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import simhash, simhash_whole, strip, tokens
from tamarack.operators import dedup
from tamarack.operators.index import BUCKETS, Index
from tamarack.plans.stage import Manifest, written

SCHEMA = "rec_id bigint, url string, text string, crawl_ts bigint, lang string"


class StreamIngest:
    """OP-L1, OP-K5, OP-D4 over micro-batches: the stream's checkpoint is the write-ahead log, and the index notes which batches
    it has taken in.

    Kept fingerprints are a table in the index folder, one directory for each batch; a batch meets them by bit blocks and never
    reads old texts. A batch that is run again after a failure is done anew if it had not been committed, else left alone.
    ``whole`` False compares by the first characters and words only; an index must do so from its first batch on or not at all.
    """

    def __init__(self, spark: SparkSession, index_path: str, min_chars: int = 100, min_tokens: int = 10, buckets: int = BUCKETS, whole: bool = True):
        self.spark, self.index = spark, Index(spark, index_path, buckets)
        self.min_chars, self.min_tokens, self.whole = min_chars, min_tokens, whole
        self.fps = f"{self.index.path}/fingerprints"
        self.log = Manifest(spark, self.fps)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        version, state = self.log.read()
        taken = state.get("batches", {})
        t = batch.withColumn("text", strip(F.col("text"))).where(F.col("url").startswith("http") & (F.length("text") >= self.min_chars))
        t = written(t.withColumn("fp", simhash_whole("text") if self.whole else simhash(F.substring("text", 1, dedup.DEDUP_CHARS))), "batch")
        name = f"batch-{batch_id}"
        if name not in taken:
            cls = written(dedup.classes(t, "rec_id"), "classes")
            if taken:
                known = self.spark.read.parquet(*(f"{self.fps}/{p}" for p in taken.values()))
                cls = written(cls.join(dedup.near_to(cls, known), "fp", "left_anti"), "classes")
            kept = dedup.greedy_kept(cls, dedup.near_pairs(cls))
            place = f"{name}-{uuid.uuid4().hex[:8]}"
            cls.join(kept, "first", "left_semi").select("fp", F.col("first").alias("rec_id")).write.mode("errorifexists").parquet(f"{self.fps}/{place}")
            taken = taken | {name: place}
            self.log.commit(version, {"batches": taken})
        kept = self.spark.read.parquet(f"{self.fps}/{taken[name]}").select("rec_id")
        docs = t.join(kept, "rec_id", "left_semi").where(F.size(tokens(F.col("text"))) >= self.min_tokens)
        self.index.add(docs.drop("fp").withColumnRenamed("rec_id", "doc_id"), batch=name)

    def run(self, source: str, checkpoint: str, files_per_batch: int = 1, fmt: str = "parquet"):
        """Takes in all files there are, ``files_per_batch`` at a time, and ends."""
        s = self.spark.readStream.format(fmt).schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(source)
        q = s.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

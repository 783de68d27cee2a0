"""Choosing and merging segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.operators.index import Index, segment_bases, with_local_ids

MAX_PER_TIER = MERGE_FACTOR = 10


def merge_candidates(segments: DataFrame, max_per_tier: int = MAX_PER_TIER, merge_factor: int = MERGE_FACTOR) -> DataFrame:
    """OP-M1: the ``merge_factor`` smallest segments (size, then id) once there are more than ``max_per_tier``; else none."""
    w = W.partitionBy(F.lit(1))  # one row for each segment
    s = segments.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("size_bytes", "segment_id")))
    return s.where((F.col("_n") > max_per_tier) & (F.col("_r") <= merge_factor)).drop("_n", "_r")


def merged_docs(docs: DataFrame, chosen: list[int]) -> DataFrame:
    """OP-M2, OP-J7: documents of the chosen segments with ids moved on by the sizes of the segments before."""
    d = docs.where(F.col("segment_id").isin(chosen))
    bases = segment_bases(d.groupBy("segment_id").agg(F.count("*").alias("num_docs"))).select("segment_id", "base")
    return d.join(F.broadcast(bases), "segment_id").withColumn("doc_id", F.col("doc_id") + F.col("base")).drop("base", "segment_id")


def compact(index: Index, max_per_tier: int = MAX_PER_TIER, merge_factor: int = MERGE_FACTOR, tombstones: DataFrame | None = None) -> int | None:
    """OP-K6: merges what ``merge_candidates`` picks by bytes into a new segment and removes the old; None if nothing is due.

    Postings are moved, not made anew: global ids stay what they are, frequencies and lengths are taken over, statistics
    are counted again. ``tombstones`` (doc_id) are left behind. Readers see the old segments or the new one, never both; the old
    files stay for those who still read them, until ``Index.purge``.
    """
    version, state = index.state()
    if not state["segments"]:
        return None
    seg = index.table("segments")
    chosen = [r["segment_id"] for r in merge_candidates(seg, max_per_tier, merge_factor).select("segment_id").collect()]
    if not chosen:
        return None
    gen = seg.where(F.col("segment_id").isin(chosen)).agg(F.max("merge_gen")).first()[0] + 1
    docs = index.table("docs", chosen).drop("local_id").withColumn("segment_id", F.lit(0))
    post = index.table("postings", chosen).drop("term_bucket").withColumn("segment_id", F.lit(0))
    if tombstones is not None:
        docs = docs.join(tombstones.select("doc_id"), "doc_id", "left_anti")
        post = post.join(tombstones.select("doc_id"), "doc_id", "left_anti")
    ids = index.put(version, state, with_local_ids(docs), post, gen, replaced=chosen)
    return ids[0] if ids else None

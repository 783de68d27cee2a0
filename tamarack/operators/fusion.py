"""Rank fusion, freshness, and the search that puts them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.retrieve import top_k

RRF_K = 60
DECAY_DAYS = 30
MODES = ("bm25", "dense", "hybrid")


def rrf(lists: list[DataFrame], k: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """OP-R1, OP-J5: (qid, doc_id, score, rank) of ranked lists (qid, doc_id, rank from 1): sum of 1 / (rrf_k + rank).

    Equal scores keep the order of first appearance: earlier list, then better rank.
    """
    parts = [x.select("qid", "doc_id", F.lit(i).alias("i"), F.col("rank").cast("int").alias("r")) for i, x in enumerate(lists)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    g = u.groupBy("qid", "doc_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("r"))), 6).alias("score"), F.min(F.struct("i", "r")).alias("seen"))
    from pyspark.sql import Window as W

    w = W.partitionBy("qid").orderBy(F.desc("score"), "seen", "doc_id")
    out = g.withColumn("rank", F.row_number().over(w)).select("qid", "doc_id", "score", "rank")
    return out.where(F.col("rank") <= k) if k else out


def freshness(crawl_ts: Column, now: int, decay_days: float = DECAY_DAYS) -> Column:
    """OP-R2: exp(-age / decay); above 1 for times to come, 0 age where the time is missing."""
    age = (F.lit(now) - F.coalesce(crawl_ts, F.lit(now))) / 3600.0
    return F.exp(-age / (decay_days * 24))


def reweighted(hits: DataFrame, docs: DataFrame, now: int, decay_days: float = DECAY_DAYS, resort: bool = False) -> DataFrame:
    """OP-R3, OP-F10, OP-F13, OP-K10: hits with url and time; score times 0.85 + 0.15 freshness.

    The rank is that before the weighting, unless ``resort``. Hits without a document are left out.
    """
    j = hits.join(docs.select("doc_id", "url", "crawl_ts"), "doc_id")
    f = freshness(F.col("crawl_ts"), now, decay_days)
    out = j.select("qid", "rank", "doc_id", "url", "crawl_ts", F.round(F.col("score") * (0.85 + 0.15 * f), 6).alias("score"), F.round(f, 4).alias("freshness_factor"))
    return top_k(out.drop("rank"), 2**31 - 1) if resort else out


def dense_scores(near: DataFrame) -> DataFrame:
    """OP-R4: neighbours as hits: score is 1 - distance."""
    return near.select("qid", F.col("vec_id").alias("doc_id"), F.round(1 - F.col("dist"), 6).alias("score"), "rank")


def fused(mode: str, k: int, sparse: DataFrame | None, dense: DataFrame | None) -> DataFrame:
    """OP-F9, OP-R4: the k hits of a mode from lists of 2k; hybrid without a dense list is the sparse list."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "bm25" or mode == "hybrid" and dense is None:
        return sparse.where(F.col("rank") <= k)
    if mode == "dense":
        return dense.where(F.col("rank") <= k)
    return rrf([sparse, dense], k)

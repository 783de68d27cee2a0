"""Retrieval quality, latency figures, write amplification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)
LATENCY_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def ir_metrics(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """OP-E1, OP-E2, OP-J9: (k, ndcg, map, recall, precision), means over the queries that have a relevant document.

    run: qid, doc_id, score; qrels: qid, doc_id, rel. Gains are linear, discounts log2(rank + 1), the ideal is over all
    judged documents. A query without results counts with zeros.
    """
    judged = qrels.where("rel > 0").select("qid", "doc_id", "rel").distinct()
    ideal = judged.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")))
    ranked = run.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))).where(F.col("r") <= max(cutoffs))
    hit = ranked.join(judged, ["qid", "doc_id"]).withColumn("seen", F.row_number().over(W.partitionBy("qid").orderBy("r")))
    gain = lambda: F.col("rel") / F.log2(F.col("r") + 1.0)
    per_ideal = ideal.groupBy("qid").agg(F.count("*").alias("n"), *(F.sum(F.when(F.col("r") <= k, gain()).otherwise(0.0)).alias(f"i{k}") for k in cutoffs))
    per_hit = hit.groupBy("qid").agg(
        *(F.sum(F.when(F.col("r") <= k, gain()).otherwise(0.0)).alias(f"d{k}") for k in cutoffs),
        *(F.sum(F.when(F.col("r") <= k, F.col("seen") / F.col("r")).otherwise(0.0)).alias(f"a{k}") for k in cutoffs),
        *(F.sum(F.when(F.col("r") <= k, 1).otherwise(0)).alias(f"h{k}") for k in cutoffs),
    )
    j = per_ideal.join(per_hit, "qid", "left").fillna(0)
    mean = lambda e: F.round(F.avg(e), 6)
    one = j.agg(
        *(
            F.struct(
                F.lit(k).alias("k"), mean(F.col(f"d{k}") / F.col(f"i{k}")).alias("ndcg"), mean(F.col(f"a{k}") / F.col("n")).alias("map"),
                mean(F.col(f"h{k}") / F.col("n")).alias("recall"), mean(F.col(f"h{k}") / k).alias("precision"),
            ).alias(f"s{k}")
            for k in cutoffs
        )
    )
    # Without a relevant document there is nothing to take a mean of: no rows.
    return one.select(F.inline(F.array(*(f"s{k}" for k in cutoffs)))).where("ndcg IS NOT NULL")


def index_percentiles(df: DataFrame, value: str, by: list[str] | None = None, points: tuple[tuple[str, float], ...] = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) -> DataFrame:
    """OP-A11, OP-A12: the element at place floor(n p), counting from 0, of the sorted values; null values are left out.

    p50 is at n // 2. Values are counted first, so that equal ones travel once, and places come from running counts.
    """
    from tamarack.operators.index import running_offsets

    by = by or []
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    c = c.withColumn("_g", F.struct(*by) if by else F.lit(0))
    # Places come from sums over ranges of the values, so that no group is sorted in one task.
    c = running_offsets(c, "_g", [value], F.col("c"), "lo").withColumn("hi", F.col("lo") + F.col("c"))
    n = c.groupBy("_g").agg(F.sum("c").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    at = lambda p: F.floor(F.col("n") * F.lit(p))
    out = c.join(n, "_g").groupBy("_g", *by).agg(
        F.max("n").alias("n"), F.max("min").alias("min"), *(F.max(F.when((at(p) >= F.col("lo")) & (at(p) < F.col("hi")), F.col(value))).alias(name) for name, p in points), F.max("max").alias("max")
    )
    return out.drop("_g")


def holding(docs: DataFrame, items: DataFrame, lead: int = 8) -> DataFrame:
    """(qid, doc_id, rel 1): documents (doc_id, text) that hold the text of an item (qid, text) word for word.

    Documents and items meet by a hash of the item's first ``lead`` words, wherever they stand in the document, so texts are
    compared only where these agree. An item whose words cannot be cut off at blanks (fewer than ``lead`` of them) is held
    against all documents by its first word instead. Null and empty items are held by none.
    """
    from tamarack.plans.stage import written

    words = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    it = written(items.where("text <> ''").withColumn("ws", words(F.col("text"))).withColumn("k", F.least(F.size("ws"), F.lit(lead))), "items")
    out = None
    for k in [r[0] for r in it.select("k").distinct().collect()]:  # at most ``lead`` lengths
        # The outermost words may be parts of longer ones in the document: only those between are compared as words.
        inner = max(k - 2, 0)
        key = F.xxhash64(F.concat_ws(" ", F.slice("ws", 2, inner))) if inner else F.lit(0).cast("long")
        own = it.where(F.col("k") == k).select("qid", F.col("text").alias("item"), key.alias("key"))
        if not inner:
            hit = docs.select("doc_id", "text").join(F.broadcast(own), F.col("text").contains(F.col("item")))  # one or two words: few items
        else:
            w = docs.select("doc_id", words(F.col("text")).alias("ws")).where(F.size("ws") >= inner)
            w = w.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ws") - inner + 1), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("ws", i, inner)))))).alias("key"))
            met = w.join(own, "key").select("qid", "doc_id", "item")
            hit = met.join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("item")))
        hit = hit.select("qid", "doc_id", F.lit(1).alias("rel"))
        out = hit if out is None else out.unionByName(hit)
    return out.distinct() if out is not None else items.limit(0).select("qid", F.lit(0).cast("long").alias("doc_id"), F.lit(1).alias("rel"))


def histogram(df: DataFrame, value: str, edges: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """OP-A14: (le, n): rows at or below each edge, the last (+Inf as null) counting all values; nulls count nowhere.

    One conditional count for each edge in a single pass.
    """
    one = df.agg(*(F.count(F.when(F.col(value) <= e, 1)).alias(f"b{i}") for i, e in enumerate(edges)), F.count(value).alias(f"b{len(edges)}"))
    rows = F.array(*(F.struct(F.lit(e).cast("double").alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate((*edges, None))))
    return one.select(F.inline(rows))


def write_amplification(segments: DataFrame) -> DataFrame:
    """OP-A13, OP-E5: postings times rewrites over postings, two places; one row."""
    s = F.coalesce(F.sum("total_postings"), F.lit(0))
    w = F.coalesce(F.sum(F.col("total_postings") * (F.col("merge_gen") + 1)), F.lit(0))
    return segments.agg(F.count("*").alias("num_segments"), s.alias("total_postings"), F.round(w / F.greatest(s, F.lit(1)), 2).alias("write_amplification"))

"""OP-E1, OP-E3, OP-E4, OP-E6, OP-K9: runs that measure the engine: quality, latency, pruning, beam widths, compaction."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators import compaction, evaluate, retrieve, vectors
from tamarack.operators.index import Index
from tamarack.sources.evaluation import SAMPLE


def places(seconds: list[float]) -> dict:
    """p50, p95 and p99 in milliseconds: the elements at n // 2, int(0.95 n) and int(0.99 n) of the sorted list; nothing for none."""
    s = sorted(seconds)
    at = {"min": 0, "p50": len(s) // 2, "p95": int(0.95 * len(s)), "p99": int(0.99 * len(s)), "max": len(s) - 1}
    return {f"{k}_ms": round(s[i] * 1000, 3) for k, i in at.items()} if s else {}


def latency(index: Index, n: int = 100, queries: list[str] | None = None, k: int = 10, warm: int = 2) -> dict:
    """OP-E3: single searches one after another, the sample over and over, after a few that do not count."""
    q, took = queries or SAMPLE, []
    for i in range(warm + n):
        began = time.perf_counter()
        retrieve.search_index(index, q[i % len(q)], k).collect()
        if i >= warm:
            took.append(time.perf_counter() - began)
    return {"n_queries": n, "k": k, "num_docs": index.num_docs(), **places(took)}


def throughput(index: Index, queries: DataFrame, k: int = 10, pruned: bool = True) -> dict:
    """Queries (qid, text) answered together: queries a second."""
    began = time.perf_counter()
    retrieve.search_many(index, queries, k, pruned=pruned).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    n = queries.count()
    return {"n_queries": n, "seconds": round(took, 3), "queries_per_s": round(n / took, 1), "pruned": pruned}


def pruning(index: Index, queries: DataFrame, k: int = 10) -> dict:
    """OP-E4: the same queries with and without bounds, and how many (query, document) pairs each scores in full."""
    q = retrieve.query_terms(queries)
    post = index.table("postings").join(q.select("term").distinct(), "term", "left_semi")
    every = post.join(q, "term").select("qid", "segment_id", "doc_id").distinct().count()
    plain, by_bounds = throughput(index, queries, k, False), throughput(index, queries, k, True)
    a, b = (retrieve.search_many(index, queries, k, pruned=p).select("qid", "doc_id", "rank") for p in (False, True))
    return {"pairs": every, "plain_s": plain["seconds"], "pruned_s": by_bounds["seconds"], "rows_differing": a.exceptAll(b).count() + b.exceptAll(a).count()}


def beam_widths(graphs: vectors.GraphIndex, all_: DataFrame, asked: DataFrame, k: int = 10, efs: tuple[int, ...] = (10, 20, 50, 100, 200, 400)) -> list[dict]:
    """OP-E6, OP-A12, OP-K9, OP-V10: recall at k and the time of a query for each beam width, single queries on one loaded shard after another.

    The graphs are searched here, shard by shard as ``toLocalIterator`` brings them, so that the time is that of the search alone.
    """
    truth = {}
    for r in vectors.knn(all_, asked, k).select("qid", "vec_id").collect():
        truth.setdefault(r["qid"], set()).add(r["vec_id"])
    ids, q = zip(*[(r["vec_id"], r["embedding"]) for r in asked.select("vec_id", "embedding").where("embedding IS NOT NULL").collect()])
    folder = graphs.manifest.read()[1]["graphs"]
    took = {ef: [0.0] * len(ids) for ef in efs}
    found: dict = {ef: [[] for _ in ids] for ef in efs}
    for row in graphs.spark.read.parquet(f"{graphs.folder}/{folder}").toLocalIterator():
        g = vectors.Graph.restored(bytes(row["graph"]))
        for ef in efs:
            for i, x in enumerate(q):
                began = time.perf_counter()
                found[ef][i] += g.search(x, k, ef)
                took[ef][i] += time.perf_counter() - began
    out = []
    for ef in efs:
        hit = sum(len({j for _, j in sorted(f)[:k]} & truth[i]) for i, f in zip(ids, found[ef]))
        p = places(took[ef])
        out.append({"ef": ef, "recall": round(hit / max(sum(map(len, truth.values())), 1), 4), "p50_ms": p["p50_ms"], "p95_ms": p["p95_ms"]})
    return out


def quality(index: Index, queries: DataFrame, qrels: DataFrame, k: int = 10) -> list[dict]:
    """OP-E1: the metrics of a run of queries (qid, text) against judgements (qid, doc_id, rel)."""
    run = retrieve.search_many(index, queries, k).select("qid", "doc_id", "score")
    return [r.asDict() for r in evaluate.ir_metrics(run, qrels).collect()]


def amplification(index: Index, batches: list[DataFrame], **limits) -> dict:
    """OP-E5: batches written one after another, compacted after each as is due: rewrites of a posting."""
    for b in batches:
        index.add(b)
        while compaction.compact(index, **limits) is not None:
            pass
    return evaluate.write_amplification(index.table("segments").select("total_postings", F.col("merge_gen"))).first().asDict()

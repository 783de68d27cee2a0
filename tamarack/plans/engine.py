"""The engine as one object: ingest, index, search, metrics."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import compaction, dedup, evaluate, fusion, retrieve, vectors
from tamarack.operators.index import Index
from tamarack.plans import profile


class Engine:
    """OP-S13, OP-R4 to R6: search over an index folder and the vector graphs kept beside it.

    ``vectors_df`` (vec_id, embedding) is put into graphs once, unless they are there. ``encoder`` turns a query text into a vector;
    without it, or without graphs, only sparse search is possible and hybrid falls back to it.
    """

    def __init__(self, spark: SparkSession, index_path: str, vectors_df: DataFrame | None = None, encoder=None, now: int | None = None):
        self.spark, self.index = spark, Index(spark, index_path)
        self.graphs, self.encoder, self.now = vectors.GraphIndex(spark, f"{index_path.rstrip('/')}/graphs"), encoder, now
        self.latencies: list[float] = []
        self.seen = self.indexed = 0
        self.began = time.time()
        if vectors_df is not None and not self.graphs.exists():
            self.graphs.build(vectors_df)

    def ingest(self, records: DataFrame, max_docs: int | None = None, threshold: int | None = None) -> dict:
        """Filters, de-duplicates and indexes a batch of records (rec_id, url, text, crawl_ts, lang), as one segment or several of
        ``threshold`` bytes; OP-A10: figures of this batch and of all so far."""
        from tamarack.functions.text import xxh64
        from tamarack.plans.stage import written

        began = time.time()
        kept = dedup.ingest(records, max_docs=max_docs).withColumn("content_hash", xxh64("text")).withColumnRenamed("rec_id", "doc_id")
        kept = written(kept, "kept")
        ids = self.index.add(kept, threshold=threshold)
        n, seen = kept.count(), records.count()
        self.seen, self.indexed = self.seen + seen, self.indexed + n
        return {
            "segment_ids": ids, "indexed": n, "seen": seen, "docs_per_s": round(seen / max(time.time() - began, 1e-9), 1),
            "total_seen": self.seen, "total_indexed": self.indexed,
        }

    def embed(self, docs: DataFrame, encode) -> int:
        """OP-V11, OP-V12: graphs over an index's documents. ``encode`` turns a pandas Series of texts into lists of floats."""
        from pyspark.sql import types as T

        made = F.pandas_udf(encode, T.ArrayType(T.FloatType()))
        held = docs.join(self.index.table("docs").select("doc_id"), "doc_id", "left_semi")
        return self.graphs.build(held.select(F.col("doc_id").alias("vec_id"), made("text").alias("embedding")))

    def compact(self) -> int | None:
        return compaction.compact(self.index)

    def search(self, q: str, k: int = 10, mode: str = "hybrid", ef: int = 50) -> DataFrame:
        """(rank, doc_id, url, score, crawl_ts, freshness_factor), in the order of rank."""
        if not q:
            raise ValueError("q must not be empty")
        if not 1 <= k <= 100:
            raise ValueError("k is 1 to 100")
        if mode not in fusion.MODES:
            raise ValueError(f"mode is one of {fusion.MODES}")
        if not 10 <= ef <= 500:
            raise ValueError("ef is 10 to 500")
        began = time.time()
        sparse = dense = None
        if mode != "dense":
            sparse = retrieve.search_index(self.index, q, 2 * k).withColumn("qid", F.lit(0))
        if mode != "bm25" and self.encoder is not None and self.graphs.exists():
            vec = self.spark.createDataFrame([(0, [float(x) for x in self.encoder(q)])], "vec_id bigint, embedding array<float>")
            dense = fusion.dense_scores(self.graphs.search(vec, 2 * k, (ef,)).drop("ef"))
        if mode == "dense" and dense is None:
            raise ValueError("dense search needs vectors and an encoder")
        hits = fusion.fused(mode, k, sparse, dense)
        out = fusion.reweighted(hits, self.index.table("docs"), self.now or int(time.time())).drop("qid").orderBy("rank")
        self.latencies.append(time.time() - began)
        return out

    def respond(self, q: str, k: int = 10, mode: str = "hybrid", ef: int = 50) -> dict:
        """OP-K10: a search as a plain dictionary."""
        began = time.time()
        rows = [r.asDict() for r in self.search(q, k, mode, ef).collect()]
        return {
            "query": q, "mode": mode, "results": rows, "latency_ms": round((time.time() - began) * 1000, 3),
            "num_segments": self.index.num_segments(), "num_docs": self.index.num_docs(),
        }

    def health(self) -> dict:
        return {"status": "ok", "num_docs": self.index.num_docs(), "num_segments": self.index.num_segments(), "vectors": self.graphs.size(), "uptime_s": round(time.time() - self.began, 1)}

    def metrics(self) -> dict:
        """Searches so far, their latencies by bucket and by place, and the postings rewritten."""
        le = [*evaluate.LATENCY_BUCKETS, float("inf")]
        out = {"searches": len(self.latencies), "latency": {str(e): sum(x <= e for x in self.latencies) for e in le}, **profile.places(self.latencies)}
        if self.index.num_segments():
            out |= evaluate.write_amplification(self.index.table("segments")).first().asDict()
        return out


def save_report(df: DataFrame | list[dict], path: str) -> None:
    """OP-K8: a report as indented JSON, one object for a single row. Rows come one after another; none is left out."""
    rows = [r.asDict() for r in df.toLocalIterator()] if isinstance(df, DataFrame) else df
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(rows[0] if len(rows) == 1 else rows, indent=2, default=str) + "\n")

"""Segmented inverted index as tables: documents, postings, terms, segments."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.functions.text import tokens, vbyte_length
from tamarack.plans.stage import Manifest, written

K1, B = 1.2, 0.75
MAX_TF = 255
FLUSH_BYTES = 50 * 1024 * 1024
TOKEN_BYTES = 24
BUCKETS = 64
"""Directories by a hash of the term: a query reads those of its own terms only. An index keeps the number it began with."""


def analyzed(docs: DataFrame) -> DataFrame:
    """Adds ``tokens`` and ``dl`` (OP-A2, every kept token counts); segment 0 where there is no ``segment_id``."""
    if "segment_id" not in docs.columns:
        docs = docs.withColumn("segment_id", F.lit(0))
    return docs.withColumn("tokens", tokens(F.col("text"))).withColumn("dl", F.size("tokens"))


def postings(docs: DataFrame) -> DataFrame:
    """OP-K2, OP-A1: (segment_id, term, doc_id, tf, dl) with tf saturating at 255; doc_id is unique within a segment."""
    t = analyzed(docs).select("segment_id", "doc_id", "dl", F.explode("tokens").alias("term"))
    return t.groupBy("segment_id", "term", "doc_id", "dl").agg(F.least(F.count("*"), F.lit(MAX_TF)).cast("int").alias("tf"))


def segment_stats(docs: DataFrame) -> DataFrame:
    """OP-A4, OP-A5: figures of each segment; one without tokens has no terms and postings."""
    d = analyzed(docs).select("segment_id", "doc_id", "dl", F.array_distinct("tokens").alias("terms"))
    per = d.groupBy("segment_id").agg(
        F.count("*").alias("num_docs"), F.avg("dl").alias("avg_doc_len"), F.min("dl").alias("min_dl"), F.sum(F.size("terms")).alias("total_postings")
    )
    terms = d.select("segment_id", F.explode("terms").alias("term")).distinct().groupBy("segment_id").agg(F.count("*").alias("num_terms"))
    return per.join(terms, "segment_id", "left").withColumn("num_terms", F.coalesce("num_terms", F.lit(0)))


def idf(n: Column, df: Column) -> Column:
    """OP-B1: never below zero."""
    return F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5)))


def tf_norm(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """OP-B2."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def term_stats(post: DataFrame, segments: DataFrame, at_query: bool = False) -> DataFrame:
    """OP-A3, OP-A6, OP-B4, OP-B5: df, max_tf and the greatest score of each term in each segment.

    The bound takes the segment's shortest document (at least 1 token), at query time a document of 1 token.
    """
    t = post.groupBy("segment_id", "term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"))
    j = t.join(segments.select("segment_id", "num_docs", "avg_doc_len", "min_dl"), "segment_id")
    short = F.lit(1) if at_query else F.greatest(F.lit(1), F.col("min_dl"))
    return j.select("segment_id", "term", "df", "max_tf", (idf(F.col("num_docs"), F.col("df")) * tf_norm(F.col("max_tf"), short, F.col("avg_doc_len"))).alias("max_score"))


def gaps(post: DataFrame) -> DataFrame:
    """OP-W4: difference to the id before in a term's list; the first counts from 0."""
    w = W.partitionBy("segment_id", "term").orderBy("doc_id")
    return post.withColumn("gap", F.col("doc_id") - F.coalesce(F.lag("doc_id").over(w), F.lit(0)))


def ungaps(g: DataFrame, order: str = "pos") -> DataFrame:
    """OP-W5: ids from gaps, in the order given."""
    w = W.partitionBy("segment_id", "term").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return g.withColumn("doc_id", F.sum("gap").over(w))


def list_bytes(post: DataFrame) -> DataFrame:
    """OP-C3: bytes of each term's encoded list."""
    g = gaps(post).groupBy("segment_id", "term").agg(F.count("*").alias("df"), F.sum(vbyte_length(F.col("gap")) + 1).alias("body"))
    return g.select("segment_id", "term", "df", (F.col("body") + vbyte_length(F.col("df"))).alias("n_bytes"))


RANGE_ROWS = 500_000


def running_offsets(df: DataFrame, key: str, order: list[str], value: Column, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Exclusive running sum of ``value`` within ``key`` (OP-W3, OP-W6) without one task for a large group.

    Rows are split into ranges of the order, of about ``range_rows`` each however many rows there are; sums of the ranges
    are few and give each range its start.
    """
    d = written(df.withColumn("_v", value.cast("long")), "values")
    parts = max(1, -(-d.count() // range_rows))
    d = written(d.repartitionByRange(parts, key, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    per = d.groupBy(key, "_p").agg(F.sum("_v").alias("_s"))
    w = W.partitionBy(key).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    per = per.select(key, "_p", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_base"))
    own = W.partitionBy(key, "_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return d.join(per, [key, "_p"]).withColumn(name, F.col("_base") + F.coalesce(F.sum("_v").over(own), F.lit(0))).drop("_p", "_v", "_base")


def segment_bases(segments: DataFrame) -> DataFrame:
    """OP-W3: first global id of each segment, in the order of segment ids; one row for each segment."""
    w = W.partitionBy(F.lit(1)).orderBy("segment_id").rowsBetween(W.unboundedPreceding, -1)  # segments are few
    return segments.select("segment_id", "num_docs", F.coalesce(F.sum("num_docs").over(w), F.lit(0)).cast("long").alias("base"))


def locate(bases: DataFrame, ids: DataFrame) -> DataFrame:
    """OP-J4: segment and local id of global ids (column ``global_id``); those beyond the last are left out.

    Each id takes the last base at or below it, found in the sorted array of bases (a few numbers).
    """
    one = bases.where("num_docs > 0").agg(F.array_sort(F.collect_list(F.struct("base", "segment_id", "num_docs"))).alias("b")).first()["b"]
    if not one:
        return ids.limit(0).select("global_id", F.lit(0).alias("segment_id"), F.col("global_id").alias("local_id"))
    arr = F.array(*(F.struct(F.lit(r["base"]).alias("base"), F.lit(r["segment_id"]).alias("segment_id"), F.lit(r["num_docs"]).alias("num_docs")) for r in one))
    hit = ids.where("global_id >= 0").withColumn("_s", F.try_element_at(F.filter(arr, lambda s: s["base"] <= F.col("global_id")), F.lit(-1)))
    local = F.col("global_id") - F.col("_s.base")
    return hit.where(local < F.col("_s.num_docs")).select("global_id", F.col("_s.segment_id").alias("segment_id"), local.alias("local_id"))


def segment_cut(docs: DataFrame, threshold: int = FLUSH_BYTES) -> DataFrame:
    """OP-K3: segment of each document by a running size of 24 bytes a token, cut at multiples of the threshold.

    Sums run over all documents in order, so a cut falls on the document that crosses a multiple; unlike a counter that is
    reset, what crosses is not thrown away.
    """
    d = running_offsets(docs.withColumn("_k", F.lit(0)), "_k", ["doc_id"], F.col("dl") * TOKEN_BYTES, "_at")
    return d.withColumn("segment_id", F.floor(F.col("_at") / threshold).cast("int")).drop("_k", "_at")


def with_local_ids(docs: DataFrame) -> DataFrame:
    """OP-W2: ``local_id``, 0, 1, 2 ... within each segment in the order of doc_id."""
    return running_offsets(docs, "segment_id", ["doc_id"], F.lit(1), "local_id")


#: Columns of a document in an index, beyond those of its segment.
META = (("url", "string"), ("crawl_ts", "bigint"), ("content_hash", "bigint"), ("lang", "string"))


class Index:
    """An index in a folder: tables docs, postings, terms, segments, each with one directory for a segment.

    A manifest says which segments count. Segment ids come from it and are never given twice, so no writer can meet another's
    segment; a write that is not in the manifest does not exist for readers, and the swap of a compaction is one version.
    """

    TABLES = ("docs", "postings", "terms", "segments")

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.manifest = Manifest(spark, self.path)

    def state(self) -> tuple[int, dict]:
        """Version, and segments {id: attempt}, the next id and the batches taken in {batch: segment ids}."""
        version, s = self.manifest.read()
        return version, s or {"segments": {}, "next": 0, "batches": {}}

    def segment_ids(self) -> list[int]:
        """OP-S7: segments present; none for a missing folder."""
        return sorted(map(int, self.state()[1]["segments"]))

    def add(self, docs: DataFrame, batch: str | None = None, merge_gen: int = 0, threshold: int | None = None) -> list[int]:
        """OP-K1, OP-K3 to K5: writes a batch (doc_id, text and any of META) as one segment, or as several of about
        ``threshold`` bytes of tokens; the ids of the new segments.

        A batch without rows writes nothing. ``batch`` names it: one that was taken in before is left alone, so that a stream
        may repeat it.
        """
        version, state = self.state()
        if batch is not None and batch in state["batches"]:
            return state["batches"][batch]
        for name, kind in META:
            if name not in docs.columns:
                docs = docs.withColumn(name, F.lit(None).cast(kind))
        d = written(analyzed(docs.drop("segment_id")).select("doc_id", *(n for n, _ in META), "tokens", "dl"), "analyzed")
        if d.isEmpty():
            return []
        if threshold is not None:
            cut = segment_cut(d.select("doc_id", "dl"), threshold).select("doc_id", "segment_id")
            d = d.join(cut, "doc_id")
        else:
            d = d.withColumn("segment_id", F.lit(0))
        t = d.select("segment_id", "doc_id", "dl", F.explode("tokens").alias("term"))
        post = t.groupBy("segment_id", "term", "doc_id", "dl").agg(F.least(F.count("*"), F.lit(MAX_TF)).cast("int").alias("tf"))
        return self.put(version, state, with_local_ids(d.drop("tokens")), post, merge_gen, batch)

    def put(self, version: int, state: dict, docs: DataFrame, post: DataFrame, merge_gen: int, batch: str | None = None, replaced: list[int] = ()) -> list[int]:
        """Writes documents and postings under new segment ids, counts them, and makes them the next version in place of ``replaced``."""
        attempt, first = uuid.uuid4().hex[:12], state["next"]
        moved = lambda df: df.withColumn("segment_id", F.col("segment_id") + first)
        place = lambda t: f"{self.path}/{t}/attempt={attempt}"
        moved(docs).write.mode("errorifexists").partitionBy("segment_id").parquet(place("docs"))
        post = moved(post).withColumn("term_bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        # A bucket of one segment is sorted by term; a frequent term is spread over ranges of its documents.
        post = post.repartitionByRange("segment_id", "term_bucket", "term", "doc_id").sortWithinPartitions("segment_id", "term_bucket", "term", "doc_id")
        post.write.mode("errorifexists").partitionBy("segment_id", "term_bucket").option("parquet.bloom.filter.enabled#term", "true").parquet(place("postings"))
        d, got = self._back(place("docs"), docs, "segment_id"), self._back(place("postings"), post, "segment_id", "term_bucket")
        seg = d.groupBy("segment_id").agg(F.count("*").alias("num_docs"), F.avg("dl").alias("avg_doc_len"), F.min("dl").alias("min_dl"))
        num = got.groupBy("segment_id", "term").agg(F.count("*").alias("df")).groupBy("segment_id").agg(F.count("*").alias("num_terms"), F.sum("df").alias("total_postings"))
        seg = seg.join(num, "segment_id", "left").fillna(0, ["num_terms", "total_postings"]).withColumn("merge_gen", F.lit(merge_gen))
        terms = term_stats(got, seg)
        terms.repartitionByRange("segment_id", "term").sortWithinPartitions("segment_id", "term").write.mode("errorifexists").partitionBy("segment_id").parquet(place("terms"))
        ids = sorted(r[0] for r in seg.select("segment_id").collect())
        sizes = F.create_map(*[F.lit(x) for i in ids for x in (i, sum(self._bytes(f"{place(t)}/segment_id={i}") for t in ("docs", "postings", "terms")))])
        seg.withColumn("size_bytes", sizes[F.col("segment_id")]).coalesce(1).write.mode("errorifexists").partitionBy("segment_id").parquet(place("segments"))
        segments = {k: v for k, v in state["segments"].items() if int(k) not in replaced} | {str(i): attempt for i in ids}
        batches = state["batches"] | ({batch: ids} if batch is not None else {})
        self.manifest.commit(version, state | {"segments": segments, "next": max(ids, default=first - 1) + 1, "batches": batches})
        return ids

    def _back(self, path: str, df: DataFrame, *by: str) -> DataFrame:
        """What was written, read with its schema; a table without rows has no files to tell it."""
        return self.spark.read.schema(df.select(*(c for c in df.columns if c not in by), *by).schema).parquet(path)

    def _bytes(self, path: str) -> int:
        """OP-A15: bytes of all files of a folder."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0

    def table(self, name: str, segment_ids: list[int] | None = None) -> DataFrame:
        """A table over the segments present, or some of them, with ``segment_id``."""
        known = self.state()[1]["segments"]
        ids = sorted(map(int, known)) if segment_ids is None else segment_ids
        if not ids:
            raise FileNotFoundError(f"no segment in {self.path}")
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/attempt={known[str(i)]}/segment_id={i}" for i in ids)).drop("attempt")

    def num_docs(self) -> int:
        """OP-S8; 0 for an empty index."""
        return int(self.table("segments").agg(F.sum("num_docs")).first()[0]) if self.segment_ids() else 0

    def num_segments(self) -> int:
        return len(self.segment_ids())

    def postings_of(self, terms: list[str]) -> DataFrame:
        """OP-J1, OP-B10: postings of some terms. The buckets are worked out first, so that other directories are not read."""
        terms = list(dict.fromkeys(terms))
        keys = self.spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = [r[0] for r in keys.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        return self.table("postings").where(F.col("term_bucket").isin(buckets) & F.col("term").isin(terms))

    def doc_freq(self, terms: list[str]) -> DataFrame:
        """OP-B10: (segment_id, term, df, max_tf, max_score) of some terms, from the terms table alone."""
        return self.table("terms").where(F.col("term").isin(list(dict.fromkeys(terms))))

    def purge(self) -> int:
        """Deletes what no version of the manifest that is still kept names: leftovers of failed or replaced writes."""
        kept = set(self.state()[1]["segments"].values())
        gone = 0
        for t in self.TABLES:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{t}")
            fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for s in fs.listStatus(p) if fs.exists(p) else []:
                name = s.getPath().getName()
                if name.startswith("attempt=") and name.split("=")[1] not in kept:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone

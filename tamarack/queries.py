"""Queries of the engine's own operators and, where SQL has the parts, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.functions import codec
from tamarack.functions.text import epoch_seconds, tokens, xxh64
from tamarack.operators import compaction, dedup, evaluate, fusion, index, journal, retrieve, vectors
from tamarack.plans.stage import cut, fresh_path, written

NOW = 1_740_787_200
SEGMENTS = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str, segments: int = 1) -> DataFrame:
    """Documents, spread over segments by id."""
    return table(spark, d, "documents").withColumn("segment_id", (F.col("doc_id") % segments).cast("int"))


def literal(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "qid int, text string")


_TOKENS = r"list_filter(regexp_extract_all(replace(lower(coalesce(text, '')), 'ς', 'σ'), '[\p{L}\p{N}_]+'), lambda x: length(x) BETWEEN 2 AND 50)"


def _corpus(segments: int = 1) -> str:
    return (
        f"d AS (SELECT (doc_id % {segments})::INT AS segment_id, doc_id, {_TOKENS} AS tokens FROM documents), "
        "n AS (SELECT segment_id, doc_id, len(tokens)::INT AS dl, tokens FROM d), "
        "p AS (SELECT segment_id, doc_id, dl, term, least(count(*), 255)::INT AS tf FROM (SELECT segment_id, doc_id, dl, unnest(tokens) AS term FROM n) GROUP BY ALL), "
        "g AS (SELECT segment_id, count(*) AS num_docs, avg(dl) AS avg_doc_len, min(dl) AS min_dl FROM n GROUP BY 1), "
        "t AS (SELECT segment_id, term, count(*) AS df, max(tf) AS max_tf FROM p GROUP BY ALL)"
    )


_IDF = "greatest(0.0, ln((num_docs - df + 0.5) / (df + 0.5)))"


def _norm(tf: str, dl: str, k1: float = 1.2, b: float = 0.75) -> str:
    return f"{tf} * {k1 + 1} / ({tf} + {k1} * ({1 - b} + {b} * {dl} / avg_doc_len))"


def _bm25(queries: str, k: int = 10, k1: float = 1.2, b: float = 0.75, segments: int = 1, cols: str = "qid, doc_id, score, rank") -> str:
    """queries: SQL giving qid, text."""
    return (
        f"WITH {_corpus(segments)}, q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_TOKENS}) AS term FROM ({queries})) GROUP BY ALL), "
        f"s AS (SELECT qid, doc_id, round(sum(qtf * {_IDF} * {_norm('tf', 'dl', k1, b)}), 6) AS score FROM p JOIN t USING (segment_id, term) JOIN g USING (segment_id) JOIN q USING (term) GROUP BY ALL), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM s) "
        f"SELECT {cols} FROM r WHERE rank <= {k}"
    )


# analysis and index


@query(f"SELECT doc_id, len(ts)::INT AS n_tokens, len(list_distinct(ts))::INT AS n_distinct FROM (SELECT doc_id, {_TOKENS} AS ts FROM documents)")
def tokenize_stats(spark, d):
    """Tokens and different tokens of each document."""
    return documents(spark, d).select("doc_id", F.size(tokens(F.col("text"))).alias("n_tokens"), F.size(F.array_distinct(tokens(F.col("text")))).alias("n_distinct"))


@query(f"WITH {_corpus()} SELECT term, df FROM t")
def term_doc_freq(spark, d):
    """Documents of each term."""
    return index.postings(documents(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {_corpus()} SELECT doc_id, term, tf FROM p")
def posting_tf(spark, d):
    """Frequency of each term in each document, at most 255."""
    return index.postings(documents(spark, d)).select("doc_id", "term", "tf")


@query(
    f"WITH {_corpus(SEGMENTS)} SELECT segment_id, num_docs, round(avg_doc_len, 6) AS avg_doc_len, min_dl, (SELECT count(*) FROM p WHERE p.segment_id = g.segment_id) AS total_postings, "
    "(SELECT count(*) FROM t WHERE t.segment_id = g.segment_id) AS num_terms FROM g"
)
def segment_stats(spark, d):
    """Figures of four segments."""
    return index.segment_stats(documents(spark, d, SEGMENTS)).withColumn("avg_doc_len", F.round("avg_doc_len", 6))


def _bounds(spark, d, at_query):
    docs = documents(spark, d, SEGMENTS)
    t = index.term_stats(index.postings(docs), index.segment_stats(docs), at_query)
    return t.withColumn("max_score", F.round("max_score", 6))


@query(f"WITH {_corpus(SEGMENTS)} SELECT segment_id, term, df, max_tf, round({_IDF} * {_norm('max_tf', 'greatest(1, min_dl)')}, 6) AS max_score FROM t JOIN g USING (segment_id)")
def term_upper_bounds_index(spark, d):
    """Greatest score of each term, by the segment's shortest document."""
    return _bounds(spark, d, False)


@query(f"WITH {_corpus(SEGMENTS)} SELECT segment_id, term, df, max_tf, round({_IDF} * {_norm('max_tf', '1')}, 6) AS max_score FROM t JOIN g USING (segment_id)")
def term_upper_bounds_query(spark, d):
    """Greatest score of each term, by a document of one token."""
    return _bounds(spark, d, True)


_GAPS = f"WITH {_corpus()}, w AS (SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM p)"


@query(_GAPS + " SELECT term, doc_id, gap FROM w")
def posting_gaps(spark, d):
    """Gaps between the ids of each term's list."""
    return index.gaps(index.postings(documents(spark, d))).select("term", "doc_id", "gap")


@query(f"WITH {_corpus()} SELECT term, doc_id FROM p")
def posting_decode(spark, d):
    """Ids restored from gaps."""
    g = index.gaps(index.postings(documents(spark, d))).withColumnRenamed("doc_id", "pos").select("segment_id", "term", "pos", "gap")
    return index.ungaps(g).select("term", "doc_id")


@query(
    _GAPS + ", b AS (SELECT term, count(*) AS df, sum(2 + (gap >= 128)::INT + (gap >= 16384)::INT + (gap >= 2097152)::INT + (gap >= 268435456)::INT) AS body FROM w GROUP BY 1) "
    "SELECT term, df, (body + 1 + (df >= 128)::INT + (df >= 16384)::INT + (df >= 2097152)::INT + (df >= 268435456)::INT)::BIGINT AS n_bytes FROM b"
)
def vbyte_size_per_term(spark, d):
    """Bytes of each term's encoded list."""
    return index.list_bytes(index.postings(documents(spark, d))).select("term", "df", "n_bytes")


@query(f"WITH {_corpus()} SELECT term, count(*) AS n, sum(doc_id)::BIGINT AS id_sum, sum(tf)::BIGINT AS tf_sum FROM p GROUP BY 1")
def vbyte_roundtrip(spark, d):
    """Lists encoded to bytes and read back."""
    p = index.postings(documents(spark, d)).withColumn("salt", F.floor(F.col("doc_id") / 100_000))  # a list is cut into blocks of ids
    lists = p.groupBy("term", "salt").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("l"))
    raw = lists.select("term", codec.encode_postings(F.col("l.doc_id"), F.col("l.tf")).alias("raw"))
    back = raw.select("term", F.explode(codec.decode_postings("raw")).alias("e"))
    return back.groupBy("term").agg(F.count("*").alias("n"), F.sum("e.doc_id").alias("id_sum"), F.sum(F.col("e.tf").cast("long")).alias("tf_sum"))


# retrieval


@query(_bm25("SELECT 0 AS qid, 'segment' AS text", cols="doc_id, score, rank"))
def bm25_single(spark, d):
    """Ten best documents of one term."""
    return retrieve.bm25(documents(spark, d), literal(spark, "segment")).drop("qid")


@query(_bm25("SELECT 0 AS qid, 'The query parser and the posting list, an early warning' AS text", cols="doc_id, score, rank"))
def bm25_multi_term(spark, d):
    """Ten best documents of several terms, frequent ones among them."""
    return retrieve.bm25(documents(spark, d), literal(spark, "The query parser and the posting list, an early warning")).drop("qid")


@query(_bm25("SELECT 0 AS qid, 'index index index merge' AS text", cols="doc_id, score, rank"))
def bm25_repeated_term(spark, d):
    """A term given three times counts three times."""
    return retrieve.bm25(documents(spark, d), literal(spark, "index index index merge")).drop("qid")


@query(_bm25("SELECT 0 AS qid, 'zzznomatch' AS text", cols="doc_id, score, rank"))
def bm25_unknown_term(spark, d):
    """No document."""
    return retrieve.bm25(documents(spark, d), literal(spark, "zzznomatch")).drop("qid")


@query(_bm25("SELECT 0 AS qid, 'tokenizer cache merge' AS text", k=20, k1=0.5, b=0.3, cols="doc_id, score, rank"))
def bm25_custom_k1_b(spark, d):
    """Other parameters."""
    return retrieve.bm25(documents(spark, d), literal(spark, "tokenizer cache merge"), k=20, k1=0.5, b=0.3).drop("qid")


@query(_bm25("SELECT 0 AS qid, 'crawler index shard' AS text", segments=SEGMENTS, cols="doc_id, score, rank"))
def bm25_segment_stats(spark, d):
    """Statistics of each segment for itself."""
    return retrieve.bm25(documents(spark, d, SEGMENTS), literal(spark, "crawler index shard"), stats="segment").drop("qid")


@query(_bm25("SELECT 0 AS qid, 'crawler index shard' AS text", cols="doc_id, score, rank"))
def bm25_global_stats(spark, d):
    """Statistics over all segments."""
    return retrieve.bm25(documents(spark, d, SEGMENTS), literal(spark, "crawler index shard")).drop("qid")


def _items(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), "text")


_BATCH = _bm25("SELECT item_id AS qid, text FROM eval_items")


@query(_BATCH)
def bm25_batch_topk(spark, d):
    """Ten best documents of every evaluation item."""
    return retrieve.bm25(documents(spark, d), _items(spark, d))


@query(_BATCH)
def bm25_pruned(spark, d):
    """The same by upper bounds."""
    return retrieve.bm25_pruned(documents(spark, d), _items(spark, d))


@query(_bm25("SELECT qid, text FROM (SELECT min(query_id) AS qid, q_text AS text FROM query_log WHERE q_text IS NOT NULL GROUP BY q_text)", k=5))
def bm25_query_log(spark, d):
    """Five best documents of every different text of the query log; equal texts are searched once."""
    q = table(spark, d, "query_log").where("q_text IS NOT NULL").groupBy("q_text").agg(F.min("query_id").alias("qid"))
    return retrieve.bm25_many(documents(spark, d), q.select("qid", F.col("q_text").alias("text")), k=5)


def _four_segments(spark, d):
    ix = index.Index(spark, fresh_path(spark, "index"), 8)
    docs = documents(spark, d, SEGMENTS)
    for i in range(SEGMENTS):
        ix.add(docs.where(F.col("segment_id") == i))
    return ix


@query(_bm25("SELECT 0 AS qid, 'result page ranking' AS text", cols="doc_id, score, rank"))
def index_search(spark, d):
    """Search of a written index of four segments, reading only the buckets of the query's terms."""
    ix = _four_segments(spark, d)
    return retrieve.search_index(ix, "result page ranking").select("doc_id", "score", "rank")


@query(f"WITH {_corpus()} SELECT (SELECT count(*) FROM n)::BIGINT AS num_docs, (SELECT count(DISTINCT term) FROM p)::BIGINT AS num_terms, (SELECT count(*) FROM p)::BIGINT AS total_postings, 1 AS merge_gen, 1 AS num_segments")
def index_compaction(spark, d):
    """A written index of four segments merged into one."""
    ix = _four_segments(spark, d)
    compaction.compact(ix, max_per_tier=3, merge_factor=SEGMENTS)
    return ix.table("segments").select("num_docs", "num_terms", "total_postings", "merge_gen", F.lit(ix.num_segments()).alias("num_segments"))


@query(_BATCH)
def index_batch_topk(spark, d):
    """The batch over a written index cut into segments by size, by bounds."""
    ix = index.Index(spark, fresh_path(spark, "index"), 16)
    ix.add(documents(spark, d), threshold=4_000_000)
    return retrieve.search_many(ix, _items(spark, d), pruned=True).select("qid", "doc_id", "score", "rank")


@query(f"WITH {_corpus()}, c AS (SELECT doc_id, dl, floor(coalesce(sum(24 * dl) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000000) AS s FROM n), "
       "x AS (SELECT doc_id, s::INT AS segment_id, (row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1)::BIGINT AS local_id, dl FROM c) SELECT segment_id, doc_id, local_id, dl FROM x")  # fmt: skip
def index_flush(spark, d):
    """A batch written as segments of bounded size, with ids from 0 in each."""
    ix = index.Index(spark, fresh_path(spark, "index"), 8)
    ix.add(documents(spark, d), threshold=1_000_000)
    return ix.table("docs").select("segment_id", "doc_id", "local_id", "dl")


@query(f"WITH {_corpus(SEGMENTS)} SELECT segment_id, term, df, max_tf, round({_IDF} * {_norm('max_tf', 'greatest(1, min_dl)')}, 6) AS max_score FROM t JOIN g USING (segment_id) WHERE term IN ('index', 'query', 'the')")
def index_doc_freq(spark, d):
    """What a written index knows of three terms, from its terms table."""
    return _four_segments(spark, d).doc_freq(["index", "query", "the"]).select("segment_id", "term", "df", "max_tf", F.round("max_score", 6).alias("max_score"))


# near-duplicates

_FP = (
    r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{85}}\x{{1c}}-\x{{1f}}]+'), lambda x: x <> '') AS ws FROM documents), "
    "h AS (SELECT doc_id, ('0x' || substr(md5(u), 1, 16))::UBIGINT AS h FROM (SELECT doc_id, unnest(ws) AS u FROM w)), "
    "v AS (SELECT doc_id, i, sum(((h >> i::UBIGINT) & 1)::INT * 2 - 1) AS s FROM h, range(64) r(i) GROUP BY ALL), "
    "x AS (SELECT doc_id, sum(CASE WHEN s > 0 THEN (1::HUGEINT << i::INT) ELSE 0 END)::HUGEINT AS u FROM v GROUP BY 1), "
    "fp AS (SELECT doc_id, (CASE WHEN coalesce(u, 0) >= 9223372036854775808 THEN u - 18446744073709551616 ELSE coalesce(u, 0) END)::BIGINT AS fp FROM documents LEFT JOIN x USING (doc_id))"
)
_HAM = "bit_count(xor(a.fp, b.fp))"


@query("WITH " + _FP.format(text="text") + " SELECT doc_id, fp FROM fp")
def simhash_fingerprint(spark, d):
    """Fingerprint of each document."""
    return dedup.fingerprints(documents(spark, d))


@query("WITH " + _FP.format(text="text") + " SELECT doc_id, b::INT AS band, ((fp >> (8 * b)::INT) & 255)::INT AS val FROM fp, range(8) r(b)")
def simhash_bands(spark, d):
    """Eight bands of eight bits of each fingerprint."""
    from tamarack.functions.text import bands

    return dedup.fingerprints(documents(spark, d)).select("doc_id", F.posexplode(bands(F.col("fp"), 8, 8)).alias("band", "val"))


_FPD = _FP.format(text="text")


@query("WITH " + _FPD + ", c AS (SELECT fp, min(doc_id) AS first FROM fp GROUP BY 1) SELECT a.first AS a, b.first AS b FROM c a JOIN c b ON a.first < b.first AND " + _HAM + " <= 3")
def near_dup_pairs(spark, d):
    """Pairs of fingerprint classes, named by their first documents, that differ in at most three bits."""
    return dedup.near_pairs(dedup.classes(dedup.fingerprints(documents(spark, d))))


@query("WITH " + _FPD + " SELECT doc_id, min(doc_id) OVER (PARTITION BY fp) AS class_id, count(*) OVER (PARTITION BY fp) AS class_size FROM fp")
def near_dup_membership(spark, d):
    """Class of equal fingerprints of each document."""
    f = cut(dedup.fingerprints(documents(spark, d)))
    return f.join(dedup.classes(f), "fp").select("doc_id", F.col("first").alias("class_id"), F.col("n").alias("class_size"))


_GREEDY = (
    "WITH " + _FPD + ", k AS (SELECT list_reduce(list(list_value(fp) ORDER BY doc_id), lambda a, x: CASE WHEN len(list_filter(a, lambda y: bit_count(xor(y, x[1])) <= 3)) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM fp), "
    "f AS (SELECT doc_id, NOT (list_contains(kept, fp) AND doc_id = min(doc_id) OVER (PARTITION BY fp)) AS is_dup FROM fp, k) "
)


@query(_GREEDY + "SELECT doc_id, is_dup FROM f")
def greedy_dedup(spark, d):
    """Whether each document repeats an earlier kept one."""
    return dedup.greedy_dedup(documents(spark, d))


@query(_GREEDY + "SELECT count(*) AS total_seen, count(*) FILTER (is_dup) AS total_dupes, round(avg(is_dup::INT), 6) AS dupe_rate FROM f")
def dupe_rate(spark, d):
    """Share of duplicates."""
    return dedup.dupe_rate(dedup.greedy_dedup(documents(spark, d)))


@query("SELECT md5(text) AS content_md5, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_md5_changes(spark, d):
    """Texts that occur more than once."""
    g = documents(spark, d).where("text IS NOT NULL").groupBy(F.md5(F.col("text").cast("binary")).alias("content_md5"))
    return g.agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query()
def content_hash_check(spark, d):
    """Stored content hashes held against the texts: right, missing (null or 0), stale; by segment."""
    t = table(spark, d, "wet_documents").select("rec_id", xxh64("text").alias("h"))
    j = table(spark, d, "doc_meta").join(t, "rec_id")
    kind = F.when(F.coalesce("content_hash", F.lit(0)) == 0, "missing").when(F.col("content_hash") == F.col("h"), "right").otherwise("stale")
    return j.groupBy("segment_id", kind.alias("state")).agg(F.count("*").alias("n"))


_STRIPPED = r"regexp_replace(text, '^[\s\x{a0}\x{85}\x{1c}-\x{1f}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{a0}\x{85}\x{1c}-\x{1f}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')"
_TAKEN = (
    f"documents AS (SELECT rec_id AS doc_id, batch_id, t AS text FROM (SELECT rec_id, batch_id, {_STRIPPED} AS t FROM wet_documents WHERE url LIKE 'http%') WHERE length(t) >= 100), "
    + _FP.format(text="text")
    + ", k AS (SELECT list_reduce(list(list_value(fp) ORDER BY {order}), lambda a, x: CASE WHEN len(list_filter(a, lambda y: bit_count(xor(y, x[1])) <= 3)) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM fp JOIN documents USING (doc_id)), "
    "f AS (SELECT doc_id, batch_id, text, list_contains(kept, fp) AND row_number() OVER (PARTITION BY fp ORDER BY {order}) = 1 AS own FROM fp JOIN documents USING (doc_id), k), "
    f"i AS (SELECT doc_id, batch_id, {_TOKENS} AS tokens FROM f WHERE own)"
)


@query("WITH " + _TAKEN.replace("{order}", "doc_id") + " SELECT doc_id AS rec_id, len(tokens)::INT AS n_tokens FROM i WHERE len(tokens) >= 10")
def ingest_filtered(spark, d):
    """Crawl records that an ingest would index."""
    return dedup.ingest(table(spark, d, "wet_documents").select("rec_id", "url", "text")).select("rec_id", "n_tokens")


# vectors


def _asked(v: DataFrame) -> DataFrame:
    return v.where(F.col("vec_id") % 20 == 0)


_KNN = (
    "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS qid, e AS qe FROM v WHERE vec_id % 20 = 0), "
    "s AS (SELECT qid, vec_id, round(1 - list_cosine_similarity(qe, e), 6) + 0.0 AS dist FROM q, v), "
    "r AS (SELECT qid, vec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id)::INT AS rank FROM s) "
)


@query(_KNN + "SELECT qid, vec_id, dist, rank FROM r WHERE rank <= 10")
def knn_exact(spark, d):
    """Ten nearest vectors of every twentieth one."""
    v = table(spark, d, "embeddings")
    return vectors.knn(v, _asked(v), 10)


@query(_KNN + "SELECT qid, vec_id AS doc_id, round(1 - dist, 6) AS score, rank FROM r WHERE rank <= 20")
def dense_score(spark, d):
    """Neighbours as hits."""
    v = table(spark, d, "embeddings")
    return fusion.dense_scores(vectors.knn(v, _asked(v), 20))


@query(
    "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT label, min(vec_id) AS first FROM v GROUP BY 1) "
    "SELECT v.vec_id, c.first, round(1 - list_cosine_similarity(v.e, w.e), 6) + 0.0 AS dist FROM v JOIN c USING (label) JOIN v w ON w.vec_id = c.first"
)
def cosine_to_first(spark, d):
    """Distance of each vector to the first of its label."""
    v = table(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min("vec_id").alias("first"))
    f = first.join(v.select(F.col("vec_id").alias("first"), F.col("embedding").alias("w")), "first")
    return v.join(f, "label").select("vec_id", "first", (F.round(vectors.cosine_distance(F.col("embedding"), F.col("w")), 6) + 0.0).alias("dist"))


def _recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    return vectors.recall(found, truth).agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 4).alias("recall"))


@query(_KNN + "SELECT qid, vec_id, dist, rank FROM r WHERE rank <= 10")
def hnsw_search(spark, d):
    """Ten nearest vectors by kept graphs, built, written, loaded and searched with a wide beam."""
    v = table(spark, d, "embeddings")
    g = vectors.GraphIndex(spark, fresh_path(spark, "graphs"))
    g.build(v)
    return vectors.exact_again(g.search(_asked(v), 20, (400,)), v, _asked(v), 10)


@query()
def hnsw_recall(spark, d):
    """Recall at ten of the graph search with a beam of 100 against exact neighbours."""
    v = table(spark, d, "embeddings")
    return _recall(vectors.hnsw_knn(v, _asked(v), 10, (100,)), vectors.knn(v, _asked(v), 10))


@query()
def hnsw_ef_sweep(spark, d):
    """Recall by beam width."""
    v = table(spark, d, "embeddings")
    truth = cut(vectors.knn(v, _asked(v), 10))
    got = cut(vectors.hnsw_knn(v, _asked(v), 10, (10, 20, 50, 100, 200, 400)))
    hit = got.join(truth.select("qid", "vec_id"), ["qid", "vec_id"], "left_semi").groupBy("ef").agg(F.count("*").alias("h"))
    n = truth.count()
    return hit.select("ef", F.round(F.col("h") / F.greatest(F.lit(n), F.lit(1)), 4).alias("recall"))


@query()
def lsh_ann(spark, d):
    """Recall at ten of the hyperplane search against exact neighbours."""
    v = table(spark, d, "embeddings")
    return _recall(vectors.lsh_knn(v, _asked(v), 10), vectors.knn(v, _asked(v), 10))


_HALF = (
    "CASE WHEN abs(x) < 6.103515625e-5 THEN round_even(x::DOUBLE * 16777216, 0) / 16777216 "
    "ELSE round_even(x::DOUBLE * pow(2, 10 - floor(log2(abs(x)::DOUBLE))), 0) / pow(2, 10 - floor(log2(abs(x)::DOUBLE))) END"
)


@query(
    f"WITH h AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: {_HALF}) AS h FROM embeddings) SELECT vec_id, len(h)::INT AS n, round(list_sum(h), 9) + 0.0 AS h_sum, "
    "round(list_max(list_transform(list_zip(embedding, h), lambda z: abs(z[1]::DOUBLE - z[2]))), 9) + 0.0 AS most_off FROM h"
)
def f16_roundtrip(spark, d):
    """What is left of each vector in 16-bit storage: its sum, and how far a component moves at most."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", vectors.half_precision("embedding").alias("h"))
    off = F.aggregate(F.zip_with("embedding", "h", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: F.greatest(s, x))
    h_sum = F.aggregate("h", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return v.select("vec_id", F.size("embedding").alias("n"), (F.round(h_sum, 9) + 0.0).alias("h_sum"), (F.round(off, 9) + 0.0).alias("most_off"))


# fusion

_DENSE_Q = _KNN + "SELECT qid, vec_id AS doc_id, rank FROM r WHERE rank <= 20"
_ITEMQ = "SELECT (item_id % 50) * 20 AS qid, string_agg(text, ' ' ORDER BY item_id) AS text FROM eval_items GROUP BY 1"


def _paired(spark, d):
    """Text queries that share their ids with vector queries: items of equal remainder, joined, in order."""
    it = table(spark, d, "eval_items").groupBy(((F.col("item_id") % 50) * 20).alias("qid")).agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("l"))
    return it.select("qid", F.concat_ws(" ", F.col("l.text")).alias("text"))


_LISTS = f"b AS (SELECT * FROM ({_bm25(_ITEMQ, k=20)})), e AS ({_DENSE_Q}), u AS (SELECT qid, doc_id, 0 AS i, rank FROM b UNION ALL SELECT qid, doc_id, 1, rank FROM e), "
_RRF = "m AS (SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, min([i, rank]) AS seen FROM u GROUP BY ALL), f AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, doc_id)::INT AS rank FROM m) "


def _fused(spark, d):
    v = table(spark, d, "embeddings")
    return retrieve.bm25(documents(spark, d), _paired(spark, d), k=20), fusion.dense_scores(vectors.knn(v, _asked(v), 20))


@query(f"WITH {_LISTS}{_RRF}SELECT qid, doc_id, score, rank FROM f WHERE rank <= 10")
def rrf_fusion(spark, d):
    """Text and vector lists fused by reciprocal ranks."""
    return fusion.rrf(list(_fused(spark, d)), 10)


_FRESH = f"exp(-({NOW} - coalesce(crawl_ts, {NOW})) / 3600.0 / 720)"


@query(f"SELECT doc_id, round({_FRESH}, 4) AS freshness_factor FROM documents")
def freshness(spark, d):
    """Freshness of each document."""
    return documents(spark, d).select("doc_id", F.round(fusion.freshness(F.col("crawl_ts"), NOW), 4).alias("freshness_factor"))


@query(
    f"WITH {_LISTS}{_RRF}SELECT qid, rank, doc_id, url, crawl_ts, round(score * (0.85 + 0.15 * {_FRESH}), 6) AS score, round({_FRESH}, 4) AS freshness_factor FROM f JOIN documents USING (doc_id) WHERE rank <= 10"
)
def hybrid_search(spark, d):
    """Fused hits with their documents, weighted by freshness."""
    return fusion.reweighted(fusion.fused("hybrid", 10, *_fused(spark, d)), documents(spark, d), NOW)


# documents and segments


@query("SELECT segment_id, num_docs::BIGINT AS num_docs, (coalesce(sum(num_docs) OVER (ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS base FROM segments")
def segment_bases(spark, d):
    """First global id of each segment."""
    return index.segment_bases(table(spark, d, "segments").withColumn("num_docs", F.col("num_docs").cast("long")))


@query(
    "WITH b AS (SELECT segment_id, num_docs, coalesce(sum(num_docs) OVER (ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM segments) "
    "SELECT doc_id AS global_id, segment_id, (doc_id - base)::BIGINT AS local_id FROM documents JOIN b ON doc_id >= base AND doc_id < base + num_docs"
)
def doc_meta_lookup(spark, d):
    """Segment and local id of global ids."""
    b = index.segment_bases(table(spark, d, "segments").withColumn("num_docs", F.col("num_docs").cast("long")))
    return index.locate(b, documents(spark, d).select(F.col("doc_id").alias("global_id")))


@query("SELECT segment_id, rec_id, coalesce(sum(octet_length(encode(url))) OVER (PARTITION BY segment_id ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS url_offset FROM (SELECT DISTINCT segment_id, rec_id, url FROM doc_meta)")
def url_offsets(spark, d):
    """Running byte offset of the addresses of each segment."""
    m = table(spark, d, "doc_meta").select("segment_id", "rec_id", "url").distinct()
    return index.running_offsets(m, "segment_id", ["rec_id"], F.coalesce(F.octet_length("url"), F.lit(0)), "url_offset").select("segment_id", "rec_id", "url_offset")


@query(f"WITH n AS (SELECT doc_id, len({_TOKENS}) AS dl FROM documents), c AS (SELECT doc_id, coalesce(sum(24 * dl) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM n) SELECT doc_id, floor(a / 1000000)::INT AS segment_id FROM c")
def segment_cut(spark, d):
    """Segment of each document by running size."""
    return index.segment_cut(index.analyzed(documents(spark, d)).select("doc_id", "dl"), 1_000_000).select("doc_id", "segment_id")


@query("SELECT segment_id, size_bytes FROM (SELECT *, row_number() OVER (ORDER BY size_bytes, segment_id) AS r, count(*) OVER () AS n FROM segments) WHERE n > 10 AND r <= 10")
def merge_candidates(spark, d):
    """Segments that are due to be merged."""
    return compaction.merge_candidates(table(spark, d, "segments")).select("segment_id", "size_bytes")


@query(
    f"WITH {_corpus(SEGMENTS)}, b AS (SELECT segment_id, num_docs, coalesce(sum(num_docs) OVER (ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM g) "
    "SELECT count(*) AS num_docs, sum(n.doc_id + base)::BIGINT AS id_sum, sum(dl)::BIGINT AS dl_sum FROM n JOIN b USING (segment_id)"
)
def merged_segment_stats(spark, d):
    """Four segments put together, ids moved on."""
    m = compaction.merged_docs(index.analyzed(documents(spark, d, SEGMENTS)).select("segment_id", "doc_id", "dl"), list(range(SEGMENTS)))
    return m.agg(F.count("*").alias("num_docs"), F.sum("doc_id").cast("long").alias("id_sum"), F.sum("dl").cast("long").alias("dl_sum"))


@query("SELECT count(*) AS num_segments, sum(total_postings)::BIGINT AS total_postings, round(sum(total_postings * (merge_gen + 1)) / greatest(sum(total_postings), 1), 2) AS write_amplification FROM segments")
def write_amplification(spark, d):
    """Rewrites of a posting."""
    return evaluate.write_amplification(table(spark, d, "segments"))


# evaluation


@query(
    f"WITH run AS ({_BATCH}), j AS (SELECT i.item_id AS qid, doc_id, 1 AS rel FROM eval_items i JOIN documents d ON contains(d.text, i.text)), "
    "i AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS r FROM j), c(k) AS (VALUES (1), (3), (5), (10)), "
    "pi AS (SELECT qid, k, count(*) AS n, sum(CASE WHEN r <= k THEN rel / log2(r + 1.0) ELSE 0 END) AS ideal FROM i, c GROUP BY ALL), "
    "h AS (SELECT qid, rank AS r, rel, row_number() OVER (PARTITION BY qid ORDER BY rank) AS seen FROM run JOIN j USING (qid, doc_id)), "
    "ph AS (SELECT qid, k, sum(CASE WHEN r <= k THEN rel / log2(r + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN r <= k THEN seen / r ELSE 0 END) AS ap, count(*) FILTER (r <= k) AS h FROM h, c GROUP BY ALL) "
    "SELECT k::INT AS k, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg, round(avg(coalesce(ap, 0) / n), 6) AS map, round(avg(coalesce(h, 0) / n), 6) AS recall, round(avg(coalesce(h, 0) / k), 6) AS precision "
    "FROM pi LEFT JOIN ph USING (qid, k) GROUP BY k"
)
def eval_ndcg_recall_map_p(spark, d):
    """Quality of the batch search; relevant are documents that hold the item word for word."""
    return evaluate.ir_metrics(bm25_batch_topk(spark, d), evaluate.holding(documents(spark, d), _items(spark, d)))


_LAT = "WITH l AS (SELECT search_mode, list(latency_s ORDER BY latency_s) AS x FROM query_log WHERE latency_s IS NOT NULL {g}) "
_PICK = "len(x) AS n, x[1] AS min, x[floor(len(x) * 0.5)::INT + 1] AS p50, x[floor(len(x) * 0.95)::INT + 1] AS p95, x[floor(len(x) * 0.99)::INT + 1] AS p99, x[-1] AS max"


@query(_LAT.replace("SELECT search_mode, list", "SELECT list").format(g="") + f"SELECT {_PICK} FROM l")
def latency_percentiles(spark, d):
    """Percentiles of the query log's latencies by place."""
    return evaluate.index_percentiles(table(spark, d, "query_log"), "latency_s")


@query(_LAT.format(g="AND search_mode IS NOT NULL GROUP BY 1") + f"SELECT search_mode, {_PICK} FROM l")
def latency_by_mode(spark, d):
    """The same for each search mode."""
    return evaluate.index_percentiles(table(spark, d, "query_log").where("search_mode IS NOT NULL"), "latency_s", ["search_mode"])


@query(
    "SELECT le::DOUBLE AS le, count(latency_s) FILTER (le IS NULL OR latency_s <= le) AS n FROM query_log, "
    "(VALUES (0.001), (0.005), (0.01), (0.025), (0.05), (0.1), (0.25), (0.5), (1.0), (NULL)) e(le) GROUP BY le"
)
def latency_histogram(spark, d):
    """Latencies at or below each edge."""
    return evaluate.histogram(table(spark, d, "query_log"), "latency_s")


# log

#: Each row of the log with ``good``: CRC-32 worked out byte by byte over a table of 256 numbers.
_WAL = (
    "b AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))), "
    "h AS (SELECT *, lpad(hex(op), 2, '0') || lpad(hex(rec_id), 16, '0') AS head, coalesce(hex(payload), '') AS tail FROM wal), "
    "e AS (SELECT seq, op, rec_id, payload, crc, substr(head, 1, 2) || list_aggregate(list_transform(range(8), lambda i: substr(head, (17 - 2 * i)::INT, 2)), 'string_agg', '') || tail AS x FROM h), "
    "y AS (SELECT *, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT) AS bytes FROM e), "
    "w AS (SELECT seq, op, rec_id, payload, crc, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, v: xor(a >> 8, tab[(xor(a, v) & 255) + 1])), 4294967295) AS own FROM y, b), "
    "g AS (SELECT seq, op, rec_id, payload, own, coalesce(crc = own, FALSE) AS good FROM w), "
    "s AS (SELECT DISTINCT seq, op, rec_id, payload, own FROM g WHERE good) "
)
_GOOD = "WITH " + _WAL + "SELECT seq, op, rec_id, payload FROM s"


@query(
    "WITH " + _WAL + ", z AS (SELECT min(seq) AS bad FROM (SELECT seq FROM g GROUP BY 1 HAVING NOT bool_or(good))), o AS (SELECT s.* FROM s, z WHERE bad IS NULL OR seq < bad) "
    "SELECT seq, op, rec_id, payload FROM o WHERE seq > coalesce((SELECT max(seq) FROM o WHERE op = 255), -1)"
)
def wal_replay_after_checkpoint(spark, d):
    """Log entries after the last checkpoint, up to the first damaged one."""
    return journal.replay(table(spark, d, "wal"))


@query(_GOOD)
def wal_salvage(spark, d):
    """All undamaged log entries."""
    return journal.salvage(table(spark, d, "wal"))


@query("WITH " + _WAL + "SELECT op, good, count(*) AS n FROM g GROUP BY ALL")
def wal_damaged(spark, d):
    """Log rows by operation and state."""
    return journal.checked(table(spark, d, "wal")).groupBy("op", "good").agg(F.count("*").alias("n"))


@query("WITH " + _WAL + "SELECT seq, op, own AS crc, (sum(17 + coalesce(octet_length(payload), 0)) OVER (ORDER BY seq))::BIGINT AS \"offset\" FROM s")
def wal_append(spark, d):
    """Checksums and byte offsets of the undamaged entries written anew."""
    return journal.appended(journal.salvage(table(spark, d, "wal"))).select("seq", "op", "crc", "offset")


@query("WITH " + _WAL + "SELECT rec_id FROM wet_documents WHERE rec_id NOT IN (SELECT rec_id FROM s WHERE op IN (1, 2) GROUP BY 1 HAVING arg_max(op, seq) = 2)")
def wal_apply_deletes(spark, d):
    """Records left after the log's deletions."""
    return journal.applied(table(spark, d, "wet_documents").select("rec_id"), journal.salvage(table(spark, d, "wal")), "rec_id")


# sources and streams


@query(
    r"SELECT rec_id, url, length(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'))::INT AS n_chars, (CASE WHEN crawl_ts BETWEEN 0 AND 4102444799 THEN crawl_ts ELSE 1740787200 END)::BIGINT AS crawl_ts FROM wet_documents "
    r"WHERE text IS NOT NULL AND url LIKE 'http%' AND length(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) >= 100"
)
def wet_parse(spark, d):
    """Crawl records written as gzipped record files and read back."""
    from tamarack.sources import wet

    w = table(spark, d, "wet_documents").where("text IS NOT NULL AND url IS NOT NULL")
    sane = F.when(F.col("crawl_ts").between(0, 4_102_444_799), F.date_format(F.timestamp_seconds("crawl_ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("not a time")
    ids = w.select("rec_id", "url", "text", sane.alias("ts"), F.col("rec_id").alias("rec_no"), F.pmod(F.xxhash64("wet_file"), F.lit(16)).cast("int").alias("file_no"))
    folder = fresh_path(spark, "wet")
    wet.write_wet(ids, folder)
    got = wet.to_documents(wet.read_wet(spark, folder), NOW)
    no = F.row_number().over(W.partitionBy("file_no").orderBy("rec_no")) - 1
    key = ids.select("file_no", "rec_id", no.alias("rec_no"))
    file_no = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    return got.withColumn("file_no", file_no).join(key, ["file_no", "rec_no"]).select("rec_id", "url", F.length("text").alias("n_chars"), "crawl_ts")


@query(
    "WITH " + _TAKEN.replace("{order}", "batch_id, doc_id") + ", u AS (SELECT * FROM i WHERE len(tokens) >= 10), t AS (SELECT DISTINCT batch_id, doc_id, unnest(tokens) AS term FROM u), "
    "n AS (SELECT batch_id, count(*) AS num_docs FROM u GROUP BY 1), p AS (SELECT batch_id, count(DISTINCT term) AS num_terms, count(*) AS total_postings FROM t GROUP BY 1) "
    "SELECT (row_number() OVER (ORDER BY batch_id) - 1)::INT AS segment_id, num_docs, num_terms, total_postings FROM n JOIN p USING (batch_id)"
)
def stream_ingest(spark, d):
    """Documents of each segment after a streaming ingest of the crawl's batches."""
    from tamarack.streaming.ingest import StreamIngest

    src, ix, ck = fresh_path(spark, "stream-in"), fresh_path(spark, "stream-index"), fresh_path(spark, "stream-log")
    w = table(spark, d, "wet_documents").select("rec_id", "url", "text", "crawl_ts", "lang", "batch_id").where("batch_id IS NOT NULL")
    w = written(w, "batches", ["batch_id"])  # the table is read once; a batch below reads its own files
    for b in [r[0] for r in w.select("batch_id").distinct().orderBy("batch_id").collect()]:  # a few batches
        # One file a batch, of small row groups, so that the stream reads it in several tasks.
        w.where(F.col("batch_id") == b).drop("batch_id").coalesce(1).write.mode("append").option("parquet.block.size", 4 << 20).parquet(src)
    s = StreamIngest(spark, ix, buckets=8)
    s.run(src, ck)
    return s.index.table("segments").select("segment_id", "num_docs", "num_terms", "total_postings")


@query(r"SELECT rec_id, (CASE WHEN crawl_ts BETWEEN 0 AND 4102444799 THEN crawl_ts ELSE 1740787200 END)::BIGINT AS crawl_ts FROM wet_documents")
def timestamps(spark, d):
    """Seconds from ISO times, with a stated time where they cannot be read."""
    w = table(spark, d, "wet_documents")
    iso = F.when(F.col("crawl_ts").between(0, 4_102_444_799), F.date_format(F.timestamp_seconds("crawl_ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("-")
    return w.select("rec_id", epoch_seconds(iso, NOW).alias("crawl_ts"))


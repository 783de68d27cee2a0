"""Unit tests of the engine's operators: shapes and assertions of the survey's test list, and edge cases."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.functions import codec
from tamarack.functions.text import simhash, tokens, xxh64
from tamarack.operators import compaction, dedup, evaluate, fusion, index, journal, retrieve, vectors
from tamarack.sources import wet


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def ask(spark, text):
    return spark.createDataFrame([(0, text)], "qid int, text string")


def toks(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t")).alias("x")).first()["x"]


def test_tokens(spark):
    assert toks(spark, "Hello World! This is a test.") == ["hello", "world", "this", "is", "test"]
    assert {"lang", "python3", "11"} <= set(toks(spark, "rust-lang, python3.11: great!"))
    assert toks(spark, "a" * 60) == [] and toks(spark, "  ") == [] and toks(spark, None) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2**31), st.integers(0, 255)), max_size=30))
def test_codec_roundtrip(pairs):
    ids = sorted({a for a, _ in pairs})
    tfs = [t for _, t in pairs][: len(ids)]
    assert codec.decode_list(codec.encode_list(ids, tfs)) == list(zip(ids, tfs))


def test_codec_sizes():
    assert len(codec.encode_list(list(range(128)), [1] * 128)) < 300
    assert codec.decode_numbers(codec.encode_numbers([0, 127, 128, 2**32 - 1]))[0] == [0, 127, 128, 2**32 - 1]
    with pytest.raises(ValueError):
        codec.decode_numbers(b"\x80")
    with pytest.raises(ValueError):
        codec.encode_list([2, 1], [1, 1])


def test_postings_saturate(spark):
    p = index.postings(docs(spark, ["word " * 300, None, ""])).collect()
    assert [(r["term"], r["tf"], r["dl"]) for r in p] == [("word", 255, 300)]


def test_bm25_order_and_ties(spark):
    d = docs(spark, ["engine search alpha", "engine only beta", "other words here", "more words there", None])
    got = retrieve.bm25(d, ask(spark, "search engine")).collect()
    assert [r["doc_id"] for r in got] == [0, 1] and got[0]["score"] > got[1]["score"] > 0
    assert retrieve.bm25(d, ask(spark, "zzz")).count() == retrieve.bm25(d, ask(spark, None)).count() == 0
    every = docs(spark, ["common"] * 10)
    assert [(r["doc_id"], r["score"]) for r in retrieve.bm25(every, ask(spark, "common"), k=3).collect()] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    with pytest.raises(ValueError):
        retrieve.bm25(d, ask(spark, "x"), k=0)
    assert retrieve.bm25(d.limit(0), ask(spark, "engine")).count() == 0


def test_pruned_equals_plain(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    d = docs(spark, [" ".join(rng.choices(words, k=rng.randint(1, 40), weights=range(1, 31))) for _ in range(150)])
    q = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(8)], "qid int, text string")
    plain = {tuple(r) for r in retrieve.bm25(d, q, k=5).collect()}
    assert plain == {tuple(r) for r in retrieve.bm25_pruned(d, q, k=5).collect()}


def test_index_search_compaction_deletes(spark, tmp_path):
    ix = index.Index(spark, f"{tmp_path}/ix", 4)
    assert ix.num_docs() == 0 and ix.add(docs(spark, []).limit(0)) == []
    assert retrieve.search_index(ix, "rust").count() == 0
    all_ = ["rust fast code", "rust and python", "python search", "gamma delta"]
    for i in range(4):
        ix.add(docs(spark, all_[i : i + 1], i))
    assert (ix.num_docs(), ix.num_segments()) == (4, 4)
    want = [tuple(r) for r in retrieve.bm25(docs(spark, all_), ask(spark, "python gamma")).drop("qid").collect()]
    assert [tuple(r)[1:] for r in retrieve.search_index(ix, "python gamma").collect()] == want
    gone = spark.createDataFrame([(3,)], "doc_id bigint")
    sid = compaction.compact(ix, 3, 4, gone)
    assert ix.segment_ids() == [sid] and ix.num_docs() == 3
    s = ix.table("segments").first()
    assert s["merge_gen"] == 1 and s["num_terms"] == 6 and s["total_postings"] == 8
    assert compaction.compact(ix) is None and ix.purge() > 0 and ix.num_docs() == 3
    assert s["size_bytes"] > 0 and [r["df"] for r in ix.doc_freq(["rust"]).collect()] == [2]
    assert ix.add(docs(spark, ["more"], 9)) == [sid + 1]  # ids are never given twice
    assert index.Index(spark, f"{tmp_path}/none").segment_ids() == []


def test_two_writers(spark, tmp_path):
    """Of two writers that start from the same state one fails, and its segment does not exist."""
    a, b = (index.Index(spark, f"{tmp_path}/ix", 2) for _ in range(2))
    version, state = b.state()
    a.add(docs(spark, ["one text"]))
    with pytest.raises(FileExistsError):
        b.put(version, state, index.analyzed(docs(spark, ["xx yy"])).drop("tokens", "text").withColumn("local_id", F.lit(0)), index.postings(docs(spark, ["xx yy"])), 0)
    assert b.num_docs() == 1


def test_segments_by_size(spark, tmp_path):
    ix = index.Index(spark, f"{tmp_path}/ix", 2)
    texts = ["word " * 10] * 7 + [None]
    assert ix.add(docs(spark, texts), threshold=480) == [0, 1, 2, 3]
    got = [(r["segment_id"], r["local_id"]) for r in ix.table("docs").orderBy("doc_id").collect()]
    assert got == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1)]
    assert retrieve.search_index(ix, "word").count() == 7


def test_search_many_equals_plain(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(25)]
    d = docs(spark, [" ".join(rng.choices(words, k=rng.randint(1, 30), weights=range(1, 26))) for _ in range(120)])
    q = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3))) for i in range(6)] + [(6, "w24 w23"), (7, "none")], "qid int, text string")
    ix = index.Index(spark, f"{tmp_path}/ix", 2)
    ix.add(d, threshold=10_000)
    plain = {tuple(r) for r in retrieve.bm25(d, q, k=7).collect()}
    assert {tuple(r) for r in retrieve.search_many(ix, q, k=7).drop("segment_id").collect()} == plain
    assert {tuple(r) for r in retrieve.search_many(ix, q, k=7, pruned=True).drop("segment_id").collect()} == plain
    assert {tuple(r) for r in retrieve.bm25_pruned(d, q, k=7).collect()} == plain


def test_holding(spark):
    d = docs(spark, ["say a b c d e f g h i j now", "xa b c d e f g h i jz", "a b c d  e f g h i j", "two words", None, "tw o"])
    it = spark.createDataFrame([(0, "a b c d e f g h i j"), (1, "two words"), (2, ""), (3, None), (4, "b c d")], "qid int, text string")
    assert {tuple(r)[:2] for r in evaluate.holding(d, it).collect()} == {(0, 0), (0, 1), (1, 3), (4, 0), (4, 1), (4, 2)}
    assert evaluate.holding(d, it.limit(0)).count() == 0


def test_segment_bases_and_lookup(spark):
    b = index.segment_bases(spark.createDataFrame([(2, 5), (0, 3), (1, 0)], "segment_id int, num_docs bigint"))
    assert {(r["segment_id"], r["base"]) for r in b.collect()} == {(0, 0), (1, 3), (2, 3)}
    ids = spark.createDataFrame([(0,), (2,), (3,), (7,), (8,), (-1,)], "global_id bigint")
    got = {tuple(r) for r in index.locate(b, ids).collect()}
    assert got == {(0, 0, 0), (2, 0, 2), (3, 2, 0), (7, 2, 4)}


def test_gaps_roundtrip_and_offsets(spark):
    p = spark.createDataFrame([(0, "t", i) for i in (5, 1, 100, 10_000)], "segment_id int, term string, doc_id bigint")
    g = index.gaps(p)
    assert sorted(r["gap"] for r in g.collect()) == [1, 4, 95, 9900]
    back = index.ungaps(g.withColumnRenamed("doc_id", "pos"))
    assert all(r["pos"] == r["doc_id"] for r in back.collect())
    o = index.running_offsets(p, "term", ["doc_id"], F.lit(3), "at").collect()
    assert sorted((r["doc_id"], r["at"]) for r in o) == [(1, 0), (5, 3), (100, 6), (10_000, 9)]


def test_simhash(spark):
    import hashlib

    def plain(t):
        w = t.lower().split()[:200]
        hs = [int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "big") for x in w]
        v = sum(1 << i for i in range(64) if sum(1 if h >> i & 1 else -1 for h in hs) > 0)
        return v - (1 << 64) if v >= 1 << 63 else v

    texts = ["the quick brown fox", "entirely other words stand here", "", "ß É same same same"]
    got = docs(spark, [*texts, None]).select("doc_id", simhash("text").alias("fp")).orderBy("doc_id").collect()
    assert [r["fp"] for r in got] == [*map(plain, texts), 0]


def test_greedy_chain_and_rate(spark):
    fps = spark.createDataFrame([(0, 0b0), (1, 0b111), (2, 0b111111), (3, 0b0), (4, -1)], "doc_id bigint, fp bigint")
    cls = dedup.classes(fps)
    assert {r["first"] for r in dedup.greedy_kept(cls, dedup.near_pairs(cls)).collect()} == {0, 2, 4}
    same = docs(spark, ["one text of some words"] * 3)
    r = dedup.dupe_rate(dedup.greedy_dedup(same)).first()
    assert (r["total_seen"], r["total_dupes"], r["dupe_rate"]) == (3, 2, 0.666667)
    assert dedup.dupe_rate(dedup.greedy_dedup(same.limit(0))).first()["dupe_rate"] == 0.0


def test_near_pairs_lossless(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(25)]
    vals = [b ^ sum(1 << i for i in rng.sample(range(63), rng.randint(0, 5))) for b in base for _ in range(4)]
    fps = spark.createDataFrame(list(enumerate(vals)), "doc_id bigint, fp bigint")
    cls = dedup.classes(fps)
    first = {}
    for i, v in enumerate(vals):
        first.setdefault(v, i)
    want = {(min(a, b), max(a, b)) for x, a in first.items() for y, b in first.items() if a < b and (x ^ y).bit_count() <= 3}
    assert {tuple(r) for r in dedup.near_pairs(cls).collect()} == want


def test_ingest(spark):
    long_ = "word%d " * 30
    rows = [(0, "http://a", long_), (1, "ftp://a", long_ + "x"), (2, "http://b", "short"), (3, "http://c", long_), (4, "http://d", None), (5, "http://e", "x " * 80)]
    d = spark.createDataFrame(rows, "rec_id bigint, url string, text string")
    assert [r["rec_id"] for r in dedup.ingest(d).collect()] == [0]


def test_xxh64(spark):
    r = docs(spark, ["", "abc", None]).select(xxh64("text").alias("h")).collect()
    assert [x["h"] for x in r] == [0xEF46DB3751D8E999 - (1 << 64), 0x44BC2CF5AD770999, None]


def test_knn_and_graph(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(200, 8))
    m[7] = 0
    m[9] = m[8]
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(500, None)], "vec_id bigint, embedding array<float>")
    q = v.where("vec_id < 10")
    got = vectors.knn(v, q, 5)
    rows = {(r["qid"], r["rank"]): (r["vec_id"], r["dist"]) for r in got.collect()}
    m32 = m.astype(np.float32).astype(float)
    n = np.linalg.norm(m32, axis=1)
    for i in range(10):
        d = np.array([1.0 if n[i] * n[j] == 0 else round(1 - m32[i] @ m32[j] / n[i] / n[j], 6) for j in range(200)])
        want = sorted(range(200), key=lambda j: (d[j], j))[:5]
        assert [rows[i, k + 1][0] for k in range(5)] == want
    r = vectors.recall(vectors.hnsw_knn(v, q, 5, (60,), shards=2), got)
    assert r.agg(F.avg("recall")).first()[0] > 0.9
    assert vectors.knn(v.limit(0), q, 3).count() == 0 and vectors.knn(v, q.limit(0), 3).count() == 0
    assert vectors.Graph(4).search([1, 0, 0, 0], 3) == []
    g = vectors.Graph(8, half=False).build(range(200), m)
    h = vectors.Graph.restored(g.dump())
    same = lambda x, y: np.allclose([d for d, _ in x], [d for d, _ in y], atol=1e-5)
    assert all(same(g.search(m[i], 5), h.search(m[i], 5)) for i in range(0, 200, 9)) and vectors.Graph.restored(vectors.Graph(4).build([], np.zeros((0, 4))).dump()).search([1, 0, 0, 0], 3) == []


def test_graphs_are_kept(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i % 7), float(i), 1.0]) for i in range(60)] + [(99, None)], "vec_id bigint, embedding array<float>")
    g = vectors.GraphIndex(spark, f"{tmp_path}/g")
    assert not g.exists() and g.search(v.limit(2), 3).count() == 0
    assert g.build(v, shards=3) == 60
    again = vectors.GraphIndex(spark, f"{tmp_path}/g")
    assert again.size() == 60 and again.search(v.where("vec_id < 5"), 4, (50,)).count() == 20


def test_fusion_and_freshness(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid int, doc_id bigint, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "qid int, doc_id bigint, rank int")
    got = [(r["doc_id"], r["score"]) for r in fusion.rrf([a, b]).orderBy("rank").collect()]
    assert got == [(2, round(1 / 61 + 1 / 62, 6)), (1, round(1 / 61, 6)), (3, round(1 / 62, 6))]
    d = spark.createDataFrame([(1, "u", 0), (2, "v", None), (9, "w", 5)], "doc_id bigint, url string, crawl_ts bigint")
    h = fusion.reweighted(fusion.rrf([a]), d, 30 * 86400).collect()
    f = {r["doc_id"]: r["freshness_factor"] for r in h}
    assert f == {1: round(math.exp(-1), 4), 2: 1.0}
    with pytest.raises(ValueError):
        fusion.fused("x", 3, a, b)


def test_metrics(spark):
    run = spark.createDataFrame([(1, 10, 3.0), (1, 11, 2.0), (2, 20, 1.0)], "qid int, doc_id bigint, score double")
    rel = spark.createDataFrame([(1, 11, 1), (2, 20, 1), (3, 30, 1)], "qid int, doc_id bigint, rel int")
    m = {r["k"]: r for r in evaluate.ir_metrics(run, rel).collect()}
    assert m[1]["recall"] == round(1 / 3, 6) and m[3]["map"] == 0.5 and m[3]["ndcg"] == round((1 / math.log2(3) + 1) / 3, 6)
    assert evaluate.ir_metrics(run, rel.limit(0)).count() == 0
    v = spark.createDataFrame([(float(x),) for x in range(10)] + [(None,)], "x double")
    p = evaluate.index_percentiles(v, "x").first()
    assert (p["n"], p["p50"], p["p95"], p["p99"]) == (10, 5.0, 9.0, 9.0)
    assert [r["n"] for r in evaluate.histogram(v, "x", (1.0, 5.0)).collect()] == [2, 6, 10]
    seg = spark.createDataFrame([(10, 1), (30, 0)], "total_postings bigint, merge_gen int")
    assert evaluate.write_amplification(seg).first()["write_amplification"] == 1.25


def test_merge_policy(spark):
    seg = lambda n: spark.createDataFrame([(i, 100 - i) for i in range(n)], "segment_id int, size_bytes bigint")
    assert compaction.merge_candidates(seg(12)).count() == 10 and compaction.merge_candidates(seg(5)).count() == 0


def test_journal(spark):
    import zlib

    crc = lambda op, i, p: zlib.crc32(bytes([op]) + i.to_bytes(8, "little") + p)
    rows = [(1, 1, 42, b"hello"), (2, 255, 0, b"\x63"), (3, 1, 43, b"world"), (4, 2, 42, b""), (5, 1, 44, b"z")]
    good = [(s, o, i, bytearray(p), crc(o, i, p)) for s, o, i, p in rows]
    schema = "seq bigint, op int, rec_id bigint, payload binary, crc bigint"
    w = spark.createDataFrame([*good[::-1], good[0]], schema)
    assert sorted(r["seq"] for r in journal.replay(w).collect()) == [3, 4, 5]
    bad = [(*g[:4], g[4] + 1) if g[0] == 4 else g for g in good]
    assert [r["seq"] for r in journal.replay(spark.createDataFrame(bad, schema)).collect()] == [3]
    assert journal.replay(w.limit(0)).count() == 0
    a = journal.appended(spark.createDataFrame([r[:4] for r in good], "seq bigint, op int, rec_id bigint, payload binary")).orderBy("seq").collect()
    assert [r["crc"] for r in a] == [g[4] for g in good] and a[0]["offset"] == 22
    left = journal.applied(spark.createDataFrame([(42,), (43,)], "doc_id bigint"), w)
    assert [r["doc_id"] for r in left.collect()] == [43]
    assert journal.replay(journal.checkpoint_entry(spark, 9, 7).withColumn("crc", journal.entry_crc(F.col("op"), F.col("rec_id"), F.col("payload")))).count() == 0


def test_log_files(spark, tmp_path):
    log = journal.Log(spark, f"file://{tmp_path}/log")
    assert log.replay().count() == 0
    log.append([(1, 7, b"a"), (1, 8, b"")])
    log.checkpoint(3)
    log.append([(1, 9, "\u00e9".encode()), (2, 9, b"")])
    again = journal.Log(spark, f"file://{tmp_path}/log")
    assert [(r["op"], r["rec_id"]) for r in again.replay().orderBy("seq").collect()] == [(1, 9), (2, 9)]
    assert again.truncate() == 1 and again.replay().count() == 2
    n = again.append([(1, 10, b"xyz")])
    file = tmp_path / "log" / f"{n:012d}.log"
    file.write_bytes(file.read_bytes()[:-1])
    (tmp_path / "log" / f".{n:012d}.log.crc").unlink(missing_ok=True)
    assert again.replay().count() == 2  # a torn entry ends the replay


def test_server(spark, tmp_path):
    import json
    import threading
    import urllib.request

    from tamarack.plans import server
    from tamarack.plans.engine import Engine, save_report

    e = Engine(spark, f"{tmp_path}/ix", spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>"), encoder=lambda q: [1.0, 0.1], now=5)
    assert server.answer(e, "/search?q=x")[0] == 503
    e.index.add(docs(spark, ["alpha beta", "gamma delta", "other words"]).withColumn("url", F.lit("http://u")))
    s = server.server(e, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    body = json.load(urllib.request.urlopen(f"http://127.0.0.1:{s.server_address[1]}/search?q=alpha&k=2&mode=hybrid"))
    s.shutdown()
    assert body["results"][0]["doc_id"] == 0 and body["num_docs"] == 3
    assert server.answer(e, "/search?q=x&k=0")[0] == server.answer(e, "/search?q=")[0] == 422 and server.answer(e, "/no")[0] == 404
    assert server.answer(e, "/health")[1]["vectors"] == 2 and server.answer(e, "/metrics")[1]["searches"] == 1
    save_report([{"a": 1}], f"{tmp_path}/r/x.json")
    assert json.loads((tmp_path / "r" / "x.json").read_text()) == {"a": 1}


def test_profile(spark, tmp_path):
    from tamarack.plans import profile

    ix = index.Index(spark, f"{tmp_path}/ix", 2)
    d = docs(spark, [f"index merge number{i} query" for i in range(6)] + ["other words", "river"] * 8)
    assert profile.amplification(ix, [d.where(F.col("doc_id") % 3 == i) for i in range(3)], max_per_tier=1, merge_factor=2)["write_amplification"] > 1
    assert profile.latency(ix, 2, warm=0)["n_queries"] == 2
    q = spark.createDataFrame([(0, "index number3"), (1, "river")], "qid int, text string")
    assert profile.pruning(ix, q, 3)["rows_differing"] == 0
    rel = spark.createDataFrame([(0, 3, 1)], "qid int, doc_id bigint, rel int")
    assert profile.quality(ix, q, rel)[0]["recall"] == 1.0
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id bigint, embedding array<float>")
    g = vectors.GraphIndex(spark, f"{tmp_path}/g")
    g.build(v)
    assert profile.beam_widths(g, v, v.where("vec_id < 3"), 5, (40,))[0]["recall"] == 1.0


def test_wet(spark, tmp_path):
    import gzip

    body = "é" * 120 + "\r\nWARC/1.0\r\nmore " + "x" * 50
    rows = [{"url": "http://a/", "ts": "2024-01-02T03:04:05Z", "text": body}, {"url": "dns:x", "ts": "", "text": "y" * 200}, {"url": "http://b/", "ts": "bad", "text": "short"}]
    with gzip.open(tmp_path / "a.warc.wet.gz", "wb") as f:
        f.write(wet.wet_bytes(rows))
    raw = wet.read_wet(spark, str(tmp_path))
    assert raw.count() == 3
    d = wet.to_documents(raw, now=5).collect()
    assert len(d) == 1 and d[0]["crawl_ts"] == 1704164645 and d[0]["text"] == body.replace("\r\n", "\n")
    (tmp_path / "paths").write_text("x/a.gz\nx/b.gz\n\nx/c.gz\n")
    m = wet.manifest(spark, str(tmp_path / "paths"), 2)
    have = spark.createDataFrame([("a.gz",)], "name string")
    assert [r["name"] for r in wet.missing(m, have).collect()] == ["b.gz"]
    (tmp_path / "src" / "x").mkdir(parents=True)
    for n in "ab":
        (tmp_path / "src" / "x" / f"{n}.gz").write_text(n)
    got = wet.fetch(spark, m, f"file://{tmp_path}/src", f"file://{tmp_path}/got")
    assert sorted(got) == ["a.gz", "b.gz"] and wet.fetch(spark, m, f"file://{tmp_path}/src", f"file://{tmp_path}/got") == []
    assert wet.read_wet(spark, f"file://{tmp_path}/none").count() == 0


def test_engine_and_stream(spark, tmp_path):
    from tamarack.plans.engine import Engine
    from tamarack.streaming.ingest import SCHEMA, StreamIngest

    topic = ["rust compiler", "garden bench", "river boat", "library desk"]
    rows = [(i, f"http://x/{i}", " ".join(f"{topic[i % 4]} {topic[i % 4].split()[0]}{i}{j} text{i * 7 + j}" for j in range(12)), 1_700_000_000, "en") for i in range(6)]
    rows.append((6, "http://x/6", rows[0][2], 1, "en"))
    df = spark.createDataFrame(rows, SCHEMA)
    e = Engine(spark, f"{tmp_path}/ix", now=1_700_000_000)
    assert e.ingest(df)["indexed"] == 6
    hits = e.respond("rust compiler", 3, "bm25")["results"]
    assert [h["doc_id"] for h in hits] == [0, 4] or {h["doc_id"] for h in hits} == {0, 4}
    for bad in (dict(q=""), dict(q="x", k=0), dict(q="x", mode="y"), dict(q="x", ef=1)):
        with pytest.raises(ValueError):
            e.search(**bad)
    assert e.health()["num_docs"] == 6 and e.metrics()["searches"] == 1
    df.where("rec_id < 4").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.where("rec_id >= 4").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = StreamIngest(spark, f"{tmp_path}/six", buckets=2)
    s.run(f"{tmp_path}/in", f"{tmp_path}/ck")
    assert s.index.num_docs() == 6 and s.index.num_segments() == 2
    s.run(f"{tmp_path}/in", f"{tmp_path}/ck")
    assert s.index.num_segments() == 2
    # A batch after a compaction leaves the merged segment alone, and a batch run again changes nothing.
    assert compaction.compact(s.index, 1, 2) == 2 and s.index.num_docs() == 6
    more = spark.createDataFrame([(9, "http://x/9", "an entirely other text " + " ".join(f"word{i}" for i in range(40)), 1, "en")], SCHEMA)
    s.process(more, 2)
    s.process(more, 2)
    assert s.index.num_docs() == 7 and s.index.num_segments() == 2

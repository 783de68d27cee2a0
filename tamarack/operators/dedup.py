"""Near-duplicates by SimHash: pairs of fingerprints, and the greedy first-wins rule of an ingest."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import DEDUP_CHARS, hamming, simhash, simhash_whole, strip, tokens
from tamarack.plans.stage import written

NEAR = 3


def fingerprints(docs: DataFrame, key: str = "doc_id", chars: int | None = None, whole: bool = True) -> DataFrame:
    """(key, fp) of whole texts.

    ``whole`` False keeps to the first 200 words (OP-F12), with ``chars`` to the first characters before (OP-F11).
    """
    if whole:
        return docs.select(key, simhash_whole("text").alias("fp"))
    text = F.substring("text", 1, chars) if chars else F.col("text")
    return docs.select(key, simhash(text).alias("fp"))


def classes(fps: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fp, first, n): one row for each fingerprint with its earliest document; copies stop here."""
    return fps.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n"))


BLOCKS, AGREE = 6, 3
#: Choices of AGREE of the BLOCKS parts of a fingerprint.
CHOICES = [c for c in itertools.combinations(range(BLOCKS), AGREE)]
EDGES = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]


def _keyed(fps: DataFrame) -> DataFrame:
    """A row for each choice of three of the six blocks: ``at`` the choice, ``val`` the bits of its blocks, about 32."""
    block = [F.shiftrightunsigned("fp", EDGES[i]).bitwiseAND(F.lit((1 << EDGES[i + 1] - EDGES[i]) - 1)) for i in range(BLOCKS)]
    vals = []
    for c in CHOICES:
        v = block[c[0]]
        for i in c[1:]:
            v = F.shiftleft(v, EDGES[i + 1] - EDGES[i]).bitwiseOR(block[i])
        vals.append(v)
    return fps.select("*", F.posexplode(F.array(*vals)).alias("at", "val"))


def _first_choice(a, b):
    """The first choice whose blocks are equal in both fingerprints; every other meeting of a pair is dropped by it."""
    same = lambda i: F.shiftrightunsigned(a.bitwiseXOR(b), EDGES[i]).bitwiseAND(F.lit((1 << EDGES[i + 1] - EDGES[i]) - 1)) == 0
    out = F.lit(len(CHOICES))
    for k in range(len(CHOICES) - 1, -1, -1):
        on = same(CHOICES[k][0])
        for i in CHOICES[k][1:]:
            on = on & same(i)
        out = F.when(on, F.lit(k)).otherwise(out)
    return out


def near_pairs(cls: DataFrame) -> DataFrame:
    """OP-J6: pairs (a, b) of class firsts, a earlier, whose fingerprints differ in at most NEAR bits.

    Three bits spoil three of six blocks at most, so two such fingerprints agree in some three blocks: the join on these, keys of about
    32 bits, loses none, and its buckets stay small where those of single bands grow with the corpus. A pair is kept at the first
    choice it agrees in only, so nothing need be made distinct.
    """
    x = _keyed(cls.select("fp", "first"))
    l, r = x.alias("l"), x.alias("r")
    j = l.join(r, (F.col("l.at") == F.col("r.at")) & (F.col("l.val") == F.col("r.val")) & (F.col("l.first") < F.col("r.first")))
    j = j.where((hamming(F.col("l.fp"), F.col("r.fp")) <= NEAR) & (_first_choice(F.col("l.fp"), F.col("r.fp")) == F.col("l.at")))
    return j.select(F.col("l.first").alias("a"), F.col("r.first").alias("b"))


def near_to(fps: DataFrame, known: DataFrame) -> DataFrame:
    """(fp) of those that differ from one of ``known`` (fp) in at most NEAR bits, each once."""
    n, o = _keyed(fps.select("fp")).alias("n"), _keyed(known.select("fp")).alias("o")
    j = n.join(o, (F.col("n.at") == F.col("o.at")) & (F.col("n.val") == F.col("o.val"))).where(hamming(F.col("n.fp"), F.col("o.fp")) <= NEAR)
    return j.select(F.col("n.fp").alias("fp")).distinct()


def greedy_kept(cls: DataFrame, pairs: DataFrame) -> DataFrame:
    """OP-D4: class firsts that the greedy rule keeps: in order of arrival, each that is near no earlier *kept* one.

    A node is kept once all its predecessors are dropped, and dropped once one of them is kept. Every round settles at
    least the earliest open node, so it ends.
    """
    edges = written(pairs, "edges")
    open_ = written(edges.select(F.col("b").alias("first")).distinct(), "open")
    settled_drop = None
    live = edges
    while not open_.isEmpty():
        kept_pred = live.join(open_.withColumnRenamed("first", "a"), "a", "left_anti")  # settled and not dropped: kept
        drop = written(kept_pred.select(F.col("b").alias("first")).distinct(), "drop")
        settled_drop = drop if settled_drop is None else settled_drop.union(drop)
        stay = open_.join(drop, "first", "left_anti")
        live = written(live.join(drop.withColumnRenamed("first", "b"), "b", "left_anti").join(drop.withColumnRenamed("first", "a"), "a", "left_anti"), "live")
        has_edge = live.select(F.col("b").alias("first")).distinct()
        open_ = written(stay.join(has_edge, "first", "left_semi"), "open")
    firsts = cls.select("first")
    return firsts if settled_drop is None else firsts.join(settled_drop, "first", "left_anti")


def greedy_dedup(docs: DataFrame, key: str = "doc_id", chars: int | None = DEDUP_CHARS, whole: bool = True) -> DataFrame:
    """(key, is_dup): whether each document, in the order of its key, repeats an earlier kept one; by whole texts, or else by
    the first ``chars`` characters and 200 words."""
    fps = written(fingerprints(docs, key, chars, whole), "fingerprints")
    cls = written(classes(fps, key), "classes")
    kept = greedy_kept(cls, near_pairs(cls)).select(F.col("first").alias(key), F.lit(True).alias("_k"))
    return fps.select(key).join(kept, key, "left").select(key, F.col("_k").isNull().alias("is_dup"))


def dupe_rate(flags: DataFrame) -> DataFrame:
    """OP-A9, OP-D5: one row (total_seen, total_dupes, dupe_rate); 0 for no documents."""
    return flags.agg(
        F.count("*").alias("total_seen"), F.coalesce(F.sum(F.col("is_dup").cast("long")), F.lit(0)).alias("total_dupes"),
        F.round(F.coalesce(F.avg(F.col("is_dup").cast("double")), F.lit(0.0)), 6).alias("dupe_rate"),
    )


def ingest(records: DataFrame, key: str = "rec_id", min_chars: int = 100, min_tokens: int = 10, max_docs: int | None = None, whole: bool = True) -> DataFrame:
    """OP-F1 to F7: what an ingest indexes, in the order of ``key``.

    Web addresses only, at least ``min_chars`` characters after trimming, greedy near-duplicate check, then at least
    ``min_tokens`` tokens: short documents still shadow later ones. ``max_docs`` None or 0 keeps all. ``whole`` False compares
    by the first characters and words only.
    """
    t = records.withColumn("text", strip(F.col("text"))).where(F.col("url").startswith("http") & (F.length("text") >= min_chars))
    t = t.join(greedy_dedup(t.select(key, "text"), key, whole=whole).where(~F.col("is_dup")).select(key), key, "left_semi")
    t = t.withColumn("n_tokens", F.size(tokens(F.col("text")))).where(F.col("n_tokens") >= min_tokens)
    return t.orderBy(key).limit(max_docs) if max_docs else t

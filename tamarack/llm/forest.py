"""Problem 2: new batches against all history, by a prefix-tree hash forest.

Signature: LEVELS minhashes of a text's five-word shingles for each of TREES permutations, 12 bits each, packed into one
number, so that a tree is a sorted run of numbers and a prefix of d minhashes is a range of it. The forest keeps, in a shared
folder: entries (key of the text, shingles), the trees' runs in sorted order, cut into slots by the leading bits, the verdict on each
entry and the pairs found. A manifest says which runs count; a run is in it or not at all, and the folder can be opened again by
another session. A batch reads none of the earlier texts: its entries are located in the runs by the range of their prefix.
Slots that no entry of the batch falls in are not read, and of the others only the ranges it hits are moved. The prefix starts at
all levels and is widened until the chance to meet a text of the required similarity in some tree reaches RECALL. All met pairs
whose sizes allow the similarity are verified on their whole shingle sets.

Exact copies (same words) form classes; only a class's first record enters the trees. A range of more than HOT entries is
never squared: its least entry is verified against all others, and as long as more than HOT of them are then without
verdict the next follows. What is still open after ROUNDS such rounds is cut up anew, by shingles: two texts with four fifths of
the longer one in common share one of the rarest fifth (and one) of their shingles, so nothing is lost. ``merge_runs`` sorts all runs of a tree into one.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.arrays import TextBatch, mapped, mix
from tamarack.plans.stage import Manifest, fresh_path, remove, written

SHINGLE = 5
TREES, LEVELS, BITS = 21, 5, 12
SIMILAR = 0.8
"""Shared shingles over those of the longer text."""
RECALL = 0.99
NEAREST = SIMILAR / (2 - SIMILAR)
"""Jaccard similarity for which RECALL is asked: the least that two texts with SIMILAR in common can have."""
HOT, ROUNDS = 64, 2
BROADCAST_IDS = 400_000
"""Ids up to this number are broadcast to pick entries; beyond it the entries are shuffled."""
FREQUENCIES = 1 << 20
"""Hash classes by which the rarity of shingles is told."""
SLOT_ROWS, MOST_SLOTS = 1_000_000, 256
"""Rows a slot of a run should hold, and the most slots of a tree."""


def depth(recall: float = RECALL, jaccard: float = NEAREST) -> int:
    """The longest prefix with which some tree meets such a pair with at least this chance."""
    for d in range(LEVELS, 1, -1):
        if 1 - (1 - jaccard**d) ** TREES >= recall:
            return d
    return 1


_R = np.random.default_rng(20_250_101)
_A = _R.integers(1, 2**63, TREES * LEVELS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 2**63, TREES * LEVELS, dtype=np.uint64)


def signature(b: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its words' hash, number of words, keys (text, tree), shingles (sorted, distinct) and their ends.

    A text of fewer than five words is one shingle.
    """
    from tamarack.llm.arrays import span_hash

    a, z = b.word_range
    whole = span_hash(b.word_hash, a, z) if b.n else np.zeros(0, np.uint64)
    at, h = b.ngram_hash(SHINGLE)
    few = np.flatnonzero((z - a < SHINGLE) & (z > a))
    doc = np.concatenate([b.word_doc[at], few]).astype(np.int64)
    val = np.concatenate([h, whole[few]]) >> np.uint64(32)
    both = np.unique(doc.astype(np.uint64) << np.uint64(32) | val)
    doc, val = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)
    ends = np.searchsorted(doc, np.arange(b.n), "right")
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if b.n else ends
    keys = np.zeros((b.n, TREES), np.int64)
    live = np.flatnonzero(ends > starts)
    if len(live):
        x = mix(val)
        lo, hi = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        for t in range(TREES):
            for k in range(LEVELS):
                i = t * LEVELS + k
                v = lo * np.uint32(_A[i] & np.uint64(0xFFFFFFFF)) + (hi ^ np.uint32(_B[i] & np.uint64(0xFFFFFFFF))) * np.uint32(_A[i] >> np.uint64(32) | np.uint64(1))
                v ^= v >> np.uint32(15)
                v *= np.uint32(0x85EBCA6B)
                least = np.minimum.reduceat(v, starts[live]).astype(np.uint64)
                least = mix(least + np.uint64(i)) >> np.uint64(64 - BITS)
                keys[live, t] = keys[live, t] << BITS | least.astype(np.int64)
    return whole, z - a, keys, val, ends


def entries(df: DataFrame) -> DataFrame:
    """(rec_id, h, n_words, keys, shingles) of each record with at least one word.

    Null texts, empty texts and texts without a word are no entries.
    """

    def make(b, kept):
        import pyarrow as pa

        whole, words, keys, val, ends = signature(b)
        live = np.flatnonzero(words > 0)
        starts = np.concatenate([[0], ends[:-1]]) if b.n else ends
        sizes = (ends - starts)[live]
        sh = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(val.astype(np.uint32).view(np.int32), pa.int32()))
        ks = pa.ListArray.from_arrays(pa.array(np.arange(len(live) + 1) * TREES, pa.int32()), pa.array(keys[live].ravel(), pa.int64()))
        return [kept[0].take(live), whole[live].view(np.int64), words[live], ks, sh]

    return mapped(df, "text", ["rec_id"], "rec_id bigint, h bigint, n_words int, keys array<bigint>, shingles array<int>", make)


_PAIR = "a bigint, b bigint"
_STORE = "rec_id bigint, shingles array<int>"
_KNOWN = "h bigint, n_words int, rec_id bigint"
_TREE = "rec_id bigint, n int, tree int, key bigint, slot int"
"""A run of trees without entries has no file that would tell its columns: that of a batch of nothing but copies."""


class Forest:
    """A forest in a folder of its own; ``add`` takes batch after batch, in the order of arrival, in one session or many."""

    def __init__(self, spark: SparkSession, folder: str | None = None, hot: int = HOT, rounds: int = ROUNDS):
        self.spark, self.hot, self.rounds = spark, hot, rounds
        self.folder = folder or fresh_path(spark, "forest")
        self.manifest = Manifest(spark, self.folder)
        self.version, state = self.manifest.read()
        self.runs: list[dict] = state.get("runs", [])

    def _read(self, what: str, schema: str | None = None, runs: list[dict] | None = None) -> DataFrame:
        runs = self.runs if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(_TREE) if what == "trees" else self.spark.read
        parts = [reader.parquet(f"{self.folder}/{what}/{r['name']}") for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _save(self, df: DataFrame, what: str, run: dict, by: str | None = None) -> DataFrame:
        path = f"{self.folder}/{what}/{run['name']}"
        w = df.write.mode("errorifexists")
        (w.partitionBy(by) if by else w).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # candidates

    def _pairs(self, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
        """Different pairs (a, b), a < b, b new and one of them open, of the same bucket, whose sizes allow the similarity.

        Without ``right`` all pairs of ``left`` are meant.
        """
        side = lambda d, c: d.select("tree", "prefix", *(F.col(k).alias(c + k) for k in ("rec_id", "n", "is_new", "is_open")))
        j = side(left, "x").join(side(left if right is None else right, "y"), ["tree", "prefix"])
        order = "xrec_id < yrec_id AND yis_new" if right is None else "xrec_id <> yrec_id AND CASE WHEN xrec_id < yrec_id THEN yis_new ELSE xis_new END"
        p = j.where(f"{order} AND (xis_open OR yis_open) AND least(xn, yn) >= {SIMILAR}D * greatest(xn, yn)")
        return p.select(F.least("xrec_id", "yrec_id").alias("a"), F.greatest("xrec_id", "yrec_id").alias("b")).distinct()

    def _met(self, members: DataFrame, store: DataFrame, last: bool = False) -> DataFrame:
        """Verified pairs (a, b) that share a bucket. members: tree, prefix, rec_id, n, is_new, is_open.

        A pair of two entries that are not open is not looked at. ``last``: rounds go on until no bucket has many open entries.
        """
        bucket = ["tree", "prefix"]
        size = members.groupBy(*bucket).agg(F.count("*").alias("m"), F.max("is_new").alias("any_new"), F.max("is_open").alias("any_open"))
        kept = written(members.join(size.where("m > 1 AND any_new AND any_open").select(*bucket, "m"), bucket), "members")
        found = self._verify(store, self._pairs(kept.where(F.col("m") <= self.hot)))
        hot = kept.where(F.col("m") > self.hot)
        if hot.isEmpty():
            return found
        # Open: entries of a hot bucket that nothing earlier is known to equal, so that others may repeat them.
        open_ = hot.where("is_open").join(found.select(F.col("b").alias("rec_id")).distinct(), "rec_id", "left_anti")
        done = 0
        while True:
            per = open_.groupBy(*bucket).agg(F.count("*").alias("c"), F.min("rec_id").alias("rec_id")).where(F.col("c") > self.hot)
            lead = written(open_.join(per.select(*bucket, "rec_id"), [*bucket, "rec_id"], "left_semi"), "leads")
            if lead.isEmpty() or done == self.rounds and not last:
                break
            got = self._verify(store, self._pairs(lead, hot))
            found = written(found.unionByName(got).distinct(), "found")
            settled = got.select(F.col("b").alias("rec_id")).distinct()
            open_ = written(open_.join(lead.select(*bucket, "rec_id"), [*bucket, "rec_id"], "left_anti").join(settled, "rec_id", "left_anti"), "open")
            done += 1
        if not lead.isEmpty():
            many = lead.select(*bucket).distinct()
            sub = self._by_rare_shingles(hot.join(many, bucket, "left_semi"), open_.join(many, bucket, "left_semi"), store)
            found = found.unionByName(self._met(sub, store, True))
            open_ = open_.join(many, bucket, "left_anti")
        # At most ``hot`` open entries a bucket are left, each against all of it.
        return found.unionByName(self._verify(store, self._pairs(open_, hot))).distinct()

    def _by_rare_shingles(self, hot: DataFrame, open_: DataFrame, store: DataFrame) -> DataFrame:
        """The entries of hot buckets as members of a bucket for each of their rarest shingles.

        Any fixed order of the shingles will do; this one goes by how often a shingle's hash class occurs among these entries. The classes
        are FREQUENCIES many, whatever the corpus, so the order is known in every task and nothing is shuffled for it.
        """
        ids = hot.groupBy("rec_id").agg(F.max("n").alias("n"), F.max("is_new").alias("is_new"))
        ids = ids.join(open_.select("rec_id").distinct().withColumn("is_open", F.lit(True)), "rec_id", "left").fillna(False, ["is_open"])
        ids = written(ids, "hot-ids")
        held = written(self._pick(store, ids.select("rec_id")).join(ids, "rec_id"), "hot-entries")
        often = held.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(FREQUENCIES)).alias("k")).count().toPandas()
        table = np.zeros(FREQUENCIES, np.int64)
        table[often["k"].to_numpy(np.int64)] = often["count"].to_numpy(np.int64)
        known = self.spark.sparkContext.broadcast(table)

        def rare(batches):
            import pyarrow as pa

            for b in batches:
                lists = b.column("shingles")
                s = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((s, known.value[s % FREQUENCIES], row))
                place = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
                least = size - np.ceil(SIMILAR * size - 1e-9).astype(np.int64) + 1
                pick = place < least[row]
                at = pa.array(row[pick])
                cols = [b.column(c).take(at) for c in ("rec_id", "n", "is_new", "is_open")]
                yield pa.RecordBatch.from_arrays([pa.array(s[order][pick], pa.int64()), *cols], ["prefix", "rec_id", "n", "is_new", "is_open"])

        out = held.select("rec_id", "n", "is_new", "is_open", "shingles").mapInArrow(rare, "prefix bigint, rec_id bigint, n int, is_new boolean, is_open boolean")
        return out.withColumn("tree", F.lit(-1))

    def _pick(self, table: DataFrame, ids: DataFrame) -> DataFrame:
        """Rows of ``table`` with these ids, without a shuffle of the table where the ids are few."""
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return table.join(F.broadcast(ids) if few else ids, "rec_id", "left_semi")

    def _verify(self, store: DataFrame, pairs: DataFrame) -> DataFrame:
        """The pairs that share at least SIMILAR of the longer text's shingles."""
        p = written(pairs, "met")
        if p.isEmpty():
            return p
        ids = written(p.select(F.col("a").alias("rec_id")).union(p.select(F.col("b").alias("rec_id"))).distinct(), "ids")
        full = written(self._pick(store, ids), "picked")
        p = p.join(full.select(F.col("rec_id").alias("a"), F.col("shingles").alias("sa")), "a").join(
            full.select(F.col("rec_id").alias("b"), F.col("shingles").alias("sb")), "b"
        )
        return written(p.where(F.expr(f"size(array_intersect(sa, sb)) >= {SIMILAR}D * greatest(size(sa), size(sb))")).select("a", "b"), "verified")

    def add(self, batch: DataFrame) -> DataFrame:
        """Checks a batch against all that was accepted and against itself, and accepts it.

        Returns (rec_id_a, rec_id_b): b of this batch repeats a, and a repeats no earlier record. rec_id must be unique and
        grow from batch to batch, which is checked (ValueError). Null, empty and wordless texts are accepted and match nothing; a
        batch without entries adds no run.
        """
        run = {"name": f"run-{self.version:06d}-{uuid.uuid4().hex[:8]}"}
        new = self._save(entries(batch.where("rec_id IS NOT NULL")), "entries", run)
        figures = new.agg(F.count("*").alias("n"), F.min("rec_id").alias("lo"), F.max("rec_id").alias("hi")).first()
        if not figures["n"]:
            return self.spark.createDataFrame([], "rec_id_a bigint, rec_id_b bigint")
        if self.runs and figures["lo"] <= max(r["hi"] for r in self.runs):
            raise ValueError("rec_id must be above those of all earlier batches")
        run["hi"] = figures["hi"]
        known = self._read("classes", _KNOWN)
        head = new.groupBy("h", "n_words").agg(F.min("rec_id").alias("rec_id"))
        classes = self._save(head.join(known, ["h", "n_words"], "left_anti").select("h", "n_words", "rec_id"), "classes", run)
        # Signatures of class heads; shingles stay where they are until a pair asks for them.
        heads_of = new.select("rec_id", "keys", F.size("shingles").alias("n")).join(classes.select("rec_id"), "rec_id", "left_semi")
        # Slots are ranges of the leading bits; a power of two, so that slots of runs of any size nest.
        slots = 1
        while slots < MOST_SLOTS and slots * SLOT_ROWS < figures["n"]:
            slots *= 2
        run["slots"] = slots
        bits = BITS * LEVELS - (slots.bit_length() - 1)
        tree = heads_of.select("rec_id", "n", F.posexplode("keys").alias("tree", "key"))
        tree = tree.withColumn("slot", F.col("tree") * slots + F.shiftright("key", bits).cast("int"))
        tree = self._save(tree.repartitionByRange("slot", "key").sortWithinPartitions("slot", "key"), "trees", run, "slot")
        shift = BITS * (LEVELS - depth())
        prefixed = lambda t: t.select("tree", F.shiftright("key", shift).alias("prefix"), "rec_id", "n")
        members = prefixed(tree).withColumns({"is_new": F.lit(True), "is_open": F.lit(True)})
        if self.runs:
            # The ranges the batch hits: slots that none falls in are not opened, and of the rest only hits are moved.
            hit = written(members.select("tree", "prefix").distinct(), "ranges")
            old = None
            for r in self.runs:
                own = BITS * LEVELS - (r["slots"].bit_length() - 1) - shift
                wanted = [x[0] for x in hit.select((F.col("tree") * r["slots"] + F.shiftright("prefix", own).cast("int")).alias("s")).distinct().collect()]
                part = prefixed(self._read("trees", runs=[r]).where(F.col("slot").isin(wanted)))
                old = part if old is None else old.unionByName(part)
            few = hit.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
            old = written(old.join(F.broadcast(hit) if few else hit, ["tree", "prefix"], "left_semi"), "hits")
            members = members.unionByName(old.withColumns({"is_new": F.lit(False), "is_open": F.lit(True)}))
        store = self._read("entries", runs=[*self.runs, run]).select("rec_id", "shingles")
        similar = self._met(members, store)
        later = similar.select(F.col("b").alias("rec_id")).distinct()
        verdict = classes.select("rec_id").join(later.withColumn("hit", F.lit(True)), "rec_id", "left").select("rec_id", F.col("hit").isNull().alias("original"))
        verdict = self._save(verdict, "verdicts", run)
        # Pairs of class heads with originals; every other member of a class repeats the same, and its head.
        first = lambda v: v.where("original").select("rec_id")
        original = first(self._read("verdicts", "rec_id bigint, original boolean").unionByName(verdict))
        own_heads = self._save(similar.join(original.withColumnRenamed("rec_id", "a"), "a", "left_semi").select("a", "b"), "heads", run)
        heads = self._read("heads", _PAIR).unionByName(own_heads)
        member = new.select(F.col("rec_id").alias("rec_id_b"), "h", "n_words").join(known.unionByName(classes).withColumnRenamed("rec_id", "head"), ["h", "n_words"])
        same = member.where("rec_id_b <> head").join(original.withColumnRenamed("rec_id", "head"), "head", "left_semi")
        via = member.join(heads.select(F.col("a").alias("rec_id_a"), F.col("b").alias("head")), "head")
        out = self._save(same.select(F.col("head").alias("rec_id_a"), "rec_id_b").unionByName(via.select("rec_id_a", "rec_id_b")), "results", run)
        self._commit([*self.runs, run])
        return out

    def _commit(self, runs: list[dict]) -> None:
        self.version = self.manifest.commit(self.version, {"runs": runs})
        self.runs = runs

    def merge_runs(self) -> None:
        """Sorts the runs of the trees, and with them all else that is kept, into one. Readers see the old runs or the new one."""
        if len(self.runs) < 2:
            return
        old, slots = self.runs, max(r["slots"] for r in self.runs)
        run = {"name": f"run-{self.version:06d}-{uuid.uuid4().hex[:8]}", "hi": max(r["hi"] for r in old), "slots": slots}
        for what in ("entries", "classes", "verdicts", "heads"):
            self._save(self._read(what), what, run)
        bits = BITS * LEVELS - (slots.bit_length() - 1)
        tree = self._read("trees").withColumn("slot", F.col("tree") * slots + F.shiftright("key", bits).cast("int"))
        self._save(tree.repartitionByRange("slot", "key").sortWithinPartitions("slot", "key"), "trees", run, "slot")
        self._commit([run])
        for r in old:
            for what in ("entries", "classes", "verdicts", "heads", "trees"):
                remove(self.spark, f"{self.folder}/{what}/{r['name']}")


def _in_order(df: DataFrame, batch: Column) -> tuple[list[tuple[int, DataFrame]], bool]:
    """The records as a forest can take them: (batch, records) with rec_ids that grow from one to the next, and whether batches mix.

    Where a batch has rec_ids above some of a later batch, the records from there on come with the later one. Batches are few: their
    numbers come to the driver.
    """
    of = df.where("rec_id IS NOT NULL").groupBy(batch.alias("k")).agg(F.min("rec_id").alias("lo"), F.max("rec_id").alias("hi"))
    parts, mixed, before = [], False, None
    for k, lo, hi in sorted(map(tuple, of.collect()), reverse=True):
        mixed |= before is not None and hi >= before
        if before is None or lo < before:
            parts.append((k, df.where(F.col("rec_id") >= lo if before is None else F.col("rec_id").between(lo, before - 1))))
            before = lo
    return parts[::-1], mixed


def _of_new(pairs: DataFrame, df: DataFrame, batch: Column, mixed: bool) -> DataFrame:
    """The pairs whose b is of a batch above 0; it always is where batches do not mix."""
    if not mixed:
        return pairs
    new = df.where(batch > 0).select(F.col("rec_id").alias("rec_id_b"))
    return pairs.join(new, "rec_id_b", "left_semi").select("rec_id_a", "rec_id_b")


def repeats(df: DataFrame, folder: str | None = None) -> DataFrame:
    """(rec_id_a, rec_id_b) of the records in batches above 0 that repeat an earlier one.

    History (batch 0 and rows without a batch) is accepted first, the new batches after it; history that arrived after a new record comes with those.
    """
    forest = Forest(df.sparkSession, folder)
    batch = (F.coalesce("batch_id", F.lit(0)) > 0).cast("int")
    parts, mixed = _in_order(df, batch)
    out = df.sparkSession.createDataFrame([], "rec_id_a bigint, rec_id_b bigint")
    for k, part in parts:
        got = forest.add(part)
        out = got if k else out
    return _of_new(out, df, batch, mixed)


def batch_by_batch(df: DataFrame, folder: str | None = None, merge_after: int = 3) -> DataFrame:
    """The same, each batch by a forest opened anew from the folder; every ``merge_after`` batches the runs are merged.

    Results of a batch do not depend on those after it.
    """
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "forest")
    batch = F.greatest(F.coalesce("batch_id", F.lit(0)), F.lit(0))
    out = spark.createDataFrame([], "rec_id_a bigint, rec_id_b bigint")
    parts, mixed = _in_order(df, batch)
    for i, (k, part) in enumerate(parts):
        forest = Forest(spark, folder)
        got = forest.add(part)
        out = out.unionByName(got) if k else out
        if (i + 1) % merge_after == 0:
            forest.merge_runs()
    return _of_new(out, df, batch, mixed)

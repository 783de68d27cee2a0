"""Nearest neighbours: exact in blocks, by random hyperplanes, and by partition-local graphs."""

from __future__ import annotations

import heapq
import io
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 32 * 1024 * 1024
"""Queries are sent to the executors in blocks of this size."""


def cosine_distance(a: Column, b: Column) -> Column:
    """OP-V1, in double; 1 where either vector has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - dot / n)


def query_blocks(queries: DataFrame, key: str = "vec_id"):
    """Driver side: (ids, matrix) of the queries, block after block; never more than BLOCK_BYTES at once."""
    ids, rows, size = [], [], 0
    for r in queries.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).select(key, "embedding").orderBy(key).toLocalIterator():
        ids.append(r[0])
        rows.append(np.array(r[1], np.float64))
        size += rows[-1].nbytes
        if size >= BLOCK_BYTES:
            yield np.array(ids), np.stack(rows)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids), np.stack(rows)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = False) -> DataFrame:
    """OP-V8, OP-O4: (qid, vec_id, dist, rank) of the k nearest vectors of each query, ties by id.

    Every query block is broadcast (bounded by BLOCK_BYTES) and meets every vector once; each batch gives at most k rows a
    query. Distances are rounded to six places before ranking. Null vectors are left out, those of length 0 lie at 1.
    """
    spark = vectors.sparkSession
    v = vectors.where(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    parts = None
    for ids, q in query_blocks(queries):
        known = spark.sparkContext.broadcast((ids, q, np.sqrt((q * q).sum(1))))

        def near(batches, known=known):
            ids, q, nq = known.value
            for pdf in batches:
                if not len(pdf):
                    continue
                m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                own = pdf["vec_id"].to_numpy()
                nm = np.sqrt((m * m).sum(1))
                both = np.outer(nq, nm)
                d = np.where(both == 0, 1.0, 1 - (q @ m.T) / np.where(both == 0, 1, both)).round(6) + 0.0
                if exclude_self:
                    d[ids[:, None] == own[None]] = np.inf
                take = min(k, len(own))
                order = np.lexsort((np.broadcast_to(own, d.shape), d), axis=1)[:, :take]
                yield pd.DataFrame({"qid": np.repeat(ids, take), "vec_id": own[order].ravel(), "dist": np.take_along_axis(d, order, 1).ravel()}).query("dist < inf")

        got = v.mapInPandas(near, "qid bigint, vec_id bigint, dist double")
        parts = got if parts is None else parts.unionByName(got)
    if parts is None:
        parts = spark.createDataFrame([], "qid bigint, vec_id bigint, dist double")
    w = W.partitionBy("qid").orderBy("dist", "vec_id")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def half_precision(v: pd.Series) -> pd.Series:
    """OP-V2: what is left of a vector stored in 16-bit floats."""
    there = v.notna().to_numpy()
    size = np.fromiter((len(x) for x in v[there]), np.int64, int(there.sum()))
    flat = np.concatenate([np.zeros(0, np.float32), *v[there]]).astype(np.float16).astype(np.float32)
    out = pd.Series([None] * len(v), dtype=object)
    for i, x in zip(np.flatnonzero(there), np.split(flat, np.cumsum(size)[:-1]) if len(size) else []):
        out.iat[i] = x
    return out


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """OP-V9: (qid, recall): share of a query's true neighbours that were found; 0 over an empty truth."""
    hit = found.select("qid", "vec_id").join(truth.select("qid", "vec_id"), ["qid", "vec_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("h"))
    n = truth.groupBy("qid").agg(F.count("*").alias("n"))
    return n.join(hit, "qid", "left").select("qid", (F.coalesce("h", F.lit(0)) / F.greatest("n", F.lit(1))).alias("recall"))


def planes(dim: int, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables, bits, dim))


def lsh_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 40, bits: int = 5, seed: int = 11) -> DataFrame:
    """Approximate neighbours: candidates share the signs of some hyperplanes in one of several tables, then exact distance.

    The planes are drawn from a seed, need no fitting, and index every row. Buckets have no cap. The defaults reach a recall
    of 0.96 on vectors without any clusters; where neighbours are close, more bits give the same for far less work.
    """
    one = vectors.where("embedding IS NOT NULL").select(F.size("embedding").alias("d")).first()
    if one is None:
        return knn(vectors, queries, k)
    h = planes(one["d"], tables, bits, seed)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def buckets(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy()).astype(np.float64)
        on = np.einsum("nd,tbd->ntb", m, h) > 0
        return pd.Series(list((on @ (1 << np.arange(bits))).astype(np.int32)))

    def keyed(df: DataFrame) -> DataFrame:
        return df.where("embedding IS NOT NULL").select("vec_id", F.posexplode(buckets("embedding")).alias("t", "h"))

    c = keyed(queries).withColumnRenamed("vec_id", "qid").join(keyed(vectors), ["t", "h"]).select("qid", "vec_id").distinct()
    c = c.join(vectors.select("vec_id", F.col("embedding").alias("v")), "vec_id").join(queries.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), "qid")
    d = c.select("qid", "vec_id", F.round(cosine_distance(F.col("q"), F.col("v")), 6).alias("dist"))
    w = W.partitionBy("qid").orderBy("dist", "vec_id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Graph:
    """OP-V3 to V7: hierarchical small-world graph over the vectors of one shard.

    Levels come from a hash of the id, so a build is repeatable. A node's links point in different directions: a neighbour that is nearer to
    one already taken than to the node is taken only if room is left. A search stops when the nearest open node is farther than
    the worst of ``ef`` results, not before there are ``ef``.
    """

    def __init__(self, dim: int, m: int = 16, ef_construction: int = 200, half: bool = True):
        self.m, self.efc, self.half, self.dim = m, ef_construction, half, dim
        self.scale = 1 / math.log(m)
        self.unit = np.zeros((0, dim), np.float32)
        self.ids: list[int] = []
        self.links: list[dict[int, list[int]]] = []
        self.entry: int | None = None

    def _level(self, node: int) -> int:
        x = (node * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
        x ^= x >> 31
        return int(-math.log((x + 1) / 2**64) * self.scale)

    def _room(self, layer: int) -> int:
        return 2 * self.m if layer == 0 else self.m

    def _dist(self, q: np.ndarray, at: list[int]) -> np.ndarray:
        return 1 - self.unit[at] @ q

    def build(self, ids, vectors) -> Graph:
        v = np.asarray(vectors, np.float32)
        v = v.astype(np.float16).astype(np.float32) if self.half else v
        n = np.linalg.norm(v, axis=1, keepdims=True)
        self.unit = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        self.ids = [int(i) for i in ids]
        tops = [self._level(i) for i in self.ids]
        # The highest node first: it is the way in for all others, and no later one can rise above it.
        order = sorted(range(len(tops)), key=lambda i: (-tops[i], i)) if tops else []
        self.links = [{} for _ in range(max(tops, default=-1) + 1)]
        for i in order[:1]:
            self.entry = i
        for i in order[:1] + sorted(order[1:]):
            self._join(i, tops[i])
        return self

    def _beam(self, q, starts: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        graph, seen = self.links[layer], set(starts)
        near = sorted(zip(self._dist(q, starts).tolist(), starts))
        open_, best = list(near), [(-d, -i) for d, i in near]
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            d, i = heapq.heappop(open_)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in graph.get(i, ()) if j not in seen]
            if not new:
                continue
            seen.update(new)
            for dj, j in zip(self._dist(q, new).tolist(), new):
                if len(best) < ef or dj < -best[0][0]:
                    heapq.heappush(open_, (dj, j))
                    heapq.heappush(best, (-dj, -j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, -i) for d, i in best)

    def _spread(self, at: np.ndarray, near: np.ndarray, room: int) -> list[int]:
        """Up to ``room`` of the nodes ``at``, nearest first (``near``), that lie in different directions; then the rest in order."""
        if len(at) <= room:
            return at.tolist()
        at, near = at[: 3 * room], near[: 3 * room]
        between = 1 - self.unit[at] @ self.unit[at].T
        nearest = np.full(len(at), np.inf)
        taken, spare = [], []
        for k in range(len(at)):
            if near[k] <= nearest[k]:
                taken.append(k)
                if len(taken) == room:
                    break
                np.minimum(nearest, between[k], out=nearest)
            else:
                spare.append(k)
        return at[taken + spare[: room - len(taken)]].tolist()

    def _join(self, i: int, top: int) -> None:
        q = self.unit[i]
        if i == self.entry:
            for graph in self.links[: top + 1]:
                graph[i] = []
            return
        at = [self.entry]
        for layer in range(len(self.links) - 1, -1, -1):
            if layer > top:
                at = [self._beam(q, at, 1, layer)[0][1]]
                continue
            near = self._beam(q, at, self.efc, layer)
            at = [j for _, j in near]
            mine = self._spread(np.array(at), np.array([d for d, _ in near]), self._room(layer))
            graph = self.links[layer]
            graph[i] = mine
            for j in mine:
                graph[j].append(i)
                if len(graph[j]) > self._room(layer):
                    row = np.array(graph[j])
                    d = self._dist(self.unit[j], row)
                    by = np.argsort(d, kind="stable")
                    graph[j] = self._spread(row[by], d[by], self._room(layer))

    def search(self, q, k: int, ef: int = 50) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest, rising; empty for an empty graph."""
        if self.entry is None:
            return []
        q = np.asarray(q, np.float32)
        n = np.linalg.norm(q)
        q = q / n if n else q
        at = [self.entry]
        for layer in range(len(self.links) - 1, 0, -1):
            at = [self._beam(q, at, 1, layer)[0][1]]
        return [(d, self.ids[i]) for d, i in self._beam(q, at, max(ef, k), 0)[:k]]

    def dump(self) -> bytes:
        """OP-S9, OP-K7: the graph as bytes: unit vectors in 16-bit floats if it was built so, ids, and the links of each layer."""
        out = {"unit": self.unit.astype(np.float16) if self.half else self.unit, "ids": np.array(self.ids, np.int64), "head": np.array([self.dim, self.m, self.efc, self.half, -1 if self.entry is None else self.entry, len(self.links)])}
        for k, graph in enumerate(self.links):
            rows = [graph[i] for i in graph]
            out[f"n{k}"] = np.array(list(graph), np.int32)
            out[f"e{k}"] = np.cumsum([len(r) for r in rows]).astype(np.int64)
            out[f"l{k}"] = np.array([j for r in rows for j in r], np.int32)
        held = io.BytesIO()
        np.savez(held, **out)
        return held.getvalue()

    @classmethod
    def restored(cls, raw: bytes) -> Graph:
        with np.load(io.BytesIO(raw)) as z:
            dim, m, efc, half, entry, layers = z["head"].tolist()
            g = cls(dim, m, efc, bool(half))
            v = z["unit"].astype(np.float32)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            g.unit = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
            g.ids, g.entry = z["ids"].tolist(), None if entry < 0 else entry
            for k in range(layers):
                g.links.append({i: r.tolist() for i, r in zip(z[f"n{k}"].tolist(), np.split(z[f"l{k}"], z[f"e{k}"][:-1]))})
        return g


SHARD_ROWS = 50_000


def _build_shard(m: int, ef_construction: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        vec = np.stack(pdf["embedding"].to_numpy())
        raw = Graph(vec.shape[1], m, ef_construction).build(pdf["vec_id"], vec).dump()
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [len(pdf)], "graph": [raw]})

    return build


class GraphIndex:
    """OP-V5, OP-V6, OP-V11, OP-S9: graphs over all vectors, one for each shard of hashed ids, kept in a folder.

    Shards hold about SHARD_ROWS vectors, so a task's work is bounded however many vectors there are. A build writes a new
    version; readers keep the one they opened. Graphs are loaded in the tasks; nothing but the queries of a block is sent there.
    """

    SCHEMA = "shard int, n bigint, graph binary"

    def __init__(self, spark, folder: str, m: int = 16, ef_construction: int = 200):
        from tamarack.plans.stage import Manifest

        self.spark, self.folder, self.m, self.efc = spark, folder.rstrip("/"), m, ef_construction
        self.manifest = Manifest(spark, self.folder)

    def exists(self) -> bool:
        return bool(self.manifest.read()[1])

    def build(self, vectors: DataFrame, shards: int | None = None) -> int:
        """Builds and writes the graphs of vectors (vec_id, embedding); the number of vectors. Null vectors are left out."""
        v = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding")
        n = v.count()
        shards = shards or max(1, -(-n // SHARD_ROWS))
        v = v.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
        version, _ = self.manifest.read()
        name = f"graphs-{version + 1}-{uuid.uuid4().hex[:8]}"
        got = v.groupBy("shard").applyInPandas(_build_shard(self.m, self.efc), self.SCHEMA)
        got.write.mode("errorifexists").option("parquet.page.size", 1 << 20).parquet(f"{self.folder}/{name}")
        self.manifest.commit(version, {"graphs": name, "vectors": n})
        return n

    def size(self) -> int:
        return self.manifest.read()[1].get("vectors", 0)

    def search(self, queries: DataFrame, k: int = 10, efs: tuple[int, ...] = (50,)) -> DataFrame:
        """(ef, qid, vec_id, dist, rank). Every shard answers all queries of a block and the answers are merged, so recall does not fall
        with the number of shards. Distances are rounded to six places; ties go by id."""
        _, state = self.manifest.read()
        schema = "ef int, qid bigint, vec_id bigint, dist double"
        parts = self.spark.createDataFrame([], schema)
        if state:
            graphs = self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/{state['graphs']}").repartition("shard")
            for i, (ids, q) in enumerate(query_blocks(queries)):
                got = graphs.mapInPandas(_answers(self.spark.sparkContext.broadcast((ids, q)), k, efs), schema)
                parts = got if i == 0 else parts.unionByName(got)
        w = W.partitionBy("ef", "qid").orderBy("dist", "vec_id")
        return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _answers(known, k: int, efs: tuple[int, ...]):
    def answer(batches):
        ids, q = known.value
        for pdf in batches:
            for raw in pdf["graph"]:
                g = Graph.restored(bytes(raw))
                # A few more than k, as 16-bit storage may change the order; distances are those of the stored vectors.
                rows = [(ef, int(i), j, round(float(d), 6) + 0.0) for ef in efs for i, x in zip(ids, q) for d, j in g.search(x, k, ef)]
                yield pd.DataFrame(rows, columns=["ef", "qid", "vec_id", "dist"])

    return answer


def hnsw_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, efs: tuple[int, ...] = (50,), m: int = 16, ef_construction: int = 200, shards: int | None = None) -> DataFrame:
    """OP-V10: graphs built for one search only; a GraphIndex keeps them."""
    from tamarack.plans.stage import fresh_path

    g = GraphIndex(vectors.sparkSession, fresh_path(vectors.sparkSession, "graphs"), m, ef_construction)
    g.build(vectors, shards)
    return g.search(queries, k, efs)


def exact_again(near: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Neighbours (qid, vec_id) measured again on the full vectors: (qid, vec_id, dist, rank)."""
    j = near.select("qid", "vec_id").join(vectors.select("vec_id", F.col("embedding").alias("_v")), "vec_id")
    j = j.join(queries.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("_q")), "qid")
    d = j.select("qid", "vec_id", (F.round(cosine_distance(F.col("_q"), F.col("_v")), 6) + 0.0).alias("dist"))
    w = W.partitionBy("qid").orderBy("dist", "vec_id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sample(df: DataFrame, n: int, key: str = "vec_id", seed: str = "s") -> DataFrame:
    """OP-O6: n rows without replacement, in the order of a seeded hash of the key, so that it can be repeated."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)

"""Approximate nearest neighbours: stable projections in a kd-tree, verified until a chi-square test holds (operator 10)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folianth.llm.store import materialize

#: Vectors of a shard, and queries of a block: bounds of what a task holds.
SHARD_ROWS = 16_384
QUERY_ROWS = 512
LEAF_ROWS = 128


def chi_square_quantile(p: float, even_degrees: int) -> float:
    """x with P(chi-square <= x) = p, for an even number of degrees of freedom."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(even_degrees // 2))

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class ProjectedTree:
    """Distinct unit vectors by a kd-tree over Gaussian projections, whose squared distances are chi-square spread."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dims: int, seed: int = 11):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, inverse = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.vectors = vectors[first].astype(np.float64)
        members = np.argsort(inverse, kind="stable")
        self.members = np.split(ids[members], np.searchsorted(inverse[members], np.arange(1, len(first))))
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], dims))
        self.points = (self.vectors / self.norms[:, None]) @ self.axes
        self.order: list[np.ndarray] = []
        self.filled = 0
        #: For an inner node its children and their boxes, for a leaf its place in the vectors.
        self.nodes: list[tuple] = []
        self._split(np.arange(len(self.points)))
        order = np.concatenate(self.order)
        self.vectors, self.norms, self.members = self.vectors[order], self.norms[order], [self.members[i] for i in order.tolist()]
        del self.points, self.order

    def _split(self, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Number, least and greatest corner of the node over these rows."""
        p, node = self.points[rows], len(self.nodes)
        low, high = p.min(axis=0), p.max(axis=0)
        self.nodes.append(())
        if len(rows) > LEAF_ROWS:
            by = rows[np.argsort(p[:, int(np.argmax(high - low))], kind="stable")]
            left, right = self._split(by[: len(by) // 2]), self._split(by[len(by) // 2 :])
            self.nodes[node] = (left[0], right[0], np.stack([left[1], right[1]]), np.stack([left[2], right[2]]))
        else:
            self.order.append(rows)
            self.nodes[node] = (self.filled, self.filled + len(rows))
            self.filled += len(rows)
        return node, low, high

    def nearest(self, query: np.ndarray, own: int, k: int, bound: float) -> list[tuple[float, int]]:
        """The k best (cosine, id), best first. Leaves come by projected distance; it stops where a vector nearer than
        the k-th found would have so far a projection with no more than the remaining chance."""
        norm = math.sqrt(float(np.einsum("i,i->", query, query)))
        point = (query / norm) @ self.axes
        best: list[tuple[float, int]] = []  # (cosine, -id), the worst first
        todo = [(0.0, 0)]
        while todo:
            distance, number = heapq.heappop(todo)
            if len(best) == k and distance > bound * max(0.0, 2 - 2 * best[0][0]):
                break
            node = self.nodes[number]
            if len(node) == 4:
                gap = np.maximum(node[2] - point, point - node[3])
                np.maximum(gap, 0, out=gap)
                near, far = np.einsum("ij,ij->i", gap, gap).tolist()
                heapq.heappush(todo, (near, node[0]))
                heapq.heappush(todo, (far, node[1]))
                continue
            a, b = node
            scores = np.einsum("ij,j->i", self.vectors[a:b], query) / (self.norms[a:b] * norm)
            for r in np.flatnonzero(scores >= best[0][0]).tolist() if len(best) == k else range(b - a):
                s = float(scores[r])
                for i in self.members[a + r][: k + 1].tolist():
                    if i != own:
                        if len(best) < k:
                            heapq.heappush(best, (s, -i))
                        elif (s, -i) > best[0]:
                            heapq.heapreplace(best, (s, -i))
        return [(s, -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))]


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, dims: int = 8, chance: float = 0.9) -> DataFrame:
    """For each query its k nearest by cosine: query_id, rank, vec_id, score.

    vectors and queries: vec_id, embedding. Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor rows without a vec_id; a query meets only vectors of its length and never its own vec_id. With
    fewer candidates all are given. Ties go to the smaller vec_id; equal vectors are indexed once, so many copies cost
    nothing. A vec_id that repeats with different vectors counts once for each. Every row is indexed. Shards are
    searched by blocks of queries; chance bounds a true neighbour's miss by the stopping test.
    """
    ok = F.expr("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    kind = vectors.schema["embedding"].dataType
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(ok).withColumn("dim", F.size("embedding"))
    counts = kept.groupBy("dim").count().collect()  # a row for each vector length
    if not counts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = F.create_map(*[F.lit(int(x)) for r in counts for x in (r.dim, math.ceil(r["count"] / SHARD_ROWS))])
    dealt = kept.withColumn("shards", shards[F.col("dim")]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))

    def packed(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy().astype(np.int64)
        values = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"dim": pa.array([table["dim"][0].as_py()], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "ids": [ids.tobytes()], "data": [values.astype(np.float64).tobytes()]})

    schema = "dim int, shard int, ids binary, data binary"
    base = dealt.select("dim", "shard", "vec_id", "embedding").groupBy("dim", "shard").applyInArrow(packed, schema)
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(ok).withColumn("dim", F.size("embedding"))
    n_asked = {r.dim: r["count"] for r in asked.groupBy("dim").count().collect()}
    blocks = F.create_map(*[F.lit(int(x)) for r in counts for x in (r.dim, math.ceil(n_asked.get(r.dim, 1) / QUERY_ROWS))])
    asked = asked.withColumn("blocks", blocks[F.col("dim")]).where("blocks is not null")
    asked = asked.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).select("dim", "shard", "vec_id", "embedding").groupBy("dim", "shard").applyInArrow(packed, schema)
    asked = asked.withColumnRenamed("shard", "block").select("dim", F.explode(F.sequence(F.lit(0), shards[F.col("dim")] - 1)).alias("shard"), "block", "ids", "data")

    bound = chi_square_quantile(chance, dims)

    def search(batches):
        at, tree = None, None
        for batch in batches:
            for dim, shard, block, ids, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                ids, vectors = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(data.as_buffer()).reshape(-1, dim.as_py())
                if block.as_py() < 0:
                    at, tree = (dim.as_py(), shard.as_py()), ProjectedTree(ids, vectors, dims)
                elif at == (dim.as_py(), shard.as_py()):
                    rows = [(q, i, s) for q, v in zip(ids.tolist(), vectors, strict=True) for s, i in tree.nearest(v, q, k, bound)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    # a shard's vectors are sent once and come before the blocks of queries that are searched in them
    both = base.select("dim", "shard", F.lit(-1).alias("block"), "ids", "data").unionByName(asked)
    found = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "block").mapInArrow(search, "query_id long, vec_id long, score double")
    found = materialize(found, "neighbours")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int = 5) -> dict[int, list[tuple[int, float]]]:
    v = vectors.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", v, v))
    out = {}
    for q in queries.tolist():
        x = v[ids == q][0]
        s = np.einsum("ij,j->i", v, x) / (norms * math.sqrt(float(np.einsum("i,i->", x, x))))
        out[q] = [(int(ids[i]), float(s[i])) for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
    return out

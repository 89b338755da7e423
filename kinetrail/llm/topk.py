"""Exact top-k by inner product with M-trees, best first.

Vectors are integers.  With a last coordinate that brings every vector to the
norm of the longest, ``|q - x|^2 = |q|^2 + M^2 - 2 q.x``: the largest products
are the nearest points, and a metric index answers them exactly.

The first level of the tree is distributed: pivots (a bounded sample) route every
vector to its nearest one, which keeps a covering radius; a pivot with many
vectors is cut into pages of ``page`` vectors, each a shard.  A task builds the
M-tree of its shard (inner nodes, leaves, entries; each with its distance to the
parent and its covering radius) and streams queries through it.  Queries first
visit the shard of their own pivot, which gives a k-th score to beat, and then
only those pivots whose ball may hold a better one.  In a tree a query opens
leaves in the order of their bounds, in growing batches; leaves and entries are
skipped by the triangle inequality on stored distances before any distance to
them is computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.llm.neighbours import matrix, usable
from kinetrail.plans.stage import written

LEAF = 64
_EXACT = float(1 << 52)  # sums of products below this are exact in doubles
MAX_PIVOTS = 1024


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, in doubles."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(float(factor)) * x).cast("double"))


def products(q: np.ndarray, x: np.ndarray, top: float) -> np.ndarray:
    """Integer inner products; beyond the exact range of doubles, by Python integers within long."""
    if top < _EXACT:
        return q @ x.T
    big = np.frompyfunc(int, 1, 1)(q) @ np.frompyfunc(int, 1, 1)(x).T
    return np.clip(big, -(1 << 63), (1 << 63) - 1)


class Shard:
    """M-tree over some vectors: inner nodes over leaves over entries."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, top: float):
        self.top = top  # M^2
        lift = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))
        point = np.column_stack([x, lift])
        order = np.argsort(ids, kind="stable")
        ids, rows, x, point = ids[order], rows[order], x[order], point[order]
        leaf_of, leaf_at = self._nearest(point, -(-len(ids) // (LEAF // 2)))
        by = np.argsort(leaf_of, kind="stable")
        # leaves that are too full (equal vectors) become several pages round one pivot
        page = np.concatenate([np.arange(n) // LEAF for n in np.bincount(leaf_of, minlength=len(leaf_at)) if n]) if len(by) else by
        cut = np.flatnonzero(np.r_[True, (leaf_of[by][1:] != leaf_of[by][:-1]) | (page[1:] != page[:-1])])
        self.begin, self.end = cut, np.r_[cut[1:], len(by)]
        self.ids, self.rows, self.x = ids[by], rows[by], x[by]
        center = point[leaf_at[leaf_of[by][cut]]]
        self.to_leaf = self._distance(point[by], np.repeat(center, self.end - self.begin, axis=0))
        self.leaf_x, self.leaf_lift = center[:, :-1], center[:, -1]
        self.leaf_radius = np.maximum.reduceat(self.to_leaf, cut)
        node_of, node_at = self._nearest(center, max(1, int(round(len(center) ** 0.5))))
        self.node_of, self.node_x = node_of, center[node_at][:, :-1]
        self.to_node = self._distance(center, center[node_at[node_of]])
        self.node_radius = np.zeros(len(node_at))
        np.maximum.at(self.node_radius, node_of, self.to_node + self.leaf_radius)

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(((a - b) ** 2).sum(axis=-1))

    @staticmethod
    def _nearest(point: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Pivots at even steps, and the nearest pivot of each point."""
        at = np.unique(np.linspace(0, len(point) - 1, min(count, len(point))).astype(int))
        norm = (point[at] ** 2).sum(axis=1)
        return (norm[None, :] - 2 * point @ point[at].T).argmin(axis=1), at

    def search(self, query_rows: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query row, vec_id, score) of the k best of each query that are not below ``floor``."""
        n = len(q)
        norm = (q * q).sum(axis=1)
        slack = 1e-9 * (norm + self.top) + 1e-6

        def best_score(distance: np.ndarray, rows=slice(None)) -> np.ndarray:
            """No point so far away or farther has a larger product; with room for rounding."""
            most = (norm + self.top) / 2 + slack
            far = np.maximum(distance, 0)
            return (most[rows] if far.ndim == 1 else most[rows][:, None]) - far * far / 2

        def distances(x: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum((norm + self.top)[:, None] - 2 * (q @ x.T), 0))

        to_node = distances(self.node_x)
        # stored distance leaf - node bounds the distance query - leaf without computing it
        rough = np.abs(to_node[:, self.node_of] - self.to_node[None, :]) - self.leaf_radius[None, :]
        bound = best_score(np.maximum(rough, to_node[:, self.node_of] - self.node_radius[self.node_of][None, :]))
        leaf_distance = np.full(bound.shape, np.nan)
        top_score = np.full((n, k), -np.inf, float if self.top < _EXACT else object)
        top_id = np.full((n, k), np.iinfo(np.int64).max)
        need = floor.astype(float).copy()
        opened = np.zeros(bound.shape, bool)
        batch = 1
        while True:
            open_ = ~opened & (bound >= need[:, None])
            active = np.flatnonzero(open_.any(axis=1))
            if not len(active):
                break
            ranked = np.where(open_[active], bound[active], -np.inf)
            m = min(batch, ranked.shape[1])
            best = np.argpartition(-ranked, m - 1, axis=1)[:, :m]
            chosen = np.zeros(ranked.shape, bool)
            np.put_along_axis(chosen, best, True, axis=1)
            chosen &= np.isfinite(ranked)
            for leaf in np.flatnonzero(chosen.any(axis=0)):
                rows = active[chosen[:, leaf]]
                opened[rows, leaf] = True
                d = np.sqrt(np.maximum(norm[rows] + self.top - 2 * (q[rows] @ self.leaf_x[leaf]), 0))
                leaf_distance[rows, leaf] = d
                rows = rows[best_score(d - self.leaf_radius[leaf], rows) >= need[rows]]
                if not len(rows):
                    continue
                a, b = self.begin[leaf], self.end[leaf]
                # entries that no query can need are skipped by their stored distance to the leaf's pivot
                nearest = np.abs(leaf_distance[rows, leaf][:, None] - self.to_leaf[None, a:b])
                useful = (best_score(nearest, rows) >= need[rows][:, None]).any(axis=0)
                if not useful.any():
                    continue
                ids, own = self.ids[a:b][useful], self.rows[a:b][useful]
                score = products(q[rows], self.x[a:b][useful], self.top)
                score = np.where(own[None, :] == query_rows[rows][:, None], -np.inf, score)
                both = np.concatenate([top_score[rows], score], axis=1)
                both_id = np.concatenate([top_id[rows], np.broadcast_to(ids, score.shape)], axis=1)
                by = np.stack([sorted(range(len(s)), key=lambda c, s=s, i=i: (-s[c], i[c]))[:k] for s, i in zip(both, both_id)]) if (
                    both.dtype == object) else np.lexsort((both_id, -both), axis=1)[:, :k]
                top_score[rows] = np.take_along_axis(both, by, axis=1)
                top_id[rows] = np.take_along_axis(both_id, by, axis=1)
                need[rows] = np.maximum(need[rows], top_score[rows, k - 1].astype(float))
            batch *= 2
        row, rank = np.nonzero((top_score != -np.inf) & (top_score >= floor[:, None]))
        return row, top_id[row, rank], top_score[row, rank]


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, page: int = 8192, per_pivot: int = 4096, seed: int = 23,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by
    ``every``, the ``k`` other rows with the largest products, ties to the smaller id.

    Vectors that are null, empty or hold null or non-finite components, and rows
    with a null id, take no part; vectors of different lengths are never compared;
    rows that share an id, equal or not, are queries and candidates of their own,
    each other's too; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col)).alias("v")).withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")  # the written number names a row
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = {r.dim: (r.n, r.top) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("top")).collect()}
    # pivots: a bounded sample by hash, MAX_PIVOTS at most for a length
    pivots: dict[int, np.ndarray] = {}
    for dim, (n, top) in sizes.items():
        count = min(MAX_PIVOTS, -(-n // per_pivot))
        own = rows.filter(F.col("dim") == dim).select("v", F.xxhash64("vec_id", F.lit(seed)).alias("h"), "vec_id")
        pivots[dim] = np.array([r.v for r in own.orderBy("h", "vec_id").limit(count).collect()]).reshape(count, dim)

    def lifted(x: np.ndarray, top: float) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            dims = t["dim"].to_numpy()
            for dim in np.unique(dims):
                part = t.filter(pa.array(dims == dim)).combine_chunks()
                top = sizes[int(dim)][1]
                point, center = lifted(matrix(part["v"], int(dim)), top), lifted(pivots[int(dim)], top)
                near = ((center ** 2).sum(axis=1)[None, :] - 2 * point @ center.T).argmin(axis=1)
                far = np.sqrt(((point - center[near]) ** 2).sum(axis=1))
                part = part.append_column("pivot", pa.array(near.astype(np.int32))).append_column("far", pa.array(far))
                yield from part.to_batches()

    routed = written(rows.select("vec_id", "v", "dim", "row").mapInArrow(
        route, "vec_id long, v array<double>, dim int, row long, pivot int, far double"), "routed")
    pivot_rows = routed.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    balls = {(r.dim, r.pivot): r.radius for r in pivot_rows.collect()}  # MAX_PIVOTS rows at most for a length
    parts = pivot_rows.select("dim", "pivot", F.ceil(F.col("n") / page).cast("int").alias("parts"))
    shards = routed.join(F.broadcast(parts), ["dim", "pivot"]).select(
        "dim", "pivot", F.pmod(F.xxhash64("row", F.lit(seed + 1)), "parts").cast("int").alias("part"),
        F.lit(0).alias("role"), "vec_id", "v", F.lit(None).cast("double").alias("floor"), "row")
    queries = routed.filter(F.col("vec_id") % every == 0).select("dim", "pivot", "vec_id", "v", "row")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard, then its queries, which stream through the built tree."""
        key, held, shard = None, [], None
        for batch in batches:
            k4 = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in k4], axis=0)) + 1 if batch.num_rows else []
            cuts = [0, *map(int, change), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                here, role = tuple(int(c[a]) for c in k4[:3]), int(k4[3][a])
                dim = here[0]
                if here != key:
                    key, held, shard = here, [], None
                part = batch.slice(a, b - a)
                ids, x, own = part.column(4).to_numpy(), matrix(part.column(5), dim), part.column(7).to_numpy()
                if role == 0:
                    held.append((ids, own, x))
                    continue
                if shard is None and held:
                    shard = Shard(*(np.concatenate([h[k] for h in held]) for k in range(3)), sizes[dim][1])
                    held = []
                if shard is not None:
                    floor = np.nan_to_num(part.column(6).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                    row, found, score = shard.search(own, x, floor, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row]), pa.array(own[row]), pa.array(found, pa.int64()), pa.array([int(s) for s in score], pa.int64())],
                        names=["query_id", "query_row", "vec_id", "score"])

    def visits(asked: DataFrame) -> DataFrame:
        """Queries sent to every page of the pivots they name."""
        sent = asked.join(F.broadcast(parts), ["dim", "pivot"]).select(
            "dim", "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "vec_id", "v", "floor", "row")
        order = ["dim", "pivot", "part", "role"]
        return shards.unionAll(sent).repartition("dim", "pivot", "part").sortWithinPartitions(*order).mapInArrow(
            search, "query_id long, query_row long, vec_id long, score long")

    ranked = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)

    home = written(visits(queries.withColumn("floor", F.lit(None).cast("double"))), "home")
    floors = best(home).filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("floor"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once per other pivot whose ball may hold a product not below its floor."""
        for batch in batches:
            for dim, pivot, one, v, floor, own in zip(*(batch.column(c).to_pylist() for c in range(6))):
                top = sizes[dim][1]
                x = np.array(v)
                norm = x @ x
                d = np.sqrt(np.maximum(norm + top - 2 * (pivots[dim] @ x), 0))
                radius = np.array([balls.get((dim, p), -np.inf) for p in range(len(d))])
                near = np.maximum(d - radius, 0)
                ub = (norm + top - near * near) / 2 + 1e-9 * (norm + top) + 1e-6
                go = np.flatnonzero((ub >= (-np.inf if floor is None else floor)) & np.isfinite(radius) & (np.arange(len(d)) != pivot))
                if len(go):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(go), dim, np.int32)), pa.array(go.astype(np.int32)), pa.array(np.full(len(go), one)),
                        pa.array([v] * len(go), pa.list_(pa.float64())), pa.array([floor] * len(go), pa.float64()),
                        pa.array(np.full(len(go), own))], names=["dim", "pivot", "vec_id", "v", "floor", "row"])

    others = queries.join(floors, "row", "left").select("dim", "pivot", "vec_id", "v", "floor", "row").mapInArrow(
        spread, "dim int, pivot int, vec_id long, v array<double>, floor double, row long")
    return best(home.unionAll(visits(others))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

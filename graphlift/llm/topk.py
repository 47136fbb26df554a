"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Rows are dealt to shards of bounded size; each shard's tree is built once and written. Queries go through
in blocks of bounded size. For a block, a few shards are searched first; the k-th best scores found there
are lower bounds that all other shards start from, and a task passes on what it has found from shard to
shard. A node is a ball around a centre; no vector in it can score above ``q . centre + |q| * radius``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require_columns, stored

SHARD_ROWS, LEAF_ROWS = 4096, 64
#: Queries searched for at a time, and shards that give their first bounds.
BLOCK, FIRST_SHARDS = 2048, 8


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component; null for a null vector or one with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A ball tree over rows of x: their order, centres, radii, and nodes (first row, last row, left, right; -1 for leaves).

    A node is halved at the median along the line between two far points; equal points stay wherever the
    halves put them, so any number of copies gives a balanced tree.
    """
    order = np.arange(len(x))
    nodes, centres, radii = [], [], []

    def add(a: int, b: int) -> int:
        rows = x[order[a:b]]
        centre = rows.mean(axis=0)
        far = ((rows - centre) ** 2).sum(axis=1)
        me = len(nodes)
        nodes.append([a, b, -1, -1])
        centres.append(centre)
        radii.append(np.sqrt(far.max()))
        if b - a > LEAF_ROWS:
            p = rows[far.argmax()]
            q = rows[((rows - p) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows @ (q - p), half)]
            nodes[me][2:] = [add(a, a + half), add(a + half, b)]
        return me

    if len(x):
        add(0, len(x))
    return order, np.array(centres).reshape(len(nodes), -1), np.array(radii), np.array(nodes, np.int64).reshape(-1, 4)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where these are exact, else in whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if most < 2**63 else (a.astype(object) @ b.astype(object).T)


def search(q: np.ndarray, own: int, bounds: np.ndarray, nodes: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, best: list) -> None:
    """Improves ``best``, a heap of at most k (score, -id), by the rows of one shard; bounds: of its nodes for this query."""
    waiting = [(-bounds[0], 0)]
    while waiting:
        bound, node = heapq.heappop(waiting)
        if len(best) == k and -bound < best[0][0]:
            return
        a, b, left, right = nodes[node]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(waiting, (-bounds[child], child))
            continue
        scores = dot(vectors[a:b], q[None])[:, 0]
        for i in np.flatnonzero(scores >= best[0][0]) if len(best) == k else range(b - a):
            if ids[a + i] != own:
                found = (int(scores[i]), -int(ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)


class Index:
    """Shards of vectors with their trees, as a written table."""

    def __init__(self, rows: DataFrame, id_col: str, vector_col: str, scale: float):
        require_columns(rows, id_col, vector_col)
        valid = rows.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v")).where("id is not null and size(v) > 0")
        self.vectors = stored(valid.select("id", "v", F.size("v").alias("dim"), F.xxhash64(F.monotonically_increasing_id()).alias("deal")), "vectors")
        self.shards = max(1, -(-self.vectors.count() // SHARD_ROWS))

        def grow(group: pa.Table) -> pa.Table:
            dim = group.column("dim")[0].as_py()
            v = np.array(group.column("v").combine_chunks().flatten().to_numpy()).reshape(-1, dim)
            order, centres, radii, nodes = build(v.astype(np.float64))
            blob = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
            return pa.table(
                {"dim": pa.array([dim], pa.int32()), "shard": group.column("shard").slice(0, 1), "ids": blob(group.column("id").to_numpy()[order]),
                 "vectors": blob(v[order]), "centres": blob(centres), "radii": blob(radii), "nodes": blob(nodes)}
            )

        dealt = self.vectors.withColumn("shard", F.pmod("deal", F.lit(self.shards)).cast("int"))
        self.trees = stored(
            dealt.groupBy("dim", "shard").applyInArrow(grow, "dim int, shard int, ids binary, vectors binary, centres binary, radii binary, nodes binary"),
            "ball-trees",
        )

    def top(self, trees: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], floors: dict[int, int], k: int) -> DataFrame:
        """(query_id, vec_id, score): what these shards have for the queries (by dimension: ids and rows)."""
        shared = trees.sparkSession.sparkContext.broadcast((queries, floors))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, floors = shared.value
            best: dict[int, list] = {}
            for b in batches:
                for t in b.to_pylist():
                    ids, rows = queries.get(t["dim"], (None, None))
                    if ids is None:
                        continue
                    d = t["dim"]
                    vec_ids, vectors = np.frombuffer(t["ids"], np.int64), np.frombuffer(t["vectors"], np.int64).reshape(-1, d)
                    nodes, radii = np.frombuffer(t["nodes"], np.int64).reshape(-1, 4), np.frombuffer(t["radii"])
                    q = rows.astype(np.float64)
                    bounds = q @ np.frombuffer(t["centres"]).reshape(-1, d).T + np.sqrt((q * q).sum(axis=1))[:, None] * radii
                    bounds += np.abs(bounds) * 1e-9 + 1e-3
                    for i, own in enumerate(ids.tolist()):
                        # a floor stands for k rows elsewhere: nothing below it can be among the best
                        heap = best.setdefault(own, [(floors[own], -(2**63))] * k if own in floors else [])
                        search(rows[i], own, bounds[i], nodes, vectors, vec_ids, k, heap)
            found = [(own, -n, s) for own, heap in best.items() for s, n in heap if n != -(2**63)]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

        return trees.mapInArrow(find, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, is_query: Column, *, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows for every query: query_id, rank (from 1), vec_id, score.

    Components become ``floor(scale * x)``; the score is the integer inner product. Queries are the rows for
    which ``is_query`` (a condition on the column ``id``) holds; candidates are all rows with another id
    than the query's, of the same number of components. Higher scores first, ties to the smaller id; all
    candidates if there are fewer than k. Rows with a null id, a null or empty vector, or one with a null or
    non-finite component take no part. Rows that repeat an id are candidates each; as a query, an id counts
    once, by its least vector. An empty table gives an empty result; other columns are not looked at.
    """
    spark = rows.sparkSession
    index = Index(rows, id_col, vector_col, scale)
    asked = index.vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "queries")
    parts = None
    for n in range(blocks):
        queries: dict[int, tuple[list, list]] = {}
        for r in asked.where(F.col("block") == n).collect():
            ids, vs = queries.setdefault(len(r.v), ([], []))
            ids.append(r.id)
            vs.append(r.v)
        ready = {d: (np.array(ids, np.int64), np.array(vs, np.int64)) for d, (ids, vs) in queries.items()}
        best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        first = best(index.top(index.trees.where(F.col("shard") < FIRST_SHARDS), ready, {}, k))
        floors = {r.query_id: r.score for r in first.where(F.col("rank") == k).collect()}
        part = best(index.top(index.trees, ready, floors, k)).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            part = stored(part, "top-k-block")
        parts = part if parts is None else parts.unionByName(part)
    return parts

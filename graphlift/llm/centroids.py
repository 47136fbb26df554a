"""Exact k-means on integer vectors whose dimension blocks are dictionary-encoded.

Vectors are encoded once, in shards of a few thousand: each block of neighbouring dimensions becomes a
dictionary of its distinct subvectors and one code per vector, without loss. A round computes the
distance of every distinct subvector to every centroid once and adds up the partial distances of a
vector by its codes. All sums are of integers, so the order of rows and tasks changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.source import local_frame
from .common import require_columns, stored

#: Vectors that share their dictionaries.
SHARD = 16_384
#: Rows that are added up at once, so that their distances stay in the processor's cache.
_ROWS = 2_048
#: Largest component after scaling: squared distances of any two vectors then fit a long for up to 128 dimensions.
LARGEST = 2**27
#: Shards are written in row groups of this many bytes, since a reader takes up a whole one.
_ROW_GROUP = 16 * 2**20


@dataclass
class Block:
    """The distinct subvectors of some neighbouring dimensions, and the one of each vector."""

    words: np.ndarray
    codes: np.ndarray

    @property
    def cost(self) -> int:
        """Work of a round, a centroid: the distances of the dictionary, and one addition a vector."""
        return self.words.size + len(self.codes)


def encode_blocks(vectors: np.ndarray) -> list[Block]:
    """Blocks of ``vectors`` (rows, dimensions): single dimensions, joined with their neighbours where that saves work."""
    blocks = []
    for column in vectors.T:
        words, codes = np.unique(column, return_inverse=True)
        blocks.append(Block(words.reshape(-1, 1), codes))
    joined = True
    while joined and len(blocks) > 1:
        joined, old, blocks = False, blocks, []
        while old:
            a = old.pop(0)
            both = _joined(a, old[0]) if old else None
            if both and both.cost < a.cost + old[0].cost:
                old.pop(0)
                a, joined = both, True
            blocks.append(a)
    return blocks


def _joined(a: Block, b: Block) -> Block:
    pairs, codes = np.unique(a.codes.astype(np.int64) * len(b.words) + b.codes, return_inverse=True)
    return Block(np.hstack([a.words[pairs // len(b.words)], b.words[pairs % len(b.words)]]), codes)


def nearest(blocks: Sequence[Block], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance, per vector; of equal ones the smaller number."""
    n, k = len(blocks[0].codes), len(centroids)
    reach = max(int(np.abs(b.words).max()) for b in blocks) + int(np.abs(centroids).max())
    kind = np.int32 if centroids.shape[1] * reach**2 < 2**31 else np.int64
    tables, at = [], 0
    for b in blocks:
        partial = np.zeros((len(b.words), k), kind)
        for j in range(b.words.shape[1]):
            partial += ((b.words[:, j, None] - centroids[None, :, at + j]) ** 2).astype(kind)
        tables.append(partial)
        at += b.words.shape[1]
    cluster, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(0, n, _ROWS):
        total = tables[0][blocks[0].codes[i : i + _ROWS]]
        for b, t in zip(blocks[1:], tables[1:]):
            total += t[b.codes[i : i + _ROWS]]
        cluster[i : i + _ROWS] = best = total.argmin(1)
        distance[i : i + _ROWS] = total[np.arange(len(best)), best]
    return cluster, distance


def cluster_sums(blocks: Sequence[Block], cluster: np.ndarray, k: int) -> np.ndarray:
    """Sum of the vectors of each cluster: (k, dimensions)."""
    sums = []
    for b in blocks:
        # How often each subvector occurs in each cluster; the vectors themselves are not rebuilt.
        cells, n = np.unique(cluster * len(b.words) + b.codes, return_counts=True)
        part = np.zeros((k, b.words.shape[1]), np.int64)
        np.add.at(part, cells // len(b.words), b.words[cells % len(b.words)] * n[:, None])
        sums.append(part)
    return np.hstack(sums)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors with ``dims`` components, none null or non-finite, as floor(scale * x)."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    # A null component makes the test null, which drops the vector as well.
    rows = rows.where(F.size("x") == dims).where(F.forall("x", lambda x: F.coalesce(F.abs(x * scale) < LARGEST, F.lit(False))))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _shards(rows: DataFrame, dims: int) -> DataFrame:
    kind = rows.schema["vec_id"].dataType.simpleString()

    def pack(ids: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        blocks = encode_blocks(vectors)
        codes = np.concatenate([b.codes.astype(np.uint16) for b in blocks])
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([[b.words.shape[1] for b in blocks]], pa.list_(pa.int32())),
                pa.array([[len(b.words) for b in blocks]], pa.list_(pa.int32())),
                pa.array([np.concatenate([b.words.ravel() for b in blocks]).astype(np.int64).tobytes()], pa.binary()),
                pa.array([codes.tobytes()], pa.binary()),
            ],
            ["ids", "widths", "sizes", "words", "codes"],
        )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            at = 0
            while at < b.num_rows:
                part = b.slice(at, SHARD - n)
                held.append((part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)))
                n, at = n + part.num_rows, at + part.num_rows
                if n == SHARD:
                    yield pack(pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held]))
                    held, n = [], 0
        if n:
            yield pack(pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held]))

    return rows.mapInArrow(encode, f"ids array<{kind}>, widths array<int>, sizes array<int>, words binary, codes binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[Block]]]:
    for b in batches:
        for i in range(b.num_rows):
            ids = b.column("ids")[i].values
            words = np.frombuffer(b.column("words")[i].as_py(), np.int64)
            codes = np.frombuffer(b.column("codes")[i].as_py(), np.uint16).reshape(-1, len(ids))
            blocks, at = [], 0
            for w, m, c in zip(b.column("widths")[i].as_py(), b.column("sizes")[i].as_py(), codes):
                blocks.append(Block(words[at : at + w * m].reshape(m, w), c))
                at += w * m
            yield ids, blocks


def _moved(shards: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the exact mean of each one's vectors; empty ones stay."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for _, blocks in _unpacked(batches):
            cluster, _ = nearest(blocks, centroids)
            total[:, :dims] += cluster_sums(blocks, cluster, k)
            total[:, dims] += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(total[:, dims])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = shards.mapInArrow(sums, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("j", "x"))
    new = [list(map(int, c)) for c in centroids]
    total = [[0] * (dims + 1) for _ in range(k)]
    for r in parts.groupBy("cluster", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # k * (dims + 1) rows
        total[r.cluster][r.j] = int(r.x)
    for c, (*s, n) in enumerate(total):
        if n:
            new[c] = [x // n for x in s]
    return np.array(new, np.int64)


def cluster(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2"
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (its final components).

    A vector is kept if it has exactly ``dims`` components, none null, NaN or infinite; a component x
    becomes floor(scale * x). Components of ``LARGEST`` or more after scaling have distances beyond a
    long: such vectors take no part either. The k kept vectors with the smallest hex sha256 of
    ``seed:vec_id`` begin as centroids, in that order; equal ids go by their components, null ids come
    last. With fewer than k vectors there are fewer centroids. Every row is a vector, repeated ones
    too; an empty table gives an empty result; other columns are not looked at.

    The driver holds the k centroids and, each round, their sums; the rounds read the shards, which
    are written once. A sum beyond a long (cluster_inertia, inertia) is null.
    """
    require_columns(vectors, id_col, vector_col)
    rows = integer_vectors(vectors, id_col, vector_col, dims, scale)
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = rows.select("v", first.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    shards = stored(_shards(rows, dims), "shards", **{"parquet.block.size": str(_ROW_GROUP)})
    centroids = np.array([r.v for r in start], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(start) else 0):
        centroids = _moved(shards, centroids)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, blocks in _unpacked(batches):
            c, d = nearest(blocks, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(c, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = stored(shards.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "assigned")
    sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda x: x if x < 2**63 else None
    ends = local_frame(
        vectors.sparkSession,
        [("cluster", pa.int32()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid", pa.list_(pa.int64()))],
        [(c, fits(d), fits(sum(sums.values())), centroids[c].tolist()) for c, d in sorted(sums.items())],
    )
    return assigned.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def cluster_digest(clusters: DataFrame) -> DataFrame:
    """The columns of ``cluster`` with each centroid as the hex sha256 of its components, joined by commas."""
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return clusters.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))

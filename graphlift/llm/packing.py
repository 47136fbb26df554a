"""Mixture-controlled packing of tokenised documents into sequences of one size.

Every source is a queue of tokens. A deficit round-robin fills each sequence to the target token
proportions: a queue earns its share of every sequence, is served whole tokens, and carries what it is
owed, or got too much, to the next one. Over a *round* of ``ROUND`` sequences the shares are whole
numbers, so at its end nothing is owed; every round of a *phase* therefore looks alike, and a task finds
the sequences of any stretch of a queue by arithmetic, without having seen what other tasks pack. A
phase ends when a queue can't fill its share of another round; the shares are then set anew for what is
left, with shorter rounds near the end. Only the last sequence can be short.

Passes over the data: one that tokenises and writes ids with running counts per task and source; one
small table of those counts, one row per task and source, that gives each its place in its queue; one
that cuts the written ids.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import TokenIds, merged_by_concatenation
from .common import kept, require_columns, stored

ROUND = 1024
#: Up to so many sources are numbered in the query itself, more by a join; the numbers are the same.
MAX_QUEUES = 256
#: Rounds that a task keeps worked out; each has at most an entry per token.
KEPT_ROUNDS = 16


@dataclass(frozen=True)
class Phase:
    size: int  # tokens of a sequence
    length: int  # sequences of a round
    rounds: int
    quota: tuple[int, ...]  # tokens of each queue in a round
    first: int  # number of its first sequence
    at: tuple[int, ...]  # position in each queue where it begins


def apportion(total: int, weights: Sequence[int]) -> list[int]:
    """Whole numbers in proportion to the weights that add up to total: largest remainders first."""
    whole = sum(weights)
    parts = [divmod(total * w, whole) for w in weights]
    out = [p for p, _ in parts]
    for i in sorted(range(len(out)), key=lambda i: (-parts[i][1], i))[: total - sum(out)]:
        out[i] += 1
    return out


def phases(totals: Sequence[int], size: int, weights: Sequence[float] | None = None) -> list[Phase]:
    """The schedule for queues of these lengths. weights: target proportions; by default those of the queues.

    A queue whose target is 0 is served when those with a target have run dry.
    """
    left, at, first, length, out = list(totals), [0] * len(totals), 0, ROUND, []
    target = None if weights is None else [round(w * 1_000_000) for w in weights]

    def add(length: int, rounds: int, quota: list[int], size: int) -> None:
        nonlocal left, at, first
        out.append(Phase(size, length, rounds, tuple(quota), first, tuple(at)))
        first += rounds * length
        at = [a + rounds * q for a, q in zip(at, quota, strict=True)]
        left = [n - rounds * q for n, q in zip(left, quota, strict=True)]

    while sum(left) >= size:
        share = left if target is None else [t if n else 0 for t, n in zip(target, left, strict=True)]
        quota = apportion(length * size, share if sum(share) else left)
        rounds = min(n // q for n, q in zip(left, quota, strict=True) if q)
        if rounds:
            add(length, rounds, quota, size)
        elif length > 1:
            length //= 2
        else:
            quota = [min(q, n) for q, n in zip(quota, left, strict=True)]
            for i in sorted(range(len(left)), key=lambda i: (quota[i] - left[i], i)):
                quota[i] += min(left[i] - quota[i], size - sum(quota))
            add(1, 1, quota, size)
    if sum(left):
        add(1, 1, list(left), sum(left))
    return out


def dealt(quota: Sequence[int], length: int, size: int) -> Iterator[np.ndarray]:
    """Tokens that each queue gets in each sequence of a round, by deficit round-robin."""
    q = np.array(quota, np.int64)
    done = np.zeros(len(q), np.int64)
    for i in range(length - 1):
        owed = q * (i + 1) - done * length
        give = np.minimum(np.maximum(owed // length, 0), q - done)
        short = size - int(give.sum())
        while short:
            step = 1 if short > 0 else -1
            able = np.flatnonzero(give < q - done if step > 0 else give > 0)
            order = able[np.argsort(-step * (owed - give * length)[able], kind="stable")][: abs(short)]
            give[order] += step
            short -= step * len(order)
        yield give
        done = done + give
    yield q - done


def round_plan(quota: tuple[int, ...], length: int, size: int) -> np.ndarray:
    """Tokens of each queue served before each sequence of a round: length + 1 rows."""
    return np.cumsum([np.zeros(len(quota), np.int64), *dealt(quota, length, size)], axis=0)


@lru_cache(maxsize=KEPT_ROUNDS)
def round_slots(quota: tuple[int, ...], length: int, size: int) -> tuple[np.ndarray, ...]:
    """The queues' parts of the sequences of a round, by queue: where each queue's parts begin in the arrays, and of
    each part its sequence, the tokens of the queue before it and its offset in the sequence."""
    done, parts = np.zeros(len(quota), np.int64), []
    for i, give in enumerate(dealt(quota, length, size)):
        queue = np.flatnonzero(give)
        n = give[queue]
        parts.append(np.stack([queue, np.full(len(queue), i), done[queue], np.cumsum(n) - n]).astype(np.int32))
        done += give
    queue, inside, begins, offset = np.concatenate(parts, axis=1)
    order = np.argsort(queue, kind="stable")
    return np.searchsorted(queue[order], np.arange(len(quota) + 1)), inside[order], begins[order], offset[order]


class Cutter:
    """Finds the pieces of a stretch of a queue."""

    def __init__(self, plan: Sequence[Phase]):
        self.plan = plan
        self.at = np.array([p.at for p in plan], np.int64).reshape(len(plan), -1)
        self.known: dict[int, tuple[np.ndarray, ...]] = {}

    def slots(self, phase: int, queue: int) -> tuple[np.ndarray, ...]:
        """Of the sequences of a round that the queue is in: their numbers, where each begins in the queue's
        share of the round (and its end), and the queue's offset there."""
        p = self.plan[phase]
        if phase not in self.known:
            if len(self.known) == KEPT_ROUNDS:
                self.known.clear()
            self.known[phase] = round_slots(p.quota, p.length, p.size)
        first, inside, begins, offset = self.known[phase]
        own = slice(first[queue], first[queue + 1])
        return inside[own], np.append(begins[own], p.quota[queue]), offset[own]

    def __call__(self, queue: int, start: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, sequence numbers and offsets of the pieces of [start, start + n) of the queue, in order."""
        parts, at, end = [], start, start + n
        while at < end:
            k = int(np.searchsorted(self.at[:, queue], at, "right")) - 1
            p, (inside, begins, offset) = self.plan[k], self.slots(k, queue)
            quota, m, origin = p.quota[queue], len(inside), p.at[queue]
            a, b = at - origin, min(end - origin, p.rounds * quota)
            edge = lambda x: x // quota * m + int(np.searchsorted(begins, x % quota, "right")) - 1  # noqa: B023, E731
            r, i = np.divmod(np.arange(edge(a), edge(b - 1) + 1), m)
            low, high = r * quota + begins[i], r * quota + begins[i + 1]
            s = np.maximum(low, a)
            parts.append((np.minimum(high, b) - s, p.first + r * p.length + inside[i], offset[i] + s - low))
            at = origin + b
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def encoder(path: str, by_ranks: bool) -> TokenIds:
    return TokenIds(path, by_ranks=by_ranks)


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Written rows: chunk (the task), doc_id, source, before (tokens of the source in the chunk so far), n, ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    by_ranks = merged_by_concatenation(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, chunk = kept(encoder, vocabulary, by_ranks), TaskContext.get().partitionId()
        end, so_far = np.array([end_id], np.uint16).tobytes(), {}
        for b in batches:
            ids = [(ids_of(t) if t else b"") + end for t in b.column("text").to_pylist()]
            n, before = [len(x) // 2 for x in ids], []
            for s, k in zip(b.column("source").to_pylist(), n, strict=True):
                before.append(so_far.get(s, 0))
                so_far[s] = before[-1] + k
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(n), pa.int32()), b.column("doc_id"), b.column("source"), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["chunk", "doc_id", "source", "before", "n", "ids"],
            )

    return stored(rows.mapInArrow(encode, f"chunk int, doc_id {kind}, source string, before long, n long, ids binary"), "token-ids")


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    size: int = 1024,
    end_id: int = 0,
    weights: Mapping[str | None, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, doc_tokens, sequence_id, offset, source, ids.

    A document is its ids and then ``end_id``; a null text is empty, so every row gives one token at least.
    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers. ``weights`` maps sources to target
    proportions (others: 0); by default the proportions of the tokens themselves, so that all sources last
    to the end. A null source is a source of its own. Ids may be null or repeated: each row is packed by
    itself. An empty table gives no pieces. Other columns are not looked at.
    """
    require_columns(docs, id_col, text_col, source_col)
    rows = tokenised(docs, vocabulary, end_id, id_col, text_col, source_col)
    counts = rows.groupBy("chunk", "source").agg(F.sum("n").alias("n"))
    sources = counts.groupBy("source").agg(F.sum("n").alias("n"))
    totals = sorted(sources.collect(), key=lambda r: (r.source is not None, r.source or ""))
    names = [r.source for r in totals]
    plan = phases([r.n for r in totals], size, None if weights is None else [weights.get(s, 0) for s in names])
    if len(names) > MAX_QUEUES:
        numbers = docs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(names)], "name string, queue_no int")
        numbered = counts.join(numbers, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    else:
        number = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(i)) for i, s in enumerate(names)], F.lit(0)) if names else F.lit(0)
        numbered = counts.withColumn("queue_no", number)
    earlier = Window.partitionBy("queue_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    places = stored(numbered.select("chunk", "source", "queue_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "queue-places")
    p = places.alias("p")
    placed = rows.join(p, (rows["chunk"] == F.col("p.chunk")) & rows["source"].eqNullSafe(F.col("p.source"))).select(
        "doc_id", rows["source"], "n", "ids", F.col("p.queue_no").alias("queue"), (F.col("p.base") + F.col("before")).alias("at")
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(plan)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                n = b.column("n").to_numpy()
                pieces = [cutter(*x) for x in zip(b.column("queue").to_pylist(), b.column("at").to_pylist(), n.tolist(), strict=True)]
                doc = np.repeat(np.arange(len(pieces)), [len(x[0]) for x in pieces])
                length, sequence, offset = (np.concatenate(x) for x in zip(*pieces, strict=True))
                ends = np.cumsum(length)
                start = ends - length - np.repeat(np.cumsum(n) - n, [len(x[0]) for x in pieces])
                ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), np.uint16).astype("<u4")
                cuts = np.concatenate([[0], ends * 4]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(sequence), pa.array(offset),
                        b.column("source").take(pa.array(doc)), pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(cuts), pa.py_buffer(ids)]),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "source", "ids"],
                )

    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, source string, ids binary")


def piece_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")

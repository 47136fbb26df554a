"""N-gram Jaccard join by vertical partitioning of the shingle sets.

All shingles have one global order: by how crowded they are, then by hash. It is cut into fragments. A
document's set falls into one segment per fragment; overlaps of two documents are counted fragment by
fragment and summed per pair. Two sets that are similar enough share a shingle among the first
``n - ceil(t * n) + 1`` of each in that order, so only those rare shingles propose pairs.

A group of many near copies would propose all its pairs. Instead each list of documents that share a rare
shingle first proposes its leader against the others; then components are formed, and only pairs whose
members still are in different components are counted, which can't miss a link between components.
Documents with equal sets are one node from the start.

Hashes are 64 bits wide, of words, shingles and sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, forget, give_back, release, require_columns, stored
from .components import components

WORDS, PERCENT = 5, 75
FRAGMENTS = 4
#: A task counts shingles in blocks of so many and passes on what occurs more than once in one; a shingle
#: with so many occurrences is crowded. The global order puts the most crowded last, by their counts, as
#: far as they fit a table of this fixed size; others go by hash. Any order gives the same result.
BLOCK, CROWDED, KNOWN = 2_000_000, 8, 1 << 19
#: Rare shingles that one task compares at a time.
BUCKET = 250_000
#: Lists with one leader and up to so many nodes meet in joins; larger ones in blocks of these sizes.
SMALL, OUTSIDE, INSIDE = 16, 256, 4096

#: Bytes of texts hashed at a time; one text may be longer.
AT_ONCE = 1 << 17
#: Bits of the table by which tasks pass over documents that no pair needs.
BITS = 1 << 25

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte, A-Z as a-z, and whether it is white space (the space and 9 to 13)."""
    code = np.arange(256, dtype=np.uint64)
    code[65:91] = code[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return mixed(code + np.uint64(1)), space


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_FACTOR), -1, 2**64))
    raised = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)]), dtype=np.uint64)
    return raised(_FACTOR), raised(inverse)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Per text, the sorted hashes of its distinct shingles: A-Z lower-cased, words between ASCII white space.

    Fewer words than a shingle has are one shingle; no words, or a null text, are none. A word's hash is a
    difference of running sums over the bytes of many texts at a time; a text is taken whole, however long.
    """
    at = 0
    while at < len(texts):
        part = texts.slice(at, 1000)
        ends = np.frombuffer(part.buffers()[1], np.int32, len(part) + 1, part.offset * 4)
        take = max(1, int(np.searchsorted(ends, ends[0] + AT_ONCE, "right")) - 1)
        yield from _some_sets(part.slice(0, take), words)
        at += take


def _some_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    n = int(offsets[-1] - offsets[0])
    if not n:
        yield from (np.empty(0, np.uint64) for _ in range(len(texts)))
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8, n, int(offsets[0]))
    offsets -= offsets[0]
    number, space = byte_tables()
    word = ~space[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] |= word[edge]
    ends[edge - 1] |= word[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(max(AT_ONCE, n))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(number[data] * up[:n], dtype=np.uint64)])
    h = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.searchsorted(start, offsets)
    count = len(h) - words + 1
    rolled = np.full(max(count, 0), words, np.uint64)
    for i in range(words):
        rolled = rolled * _FACTOR + h[i : i + len(rolled)]
    rolled = mixed(rolled)
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if not valid[i] or a == b:
            yield np.empty(0, np.uint64)
        elif b - a < words:
            x = np.uint64([b - a])
            for j in range(a, b):
                x = x * _FACTOR + h[j : j + 1]
            yield mixed(x)
        else:
            found = np.sort(rolled[a : b - words + 1])
            new = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            yield found[new]


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many of a set's first shingles hold one of any similar enough set's first ones."""
    return n - -(-n * percent // 100) + 1


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The range of hashes, of so many, that each hash is in."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _parts(buckets: int, h: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """One row per bucket: its number, and the bytes of its hashes and of what goes with them."""
    bucket = _bucket(h, buckets)
    by = np.argsort(bucket, kind="stable")
    which, at = np.unique(bucket[by], return_index=True)
    cut = [slice(i, j) for i, j in zip(at, [*at[1:], len(h)], strict=True)]
    blobs = [pa.array([x[by][c].tobytes() for c in cut], pa.binary()) for x in (h, *more)]
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), *blobs], ["bucket", "h", "x", "y"][: 2 + len(more)])


def _joined(found: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in found.column(column)])


def repeated(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that occur more than once, and how often; h is sorted where it lies."""
    h.sort()
    same = h[1:] == h[:-1]
    first, last = same.copy(), same.copy()
    first[1:] &= ~same[:-1]
    last[:-1] &= ~same[1:]
    at = np.flatnonzero(first)
    return h[at], np.flatnonzero(last) + 2 - at


def repeated_in_blocks(sets: Iterable[np.ndarray], block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What is repeated among each so many hashes of the sets, in memory for one block; a set may be cut by its end."""
    held, size = np.empty(block, np.uint64), 0
    for found in sets:
        at = 0
        while at < len(found):
            part = found[at : at + block - size]
            held[size : size + len(part)] = part
            size, at = size + len(part), at + len(part)
            if size == block:
                yield repeated(held)
                size = 0
    if size:
        yield repeated(held[:size])


def crowded_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the most crowded shingles of all documents.

    A task sends one number for a shingle and block, so a shingle that a third of all documents have is no
    large group. Counts leave out occurrences that are alone in their block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for h, n in repeated_in_blocks((found for b in batches for found in shingle_sets(b.column("text"), words)), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])
        give_back()

    counts = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= CROWDED)
    most = counts.orderBy(F.desc("n"), "h").limit(KNOWN).toArrow()
    h, n = most.column("h").to_numpy().view(np.uint64), most.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


class Order:
    """The global order of shingles."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts = hashes, counts

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each shingle is one of the crowded ones, and its count if so."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return hit, np.where(hit, self.counts[at], 0)

    def first(self, h: np.ndarray, k: int) -> np.ndarray:
        """The first k of sorted shingles: those that aren't crowded by hash, then the crowded by count."""
        hit, count = self.known(h)
        rare = h[~hit][:k]
        if len(rare) == k:
            return rare
        common = h[hit]
        return np.concatenate([rare, common[np.lexsort((common, count[hit]))[: k - len(rare)]]])


def similar(overlap: Column, n_a: Column, n_b: Column, percent: int = PERCENT) -> Column:
    return overlap * 100 >= percent * (n_a + n_b - overlap)


def _length_fits(n_a: str, n_b: str, percent: int) -> Column:
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent)


def _pairs(found: DataFrame, percent: int) -> DataFrame:
    """Unordered pairs (a, b, n_a, n_b), a < b, of columns x, y, n_x, n_y with a row for each shared rare shingle.

    Of two sets, let A be the one whose first shingles end first. A shared shingle that isn't among both
    sets' first ones lies behind A's, of which there are ``ceil(t * n) - 1``. So similar sets share as
    many first shingles as the least overlap is above that.
    """
    low = F.col("x") < F.col("y")
    either = lambda p, q: F.when(low, F.col(p)).otherwise(F.col(q))
    named = found.select(either("x", "y").alias("a"), either("y", "x").alias("b"), either("n_x", "n_y").alias("n_a"), either("n_y", "n_x").alias("n_b"))
    behind = F.ceil(F.greatest("n_a", "n_b") * percent / 100) - 1
    least = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    return named.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least - behind).drop("shared")


def place(key: Column) -> tuple[Column, Column]:
    """The row and the bit in it that stand for a key in the table of BITS."""
    bit = F.pmod(F.xxhash64(key), F.lit(BITS))
    return F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)


def bits_of(rows: DataFrame, column: str) -> np.ndarray:
    """The table of BITS with those of the column's keys set; a set bit may stand for other keys, too."""
    k, at = place(F.col(column))
    held = rows.groupBy(k.alias("k")).agg(F.bitmap_construct_agg(at).alias("bits")).collect()
    size = len(held[0].bits) if held else 1
    bits = np.zeros((BITS // (size * 8) + 2, size), np.uint8)
    for r in held:
        bits[r.k] = np.frombuffer(r.bits, np.uint8)
    return bits


def is_set(bits: np.ndarray, k: pa.Array, at: pa.Array) -> np.ndarray:
    at = at.to_numpy()
    return (bits[k.to_numpy(), at // 8] >> (at % 8).astype(np.uint8) & 1).astype(bool)


class Join:
    """The steps of one join; tables are written as they are made."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int):
        self.words, self.percent = words, percent
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        self.id_type = self.docs.schema["doc_id"].dataType.simpleString()
        self.order = self.spark.sparkContext.broadcast(Order(*crowded_shingles(self.docs.where("doc_id is not null").select("text"), words)))
        self.sets = self._sets()

    def _sets(self) -> DataFrame:
        """Per row: doc_id, n, node (hash of the set; null for an empty one or a null id), rare (first shingles)."""
        order, words, percent = self.order, self.words, self.percent

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            forget()
            for whole in batches:
                for k in range(0, whole.num_rows, 1000):
                    b = whole.slice(k, 1000)
                    sets = list(shingle_sets(b.column("text"), words))
                    used = [len(s) > 0 and i.is_valid for s, i in zip(sets, b.column("doc_id"), strict=True)]
                    nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if u else None for s, u in zip(sets, used, strict=True)]
                    rare = [order.value.first(s, prefix_size(len(s), percent)).view(np.int64) if u else None for s, u in zip(sets, used, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(rare, pa.list_(pa.int64()))],
                        ["doc_id", "n", "node", "rare"],
                    )
            give_back()

        return stored(self.docs.mapInArrow(make, f"doc_id {self.id_type}, n long, node long, rare array<long>"), "shingle-sets")

    def lists(self) -> DataFrame:
        """Rows (h, node, n) of rare shingles that more than one node has; h is half a hash, as a list of two
        shingles can only propose more pairs.

        Crowded shingles are rows from the start. The others meet in buckets, ranges of their hash whose
        number grows with the input, as blocks of numbers.
        """
        used = self.sets.where("node is not null").select("node", "n", "rare")
        entries = used.agg(F.coalesce(F.sum(F.size("rare")), F.lit(0))).first()[0]
        buckets, order = max(1, -(-entries // BUCKET)), self.order

        def entries_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            rare = b.column("rare")
            row = np.repeat(np.arange(b.num_rows), rare.value_lengths().to_numpy())
            h = rare.flatten().to_numpy().view(np.uint64)
            return h, b.column("node").to_numpy()[row], b.column("n").to_numpy()[row], order.value.known(h)[0]

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, node, n, crowded = entries_of(batch)
                yield _parts(buckets, h[~crowded], node[~crowded], n[~crowded].astype("<u4"))

        def meet(found: pa.Table) -> pa.Table:
            h, node, n = _joined(found, "h", "<u8"), _joined(found, "x", "<i8"), _joined(found, "y", "<u4")
            by = np.lexsort((node, h))
            h, node, n = h[by], node[by], n[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
            h, node, n = h[new], node[new], n[new]
            same = h[1:] == h[:-1]
            shared = np.append(same, False) | np.append(False, same)
            return pa.table({"h": (h[shared] >> np.uint64(32)).astype(np.uint32).view(np.int32), "node": node[shared], "n": n[shared].astype(np.int64)})

        def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, node, n, hit = entries_of(batch)
                short = (h[hit] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(short), pa.array(node[hit]), pa.array(n[hit])], ["h", "node", "n"])

        rare = used.mapInArrow(blocks, "bucket long, h binary, x binary, y binary").groupBy("bucket").applyInArrow(meet, "h int, node long, n long")
        return stored(rare.unionByName(used.mapInArrow(common, "h int, node long, n long").distinct()), "rare-shingle-lists")

    def first_pairs(self, lists: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The leader of each list against the others, (node, leader): the leader a node meets most, and the table the pairs are read from.

        A list is led by the node that is in most lists: of near copies, one with few changes of its own.
        Pairs that share too little in the lists they meet in are left to other_pairs.
        """
        each = lists.groupBy("node").agg(F.count("*").alias("k"))
        lead = F.max(F.struct("k", F.xxhash64("node").alias("by"), F.col("node").alias("y"), F.col("n").alias("n_y")))
        leads = lists.join(each, "node").groupBy("h").agg(lead.alias("lead")).select("h", "lead.y", "lead.n_y")
        met = stored(lists.withColumnsRenamed({"node": "x", "n": "n_x"}).join(leads, "h"), "lists-with-leaders")
        del each, leads
        release(self.spark)
        most = met.groupBy("x", "y").agg(F.count("*").alias("k")).groupBy("x").agg(F.max_by("y", F.struct("k", "y")).alias("leader"))
        pairs = _pairs(met.where((F.col("x") != F.col("y")) & _length_fits("n_x", "n_y", self.percent)), self.percent)
        return pairs, stored(most.select(F.col("x").alias("node"), "leader"), "leaders"), met

    def other_pairs(self, lists: DataFrame, roots: DataFrame, leaders: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """All pairs that share enough rare shingles and whose members are in different components.

        Nodes with one leader are a group; where a group is large, its pairs are found in blocks. Other
        pairs meet in the lists: one of the two is outside the list's largest component, so those outside
        meet all. The members of one component never meet each other. With the pairs come the tables they
        are read from.
        """
        nodes = lists.select("node", "n").distinct().join(leaders, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        count = nodes.groupBy("leader", "root").agg(F.count("*").alias("k"))
        groups = count.groupBy("leader").agg(F.sum("k").alias("size"), F.max_by("root", F.struct("k", "root")).alias("top"), F.count("*").alias("roots"), F.max("k").alias("most"))
        known = stored(nodes.join(groups, "leader"), "nodes-in-groups")

        at = lists.join(known.select("node", "root", F.when(F.col("size") > SMALL, F.col("leader")).alias("large")), "node")
        each = at.groupBy("h", "root").agg(F.count("*").alias("k"))
        largest = each.groupBy("h").agg(F.max_by("root", F.struct("k", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("h", "top")
        split = at.join(largest, "h")
        outside = split.where("root <> top").select("h", F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("root").alias("root_x"), F.col("large").alias("large_x"))
        members = split.select("h", F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("root").alias("root_y"), F.col("large").alias("large_y"), "top")
        meet = (F.col("root_x") != F.col("root_y")) & _length_fits("n_x", "n_y", self.percent) & ((F.col("root_y") == F.col("top")) | (F.col("x") < F.col("y")))
        apart = F.coalesce(F.col("large_x") != F.col("large_y"), F.lit(True))
        of_groups, tables = self.group_pairs(known)
        return _pairs(outside.join(members, "h").where(meet & apart), self.percent).unionByName(of_groups), [known, *tables]

    def group_pairs(self, known: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """The pairs of large groups, by blocks of nodes outside the largest component against blocks of all."""
        percent = self.percent
        mixed_groups = stored(known.where((F.col("size") > SMALL) & (F.col("roots") > 1)), "large-groups")
        rare = self.sets.select("node", "rare").join(mixed_groups.select("node"), "node", "left_semi").groupBy("node").agg(F.first("rare").alias("rare"))
        held = stored(mixed_groups.join(rare, "node"), "large-groups-with-sets")
        dealt = F.xxhash64("node")
        rows, columns = F.ceil((F.col("size") - F.col("most")) / OUTSIDE).cast("int"), F.ceil(F.col("size") / INSIDE).cast("int")
        blocks = held.select("leader", "node", "n", "root", "top", "rare", rows.alias("rows"), columns.alias("columns"), dealt.alias("deal"))
        outside = blocks.where("root <> top").select("*", F.pmod("deal", "rows").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
        inside = blocks.select("*", F.pmod("deal", "columns").cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"))
        kept = [F.col(c).alias(c) for c in ("leader", "i", "j", "node", "n", "root", "top", "rare")]

        def find(left: pa.Table, right: pa.Table) -> pa.Table:
            empty = pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n_a", "n_b")})
            if not left.num_rows or not right.num_rows:
                return empty
            flat = lambda t: (t.column("rare").combine_chunks().flatten().to_numpy(), np.repeat(np.arange(t.num_rows), t.column("rare").combine_chunks().value_lengths().to_numpy()))
            (h, x), (g, y) = flat(left), flat(right)
            by = np.argsort(g, kind="stable")
            g, y = g[by], y[by]
            a, b = np.searchsorted(g, h), np.searchsorted(g, h, "right")
            shared = np.zeros(left.num_rows * right.num_rows, np.int32)
            for i in range(left.num_rows):  # one row of counts at a time
                mine = x == i
                found = [y[s:e] for s, e in zip(a[mine].tolist(), b[mine].tolist(), strict=True) if e > s]
                if found:
                    shared[i * right.num_rows : (i + 1) * right.num_rows] = np.bincount(np.concatenate(found), minlength=right.num_rows)
            i, j = np.divmod(np.flatnonzero(shared), right.num_rows)
            c = shared[shared > 0]
            col = lambda t, name: t.column(name).to_numpy()
            p, q, n_p, n_q = col(left, "node")[i], col(right, "node")[j], col(left, "n")[i], col(right, "n")[j]
            r_p, r_q, top = col(left, "root")[i], col(right, "root")[j], col(right, "top")[j]
            low, high = np.minimum(n_p, n_q), np.maximum(n_p, n_q)
            enough = c >= -(-(n_p + n_q) * percent // (100 + percent)) - (-(-high * percent // 100) - 1)
            ok = (r_p != r_q) & (low * 100 >= high * percent) & enough & ((r_q == top) | (p < q))
            p, q, n_p, n_q = p[ok], q[ok], n_p[ok], n_q[ok]
            swap = p > q
            return pa.table({"a": np.where(swap, q, p), "b": np.where(swap, p, q), "n_a": np.where(swap, n_q, n_p), "n_b": np.where(swap, n_p, n_q)})

        keys = ["leader", "i", "j"]
        found = outside.select(*kept).groupBy(*keys).cogroup(inside.select(*kept).groupBy(*keys)).applyInArrow(find, "a long, b long, n_a long, n_b long")
        return found, [mixed_groups, held]

    def segments(self, nodes: DataFrame) -> DataFrame:
        """Rows (node, fragment, segment) of the whole sets of these nodes, made anew from one text of each."""
        words = self.words
        bits = self.spark.sparkContext.broadcast(bits_of(nodes, "doc_id"))
        numbered = self.docs.where("doc_id is not null").select("text", *[c.alias(n) for c, n in zip(place(F.col("doc_id")), ("k", "at"), strict=True)])
        share = np.uint64(2**64 // FRAGMENTS)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for whole in batches:
                wanted = np.flatnonzero(is_set(bits.value, whole.column("k"), whole.column("at")))
                for i in range(0, len(wanted), 500):
                    node, fragment, segment = [], [], []
                    for s in filter(len, shingle_sets(whole.column("text").take(pa.array(wanted[i : i + 500])), words)):
                        of = np.minimum(s // share, np.uint64(FRAGMENTS - 1))
                        name = xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63
                        for f in range(FRAGMENTS):
                            a, b = np.searchsorted(of, f), np.searchsorted(of, f, "right")
                            if a < b:
                                node.append(name)
                                fragment.append(f)
                                segment.append(s[a:b].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(fragment, pa.int32()), pa.array(segment, pa.list_(pa.int64()))], ["node", "fragment", "segment"])
            give_back()

        made = numbered.mapInArrow(make, "node long, fragment int, segment array<long>")
        return made.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node", "fragment"])

    def links(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs that are similar enough: overlaps per fragment, summed per pair."""
        pairs = stored(pairs, "pairs")
        release(self.spark)
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        segments = stored(self.segments(nodes.join(ends, "node", "left_semi")), "segments", by="fragment")
        del ends
        release(self.spark)
        partial = []
        for f in range(FRAGMENTS):  # one at a time, so that the segments of one only are beside their table on disk
            side = lambda end, name: segments.where(F.col("fragment") == f).select(F.col("node").alias(end), F.col("segment").alias(name))  # noqa: B023, E731
            met = pairs.join(side("a", "s_a"), "a").join(side("b", "s_b"), "b")
            partial.append(stored(met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("k")), "overlaps"))
            del met
            release(self.spark)
        overlap = reduce(DataFrame.unionByName, partial).groupBy("a", "b", "n_a", "n_b").agg(F.sum("k").alias("k"))
        links = stored(overlap.where(similar(F.col("k"), F.col("n_a"), F.col("n_b"), self.percent)).select("a", "b"), "links")
        del overlap
        discard(pairs, segments, *partial)
        return links

    def components(self) -> DataFrame:
        """(node, root): the component of every node. Tables go as soon as the next ones stand."""
        nodes = stored(self.sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
        lists = self.lists()
        release(self.spark)
        pairs, leaders, met = self.first_pairs(lists)
        first = self.links(pairs, nodes)
        del pairs
        discard(met)
        roots = stored(components(first), "roots")
        pairs, tables = self.other_pairs(lists, roots, leaders)
        more = self.links(pairs, nodes)
        del pairs
        discard(lists, leaders, first, self.sets, *tables)
        spokes = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        final = stored(components(spokes.unionByName(more)), "components")
        every = stored(nodes.join(final, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "rooted")
        discard(roots, more, final, nodes)
        return every

    def run(self) -> DataFrame:
        rows = stored(self.sets.select("doc_id", "n", "node"), "rows")
        named = self.components()
        least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        of_node = named.join(least, "root").select("node", "component_id")
        with_node = rows.where("node is not null").select("doc_id", "n", "node").join(of_node, "node")
        alone = rows.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return with_node.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)

    def surplus(self) -> DataFrame:
        """(doc_id, node, stands, all): sets that don't stand for their component, and all sets under an id that has several rows.

        A component is stood for by the least of its (doc_id, node); ``all`` counts the id's rows.
        """
        rows = stored(self.sets.where("doc_id is not null").groupBy("doc_id", "node").agg(F.count("*").alias("rows")), "rows")
        named = self.components()
        roots = rows.join(named.select("node", "root"), "node")
        first = roots.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first"))
        judged = roots.join(first, "root").select("doc_id", "node", (F.struct("doc_id", "node") == F.col("first")).alias("stands"))
        every = rows.groupBy("doc_id").agg(F.sum("rows").alias("all"))
        return judged.join(every, "doc_id").where("all > 1 or not stands")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable by links, its own included).

    Two rows link when ``100 * |A & B| >= percent * |A | B|`` for their shingle sets. A text without words,
    or null, has an empty set and links with nothing: its component is its own id. A row with a null id has
    its shingles counted, links with nothing and has a null component. Repeated rows and different texts
    under one id are kept; each row has the component of its text. An empty table gives an empty result.
    Other columns are not looked at.
    """
    require_columns(docs, id_col, text_col)
    return Join(docs, id_col, text_col, words, percent).run()


def keep_one_per_group(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """The rows of docs, with all columns, but one for each component: the row with the least id (then the least hash of its set).

    What an id says of a row is decided by the row's own text: two texts under one id go or stay each on
    its own. Of rows that repeat both, one stays. Rows with a null id or without words link with nothing
    and all stay.
    """
    require_columns(docs, id_col, text_col)
    found = stored(Join(docs, id_col, text_col, words, percent).surplus(), "surplus")
    # An id with one row is decided by the id alone. The texts of other ids are hashed once more.
    # A table of bits tells most other documents, which stay and need not travel.
    drop = found.where("all = 1 and not stands").select(F.col("doc_id").alias("__id"))
    several = found.where("all > 1").select(F.col("doc_id").alias("__id")).distinct()
    judged = drop.unionByName(several)
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(judged, "__id"))

    @F.arrow_udf("boolean")
    def named(k: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array(is_set(bits.value, k, at))

    is_named = named(*place(docs[id_col]))
    near = docs.where(is_named)
    same = docs[id_col] == F.col("__id")
    single = docs.where(~is_named).unionByName(near.join(judged, same, "left_anti"))
    number = F.monotonically_increasing_id()
    repeated = stored(near.join(several, same, "left_semi").withColumn("__row", number), "repeated-ids")
    marked = stored(_with_node(repeated, text_col, words), "repeated-ids-with-sets")
    stands = found.where("all > 1 and stands").select(F.col("doc_id").alias("__id"), F.col("node").alias("__set"))
    mine = (marked[id_col] == F.col("__id")) & (marked["__node"] == F.col("__set"))
    one = marked.join(stands, mine, "left_semi").groupBy(id_col, "__node").agg(F.min("__row").alias("__first")).select("__first")
    kept = marked.join(one, marked["__row"] == F.col("__first"), "left_semi").unionByName(marked.where("__node is null"))
    return single.unionByName(kept.select(*[F.col(f"`{c}`") for c in docs.columns]))


def _with_node(rows: DataFrame, text_col: str, words: int) -> DataFrame:
    """rows plus __node, the hash of the set of each text; null for an empty one."""

    @F.arrow_udf("long")
    def node(texts: pa.Array) -> pa.Array:
        import xxhash

        sets = (s for k in range(0, len(texts), 1000) for s in shingle_sets(texts.slice(k, 1000), words))
        return pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets], pa.int64())

    return rows.withColumn("__node", node(F.col(text_col)))

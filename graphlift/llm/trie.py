"""Prefix trie of conversations from vertical bitmaps: which conversations share their first turns, and what that saves.

Conversations are dealt out in ranges of their ids. A task takes a range in shards of a few thousand
conversations; for every position and turn a bitset says which of the shard's conversations have that
turn there. Walking down from the root, a node's bitset meets the postings of the next position: each
intersection is a child, its bits are the members, and those that are as long as the node is deep end
there. A node is named by a digest of its turns, so the same node of several shards comes together in
one aggregation, with a row per shard however many conversations share it; the lists of ends of
ascending ranges only have to be laid one after the other.

Sums over subtrees follow chains: every node is represented by its least conversation, the nodes of one
representative are a path, and paths hang on earlier paths. Totals of paths are added up by pointer
doubling, in a number of rounds that grows with the logarithm of the tree of paths, not with its depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of, require_columns, stored

#: Conversations and turns of a shard. A longer conversation is walked on its own, as a stream.
SHARD, TURNS = 4096, 2**17
#: Ids in one piece of a list of ends.
_CHUNK = 512

#: Key of the root; a digest of 16 bytes is held as two longs.
ROOT = bytes(16)
_NODE = "k1 long, k2 long, p1 long, p2 long, depth long, n_convs long, conv_id long, bytes long, ends string"


def ordered_turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, turn_id, bytes): each conversation's turns by number, from 0.

    Null numbers come first; equal numbers go by role, then by the text's digest, and repeated rows are
    turns of their own. A null role or text is empty. ``turn_id`` is a digest of role and text, so that
    texts are not moved; ``bytes`` is the text's length in UTF-8. Rows without a conversation id are
    left out. Other columns are not looked at.
    """
    require_columns(conversations, id_col, turn_col, role_col, text_col)
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("bytes"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.unhex(F.md5(F.concat("digest", "role").cast("binary"))).alias("turn_id"), "bytes")


def rebuilt(turns: DataFrame, *, group: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that begin like the first of their group: (conv_id, part, pos, turn_id, bytes).

    Conversation c begins with the first h turns of conversation c - c % group (all if that has fewer,
    none if it is absent) and goes on with its own turns after its first h; h is crc32(c) % heads. A
    row of part -1 without a turn stands for the conversation itself, which may have no turns left.
    """
    shared = (crc_of(F.col("conv_id")) % heads).alias("h")
    base = F.col("conv_id") - F.col("conv_id") % group
    whole = turns.where("pos = 0").select("conv_id", shared, base.alias("base"))
    first = turns.where((F.col("pos") < heads - 1) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "pos", "turn_id", "bytes")
    begin = whole.join(first, "base").where("pos < h").select("conv_id", F.lit(0).alias("part"), "pos", "turn_id", "bytes")
    rest = turns.select("*", shared).where("pos >= h").select("conv_id", F.lit(1).alias("part"), "pos", "turn_id", "bytes")
    self = whole.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_id"), F.lit(0).cast("long").alias("bytes"))
    return self.unionByName(begin).unionByName(rest)


class _Shard:
    """Some conversations with ascending ids, and the nodes that they make."""

    def __init__(self):
        self.ids: list[int] = []
        self.turns: list[list[int]] = []
        self.known: dict[bytes, int] = {}
        self.digest: list[bytes] = []
        self.bytes: list[int] = []
        self.size = 0

    def turn(self, digest: bytes, n: int) -> int:
        t = self.known.setdefault(digest, len(self.digest))
        if t == len(self.digest):
            self.digest.append(digest)
            self.bytes.append(n)
        return t

    def nodes(self) -> Iterator[tuple]:
        """(key, parent, depth, members, least member, bytes of the last text, ends) of every node of the shard."""
        postings: dict[tuple[int, int], int] = {}
        ended: dict[int, int] = {}
        for i, turns in enumerate(self.turns):
            bit = 1 << i
            for d, t in enumerate(turns):
                postings[d, t] = postings.get((d, t), 0) | bit
            ended[len(turns)] = ended.get(len(turns), 0) | bit
        stack = [(ROOT, None, 0, (1 << len(self.ids)) - 1, 0)]
        while stack:
            key, parent, depth, members, n = stack.pop()
            ends = members & ended.get(depth, 0)
            yield key, parent, depth, members.bit_count(), self.ids[_lowest(members)], n, self._listed(ends)
            rest = members & ~ends
            while rest:
                t = self.turns[_lowest(rest)][depth]
                child = members & postings[depth, t]
                rest &= ~child
                stack.append((child_key(key, self.digest[t]), key, depth + 1, child, self.bytes[t]))

    def _listed(self, bits: int) -> list[int]:
        found = []
        while bits:
            i = _lowest(bits)
            found.append(self.ids[i])
            bits &= bits - 1
        return found


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def child_key(parent: bytes, turn: bytes) -> bytes:
    return blake2b(parent + turn, digest_size=16).digest()


def _rows(nodes: Iterator[tuple], size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Nodes as batches; a list of ends goes out in pieces, the first with the node itself."""
    held: list[tuple] = []
    for key, parent, depth, n, least, last, ends in nodes:
        pieces = [",".join(map(str, ends[i : i + _CHUNK])) for i in range(0, len(ends), _CHUNK)] or [None]
        first = ends[::_CHUNK] or [least]
        for i, (piece, at) in enumerate(zip(pieces, first)):
            held.append((key + (parent or ROOT), depth, 0 if i else n, at if i else least, last, piece))
        if len(held) >= size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    keys, depth, n, conv, last, ends = zip(*held)
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 4)
    return pa.RecordBatch.from_arrays(
        [*[pa.array(both[:, i]) for i in range(4)], *[pa.array(c, pa.int64()) for c in (depth, n, conv, last)], pa.array(ends, pa.string())],
        ["k1", "k2", "p1", "p2", "depth", "n_convs", "conv_id", "bytes", "ends"],
    )


def grow(turns: DataFrame, *, shard: int = SHARD, most: int = TURNS) -> DataFrame:
    """The nodes of every shard of ``turns`` (as ``rebuilt`` gives them), with its members' number and least id.

    ``ends`` lists the members that end at the node, as text; further pieces of a long list are rows
    with n_convs 0, whose conv_id is their first id. A task holds one shard.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(nodes(batches))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, alone = _Shard(), None  # alone: (id, key, depth) of a conversation longer than a shard
        for b in batches:
            for conv, part, turn, n in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "turn_id", "bytes"))):
                if part < 0:
                    if alone:
                        yield (*alone[1], [alone[0]])
                        alone = None
                    if len(now.ids) >= shard or now.size >= most:
                        yield from now.nodes()
                        now = _Shard()
                    now.ids.append(conv)
                    now.turns.append([])
                elif alone:
                    yield (*alone[1], [])
                    alone = (conv, (child_key(alone[1][0], turn), alone[1][0], alone[1][2] + 1, 1, conv, n))
                else:
                    now.turns[-1].append(now.turn(turn, n))
                    now.size += 1
                    if len(now.turns[-1]) > most:
                        # The others make a shard; this one's turns are a path and nothing of it is kept.
                        walked, now.ids, now.turns = now.turns[-1], now.ids[:-1], now.turns[:-1]
                        if now.ids:
                            yield from now.nodes()
                        at = (ROOT, None, 0, 1, conv, 0)
                        for t in walked:
                            yield (*at, [])
                            at = (child_key(at[0], now.digest[t]), at[0], at[2] + 1, 1, conv, now.bytes[t])
                        alone, now = (conv, at), _Shard()
        if alone:
            yield (*alone[1], [alone[0]])
        if now.ids:
            yield from now.nodes()

    dealt = turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "part", "turn_id", "bytes")
    return dealt.mapInArrow(walk, _NODE)


def _end_digests(grown: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): a task reads the pieces of a list in the order of their ids and keeps only the running hash."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running, done = None, sha256(), []
        for b in batches:
            for k1, k2, text in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ends"))):
                if (k1, k2) == at:
                    running.update(b"," + text.encode())
                    continue
                if at is not None:
                    done.append((*at, running.hexdigest()))
                at, running = (k1, k2), sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["k1", "k2", "ends_sha256"])
                done = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, running.hexdigest())], ["k1", "k2", "ends_sha256"])

    # A list's first piece starts with its node's first end, which need not be the least member.
    lists = grown.where("ends IS NOT NULL").select("k1", "k2", F.substring_index("ends", ",", 1).cast("long").alias("first"), "ends")
    return lists.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "ends").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def _path_totals(paths: DataFrame) -> DataFrame:
    """(conv_id, above, n_leaves, saved) -> the same with each path's totals over all paths that hang on it.

    Each round adds what the paths below have gathered so far and doubles how far ``above`` reaches;
    ``above`` is null where a path hangs on the root's.
    """
    while True:
        paths = stored(paths, "paths")
        if paths.where("above IS NOT NULL").isEmpty():
            return paths.select("conv_id", "n_leaves", "saved")
        below = paths.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        next_above = paths.select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        more = {"n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}
        summed = paths.join(below, "conv_id", "left").withColumns(more)
        reach = summed.where("above IS NOT NULL").join(next_above, "above").select("conv_id", F.col("next").alias("above"), "n_leaves", "saved")
        paths = summed.where("above IS NULL").select("conv_id", "above", "n_leaves", "saved").unionByName(reach)


def prefix_trie(turns: DataFrame, *, shard: int = SHARD, most: int = TURNS) -> DataFrame:
    """One row per distinct beginning of the conversations in ``turns`` (as ``rebuilt`` gives them).

    conv_id is the least conversation that begins so, depth its number of turns, parent_conv_id that of
    the beginning without the last turn (null for the root, depth 0), n_convs how many conversations
    begin so, n_children and n_leaves the nodes next below and those below (or here) without children,
    saved_tokens the bytes of last texts that are there more than once, summed over the subtree (the
    node included), ends_sha256 the hex sha256 of the ids of the conversations that are just this
    beginning, ascending, joined by commas. An empty table gives an empty result.

    One conversation is put in order by one task, in memory that spills, and its turns are read as a stream.
    """
    grown = stored(grow(stored(turns, "turns"), shard=shard, most=most), "shards")
    merged = grown.groupBy("k1", "k2").agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes")
    )
    children = grown.where("depth > 0").select("k1", "k2", "p1", "p2").distinct()
    children = children.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = stored(merged.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    top = nodes.where("depth = 0").select("conv_id").first()
    least = F.lit(top.conv_id if top else None).cast("long")

    by_depth = Window.partitionBy("conv_id").orderBy("depth")
    starts = nodes.withColumn("before", F.lag("depth").over(by_depth)).where("before IS NULL AND depth > 0").select("conv_id", "depth", "p1", "p2")
    parents = nodes.where("depth > 0 AND n_children > 0 AND n_convs > 1").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    low = starts.where("depth > 1").join(parents, ["p1", "p2"])
    starts = stored(starts.where("depth = 1").withColumn("parent", least).unionByName(low.select("conv_id", "depth", "p1", "p2", "parent")), "starts")

    own = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}
    nodes = nodes.withColumns(own)
    paths = nodes.where("depth > 0").groupBy("conv_id").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    above = starts.select("conv_id", F.when(F.col("parent") != least, F.col("parent")).alias("above"))
    totals = _path_totals(paths.join(above, "conv_id").select("conv_id", "above", "n_leaves", "saved"))
    hung = starts.join(totals, "conv_id").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))

    up = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_sums = (
        nodes.join(hung, ["k1", "k2"], "left")
        .join(_end_digests(grown), ["k1", "k2"], "left")
        .withColumn("l", F.sum(F.col("n_leaves") + F.coalesce("l", F.lit(0))).over(up))
        .withColumn("s", F.sum(F.col("saved") + F.coalesce("s", F.lit(0))).over(up))
    )
    begun = starts.select("conv_id", F.col("depth").alias("from"), "parent")
    return with_sums.join(begun, "conv_id", "left").select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("l").alias("n_leaves"),
        F.col("s").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"),
    )

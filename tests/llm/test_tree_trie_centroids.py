"""Centroid clustering, the prefix trie and byte-pair encoding, against plain restatements."""

import hashlib
import math
import random
import time
import zlib
from array import array

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import types as T

from graphlift.llm import bpe_tree, centroids, encoding, queries, trie
from helpers import SF, docs, table

WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def sql_rows(name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(t, df)
    cursor = con.execute(queries.ORACLES[name])
    return [c[0] for c in cursor.description], sorted(cursor.fetchall(), key=str)


# -- centroids --------------------------------------------------------------------------------


def plain_kmeans(rows, k, rounds, scale=256, dims=4):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middles = [list(v) for _, v in start[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middles))

    for _ in range(rounds):
        of = [best(v)[1] for _, v in kept]
        for c in range(len(middles)):
            mine = [v for (_, v), o in zip(kept, of) if o == c]
            if mine:
                middles[c] = [sum(x) // len(mine) for x in zip(*mine)]
    ends = [(i, *best(v)) for i, v in kept]
    total = sum(d for _, d, _ in ends)
    sums = {c: sum(d for _, d, e in ends if e == c) for c in range(len(middles))}
    return sorted(((i, c, d, sums[c], total, hashlib.sha256(",".join(map(str, middles[c])).encode()).hexdigest()) for i, d, c in ends), key=str)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster", T.StringType()), T.StructField("v", T.LongType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_plain_kmeans(spark, monkeypatch, seed):
    monkeypatch.setattr(centroids, "SHARD", 7)
    r = random.Random(seed)
    grid = [-1.0, -0.3, 0.0, 0.1, 0.7]
    rows = [(i, [r.choice(grid) if seed else r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [rows[3], rows[3], (3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1])]  # repeated rows, repeated and null ids
    odd = [(90, None), (91, []), (92, [1.0] * 3), (93, [1.0] * 5), (94, [1.0, None, 1.0, 1.0]), (95, [float("nan")] * 4), (96, [float("inf"), 0.0, 0.0, 0.0])]
    got = centroids.cluster_digest(centroids.cluster(vectors(spark, rows + odd).repartition(3), k=9, rounds=4, dims=4))
    assert rows_of(got) == plain_kmeans(rows + odd, 9, 4)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5, 0.5, 0.5, 0.5]), (2, [0.25, 0.5, 0.5, 0.5])]
    assert rows_of(centroids.cluster_digest(centroids.cluster(vectors(spark, rows), dims=4))) == plain_kmeans(rows, 40, 5)
    assert centroids.cluster(vectors(spark, []), dims=4).count() == 0
    huge = vectors(spark, [*rows, (3, [1e30, 0.0, 0.0, 0.0])])
    assert {r.vec_id for r in centroids.cluster(huge, dims=4).collect()} == {1, 2}


def test_blocks_are_joined_where_that_saves_work_and_lose_nothing():
    r = np.random.default_rng(1)
    kinds = r.integers(-50, 50, (5, 8))
    x = kinds[r.integers(0, 5, 1000)]
    blocks = centroids.encode_blocks(x)
    assert len(blocks) == 1 and len(blocks[0].words) == 5
    mixed = np.hstack([x, r.integers(-(2**26), 2**26, (1000, 3))])
    blocks = centroids.encode_blocks(mixed)
    assert (np.hstack([b.words[b.codes] for b in blocks]) == mixed).all() and 1 < len(blocks) < 11
    middles = r.integers(-(2**26), 2**26, (6, 11))
    cluster, distance = centroids.nearest(blocks, middles)
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)) for m in middles] for v in mixed[:50]]
    assert [min(f) for f in far] == distance[:50].tolist() and [f.index(min(f)) for f in far] == cluster[:50].tolist()
    sums = centroids.cluster_sums(blocks, cluster, 6)
    assert (sums == [mixed[cluster == c].sum(0) for c in range(6)]).all()


def test_op11_equals_its_sql_on_the_test_table(spark):
    names, want = sql_rows("op11_centroid_clustering", embeddings=table("embeddings"))
    assert rows_of(queries.op11_centroid_clustering(spark, SF).select(names)) == want


# -- prefix trie ------------------------------------------------------------------------------

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("bytes", T.StringType()),
    ]
)


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            md5 = hashlib.md5((text or "").encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", md5, text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    new = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        new[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if len(new[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        leaves = sum(q not in children for q in below)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], TURNS).repartition(3)
    turns = trie.ordered_turns(df)
    return rows_of(trie.prefix_trie(trie.rebuilt(turns), **sizes))


def some_conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(-6, 30), 1000, 10**12]:
        for k in range(r.choice([1, 2, 3, 5, 9, 12])):
            text = r.choice(["hi", "hi", "", None, "ä longer text", f"own {c}"])
            rows.append((c, r.choice([k, k, None, 2]), r.choice(["user", "user", "assistant", None]), text))
    rows += rows[:5] + [(None, 0, "user", "no id")]
    rows += [(c, k, "user", "the same") for c in range(100, 140) for k in range(3)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard": 2}, {"shard": 5, "most": 4}, {"shard": 1, "most": 1}])
def test_trie_equals_a_plain_one(spark, sizes):
    rows = some_conversations(len(sizes))
    assert trie_of(spark, rows, **sizes) == plain_trie(rows)


def test_trie_of_nested_conversations(spark):
    # Each conversation is one turn longer than the one before: a path of many paths for the doubling.
    rows = [(5 * c, k, "user", f"turn {k}") for c in range(12) for k in range(c + 1)]
    rows += [(5 * c, c + 1, "user", f"other {c}") for c in range(0, 12, 2)]
    rows = [(1000 - c, k, role, t) for c, k, role, t in rows]
    assert trie_of(spark, rows, shard=3) == plain_trie(rows)


def test_long_list_of_ends_is_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "_CHUNK", 3)
    rows = [(c, 0, "user", "same") for c in range(0, 200, 5)] + [(c, 0, "user", "same") for c in range(7, 50, 10)]
    assert trie_of(spark, rows, shard=8) == plain_trie(rows)


def test_no_conversations(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "user", "x")]) == []


def test_op12_equals_its_sql_on_the_test_table_and_on_odd_rows(spark, tmp_path):
    names, want = sql_rows("op12_conversation_prefix_trie", conversations=table("conversations"))
    assert rows_of(queries.op12_conversation_prefix_trie(spark, SF).select(names)) == want
    rows = some_conversations(7)
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    names, want = sql_rows("op12_conversation_prefix_trie", conversations=frame)
    spark.createDataFrame([(*r, "a", "b") for r in rows], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(queries.op12_conversation_prefix_trie(spark, str(tmp_path)).select(names)) == want


# -- byte-pair encoding -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)

    def both(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return list(ids), t.decode(ids, skip_special_tokens=False)

    return both


def odd_texts():
    r = random.Random(5)
    letters = [chr(c) for a, b in ((0, 0x250), (0x300, 0x370), (0x390, 0x3D0), (0x2000, 0x2070), (0x3040, 0x3100)) for c in range(a, b)]
    letters += list("\x85\xa0　  ﻿İẞﬁÅ각가\U0001f600")
    words = ["don't", "THE", "a" * 40, "abab" * 9, "<|endoftext|>", "<|startoftext|>", "é", "12345", "!?!", "日本語日本語", "I'LL'd"]
    for _ in range(300):
        yield "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        yield "".join(r.choice(words) + r.choice(["", " ", "\n", "\t\t", "\x1c", "　"]) for _ in range(r.randint(0, 12)))
        yield "".join(r.choice("aeinrstho") for _ in range(r.randint(0, 500)))


@pytest.mark.parametrize("leaf", [2, 5, 1024])
def test_ids_and_decoded_text_equal_the_library(library, leaf):
    model = bpe_tree.WordBpe(WORDS, leaf=leaf)
    for text in odd_texts():
        got = model.encode(text)
        assert (array("I", got.ids).tolist(), got.text) == library(text)


@pytest.mark.parametrize("size", [1, 3, 40])
def test_parts_encoded_apart_join_to_the_same_ids(library, size):
    model = bpe_tree.WordBpe(WORDS, leaf=4)
    for text in odd_texts():
        out, begun = [], []
        for pieces, continues, unfinished in model.parts(text, size):
            assert sum(len(p) if isinstance(p, str) else 1 for p in pieces) <= size
            head, ids, tail = model.part(pieces, continues, unfinished)
            begun = model.joined(begun, head)
            if not (continues and unfinished and len(pieces) == 1):
                out, begun = out + begun + ids, tail
        assert (out, begun) == (library(text)[0], [])


def test_memory_of_words_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe_tree, "MEMORY", 20_000)
    model = bpe_tree.WordBpe(WORDS)
    for i in range(500):
        model.encode(f"word{i} {'x' * 100}{i}")
    assert 5 < len(model._known) < 60 and model._known.room[0] >= 0 and max(map(len, model._known)) <= bpe_tree.LONGEST_WORD


def test_a_long_word_is_split_in_linear_time(library):
    model = bpe_tree.WordBpe(WORDS)
    start = time.time()
    text = "x1" * 200_000 + " é" + "y" * 50_000
    got = model.encode(text)
    assert time.time() - start < 60 and (array("I", got.ids).tolist(), got.text) == library(text)


@pytest.mark.parametrize("long", [2**18, 50])
def test_encoded_texts(spark, library, long):
    r = random.Random(2)
    blob = "".join(r.choice("abcdef0123456789") for _ in range(3000))
    texts = [None, "", " \n", "Hello <|endoftext|> WORLD's", blob, "z" * 700, blob + " " + blob, "日本" * 300, "a b " * 500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, blob), (4, blob), (None, "z" * 700), (3, "again")]
    got = rows_of(encoding.encoding_digest(encoding.encode_texts(docs(spark, rows).repartition(3), WORDS, long=long)))
    want = []
    for i, t in rows:
        ids, text = library(t)
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert encoding.encode_texts(docs(spark, []), WORDS, long=long).count() == 0


def test_op13_on_the_test_table(spark, library):
    got = {r.doc_id: r for r in queries.op13_bpe_encoding_and_decoding(spark, SF).collect()}
    source = table("documents")
    assert len(got) == len(source)
    for doc_id, text in zip(source.doc_id, source.text):
        ids, back = library(text)
        assert got[doc_id].n_tokens == len(ids) and got[doc_id].ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe_tree.WordBpe(public_tokenizers.path("byte_bpe_50k.json"))

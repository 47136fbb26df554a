import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphlift.llm import bpe, packing, queries, tokens

from helpers import SF, docs, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", " ", "  ", "\n", " \n", "\t", "'s", "'", "1", "²", "é", "\xa0", "\x1c", "\x85", "<|endoftext|>", "!", "the", "　", "日本", "\x00", "😀", "ſ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n=3000):
    r = random.Random(1)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 12))) for _ in range(n)] + [f"a {chr(c)} b{chr(c)}1" for c in range(0x3000)]


def test_counts_and_ids_equal_the_library(library):
    count, ranks, plain = bpe.TokenCounter(PATH), bpe.TokenIds(PATH, by_ranks=True), bpe.TokenIds(PATH)
    assert bpe.merged_by_concatenation(PATH)
    for t in odd_texts() + table("documents").text.tolist()[:50]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert count(t) == len(ids)
        assert np.frombuffer(ranks(t), np.uint16).tolist() == ids == np.frombuffer(plain(t), np.uint16).tolist()


def test_long_piece_is_counted_whole(library):
    t = "ab" * 20_000
    assert bpe.TokenCounter(PATH)(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_memo_is_bounded():
    m = bpe.Remembered(len, limit=2)
    assert [m[k] for k in ("a", "bb", "ccc", "bb")] == [1, 2, 3, 2] and len(m) == 2


def test_token_counts_of_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x <|endoftext|> y"), (5, "word " * 3000)]
    got = tokens.token_counts(docs(spark, rows), PATH).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert tokens.token_counts(docs(spark, []), PATH).count() == 0


def test_op4_whole_table(spark, library):
    got = {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, SF).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in zip(table("documents").doc_id, table("documents").text, strict=True)}


@pytest.mark.parametrize("totals, weights", [([10**9, 3 * 10**8, 777, 1, 5 * 10**6], None), ([5000, 300, 20], [1, 2, 0]), ([3], None), ([10**6] * 40 + [3], [1] * 41), ([1024 * 8, 0], None)])
def test_schedule_serves_all_and_owes_little(totals, weights):
    plan = packing.phases(totals, 1024, weights)
    assert [sum(p.rounds * p.quota[i] for p in plan) for i in range(len(totals))] == totals
    for p in plan:
        served = packing.round_plan(p.quota, p.length, p.size)
        each = np.diff(served, axis=0)
        assert (each >= 0).all() and (each.sum(axis=1) == p.size).all() and tuple(served[-1]) == p.quota
        owed = np.outer(np.arange(p.length + 1), p.quota) / p.length - served
        assert p.length == 1 or abs(owed).max() < 2


def check_pieces(pieces, ids, size=1024):
    """Every document's ids once, in order; sequences without gaps and full but for the last."""
    at = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] = r.start + r.length
    assert at == {k: len(v) for k, v in ids.items()}
    filled = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0) and r.length > 0
        filled[r.sequence_id] = r.offset + r.length
    assert sorted(filled) == list(range(len(filled)))
    assert all(n == size for s, n in filled.items() if s < len(filled) - 1)


def ids_of(library, rows):
    return {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}


def test_op8_whole_table(spark, library):
    d = table("documents")
    check_pieces(queries.op8_packing(spark, SF).collect(), ids_of(library, zip(d.doc_id, d.text, strict=True)))


def test_packing_mixes_every_sequence(spark):
    shares = {}
    for r in queries.op8_packing(spark, SF).collect():
        shares[r.sequence_id, r.source] = shares.get((r.sequence_id, r.source), 0) + r.length
    last = max(s for s, _ in shares)
    by_source = {}
    for (s, source), n in shares.items():
        if s < last * 0.9:
            by_source.setdefault(source, []).append(n)
    assert all(max(v) - min(v) <= 2 for v in by_source.values())


def test_packing_of_odd_rows(spark, library):
    rows = [(1, None, None, "a"), (2, "", None, None), (3, "x y z " * 2000, None, "a"), (4, "b", None, "b")]
    check_pieces(packing.piece_digest(packing.pack(docs(spark, rows), PATH)).collect(), ids_of(library, [r[:2] for r in rows]))
    assert packing.pack(docs(spark, []), PATH).count() == 0
    twice = packing.pack(docs(spark, [(1, "a", None, "a")] * 2 + [(None, "a", None, "a")]), PATH).collect()
    assert [r.length for r in twice] == [2, 2, 2] and {r.sequence_id for r in twice} == {0}


def test_packing_to_given_proportions(spark):
    rows = [(i, "x y " * 500, None, "ab"[i % 2]) for i in range(40)]
    got = packing.pack(docs(spark, rows), PATH, weights={"a": 3, "b": 1}).collect()
    first = {}
    for r in got:
        if r.sequence_id < 10:
            first[r.source] = first.get(r.source, 0) + r.length
    assert first == {"a": 7680, "b": 2560}


def test_more_sources_than_queues(spark, library):
    rows = [(i, "a b c", None, f"s{i}") for i in range(packing.MAX_QUEUES + 40)]
    check_pieces(packing.piece_digest(packing.pack(docs(spark, rows), PATH)).collect(), ids_of(library, [r[:2] for r in rows]))


def served(pieces, upto):
    out = {}
    for r in pieces:
        if r.sequence_id < upto:
            out.setdefault(r.source, {}).setdefault(r.sequence_id, []).append(r.length)
    return {s: [sum(x.get(i, [0])) for i in range(upto)] for s, x in out.items()}


def test_every_source_is_in_every_sequence_and_keeps_its_own_weight(spark):
    rows = [(i, "x y " * 200, None, f"s{i}" if i else None) for i in range(320)]
    shares = served(packing.pack(docs(spark, rows), PATH).collect(), 90)
    assert len(shares) == 320 and all(max(x) - min(x) <= 2 and min(x) >= 1 for x in shares.values())
    got = served(packing.pack(docs(spark, rows), PATH, size=64, weights={"s5": 3, None: 1}).collect(), 5)
    assert got == {"s5": [48] * 5, None: [16] * 5}


def test_sources_below_a_token_a_sequence_take_turns():
    totals = [500 + i % 7 for i in range(3000)]
    plan = packing.phases(totals, 1024)
    cutter, filled, first = packing.Cutter(plan), {}, []
    for q, n in enumerate(totals):
        length, sequence, offset = cutter(q, 0, n)
        assert length.sum() == n and (np.diff(sequence) > 0).all()
        first.append(sequence[0])
        for s, o, k in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
            filled.setdefault(s, []).append((o, k))
    assert max(first) <= 6
    for s, parts in filled.items():
        ends = [o + k for o, k in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] == (1024 if s < len(filled) - 1 else sum(totals) % 1024 or 1024)


def test_words_are_remembered_within_bytes(monkeypatch):
    from graphlift.llm import bpe

    monkeypatch.setattr(bpe, "MEMORY", 50_000)
    memo = bpe.Remembered(lambda w: b"x" * 400)
    for i in range(1000):
        assert memo["w" * 1000 + str(i)] == memo[f"word{i}"] == b"x" * 400
    assert 20 < len(memo) < 120 and max(map(len, memo)) <= bpe.LONGEST

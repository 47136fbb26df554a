import random
import time
import tracemalloc
from collections import Counter, defaultdict

import pytest

from graphlift.llm import common, components, jaccard, queries

from helpers import SF, docs, table, words5


def brute(rows):
    sets = {i: words5(t) for i, t in rows}
    having, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in having[s])
        for s in sets[i]:
            having[s].append(i)
        for j, k in shared.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_op6_whole_table(spark):
    d = table("documents")
    assert found(queries.op6_ngram_jaccard_join(spark, SF)) == brute(zip(d.doc_id, d.text, strict=True))


def varied(seed, groups):
    """Groups of (size, edits): copies of a base text, each with so many words changed at most; a passage is shared."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage, out = " ".join(word() for _ in range(40)), []
    for size, edits in groups:
        base = [word() for _ in range(r.randint(60, 90))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w) + (" " + passage if r.random() < 0.5 else ""))
    out += [passage + " " + " ".join(word() for _ in range(k)) for k in range(4, 24) for _ in range(3)]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_and_shared_passages(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "OUTSIDE", 16)
    monkeypatch.setattr(jaccard, "INSIDE", 32)
    rows = varied(seed, [(120, 9), (30, 6), (5, 2), (2, 3), (1, 0)])
    want = brute(rows)
    assert found(jaccard.jaccard_components(docs(spark, rows))) == want
    assert len({v[1] for v in want.values()}) > 20


def test_odd_rows(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (3, "ONE two"), (9, "one\xa0two"), (None, "one two"), (8, "one two"), (2, "w " * 9), (1, "w w w w w")]
    got = jaccard.jaccard_components(docs(spark, rows)).collect()
    want = [(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 3), (3, 1, 3), (9, 1, 9), (None, 1, None), (8, 1, 3), (2, 1, 1), (1, 1, 1)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_one_stays_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(4, text), (2, text), (2, text), (9, text + " more"), (7, "other text"), (None, text), (5, None), (6, "")]
    kept = jaccard.keep_one_per_group(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "6", "7", "None"]


def test_texts_under_one_id_stay_or_go_on_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    kept = lambda rows: sorted((r.doc_id, r.text) for r in jaccard.keep_one_per_group(docs(spark, rows)).collect())
    assert kept([(1, a), (1, b), (2, c)]) == sorted([(1, a), (1, b), (2, c)])
    assert kept([(1, a), (2, a), (2, b)]) == [(1, a), (2, b)]
    got = kept([(1, a), (1, a), (1, a + " more"), (2, b), (2, b), (3, ""), (3, ""), (3, b)])
    assert got in ([(1, a), (2, b), (3, ""), (3, "")], [(1, a + " more"), (2, b), (3, ""), (3, "")])


@pytest.mark.parametrize("seed", range(2))
def test_one_row_of_each_component_stays(spark, seed):
    r = random.Random(seed)
    base = [[f"{g}w{i}" for i in range(50)] for g in "abcdef"]
    rows = []
    for _ in range(60):
        w = list(r.choice(base))
        w[r.randrange(50)] = "x"
        rows.append((r.randrange(25), " ".join(w)))
    sets = [words5(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    least = {c: min(rows[i][0] for i in range(len(rows)) if root[i] == c) for c in set(root)}
    got = [(x.doc_id, x.text) for x in jaccard.keep_one_per_group(docs(spark, rows)).collect()]
    assert sorted(i for i, _ in got) == sorted(least.values()) and set(got) <= set(rows)
    assert len({root[rows.index(x)] for x in got}) == len(least)


def test_shingle_sets_of_sliced_arrays():
    import pyarrow as pa

    texts = pa.array(["skip me", "A b c d e f", None, "", "x", "é É\x0bq"])
    sizes = [len(s) for s in jaccard.shingle_sets(texts.slice(1))]
    assert sizes == [2, 0, 0, 1, 1]
    long = pa.array(["a b c d e f g h " * 100_000, "a b c d e f g h"])
    first, second = jaccard.shingle_sets(long)
    assert len(first) == 8 and set(second) <= set(first)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + k: 100 for k in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_bound_is_exact():
    for n in range(1, 200):
        need = -(-3 * n // 4)
        assert jaccard.prefix_size(n) == n - need + 1


def test_release_frees_what_was_shuffled_last(spark):
    def shuffled():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    common.release(spark)
    time.sleep(1)
    before = shuffled()
    kept = common.stored(spark.range(0, 10_000, 1, 4).groupBy((jaccard.F.col("id") % 1000).alias("k")).count(), "counts")
    assert shuffled() - before
    common.release(spark)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and kept.count() == 1000


def test_links_of_several_fragments(spark):
    words = [f"w{i}" for i in range(90)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:44], "x", *words[45:]])), (3, " ".join(reversed(words))), (4, " ".join(words[:40]))]
    assert found(jaccard.jaccard_components(docs(spark, rows))) == brute(rows)


def test_ids_that_share_a_bit_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BITS", 2)
    text = [" ".join(f"{x}{i}" for i in range(30)) for x in "abcd"]
    rows = [(1, text[0]), (2, text[0]), (3, text[1]), (4, text[2]), (4, text[3]), (5, text[3]), (None, text[0]), (6, "")]
    kept = jaccard.keep_one_per_group(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in [rows[0], *rows[2:5], *rows[6:]])


def test_sets_are_made_in_little_memory():
    import pyarrow as pa

    def peak(f):
        tracemalloc.start()
        f()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    r = random.Random(1)
    texts = pa.array([" ".join(str(r.randrange(1000)) for _ in range(500)) for _ in range(1000)])
    assert peak(lambda: [len(s) for s in jaccard.shingle_sets(texts)]) < 20e6  # 2 MB of texts
    h = jaccard.np.random.default_rng(1).integers(0, 1 << 19, 1 << 20).astype(jaccard.np.uint64)
    want = {k: n for k, n in Counter(h.tolist()).items() if n > 1}
    got = []
    assert peak(lambda: got.append(jaccard.repeated(h))) < 2 * h.nbytes
    assert dict(zip(got[0][0].tolist(), got[0][1].tolist(), strict=True)) == want
    assert [len(x) for x in jaccard.repeated(h[:0].copy())] == [0, 0] and len(jaccard.repeated(h[:1].copy())[0]) == 0


def test_blocks_of_shingles_are_counted_in_the_memory_of_one():
    np = jaccard.np
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 14, 2000).astype(np.uint64)) for i in range(300)]
    block, whole = 1 << 17, np.concatenate(sets)
    want = [Counter(whole[k : k + block].tolist()) for k in range(0, len(whole), block)]
    tracemalloc.start()
    got = [dict(zip(h.tolist(), n.tolist(), strict=True)) for h, n in jaccard.repeated_in_blocks(iter(sets[:5] * 80), block)][-1:]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got and most < 8 * block * 8
    got = [dict(zip(h.tolist(), n.tolist(), strict=True)) for h, n in jaccard.repeated_in_blocks(iter(sets), block)]
    assert got == [{h: n for h, n in c.items() if n > 1} for c in want]
    assert list(jaccard.repeated_in_blocks(iter([]), block)) == [] and len(list(jaccard.repeated_in_blocks(iter([sets[0]]), 100))) == -(-len(sets[0]) // 100)


def test_a_worker_forgets_what_an_earlier_stage_loaded():
    import pyarrow as pa

    class Ran(Exception):
        pass

    class Worker:
        def mapInArrow(self, f, schema):
            self.out = [b.to_pydict() for b in f(iter([pa.RecordBatch.from_pydict({"text": ["a b c d e f", "a b c d e g"]})]))]
            raise Ran

    made = []
    load = lambda k: made.append(k) or [k]
    assert common.kept(load, 1) is common.kept(load, 1) and made == [1]
    common.kept(load, 2)
    assert len(common._kept) == 1 and made == [1, 2]
    worker = Worker()
    with pytest.raises(Ran):
        jaccard.crowded_shingles(worker, 5)
    assert not common._kept and [b["n"] for b in worker.out] == [[2]]


def test_packing_leaves_one_encoder_to_the_worker():
    import public_tokenizers
    from graphlift.llm import packing

    path = public_tokenizers.path(queries.VOCABULARY)
    assert not hasattr(packing.encoder, "cache_info")  # a cache of its own would outlive the stage
    assert common.kept(packing.encoder, path, True) is common.kept(packing.encoder, path, True)
    common.forget()
    assert not common._kept

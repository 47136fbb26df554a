import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlift.llm import language, queries, topk, toxicity

from helpers import SF, docs, table


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


# -- toxicity ---------------------------------------------------------------------------------------


def labelled(spark, n=240, seed=1):
    """Texts of random words; every third one holds words that no other text has."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeiou") if k % 2 else r.choice("bdklmnrst") for k in range(r.randint(3, 7))) for _ in range(400)]
    bad = ["gruzzle", "flomp", "vextar", "quibbo"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(40, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(6):
                w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_words_are_learned_and_found(spark):
    d, labels = labelled(spark)
    model = toxicity.train(d, labels.where("doc_id < 180"))
    assert all(w.encode() in model.toxic and w.encode() not in model.ordinary for w in ("gruzzle", "flomp"))
    held = [r for r in toxicity.toxicity(d, model).collect() if r.doc_id >= 180]
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 57
    kept = toxicity.drop_toxic(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.toxicity(d, model).collect() if not r.predicted}


def test_toxicity_of_odd_rows(spark):
    d, labels = labelled(spark, 90)
    model = toxicity.train(d, labels)
    odd = docs(spark, [(1, None), (2, ""), (2, ""), (None, "x"), (3, "é" * 5000)])
    got = toxicity.toxicity(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    score = {r.doc_id: r.score for r in got}
    assert score[1] == score[2]
    assert toxicity.toxicity(docs(spark, []), model).count() == 0
    assert toxicity.drop_toxic(odd, model).count() == 5


def test_toxicity_without_labels(spark):
    d, labels = labelled(spark, 30)
    none = toxicity.train(d, labels.limit(0))
    assert {r.predicted for r in toxicity.toxicity(d, none).collect()} == {0}
    nulls = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert toxicity.train(d, nulls).weights == none.weights


def test_op9_learns_from_other_rows_only(spark):
    d = table("documents")
    got = queries.op9_toxicity(spark, SF).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: crc(i, 5) == 0 for i in d.doc_id}
    sizes = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, "/root/testdata/sf0.01").collect()}
    held = [(got[i].predicted, t) for i, t in zip(sizes.doc_id, sizes.toxic, strict=True) if crc(i, 5) == 0]
    assert sum(p == t for p, t in held) / len(held) > 0.9


# -- language ---------------------------------------------------------------------------------------


def test_language_backs_off_to_shorter_grams():
    model = language.Model(("x", "y"), (0.0, 0.0), {"known": (0.0, -3.0)}, ({"z": (-3.0, 0.0)}, {"ab": (0.0, -1.0)}, {"qab": (-9.0, 0.0)}, {}, {}))
    of = language.Guesser(model)
    assert of("known")[0] == "x" and of("cab")[0] == "x" and of("qab")[0] == "y" and of("z")[0] == "y"
    assert of("known known z") == of("Known KNOWN z") and of("")[0] == "und" and of(None) == ("und", 0.0) and of("12 .²")[0] == "und"
    assert of("ыыы")[0] == "x"


def test_language_of_odd_rows(spark):
    rows = [(i, "der hund und die katze" if i % 2 else "the dog and the cat", "de" if i % 2 else "en") for i in range(40)] + [(None, "x", "fr"), (50, None, "fr"), (51, "y", None)]
    d = docs(spark, rows)
    model = language.train(d)
    assert model.languages == ("de", "en")
    odd = docs(spark, [(1, None, "de"), (2, "", "de"), (3, "42!", "de"), (None, "the katze und die", "en"), (4, "und die " * 5000, "en"), (4, "THE", "de")])
    got = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "de"), (4, "de"), (4, "en")}
    assert language.identify(docs(spark, []), model).count() == 0
    empty = language.train(docs(spark, []))
    assert [r.lang_pred for r in language.identify(docs(spark, [(1, "the")]), empty).collect()] == ["und"]


def test_op3_is_right_on_held_out_rows(spark):
    d = table("documents").set_index("doc_id")
    got = queries.op3_language_id(spark, SF).collect()
    assert len(got) == len(d) and all(r.held_out == (crc(r.doc_id, 4) == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == d.lang[r.doc_id] for r in held) / len(held) > 0.9


# -- top-k ------------------------------------------------------------------------------------------

VECTORS = T.StructType([T.StructField(n, t) for n, t in (("vec_id", T.LongType()), ("embedding", T.ArrayType(T.FloatType())), ("id", T.StringType()), ("v", T.LongType()), ("score", T.LongType()))])


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, 2) for i, v in rows], VECTORS)


def brute(rows, k, is_query):
    ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if is_query(i)}):
        mine = min((v for i, v in ok if i == q), key=lambda v: v.tolist())
        found = sorted((-int(v @ mine), i) for i, v in ok if i != q and len(v) == len(mine))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("shard, leaf, block", [(4096, 64, 2048), (40, 4, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, leaf, block):
    for name, value in (("SHARD_ROWS", shard), ("LEAF_ROWS", leaf), ("BLOCK", block), ("FIRST_SHARDS", 2)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).round(1).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(120)]  # many ties
    rows += [(7, rows[3][1]), (20, rows[3][1]), (None, [1] * 6), (500, None), (510, []), (520, [1, None, 1, 1, 1, 1]), (530, [1, float("nan"), 1, 1, 1, 1]), (540, [float("inf")] * 6), (550, [1, 2]), (560, [2, 1]), (570, [3e6] * 6)]
    got = topk.top_k(vectors(spark, rows), F.col("id") % 10 == 0).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, 10, lambda i: i % 10 == 0)


def test_top_k_of_few_or_no_rows(spark):
    rows = [(0, [1, 0]), (1, [0, 1]), (2, [1, 1])]
    got = topk.top_k(vectors(spark, rows), F.col("id") == 0).collect()
    assert [tuple(x) for x in sorted(got)] == [(0, 1, 2, 1024**2), (0, 2, 1, 0)]
    assert topk.top_k(vectors(spark, []), F.col("id") == 0).count() == 0
    assert topk.top_k(vectors(spark, rows[:1]), F.col("id") == 0).count() == 0


def test_op5_whole_table(spark):
    e = table("embeddings")
    rows = [(i, v.tolist()) for i, v in zip(e.vec_id, e.embedding, strict=True)]
    assert sorted(tuple(x) for x in queries.op5_exact_topk_search(spark, SF).collect()) == brute(rows, 10, lambda i: i % 100 == 0)


def test_least_rows_are_the_same_with_and_without_the_bound(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "1 AS toxic")
    by = F.xxhash64("doc_id")
    want = [r.doc_id for r in rows.orderBy(by, "doc_id").limit(500).collect()]
    assert [r.doc_id for r in toxicity._least(rows, by, 500, 20_000).collect()] == want
    assert [r.doc_id for r in toxicity._least(rows, by, 500, 10**9).collect()] == want  # a wrong count bounds too low: all rows are looked at


def test_training_starts_no_rdd_workers(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("rows through an RDD")

    rows = [(i, ("you vile rotten fool " if i % 2 else "a calm and pleasant day ") * 5 + str(i)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert toxicity.train(d, labels).toxic

"""Toxicity by compression distance: two zstandard dictionaries, window by window.

Ordinary rows train one dictionary: their most common words. Toxic rows train the other: the same words,
which toxic text has too, and before them the words that toxic rows use more than ordinary ones do by a
likelihood ratio. A window that compresses better with the second than with the first holds such words or
parts of them. Words count once for each pair of neighbours they have, so copies of one text weigh nothing.
Lengths saved per window and the most saved in one window are turned into a probability by a logistic
curve, fitted on labelled rows that trained no dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require_columns

#: Bytes of a window, and of the one before that it repeats.
WINDOW, OVERLAP = 128, 12
#: Rows whose texts a task holds as Python strings at a time.
AT_ONCE = 500
LEVEL = 9
#: Words of the ordinary dictionary; most words of the toxic one; least likelihood ratio of these.
COMMON, TOXIC, RATIO = 3000, 2000, 20.0
#: Most labelled rows of a class that a model is fitted on: those with the least hash of their id.
SAMPLE = 3000


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, float, float]  # of the constant, bytes saved per window, most bytes saved

    def compressors(self):
        import zstandard as zstd

        def make(content: bytes):
            d = zstd.ZstdCompressionDict(content + b"\n" * 24, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress

        return make(self.ordinary), make(self.toxic)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def saved(text: str | None, ordinary, toxic) -> tuple[float, float]:
    """Bytes saved by the toxic dictionary per window, and the most in one. A null text is an empty one."""
    data = (text or "").lower().encode()
    gains = [len(ordinary(w)) - len(toxic(w)) for w in (data[max(0, k - OVERLAP) : k + WINDOW] for k in range(0, max(len(data), 1), WINDOW))]
    return sum(g for g in gains if g > 0) / len(gains), float(max(0, max(gains)))


def _features(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, other columns but text, and the two features."""
    kept = [f for f in rows.schema if f.name != "text"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, toxic = model.compressors()
        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(k, AT_ONCE)
                found = np.array([saved(t, ordinary, toxic) for t in b.column("text").to_pylist()]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(found[:, 0]), pa.array(found[:, 1])], [*[f.name for f in kept], "per_window", "most"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(measure, f"{names}, per_window double, most double")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.1) -> tuple[float, ...]:
    """Weights of a constant and the columns of x, by Newton steps with a small penalty."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [penalty] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (y - p)) - ridge @ w
        step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + ridge, grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _least(rows: DataFrame, by: Column, k: int, n: int) -> DataFrame:
    """The k of n rows with the least hash: those below a bound that some more than k are expected to pass, cut to k.

    So no more than those travel, however many tasks there are.
    """
    share = (k + 10 * k**0.5 + 100) / n
    if share < 1:
        below = rows.where(by < F.lit(int(share * 2**64) - 2**63))
        if below.count() >= k:
            rows = below
    return rows.orderBy(by, "doc_id").limit(k)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic 0/1): at most ``sample`` labelled rows of each class are used.

    Rows with a null id, text or label train nothing; an id labelled both ways counts as toxic. Without
    toxic rows every score is 0; without ordinary ones 1.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return Model(b"", b"", (30.0 if counts.get(1) else -30.0, 0.0, 0.0))
    by = F.xxhash64("doc_id")
    chosen = [_least(known.where(F.col("toxic") == c), by, sample, counts[c]).withColumn("part", F.pmod(by, F.lit(3))).toArrow() for c in (0, 1)]
    # As an Arrow table: rows would start Python's RDD workers, whose parent process stays on every executor.
    picked = F.broadcast(spark.createDataFrame(pa.concat_tables(chosen)))
    rows = docs.where("text is not null").join(picked, "doc_id").select("toxic", "part", "text").cache()
    words = rows.where("part <> 0").select("toxic", F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), "").alias("w"))
    places = words.select("toxic", F.explode(F.arrays_zip(F.col("w").alias("word"), F.expr("array_append(slice(w, 2, size(w)), '')").alias("next"), F.expr("array_prepend(slice(w, 1, greatest(size(w) - 1, 0)), '')").alias("last"))).alias("x"))
    seen = places.select("toxic", "x.word", "x.last", "x.next").where("word is not null").distinct().groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")).cache()
    n = seen.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    if not n.a or not n.b:
        return Model(b"", b"", (-30.0, 0.0, 0.0))
    share = (F.col("a") + F.col("b")) / (n.a + n.b)
    part = lambda c, total: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / (share * total))).otherwise(0.0)
    judged = seen.select("word", "a", "b", (2 * (part("a", n.a) + part("b", n.b))).alias("ratio"), ((F.col("a") + 0.5) / n.a / ((F.col("b") + 0.5) / n.b)).alias("odds"))
    over = [r.word for r in judged.where((F.col("ratio") >= RATIO) & (F.col("odds") > 7)).orderBy(F.desc("ratio"), "word").limit(TOXIC).collect()]
    common = [r.word for r in judged.where("odds <= 7").orderBy(F.desc("b"), "word").limit(COMMON).collect()]
    joined = lambda ws: (" " + " ".join(reversed(ws)) + " ").encode()
    plain = joined(common)
    model = Model(plain, joined(over) + plain, (0.0, 0.0, 0.0))
    found = _features(rows.where("part = 0"), model).select("toxic", "per_window", "most").collect()
    rows.unpersist()
    seen.unpersist()
    y = np.array([r.toxic for r in found], float)
    if len(y) == 0 or y.min() == y.max():
        return Model(model.ordinary, model.toxic, (-3.0, 1.0, 0.5))
    real = {c: counts[c] / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, real[1], real[0])
    x = np.array([[r.per_window, r.most] for r in found])
    return Model(model.ordinary, model.toxic, logistic(x, y, weight * len(y) / weight.sum()))


def toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1) and predicted (1 if the score is 0.5 or more).

    A null text is scored as an empty one. Ids may be null or repeated, and repeated rows are scored alike; an
    empty table gives an empty result; other columns are not looked at. Whole texts are compressed, window by
    window, so a very long one takes time in proportion and no more memory than itself.
    """
    require_columns(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    a, b, c = model.weights
    z = F.lit(a) + F.col("per_window") * b + F.col("most") * c
    scored = _features(rows, model).select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))
    return scored.select("doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that are not predicted toxic.

    Null and empty texts are judged as empty. Repeated rows go or stay alike; an empty table gives an empty
    result; ids and other columns are not looked at. Whole texts are judged, however long.
    """
    require_columns(docs, text_col)

    @F.arrow_udf("boolean")
    def harmless(texts: pa.Array) -> pa.Array:
        ordinary, toxic = model.compressors()
        parts = [[saved(t.as_py(), ordinary, toxic) for t in texts.slice(k, AT_ONCE)] for k in range(0, len(texts), AT_ONCE)]
        return pa.array(model.score(np.array([x for p in parts for x in p]).reshape(-1, 2)) < 0.5)

    return docs.where(harmless(F.col(text_col)))  # only texts go to Python; the rows stay where they are

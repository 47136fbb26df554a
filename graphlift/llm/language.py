"""Language identification: word frequencies first, shorter and shorter character n-grams for unseen words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Remembered
from .common import require_columns

#: Documents of a language that a model is fitted on, about: those whose id has a small enough hash; all, if fewer.
SAMPLE = 3000
#: Most words, and most n-grams of each length, that a model keeps: the most frequent over all languages.
WORDS, GRAMS = 100_000, 30_000
#: Longest n-gram; words carry a mark at either end.
LONGEST = 5
BEGIN, END = "\x02", "\x03"

letters = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: tuple[float, ...]
    words: dict[str, tuple[float, ...]]  # log frequency in each language
    grams: tuple[dict[str, tuple[float, ...]], ...]  # by length, from 1


def grams_of(word: str, n: int) -> list[str]:
    marked = BEGIN + word + END
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Guesser:
    def __init__(self, model: Model):
        self.model, self.n = model, len(model.languages)
        self.memo = Remembered(lambda w: np.array(self.word(w), np.float32).tobytes())

    def word(self, word: str) -> tuple[float, ...] | list[float]:
        """Log weights of one word: its own, if it is known, else the mean of its longest known n-grams."""
        if (known := self.model.words.get(word)) is not None:
            return known
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            table = self.model.grams[n - 1]
            if found := [v for g in grams_of(word, n) if (v := table.get(g)) is not None]:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * self.n

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = letters(text.lower()) if text else []
        if not self.n or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        total = np.frombuffer(b"".join(map(self.memo.__getitem__, words)), np.float32).reshape(-1, self.n).sum(axis=0, dtype=np.float64) + self.model.prior
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def _log_table(rows: list, languages: tuple[str, ...], totals: list[float]) -> dict[str, tuple[float, ...]]:
    at = {x: i for i, x in enumerate(languages)}
    counts: dict[str, list[float]] = {}
    for r in rows:
        counts.setdefault(r.unit, [0.0] * len(languages))[at[r.lang]] += r.n
    return {u: tuple(math.log((c + 0.5) / (t + 1)) for c, t in zip(cs, totals, strict=True)) for u, cs in counts.items()}


def train(docs: DataFrame, *, sample: int = SAMPLE) -> Model:
    """docs (doc_id, text, lang): about ``sample`` documents of a language; nulls in any of the three are passed over.

    Frequencies are taken on Spark; the model holds at most WORDS words and GRAMS n-grams of each length.
    """
    known = docs.where("doc_id is not null and text is not null and lang is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("docs"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("docs").cast("double") < F.lit(float(sample << 30))
    picked = known.select("doc_id", "lang").join(counts, "lang").where(drawn).select("doc_id").distinct()
    ids = picked.count()
    picked = F.broadcast(picked) if ids <= 100_000 else picked
    words = (
        known.join(picked, "doc_id", "left_semi")
        .select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("unit"))
        .where("unit <> ''").groupBy("lang", "unit").agg(F.count("*").alias("n")).cache()
    )
    size = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = tuple(sorted(size))

    def table(units: DataFrame, most: int) -> dict[str, tuple[float, ...]]:
        top = units.groupBy("unit").agg(F.sum("n").alias("all")).where("all >= 3").orderBy(F.desc("all"), "unit").limit(most).select("unit")
        rows = units.join(F.broadcast(top), "unit").select("lang", "unit", "n").collect()
        totals = {r.lang: r.n for r in units.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        return _log_table(rows, languages, [totals.get(x, 0) for x in languages])

    by_length = []
    marked = words.select("lang", "n", F.concat(F.lit(BEGIN), "unit", F.lit(END)).alias("w"))
    for n in range(1, LONGEST + 1):
        cut = F.expr(f"transform(sequence(1, length(w) - {n - 1}), i -> substring(w, i, {n}))")
        by_length.append(table(marked.where(F.length("w") >= n).select("lang", "n", F.explode(cut).alias("unit")).groupBy("lang", "unit").agg(F.sum("n").alias("n")), GRAMS))
    model = Model(languages, tuple(math.log((size[x] + 1) / (sum(size.values()) + 1)) for x in languages), table(words, WORDS), tuple(by_length))
    words.unpersist()
    return model


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (0 to 1).

    A null text, or one without a letter, is ``und`` with score 0. Any other has the most likely learned
    language; ties go to the first by name. Whole texts are judged, however long. Ids may be null or repeated,
    and repeated rows are judged alike; an empty table gives an empty result; other columns are not looked
    at. A model without languages finds ``und`` everywhere.
    """
    require_columns(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Guesser(shared.value)
        for b in batches:
            found = [of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return rows.mapInArrow(guess, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")

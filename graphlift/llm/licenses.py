"""Licence scans by a positional index of rare licence words, in DataFrame functions only.

Base phrases are found word by word. For each template whose key phrases all stand in a text, the method then
looks up the rarest words that text and template share (by inverse document frequency over all documents) in
the template's postings; words that stand as far apart as in the template agree on where it would begin. A
template whose words agree well enough gives its label. Templates don't compete: other licences in the text
change nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, require_columns

#: What stands between words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label: (text, key phrases, which all must stand in a text).
TEMPLATES = {
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    "gpl-2.0": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2", ("gnu general public license", "version 2", "free software foundation")),
    "lgpl-3.0": ("this library is licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "mit": ("released under the mit license", ("mit license",)),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc0-1.0": ("licensed under cc0 1 0 universal public domain dedication", ("cc0 1 0", "public domain dedication")),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
}

#: One of these, each within one word, is in every text in which a base phrase or all key phrases of a template can stand.
CUES = ("license", "cc", "redistribution", "hereby", "unencumbered")
#: Distinct words looked up per text and template, and the share of their weight in the template that must agree.
LOOKED_UP, AGREEING = 12, 0.6


def words_of(low: Column) -> Column:
    return F.array_remove(F.split(low, SEPARATOR), "")


def _starts(words: Column, phrase: str) -> Column:
    """Places (from 0) where the words of the phrase stand consecutively."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    first = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (F.get(words, i) == parts[0]) & (i <= last))
    return F.filter(first, lambda i: _all(F.get(words, i + k) == part for k, part in enumerate(parts[1:], 1)))


def idf(rows: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every template word over all rows (low)."""
    vocabulary = sorted({w for text, _ in TEMPLATES.values() for w in text.split()})
    found = F.array_distinct(F.filter(words_of(F.col("low")), lambda w: w.isin(vocabulary)))
    seen = {r.word: r.df for r in rows.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}
    total = rows.count()
    return {w: math.log((total + 1) / (seen.get(w, 0) + 0.5)) for w in vocabulary}


def _rarest_first(text: str, weight: dict[str, float]) -> list[str]:
    return sorted(set(text.split()), key=lambda w: (-weight[w], w))


def _postings(spark: SparkSession, weight: dict[str, float]) -> DataFrame:
    """(word, template, at, share): share is the word's part of the weight that the template's rarest words have."""
    rows = []
    for label, (text, _) in TEMPLATES.items():
        words = text.split()
        rarest = _rarest_first(text, weight)[:LOOKED_UP]
        whole = sum(weight[w] for w in words if w in rarest)
        rows += [(w, label, at, weight[w] / whole) for at, w in enumerate(words)]
    return spark.createDataFrame(rows, "word string, template string, at int, share double")


def template_labels(texts: DataFrame, weight: dict[str, float]) -> DataFrame:
    """texts (k1, k2, words), keys unique: (k1, k2, found, score) of those that a template fits."""
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    stand = [
        F.when(
            _all(line.contains(f" {k} ") for k in keys),
            F.struct(F.lit(label).alias("template"), F.slice(F.array_intersect(F.lit(_rarest_first(text, weight)), "words"), 1, LOOKED_UP).alias("rare")),
        )
        for label, (text, keys) in TEMPLATES.items()
    ]
    looked = texts.select("k1", "k2", "words", F.explode(F.array_compact(F.array(*stand))).alias("stand"))
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: F.array_contains("stand.rare", x["word"]))
    hits = looked.select("k1", "k2", "stand.template", F.explode(places).alias("hit")).select("k1", "k2", "template", "hit.word", "hit.pos")
    met = hits.join(_postings(texts.sparkSession, weight), ["template", "word"])
    agree = met.groupBy("k1", "k2", "template", (F.col("pos") - F.col("at")).alias("begin")).agg(F.least(F.sum("share"), F.lit(1.0)).alias("share"))
    best = agree.groupBy("k1", "k2", "template").agg(F.max("share").alias("share")).where(F.col("share") >= AGREEING)
    return best.groupBy("k1", "k2").agg(F.collect_set("template").alias("found"), F.round(F.max("share"), 6).alias("score"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text counts as empty; a text without licence words has no places, null first_word and last_word,
    empty labels and score 0. The score is the greatest share of a template's weight that agrees, among the
    templates that give labels; with base labels alone it is 0. Ids may be null or repeated; equal texts are
    looked up once and have equal labels. An empty table gives an empty result. Other columns are not
    looked at. Whole texts are read; only texts with a cue are looked up, and no other can have a label.
    """
    require_columns(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("low"))
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.col("low").contains(c)
    nothing = {"n_base": "0L", "first_word": "cast(null as long)", "last_word": "cast(null as long)", "base_labels": "''", "labels": "''", "score": "0D"}
    plain = rows.where(~cue).select("doc_id", F.size(words_of(F.col("low"))).cast("long").alias("n_words"), *[F.expr(v).alias(k) for k, v in nothing.items()])

    keyed = rows.where(cue).select("doc_id", F.xxhash64("low").alias("k1"), F.xxhash64(F.lit(1), "low").alias("k2"), words_of(F.col("low")).alias("words"))
    texts = keyed.dropDuplicates(["k1", "k2"]).select("k1", "k2", "words")
    found = template_labels(texts, idf(rows))
    starts = keyed.select("doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"), *[_starts(F.col("words"), phrase).alias(label) for phrase, label in BASE.items()])
    every = F.flatten(F.array(*[F.col(f"`{x}`") for x in BASE.values()]))
    base = F.array_compact(F.array(*[F.when(F.size(F.col(f"`{x}`")) > 0, F.lit(x)) for x in BASE.values()]))
    cued = starts.select("doc_id", "k1", "k2", "n_words", every.alias("every"), base.alias("base")).join(found, ["k1", "k2"], "left")
    judged = cued.select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return plain.unionByName(judged)

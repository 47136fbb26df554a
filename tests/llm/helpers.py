import re

import pandas as pd
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

#: Extra columns whose names an operator could use itself.
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
        T.StructField("node", T.LongType()), T.StructField("n", T.StringType()), T.StructField("low", T.StringType()),
    ]
)


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1]), "x", 1, "y", "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words5(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")

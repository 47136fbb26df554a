"""Token counts of whole texts by heap-and-linked-list byte-pair merging; no ids are made."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TokenCounter
from .common import require_columns


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``vocabulary`` is the path of a byte-level BPE .json file, the same on every executor. A null text
    counts as empty (0 bytes, 0 tokens); ids may be null or repeated and are passed on as they are;
    an empty table gives an empty result; other columns are not looked at. A task holds one batch of
    texts and a bounded memory of words; a text of any length is counted whole.
    """
    require_columns(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [tokens(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(count, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")

"""Token ids of whole texts and the texts they decode to, by tree concatenation of byte-pair encodings."""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_tree import word_bpe
from .common import require_columns, stored

#: A text of more characters is encoded in parts of so many symbols, by several tasks.
LONG = 2**18
#: Rows that go back to Spark at once.
_SLICE = 256


def encode_texts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """One row per row of docs: doc_id, ids (binary, little-endian unsigned 32-bit integers), decoded (string).

    ``vocabulary`` is the path of a tokenizers .json file with a word-level BPE model that drops white
    space, the same on every executor. Ids are the library's without added special tokens, truncation
    or padding; special strings in a text are special tokens; ``decoded`` is the library's decode of
    them, special tokens kept. A null text counts as empty: no ids, an empty ``decoded``. Ids of
    documents may be null or repeated and are passed on; an empty table gives an empty result; other
    columns are not looked at.

    A text of at most ``long`` characters is encoded by the task that reads it. A longer one is cut
    into parts, inside words too; tasks encode the parts on their own, and one task joins them in
    order, holding that text's ids. Copies of a long text are encoded once.
    """
    require_columns(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, _SLICE):
                b = batch.slice(i, _SLICE)
                found = [model.encode(t.as_py()) for t in b.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([_little(x.ids) for x in found], pa.binary()), pa.array([x.text for x in found], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    short = rows.where(F.char_length("text") <= long).mapInArrow(encode, f"doc_id {kind}, ids binary, decoded string")
    big = stored(rows.where(F.char_length("text") > long).withColumn("key", F.sha2("text", 256)), "long-texts")
    whole = _by_parts(big.select("key", "text").dropDuplicates(["key"]), vocabulary, long)
    return short.unionByName(big.select("doc_id", "key").join(whole, "key").select("doc_id", "ids", "decoded"))


def _little(ids: bytes) -> bytes:
    if sys.byteorder == "little":
        return ids
    turned = array("I", ids)
    turned.byteswap()
    return turned.tobytes()


def _by_parts(texts: DataFrame, vocabulary: str, size: int) -> DataFrame:
    """(key, text) with distinct keys -> (key, ids, decoded)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(vocabulary)
        for b in batches:
            for key, text in zip(b.column("key"), b.column("text")):
                for i, (pieces, continues, unfinished) in enumerate(model.parts(text.as_py(), size)):
                    yield pa.RecordBatch.from_pydict(
                        {"key": [key.as_py()], "i": pa.array([i], pa.int32()), "pieces": [json.dumps(pieces)], "continues": [continues], "unfinished": [unfinished]}
                    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(vocabulary)
        for b in batches:
            for r in b.to_pylist():
                groups = model.part(json.loads(r["pieces"]), r["continues"], r["unfinished"])
                inner = r["continues"] and r["unfinished"] and not groups[1] and not groups[2]
                yield pa.RecordBatch.from_pydict(
                    {"key": [r["key"]], "i": pa.array([r["i"]], pa.int32()), "inner": [inner]} | {c: [array("I", g).tobytes()] for c, g in zip(("head", "ids", "tail"), groups)}
                )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at, ids, begun = word_bpe(vocabulary), None, array("I"), []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": [at], "ids": [_little(ids.tobytes())], "decoded": [model.decoded(ids)]})

        for b in batches:
            for r in b.to_pylist():
                if r["key"] != at:
                    if at is not None:
                        yield row()
                    at, ids, begun = r["key"], array("I"), []
                begun = model.joined(begun, array("I", r["head"]).tolist())
                if not r["inner"]:
                    ids.extend(begun)
                    ids.frombytes(r["ids"])
                    begun = array("I", r["tail"]).tolist()
        if at is not None:
            yield row()

    parts = texts.mapInArrow(cut, "key string, i int, pieces string, continues boolean, unfinished boolean").repartition("key", "i")
    parts = parts.mapInArrow(encode, "key string, i int, inner boolean, head binary, ids binary, tail binary")
    return parts.repartition("key").sortWithinPartitions("key", "i").mapInArrow(join, "key string, ids binary, decoded string")


def encoding_digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the UTF-8 bytes), both as lower-case hex."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

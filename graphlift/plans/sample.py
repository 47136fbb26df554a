"""The test tables declared as a relational source, with three tables derived from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_parquet
from ..sources.source import ForeignKey, Source

FILES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

TRADE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

PRIMARY_KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"),
    "conversation": ("conv_id",),
    "flagged_document": ("doc_id",),
    "supplier_part": ("suppkey", "partkey"),
}

FOREIGN_KEYS = (
    ForeignKey("nation_region", "nation", "n_regionkey", "region", "r_regionkey"),
    ForeignKey("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ForeignKey("supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ForeignKey("orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ForeignKey("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ForeignKey("lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ForeignKey("events_customer", "events", "user_id", "customer", "c_custkey"),
    ForeignKey("labels_documents", "labels", "doc_id", "documents", "doc_id"),
    ForeignKey("flagged_labels", "flagged_document", "doc_id", "labels", "doc_id"),
    ForeignKey("conversations_conversation", "conversations", "conv_id", "conversation", "conv_id"),
    ForeignKey("supplier_part_supplier", "supplier_part", "suppkey", "supplier", "s_suppkey"),
    ForeignKey("supplier_part_part", "supplier_part", "partkey", "part", "p_partkey"),
)

SQL_TYPES = {("events", "props"): "json"}


def sample_source(spark: SparkSession, directory: str, names: Iterable[str] = TRADE, *, declare_not_null: bool = True) -> Source:
    """The named tables with their declared keys.

    ``conversation``, ``flagged_document`` and ``supplier_part`` are derived: the owner of the
    turns, a subclass of a subclass, and a junction table.
    """
    names = list(names)
    base = {"conversation": "conversations", "flagged_document": "labels", "supplier_part": "lineitem"}
    files = read_parquet(spark, directory, dict.fromkeys(base.get(n, n) for n in names))
    tables = {}
    for n in names:
        df = files[base.get(n, n)]
        if n == "conversation":
            df = df.select("conv_id").distinct()
        elif n == "flagged_document":
            df = df.where("toxic = 1").select("doc_id")
        elif n == "supplier_part":
            df = df.groupBy(F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("partkey")).agg(
                F.sum("l_quantity").alias("qty")
            )
        tables[n] = df
    keys = {t: k for t, k in PRIMARY_KEYS.items() if t in tables}
    fks = tuple(fk for fk in FOREIGN_KEYS if fk.table in tables and fk.ref_table in tables)
    required = {t: tuple(dict.fromkeys((*k, *(c for fk in fks if fk.table == t for c in fk.columns)))) for t, k in keys.items()}
    return Source(
        spark,
        tables,
        primary_keys=keys,
        foreign_keys=fks,
        not_null=required if declare_not_null else {},
        sql_types={k: v for k, v in SQL_TYPES.items() if k[0] in tables},
        name="sample",
    )

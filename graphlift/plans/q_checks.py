"""Registered queries on validation, each with its SQL.

The data has no orphans and no nulls, so the checks run on sources or graphs from which a part of
the parents was taken away.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import checks as CK
from ..sources.source import ForeignKey, Source, union_all
from .build import GraphMapping, build_graph, merge_inheritance
from .q_graph import LABEL, SEGMENT, composite_source, translated_source
from .q_semantics import IN_TRADE, rel
from .sample import TRADE, sample_source

WITH_JUNCTION = (*TRADE, "supplier_part")


def _without_customers(spark: SparkSession, d: str, **options) -> tuple[Source, Graph]:
    """A graph whose customer nodes are one segment only, edges kept as the rows have them."""
    s = sample_source(spark, d)
    g = build_graph(s, assume_complete=True, **options)
    return s, g.with_nodes("Customer", g.nodes["Customer"].where(f"cMktsegment = '{SEGMENT}'"))


def tables_without_key(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d)
    s = replace(s, primary_keys={t: k for t, k in s.primary_keys.items() if t not in ("lineitem", "orders")})
    return CK.tables_without_key(s).join(s.row_counts(), "table_name")


def dangling_foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    """The part and supplier tables are missing; rows concerned are counted."""
    s = sample_source(spark, d)
    s = replace(s, tables={t: df for t, df in s.tables.items() if t not in ("part", "supplier")})
    bad = [fk for fk in s.foreign_keys if fk.table in s.tables]
    counts = s["lineitem"].selectExpr(*[f"count({fk.column}) AS {fk.name}" for fk in bad if fk.table == "lineitem"])
    counts = counts.unpivot([], counts.columns, "fk_name", "n_rows")
    return CK.dangling_foreign_keys(s).join(counts, "fk_name")


def source_statistics(spark: SparkSession, d: str) -> DataFrame:
    return CK.source_statistics(sample_source(spark, d, WITH_JUNCTION))


def count_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return CK.reconcile_counts(*_without_customers(spark, d))


def merged_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents, labels and flagged ones as one node each, and then only some tables chosen: nothing is amiss, so all match."""
    s = sample_source(spark, d, ["documents", "labels", "flagged_document", "conversation", "conversations"])
    merged = CK.reconcile_counts(s, merge_inheritance(build_graph(s)))
    chosen = CK.reconcile_counts(s, build_graph(s, mapping=GraphMapping(tables_as_nodes=("documents", "conversation"))))
    return merged.selectExpr("'merged' AS graph", "*").unionByName(chosen.selectExpr("'chosen' AS graph", "*"))


def no_foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every check of a source that declares nothing but two keys."""
    s = sample_source(spark, d, ["region", "nation"], declare_not_null=False)
    s = replace(s, foreign_keys=())
    g = build_graph(s)
    counts = [
        ("instances", CK.instance_counts(s, g)), ("orphans", CK.orphan_rows(s)), ("required", CK.required_properties(s)),
        ("missing", CK.missing_nodes(g)), ("findings", CK.findings(s, g)), ("nodes", g.all_nodes),
    ]
    return union_all(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, df in counts)


def target_totals(spark: SparkSession, d: str) -> DataFrame:
    return CK.target_totals(build_graph(sample_source(spark, d, WITH_JUNCTION)))


def relationship_counts(spark: SparkSession, d: str) -> DataFrame:
    """No nation is left, so the types that end there are empty."""
    s = sample_source(spark, d)
    return CK.relationship_counts(build_graph(s.with_tables(nation=s["nation"].where("n_name = 'none'"))))


def missing_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers are one segment and half of the orders are gone."""
    _, g = _without_customers(spark, d)
    g = g.with_nodes("Orders", g.nodes["Orders"].where("oOrderstatus <> 'O'"))
    return CK.missing_nodes(g)


def missing_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys of two columns and keys that are translated: nothing is missing as built, and what is taken away is found."""
    frames = []
    for name, s, label, test in (
        ("composite", composite_source(spark, d), "SupplierPart", "qty > 30"),
        ("translated", translated_source(spark, d), "Customer", "cAcctbal > 0"),
    ):
        g = build_graph(s)
        for case, graph in (("as built", g), ("part", g.with_nodes(label, g.nodes[label].where(test)))):
            frames.append(CK.missing_nodes(graph).selectExpr(f"'{name} {case}' AS graph", "*"))
    return union_all(frames)


def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    s, g = _without_customers(spark, d)
    extra = ForeignKey("orders_clerk", "orders", "o_orderpriority", "clerk", "k_name")
    s = replace(s, foreign_keys=(*s.foreign_keys, extra))
    return CK.validation_summary(CK.findings(s, g))


def findings(spark: SparkSession, d: str) -> DataFrame:
    return CK.findings(*_without_customers(spark, d))


def instance_counts(spark: SparkSession, d: str) -> DataFrame:
    """Foreign keys against edges where the build had to drop those without a customer."""
    s = sample_source(spark, d)
    s = s.with_tables(customer=s["customer"].where(f"c_mktsegment = '{SEGMENT}'"))
    return CK.instance_counts(s, build_graph(s))


def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, [*TRADE, "events"])
    s = s.with_tables(
        customer=s["customer"].where(f"c_mktsegment = '{SEGMENT}'"), supplier=s["supplier"].where("s_acctbal > 0")
    )
    return CK.orphan_rows(s)


QUERIES = {
    "e1_tables_without_key": tables_without_key,
    "e2_dangling_foreign_keys": dangling_foreign_keys,
    "e3_source_statistics": source_statistics,
    "e4_count_reconciliation": count_reconciliation,
    "e4_merged_counts": merged_counts,
    "e5_target_totals": target_totals,
    "e6_relationship_counts": relationship_counts,
    "e7_missing_nodes": missing_nodes,
    "e7_missing_by_key": missing_by_key,
    "e8_validation_summary": validation_summary,
    "e8_findings": findings,
    "e9_instance_counts": instance_counts,
    "e9_no_foreign_keys": no_foreign_keys,
    "e10_orphan_rows": orphan_rows,
}


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _count(source: str) -> str:
    return f"(SELECT count(*) FROM {source})"


_KEPT = f"(SELECT c_custkey FROM customer WHERE c_mktsegment = '{SEGMENT}')"
_LOST_CUSTOMERS = f"(SELECT count(*) FROM customer WHERE c_mktsegment <> '{SEGMENT}')"
_EDGES = " + ".join(_count(m[1]) for m in IN_TRADE)

ORACLES = {
    "e1_tables_without_key": _union(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("lineitem", "orders")),
    "e2_dangling_foreign_keys": _union(
        f"SELECT '{k}' AS fk_name, 'lineitem' AS table_name, '{c}' AS column_name, '{t}' AS ref_table, count({c}) AS n_rows FROM lineitem"
        for k, c, t in (("lineitem_part", "l_partkey", "part"), ("lineitem_supplier", "l_suppkey", "supplier"))
    ),
    "e3_source_statistics": f"""
        SELECT CAST(8 AS BIGINT) AS total_tables, CAST({" + ".join(_count(rel(t)) for t in WITH_JUNCTION)} AS BIGINT) AS total_rows,
               CAST(7 AS BIGINT) AS entity_tables, CAST(1 AS BIGINT) AS junction_tables""",
    "e4_count_reconciliation": _union(
        f"SELECT '{t}' AS table_name, '{LABEL[t]}' AS label, count(*) AS source_count, "
        f"count(*) - {lost} AS target_count, -{lost} AS difference, {lost} = 0 AS is_match FROM {t}"
        for t, lost in ((t, _LOST_CUSTOMERS if t == "customer" else "CAST(0 AS BIGINT)") for t in TRADE)
    ),
    "e4_merged_counts": _union(
        f"SELECT '{g}' AS graph, '{label}' AS label, '{t}' AS table_name, n AS source_count, n AS target_count, CAST(0 AS BIGINT) AS difference, "
        f"true AS is_match FROM (SELECT count({what}) AS n FROM {x})"
        for g, label, t, what, x in (
            ("merged", "Documents", "documents", "*", "documents"), ("merged", "Labels", "labels", "*", "labels"),
            ("merged", "FlaggedDocument", "flagged_document", "*", "labels WHERE toxic = 1"),
            ("merged", "Conversation", "conversation", "DISTINCT conv_id", "conversations"),
            ("merged", "Conversations", "conversations", "*", "conversations"),
            ("chosen", "Documents", "documents", "*", "documents"),
            ("chosen", "Conversation", "conversation", "DISTINCT conv_id", "conversations"),
        )
    ),
    "e5_target_totals": f"""
        SELECT 'total_nodes' AS statistic, CAST({" + ".join(_count(t) for t in TRADE)} AS BIGINT) AS value
        UNION ALL SELECT 'total_relationships', CAST({_EDGES} + {_count(rel("supplier_part"))} AS BIGINT)
        UNION ALL SELECT 'node_labels', 7 UNION ALL SELECT 'relationship_types', 8""",
    "e6_relationship_counts": _union(
        f"SELECT '{m[5]}' AS rel_type, '{LABEL[m[1]]}' AS from_label, '{LABEL[m[3]]}' AS to_label, {n} AS n, {n} = 0 AS is_empty"
        for m, n in ((m, "CAST(0 AS BIGINT)" if "nation" in (m[1], m[3]) else _count(m[1])) for m in IN_TRADE)
    ),
    "e7_missing_nodes": f"""
        SELECT 'PURCHASED_BY' AS rel_type, 'Orders' AS from_label, 'Customer' AS to_label, 'to' AS missing, count(*) AS n
        FROM orders WHERE o_custkey NOT IN {_KEPT}
        UNION ALL SELECT 'PURCHASED_BY', 'Orders', 'Customer', 'from', count(*) FROM orders WHERE o_orderstatus = 'O'
        UNION ALL SELECT 'PART_OF_ORDERS', 'Lineitem', 'Orders', 'to', count(*)
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'
        UNION ALL SELECT 'PART_OF_NATION', 'Customer', 'Nation', 'from', count(*) FROM customer WHERE c_mktsegment <> '{SEGMENT}'""",
    "e7_missing_by_key": f"""
        SELECT 'composite part' AS graph, 'PART_OF_SUPPLIERPART' AS rel_type, 'Lineitem' AS from_label, 'SupplierPart' AS to_label, 'to' AS missing, count(*) AS n
        FROM lineitem JOIN {rel("supplier_part")} ON suppkey = l_suppkey AND partkey = l_partkey WHERE qty > 20 AND qty <= 30 HAVING count(*) > 0
        UNION ALL SELECT 'translated part', 'PURCHASED_BY', 'Orders', 'Customer', 'to', count(*) FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment = '{SEGMENT}' AND c_name <> 'Customer#5' AND c_acctbal <= 0 HAVING count(*) > 0
        UNION ALL SELECT 'translated part', 'PART_OF_NATION', 'Customer', 'Nation', 'from', count(*) FROM customer
        WHERE c_mktsegment = '{SEGMENT}' AND c_acctbal <= 0 HAVING count(*) > 0""",
    "e8_validation_summary": f"""
        SELECT 'pre' AS phase, 'FAILED' AS status, CAST(1 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS warnings
        UNION ALL SELECT 'post', 'FAILED',
            CAST({_LOST_CUSTOMERS} > 0 AS BIGINT) * 2 + CAST((SELECT count(*) FROM orders WHERE o_custkey NOT IN {_KEPT}) > 0 AS BIGINT), 0""",
    "e8_findings": f"""
        SELECT 'post' AS phase, 'error' AS severity, 'row_count_mismatch' AS check_name, 'Customer' AS subject, {_LOST_CUSTOMERS} AS n
        UNION ALL SELECT 'post', 'error', 'missing_node', 'PART_OF_NATION', {_LOST_CUSTOMERS}
        UNION ALL SELECT 'post', 'error', 'missing_node', 'PURCHASED_BY', count(*) FROM orders WHERE o_custkey NOT IN {_KEPT}""",
    "e9_instance_counts": _union(
        f"SELECT '{m[0]}' AS fk_name, a AS instances, b AS edges, a = b AS is_match FROM (SELECT count({m[2]}) AS a, "
        f"{f'count(*) FILTER (WHERE o_custkey IN {_KEPT})' if m[0] == 'orders_customer' else 'count(*)'} AS b FROM {source})"
        for m, source in (
            (m, f"(SELECT * FROM customer WHERE c_mktsegment = '{SEGMENT}')" if m[1] == "customer" else m[1]) for m in IN_TRADE
        )
    ),
    "e9_no_foreign_keys": """
        SELECT 'instances' AS what, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'orphans', 0 UNION ALL SELECT 'required', 0
        UNION ALL SELECT 'missing', 0 UNION ALL SELECT 'findings', 0
        UNION ALL SELECT 'nodes', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation)""",
    "e10_orphan_rows": _union(
        f"SELECT '{k}' AS fk_name, count(*) AS orphan_rows, count(DISTINCT {c}) AS orphan_values FROM {t} WHERE {c} NOT IN ({p})"
        for k, t, c, p in (
            *[
                (m[0], f"(SELECT * FROM customer WHERE c_mktsegment = '{SEGMENT}')" if m[1] == "customer"
                 else "(SELECT * FROM supplier WHERE s_acctbal > 0)" if m[1] == "supplier" else m[1], m[2],
                 f"SELECT c_custkey FROM customer WHERE c_mktsegment = '{SEGMENT}'" if m[3] == "customer"
                 else "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0" if m[3] == "supplier" else f"SELECT {m[4]} FROM {m[3]}")
                for m in IN_TRADE
            ],
            ("events_customer", "events", "user_id", f"SELECT c_custkey FROM customer WHERE c_mktsegment = '{SEGMENT}'"),
        )
    ),
}

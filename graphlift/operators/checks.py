"""Reconciling a graph with its source. Every check is a DataFrame of findings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import fk_value, literal
from ..graph import Graph
from ..sources.source import ForeignKey, Source, local_frame, no_rows, union_all
from .edges import missing_endpoints
from .match import edge_counts, node_counts
from .profile import orphan_values
from .semantics import junction_flags

def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


# -- before the build -------------------------------------------------------------------------


def tables_without_key(source: Source, *, rule: str = "shared_key") -> DataFrame:
    """Entity tables without a primary key (warning)."""
    return (
        junction_flags(source, rule=rule)
        .where("NOT is_junction")
        .select("table_name")
        .join(source.cat_keys().where("is_primary"), "table_name", "left_anti")
    )


def dangling_foreign_keys(source: Source) -> DataFrame:
    """Foreign keys to a table that is not there (error)."""
    known = source.cat_tables().select(F.col("table_name").alias("ref_table"))
    return source.cat_fks().join(known, "ref_table", "left_anti").select("fk_name", "table_name", "column_name", "ref_table")


def source_summary(source: Source, *, rule: str = "shared_key") -> DataFrame:
    """One row of totals: tables, entity and junction tables, columns, keys, rows."""
    tables = junction_flags(source, rule=rule).join(source.row_counts(), "table_name")
    indexes = source.cat_keys().where("NOT is_primary").groupBy("table_name").agg(_n())
    return tables.join(indexes, "table_name", "left").agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if(~F.col("is_junction")).alias("entity_tables"),
        F.count_if("is_junction").alias("junction_tables"),
        F.sum("n_columns").alias("total_columns"),
        F.sum(F.size("fk_columns")).alias("total_foreign_keys"),
        F.sum(F.coalesce("n", F.lit(0))).alias("total_indexes"),
        F.sum("row_count").alias("total_rows"),
        F.count_if(F.col("row_count") > 0).alias("tables_with_data"),
    )


def source_statistics(source: Source, *, rule: str = "shared_key") -> DataFrame:
    """Totals of the pre-check."""
    return source_summary(source, rule=rule).select("total_tables", "total_rows", "entity_tables", "junction_tables")


# -- after the build --------------------------------------------------------------------------


def label_counts(graph: Graph) -> DataFrame:
    """``(node_set, label, n)``: nodes that carry a label, where a node of a merged hierarchy carries several."""
    frames = []
    for name, df in graph.nodes.items():
        if "labels" in df.columns:
            counts = df.select(F.explode("labels").alias("label")).groupBy("label").agg(_n())
        else:
            counts = df.agg(_n()).select(F.lit(name).alias("label"), "n")
        frames.append(counts.select(F.lit(name).alias("node_set"), "label", "n"))
    return union_all(frames, empty=no_rows(graph.source.spark, node_set=pa.string(), label=pa.string(), n=pa.int64()))


def reconcile_counts(source: Source, graph: Graph) -> DataFrame:
    """Rows of the tables that became nodes against nodes with their label; ``difference`` is target - source.

    The graph's own plan says which tables these are and where their rows went: under a root after
    ``merge_inheritance``, together where tables share a label (their names are then joined by
    commas), nowhere for tables that were not chosen. A label that no table accounts for has no source.
    """
    placed = local_frame(
        source.spark, [("table_name", pa.string()), ("node_set", pa.string()), ("label", pa.string())], [(t, *at) for t, at in graph.tables.items()]
    )
    rows = (
        source.only(graph.tables).row_counts().join(placed, "table_name").groupBy("node_set", "label")
        .agg(F.array_join(F.array_sort(F.collect_list("table_name")), ",").alias("table_name"), F.sum("row_count").alias("source_count"))
    )
    # A label that rows have from a superclass elsewhere is counted where that superclass is.
    planned = F.broadcast(placed.groupBy("node_set").agg(F.collect_set("label").alias("own")))
    target = label_counts(graph).join(planned, "node_set", "left").where("own IS NULL OR array_contains(own, label)")
    target = target.select("node_set", "label", F.col("n").alias("target_count"))
    zero = F.lit(0).cast("bigint")
    return (
        rows.join(target, ["node_set", "label"], "full_outer")
        .withColumn("source_count", F.coalesce("source_count", zero))
        .withColumn("target_count", F.coalesce("target_count", zero))
        .withColumn("difference", F.col("target_count") - F.col("source_count"))
        .withColumn("is_match", F.col("difference") == 0)
        .select("label", "table_name", "source_count", "target_count", "difference", "is_match")
    )


def target_totals(graph: Graph) -> DataFrame:
    """``(statistic, value)``: nodes, relationships, labels and types of the graph."""
    nodes = node_counts(graph).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    edges = graph.edges.agg(_n())
    model = graph.rel_types().select("rel_type", "from_label", "to_label").distinct().agg(_n())

    def row(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("statistic"), F.col("n").cast("bigint").alias("value"))

    labels = graph.labels.select("label").distinct().agg(_n())
    return union_all(
        [row("total_nodes", nodes), row("total_relationships", edges), row("node_labels", labels),
         row("relationship_types", model)]
    )


def relationship_counts(graph: Graph) -> DataFrame:
    """Edges per planned type; types without any count 0 and are warned about."""
    types = graph.rel_types().select("rel_type", "from_label", "to_label").distinct()
    keys = ["rel_type", "from_label", "to_label"]
    return (
        types.join(edge_counts(graph), keys, "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
        .withColumn("is_empty", F.col("n") == 0)
    )


def missing_nodes(graph: Graph) -> DataFrame:
    """Edges whose source or target node is missing: ``(rel_type, from_label, to_label, missing, n)``.

    The targets of a type are counted per key before they are looked up, so a hub costs one row
    per task and the lookup reuses the shuffle of the count.
    """
    keys = ["rel_type", "from_label", "to_label"]
    found = []
    for table, label in {e.fk.table: e.from_label for e in graph.edge_types}.items():
        # All types of a table start at the same nodes.
        lost = missing_endpoints(graph.edge_sets[table], graph.nodes[label], "from")
        found.append(lost.groupBy(*keys).agg(_n()).withColumn("missing", F.lit("from")))
    for e in graph.edge_types:
        edges = graph.edge_sets[e.fk.table].where(F.col("fk_name") == e.fk.name)
        lost = missing_endpoints(edges.groupBy("to_key").agg(_n()), graph.nodes[e.to_label], "to")
        found.append(
            lost.selectExpr(
                f"{literal(e.rel_type)} AS rel_type", f"{literal(e.from_label)} AS from_label",
                f"{literal(e.to_label)} AS to_label", "n", "'to' AS missing",
            )
        )
    for name in set(graph.edge_sets) - {e.fk.table for e in graph.edge_types}:
        edges = graph.edge_sets[name]
        for end in ("from", "to"):
            # One row per label that the user's edges begin or end at.
            for r in edges.select(F.col(f"{end}_label").alias("label")).distinct().collect():
                at = edges.where(F.col(f"{end}_label").eqNullSafe(F.lit(r.label)))
                lost = missing_endpoints(at, graph.nodes[r.label], end) if r.label in graph.nodes else at
                found.append(lost.groupBy(*keys).agg(_n()).withColumn("missing", F.lit(end)))
    if not found:
        return graph.edges.select(*keys, F.lit("from").alias("missing"), F.lit(0).cast("bigint").alias("n"))
    return union_all(found).groupBy(*keys, "missing").agg(F.sum("n").alias("n"))


def duplicate_keys(nodes: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Uniqueness per label: ``(label, duplicate_keys, surplus_rows)``.

    Rows are counted per key before they are shuffled, so a key that occurs a million times
    costs one row per task.
    """
    return union_all(
        df.groupBy(*[F.col(f"`{c}`") for c in key])
        .agg(_n())
        .where("n > 1")
        .agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))
        .select(F.lit(label).alias("label"), "duplicate_keys", "surplus_rows")
        for label, (df, key) in nodes.items()
    )


def required_properties(source: Source) -> DataFrame:
    """Nulls in columns declared NOT NULL: ``(table_name, column_name, null_count)``, one pass per table."""
    frames = []
    for t, df in source.tables.items():
        columns = [c for c in df.columns if source.is_not_null(t, c)]
        if not columns:
            continue
        nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
        frames.append(
            nulls.unpivot([], columns, "column_name", "null_count").select(F.lit(t).alias("table_name"), "column_name", "null_count")
        )
    return union_all(frames, empty=no_rows(source.spark, table_name=pa.string(), column_name=pa.string(), null_count=pa.int64()))


def instance_counts(source: Source, graph: Graph) -> DataFrame:
    """Non-null foreign keys against edges, per foreign key."""
    names = [e.fk for e in graph.edge_types]
    by_table: dict[str, list[ForeignKey]] = {}
    for fk in names:
        by_table.setdefault(fk.table, []).append(fk)
    frames = []
    for t, fks in by_table.items():
        counts = source[t].agg(*[_references(source, fk).alias(fk.name) for fk in fks])
        frames.append(counts.unpivot([], [fk.name for fk in fks], "fk_name", "instances"))
    edges = graph.edges.groupBy("fk_name").agg(F.count(F.lit(1)).alias("edges"))
    return (
        union_all(frames, empty=no_rows(source.spark, fk_name=pa.string(), instances=pa.int64()))
        .join(edges, "fk_name", "left")
        .withColumn("edges", F.coalesce("edges", F.lit(0).cast("bigint")))
        .withColumn("is_match", F.col("instances") == F.col("edges"))
    )


def _references(source: Source, fk: ForeignKey) -> Column:
    """Number of rows that refer to something; rows of a junction table need both ends."""
    ends = [fk] if fk in source.foreign_keys else source.fks_of(fk.table)
    known = " AND ".join(f"{fk_value(e.columns)} IS NOT NULL" for e in ends)
    return F.expr(f"count(CASE WHEN {known} THEN 1 END)")


def orphan_rows(source: Source, fks: Iterable[ForeignKey] | None = None) -> DataFrame:
    """Source rows whose parent is missing, with the distinct values concerned, per foreign key."""
    frames = (
        orphan_values(source, fk).selectExpr(
            f"{literal(fk.name)} AS fk_name", "coalesce(sum(n), 0) AS orphan_rows", "count(1) AS orphan_values"
        )
        for fk in (source.foreign_keys if fks is None else fks)
    )
    return union_all(frames, empty=no_rows(source.spark, fk_name=pa.string(), orphan_rows=pa.int64(), orphan_values=pa.int64()))


# -- summary ----------------------------------------------------------------------------------


def findings(source: Source, graph: Graph, *, rule: str = "shared_key") -> DataFrame:
    """All findings: ``(phase, severity, check_name, subject, n)``."""

    def rows(df: DataFrame, phase: str, severity: str, check: str, subject, n) -> DataFrame:
        return df.select(
            F.lit(phase).alias("phase"),
            F.lit(severity).alias("severity"),
            F.lit(check).alias("check_name"),
            subject.alias("subject"),
            n.cast("bigint").alias("n"),
        )

    one, col = F.lit(1), F.col
    return union_all(
        [
            rows(tables_without_key(source, rule=rule), "pre", "warning", "no_primary_key", col("table_name"), one),
            rows(dangling_foreign_keys(source), "pre", "error", "dangling_foreign_key", col("fk_name"), one),
            rows(
                reconcile_counts(source, graph).where("NOT is_match"),
                "post", "error", "row_count_mismatch", col("label"), F.abs("difference"),
            ),
            rows(relationship_counts(graph).where("is_empty"), "post", "warning", "empty_type", col("rel_type"), one),
            rows(missing_nodes(graph), "post", "error", "missing_node", col("rel_type"), col("n")),
        ]
    )


def validation_summary(found: DataFrame) -> DataFrame:
    """``(phase, status, errors, warnings)``; both phases are always listed."""
    phases = found.sparkSession.range(2).select(F.when(F.col("id") == 0, "pre").otherwise("post").alias("phase"))
    counts = found.groupBy("phase").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    zero = F.lit(0).cast("bigint")
    return phases.join(counts, "phase", "left").select(
        "phase",
        F.when(F.coalesce("errors", zero) > 0, "FAILED").otherwise("PASSED").alias("status"),
        F.coalesce("errors", zero).alias("errors"),
        F.coalesce("warnings", zero).alias("warnings"),
    )

"""Tables -> node DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions.types import graph_type
from ..functions.values import graph_value, literal, node_key, quoted
from ..sources.source import Source


def property_names(source: Source) -> dict[tuple[str, str], str]:
    """``(table, column) -> property``, resolved once for the whole catalog.

    The catalog is a local relation, so Spark folds the naming expression without a job.
    """
    rows = source.cat_columns().select("table_name", "column_name", F.expr(N.property_name("column_name")).alias("p")).collect()
    return {(r.table_name, r.column_name): r.p for r in rows}


def labels_of(source: Source) -> dict[str, str]:
    rows = source.cat_tables().select("table_name", F.expr(N.node_label("table_name")).alias("l")).collect()
    return {r.table_name: r.l for r in rows}


def table_nodes(
    source: Source,
    table: str,
    *,
    label: str,
    names: Mapping[tuple[str, str], str],
    keep_foreign_keys: bool = False,
) -> DataFrame:
    """Node rows of one table: ``node_key``, ``label`` and the properties.

    Foreign-key columns become edges and are dropped, except where they belong to the key.
    ``keep_foreign_keys`` keeps every column, as the enriched mode does.
    """
    df = source[table]
    key = source.primary_key(table)
    dropped = set() if keep_foreign_keys else {c for fk in source.fks_of(table) for c in fk.columns} - set(key)
    properties = [
        f"{graph_value(quoted(f.name), f.dataType, is_json=source.is_json(table, f.name))} AS {quoted(names[table, f.name])}"
        for f in df.schema.fields
        if f.name not in dropped
    ]
    return df.selectExpr(f"{node_key(df.schema, key)} AS node_key", f"{literal(label)} AS label", *properties)


def union_nodes(frames: Sequence[DataFrame]) -> DataFrame:
    """Nodes of several tables under one label. A property that some of them lack is null; of different types, it is text."""
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = {c for c, k in kinds.items() if len(k) > 1}
    first, *rest = [df.withColumns({c: F.col(quoted(c)).cast("string") for c in df.columns if c in mixed}) for df in frames]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def property_map(df: DataFrame) -> DataFrame:
    """Nodes as ``(node_key, label, properties)``: one JSON text per node, nulls stripped."""
    names = [c for c in df.columns if c not in ("node_key", "label")]
    return df.select("node_key", "label", F.to_json(F.struct(*names)).alias("properties"))


def property_count(df: DataFrame) -> Column:
    """Number of properties a node really has, nulls left out."""
    names = [c for c in df.columns if c not in ("node_key", "label")]
    return F.expr(" + ".join(f"int({quoted(c)} IS NOT NULL)" for c in names) or "0")


def merge_subclass(
    parent: DataFrame,
    child: DataFrame,
    *,
    parent_key: str,
    child_key: str,
    child_label: str,
    keep_orphans: bool = True,
    also: Sequence[str] = (),
) -> DataFrame:
    """Superclass and subclass rows as one node with both labels.

    ``labels`` grows by the subclass label where a row takes part. A subclass property whose name
    the superclass already has gets the subclass label as prefix. A subclass row without its
    superclass row stays a node of its own; where there is none (a foreign key without orphans),
    ``keep_orphans=False`` allows the cheaper left join. Keys are unique on both sides, so no row
    can have many partners. ``also`` names labels that a subclass row has from superclasses elsewhere.
    """
    old = "labels" if "labels" in parent.columns else "CASE WHEN label IS NOT NULL THEN array(label) END"
    taken = set(parent.columns)
    extra = []
    for c in child.columns:
        if c in ("node_key", "label", child_key):
            continue
        name = f"{child_label[:1].lower()}{child_label[1:]}{c[:1].upper()}{c[1:]}" if c in taken else c
        extra.append((c, name))
    sub = child.selectExpr(
        f"{quoted(child_key)} AS _sub_key", "node_key AS _sub_node_key", *[f"{quoted(c)} AS `_sub_{n}`" for c, n in extra]
    )
    how = "full_outer" if keep_orphans else "left"
    joined = parent.join(sub, F.col(f"`{parent_key}`") == F.col("_sub_key"), how)
    whole = {"node_key": "coalesce(node_key, _sub_node_key)", parent_key: f"coalesce({quoted(parent_key)}, _sub_key)"}
    kept = [f"{whole.get(c, quoted(c))} AS {quoted(c)}" for c in parent.columns if c not in ("label", "labels")]
    added = f"CASE WHEN _sub_key IS NOT NULL THEN array({', '.join(map(literal, (child_label, *also)))}) ELSE array() END"
    return joined.selectExpr(
        *kept, f"concat(coalesce({old}, array()), {added}) AS labels", *[f"`_sub_{n}` AS {quoted(n)}" for _, n in extra]
    )


def derive_property(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """Nodes plus one computed property."""
    return df.withColumn(name, F.expr(value) if isinstance(value, str) else value)


def label_table(
    source: Source,
    tables: Sequence[str],
    *,
    keep_foreign_keys: bool = False,
    attributes: DataFrame | None = None,
) -> DataFrame:
    """Properties of every label: name, graph type, required or not.

    ``attributes`` (the conceptual entities) restricts the properties to the entity's attributes.
    """
    columns = source.cat_columns().where(F.col("table_name").isin(list(tables)))
    if attributes is not None:
        names = attributes.select("table_name", F.explode("attributes").alias("column_name"))
        columns = columns.join(names, ["table_name", "column_name"], "left_semi")
    elif not keep_foreign_keys:
        pk = source.cat_tables().select("table_name", F.explode("pk_columns").alias("column_name"))
        dropped = source.cat_fks().select("table_name", F.explode("columns").alias("column_name")).join(pk, ["table_name", "column_name"], "left_anti")
        columns = columns.join(dropped, ["table_name", "column_name"], "left_anti")
    return columns.selectExpr(
        f"{N.node_label('table_name')} AS label",
        "table_name",
        f"{N.property_name('column_name')} AS property",
        "column_name",
        "ordinal",
        f"{graph_type('sql_type')} AS property_type",
        "NOT nullable AS is_required",
    )

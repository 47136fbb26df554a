"""Foreign keys and junction tables -> edge DataFrames.

Edges share one shape: ``fk_name, rel_type, from_label, from_key, to_label, to_key,
cardinality, props``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import fk_value, graph_value, literal, node_key, quoted
from ..sources.source import ForeignKey, Source
from .profile import orphan_values

EDGE_COLUMNS = ("fk_name", "rel_type", "from_label", "from_key", "to_label", "to_key", "cardinality", "props")

# A key with this many rows is spread over several tasks in `hub_join`.
HOT_ROWS = 2_000_000

# Rough bytes per key in a broadcast table.
_ROW_BYTES = 64


@dataclass(frozen=True)
class EdgeType:
    """How one foreign key (or junction table) becomes edges."""

    fk: ForeignKey
    rel_type: str
    from_label: str
    to_label: str
    cardinality: str | None = None
    semantics: str | None = None


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _same_text(child: T.DataType, parent: T.DataType) -> bool:
    """Whether equal values of two columns are equal as text."""
    whole = isinstance(child, T.IntegralType) and isinstance(parent, T.IntegralType)
    return whole or child == parent or T.StringType() in (child, parent)


def points_at_node_key(source: Source, fk: ForeignKey) -> bool:
    """Whether a foreign key's own values spell its parents' node keys; otherwise they have to be looked up."""
    key = source.primary_key(fk.ref_table)
    child, parent = source[fk.table].schema, source[fk.ref_table].schema
    same = all(_same_text(child[c].dataType, parent[r].dataType) for c, r in zip(fk.columns, fk.ref_columns))
    return bool(key) and sorted(key) == sorted(fk.ref_columns) and same


def _spelled_key(source: Source, df: DataFrame, fk: ForeignKey) -> str:
    """The parent's node key, from the child's columns alone; null where one of them is null (SQL text)."""
    own = dict(zip(fk.ref_columns, fk.columns))
    columns = [own[c] for c in source.primary_key(fk.ref_table)]
    known = " AND ".join(f"{quoted(c)} IS NOT NULL" for c in columns)
    return f"CASE WHEN {known} THEN {node_key(df.schema, columns)} END"


def parent_keys(source: Source, fk: ForeignKey, value: str, key: str) -> DataFrame:
    """``(value, key)``: what foreign keys may hold, and the key of the node that is meant.

    Several parents with one value count as the one with the least key, so that a row of the child
    stays one row. Grouping deals rows out as the join does, so it costs no shuffle of its own there.
    """
    parent = source[fk.ref_table]
    found = parent.selectExpr(f"{fk_value(fk.ref_columns)} AS {value}", f"{node_key(parent.schema, source.primary_key(fk.ref_table))} AS {key}")
    return found.where(f"{value} IS NOT NULL").groupBy(value).agg(F.min(key).alias(key))


def with_parent_keys(
    source: Source,
    df: DataFrame,
    fks: Sequence[ForeignKey],
    *,
    check: Sequence[ForeignKey] = (),
    orphans: Mapping[str, int] | None = None,
    row_counts: Mapping[str, int] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``df`` with ``_to0``, ``_to1`` ...: the node key that each foreign key leads to, or null.

    A foreign key that holds its parents' primary key spells the node key itself. Any other one is
    translated: the rows are joined with the values that it may hold and the keys behind them.
    ``check`` lists the keys whose parents may be missing; translation finds that out by itself.

    ``orphans`` gives the number of parentless values per key, as the profile counted them. Where
    they fit a broadcast, only they are sent to the rows and the rows are not shuffled. Otherwise
    the rows are joined with the parent keys: with the hot keys spread where ``row_counts`` says
    the parent is too big to broadcast, else as Spark's own size check decides. A row stays one
    row in every case, also where its parent value occurs several times.
    """
    limit, checked = broadcast_limit(source), {fk.name for fk in check}
    for i, fk in enumerate(fks):
        value, mark, key, to = f"_fk{i}", f"_end{i}", f"_key{i}", f"_to{i}"
        spelled = points_at_node_key(source, fk)
        if spelled and fk.name not in checked:
            df = df.withColumn(to, F.expr(_spelled_key(source, df, fk)))
            continue
        df = df.withColumn(value, F.expr(fk_value(fk.columns)))
        if spelled and fk.name in (orphans or {}) and orphans[fk.name] * _ROW_BYTES * len(fk.columns) <= limit:
            lost = orphan_values(source, fk).select(F.col("k").alias(mark))
            df = df.join(F.broadcast(lost), F.col(value) == F.col(mark), "left")
            end = F.when(F.col(mark).isNull(), F.expr(_spelled_key(source, df, fk)))
            df = df.withColumn(to, end).drop(value, mark)
            continue
        parent = parent_keys(source, fk, mark, key)
        if (row_counts or {}).get(fk.ref_table, 0) * _ROW_BYTES > limit:
            hot = hot_keys(source[fk.table].selectExpr(f"{fk_value(fk.columns)} AS {value}"), value, hot_rows)
            df = hub_join(df, parent, value, mark, how="left", hot=hot)
        else:
            df = df.join(parent, F.col(value) == F.col(mark), "left")
        df = df.withColumnRenamed(key, to).drop(value, mark)
    return df


def broadcast_limit(source: Source) -> int:
    """Spark's own broadcast threshold in bytes; negative when broadcasting is off."""
    text = source.spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    units = {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}
    digits = text.rstrip("kmgtb")
    return int(float(digits) * units.get(text[len(digits):][:1], 1))


def fk_edges(
    source: Source,
    table: str,
    edge_types: Sequence[EdgeType],
    *,
    check: Sequence[ForeignKey] = (),
    orphans: Mapping[str, int] | None = None,
    row_counts: Mapping[str, int] | None = None,
) -> DataFrame:
    """All foreign-key edges of one table from a single scan of its key columns.

    Rows with a null foreign key give no edge. ``check`` lists the keys whose parents may be
    missing; their edges are kept only where the parent exists.
    """
    df = source[table]
    needed = dict.fromkeys(c for e in edge_types for c in e.fk.columns)
    df = df.selectExpr(f"{node_key(df.schema, source.primary_key(table))} AS from_key", *[quoted(c) for c in needed])
    df = with_parent_keys(source, df, [e.fk for e in edge_types], check=check, orphans=orphans, row_counts=row_counts)
    columns = [_edge(e, "from_key", f"_to{i}") for i, e in enumerate(edge_types)]
    if len(columns) == 1:
        return df.where("_to0 IS NOT NULL").selectExpr(*columns[0])
    structs = ", ".join(f"struct({', '.join(c)})" for c in columns)
    return df.selectExpr(f"inline(array({structs}))").where("to_key IS NOT NULL")


def _edge(e: EdgeType, from_key: str, to_key: str, props: str | None = None) -> list[str]:
    return [
        f"{literal(e.fk.name)} AS fk_name",
        f"{literal(e.rel_type)} AS rel_type",
        f"{literal(e.from_label)} AS from_label",
        f"CAST({from_key} AS STRING) AS from_key",
        f"{literal(e.to_label)} AS to_label",
        f"CAST({to_key} AS STRING) AS to_key",
        f"{literal(e.cardinality)} AS cardinality",
        f"{props or literal(None)} AS props",
    ]


def junction_edges(
    source: Source,
    table: str,
    edge: EdgeType,
    names: Mapping[tuple[str, str], str],
    *,
    flat: bool = False,
    check: Sequence[ForeignKey] = (),
    orphans: Mapping[str, int] | None = None,
    row_counts: Mapping[str, int] | None = None,
) -> DataFrame:
    """Rows of a junction table as edges; its other columns become edge properties.

    ``flat`` gives the properties as typed columns, otherwise they are one JSON text so that
    edges of all types fit one DataFrame.
    """
    df = source[table]
    ends = source.fks_of(table)
    keys = {c for fk in ends for c in fk.columns}
    others = [f for f in df.schema.fields if f.name not in keys]
    df = with_parent_keys(source, df, ends, check=check, orphans=orphans, row_counts=row_counts)
    values = [
        f"{graph_value(quoted(f.name), f.dataType, is_json=source.is_json(table, f.name))} AS {quoted(names[table, f.name])}"
        for f in others
    ]
    props = f"to_json(struct({', '.join(values)}))" if values and not flat else None
    columns = _edge(edge, "_to0", "_to1", props)
    df = df.where("_to0 IS NOT NULL AND _to1 IS NOT NULL")
    return df.selectExpr(*columns[:-1], *values) if flat else df.selectExpr(*columns)


# -- joining edges to nodes -------------------------------------------------------------------


#: Keys that a list of hot ones may have, items that a sketch follows, and first-level merges of sketches.
MOST_HOT, _TRACKED, _GROUPS = 1024, 4096, 64


def _key_hash(df: DataFrame, key: str, kind: str | None = None) -> str:
    """One long per key, the same for equal keys of any integer width or, as ``kind``, of any type (SQL text)."""
    value = f"CAST({quoted(key)} AS {kind})" if kind else quoted(key)
    plain = isinstance(df.schema[key].dataType, (T.FloatType, T.DoubleType))
    return f"xxhash64(CAST({value}{' + 0' if plain else ''} AS STRING))"  # -0.0 is 0.0


def same_hash(a: T.DataType, b: T.DataType) -> bool:
    """Whether equal keys of two types have one ``_key_hash``."""
    return a == b or isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType)


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS, *, kind: str | None = None) -> DataFrame:
    """``(_hot, _parts)``: hashes of keys with about ``hot_rows`` rows or more, and the parts they are cut into.

    Found by a mergeable sketch of frequent items, so nothing is shuffled per key and the list is
    bounded by construction: the ``MOST_HOT`` most frequent keys at most. A key beyond the list has
    less than a ``MOST_HOT``-th of the rows. Any list gives the right result; it only says what is spread.
    """
    hashes = df.where(_q(key).isNotNull()).selectExpr(f"{_key_hash(df, key, kind)} AS _hot", f"pmod(spark_partition_id(), {_GROUPS}) AS _g")
    some = hashes.groupBy("_g").agg(F.expr(f"approx_top_k_accumulate(_hot, {_TRACKED})").alias("_s"))
    # Grouped by a constant, since a task without rows has no sketch to hand on.
    top = some.groupBy(F.lit(0).alias("_all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(_s, {_TRACKED}), {MOST_HOT})").alias("_t"))
    found = top.selectExpr("inline(_t)").where(F.col("count") >= hot_rows)
    return found.select(F.col("item").alias("_hot"), F.expr(f"CAST(ceil(count / {hot_rows}) AS INT)").alias("_parts"))


def hub_join(
    big: DataFrame,
    small: DataFrame,
    big_key: str,
    small_key: str,
    *,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join that spreads the hot keys and the null keys of ``big``; same result as a plain join.

    The two sides must not share column names. The list of hot keys is bounded (``hot_keys``), so it
    may be broadcast. Each hot key is cut into ``ceil(rows of the key / hot_rows)`` parts by a hash of
    the row; ``small`` repeats its hot rows once per part, which adds at most ``2 * rows / hot_rows``
    copies of each. Rows without a key meet nothing: they are left out, or dealt out evenly where the
    join keeps them. Everything else is joined as it is. The salt of a key is a hash, not a random
    number, so a task that runs again gives the same rows.

    ``hot`` (from ``hot_keys``) saves finding the hot keys in ``big`` when that is itself the
    result of joins; any list gives the right result.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"hub_join does not support {how}")
    if how in ("inner", "left_semi"):
        big = big.where(_q(big_key).isNotNull())
    kinds, kind = [big.schema[big_key].dataType, small.schema[small_key].dataType], None
    if not same_hash(*kinds):
        # Equal keys must be equal as text as well, on which the parts of a key depend.
        kind = big.select(_q(big_key)).union(small.select(_q(small_key))).schema[0].dataType.simpleString()
    if hot is None:
        hot = hot_keys(big, big_key, hot_rows, kind=kind)
    left, right = with_salt(big, big_key, hot, "_salt", kind=kind), with_parts(small, small_key, hot, "_part", kind=kind)
    same = (_q(big_key) == _q(small_key)) & (F.col("_salt") == F.col("_part"))
    return left.join(right, same, how).drop("_salt", "_part")


def with_salt(big: DataFrame, key: str, hot: DataFrame, name: str, *, by: Sequence[str] | None = None, kind: str | None = None) -> DataFrame:
    """``big`` plus the part of its key that a row belongs to; 0 for keys that are not hot.

    The part is a hash of the columns ``by``, which should differ between the rows of a key; by
    default all that can be hashed. Rows without a key are dealt out one by one: they have no partner
    that would have to be in the same part.
    """
    if by is None:
        plain = [f.name for f in big.schema.fields if not any(t in f.dataType.simpleString() for t in ("variant", "map<"))]
        by = [c for c in plain if c != key] or [key]
    part = f"CAST(pmod(xxhash64({', '.join(map(quoted, by))}), _parts) AS INT)"
    alone = "CAST(pmod(monotonically_increasing_id(), 1000003) AS INT)"
    salt = f"CASE WHEN {quoted(key)} IS NULL THEN {alone} WHEN _parts IS NULL THEN 0 ELSE {part} END AS {name}"
    joined = big.join(F.broadcast(hot), F.expr(_key_hash(big, key, kind)) == F.col("_hot"), "left")
    return joined.selectExpr(*[quoted(c) for c in big.columns], salt)


def with_parts(small: DataFrame, key: str, hot: DataFrame, name: str, *, kind: str | None = None) -> DataFrame:
    """``small`` with a row per part of its key, numbered from 0."""
    joined = small.join(F.broadcast(hot), F.expr(_key_hash(small, key, kind)) == F.col("_hot"), "left")
    return joined.selectExpr(
        *[quoted(c) for c in small.columns], f"explode(sequence(0, coalesce(_parts, 1) - 1)) AS {name}"
    )


def match_endpoints(
    edges: DataFrame, from_nodes: DataFrame, to_nodes: DataFrame, *, spread: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Edges whose two nodes both exist. An id that occurs twice among the nodes multiplies.

    ``spread`` uses ``hub_join``; for node sets too big to broadcast whose hubs hold a large share
    of the edges. Otherwise Spark picks broadcast or sort-merge, with its own skew handling.
    """
    a = from_nodes.select(F.col("node_key").alias("_from"))
    b = to_nodes.select(F.col("node_key").alias("_to"))
    if spread:
        half = hub_join(edges, a, "from_key", "_from", hot_rows=hot_rows)
        hubs = hot_keys(edges, "to_key", hot_rows)
        return hub_join(half, b, "to_key", "_to", hot=hubs).drop("_from", "_to")
    return (
        edges.join(a, edges["from_key"] == a["_from"])
        .join(b, edges["to_key"] == b["_to"])
        .drop("_from", "_to")
    )


def missing_endpoints(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Edges whose ``end`` (``from`` or ``to``) has no node."""
    keys = nodes.select(F.col("node_key").alias("_key"))
    return edges.join(keys, edges[f"{end}_key"] == keys["_key"], "left_anti")


def add_edges(edges: DataFrame, extra: DataFrame) -> DataFrame:
    """Edges plus user-defined ones; columns that one side lacks are null."""
    return edges.unionByName(extra, allowMissingColumns=True)

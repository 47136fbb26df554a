"""Semantic enrichment: what the tables and keys of a source mean.

All rules are joins and expressions over the small catalog tables. Evidence from the rows
(``profile.fk_profile``) is one more small table that can be joined in.

``rule='shared_key'`` (default) calls a table a subclass when its foreign key is its whole primary
key. ``rule='as_coded'`` is the looser reading: any foreign key inside the primary key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import naming as N
from ..functions.values import fk_value, literal, quoted
from ..sources.source import Source, local_frame, union_all
from .profile import column_stats

RULES = ("shared_key", "as_coded")


@dataclass(frozen=True)
class ConceptualModel:
    """The conceptual model as DataFrames; see the functions below for their columns."""

    source: Source
    rule: str
    tables: DataFrame
    fks: DataFrame
    entities: DataFrame
    relationships: DataFrame


def _loose(rule: str) -> bool:
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule}")
    return rule == "as_coded"


def junction_flags(source: Source, *, rule: str = "shared_key") -> DataFrame:
    """Catalog tables plus ``is_junction``: two foreign keys on different columns and a primary key made of them.

    ``as_coded`` is content with a primary key that is a part of their columns.
    """
    test = (
        "n_fks = 2 AND size(array_distinct(fk_columns)) = size(fk_columns) AND size(pk_columns) > 0 "
        "AND size(array_except(pk_columns, fk_columns)) = 0"
    )
    if not _loose(rule):
        test += " AND size(array_except(fk_columns, pk_columns)) = 0"
    return source.cat_tables().selectExpr("*", f"{test} AS is_junction")


def enriched_fks(source: Source, *, rule: str = "shared_key", evidence: DataFrame | None = None) -> DataFrame:
    """Foreign keys with their meaning, one row each.

    Adds ``not_null``, ``is_junction``, ``is_inheritance``, ``is_weak``, ``is_aggregation``,
    ``cardinality``, ``relationship_name`` and ``semantics``. With ``evidence``, a column whose
    rows hold no null counts as NOT NULL. Tables already classified (subclasses; by default
    junctions too) are neither weak nor aggregated.
    """
    loose = _loose(rule)
    if loose:
        inherits = "size(array_except(f.columns, c.pk_columns)) = 0 AND coalesce(size(array_except(f.ref_columns, p.pk_columns)) = 0, false)"
        closed = "false"
    else:
        inherits = (
            "array_sort(c.pk_columns) = array_sort(f.columns) AND coalesce(array_sort(p.pk_columns) = array_sort(f.ref_columns), false) "
            "AND NOT c.is_junction"
        )
        closed = "is_junction"
    if evidence is None:
        seen = source.cat_fks().selectExpr("fk_name", "false AS complete").limit(0)
    else:
        seen = evidence.selectExpr("fk_name", "null_rows = 0 AND child_rows > 0 AS complete")
    name = N.relationship_name("column_name", "ref_table", "is_inheritance", "is_aggregation", as_coded=loose)
    return source.spark.sql(
        f"""
        WITH facts AS (
            SELECT f.*, c.table_ordinal, c.is_junction,
                   f.declared_not_null OR coalesce(e.complete, false) AS not_null,
                   size(array_except(f.columns, c.pk_columns)) = 0 AS in_pk,
                   array_position(c.pk_columns, f.columns[0]) AS pk_position,
                   array_sort(c.pk_columns) = array_sort(f.columns) AS is_whole_pk,
                   u.columns IS NOT NULL AS is_unique,
                   {inherits} AS is_inheritance,
                   coalesce(contains(upper(f.on_delete), 'CASCADE'), false) AS is_cascade
            FROM {{fks}} f
            JOIN {{tables}} c ON c.table_name = f.table_name
            LEFT JOIN {{tables}} p ON p.table_name = f.ref_table
            LEFT JOIN (SELECT DISTINCT table_name, array_sort(columns) AS columns FROM {{keys}} WHERE NOT is_primary AND is_unique) u
              ON u.table_name = f.table_name AND u.columns = array_sort(f.columns)
            LEFT JOIN {{seen}} e ON e.fk_name = f.fk_name
        ), open AS (
            SELECT facts.*, s.table_name IS NULL AND NOT {closed} AS is_open
            FROM facts LEFT JOIN (SELECT DISTINCT table_name FROM facts WHERE is_inheritance) s
              ON s.table_name = facts.table_name
        ), flagged AS (
            SELECT *, is_open AND in_pk AS is_weak,
                   is_open AND (in_pk OR is_cascade OR not_null) AS is_aggregation,
                   CASE WHEN is_inheritance OR is_unique OR is_whole_pk THEN '1:1' ELSE 'N:1' END AS cardinality
            FROM open
        )
        SELECT fk_name, table_name, table_ordinal, column_name, columns, fk_ordinal, ref_table, ref_column, ref_columns, on_delete, not_null,
               in_pk, pk_position, is_junction, is_inheritance, is_weak, is_aggregation, cardinality,
               {name} AS relationship_name,
               CASE WHEN is_inheritance THEN 'INHERITANCE' WHEN is_aggregation AND is_cascade THEN 'COMPOSITION'
                    WHEN is_aggregation THEN 'AGGREGATION' ELSE 'ASSOCIATION' END AS semantics
        FROM flagged
        """,
        fks=source.cat_fks(),
        tables=junction_flags(source, rule=rule),
        keys=source.cat_keys(),
        seen=seen,
    )


def normal_cardinality(x: str) -> str:
    """One of 1:1, 1:N, N:1, N:M; anything else is N:1 (SQL text)."""
    return f"CASE WHEN {x} IN ('1:1', '1:N', 'N:1', 'N:M') THEN {x} ELSE 'N:1' END"


def conceptual_entities(source: Source, fks: DataFrame, *, rule: str = "shared_key") -> DataFrame:
    """Non-junction tables as entities: type, attributes, keys, superclass, subclasses, owner.

    A table with several parents keeps the one whose column comes first in its primary key, or
    as coded the last foreign key.
    """
    pick = "max_by(ref_table, fk_ordinal)" if _loose(rule) else "min_by(ref_table, pk_position)"
    return source.spark.sql(
        f"""
        WITH supers AS (SELECT table_name, {pick} AS superclass FROM {{fks}} WHERE is_inheritance GROUP BY table_name),
        owners AS (SELECT table_name, {pick} AS owner FROM {{fks}} WHERE is_weak GROUP BY table_name),
        subs AS (SELECT superclass AS table_name, array_sort(collect_list(table_name)) AS subclasses
                 FROM supers GROUP BY superclass),
        attributes AS (
            SELECT table_name, array_sort(collect_list(struct(ordinal, column_name))).column_name AS attributes
            FROM {{columns}} c LEFT ANTI JOIN (SELECT table_name, explode(columns) AS column_name FROM {{fks}} WHERE NOT is_inheritance) f
              USING (table_name, column_name)
            GROUP BY table_name)
        SELECT table_name, CASE WHEN owner IS NULL THEN 'STRONG' ELSE 'WEAK' END AS entity_type,
               coalesce(attributes, array()) AS attributes, pk_columns AS key_attributes, superclass,
               coalesce(subclasses, array()) AS subclasses, owner
        FROM {{tables}} LEFT JOIN supers USING (table_name) LEFT JOIN owners USING (table_name)
             LEFT JOIN subs USING (table_name) LEFT JOIN attributes USING (table_name)
        WHERE NOT is_junction
        """,
        fks=fks,
        columns=source.cat_columns(),
        tables=junction_flags(source, rule=rule),
    )


def junction_relationships(source: Source, *, rule: str = "shared_key") -> DataFrame:
    """N:M relationships: first foreign key -> second, the other columns as attributes."""
    return source.spark.sql(
        f"""
        WITH j AS (SELECT table_name FROM {{tables}} WHERE is_junction),
        attributes AS (
            SELECT table_name, array_sort(collect_list(struct(ordinal, column_name))).column_name AS attributes
            FROM {{columns}} LEFT ANTI JOIN (SELECT table_name, explode(columns) AS column_name FROM {{fks}}) f USING (table_name, column_name)
            GROUP BY table_name)
        SELECT {N.junction_type("j.table_name")} AS name, a.ref_table AS source_entity, b.ref_table AS target_entity,
               'N:M' AS cardinality, 'ASSOCIATION' AS semantics, CAST(NULL AS STRING) AS fk_name,
               j.table_name AS junction_table, coalesce(t.attributes, array()) AS attributes, false AS is_mandatory_source
        FROM j JOIN {{fks}} a ON a.table_name = j.table_name AND a.fk_ordinal = 1
               JOIN {{fks}} b ON b.table_name = j.table_name AND b.fk_ordinal = 2
               LEFT JOIN attributes t ON t.table_name = j.table_name
        """,
        fks=source.cat_fks(),
        columns=source.cat_columns(),
        tables=junction_flags(source, rule=rule),
    )


def conceptual_relationships(source: Source, fks: DataFrame, *, rule: str = "shared_key") -> DataFrame:
    """Relationships from foreign keys of non-junction tables, and from junction tables."""
    plain = fks.where("NOT is_junction").selectExpr(
        "relationship_name AS name",
        "table_name AS source_entity",
        "ref_table AS target_entity",
        f"{normal_cardinality('cardinality')} AS cardinality",
        "semantics",
        "fk_name",
        "CAST(NULL AS STRING) AS junction_table",
        "CAST(array() AS ARRAY<STRING>) AS attributes",
        "not_null AS is_mandatory_source",
    )
    return plain.unionByName(junction_relationships(source, rule=rule))


def enrich(source: Source, *, rule: str = "shared_key", evidence: DataFrame | None = None) -> ConceptualModel:
    """Schema -> conceptual model."""
    fks = enriched_fks(source, rule=rule, evidence=evidence)
    return ConceptualModel(
        source=source,
        rule=rule,
        tables=junction_flags(source, rule=rule),
        fks=fks,
        entities=conceptual_entities(source, fks, rule=rule),
        relationships=conceptual_relationships(source, fks, rule=rule),
    )


# -- hierarchies and groups -------------------------------------------------------------------


def hierarchies(model: ConceptualModel) -> DataFrame:
    """Inheritance chains from every root: ``(root, member, depth, path)``.

    The closure does not depend on the order of tables; a table met again on its own path ends it.
    """
    return model.source.spark.sql(
        """
        WITH RECURSIVE isa AS (SELECT DISTINCT ref_table AS parent, table_name AS child FROM {fks} WHERE is_inheritance),
        chain(root, member, depth, path) AS (
            SELECT DISTINCT p.parent, p.parent, 0, array(p.parent)
            FROM isa p LEFT ANTI JOIN isa c ON c.child = p.parent
            UNION ALL
            SELECT chain.root, i.child, chain.depth + 1, array_append(chain.path, i.child)
            FROM chain JOIN isa i ON i.parent = chain.member
            WHERE NOT array_contains(chain.path, i.child)
        )
        SELECT root, member, depth, array_join(path, ' > ') AS path FROM chain
        """,
        fks=model.fks,
    )


def hierarchy_groups(model: ConceptualModel) -> DataFrame:
    """``(root, members)``: all tables below a root, the root first, then by depth and name."""
    return model.source.spark.sql(
        "SELECT root, array_sort(collect_set(struct(depth, member))).member AS members FROM {chains} GROUP BY root",
        chains=hierarchies(model),
    )


def weak_groups(model: ConceptualModel) -> DataFrame:
    """``(owner, weak_tables)``: every owner of every weak entity, names sorted."""
    return model.source.spark.sql(
        "SELECT ref_table AS owner, array_sort(collect_set(table_name)) AS weak_tables "
        "FROM {fks} WHERE is_weak GROUP BY ref_table",
        fks=model.fks,
    )


def model_statistics(model: ConceptualModel) -> DataFrame:
    """``(statistic, value)``: the totals of a conceptual model."""
    e = model.entities.selectExpr(
        "count(1) AS total_entities",
        "count_if(entity_type = 'STRONG') AS strong_entities",
        "count_if(entity_type = 'WEAK') AS weak_entities",
    )
    r = model.relationships.selectExpr(
        "count(1) AS total_relationships",
        "count_if(semantics = 'INHERITANCE') AS inheritance_relationships",
        "count_if(semantics IN ('AGGREGATION', 'COMPOSITION')) AS aggregation_relationships",
    )
    return _long(e).unionByName(_long(r))


def _long(df: DataFrame) -> DataFrame:
    return df.unpivot([], df.columns, "statistic", "value")


def distributions(model: ConceptualModel) -> DataFrame:
    """Histograms of entity types, cardinalities and semantics: ``(kind, value, n)``."""
    return model.source.spark.sql(
        """
        SELECT kind, value, count(1) AS n FROM (
            SELECT 'entity_type' AS kind, entity_type AS value FROM {e}
            UNION ALL SELECT 'cardinality', cardinality FROM {r}
            UNION ALL SELECT 'semantics', semantics FROM {r})
        GROUP BY kind, value
        """,
        e=model.entities,
        r=model.relationships,
    )


# -- evidence from the rows -------------------------------------------------------------------


def data_cardinality(evidence: DataFrame) -> DataFrame:
    """Cardinality of foreign keys from their rows: at most one child per parent is 1:1."""
    return evidence.selectExpr(
        "fk_name",
        "table_name",
        "ref_table",
        "max_children",
        "CASE WHEN max_children <= 1 THEN '1:1' ELSE 'N:1' END AS cardinality",
    )


def junction_cardinality(source: Source, tables: Sequence[str]) -> DataFrame:
    """Cardinality of junction tables from their rows: the widest fan-out seen from each end.

    Each end is counted per value before the shuffle; only the two maxima meet.
    """

    def widest(table: str, columns: Sequence[str], end: str) -> DataFrame:
        counts = source[table].selectExpr(f"{fk_value(columns)} AS k").where("k IS NOT NULL").groupBy("k").count()
        return counts.selectExpr(f"{literal(table)} AS table_name", f"'{end}' AS side", "coalesce(max(count), 0) AS n")

    ends = union_all(
        widest(t, fk.columns, end) for t in tables for fk, end in zip(source.fks_of(t), ("from", "to"))
    )
    return source.spark.sql(
        """
        SELECT table_name, from_fan_out, to_fan_out,
               CASE WHEN from_fan_out > 1 AND to_fan_out > 1 THEN 'N:M' WHEN from_fan_out > 1 THEN '1:N'
                    WHEN to_fan_out > 1 THEN 'N:1' ELSE '1:1' END AS cardinality
        FROM (SELECT table_name, max(n) FILTER (WHERE side = 'from') AS from_fan_out,
                     max(n) FILTER (WHERE side = 'to') AS to_fan_out
              FROM {ends} GROUP BY table_name)
        """,
        ends=ends,
    )


def participation(evidence: DataFrame) -> DataFrame:
    """Whether each end must take part, from the rows of both ends."""
    return evidence.selectExpr(
        "fk_name",
        "child_rows",
        "child_rows - null_rows - orphan_rows AS children_with_parent",
        "null_rows + orphan_rows = 0 AS is_mandatory_source",
        "parent_rows",
        "parents_with_child",
        "parents_with_child = parent_rows AS is_mandatory_target",
    )


# -- optional evidence by name ----------------------------------------------------------------

# Name endings that suggest containment and membership.
_CONTAINED = "(?i)_(detail|line|item)s?$"
_MEMBER = "(?i)_(member|assignment)s?$"


def semantics_by_name(table: str) -> str:
    """COMPOSITION or AGGREGATION suggested by the ending of a table name, else null (SQL text)."""
    return f"CASE WHEN {table} rlike '{_CONTAINED}' THEN 'COMPOSITION' WHEN {table} rlike '{_MEMBER}' THEN 'AGGREGATION' END"


def name_evidence(source: Source) -> DataFrame:
    """Per foreign key: how alike the two tables are by name and by column names.

    Evidence to stand beside the key rules, never a rule of its own.
    """
    return source.spark.sql(
        f"""
        WITH stems AS (SELECT table_name, collect_set({N.name_stem("column_name")}) AS stems FROM {{columns}} GROUP BY table_name)
        SELECT f.fk_name, f.table_name, f.ref_table,
               levenshtein(lower(f.table_name), lower(f.ref_table)) AS name_distance,
               contains(lower(f.table_name), regexp_replace(lower(f.ref_table), 's$', '')) AS shares_name_stem,
               size(array_intersect(c.stems, p.stems)) AS shared_columns
        FROM {{fks}} f JOIN stems c ON c.table_name = f.table_name JOIN stems p ON p.table_name = f.ref_table
        """,
        columns=source.cat_columns(),
        fks=source.cat_fks(),
    )


def discriminators(source: Source, *, max_values: int | None = None) -> DataFrame:
    """Single-table inheritance: one subclass per value of a ``*type`` / ``*category`` column.

    Every column of such a name gives its histogram, counted on the map side. ``max_values`` leaves out
    columns with more values than that, by an estimate. Without such columns the result is empty.
    """
    named = source.cat_columns().where("column_name rlike '(?i)(_|^)(type|category)$'").collect()
    wanted: dict[str, list[str]] = {}
    for r in named:
        wanted.setdefault(r.table_name, []).append(r.column_name)
    few = [r for r in named if r.table_name in wanted]
    if few and max_values is not None:
        few = column_stats({t: source[t].select(*map(quoted, c)) for t, c in wanted.items()}).where(f"approx_ndv <= {max_values}").collect()
    if not few:
        text = [(c, pa.string()) for c in ("table_name", "column_name", "value", "subclass_label")]
        return local_frame(source.spark, [*text, ("row_count", pa.int64())], [])
    return union_all(
        source[r.table_name]
        .where(f"{quoted(r.column_name)} IS NOT NULL")
        .groupBy(quoted(r.column_name))
        .count()
        .selectExpr(
            f"{literal(r.table_name)} AS table_name",
            f"{literal(r.column_name)} AS column_name",
            f"CAST({quoted(r.column_name)} AS STRING) AS value",
            f"{N.node_label(f'CAST({quoted(r.column_name)} AS STRING)')} AS subclass_label",
            "count AS row_count",
        )
        for r in few
    )


def dictionary_names(fks: DataFrame, pairs: Mapping[tuple[str, str], str], *, by_cardinality: bool = False) -> DataFrame:
    """Foreign keys with ``final_name``: the user's name for the table pair wins, then the verb.

    With ``by_cardinality`` a name without a verb (``PART_OF_X``, ``HAS_X``) gives way to the name
    of its cardinality.
    """
    spark = fks.sparkSession
    table = local_frame(
        spark,
        [("table_name", pa.string()), ("ref_table", pa.string()), ("user_name", pa.string())],
        [(a, b, v) for (a, b), v in pairs.items()],
    )
    plain = f"try_element_at({N.text_map(N.CARDINALITY_VERBS)}, cardinality)"
    fallback = f"CASE WHEN semantics <> 'INHERITANCE' AND {N.verb_for('column_name', 'ref_table')} IS NULL THEN {plain} END"
    choice = ["user_name", *([fallback] if by_cardinality else []), "relationship_name"]
    return fks.join(table, ["table_name", "ref_table"], "left").selectExpr("*", f"coalesce({', '.join(choice)}) AS final_name")

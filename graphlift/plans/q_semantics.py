"""Registered queries on semantic enrichment, each with its SQL.

Every query joins the inferred meaning to evidence computed from the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..operators import profile as P
from ..operators import semantics as S
from ..sources.source import ForeignKey, Source
from .build import build_graph
from .sample import TRADE, sample_source

SOCIAL = ("documents", "labels", "flagged_document", "conversation", "conversations")
EVERYTHING = (*TRADE, "events", *SOCIAL, "supplier_part")


def _edge_counts(source: Source, fks: DataFrame) -> DataFrame:
    """Enriched foreign keys with their non-null rows, one pass per table."""
    frames = []
    for t in source.tables:
        names = [(fk.name, fk.column) for fk in source.fks_of(t)]
        if names:
            counts = source[t].selectExpr(*[f"count({c}) AS {n}" for n, c in names])
            frames.append(counts.unpivot([], [n for n, _ in names], "fk_name", "edge_count"))
    counted = frames[0]
    for df in frames[1:]:
        counted = counted.unionByName(df)
    return fks.join(counted, "fk_name")


def _inheritance(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = sample_source(spark, d, EVERYTHING)
        found = S.enriched_fks(s, rule=rule).where("is_inheritance")
        names = {r.fk_name for r in found.select("fk_name").collect()}
        evidence = P.fk_profile(s, [fk for fk in s.foreign_keys if fk.name in names])
        return found.join(evidence.drop("table_name", "column_name", "ref_table"), "fk_name").selectExpr(
            "table_name AS subclass", "ref_table AS superclass", "relationship_name", "cardinality", "child_rows",
            "non_null_rows - orphan_rows AS matched_rows",
            "max_children <= 1 AND orphan_rows = 0 AND null_rows = 0 AS is_confirmed",
        )

    return run


def hierarchies(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, EVERYTHING)
    chains = S.hierarchies(S.enrich(s))
    counts = s.row_counts().withColumnRenamed("table_name", "member")
    return chains.join(counts, "member").selectExpr("root", "member", "CAST(depth AS BIGINT) AS depth", "path", "row_count")


def hierarchy_groups(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, EVERYTHING)
    counts = s.row_counts().withColumnRenamed("table_name", "root").withColumnRenamed("row_count", "root_rows")
    groups = S.hierarchy_groups(S.enrich(s)).join(counts, "root")
    return groups.selectExpr("root", "array_join(members, ',') AS members", "root_rows")


def weak_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every owner of every weak entity with the members that the rows show per owner."""
    s = sample_source(spark, d, EVERYTHING)
    m = S.enrich(s)
    weak = m.fks.where("is_weak")
    names = {r.fk_name for r in weak.select("fk_name").collect()}
    evidence = P.fk_profile(s, [fk for fk in s.foreign_keys if fk.name in names])
    owner = m.entities.where("entity_type = 'WEAK'").selectExpr("table_name", "owner AS primary_owner")
    return (
        weak.join(owner, "table_name")
        .join(evidence.drop("table_name", "column_name", "ref_table"), "fk_name")
        .selectExpr(
            "table_name AS weak_table", "ref_table AS owner", "ref_table = primary_owner AS is_primary_owner",
            "child_rows", "max_children", "parents_with_child AS owners_in_use",
        )
    )


def weak_groups(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, EVERYTHING)
    groups = S.weak_groups(S.enrich(s))
    counts = s.row_counts().withColumnRenamed("table_name", "owner").withColumnRenamed("row_count", "owner_rows")
    return groups.join(counts, "owner").selectExpr("owner", "array_join(weak_tables, ',') AS weak_tables", "owner_rows")


def aggregation(spark: SparkSession, d: str) -> DataFrame:
    """NOT NULL is taken from the rows here, nothing is declared."""
    s = sample_source(spark, d, EVERYTHING, declare_not_null=False)
    evidence = P.materialize(P.fk_profile(s))
    fks = S.enriched_fks(s, evidence=evidence)
    return fks.join(evidence.select("fk_name", "null_rows", "child_rows"), "fk_name").selectExpr(
        "fk_name", "not_null", "is_weak", "is_aggregation", "semantics", "null_rows", "child_rows"
    )


def cascade(spark: SparkSession, d: str) -> DataFrame:
    """The same foreign keys, one of them declared ON DELETE CASCADE."""
    s = sample_source(spark, d)
    fks = tuple(replace(fk, on_delete="CASCADE") if fk.name == "lineitem_orders" else fk for fk in s.foreign_keys)
    return _edge_counts(s, S.enriched_fks(replace(s, foreign_keys=fks))).select("fk_name", "semantics", "edge_count")


def constraint_cardinality(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, EVERYTHING)
    return _edge_counts(s, S.enriched_fks(s)).select("fk_name", "cardinality", "edge_count")


def data_cardinality(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, EVERYTHING)
    return S.data_cardinality(P.fk_profile(s)).select("fk_name", "max_children", "cardinality")


def junction_cardinality(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, ["supplier", "part", "supplier_part"])
    return S.junction_cardinality(s, ["supplier_part"])


def relationship_names(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, EVERYTHING)
    return _edge_counts(s, S.enriched_fks(s)).select("fk_name", "relationship_name", "edge_count")


def entities(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, EVERYTHING)
    e = S.enrich(s).entities
    return e.join(s.row_counts(), "table_name").selectExpr(
        "table_name", "entity_type", "array_join(attributes, ',') AS attributes",
        "array_join(key_attributes, ',') AS key_attributes", "superclass", "array_join(subclasses, ',') AS subclasses",
        "owner", "row_count",
    )


def relationships(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, EVERYTHING)
    r = S.enrich(s).relationships.where("fk_name IS NOT NULL")
    return _edge_counts(s, r).select(
        "name", "source_entity", "target_entity", "cardinality", "semantics", "is_mandatory_source", "edge_count"
    )


def junction_relationships(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, EVERYTHING)
    r = S.junction_relationships(s).join(s.row_counts().withColumnRenamed("table_name", "junction_table"), "junction_table")
    return r.selectExpr(
        "name", "source_entity", "target_entity", "cardinality", "array_join(attributes, ',') AS attributes", "row_count"
    )


def participation(spark: SparkSession, d: str) -> DataFrame:
    return S.participation(P.fk_profile(sample_source(spark, d, EVERYTHING)))


def normal_cardinalities(spark: SparkSession, d: str) -> DataFrame:
    """Raw cardinality texts made from the fan-out of each customer, brought to the four forms."""
    s = sample_source(spark, d, ["orders"])
    fan = s["orders"].groupBy("o_custkey").count()
    raw = fan.selectExpr("CASE WHEN count = 1 THEN '1:1' WHEN count < 10 THEN '1:N' WHEN count < 15 THEN 'n..1' ELSE 'N:M' END AS raw")
    return raw.groupBy("raw").count().selectExpr("raw", f"{S.normal_cardinality('raw')} AS cardinality", "count AS n")


def statistics(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the model, NOT NULL taken from the rows."""
    s = sample_source(spark, d, EVERYTHING, declare_not_null=False)
    m = S.enrich(s, evidence=P.materialize(P.fk_profile(s)))
    rows = s.row_counts().selectExpr("'total_rows' AS statistic", "row_count AS value").groupBy("statistic").sum("value")
    return S.model_statistics(m).unionByName(rows.selectExpr("statistic", "`sum(value)` AS value"))


def distributions(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, EVERYTHING, declare_not_null=False)
    return S.distributions(S.enrich(s, evidence=P.materialize(P.fk_profile(s))))


def mode_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Direct and enriched names side by side, with the edges both modes build."""
    s = sample_source(spark, d)
    direct, enriched = build_graph(s, "direct"), build_graph(s, "enriched")
    counts = enriched.edges.groupBy("fk_name").count().withColumnRenamed("count", "edge_count")
    both = direct.rel_types().selectExpr("fk_name", "rel_type AS direct_type").join(
        enriched.rel_types().selectExpr("fk_name", "rel_type AS enriched_type", "cardinality", "semantics"), "fk_name", "full_outer"
    )
    return both.join(counts, "fk_name", "left")


def discriminators(spark: SparkSession, d: str) -> DataFrame:
    return S.discriminators(sample_source(spark, d, [*TRADE, "events", "documents"]))


def _renamed(spark: SparkSession, d: str) -> Source:
    """The trade tables under the names a shop might use."""
    s = sample_source(spark, d, [*TRADE, "documents", "labels"])
    tables = {"order_item": s["lineitem"], "order": s["orders"], "product": s["part"], "document": s["documents"],
              "document_assignment": s["labels"]}
    fks = (
        ForeignKey("item_order", "order_item", "l_orderkey", "order", "o_orderkey"),
        ForeignKey("item_product", "order_item", "l_partkey", "product", "p_partkey"),
        ForeignKey("assignment_document", "document_assignment", "doc_id", "document", "doc_id"),
    )
    return Source(spark, tables, foreign_keys=fks)


def name_evidence(spark: SparkSession, d: str) -> DataFrame:
    s = _renamed(spark, d)
    found = S.name_evidence(s).join(P.fk_profile(s).select("fk_name", "distinct_values", "orphan_rows"), "fk_name")
    return found.selectExpr(
        "fk_name", "CAST(name_distance AS BIGINT) AS name_distance", "shares_name_stem",
        "CAST(shared_columns AS BIGINT) AS shared_columns", "distinct_values", "orphan_rows",
    )


def semantics_by_name(spark: SparkSession, d: str) -> DataFrame:
    s = _renamed(spark, d)
    return s.row_counts().selectExpr("table_name", f"{S.semantics_by_name('table_name')} AS semantics", "row_count")


def dictionary_names(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d)
    fks = S.dictionary_names(S.enriched_fks(s), {("lineitem", "part"): "CONTAINS"}, by_cardinality=True)
    return _edge_counts(s, fks).selectExpr("fk_name", "final_name", "edge_count")


QUERIES = {
    "c1_inheritance": _inheritance("shared_key"),
    "c1_inheritance_loose": _inheritance("as_coded"),
    "c2_hierarchies": hierarchies,
    "c2_hierarchy_groups": hierarchy_groups,
    "c3_weak_entities": weak_entities,
    "c3_weak_groups": weak_groups,
    "c4_aggregation": aggregation,
    "c5_constraint_cardinality": constraint_cardinality,
    "c6_data_cardinality": data_cardinality,
    "c6_junction_cardinality": junction_cardinality,
    "c7_relationship_names": relationship_names,
    "c8_entities": entities,
    "c9_relationships": relationships,
    "c9_cascade": cascade,
    "c10_junction_relationships": junction_relationships,
    "c11_participation": participation,
    "c12_normal_cardinalities": normal_cardinalities,
    "c13_statistics": statistics,
    "c14_distributions": distributions,
    "c15_mode_comparison": mode_comparison,
    "c16_discriminators": discriminators,
    "c17_name_evidence": name_evidence,
    "c18_semantics_by_name": semantics_by_name,
    "c19_dictionary_names": dictionary_names,
}

# Tables derived from the files, as SQL.
DERIVED = {
    "conversation": "(SELECT DISTINCT conv_id FROM conversations)",
    "flagged_document": "(SELECT doc_id FROM labels WHERE toxic = 1)",
    "supplier_part": "(SELECT l_suppkey AS suppkey, l_partkey AS partkey, sum(l_quantity) AS qty FROM lineitem "
    "GROUP BY l_suppkey, l_partkey)",
}


def rel(table: str) -> str:
    return DERIVED.get(table, table)


# Expected meaning: key, table, column, parent, parent column, enriched name, direct name, cardinality, semantics, weak.
MEANING = (
    ("nation_region", "nation", "n_regionkey", "region", "r_regionkey", "PART_OF_REGION", "NATION_REGION", "N:1", "AGGREGATION", 0),
    ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey", "PART_OF_NATION", "CUSTOMER_NATION", "N:1", "AGGREGATION", 0),
    ("supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey", "PART_OF_NATION", "SUPPLIER_NATION", "N:1", "AGGREGATION", 0),
    ("orders_customer", "orders", "o_custkey", "customer", "c_custkey", "PURCHASED_BY", "ORDER_CUSTOMER", "N:1", "AGGREGATION", 0),
    ("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey", "PART_OF_ORDERS", "LINEITEM_ORDER", "N:1", "AGGREGATION", 1),
    ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey", "PART_OF_PART", "LINEITEM_PART", "N:1", "AGGREGATION", 1),
    ("lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey", "PART_OF_SUPPLIER", "LINEITEM_SUPPLIER", "N:1", "AGGREGATION", 1),
    ("events_customer", "events", "user_id", "customer", "c_custkey", "USED_BY", "EVENT_CUSTOMER", "N:1", "AGGREGATION", 0),
    ("labels_documents", "labels", "doc_id", "documents", "doc_id", "IS_A_DOCUMENTS", "LABEL_DOCUMENT", "1:1", "INHERITANCE", 0),
    ("flagged_labels", "flagged_document", "doc_id", "labels", "doc_id", "IS_A_LABELS", "FLAGGED_DOCUMENT_LABEL", "1:1", "INHERITANCE", 0),
    ("conversations_conversation", "conversations", "conv_id", "conversation", "conv_id", "PART_OF_CONVERSATION",
     "CONVERSATION_CONVERSATION", "N:1", "AGGREGATION", 1),
    ("supplier_part_supplier", "supplier_part", "suppkey", "supplier", "s_suppkey", "HAS_SUPPLIER", "SUPPLIER_PART_SUPPLIER", "N:1", "ASSOCIATION", 0),
    ("supplier_part_part", "supplier_part", "partkey", "part", "p_partkey", "HAS_PART", "SUPPLIER_PART_PART", "N:1", "ASSOCIATION", 0),
)
PLAIN = [m for m in MEANING if m[1] != "supplier_part"]
IN_TRADE = [m for m in MEANING if m[1] in TRADE]


def _big(text: str) -> str:
    return f"CAST(({text}) AS BIGINT)"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _isa(loose: bool) -> str:
    rows = []
    for _, t, c, rt, rc, _, _, _, sem, weak in MEANING:
        if sem == "INHERITANCE" or (loose and (weak or t == "supplier_part")):
            widest = f"coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM {rel(t)} WHERE {c} IS NOT NULL GROUP BY {c})), 0)"
            matched = f"(SELECT count(*) FROM {rel(t)} WHERE {c} IN (SELECT {rc} FROM {rel(rt)}))"
            rows.append(
                f"SELECT '{t}' AS subclass, '{rt}' AS superclass, 'IS_A_{rt.upper()}' AS relationship_name, '1:1' AS cardinality, "
                f"{_big(f'SELECT count(*) FROM {rel(t)}')} AS child_rows, {_big(matched)} AS matched_rows, "
                f"{widest} <= 1 AND {matched} = (SELECT count(*) FROM {rel(t)}) AS is_confirmed"
            )
    return _union(rows)


def _entity(name: str, kind: str, attributes: str, keys: str, sup: str | None, subs: str, owner: str | None) -> str:
    def text(x: str | None) -> str:
        return "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"

    return (
        f"SELECT '{name}' AS table_name, '{kind}' AS entity_type, '{attributes}' AS attributes, '{keys}' AS key_attributes, "
        f"{text(sup)} AS superclass, '{subs}' AS subclasses, {text(owner)} AS owner, count(*) AS row_count FROM {rel(name)}"
    )


_ENTITIES = _union(
    [
        _entity("region", "STRONG", "r_regionkey,r_name", "r_regionkey", None, "", None),
        _entity("nation", "STRONG", "n_nationkey,n_name", "n_nationkey", None, "", None),
        _entity("customer", "STRONG", "c_custkey,c_name,c_acctbal,c_mktsegment", "c_custkey", None, "", None),
        _entity("supplier", "STRONG", "s_suppkey,s_name,s_acctbal", "s_suppkey", None, "", None),
        _entity("part", "STRONG", "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice", "p_partkey", None, "", None),
        _entity("orders", "STRONG", "o_orderkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority", "o_orderkey", None, "", None),
        _entity("lineitem", "WEAK", "l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate",
                "l_orderkey,l_partkey,l_suppkey,l_linenumber", None, "", "orders"),
        _entity("events", "STRONG", "event_id,ts,event_type,value,props", "event_id", None, "", None),
        _entity("documents", "STRONG", "doc_id,text,lang,source,n_chars", "doc_id", None, "labels", None),
        _entity("labels", "STRONG", "doc_id,quality,toxic", "doc_id", "documents", "flagged_document", None),
        _entity("flagged_document", "STRONG", "doc_id", "doc_id", "labels", "", None),
        _entity("conversation", "STRONG", "conv_id", "conv_id", None, "", None),
        _entity("conversations", "WEAK", "turn,role,text", "conv_id,turn", None, "", "conversation"),
    ]
)

_TOTAL_ROWS = " + ".join(f"(SELECT count(*) FROM {rel(t)})" for t in EVERYTHING)

ORACLES = {
    "c1_inheritance": _isa(False),
    "c1_inheritance_loose": _isa(True),
    "c2_hierarchies": _union(
        f"SELECT 'documents' AS root, '{m}' AS member, CAST({i} AS BIGINT) AS depth, '{p}' AS path, count(*) AS row_count FROM {rel(m)}"
        for i, (m, p) in enumerate(
            (("documents", "documents"), ("labels", "documents > labels"),
             ("flagged_document", "documents > labels > flagged_document"))
        )
    ),
    "c2_hierarchy_groups": """
        SELECT 'documents' AS root, 'documents,labels,flagged_document' AS members, count(*) AS root_rows FROM documents""",
    "c3_weak_entities": _union(
        f"SELECT '{t}' AS weak_table, '{rt}' AS owner, {'true' if rt in ('orders', 'conversation') else 'false'} AS is_primary_owner, "
        f"{_big(f'SELECT count(*) FROM {rel(t)}')} AS child_rows, max(n) AS max_children, count(*) AS owners_in_use "
        f"FROM (SELECT {c}, count(*) AS n FROM {rel(t)} GROUP BY {c}) WHERE {c} IN (SELECT {rc} FROM {rel(rt)})"
        for _, t, c, rt, rc, _, _, _, _, weak in MEANING if weak
    ),
    "c3_weak_groups": _union(
        f"SELECT '{o}' AS owner, '{w}' AS weak_tables, count(*) AS owner_rows FROM {rel(o)}"
        for o, w in (("orders", "lineitem"), ("part", "lineitem"), ("supplier", "lineitem"), ("conversation", "conversations"))
    ),
    "c4_aggregation": _union(
        f"SELECT '{k}' AS fk_name, count(*) = count({c}) AND count(*) > 0 AS not_null, {'true' if weak else 'false'} AS is_weak, "
        f"{'true' if sem == 'AGGREGATION' else 'false'} AS is_aggregation, '{sem}' AS semantics, "
        f"count(*) - count({c}) AS null_rows, count(*) AS child_rows FROM {rel(t)}"
        for k, t, c, _, _, _, _, _, sem, weak in MEANING
    ),
    "c5_constraint_cardinality": _union(
        f"SELECT '{m[0]}' AS fk_name, '{m[7]}' AS cardinality, count({m[2]}) AS edge_count FROM {rel(m[1])}" for m in MEANING
    ),
    "c6_data_cardinality": _union(
        f"SELECT '{m[0]}' AS fk_name, max(n) AS max_children, CASE WHEN max(n) <= 1 THEN '1:1' ELSE 'N:1' END AS cardinality "
        f"FROM (SELECT count(*) AS n FROM {rel(m[1])} WHERE {m[2]} IS NOT NULL GROUP BY {m[2]})"
        for m in MEANING
    ),
    "c6_junction_cardinality": f"""
        SELECT 'supplier_part' AS table_name, a AS from_fan_out, b AS to_fan_out,
               CASE WHEN a > 1 AND b > 1 THEN 'N:M' WHEN a > 1 THEN '1:N' WHEN b > 1 THEN 'N:1' ELSE '1:1' END AS cardinality
        FROM (SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM {rel("supplier_part")} GROUP BY suppkey)) AS a,
                     (SELECT max(n) FROM (SELECT count(*) AS n FROM {rel("supplier_part")} GROUP BY partkey)) AS b)""",
    "c7_relationship_names": _union(
        f"SELECT '{m[0]}' AS fk_name, '{m[5]}' AS relationship_name, count({m[2]}) AS edge_count FROM {rel(m[1])}" for m in MEANING
    ),
    "c8_entities": _ENTITIES,
    "c9_relationships": _union(
        f"SELECT '{name}' AS name, '{t}' AS source_entity, '{rt}' AS target_entity, '{card}' AS cardinality, '{sem}' AS semantics, "
        f"true AS is_mandatory_source, count({c}) AS edge_count FROM {rel(t)}"
        for _, t, c, rt, _, name, _, card, sem, _ in PLAIN
    ),
    "c9_cascade": _union(
        f"SELECT '{m[0]}' AS fk_name, '{'COMPOSITION' if m[0] == 'lineitem_orders' else m[8]}' AS semantics, "
        f"count({m[2]}) AS edge_count FROM {m[1]}"
        for m in IN_TRADE
    ),
    "c10_junction_relationships": f"""
        SELECT 'SUPPLIER_PART' AS name, 'supplier' AS source_entity, 'part' AS target_entity, 'N:M' AS cardinality,
               'qty' AS attributes, count(*) AS row_count FROM {rel("supplier_part")}""",
    "c11_participation": _union(
        f"SELECT '{k}' AS fk_name, a AS child_rows, b AS children_with_parent, a = b AS is_mandatory_source, "
        f"c AS parent_rows, e AS parents_with_child, c = e AS is_mandatory_target FROM (SELECT "
        f"(SELECT count(*) FROM {rel(t)}) AS a, (SELECT count(*) FROM {rel(t)} WHERE {c} IN (SELECT {rc} FROM {rel(rt)})) AS b, "
        f"(SELECT count(*) FROM {rel(rt)}) AS c, (SELECT count(*) FROM {rel(rt)} WHERE {rc} IN (SELECT {c} FROM {rel(t)})) AS e)"
        for k, t, c, rt, rc, *_ in MEANING
    ),
    "c12_normal_cardinalities": """
        SELECT raw, CASE raw WHEN 'n..1' THEN 'N:1' ELSE raw END AS cardinality, count(*) AS n
        FROM (SELECT CASE WHEN k = 1 THEN '1:1' WHEN k < 10 THEN '1:N' WHEN k < 15 THEN 'n..1' ELSE 'N:M' END AS raw
              FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey)) GROUP BY raw""",
    "c13_statistics": _union(
        [f"SELECT '{k}' AS statistic, CAST({v} AS BIGINT) AS value" for k, v in (
            ("total_entities", 13), ("strong_entities", 11), ("weak_entities", 2), ("total_relationships", 12),
            ("inheritance_relationships", 2), ("aggregation_relationships", 9))]
        + [f"SELECT 'total_rows', CAST({_TOTAL_ROWS} AS BIGINT)"]
    ),
    "c14_distributions": _union(
        f"SELECT '{k}' AS kind, '{v}' AS value, CAST({n} AS BIGINT) AS n"
        for k, v, n in (
            ("entity_type", "STRONG", 11), ("entity_type", "WEAK", 2), ("cardinality", "1:1", 2), ("cardinality", "N:1", 9),
            ("cardinality", "N:M", 1), ("semantics", "INHERITANCE", 2), ("semantics", "AGGREGATION", 9),
            ("semantics", "ASSOCIATION", 1),
        )
    ),
    "c15_mode_comparison": _union(
        f"SELECT '{k}' AS fk_name, '{direct}' AS direct_type, '{name}' AS enriched_type, '{card}' AS cardinality, "
        f"'{sem}' AS semantics, count({c}) AS edge_count FROM {t}"
        for k, t, c, _, _, name, direct, card, sem, _ in IN_TRADE
    ),
    "c16_discriminators": _union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS value, upper({c}[1:1]) || lower({c}[2:]) AS subclass_label, "
        f"count(*) AS row_count FROM {t} GROUP BY {c}"
        for t, c in (("part", "p_type"), ("events", "event_type"))
    ),
    "c17_name_evidence": _union(
        f"SELECT '{k}' AS fk_name, CAST({dist} AS BIGINT) AS name_distance, {stem} AS shares_name_stem, "
        f"CAST({shared} AS BIGINT) AS shared_columns, count(DISTINCT {c}) AS distinct_values, "
        f"count(*) FILTER (WHERE {c} NOT IN (SELECT {rc} FROM {rt})) AS orphan_rows FROM {t}"
        for k, t, c, rt, rc, dist, stem, shared in (
            ("item_order", "lineitem", "l_orderkey", "orders", "o_orderkey", "levenshtein('order_item', 'order')", "true", 1),
            ("item_product", "lineitem", "l_partkey", "part", "p_partkey", "levenshtein('order_item', 'product')", "false", 1),
            ("assignment_document", "labels", "doc_id", "documents", "doc_id",
             "levenshtein('document_assignment', 'document')", "true", 1),
        )
    ),
    "c18_semantics_by_name": _union(
        f"SELECT '{n}' AS table_name, {f"'{v}'" if v else 'NULL'} AS semantics, count(*) AS row_count FROM {t}"
        for n, v, t in (
            ("order_item", "COMPOSITION", "lineitem"), ("order", None, "orders"), ("product", None, "part"),
            ("document", None, "documents"), ("document_assignment", "AGGREGATION", "labels"),
        )
    ),
    "c19_dictionary_names": _union(
        f"SELECT '{m[0]}' AS fk_name, '{'CONTAINS' if m[0] == 'lineitem_part' else 'PURCHASED_BY' if m[0] == 'orders_customer' else 'BELONGS_TO'}' "
        f"AS final_name, count({m[2]}) AS edge_count FROM {m[1]}"
        for m in IN_TRADE
    ),
}

"""Registered queries on profiling and the catalog, each with its SQL."""

from __future__ import annotations

import re
from dataclasses import replace
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions import types as TY
from ..operators import checks as CK
from ..operators import inclusion as I
from ..operators import profile as P
from ..operators import semantics as S
from ..sources.source import Source, local_frame
from .sample import FILES, TRADE, sample_source

WITH_JUNCTION = (*TRADE, "supplier_part")


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, FILES)
    return P.column_profile(s).select(
        "table_name", "column_name", "ordinal", F.expr(TY.column_type("sql_type")).alias("column_type"), "row_count",
        "null_count", "ndv", "is_unique", "min_value", "max_value", "max_length", "precision", "scale",
    )


def primary_keys(spark: SparkSession, d: str) -> DataFrame:
    s = replace(sample_source(spark, d, FILES), primary_keys={})
    return P.primary_key_table(s, P.discover_primary_keys(s))


#: Tables of all different values of a few columns of the line items: a key needs all columns.
_WIDE = {
    "wide3": "SELECT DISTINCT l_orderkey % 8 AS a, l_partkey % 8 AS b, l_suppkey % 8 AS c FROM {lineitem}",
    "wide4": "SELECT DISTINCT l_orderkey % 5 AS a, l_partkey % 5 AS b, l_suppkey % 5 AS c, l_linenumber % 3 AS e FROM {lineitem}",
}


def wide_keys(spark: SparkSession, d: str) -> DataFrame:
    lines = sample_source(spark, d)["lineitem"]
    s = Source(spark, {name: spark.sql(text, lineitem=lines) for name, text in _WIDE.items()})
    return P.primary_key_table(s, P.discover_primary_keys(s))


def foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    s = replace(sample_source(spark, d, FILES), foreign_keys=())
    found = P.discover_foreign_keys(s)
    return P.fk_profile(s, found).join(
        replace(s, foreign_keys=tuple(found)).cat_fks().select("fk_name", "ref_column"), "fk_name"
    ).select("table_name", "column_name", "ref_table", "ref_column", "non_null_rows", "distinct_values", "orphan_rows")


def inclusions(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of columns of one kind, of all tables, whose values are contained, keys or not."""
    return I.inclusion_dependencies(sample_source(spark, d, FILES))


def self_references(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a referrer: a reference of a table to itself that no name gives away, among the inclusions in keys."""
    s = sample_source(spark, d, ["customer", "orders"])
    referred = s["customer"].selectExpr("c_custkey", "CASE WHEN c_mktsegment = 'BUILDING' THEN (c_custkey + 1) DIV 2 END AS sent_by", "c_name")
    return I.inclusion_dependencies(Source(spark, {"customer": referred, "orders": s["orders"]}, primary_keys={"customer": ("c_custkey",)}), to_keys=True)


def composite_source(spark: SparkSession, d: str) -> Source:
    """Line items beside the pairs of supplier and part, whose key has two columns."""
    s = sample_source(spark, d, ["lineitem", "supplier_part", "part", "supplier"])
    return replace(s, primary_keys={t: k for t, k in s.primary_keys.items() if t != "lineitem"}, foreign_keys=())


def composite_keys(spark: SparkSession, d: str) -> DataFrame:
    """Tuples of columns contained in the two-column key, whatever their names."""
    s = composite_source(spark, d)
    named = {(fk.table, fk.columns) for fk in I.discover_composite_foreign_keys(s)}
    rows = [(t, ",".join(c), rt, ",".join(rc), (t, c) in named) for (t, c), (rt, rc) in I.composite_inclusions(s)]
    fields = [(n, pa.string()) for n in ("table_name", "columns", "ref_table", "ref_columns")] + [("shares_names", pa.bool_())]
    found = local_frame(spark, fields, rows)
    return found.join(s.row_counts(), "table_name")


def unique_columns(spark: SparkSession, d: str) -> DataFrame:
    return P.unique_columns(sample_source(spark, d, FILES))


def auto_increment(spark: SparkSession, d: str) -> DataFrame:
    return P.auto_increment_columns(sample_source(spark, d, FILES))


def schema_summary(spark: SparkSession, d: str) -> DataFrame:
    return CK.source_summary(sample_source(spark, d, WITH_JUNCTION))


def junction_tables(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, [*WITH_JUNCTION, "documents", "labels"])
    loose = S.junction_flags(s, rule="as_coded").select("table_name", F.col("is_junction").alias("is_junction_loose"))
    return (
        S.junction_flags(s)
        .join(loose, "table_name")
        .join(s.row_counts(), "table_name")
        .select(
            "table_name", F.size("fk_columns").cast("bigint").alias("n_fks"), F.array_join("pk_columns", ",").alias("pk"),
            "is_junction", "is_junction_loose", "row_count",
        )
    )


def table_kinds(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, WITH_JUNCTION)
    kind = F.when(F.col("is_junction"), "junction").otherwise("entity")
    return (
        S.junction_flags(s).join(s.row_counts(), "table_name").groupBy(kind.alias("kind"))
        .agg(F.count(F.lit(1)).alias("n_tables"), F.sum("row_count").alias("n_rows"))
    )


def _types(spark: SparkSession, d: str, function) -> DataFrame:
    s = sample_source(spark, d, FILES)
    stats = P.column_stats(s.tables, distinct=False)
    return stats.select(
        "table_name", "column_name", F.expr(function("sql_type")).alias("type"),
        F.expr(function("sql_type", as_coded=True)).alias("type_loose"),
        (F.col("row_count") - F.col("null_count")).alias("value_count"),
    )


def column_types(spark: SparkSession, d: str) -> DataFrame:
    return _types(spark, d, TY.column_type)


def graph_types(spark: SparkSession, d: str) -> DataFrame:
    return _types(spark, d, TY.graph_type)


def analysed_columns(spark: SparkSession, d: str) -> DataFrame:
    """What was analysed: columns and rows per table."""
    s = sample_source(spark, d, FILES)
    return (
        P.column_stats(s.tables, distinct=False).groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("n_columns"), F.max("row_count").alias("row_count"),
             F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"))
    )


def node_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels made of text values, with their rows."""
    s = sample_source(spark, d, ["part", "documents"])
    names = s["part"].select(F.concat_ws("_", "p_type", "p_brand", "p_name").alias("name"))
    names = names.unionByName(s["documents"].select(F.concat_ws("-", "source", "lang").alias("name")))
    return names.groupBy(F.expr(N.node_label("name")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def property_names(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, ["part"])
    name = N.property_name("concat_ws(' ', p_type, p_brand, p_name)")
    return s["part"].groupBy(F.expr(name).alias("property")).agg(F.count(F.lit(1)).alias("n"))


def relationship_types(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, ["orders", "customer"])
    pairs = s["orders"].join(s["customer"], F.col("o_custkey") == F.col("c_custkey"))
    name = N.relationship_type("concat('orders_', o_orderpriority)", "concat(c_mktsegment, 'Class')")
    return pairs.groupBy(F.expr(name).alias("rel_type")).agg(F.count(F.lit(1)).alias("n"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """How many values of some text columns could serve as identifiers."""
    s = sample_source(spark, d, ["part", "customer", "events", "documents"])
    columns = {"part": ["p_brand", "p_type", "p_name"], "customer": ["c_name", "c_mktsegment"],
               "events": ["event_type", "props"], "documents": ["text", "source"]}
    frames = [
        s[t].groupBy(F.lit(c).alias("column_name"), F.expr(N.is_valid_identifier(c)).alias("is_valid"))
        .agg(F.count(F.lit(1)).alias("n"))
        for t, cs in columns.items() for c in cs
    ]
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df)
    return first


QUERIES = {
    "b1_column_profile": column_profile,
    "b2_primary_keys": primary_keys,
    "b2_wide_keys": wide_keys,
    "b3_foreign_keys": foreign_keys,
    "b3_inclusions": inclusions,
    "b3_self_references": self_references,
    "b3_composite_keys": composite_keys,
    "b4_unique_columns": unique_columns,
    "b5_auto_increment": auto_increment,
    "b6_schema_summary": schema_summary,
    "b7_junction_tables": junction_tables,
    "b8_table_kinds": table_kinds,
    "b9_column_types": column_types,
    "b10_graph_types": graph_types,
    "b11_analysed_columns": analysed_columns,
    "g1_node_labels": node_labels,
    "g2_property_names": property_names,
    "g3_relationship_types": relationship_types,
    "g4_identifiers": identifiers,
}

# Columns of the test tables: i integer, l bigint, d double, s text, t timestamp, a float array.
_COLUMNS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:l c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:l s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:l p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:l l_partkey:l l_suppkey:l l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d "
    "l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:l ts:t user_id:l event_type:s value:d props:s",
    "documents": "doc_id:l text:s lang:s source:s n_chars:l",
    "embeddings": "vec_id:l embedding:a label:i",
    "pages": "page_id:l url:s html:s",
    "benchmark": "item_id:l text:s",
    "labels": "doc_id:l quality:i toxic:i",
    "conversations": "conv_id:l turn:l role:s text:s",
}
COLUMNS = {t: [tuple(c.split(":")) for c in text.split()] for t, text in _COLUMNS.items()}
_TYPE = {"i": "INTEGER", "l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "t": "TIMESTAMP", "a": "UNKNOWN"}
_LOOSE = {"i": "INTEGER", "l": "INTEGER", "d": "DOUBLE", "s": "UNKNOWN", "t": "TIMESTAMP", "a": "FLOAT"}
_GRAPH = {"i": "INTEGER", "l": "INTEGER", "d": "FLOAT", "s": "STRING", "t": "DATETIME", "a": "LIST"}
_GRAPH_LOOSE = {"i": "INTEGER", "l": "INTEGER", "d": "FLOAT", "s": "STRING", "t": "DATETIME", "a": "FLOAT"}


def _each(template: str, kinds: str = "ildsta") -> str:
    """The template for every column of every test table, joined by UNION ALL."""
    parts = []
    for t, columns in COLUMNS.items():
        for i, (c, k) in enumerate(columns, 1):
            if k in kinds:
                text = f"CAST(min({c}) AS VARCHAR)" if k in "ilsdt" else "NULL"
                parts.append(
                    template.format(
                        t=t, c=c, i=i, type=_TYPE[k], loose=_LOOSE[k], graph=_GRAPH[k], graph_loose=_GRAPH_LOOSE[k],
                        lo=text, hi=text.replace("min(", "max("), len=f"max(length({c}))" if k == "s" else "NULL",
                    )
                )
    return " UNION ALL ".join(parts)


def _key_sql(usable_of: dict[str, list[str]], also: str = "") -> str:
    """Every set of key columns tested exactly; smallest, then first in column order."""
    parts = []
    for t, usable in usable_of.items():
        rank = 0
        for arity in range(1, len(usable) + 1):
            for combo in combinations(usable, arity):
                rank += 1
                full = " AND ".join(f"count({c}) = count(*)" for c in combo)
                key = combo[0] if arity == 1 else f"({', '.join(combo)})"
                parts.append(
                    f"SELECT '{t}' AS t, '{','.join(combo)}' AS k, {arity} AS a, {rank} AS r, "
                    f"({full} AND count(DISTINCT {key}) = count(*)) AS ok FROM {t}"
                )
    counts = " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in usable_of)
    return f"""
        WITH {also} tested AS ({" UNION ALL ".join(parts)}),
             best AS (SELECT t, min(r) AS r FROM tested WHERE ok GROUP BY t), c AS ({counts})
        SELECT c.t AS table_name, tested.k AS key_columns, CAST(coalesce(tested.a, 0) AS BIGINT) AS arity, c.n AS row_count
        FROM c LEFT JOIN best ON best.t = c.t LEFT JOIN tested ON tested.t = best.t AND tested.r = best.r"""


# Column pairs with the same name stem and a single-column key on the parent side.
_FK_CANDIDATES = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("documents", "doc_id", "labels", "doc_id"),
)

def _shares_name(child: tuple[str, str], parent: tuple[str, str]) -> bool:
    """The stem is what follows a one-letter prefix; no key here is a bare ``id``."""
    stem = [re.sub("^[a-z]_", "", c.lower()) for _, c in (child, parent)]
    return stem[0] == stem[1] or child[1].lower() == stem[1]


def _inclusion_sql(columns: list[tuple[str, str, str, str]], named, also: str = "", refs: set[tuple[str, str]] | None = None) -> str:
    """Pairs of (table, column, kind, relation), decided by counting the values that both hold."""
    kind = {"i": "n", "l": "n", "s": "s", "t": "t"}
    values = " UNION ALL ".join(
        f"SELECT DISTINCT {i} AS i, '{kind[k]}' AS kind, CAST({c} AS VARCHAR) AS v FROM {x} WHERE {c} IS NOT NULL" for i, (t, c, k, x) in enumerate(columns)
    )
    facts = " UNION ALL ".join(
        f"SELECT {i} AS i, '{t}' AS t, '{c}' AS c, count(DISTINCT {c}) AS n, count(DISTINCT {c}) = count(*) AS u FROM {x}" for i, (t, c, k, x) in enumerate(columns)
    )
    same = [(i, j) for i, a in enumerate(columns) for j, b in enumerate(columns) if i != j and named(a[:2], b[:2])]
    allowed = "" if refs is None else f"AND b.i IN ({', '.join(str(i) for i, c in enumerate(columns) if c[:2] in refs)})"
    return f"""
        WITH {also} vals AS ({values}), facts AS ({facts}),
             common AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM vals x JOIN vals y ON x.kind = y.kind AND x.v = y.v AND x.i <> y.i GROUP BY ALL)
        SELECT a.t AS table_name, a.c AS column_name, b.t AS ref_table, b.c AS ref_column, a.n AS distinct_values, b.n AS ref_values,
               (a.i, b.i) IN ({', '.join(map(str, same))}) AS shares_name, b.u AS is_unique
        FROM common JOIN facts a ON a.i = common.a AND a.n = common.n JOIN facts b ON b.i = common.b {allowed}"""


SUPPLIER_PART = "(SELECT l_suppkey AS suppkey, l_partkey AS partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey, l_partkey)"
_ALL_ROWS = " + ".join(f"(SELECT count(*) FROM {t})" for t in TRADE) + f" + (SELECT count(*) FROM {SUPPLIER_PART})"
_PASCAL = "array_to_string(list_transform(string_split({x}, '_'), lambda w: upper(w[1:1]) || lower(w[2:])), '')"


def _pascal(x: str) -> str:
    return _PASCAL.replace("{x}", x)


ORACLES = {
    "b1_column_profile": _each(
        "SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal, '{type}' AS column_type, count(*) AS row_count, "
        "count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS ndv, "
        "count(DISTINCT {c}) = count(*) AS is_unique, {lo} AS min_value, {hi} AS max_value, CAST({len} AS BIGINT) AS max_length, "
        "CAST(NULL AS INT) AS precision, CAST(NULL AS INT) AS scale FROM {t}"
    ),
    "b2_primary_keys": _key_sql({t: [c for c, k in columns if k in "ilst"] for t, columns in COLUMNS.items()}),
    "b2_wide_keys": _key_sql(
        {"wide3": ["a", "b", "c"], "wide4": ["a", "b", "c", "e"]},
        "".join(f"{t} AS ({text.format(lineitem='lineitem')}), " for t, text in _WIDE.items()),
    ),
    "b3_foreign_keys": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{rt}' AS ref_table, '{rc}' AS ref_column, "
        f"count({c}) AS non_null_rows, count(DISTINCT {c}) AS distinct_values, CAST(0 AS BIGINT) AS orphan_rows FROM {t} "
        f"HAVING count({c}) > 0 AND count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {rc} FROM {rt})) = 0"
        for t, c, rt, rc in _FK_CANDIDATES
    ),
    "b3_inclusions": _inclusion_sql(
        [(t, c, k, t) for t, columns in COLUMNS.items() for c, k in columns if k in "ilst"], _shares_name
    ),
    "b3_self_references": _inclusion_sql(
        [("customer", "c_custkey", "l", "referred"), ("customer", "sent_by", "l", "referred"), ("customer", "c_name", "s", "referred"),
         *[("orders", c, k, "orders") for c, k in COLUMNS["orders"] if k in "ilst"]],
        _shares_name,
        "referred AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN (c_custkey + 1) // 2 END AS sent_by, c_name FROM customer), ",
        {("customer", "c_custkey")},
    ),
    "b3_composite_keys": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{a},{b}' AS columns, 'supplier_part' AS ref_table, 'suppkey,partkey' AS ref_columns, "
        f"{'true' if (a, b) == ('l_suppkey', 'l_partkey') else 'false'} AS shares_names, (SELECT count(*) FROM {x}) AS row_count "
        f"WHERE EXISTS (SELECT 1 FROM {x} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AND NOT EXISTS "
        f"(SELECT {a}, {b} FROM {x} WHERE {a} IS NOT NULL AND {b} IS NOT NULL EXCEPT SELECT suppkey, partkey FROM {SUPPLIER_PART})"
        for t, x, columns in (
            ("lineitem", "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]),
            ("supplier_part", SUPPLIER_PART, ["suppkey", "partkey"]),
            ("part", "part", ["p_partkey", "p_size"]), ("supplier", "supplier", ["s_suppkey", "s_nationkey"]),
        )
        for a in columns for b in columns if a != b and (t, a) != ("supplier_part", "suppkey")
    ),
    "b4_unique_columns": "SELECT table_name, column_name, ndv FROM ("
    + _each(
        "SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS ndv, count(*) AS n FROM {t}", "ilst"
    )
    + ") WHERE ndv = n AND (table_name, column_name) NOT IN (('region','r_regionkey'), ('nation','n_nationkey'), "
    "('customer','c_custkey'), ('supplier','s_suppkey'), ('part','p_partkey'), ('orders','o_orderkey'), "
    "('events','event_id'), ('documents','doc_id'), ('embeddings','vec_id'), ('pages','page_id'), "
    "('benchmark','item_id'), ('labels','doc_id'))",
    "b5_auto_increment": "SELECT table_name, column_name, first_value, last_value FROM ("
    + _each(
        "SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(min({c}) AS BIGINT) AS first_value, "
        "CAST(max({c}) AS BIGINT) AS last_value, count(*) AS n, count(DISTINCT {c}) AS u FROM {t}",
        "il",
    )
    + ") WHERE u = n AND last_value - first_value + 1 = n",
    "b6_schema_summary": f"""
        SELECT CAST(8 AS BIGINT) AS total_tables, CAST(7 AS BIGINT) AS entity_tables, CAST(1 AS BIGINT) AS junction_tables,
               CAST({sum(len(COLUMNS[t]) for t in TRADE) + 3} AS BIGINT) AS total_columns,
               CAST(9 AS BIGINT) AS total_foreign_keys, CAST(0 AS BIGINT) AS total_indexes,
               CAST({_ALL_ROWS} AS BIGINT) AS total_rows, CAST(8 AS BIGINT) AS tables_with_data""",
    "b7_junction_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST({n} AS BIGINT) AS n_fks, '{pk}' AS pk, {j} AS is_junction, {j} AS is_junction_loose, "
        f"count(*) AS row_count FROM {SUPPLIER_PART if t == 'supplier_part' else t}"
        for t, n, pk, j in (
            ("region", 0, "r_regionkey", "false"), ("nation", 1, "n_nationkey", "false"),
            ("customer", 1, "c_custkey", "false"), ("supplier", 1, "s_suppkey", "false"),
            ("part", 0, "p_partkey", "false"), ("orders", 1, "o_orderkey", "false"),
            ("lineitem", 3, "l_orderkey,l_partkey,l_suppkey,l_linenumber", "false"),
            ("supplier_part", 2, "suppkey,partkey", "true"), ("documents", 0, "doc_id", "false"),
            ("labels", 1, "doc_id", "false"),
        )
    ),
    "b8_table_kinds": f"""
        SELECT 'junction' AS kind, CAST(1 AS BIGINT) AS n_tables, count(*) AS n_rows FROM {SUPPLIER_PART}
        UNION ALL SELECT 'entity', 7, CAST({" + ".join(f"(SELECT count(*) FROM {t})" for t in TRADE)} AS BIGINT)""",
    "b9_column_types": _each(
        "SELECT '{t}' AS table_name, '{c}' AS column_name, '{type}' AS type, '{loose}' AS type_loose, count({c}) AS value_count FROM {t}"
    ),
    "b10_graph_types": _each(
        "SELECT '{t}' AS table_name, '{c}' AS column_name, '{graph}' AS type, '{graph_loose}' AS type_loose, count({c}) AS value_count FROM {t}"
    ),
    "b11_analysed_columns": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST({len(cs)} AS BIGINT) AS n_columns, count(*) AS row_count, CAST("
        + " + ".join(f"(CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END)" for c, _ in cs)
        + f" AS BIGINT) AS columns_with_nulls FROM {t}"
        for t, cs in COLUMNS.items()
    ),
    "g1_node_labels": f"""
        WITH names AS (SELECT concat_ws('_', p_type, p_brand, p_name) AS x FROM part
                       UNION ALL SELECT concat_ws('-', source, lang) FROM documents),
             clean AS (SELECT regexp_replace(x, '[^a-zA-Z0-9_]', '', 'g') AS y FROM names)
        SELECT {_pascal("y")} AS label, count(*) AS n FROM clean GROUP BY 1""",
    "g2_property_names": f"""
        WITH clean AS (SELECT trim(regexp_replace(concat_ws(' ', p_type, p_brand, p_name), '[^a-zA-Z0-9_]', '_', 'g'), '_') AS y FROM part)
        SELECT lower(string_split(y, '_')[1]) || {_pascal("array_to_string(string_split(y, '_')[2:], '_')")} AS property,
               count(*) AS n FROM clean GROUP BY 1""",
    "g3_relationship_types": """
        WITH pairs AS (SELECT regexp_replace('orders_' || o_orderpriority, 's+$', '') || '_'
                              || regexp_replace(c_mktsegment || 'Class', 's+$', '') AS x
                       FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT trim(regexp_replace(regexp_replace(upper(regexp_replace(x, '([A-Z])', '_\\1', 'g')), '[^A-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS rel_type,
               count(*) AS n FROM pairs GROUP BY 1""",
    "g4_identifiers": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, regexp_full_match({c}, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*') AS is_valid, count(*) AS n FROM {t} GROUP BY 2"
        for t, c in (
            ("part", "p_brand"), ("part", "p_type"), ("part", "p_name"), ("customer", "c_name"),
            ("customer", "c_mktsegment"), ("events", "event_type"), ("events", "props"), ("documents", "text"),
            ("documents", "source"),
        )
    ),
}

"""Registered queries on reading and writing (scans, paging, sinks), each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as CK
from ..operators import semantics as S
from ..sources import paging, sinks
from ..sources.source import union_all
from .build import build_graph
from .pipeline import analyze, migrate
from .sample import FILES, TRADE, sample_source

BATCH = 1000


def table_scan(spark: SparkSession, d: str) -> DataFrame:
    return sample_source(spark, d, ["customer"])["customer"]


def ordered_batches(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, ["orders"])
    b = paging.batches(s["orders"], s.primary_key("orders"), BATCH, rows_per_range=5000)
    return b.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("o_orderkey").alias("first_key"),
        F.max("o_orderkey").alias("last_key"),
        F.count_if(F.col("o_orderstatus") == "O").alias("n_open"),
    )


def composite_batches(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, ["conversations"])
    b = paging.batches(s["conversations"], s.primary_key("conversations"), 100, rows_per_range=64)
    return b.select("conv_id", "turn", "batch_id")


def single_page(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, ["orders"])
    return paging.page(s["orders"], s.primary_key("orders"), 2 * BATCH, BATCH)


def deep_page(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, ["orders"])
    return paging.page(s["orders"], s.primary_key("orders"), 2 * BATCH, BATCH, top_rows=0, rows_per_range=4000)


def key_range(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, ["orders"])
    return paging.key_range(s["orders"], s.primary_key("orders"), 100, 1100)


def row_counts(spark: SparkSession, d: str) -> DataFrame:
    return sample_source(spark, d, FILES).row_counts()


def adhoc_sql(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d)
    return s.sql(
        "SELECT c_mktsegment, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers "
        "FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderstatus = :status GROUP BY c_mktsegment",
        {"status": "O"},
    )


def table_selection(spark: SparkSession, d: str) -> DataFrame:
    g = build_graph(sample_source(spark, d).only(["customer", "orders", "nation"]), "direct")
    edges = g.edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))
    nodes = union_all(
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("name"), "n") for label, df in g.nodes.items()
    )
    return nodes.unionByName(edges.select(F.col("rel_type").alias("name"), "n"))


def _written(spark: SparkSession, d: str):
    g = build_graph(sample_source(spark, d, ["region", "nation", "customer", "orders"]), "enriched")
    return g, sinks.scratch_folder(spark)


def node_sink(spark: SparkSession, d: str) -> DataFrame:
    g, path = _written(spark, d)
    sinks.write_nodes(g.nodes, f"{path}/nodes")
    read = [sinks.read_nodes(spark, f"{path}/nodes", label).withColumn("label", F.lit(label)) for label in g.nodes]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


def edge_sink(spark: SparkSession, d: str) -> DataFrame:
    g, path = _written(spark, d)
    sinks.write_edges(g.edges, f"{path}/edges")
    return sinks.read_edges(spark, f"{path}/edges").select("rel_type", "from_label", "from_key", "to_label", "to_key", "cardinality")


def csv_staging(spark: SparkSession, d: str) -> DataFrame:
    g, path = _written(spark, d)
    read = lambda folder: spark.read.option("header", True).option("escape", '"').csv(folder)
    found = []
    for label, df in g.nodes.items():
        sinks.write_csv(sinks.bulk_nodes(df, label), f"{path}/csv/{label}")
        cells = read(f"{path}/csv/{label}")
        properties = [f"`{c}`" for c in cells.columns if not c.startswith(":")]
        found.append(
            cells.select(
                F.lit("node").alias("kind"), F.col("`:LABEL`").alias("type"), F.col(f"`:ID({label})`").alias("start_id"),
                F.lit(None).cast("string").alias("end_id"), F.concat_ws("|", *properties).alias("cells"),
            )
        )
    sinks.write_csv(sinks.bulk_edges(g.edges), f"{path}/csv/edges")
    edges = read(f"{path}/csv/edges").select(
        F.lit("edge").alias("kind"), F.col("`:TYPE`").alias("type"), F.col("`:START_ID`").alias("start_id"),
        F.col("`:END_ID`").alias("end_id"), F.concat_ws("|", "cardinality", "props").alias("cells"),
    )
    return union_all([*found, edges])


def clear_target(spark: SparkSession, d: str) -> DataFrame:
    """Two loads into each of two targets: one appends, the other is cleared first."""
    g, path = _written(spark, d)
    found = []
    for name, clear in (("append", False), ("replace", True)):
        nodes, edges = f"{path}/{name}/nodes", f"{path}/{name}/edges"
        for _ in range(2):
            sinks.write_nodes({"Customer": g.nodes["Customer"]}, nodes, clear=clear)
            sinks.write_edges(g.edges, edges, clear=clear)
        for what, df in (("nodes", sinks.read_nodes(spark, nodes, "Customer")), ("edges", sinks.read_edges(spark, edges))):
            found.append(df.selectExpr("count(1) AS n").selectExpr(f"'{name}' AS target", f"'{what}' AS what", "n"))
    return union_all(found)


def second_load(spark: SparkSession, d: str) -> DataFrame:
    """A load of four tables and then one of two to the same place: what is left of labels and edges."""
    path = sinks.scratch_folder(spark)
    for names in (["region", "nation", "customer", "orders"], ["region", "nation"]):
        migrate(analyze(sample_source(spark, d, names)), path)
    path = sinks.current_version(spark, path)
    nodes = spark.read.parquet(f"{path}/nodes").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    edges = spark.read.parquet(f"{path}/edges").groupBy("from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))
    return nodes.select(F.lit("nodes").alias("what"), F.col("label").alias("name"), "n").unionByName(
        edges.select(F.lit("edges").alias("what"), F.concat_ws(">", "from_label", "to_label").alias("name"), "n")
    )


def repeated_load(spark: SparkSession, d: str) -> DataFrame:
    """Three loads that add: all customers, the same again, then those of one segment renamed, beside the nations."""
    path = sinks.scratch_folder(spark)
    s = sample_source(spark, d, ["nation", "customer"])
    some = s["customer"].where("c_mktsegment = 'BUILDING'").withColumn("c_name", F.lit("renamed"))
    for source in (s, s, s.with_tables(customer=some)):
        g = migrate(analyze(source), path, clear=False)
    nodes = g.nodes["Customer"].groupBy("cName").agg(F.count(F.lit(1)).alias("n"))
    names = nodes.groupBy((F.col("cName") == "renamed").alias("renamed")).agg(F.sum("n").alias("n"))
    edges = g.edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))
    return names.select(F.when(F.col("renamed"), "renamed").otherwise("first name").alias("what"), "n").unionByName(
        edges.select(F.col("rel_type").alias("what"), "n")
    )


def many_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Batches of orders by a text key, from many more ranges than the first level of split points has."""
    orders = sample_source(spark, d, ["orders"])["orders"]
    keyed = orders.selectExpr("concat_ws('-', o_orderpriority, lpad(o_orderkey, 12, '0')) AS `the.key`", "o_custkey")
    batches = paging.batches(keyed, ["the.key"], 100, rows_per_range=1)
    return batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("`the.key`").alias("first_key"), F.max("`the.key`").alias("last_key"), F.sum("o_custkey").alias("customers")
    )


def user_edges_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the user, written, read back and checked: those to customers that do not exist are found."""
    source = sample_source(spark, d, ["region", "nation", "customer"])
    known = source["customer"].selectExpr(
        "'KNOWS' AS rel_type", "'Customer' AS from_label", "CAST(c_custkey AS STRING) AS from_key",
        "'Customer' AS to_label", "CAST(c_custkey + 3 AS STRING) AS to_key",
    )
    g, path = build_graph(source, "enriched").with_edges("knows", known), sinks.scratch_folder(spark)
    sinks.write_nodes(g.nodes, f"{path}/nodes")
    sinks.write_edges(g.edges, f"{path}/edges")
    stored = sinks.read_graph(spark, path, g)
    count = stored.edges.where("rel_type = 'KNOWS'").selectExpr("'KNOWS' AS rel_type", "'edges' AS found").groupBy("rel_type", "found")
    lost = CK.missing_nodes(stored).select("rel_type", F.col("missing").alias("found"), "n")
    return count.agg(F.count(F.lit(1)).alias("n")).unionByName(lost)


def pages_with_null_key(spark: SparkSession, d: str) -> DataFrame:
    """The first page of orders one of which has a null key, as a top-k and by row number."""
    orders = sample_source(spark, d, ["orders"])["orders"]
    first = orders.agg(F.min("o_orderkey").alias("first"))
    df = orders.join(first, orders["o_orderkey"] == first["first"], "left").selectExpr("CASE WHEN first IS NULL THEN o_orderkey END AS k")
    return union_all(
        paging.page(df, ["k"], 0, 20, **how).withColumn("path", F.lit(name))
        for name, how in (("top", {}), ("numbered", {"top_rows": 0, "rows_per_range": 500}))
    )


def json_export(spark: SparkSession, d: str) -> DataFrame:
    """Catalog, conceptual and graph model as JSON, read back as (model, name, n)."""
    s = sample_source(spark, d)
    path = sinks.scratch_folder(spark)
    m, g = S.enrich(s), build_graph(s, "enriched")
    tables = s.cat_tables().join(s.row_counts(), "table_name")
    edges = g.edges.groupBy("fk_name").agg(F.count(F.lit(1)).alias("edge_count"))
    sinks.write_json(
        {"tables": tables, "entities": m.entities, "relationships": g.rel_types().join(edges, "fk_name")}, path
    )
    read = spark.read.json
    return (
        read(f"{path}/tables").select(F.lit("schema").alias("model"), F.col("table_name").alias("name"), F.col("row_count").alias("n"))
        .unionByName(read(f"{path}/relationships").select(F.lit("graph").alias("model"), F.col("fk_name").alias("name"), F.col("edge_count").alias("n")))
        .unionByName(read(f"{path}/entities").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
                     .select(F.lit("conceptual").alias("model"), F.col("entity_type").alias("name"), "n"))
    )


QUERIES = {
    "a1_table_scan": table_scan,
    "a3_ordered_batches": ordered_batches,
    "a3_composite_batches": composite_batches,
    "a3_many_ranges": many_ranges,
    "a4_single_page": single_page,
    "a4_deep_page": deep_page,
    "a5_key_range": key_range,
    "a6_row_counts": row_counts,
    "a7_adhoc_sql": adhoc_sql,
    "a8_table_selection": table_selection,
    "a9_node_sink": node_sink,
    "a10_edge_sink": edge_sink,
    "a11_csv_staging": csv_staging,
    "a12_clear_target": clear_target,
    "a12_second_load": second_load,
    "a12_repeated_load": repeated_load,
    "a10_user_edges": user_edges_read_back,
    "a4_null_key": pages_with_null_key,
    "a13_json_export": json_export,
}

_EDGES = """
SELECT 'PART_OF_REGION' AS rel_type, 'Nation' AS from_label, CAST(n_nationkey AS VARCHAR) AS from_key,
       'Region' AS to_label, CAST(n_regionkey AS VARCHAR) AS to_key, 'N:1' AS cardinality FROM nation
UNION ALL SELECT 'PART_OF_NATION', 'Customer', CAST(c_custkey AS VARCHAR), 'Nation', CAST(c_nationkey AS VARCHAR), 'N:1' FROM customer
UNION ALL SELECT 'PURCHASED_BY', 'Orders', CAST(o_orderkey AS VARCHAR), 'Customer', CAST(o_custkey AS VARCHAR), 'N:1' FROM orders
"""

ORACLES = {
    "a1_table_scan": "SELECT * FROM customer",
    "a3_ordered_batches": f"""
        SELECT b AS batch_id, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key,
               count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open
        FROM (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // {BATCH} AS b FROM orders) GROUP BY b""",
    "a3_composite_batches": """
        SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 100 AS batch_id FROM conversations""",
    "a3_many_ranges": """
        SELECT b AS batch_id, count(*) AS n, min(k) AS first_key, max(k) AS last_key, CAST(sum(o_custkey) AS BIGINT) AS customers
        FROM (SELECT *, (row_number() OVER (ORDER BY k) - 1) // 100 AS b
              FROM (SELECT o_orderpriority || '-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS k, o_custkey FROM orders)) GROUP BY b""",
    "a4_single_page": f"SELECT * FROM orders ORDER BY o_orderkey LIMIT {BATCH} OFFSET {2 * BATCH}",
    "a4_deep_page": f"SELECT * FROM orders ORDER BY o_orderkey LIMIT {BATCH} OFFSET {2 * BATCH}",
    "a5_key_range": "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100",
    "a6_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in FILES),
    "a7_adhoc_sql": """
        SELECT c_mktsegment, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY c_mktsegment""",
    "a8_table_selection": """
        SELECT 'Customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'Orders', count(*) FROM orders
        UNION ALL SELECT 'Nation', count(*) FROM nation
        UNION ALL SELECT 'ORDER_CUSTOMER', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'CUSTOMER_NATION', count(*) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)""",
    "a9_node_sink": """
        SELECT CAST(r_regionkey AS VARCHAR) AS node_key, 'Region' AS label, r_regionkey AS "rRegionkey", r_name AS "rName" FROM region
        UNION ALL BY NAME SELECT CAST(n_nationkey AS VARCHAR) AS node_key, 'Nation' AS label, n_nationkey AS "nNationkey", n_name AS "nName",
            n_regionkey AS "nRegionkey" FROM nation
        UNION ALL BY NAME SELECT CAST(c_custkey AS VARCHAR) AS node_key, 'Customer' AS label, c_custkey AS "cCustkey", c_name AS "cName",
            c_nationkey AS "cNationkey", c_acctbal AS "cAcctbal", c_mktsegment AS "cMktsegment" FROM customer
        UNION ALL BY NAME SELECT CAST(o_orderkey AS VARCHAR) AS node_key, 'Orders' AS label, o_orderkey AS "oOrderkey", o_custkey AS "oCustkey",
            o_orderstatus AS "oOrderstatus", o_totalprice AS "oTotalprice", strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "oOrderdate",
            o_orderpriority AS "oOrderpriority" FROM orders""",
    "a10_edge_sink": _EDGES,
    "a11_csv_staging": f"""
        SELECT 'node' AS kind, 'Region' AS type, CAST(r_regionkey AS VARCHAR) AS start_id, NULL AS end_id, concat_ws('|', r_regionkey, r_name) AS cells FROM region
        UNION ALL SELECT 'node', 'Nation', CAST(n_nationkey AS VARCHAR), NULL, concat_ws('|', n_nationkey, n_name, n_regionkey) FROM nation
        UNION ALL SELECT 'node', 'Customer', CAST(c_custkey AS VARCHAR), NULL, concat_ws('|', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) FROM customer
        UNION ALL SELECT 'node', 'Orders', CAST(o_orderkey AS VARCHAR), NULL,
            concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority) FROM orders
        UNION ALL SELECT 'edge', rel_type, from_key, to_key, 'N:1' FROM ({_EDGES})""",
    "a12_clear_target": f"""
        SELECT 'append' AS target, 'nodes' AS what, 2 * count(*) AS n FROM customer
        UNION ALL SELECT 'replace', 'nodes', count(*) FROM customer
        UNION ALL SELECT 'append', 'edges', 2 * count(*) FROM ({_EDGES})
        UNION ALL SELECT 'replace', 'edges', count(*) FROM ({_EDGES})""",
    "a12_second_load": """
        SELECT 'nodes' AS what, 'Region' AS name, count(*) AS n FROM region
        UNION ALL SELECT 'nodes', 'Nation', count(*) FROM nation
        UNION ALL SELECT 'edges', 'Nation>Region', count(*) FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)""",
    "a12_repeated_load": """
        SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'renamed' ELSE 'first name' END AS what, count(*) AS n FROM customer GROUP BY 1
        UNION ALL SELECT 'PART_OF_NATION', count(*) FROM customer""",
    "a10_user_edges": """
        SELECT 'KNOWS' AS rel_type, 'edges' AS found, count(*) AS n FROM customer
        UNION ALL SELECT 'KNOWS', 'to', count(*) FROM customer WHERE c_custkey + 3 NOT IN (SELECT c_custkey FROM customer)""",
    "a4_null_key": """
        WITH one AS (SELECT min(o_orderkey) AS k FROM orders),
             t AS (SELECT nullif(o_orderkey, one.k) AS k FROM orders, one),
             p AS (SELECT k FROM t ORDER BY k NULLS FIRST LIMIT 20)
        SELECT k, 'top' AS path FROM p UNION ALL SELECT k, 'numbered' FROM p""",
    "a13_json_export": " UNION ALL ".join(
        [f"SELECT 'schema' AS model, '{t}' AS name, count(*) AS n FROM {t}" for t in TRADE]
        + [
            f"SELECT 'graph', '{fk}', count(*) FROM {t}"
            for fk, t in (
                ("nation_region", "nation"), ("customer_nation", "customer"), ("supplier_nation", "supplier"),
                ("orders_customer", "orders"), ("lineitem_orders", "lineitem"), ("lineitem_part", "lineitem"),
                ("lineitem_supplier", "lineitem"),
            )
        ]
        + ["SELECT 'conceptual', 'STRONG', 6", "SELECT 'conceptual', 'WEAK', 1"]
    ),
}

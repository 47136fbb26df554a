"""Registered queries on graph construction and graph patterns, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import checks as CK
from ..operators import edges as E
from ..operators import match as M
from ..operators import nodes as ND
from ..operators import profile as P
from ..sources import sinks
from ..sources.source import ForeignKey, Source, union_all
from .build import GraphMapping, build_graph, merge_inheritance
from .q_semantics import IN_TRADE, MEANING, rel
from .sample import TRADE, sample_source

SEGMENT = "BUILDING"


def _graph(spark: SparkSession, d: str, names=TRADE, mode: str = "enriched", **options) -> Graph:
    return build_graph(sample_source(spark, d, names), mode, **options)


def _one_segment(g: Graph) -> DataFrame:
    return g.nodes["Customer"].where(f"cMktsegment = '{SEGMENT}'")


# -- nodes ------------------------------------------------------------------------------------


def nodes_direct(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, ["customer", "orders"], "direct").nodes["Orders"]


def nodes_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation: a two-column key, every column kept, nulls not counted."""
    df = _graph(spark, d, ["conversation", "conversations"]).nodes["Conversations"]
    return df.withColumn("n_properties", ND.property_count(df))


def node_property_maps(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with their properties as one JSON text, customers without orders showing nulls stripped."""
    s = sample_source(spark, d, ["customer", "orders"])
    last = s["orders"].groupBy("o_custkey").agg({"o_orderkey": "max"}).withColumnRenamed("max(o_orderkey)", "last_order")
    joined = s["customer"].join(last, s["customer"]["c_custkey"] == last["o_custkey"], "left").drop("o_custkey")
    nodes = build_graph(s.with_tables(customer=joined)).nodes["Customer"]
    return ND.property_map(nodes)


def shared_label(spark: SparkSession, d: str) -> DataFrame:
    """Customers in two tables whose names give one label; a column that only one has, and one of two types."""
    c = sample_source(spark, d, ["customer"])["customer"]
    tables = {
        "big_customer": c.where(f"c_mktsegment = '{SEGMENT}'").select("c_custkey", "c_name", "c_nationkey"),
        "big-_customer": c.where(f"c_mktsegment <> '{SEGMENT}'").selectExpr("c_custkey", "c_mktsegment", "concat('n', c_nationkey) AS c_nationkey"),
    }
    s = Source(spark, tables, primary_keys={t: ("c_custkey",) for t in tables})
    g = build_graph(s)
    counts = CK.reconcile_counts(s, g).select("label", "is_match")
    return g.nodes["BigCustomer"].join(counts, "label").select("node_key", "label", "cName", "cNationkey", "cMktsegment", "is_match")


def converted_values(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps as text, JSON text as values, and text that is no JSON kept as text."""
    s = sample_source(spark, d, ["events"])
    s = Source(s.spark, s.tables, primary_keys=s.primary_keys,
               sql_types={("events", "props"): "json", ("events", "event_type"): "json"})
    return build_graph(s, "direct").nodes["Events"].selectExpr(
        "eventId", "ts", "variant_get(props, '$.k', 'bigint') AS k", "to_json(props) AS props", "CAST(eventType AS STRING) AS event_type", "userId", "value"
    )


def merged_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Documents, labels and flagged documents as one node per document with up to three labels."""
    g = _graph(spark, d, ["documents", "labels", "flagged_document"])
    merged = ND.merge_subclass(g.nodes["Documents"], g.nodes["Labels"], parent_key="docId", child_key="docId", child_label="Labels")
    merged = ND.merge_subclass(
        merged, g.nodes["FlaggedDocument"], parent_key="docId", child_key="docId", child_label="FlaggedDocument"
    )
    return merged.selectExpr("docId", "array_join(labels, ':') AS labels", "lang", "nChars", "quality", "toxic")


def merged_graph(spark: SparkSession, d: str) -> DataFrame:
    """The same for a whole graph: label sets and edge types that are left."""
    g = merge_inheritance(_graph(spark, d, ["documents", "labels", "flagged_document", "conversation", "conversations"]))
    nodes = g.nodes["Documents"].selectExpr("array_join(labels, ':') AS name").groupBy("name").count()
    return nodes.unionByName(g.edges.selectExpr("rel_type AS name").groupBy("name").count()).withColumnRenamed("count", "n")


def two_superclasses(spark: SparkSession, d: str) -> DataFrame:
    """Flagged documents are labels and urgent ones; both are documents. And some are also pages, a hierarchy of its own."""
    s = sample_source(spark, d, ["documents", "labels", "pages"])
    labels = s["labels"]
    tables = {
        "documents": s["documents"], "labels": labels, "urgent": labels.where("quality = 0").select("doc_id", "quality"),
        "flagged": labels.where("toxic = 1 AND quality = 0").select("doc_id"),
        "page": s["pages"].selectExpr("page_id AS doc_id", "url"), "linked": labels.where("toxic = 1").select("doc_id"),
    }
    links = [("labels", "documents"), ("urgent", "documents"), ("flagged", "labels"), ("flagged", "urgent"), ("linked", "documents"), ("linked", "page")]
    fks = tuple(ForeignKey(f"{a}_{b}", a, "doc_id", b, "doc_id") for a, b in links)
    s = Source(spark, tables, primary_keys={t: ("doc_id",) for t in tables}, foreign_keys=fks)
    g = merge_inheritance(build_graph(s))
    nodes = g.nodes["Documents"].selectExpr("array_join(array_sort(labels), ':') AS name").groupBy("name").count()
    counts = CK.reconcile_counts(s, g).selectExpr("concat(label, ' ', difference) AS name", "target_count AS count")
    edges = g.edges.groupBy(F.concat_ws(" ", "rel_type", "from_label", "to_label").alias("name")).count()
    return nodes.unionByName(counts).unionByName(edges).withColumnRenamed("count", "n")


def derived_property(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d, ["customer"], derived={"customer": {"fullName": "concat(cName, ' of ', cMktsegment)"}})
    return g.nodes["Customer"].select("node_key", "fullName")


# -- edges ------------------------------------------------------------------------------------


def fk_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).edges.drop("props")


def fk_edges_direct(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, mode="direct").edges.groupBy("rel_type", "from_label", "to_label").count().withColumnRenamed("count", "n")


def composite_source(spark: SparkSession, d: str) -> Source:
    """Line items that refer to pairs of supplier and part, some of which are missing, by a foreign key of two columns."""
    s = sample_source(spark, d, ["lineitem", "supplier_part"])
    fk = ForeignKey("lineitem_pair", "lineitem", ("l_partkey", "l_suppkey"), "supplier_part", ("partkey", "suppkey"))
    return replace(s, foreign_keys=(fk,)).with_tables(supplier_part=s["supplier_part"].where("qty > 20"))


def composite_edges(spark: SparkSession, d: str) -> DataFrame:
    """Once with the parents looked up, once from the profile of the discovered and declared keys."""
    s = composite_source(spark, d)
    profiled = build_graph(s, evidence=P.materialize(P.fk_profile(s)), row_counts={"supplier_part": 10**9})
    both = build_graph(s).edges.selectExpr("'joined' AS path", "*").unionByName(profiled.edges.selectExpr("'profiled' AS path", "*"))
    return both.groupBy("path", "rel_type", "from_label", "to_label", "to_key", "cardinality").count().withColumnRenamed("count", "n")


def translated_source(spark: SparkSession, d: str) -> Source:
    """Orders that name their customer by its name, which is unique but not the key, and customers their nation so."""
    s = sample_source(spark, d, ["orders", "customer", "nation"])
    named = s["customer"].select("c_custkey", "c_name")
    orders = s["orders"].join(named, F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_orderkey", "nullif(c_name, 'Customer#5') AS buyer")
    fks = (
        ForeignKey("orders_buyer", "orders", "buyer", "customer", "c_name"),
        ForeignKey("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    )
    kept = s["customer"].where(f"c_mktsegment = '{SEGMENT}'")
    return replace(s, foreign_keys=fks, unique_keys={"customer": (("c_name",),)}).with_tables(orders=orders, customer=kept)


def translated_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges end at the nodes' keys, whatever column the foreign key refers to."""
    return build_graph(translated_source(spark, d)).edges.select("fk_name", "rel_type", "from_key", "to_label", "to_key")


def junction_edges(spark: SparkSession, d: str) -> DataFrame:
    s = sample_source(spark, d, ["supplier", "part", "supplier_part"])
    g = build_graph(s)
    edge = next(e for e in g.edge_types if e.fk.table == "supplier_part")
    return E.junction_edges(s, "supplier_part", edge, g.names, flat=True, check=s.fks_of("supplier_part")).drop("fk_name")


def matched_endpoints(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d, ["customer", "orders"], assume_complete=True)
    return E.match_endpoints(g.edges, g.nodes["Orders"], _one_segment(g)).select("rel_type", "from_key", "to_key")


def spread_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Line items of their parts and suppliers, hot parents spread over several tasks."""
    g = _graph(spark, d, assume_complete=True)
    edges = g.edge_sets["lineitem"].where("rel_type = 'PART_OF_SUPPLIER'")
    busy = g.nodes["Supplier"].where("sAcctbal > 0")
    joined = E.match_endpoints(edges, g.nodes["Lineitem"], busy, spread=True, hot_rows=500)
    return joined.groupBy("rel_type", "to_key").count().withColumnRenamed("count", "n")


def dropped_edges(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d, ["customer", "orders"], assume_complete=True)
    return E.missing_endpoints(g.edges, _one_segment(g), "to").select("rel_type", "from_key", "to_key")


def complete_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a source whose customers are one segment: the build itself drops the rest."""
    s = sample_source(spark, d, ["customer", "orders", "events"])
    s = s.with_tables(customer=s["customer"].where(f"c_mktsegment = '{SEGMENT}'"))
    return build_graph(s).edges.select("rel_type", "from_key", "to_key")


def profiled_edges(spark: SparkSession, d: str) -> DataFrame:
    """The same through the profile: proven keys are not joined, orphans are broadcast."""
    s = sample_source(spark, d, ["nation", "customer", "orders", "events"])
    s = s.with_tables(customer=s["customer"].where(f"c_mktsegment = '{SEGMENT}'"))
    g = build_graph(s, evidence=P.materialize(P.fk_profile(s)))
    return g.edges.where("to_label = 'Customer'").select("rel_type", "from_key", "to_key")


def duplicated_parents(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one segment, each twice, looked up by a join and by a broadcast of orphans: an order stays one edge."""
    s = sample_source(spark, d, ["customer", "orders"])
    one = s["customer"].where(f"c_mktsegment = '{SEGMENT}'")
    s = s.with_tables(customer=one.unionByName(one))
    paths = {"joined": build_graph(s), "profiled": build_graph(s, evidence=P.materialize(P.fk_profile(s)))}
    joined, profiled = (g.edges.selectExpr(f"'{p}' AS path", "rel_type", "from_key", "to_key") for p, g in paths.items())
    return joined.unionByName(profiled)


def nary_table(spark: SparkSession, d: str) -> DataFrame:
    """A table with three foreign keys stays a node and gives three edges per row."""
    g = _graph(spark, d)
    edges = g.edge_sets["lineitem"].groupBy("rel_type").count().selectExpr("rel_type AS name", "count AS n")
    return M.node_counts(g, "Lineitem").selectExpr("label AS name", "n").unionByName(edges)


def user_edges(spark: SparkSession, d: str) -> DataFrame:
    """FOLLOWED_BY edges between consecutive turns, beside the foreign-key edges."""
    s = sample_source(spark, d, ["conversation", "conversations"])
    g = build_graph(s)
    turns = g.nodes["Conversations"].select("node_key", "convId", "turn")
    later = turns.selectExpr("node_key AS to_key", "convId AS conv", "turn - 1 AS previous")
    own = turns.join(later, (turns["convId"] == later["conv"]) & (turns["turn"] == later["previous"])).selectExpr(
        "'FOLLOWED_BY' AS rel_type", "'Conversations' AS from_label", "node_key AS from_key",
        "'Conversations' AS to_label", "to_key",
    )
    return g.with_edges("turn_order", own).edges.select("rel_type", "from_key", "to_key", "cardinality")


def mapping_choices(spark: SparkSession, d: str) -> DataFrame:
    """Only some tables become nodes, one relationship is renamed, cardinality is off."""
    mapping = GraphMapping(
        tables_as_nodes=("orders", "customer", "supplier", "part"),
        custom_relationships={"supplier_part": "OFFERS", "orders": "PLACED_BY"},
        infer_cardinality=False,
    )
    g = _graph(spark, d, [*TRADE, "supplier_part"], mapping=mapping)
    edges = g.edges.selectExpr("rel_type AS name", "cardinality").groupBy("name", "cardinality").count()
    nodes = M.node_counts(g).selectExpr("label AS name", "CAST(NULL AS STRING) AS cardinality", "n")
    return nodes.unionByName(edges.withColumnRenamed("count", "n"))


# -- constraints and layout -------------------------------------------------------------------


def unique_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Uniqueness of the key of every label, and of a shorter line-item key that is no key."""
    g = _graph(spark, d)
    keys = {label: (df, ["node_key"]) for label, df in g.nodes.items()}
    keys["Lineitem (short)"] = (g.nodes["Lineitem"], ["lOrderkey", "lLinenumber"])
    return CK.duplicate_keys(keys)


def lookup_layout(spark: SparkSession, d: str) -> DataFrame:
    """Customers written sorted by segment, then looked up by it."""
    g = _graph(spark, d, ["customer"])
    path = sinks.scratch_folder(spark)
    sinks.write_nodes({"Customer": g.nodes["Customer"]}, path, clear=True, sort_by={"Customer": ["cMktsegment"]})
    return sinks.read_nodes(spark, path, "Customer").where(f"cMktsegment = '{SEGMENT}'").select("node_key", "cName")


def bucketed_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders and customers as bucketed tables, joined on the customer's key without an exchange."""
    g = _graph(spark, d, ["customer", "orders"])
    tables = []
    for name, df, key in (("customers", g.nodes["Customer"], "node_key"), ("purchases", g.edges.drop("props"), "to_key")):
        path = sinks.scratch_folder(spark)
        tables.append(sinks.write_bucketed(df, f"graphlift_{name}_{path[-8:]}", key, buckets=8, path=path))
    customers, edges = tables
    joined = edges.hint("merge").join(customers, edges["to_key"] == customers["node_key"])
    return joined.groupBy("cMktsegment", "rel_type").agg(F.count(F.lit(1)).alias("n"))


def required_properties(spark: SparkSession, d: str) -> DataFrame:
    """Required columns of orders left-joined to one segment's customers, so that nulls occur."""
    s = sample_source(spark, d, ["customer", "orders"])
    some = s["customer"].where(f"c_mktsegment = '{SEGMENT}'").select("c_custkey")
    orders = s["orders"].join(some, s["orders"]["o_custkey"] == some["c_custkey"], "left").drop("o_custkey")
    return CK.required_properties(s.with_tables(orders=orders.withColumnRenamed("c_custkey", "o_custkey")))


def model_summary(spark: SparkSession, d: str) -> DataFrame:
    """Labels and types of the model with what they hold."""
    g = _graph(spark, d)
    counts = M.node_counts(g).selectExpr("label AS name", "n").unionByName(
        M.edge_counts(g).groupBy("rel_type").sum("n").selectExpr("rel_type AS name", "`sum(n)` AS n")
    )
    return M.model_summary(g).join(counts, "name").drop("kind")


def types_of_label(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    keys = ["rel_type", "from_label", "to_label"]
    return M.types_of_label(g, "Nation").select(*keys).join(M.edge_counts(g), keys)


# -- counts and patterns ----------------------------------------------------------------------


def node_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.node_counts(_graph(spark, d))


def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.edge_counts(_graph(spark, d))


def edges_per_segment(spark: SparkSession, d: str) -> DataFrame:
    """Purchases per market segment."""
    g = _graph(spark, d, ["customer", "orders"])
    found = M.match(
        g, [M.node("o", "Orders"), M.step("PURCHASED_BY"), M.node("c", "Customer")], returns={"segment": "c.cMktsegment"}
    )
    return found.groupBy("segment").count().withColumnRenamed("count", "n")


def histogram(spark: SparkSession, d: str) -> DataFrame:
    return M.histogram(_graph(spark, d))


def one_hop(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d, ["customer", "orders"])
    return M.match(
        g,
        [M.node("o", "Orders"), M.step("PURCHASED_BY", var="r"), M.node("c", "Customer")],
        where="o.oOrderstatus = 'O'",
        returns={"order_id": "o.oOrderkey", "customer": "c.cName", "cardinality": "r.cardinality"},
        order_by=["order_id"],
        limit=10,
    )


def two_hops(spark: SparkSession, d: str, **options) -> DataFrame:
    g = _graph(spark, d)
    return M.match(
        g,
        [M.node("l", "Lineitem"), M.step("PART_OF_ORDERS"), M.node("o", "Orders"), M.step("PURCHASED_BY"), M.node("c", "Customer")],
        where=f"c.cMktsegment = '{SEGMENT}' AND o.oOrderpriority = '1-URGENT'",
        returns={"customer": "c.cName", "order_id": "o.oOrderkey", "line": "l.lLinenumber", "part_id": "l.lPartkey"},
        **options,
    )


def two_hops_spread(spark: SparkSession, d: str) -> DataFrame:
    """The same with customers of many orders, and orders of many lines, cut into parts."""
    return two_hops(spark, d, spread=True, hot_rows=12)


def two_hops_inward(spark: SparkSession, d: str) -> DataFrame:
    """The chain from its far end: region <- nation <- customer."""
    g = _graph(spark, d)
    return M.match(
        g,
        [M.node("r", "Region"), M.step("PART_OF_REGION", "in"), M.node("n", "Nation"), M.step("PART_OF_NATION", "in"), M.node("c", "Customer")],
        where="r.rName = 'ASIA'",
        returns={"region": "r.rName", "nation": "n.nName", "customer": "c.cName"},
    )


def counted_paths(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of orders of one customer, and of line items of one supplier, and longer ways, counted without forming them."""
    g = _graph(spark, d)
    order, customer, line, supplier = M.node("o", "Orders"), M.node("c", "Customer"), M.node("l", "Lineitem"), M.node("s", "Supplier")
    buys, supplied = ("PURCHASED_BY",), ("PART_OF_SUPPLIER",)
    patterns = {
        "orders of a customer": ([order, M.step(*buys), customer, M.step(*buys, "in"), M.node("p", "Orders")], {"c": f"cMktsegment = '{SEGMENT}'", "p": "oOrderstatus = 'O'"}),
        "lines of a supplier": ([line, M.step(*supplied), supplier, M.step(*supplied, "in"), M.node("m", "Lineitem")], {}),
        "lines of customers of a region": (
            [line, M.step("PART_OF_ORDERS"), order, M.step(*buys), customer, M.step("PART_OF_NATION"), M.node("n", "Nation"), M.step("PART_OF_REGION"), M.node("r", "Region")],
            {"r": "rName = 'ASIA'", "l": "lQuantity > 20"},
        ),
    }
    return union_all(M.count_paths(g, p, where=w).select(F.lit(name).alias("pattern"), "n") for name, (p, w) in patterns.items())


def paths_per_start(spark: SparkSession, d: str) -> DataFrame:
    """Other orders of the same customer, for each order."""
    g = _graph(spark, d, ["customer", "orders"])
    pattern = [M.node("o", "Orders"), M.step("PURCHASED_BY"), M.node("c", "Customer"), M.step("PURCHASED_BY", "in"), M.node("p", "Orders")]
    return M.count_paths(g, pattern, where={"p": "oOrderstatus = 'O'"}, per_start=True)


def collected(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with the market segments found in their nation."""
    g = _graph(spark, d)
    found = M.collect_over_hub(
        g,
        M.node("s", "Supplier"), M.node("n", "Nation"), M.node("c", "Customer"),
        start_step="PART_OF_NATION", end_step="PART_OF_NATION",
        value="c.cMktsegment", alias="segments", returns={"supplier": "s.sName"}, where="c.cAcctbal > 9000",
    )
    return found.selectExpr("supplier", "array_join(segments, ',') AS segments")


def collected_groups(distinct: bool):
    """Segments of the customers in a supplier's nation, per nation of the suppliers."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = M.collect_groups(
            _graph(spark, d),
            M.node("s", "Supplier"), M.node("n", "Nation"), M.node("c", "Customer"),
            start_step="PART_OF_NATION", end_step="PART_OF_NATION", distinct=distinct,
            value="c.cMktsegment", alias="segments", returns={"nation": "s.sNationkey"}, where="c.cAcctbal > 9500",
        )
        return found.selectExpr("nation", "array_join(segments, ',') AS segments")

    return run


def graph_sample(spark: SparkSession, d: str) -> DataFrame:
    return M.graph_sample(_graph(spark, d), 50)


def junction_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Supplier -[SUPPLIER_PART]-> part, with the edge's own property."""
    g = _graph(spark, d, ["supplier", "part", "supplier_part"])
    return M.match(
        g,
        [M.node("s", "Supplier"), M.step("SUPPLIER_PART", var="r"), M.node("p", "Part")],
        where="p.pBrand = 'Brand#3'",
        returns={"supplier": "s.sName", "part_id": "p.pPartkey", "qty": "CAST(get_json_object(r.props, '$.qty') AS DOUBLE)"},
    )


def written_pattern(spark: SparkSession, d: str) -> DataFrame:
    """A pattern over a graph that was written and read back: edges come from files."""
    g = _graph(spark, d, ["nation", "customer", "orders"])
    path = sinks.scratch_folder(spark)
    sinks.write_nodes(g.nodes, f"{path}/nodes", clear=True)
    sinks.write_edges(g.edges, f"{path}/edges", clear=True)
    stored = sinks.read_graph(spark, path, g)
    found = M.match(
        stored,
        [M.node("o", "Orders"), M.step("PURCHASED_BY"), M.node("c", "Customer"), M.step("PART_OF_NATION"), M.node("n", "Nation")],
        returns={"nation": "n.nName"},
    )
    return found.groupBy("nation").count().withColumnRenamed("count", "n")


QUERIES = {
    "d1_nodes_direct": nodes_direct,
    "d1_shared_label": shared_label,
    "d2_nodes_enriched": nodes_enriched,
    "d2_property_maps": node_property_maps,
    "d3_converted_values": converted_values,
    "d4_fk_edges": fk_edges,
    "d4_fk_edges_direct": fk_edges_direct,
    "d4_duplicated_parents": duplicated_parents,
    "d4_composite_edges": composite_edges,
    "d4_translated_edges": translated_edges,
    "d5_junction_edges": junction_edges,
    "d6_matched_endpoints": matched_endpoints,
    "d6_spread_endpoints": spread_endpoints,
    "d6_dropped_edges": dropped_edges,
    "d6_complete_edges": complete_edges,
    "d6_profiled_edges": profiled_edges,
    "d7_merged_nodes": merged_nodes,
    "d7_merged_graph": merged_graph,
    "d7_two_superclasses": two_superclasses,
    "d8_nary_table": nary_table,
    "d9_derived_property": derived_property,
    "d10_user_edges": user_edges,
    "d11_mapping_choices": mapping_choices,
    "d12_unique_nodes": unique_nodes,
    "d13_lookup_layout": lookup_layout,
    "d13_bucketed_join": bucketed_join,
    "d14_required_properties": required_properties,
    "d15_model_summary": model_summary,
    "d15_types_of_label": types_of_label,
    "f1_node_counts": node_counts,
    "f2_edge_counts": edge_counts,
    "f2_edges_per_segment": edges_per_segment,
    "f3_histogram": histogram,
    "f4_one_hop": one_hop,
    "f5_two_hops": two_hops,
    "f5_two_hops_spread": two_hops_spread,
    "f5_two_hops_inward": two_hops_inward,
    "f5_counted_paths": counted_paths,
    "f5_paths_per_start": paths_per_start,
    "f6_collected": collected,
    "f6_collected_groups": collected_groups(False),
    "f6_collected_distinct_groups": collected_groups(True),
    "f7_graph_sample": graph_sample,
    "f8_junction_pattern": junction_pattern,
    "f8_written_pattern": written_pattern,
}

_KEY = {
    "region": "CAST(r_regionkey AS VARCHAR)", "nation": "CAST(n_nationkey AS VARCHAR)",
    "customer": "CAST(c_custkey AS VARCHAR)", "supplier": "CAST(s_suppkey AS VARCHAR)",
    "part": "CAST(p_partkey AS VARCHAR)", "orders": "CAST(o_orderkey AS VARCHAR)",
    "lineitem": "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)",
    "events": "CAST(event_id AS VARCHAR)",
}
LABEL = {t: "".join(w.capitalize() for w in t.split("_")) for t in (*TRADE, "events", "supplier_part")}


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def edge_sql(meanings=IN_TRADE) -> str:
    """All foreign-key edges of the enriched graph."""
    return _union(
        f"SELECT '{k}' AS fk_name, '{name}' AS rel_type, '{LABEL[t]}' AS from_label, {_KEY[t]} AS from_key, "
        f"'{LABEL[rt]}' AS to_label, CAST({c} AS VARCHAR) AS to_key, '{card}' AS cardinality FROM {t} WHERE {c} IN (SELECT {rc} FROM {rt})"
        for k, t, c, rt, rc, name, _, card, _, _ in meanings
    )


_NODES = _union(f"SELECT '{LABEL[t]}' AS label, {_KEY[t]} AS node_key FROM {t}" for t in TRADE)
_SEGMENT_KEYS = f"(SELECT c_custkey FROM customer WHERE c_mktsegment = '{SEGMENT}')"
_ORDER_EDGE = "SELECT 'PURCHASED_BY' AS rel_type, CAST(o_orderkey AS VARCHAR) AS from_key, CAST(o_custkey AS VARCHAR) AS to_key FROM orders"

ORACLES = {
    "d1_nodes_direct": """
        SELECT CAST(o_orderkey AS VARCHAR) AS node_key, 'Orders' AS label, o_orderkey AS "oOrderkey", o_orderstatus AS "oOrderstatus",
               o_totalprice AS "oTotalprice", strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "oOrderdate",
               o_orderpriority AS "oOrderpriority" FROM orders""",
    "d1_shared_label": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS node_key, 'BigCustomer' AS label, CASE WHEN c_mktsegment = '{SEGMENT}' THEN c_name END AS "cName",
               CASE WHEN c_mktsegment <> '{SEGMENT}' THEN 'n' ELSE '' END || c_nationkey AS "cNationkey",
               CASE WHEN c_mktsegment <> '{SEGMENT}' THEN c_mktsegment END AS "cMktsegment", true AS is_match FROM customer""",
    "d2_nodes_enriched": """
        SELECT concat_ws('|', conv_id, turn) AS node_key, 'Conversations' AS label, conv_id AS "convId", turn, role, text,
               CAST((conv_id IS NOT NULL)::INT + (turn IS NOT NULL)::INT + (role IS NOT NULL)::INT + (text IS NOT NULL)::INT AS INTEGER)
               AS n_properties FROM conversations""",
    "d2_property_maps": """
        SELECT CAST(c_custkey AS VARCHAR) AS node_key, 'Customer' AS label,
               '{"cCustkey":' || c_custkey || ',"cName":"' || c_name || '","cNationkey":' || c_nationkey || ',"cAcctbal":' || c_acctbal || ',"cMktsegment":"'
               || c_mktsegment || '"' || coalesce(',"lastOrder":' || k, '') || '}' AS properties
        FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "d3_converted_values": """
        SELECT event_id AS "eventId", strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS ts,
               CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json(props) AS VARCHAR) AS props, event_type, user_id AS "userId", value FROM events""",
    "d4_fk_edges": edge_sql(),
    "d4_fk_edges_direct": _union(
        f"SELECT '{m[6]}' AS rel_type, '{LABEL[m[1]]}' AS from_label, '{LABEL[m[3]]}' AS to_label, count(*) AS n FROM {m[1]}"
        for m in IN_TRADE
    ),
    "d4_duplicated_parents": f"""
        SELECT path, e.* FROM (VALUES ('joined'), ('profiled')) AS p(path), ({_ORDER_EDGE} WHERE o_custkey IN {_SEGMENT_KEYS}) AS e""",
    "d4_composite_edges": f"""
        SELECT path, 'PART_OF_SUPPLIERPART' AS rel_type, 'Lineitem' AS from_label, 'SupplierPart' AS to_label,
               concat_ws('|', l_suppkey, l_partkey) AS to_key, 'N:1' AS cardinality, count(*) AS n
        FROM (VALUES ('joined'), ('profiled')) AS p(path), lineitem JOIN {rel("supplier_part")} ON suppkey = l_suppkey AND partkey = l_partkey
        WHERE qty > 20 GROUP BY path, l_suppkey, l_partkey""",
    "d4_translated_edges": f"""
        SELECT 'orders_buyer' AS fk_name, 'PURCHASED_BY' AS rel_type, CAST(o_orderkey AS VARCHAR) AS from_key, 'Customer' AS to_label,
               CAST(c_custkey AS VARCHAR) AS to_key FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment = '{SEGMENT}' AND c_name <> 'Customer#5'
        UNION ALL SELECT 'customer_nation', 'PART_OF_NATION', CAST(c_custkey AS VARCHAR), 'Nation', CAST(c_nationkey AS VARCHAR)
        FROM customer WHERE c_mktsegment = '{SEGMENT}'""",
    "d5_junction_edges": f"""
        SELECT 'SUPPLIER_PART' AS rel_type, 'Supplier' AS from_label, CAST(suppkey AS VARCHAR) AS from_key, 'Part' AS to_label,
               CAST(partkey AS VARCHAR) AS to_key, 'N:M' AS cardinality, qty FROM {rel("supplier_part")}""",
    "d6_matched_endpoints": f"{_ORDER_EDGE} WHERE o_custkey IN {_SEGMENT_KEYS}",
    "d6_spread_endpoints": """
        SELECT 'PART_OF_SUPPLIER' AS rel_type, CAST(l_suppkey AS VARCHAR) AS to_key, CAST(sum(k * k) AS BIGINT) AS n
        FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) AS k FROM lineitem GROUP BY ALL)
        WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_suppkey""",
    "d6_dropped_edges": f"{_ORDER_EDGE} WHERE o_custkey NOT IN {_SEGMENT_KEYS}",
    "d6_complete_edges": f"""{_ORDER_EDGE} WHERE o_custkey IN {_SEGMENT_KEYS}
        UNION ALL SELECT 'USED_BY', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR) FROM events WHERE user_id IN {_SEGMENT_KEYS}""",
    "d6_profiled_edges": f"""{_ORDER_EDGE} WHERE o_custkey IN {_SEGMENT_KEYS}
        UNION ALL SELECT 'USED_BY', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR) FROM events WHERE user_id IN {_SEGMENT_KEYS}""",
    "d7_merged_nodes": """
        SELECT doc_id AS "docId", 'Documents' || CASE WHEN labels.doc_id IS NULL THEN '' ELSE ':Labels' END
               || CASE WHEN toxic = 1 THEN ':FlaggedDocument' ELSE '' END AS labels, lang, n_chars AS "nChars", quality, toxic
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "d7_merged_graph": """
        SELECT 'Documents' || CASE WHEN labels.doc_id IS NULL THEN '' ELSE ':Labels' END
               || CASE WHEN toxic = 1 THEN ':FlaggedDocument' ELSE '' END AS name, count(*) AS n
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
        UNION ALL SELECT 'PART_OF_CONVERSATION', count(*) FROM conversations""",
    "d7_two_superclasses": """
        WITH f AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS lab, coalesce(l.quality = 0, false) AS urg, coalesce(l.toxic = 1 AND l.quality = 0, false) AS flag,
                          coalesce(l.toxic = 1, false) AS link
                   FROM documents d LEFT JOIN labels l USING (doc_id)),
             page AS (SELECT count(*) AS n FROM pages),
             counts AS (SELECT 'Documents' AS name, count(*) AS n FROM f UNION ALL SELECT 'Labels', count(*) FROM f WHERE lab
                        UNION ALL SELECT 'Urgent', count(*) FROM f WHERE urg UNION ALL SELECT 'Flagged', count(*) FROM f WHERE flag
                        UNION ALL SELECT 'Linked', count(*) FROM f WHERE link UNION ALL SELECT 'Page', n FROM page)
        SELECT concat_ws(':', 'Documents', CASE WHEN flag THEN 'Flagged' END, CASE WHEN lab THEN 'Labels' END, CASE WHEN link THEN 'Linked' END,
                         CASE WHEN link THEN 'Page' END, CASE WHEN urg THEN 'Urgent' END) AS name, count(*) AS n FROM f GROUP BY 1
        UNION ALL SELECT name || ' 0', n FROM counts
        UNION ALL SELECT 'IS_A_PAGE Documents Page', count(*) FROM f WHERE link AND doc_id IN (SELECT page_id FROM pages) HAVING count(*) > 0""",
    "d8_nary_table": _union(
        f"SELECT '{n}' AS name, count(*) AS n FROM lineitem" for n in ("Lineitem", "PART_OF_ORDERS", "PART_OF_PART", "PART_OF_SUPPLIER")
    ),
    "d9_derived_property": """
        SELECT CAST(c_custkey AS VARCHAR) AS node_key, c_name || ' of ' || c_mktsegment AS "fullName" FROM customer""",
    "d10_user_edges": """
        SELECT 'PART_OF_CONVERSATION' AS rel_type, concat_ws('|', conv_id, turn) AS from_key, CAST(conv_id AS VARCHAR) AS to_key,
               'N:1' AS cardinality FROM conversations
        UNION ALL SELECT 'FOLLOWED_BY', concat_ws('|', a.conv_id, a.turn), concat_ws('|', b.conv_id, b.turn), NULL
        FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
    "d11_mapping_choices": f"""
        SELECT 'PLACED_BY' AS name, CAST(NULL AS VARCHAR) AS cardinality, count(*) AS n FROM orders
        UNION ALL SELECT 'OFFERS', NULL, count(*) FROM {rel("supplier_part")}
        UNION ALL SELECT 'Orders', NULL, count(*) FROM orders UNION ALL SELECT 'Customer', NULL, count(*) FROM customer
        UNION ALL SELECT 'Supplier', NULL, count(*) FROM supplier UNION ALL SELECT 'Part', NULL, count(*) FROM part""",
    "d12_unique_nodes": _union(
        f"SELECT '{label}' AS label, count(*) AS duplicate_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows "
        f"FROM (SELECT count(*) AS n FROM {t} GROUP BY {key} HAVING count(*) > 1)"
        for label, t, key in (
            *[(LABEL[t], t, _KEY[t]) for t in TRADE],
            ("Lineitem (short)", "lineitem", "l_orderkey, l_linenumber"),
        )
    ),
    "d13_lookup_layout": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS node_key, c_name AS "cName" FROM customer WHERE c_mktsegment = '{SEGMENT}'""",
    "d13_bucketed_join": """
        SELECT c_mktsegment AS "cMktsegment", 'PURCHASED_BY' AS rel_type, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "d14_required_properties": f"""
        SELECT 'customer' AS table_name, 'c_custkey' AS column_name, count(*) - count(c_custkey) AS null_count FROM customer
        UNION ALL SELECT 'orders', 'o_orderkey', count(*) - count(o_orderkey) FROM orders
        UNION ALL SELECT 'orders', 'o_custkey', count(*) FILTER (WHERE o_custkey NOT IN {_SEGMENT_KEYS}) FROM orders""",
    "d15_model_summary": _union(
        [
            f"SELECT '{LABEL[t]}' AS name, CAST(NULL AS VARCHAR) AS from_label, CAST(NULL AS VARCHAR) AS to_label, "
            f"CAST({n} AS BIGINT) AS n_properties, count(*) AS n FROM {t}"
            for t, n in (("region", 2), ("nation", 3), ("customer", 5), ("supplier", 4), ("part", 6), ("orders", 6), ("lineitem", 11))
        ]
        + [
            f"SELECT '{m[5]}', '{LABEL[m[1]]}', '{LABEL[m[3]]}', NULL, "
            + (" + ".join(f"(SELECT count(*) FROM {o[1]})" for o in IN_TRADE if o[5] == m[5]))
            for m in IN_TRADE
        ]
    ),
    "d15_types_of_label": _union(
        f"SELECT '{m[5]}' AS rel_type, '{LABEL[m[1]]}' AS from_label, '{LABEL[m[3]]}' AS to_label, count(*) AS n FROM {m[1]}"
        for m in IN_TRADE if "nation" in (m[1], m[3])
    ),
    "f1_node_counts": f"SELECT label, count(*) AS n FROM ({_NODES}) GROUP BY label",
    "f2_edge_counts": f"SELECT rel_type, from_label, to_label, count(*) AS n FROM ({edge_sql()}) GROUP BY ALL",
    "f2_edges_per_segment": """
        SELECT c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "f3_histogram": f"""
        SELECT 'node' AS kind, label AS name, count(*) AS n FROM ({_NODES}) GROUP BY label
        UNION ALL SELECT 'node', NULL, count(*) FROM ({_NODES})
        UNION ALL SELECT 'edge', rel_type, count(*) FROM ({edge_sql()}) GROUP BY rel_type
        UNION ALL SELECT 'edge', NULL, count(*) FROM ({edge_sql()})""",
    "f4_one_hop": """
        SELECT o_orderkey AS order_id, c_name AS customer, 'N:1' AS cardinality FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 10""",
    **dict.fromkeys(("f5_two_hops", "f5_two_hops_spread"), f"""
        SELECT c_name AS customer, o_orderkey AS order_id, l_linenumber AS line, l_partkey AS part_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment = '{SEGMENT}' AND o_orderpriority = '1-URGENT'"""),
    "f5_two_hops_inward": """
        SELECT r_name AS region, n_name AS nation, c_name AS customer
        FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'""",
    **{
        f"f6_collected_{name}groups": f"""
        SELECT s_nationkey AS nation, string_agg({distinct} c_mktsegment, ',' ORDER BY c_mktsegment) AS segments
        FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal > 9500 GROUP BY s_nationkey"""
        for name, distinct in (("", ""), ("distinct_", "DISTINCT"))
    },
    "f5_counted_paths": f"""
        WITH lines AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) AS m, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
        SELECT 'orders of a customer' AS pattern, CAST(coalesce(sum(a * b - b), 0) AS BIGINT) AS n
        FROM (SELECT o_custkey, count(*) AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders
              JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = '{SEGMENT}' GROUP BY o_custkey)
        UNION ALL
        SELECT 'lines of a supplier', CAST((SELECT sum(k * k) FROM (SELECT l_suppkey, sum(m) AS k FROM lines GROUP BY l_suppkey))
                                           - (SELECT sum(m * m) FROM lines) AS BIGINT)
        UNION ALL
        SELECT 'lines of customers of a region', coalesce(sum(m), 0)::BIGINT FROM lines
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND q > 20""",
    "f5_paths_per_start": """
        SELECT CAST(o_orderkey AS VARCHAR) AS node_key, b - CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS n
        FROM orders JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY o_custkey) USING (o_custkey)
        WHERE b - CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END > 0""",
    "f6_collected": """
        SELECT s_name AS supplier, segments FROM supplier JOIN (
            SELECT c_nationkey, string_agg(s, ',' ORDER BY s) AS segments
            FROM (SELECT DISTINCT c_nationkey, c_mktsegment AS s FROM customer WHERE c_acctbal > 9000) GROUP BY c_nationkey)
        ON s_nationkey = c_nationkey""",
    "f7_graph_sample": f"SELECT label, node_key FROM ({_NODES}) ORDER BY label, node_key LIMIT 50",
    "f8_junction_pattern": f"""
        SELECT s_name AS supplier, p_partkey AS part_id, qty FROM {rel("supplier_part")} j
        JOIN supplier ON s_suppkey = suppkey JOIN part ON p_partkey = partkey WHERE p_brand = 'Brand#3'""",
    "f8_written_pattern": """
        SELECT n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
}

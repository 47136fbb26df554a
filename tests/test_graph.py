"""Building: nodes, edges, endpoints, mapping."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphlift import GraphMapping, analyze, build_graph, match, merge_inheritance, migrate, node, step
from graphlift.operators import edges as E
from graphlift.operators import nodes as ND
from graphlift.operators import profile as P


def edges(graph):
    return sorted((r.rel_type, r.from_key, r.to_key) for r in graph.edges.collect())


def test_blog_direct(blog):
    g = build_graph(blog, "direct")
    assert set(g.nodes) == {"Users", "Posts", "Tags"}
    assert {e.rel_type for e in g.edge_types} == {"POST_USER", "POST_TAGS"}
    assert g.nodes["Posts"].columns == ["node_key", "label", "id", "title", "content", "createdAt"]
    assert g.nodes["Posts"].first().createdAt == "2024-01-02 03:04:05"
    assert edges(g) == [
        ("POST_TAGS", "1", "1"), ("POST_TAGS", "1", "2"), ("POST_TAGS", "2", "2"),
        ("POST_USER", "1", "1"), ("POST_USER", "2", "1"), ("POST_USER", "3", "2"),
    ]


def test_blog_enriched(blog):
    g = build_graph(blog)
    assert "userId" in g.nodes["Posts"].columns
    cards = {(r.rel_type, r.cardinality) for r in g.edges.collect()}
    assert cards == {("USED_BY", "N:1"), ("POST_TAGS", "N:M")}
    props = [r.props for r in g.edges.where("rel_type = 'POST_TAGS'").orderBy("from_key", "to_key").collect()]
    assert props == ['{"createdAt":"2024-01-02 03:04:05"}', '{"createdAt":"2024-01-02 03:04:05"}', "{}"]


def test_null_key_gives_no_edge(university):
    g = build_graph(university)
    assert ("WORKS_IN", "13", None) not in edges(g)
    assert len([e for e in edges(g) if e[0] == "WORKS_IN"]) == 5


@pytest.mark.parametrize("how", ["plain", "evidence", "spread"])
def test_missing_parent_drops_the_edge(blog, how):
    s = blog.with_tables(users=blog["users"].where("id = 1"), posts=blog["posts"].where("id < 3").unionByName(blog["posts"].where("id = 3")))
    options = {}
    if how == "evidence":
        options = {"evidence": P.materialize(P.fk_profile(s))}
    if how == "spread":
        options = {"row_counts": {"users": 10**12}}
    got = edges(build_graph(s, **options))
    assert [e for e in got if e[0] == "USED_BY"] == [("USED_BY", "1", "1"), ("USED_BY", "2", "1")]
    assert len([e for e in got if e[0] == "POST_TAGS"]) == 3


@pytest.mark.parametrize("how", ["joined", "profiled", "spread"])
def test_duplicated_parents_leave_edges_single(blog, how):
    users = blog["users"].where("id <> 2")
    s = blog.with_tables(users=users.unionByName(users))
    options = {"joined": {}, "profiled": {"evidence": P.materialize(P.fk_profile(s))}, "spread": {"row_counts": {"users": 10**12}}}[how]
    got = edges(build_graph(s, **options))
    assert sorted(e for e in got if e[0] == "USED_BY") == [("USED_BY", "1", "1"), ("USED_BY", "2", "1")]
    assert len(got) == 2 + 3


def test_evidence_without_orphans_needs_no_join(blog):
    g = build_graph(blog, evidence=P.materialize(P.fk_profile(blog)))
    plan = g.edges._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_key_columns_stay_and_composite_keys(people):
    g = build_graph(people, "direct")
    items = g.nodes["OrderItem"]
    assert items.columns == ["node_key", "label", "orderId", "itemNumber", "quantity"]
    assert sorted(r.node_key for r in items.collect()) == ["1|1", "1|2", "2|1"]
    assert ("ORDER_ITEM_ORDER", "1|2", "1") in edges(g)


def test_rebuild_gives_the_same(people):
    assert edges(build_graph(people)) == edges(build_graph(people))


def test_counts_follow_the_rows(people, university, blog):
    for s in (people, university, blog):
        g = build_graph(s)
        for label, df in g.nodes.items():
            table = next(t for t, n in ND.labels_of(s).items() if n == label)
            assert df.count() == s[table].count()
        found = Counter(r.fk_name for r in g.edges.collect())
        for fk in s.foreign_keys:
            if fk.name in found:
                assert found[fk.name] == s[fk.table].where(F.col(fk.column).isNotNull()).count()


def test_mapping(blog):
    m = GraphMapping(tables_as_nodes=("posts", "tags"), custom_relationships={"post_tags": "TAGGED"})
    g = build_graph(blog, mapping=m)
    assert set(g.nodes) == {"Posts", "Tags"} and {e.rel_type for e in g.edge_types} == {"TAGGED"}
    assert {e.rel_type for e in build_graph(blog, mapping=GraphMapping(junction_tables_as_relationships=False)).edge_types} == {"USED_BY"}
    assert {e.rel_type for e in build_graph(blog, mapping=GraphMapping(foreign_keys_as_relationships=False)).edge_types} == {"POST_TAGS"}
    plain = build_graph(blog, mapping=GraphMapping(generate_semantic_names=False, infer_cardinality=False))
    assert {(e.rel_type, e.cardinality) for e in plain.edge_types} == {("POST_USER", None), ("POST_TAGS", None)}


def test_inheritance_can_be_switched_off(people):
    kinds = {e.fk.name: (e.rel_type, e.semantics) for e in build_graph(people).edge_types}
    assert kinds["manager_employee"] == ("IS_A_EMPLOYEE", "INHERITANCE")
    kinds = {e.fk.name: (e.rel_type, e.semantics) for e in build_graph(people, mapping=GraphMapping(preserve_inheritance=False)).edge_types}
    assert kinds["manager_employee"] == ("EMPLOYS", "ASSOCIATION")


def test_merge_three_levels(people):
    g = build_graph(people)
    df = ND.merge_subclass(g.nodes["Person"], g.nodes["Employee"], parent_key="personId", child_key="personId", child_label="Employee")
    df = ND.merge_subclass(df, g.nodes["Manager"], parent_key="personId", child_key="personId", child_label="Manager")
    got = {r.personId: (r.labels, r.name, r.employeeName, r.hired, r.level) for r in df.collect()}
    assert got == {
        1: (["Person", "Employee", "Manager"], "A", "emp A", 2001, 5),
        2: (["Person", "Employee"], "B", "emp B", 2002, None),
        3: (["Person"], "C", None, None, None),
    }


@pytest.mark.parametrize("with_evidence", [False, True])
def test_merge_inheritance(people, with_evidence):
    lonely = people["customer"].unionByName(people.spark.range(1).selectExpr("99L AS person_id", "1L AS points"))
    s = people.with_tables(customer=lonely)
    evidence = P.materialize(P.fk_profile(s)) if with_evidence else None
    g = merge_inheritance(build_graph(s, evidence=evidence), evidence=evidence)
    assert set(g.nodes) == {"Person", "UserProfile", "Order", "OrderItem"}
    got = {r.node_key: (sorted(r.labels), r.personId, r.points) for r in g.nodes["Person"].collect()}
    assert got == {
        "1": (["Employee", "Manager", "Person"], 1, None),
        "2": (["Employee", "Person"], 2, None),
        "3": (["Customer", "Person"], 3, 9),
        "99": (["Customer"], 99, 1),
    }
    assert {(e.rel_type, e.from_label, e.to_label) for e in g.edge_types} == {
        ("USED_BY", "UserProfile", "Person"), ("PURCHASED_BY", "Order", "Person"), ("PART_OF_ORDER", "OrderItem", "Order"),
    }
    found = match(g, [node("o", "Order"), step("PURCHASED_BY"), node("p", "Person")], returns={"o": "o.orderId", "n": "p.name"})
    assert sorted(map(tuple, found.collect())) == [(1, "C"), (2, "C")]


def test_property_map_strips_nulls(blog):
    df = build_graph(blog).nodes["Posts"]
    maps = {r.node_key: r.properties for r in ND.property_map(df).collect()}
    assert '"content"' not in maps["2"] and '"content":"x"' in maps["1"]
    assert {r.node_key: r.n for r in df.withColumn("n", ND.property_count(df)).collect()} == {"1": 5, "2": 4, "3": 5}


def test_user_edges_and_derived_property(blog):
    g = build_graph(blog, derived={"users": {"fullName": "upper(name)"}})
    assert g.nodes["Users"].where("id = 1").first().fullName == "ALICE SMITH"
    extra = blog.spark.createDataFrame(pa.table({"rel_type": ["FRIENDS_WITH"], "from_label": ["Users"], "from_key": ["1"],
                                                 "to_label": ["Users"], "to_key": ["2"]}))
    assert ("FRIENDS_WITH", "1", "2") in edges(g.with_edges("friends", extra))


# -- joins on hubs ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, some have none, some have no partner."""
    big = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7L WHEN id % 50 = 1 THEN NULL ELSE id % 40 END AS k"
    )
    small = spark.range(30).selectExpr("id AS sk", "id * 10 AS v").unionByName(spark.range(1).selectExpr("7L AS sk", "1L AS v"))
    return big, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [1, 100, 10**9])
def test_hub_join_equals_join(skewed, how, hot_rows):
    big, small = skewed
    want = big.join(small, big["k"] == small["sk"], how)
    got = E.hub_join(big, small, "k", "sk", how=how, hot_rows=hot_rows)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_hub_join_spreads_the_hub(spark, skewed):
    big, small = skewed
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = E.hub_join(big, small, "k", "sk", hot_rows=100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(k" in plan and "_salt" in plan


def test_hub_join_with_values_that_cannot_be_hashed(spark):
    big = spark.range(20).selectExpr("id", "1L AS k", "parse_json(CAST(id AS STRING)) AS v", "map('a', id) AS m")
    got = E.hub_join(big, spark.range(3).selectExpr("id AS sk"), "k", "sk", hot_rows=5)
    assert sorted(r.id for r in got.collect()) == list(range(20))


def test_match_endpoints_multiplies_duplicates(blog):
    g = build_graph(blog, assume_complete=True)
    used = g.edges.where("rel_type = 'USED_BY'")
    twice = g.nodes["Users"].where("id = 1").unionByName(g.nodes["Users"].where("id = 1"))
    for spread in (False, True):
        got = E.match_endpoints(used, g.nodes["Posts"], twice, spread=spread, hot_rows=1)
        assert sorted((r.from_key, r.to_key) for r in got.collect()) == [("1", "1")] * 2 + [("2", "1")] * 2
    assert E.missing_endpoints(used, twice, "to").count() == 1


# -- the commands -----------------------------------------------------------------------------


def test_analyze_discovers_and_migrates(blog):
    from graphlift import Source

    found = analyze(Source(blog.spark, blog.tables), discover=True)
    assert found.row_counts == {"users": 3, "posts": 3, "tags": 2, "post_tags": 3}
    g = migrate(found)
    assert {e.rel_type for e in g.edge_types} == {"USED_BY", "POST_TAGS"} and len(edges(g)) == 6


def test_a_broken_table_is_skipped(blog, spark, tmp_path, caplog):
    spark.range(5).write.parquet(str(tmp_path / "gone"))
    gone = spark.read.parquet(str(tmp_path / "gone"))
    for f in (tmp_path / "gone").glob("part-*"):
        f.write_bytes(b"no parquet")
    found = analyze(blog.with_tables(gone=gone))
    assert "gone" not in found.source.tables and found.row_counts["users"] == 3
    assert "gone" in caplog.text


def test_loose_rule_builds(blog, people):
    g = build_graph(people, rule="as_coded")
    assert {e.fk.name: e.rel_type for e in g.edge_types}["item_order"] == "IS_A_ORDER"
    assert {e.rel_type for e in build_graph(blog, rule="as_coded").edge_types} == {"USED_BY", "POST_TAGS"}


# -- hot and missing keys ---------------------------------------------------------------------


def largest_and_mean(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes), sum(sizes) / len(sizes)


def test_rows_without_a_key_are_dealt_out(spark):
    big = spark.range(100_000).selectExpr("IF(id % 10 = 0, id, NULL) AS k", "id")
    small = spark.range(1000).selectExpr("id * 10 AS sk", "id AS w")
    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {c: spark.conf.get(c) for c in confs}
    for c, v in confs.items():
        spark.conf.set(c, v)
    try:
        joined = E.hub_join(big, small, "k", "sk", how="left")
        most, mean = largest_and_mean(joined)
        assert joined.count() == 100_000 and most < 2 * mean
        assert E.hub_join(big, small, "k", "sk", how="left_anti").count() == 99_000
        assert E.hub_join(big, small, "k", "sk").count() == 1000
        hub = spark.range(100_000).selectExpr("IF(id % 10 = 0, id, 7) AS k", "id")
        spread = E.hub_join(hub, small.withColumn("sk", F.col("w") + 7), "k", "sk", hot_rows=5000)
        plain = hub.join(small.withColumn("sk", F.col("w") + 7), F.col("k") == F.col("sk"))
        assert spread.count() == plain.count()
        most, mean = largest_and_mean(spread)
        assert most < 4 * mean < largest_and_mean(plain)[0]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_the_list_of_hot_keys_is_bounded(spark, monkeypatch):
    df = spark.range(30_000).selectExpr("IF(id % 3 = 0, -1, id % 3000) AS k")
    assert E.hot_keys(df, "k", 5000).collect()[0]["_parts"] == 2
    assert E.hot_keys(df, "k", 1).count() <= E.MOST_HOT
    assert E.hot_keys(df.where("k > 99999"), "k").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hub_join_of_keys_of_different_types(spark, how):
    big = spark.range(300).selectExpr("CAST(id % 7 AS DECIMAL(10, 2)) AS k", "id")
    small = spark.range(5).selectExpr("CAST(id AS INT) AS sk", "id AS w")
    want = big.join(small, big["k"] == small["sk"], how)
    for hot_rows in (1, 20):
        got = E.hub_join(big, small, "k", "sk", how=how, hot_rows=hot_rows)
        assert Counter(map(str, got.collect())) == Counter(map(str, want.collect()))


# -- labels -----------------------------------------------------------------------------------


def test_two_superclasses(spark):
    from graphlift import ForeignKey, Source, merge_inheritance
    from graphlift.operators import checks as CK

    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    tables = {"person": ids(1, 2, 3, 4), "student": ids(1, 2), "employee": ids(2, 3), "tutor": ids(2), "account": ids(2, 9)}
    links = [("student", "person"), ("employee", "person"), ("tutor", "student"), ("tutor", "employee"), ("tutor", "account")]
    s = Source(spark, tables, primary_keys={t: ("id",) for t in tables}, foreign_keys=tuple(ForeignKey(f"{a}_{b}", a, "id", b, "id") for a, b in links))
    g = merge_inheritance(build_graph(s))
    assert sorted(g.nodes) == ["Account", "Person"]
    got = {r.id: sorted(r.labels) for r in g.nodes["Person"].collect()}
    assert got == {1: ["Person", "Student"], 2: ["Account", "Employee", "Person", "Student", "Tutor"], 3: ["Employee", "Person"], 4: ["Person"]}
    assert [(r.rel_type, r.from_label, r.to_label, r.from_key) for r in g.edges.collect()] == [("IS_A_ACCOUNT", "Person", "Account", "2")]
    assert all(r.is_match for r in CK.reconcile_counts(s, g).collect()) and CK.reconcile_counts(s, g).count() == 5


def test_one_key_column_with_two_foreign_keys_is_no_junction(spark):
    from graphlift import ForeignKey, Source

    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    s = Source(
        spark, {"a": ids(1, 2), "b": ids(1, 3), "c": ids(1)}, primary_keys={t: ("id",) for t in "abc"},
        foreign_keys=(ForeignKey("c_a", "c", "id", "a", "id"), ForeignKey("c_b", "c", "id", "b", "id")),
    )
    for rule in ("shared_key", "as_coded"):
        assert sorted(build_graph(s, rule=rule).nodes) == ["A", "B", "C"]

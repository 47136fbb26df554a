from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from graphlift import ForeignKey, Source, analyze, build_graph, match, migrate, node, step, validate
from graphlift.operators import checks as CK
from graphlift.operators import semantics as S
from graphlift.sources import sinks


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "graph")


def test_migrate_is_idempotent_and_readable(spark, university, folder):
    found = analyze(university)
    for _ in range(2):
        g = migrate(found, folder, sort_by={"Students": ["lastName"]})
    stored = sinks.read_graph(spark, folder, g)
    assert {label: df.count() for label, df in stored.nodes.items()} == {label: df.count() for label, df in g.nodes.items()}
    key = ["rel_type", "from_key", "to_key", "props"]
    assert sorted(map(str, stored.edges.select(key).collect())) == sorted(map(str, g.edges.select(key).collect()))
    got = match(stored, [node("c", "Courses"), step("WORKS_IN"), node("d", "Departments")], returns={"c": "c.courseId"})
    assert sorted(r.c for r in got.collect()) == [10, 11, 12]


def test_a_second_load_leaves_nothing_of_the_first(spark, university, folder):
    migrate(analyze(university), folder)
    g = migrate(analyze(university.only(["courses", "departments"])), folder)
    folder = sinks.current_version(spark, folder)
    assert {r.label for r in spark.read.parquet(f"{folder}/nodes").select("label").distinct().collect()} == {"Courses", "Departments"}
    assert {r.from_label for r in g.edges.collect()} == {"Courses"}


def test_validation_looks_at_what_was_written(university, folder):
    g = migrate(analyze(university), folder)
    assert validate(university, g)["findings"].count() == 0
    one = build_graph(university).nodes["Departments"].where("departmentId = 1")
    sinks.write_nodes({"Departments": one}, f"{sinks.current_version(university.spark, folder)}/nodes", clear=True)
    again = sinks.read_graph(university.spark, folder, g)
    assert validate(university, again)["findings"].count() > 0


def test_source_without_foreign_keys(spark, folder):
    s = Source(spark, {"t": spark.createDataFrame([(1, "a")], "id int, name string")}, primary_keys={"t": ("id",)})
    g = migrate(analyze(s), folder)
    assert g.nodes["T"].count() == 1 and g.edges.count() == 0
    assert {r.statistic: r.value for r in CK.target_totals(g).collect()}["total_relationships"] == 0
    assert CK.missing_nodes(g).count() == 0


def test_append_duplicates(spark, blog, folder):
    g = build_graph(blog)
    for _ in range(2):
        sinks.write_nodes(g.nodes, folder)
        sinks.write_edges(g.edges, f"{folder}/e")
    assert sinks.read_nodes(spark, folder, "Users").count() == 6 and sinks.read_edges(spark, f"{folder}/e").count() == 12
    sinks.write_edges(g.edges.where("rel_type = 'USED_BY'"), f"{folder}/e", clear=True)
    left = {r.rel_type: r["count"] for r in sinks.read_edges(spark, f"{folder}/e").groupBy("rel_type").count().collect()}
    assert left == {"USED_BY": 3, "POST_TAGS": 6}


def test_csv(spark, blog, folder):
    g = build_graph(blog)
    sinks.write_csv(sinks.bulk_nodes(g.nodes["Posts"], "Posts"), f"{folder}/n")
    sinks.write_csv(sinks.bulk_edges(g.edges), f"{folder}/e")
    read = spark.read.option("header", True).option("escape", '"')
    assert read.csv(f"{folder}/n").columns[0] == ":ID(Posts)" and read.csv(f"{folder}/n").columns[-1] == ":LABEL"
    rows = {(r[":START_ID"], r[":END_ID"], r[":TYPE"], r["props"]) for r in read.csv(f"{folder}/e").collect()}
    assert ("1", "2", "POST_TAGS", '{"createdAt":"2024-01-02 03:04:05"}') in rows and len(rows) == 6


def test_json(spark, blog, folder):
    m = S.enrich(blog)
    sinks.write_json({"entities": m.entities, "relationships": m.relationships}, folder)
    assert spark.read.json(f"{folder}/entities").count() == 3


def test_clean_graph_passes(university):
    g = build_graph(university)
    report = validate(university, g)
    assert report["findings"].count() == 0
    assert {(r.phase, r.status) for r in report["summary"].collect()} == {("pre", "PASSED"), ("post", "PASSED")}
    assert {r.is_match for r in report["counts"].collect()} == {True}
    assert {r.statistic: r.value for r in report["totals"].collect()} == {
        "total_nodes": 12, "total_relationships": 9, "node_labels": 4, "relationship_types": 3,
    }
    assert {r.is_match for r in report["instances"].collect()} == {True}


def test_findings(university):
    s = replace(
        university,
        primary_keys={t: k for t, k in university.primary_keys.items() if t != "students"},
        foreign_keys=(*university.foreign_keys, ForeignKey("x", "courses", "course_name", "nowhere", "id")),
    )
    g = build_graph(university, assume_complete=True)
    g = g.with_nodes("Departments", g.nodes["Departments"].where("departmentId = 1"))
    g = replace(g, edge_sets={**g.edge_sets, "professors": g.edge_sets["professors"].limit(0)})
    found = {(r.phase, r.severity, r.check_name, r.subject, r.n) for r in CK.findings(s, g).collect()}
    assert found == {
        ("pre", "warning", "no_primary_key", "students", 1),
        ("pre", "error", "dangling_foreign_key", "x", 1),
        ("post", "error", "row_count_mismatch", "Departments", 2),
        ("post", "warning", "empty_type", "WORKS_IN", 1),
        ("post", "error", "missing_node", "WORKS_IN", 1),
    }
    rows = {r.phase: (r.status, r.errors, r.warnings) for r in CK.validation_summary(CK.findings(s, g)).collect()}
    assert rows == {"pre": ("FAILED", 1, 1), "post": ("FAILED", 2, 1)}


def test_orphans_and_duplicates(blog):
    s = blog.with_tables(users=blog["users"].where("id = 2"))
    got = {r.fk_name: (r.orphan_rows, r.orphan_values) for r in CK.orphan_rows(s).collect()}
    assert got["posts_user"] == (2, 1) and got["pt_tag"] == (0, 0)
    dup = CK.duplicate_keys({"T": (blog["post_tags"], ["tag_id"]), "P": (blog["posts"], ["id"])})
    assert {r.label: (r.duplicate_keys, r.surplus_rows) for r in dup.collect()} == {"T": (1, 1), "P": (0, 0)}


def test_required(blog):
    s = replace(blog, not_null={"posts": ("content", "id")})
    got = {(r.table_name, r.column_name): r.null_count for r in CK.required_properties(s).collect()}
    assert got[("posts", "content")] == 1 and got[("posts", "id")] == 0


def test_source_summary(blog):
    r = CK.source_summary(blog).first()
    assert (r.total_tables, r.entity_tables, r.junction_tables, r.total_columns) == (4, 3, 1, 14)
    assert (r.total_foreign_keys, r.total_indexes, r.total_rows, r.tables_with_data) == (3, 2, 11, 4)


def test_json_columns_survive_the_sinks(spark, folder):
    """A JSON column is a value on the node, in Parquet and in CSV."""
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, "plain"), (3, None)], "id long, doc string")
    s = Source(spark, {"t": df}, primary_keys={"t": ("id",)}, sql_types={("t", "doc"): "json"})
    g = build_graph(s)
    sinks.write_nodes(g.nodes, folder, clear=True)
    back = sinks.read_nodes(spark, folder, "T").selectExpr("id", "try_variant_get(doc, '$.k', 'int') AS k", "to_json(doc) AS doc")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [(1, 5, '{"k":5}'), (2, None, '"plain"'), (3, None, None)]
    sinks.write_csv(sinks.bulk_nodes(g.nodes["T"], "T"), f"{folder}/csv")
    rows = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/csv").orderBy(":ID(T)").collect()
    assert [r["doc"] for r in rows] == ['{"k":5}', '"plain"', None]


def test_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://somewhere"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        sinks.shared_folder(Session())
    Context.master = "local[2]"
    assert sinks.shared_folder(Session(), "x").endswith("/graphlift/x")


# -- versions ---------------------------------------------------------------------------------


def rows_of(graph):
    nodes = sorted(str((label, r.node_key)) for label, df in graph.nodes.items() for r in df.select("node_key").collect())
    return nodes, sorted(map(str, graph.edges.select("rel_type", "from_key", "to_key").collect()))


def test_a_load_that_fails_leaves_the_old_graph(spark, university, folder, monkeypatch):
    found = analyze(university)
    before = rows_of(migrate(found, folder))
    broken = replace(found, source=university.with_tables(students=university["students"].where("raise_error('no') IS NULL OR student_id = 1")))
    with pytest.raises(Exception):
        migrate(broken, folder)
    model = build_graph(university)
    assert rows_of(sinks.read_graph(spark, folder, model)) == before
    monkeypatch.setattr(sinks, "commit_version", lambda *a, **k: 1 / 0)  # all is written, but not switched to
    with pytest.raises(ZeroDivisionError):
        migrate(analyze(university.only(["courses", "departments"])), folder)
    monkeypatch.undo()
    assert rows_of(sinks.read_graph(spark, folder, model)) == before
    assert len(rows_of(migrate(analyze(university.only(["courses", "departments"])), folder))[1]) == 3


def test_the_same_load_twice_adds_nothing(spark, blog, folder):
    once = rows_of(migrate(analyze(blog), folder, clear=False))
    assert rows_of(migrate(analyze(blog), folder, clear=False)) == once
    changed = blog.with_tables(users=blog["users"].where("id = 2").withColumn("name", F.lit("New")))
    g = migrate(analyze(replace(changed, foreign_keys=())), folder, clear=False)
    assert sorted((r.id, r.name) for r in g.nodes["Users"].collect()) == [(1, "Alice Smith"), (2, "New"), (3, "Charlie Brown")]
    whole = sinks.read_graph(spark, folder, build_graph(blog))
    assert rows_of(whole) == once


def test_old_versions_go_and_a_name_is_taken_once(spark, blog, folder):
    for _ in range(4):
        migrate(analyze(blog), folder)
    assert sinks.versions(spark, folder) == [3, 4]
    with pytest.raises(RuntimeError):
        sinks.commit_version(spark, folder, 4)
    assert sinks.current_version(spark, folder).endswith("version=4") and sinks.current_version(spark, folder + "/x") is None


def test_bucketed_tables_join_without_an_exchange(spark, folder):
    big = spark.range(1000).selectExpr("CAST(id % 50 AS STRING) AS k", "id")
    keys = spark.range(50).selectExpr("CAST(id AS STRING) AS node_key", "id * 2 AS v")
    a = sinks.write_bucketed(big, "bucketed_big", "k", buckets=4, path=f"{folder}/a")
    b = sinks.write_bucketed(keys, "bucketed_keys", "node_key", buckets=4, path=f"{folder}/b")
    joined = a.hint("merge").join(b, a["k"] == b["node_key"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 1000
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't show what is skipped
    one = b.where("node_key = '7'")
    assert "SelectedBucketsCount: 1 out of 4" in one._jdf.queryExecution().executedPlan().toString() and one.first().v == 14
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    spark.sql("DROP TABLE bucketed_big")
    spark.sql("DROP TABLE bucketed_keys")


# -- empty sources ----------------------------------------------------------------------------


def test_checks_of_a_source_without_foreign_keys_and_without_tables(spark):
    one = Source(spark, {"t": spark.createDataFrame([(1,)], "id int")}, primary_keys={"t": ("id",)})
    for s in (one, Source(spark, {})):
        g = build_graph(s)
        assert {r.status for r in validate(s, g)["summary"].collect()} == {"PASSED"}
        for df in (CK.instance_counts(s, g), CK.orphan_rows(s), CK.required_properties(s), CK.missing_nodes(g)):
            assert df.count() == 0
        assert g.all_nodes.count() == len(s.tables)

import pytest

from graphlift import ForeignKey, Source, build_graph, collect_over_hub, match, node, step
from graphlift.operators import match as M


@pytest.fixture(scope="module")
def uni(university):
    return build_graph(university)


def test_students_of_a_department(uni):
    got = match(
        uni,
        [node("d", "Departments"), step("WORKS_IN", "in"), node("c", "Courses"), step("ENROLLMENTS", "in"), node("s", "Students")],
        where="d.departmentName = 'Computer Science'",
        returns={"first": "s.firstName", "course": "c.courseName"},
    )
    assert sorted(map(tuple, got.collect())) == [("Ann", "Databases"), ("Ann", "Graphs"), ("Ben", "Databases")]


def test_professors_and_collected_courses(uni):
    got = collect_over_hub(
        uni, node("p", "Professors"), node("d", "Departments"), node("c", "Courses"),
        start_step="WORKS_IN", end_step="WORKS_IN", value="c.courseName", alias="courses", returns={"first": "p.firstName"},
    )
    assert {r["first"]: r.courses for r in got.collect()} == {"Pia": ["Databases", "Graphs"], "Quo": ["Algebra"]}


def test_edge_properties_and_limit(uni):
    got = match(
        uni,
        [node("s", "Students"), step("ENROLLMENTS", var="e"), node("c", "Courses")],
        returns={"first": "s.firstName", "course": "c.courseName", "grade": "get_json_object(e.props, '$.grade')"},
        order_by=["first", "course"],
        limit=3,
    )
    assert [tuple(r) for r in got.collect()] == [("Ann", "Databases", "A"), ("Ann", "Graphs", "B"), ("Ben", "Databases", None)]


@pytest.mark.parametrize("named", [False, True])
def test_an_edge_is_not_walked_twice(uni, named):
    """Courses of the same department: a course does not meet itself."""
    got = match(
        uni,
        [node("a", "Courses"), step("WORKS_IN", var="r1" if named else None), node("d", "Departments"),
         step("WORKS_IN", "in", var="r2" if named else None), node("b", "Courses")],
        returns={"a": "a.courseName", "b": "b.courseName"},
    )
    assert sorted(map(tuple, got.collect())) == [("Databases", "Graphs"), ("Graphs", "Databases")]


def test_carried_and_stored_edges_agree(uni):
    pattern = [node("c", "Courses"), step("WORKS_IN"), node("d", "Departments")]
    returns = {"c": "c.courseId", "d": "d.departmentName"}
    fast = match(uni, pattern, returns=returns)
    slow = match(uni, [pattern[0], step("WORKS_IN", var="r"), pattern[2]], returns=returns)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join Inner") + plan.count("HashJoin") == 1 or plan.count("Join") <= 2


@pytest.mark.parametrize("hot_rows", [1, 2, 100])
def test_spreading_changes_nothing(uni, hot_rows):
    patterns = [
        [node("c", "Courses"), step("WORKS_IN"), node("d", "Departments")],
        [node("d", "Departments"), step("WORKS_IN", "in"), node("c", "Courses"), step("ENROLLMENTS", "in"), node("s", "Students")],
        [node("a", "Students"), step("ENROLLMENTS"), node("c", "Courses"), step("ENROLLMENTS", "in"), node("b", "Students")],
        [node("a", "Courses"), step("WORKS_IN"), node("d", "Departments"), step("WORKS_IN", "in", var="r"), node("b", "Courses")],
    ]
    for pattern in patterns:
        returns = {n.var: f"{n.var}.node_key" for n in pattern[0::2]}
        want = match(uni, pattern, returns=returns)
        got = match(uni, pattern, returns=returns, spread=True, hot_rows=hot_rows)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert want.count() > 0


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS k", "id % 7 AS g", "'x' AS wide").write.parquet(str(tmp_path / "t"))
    g = build_graph(Source(spark, {"t": spark.read.parquet(str(tmp_path / "t"))}, primary_keys={"t": ("k",)}))
    plan = match(g, [node("t", "T")], where="t.g = 3", returns={"k": "t.k"})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(g,3)" in plan and "wide" not in plan


def test_wrong_patterns(uni):
    with pytest.raises(ValueError):
        match(uni, [node("a", "Courses"), step("WORKS_IN")])
    with pytest.raises(ValueError):
        match(uni, [node("a", "Courses"), step("NOPE"), node("b", "Departments")])
    with pytest.raises(ValueError):
        step("X", "sideways")


def test_counts(uni):
    assert {r.label: r.n for r in M.node_counts(uni).collect()} == {"Departments": 3, "Students": 3, "Courses": 4, "Professors": 2}
    assert {(r.rel_type, r.from_label): r.n for r in M.edge_counts(uni).collect()} == {
        ("WORKS_IN", "Courses"): 3, ("WORKS_IN", "Professors"): 2, ("ENROLLMENTS", "Students"): 4,
    }
    assert M.edge_counts(uni, "ENROLLMENTS").count() == 1
    h = {(r.kind, r.name): r.n for r in M.histogram(uni).collect()}
    assert h[("node", None)] == 12 and h[("edge", None)] == 9 and h[("edge", "WORKS_IN")] == 5
    assert [r.node_key for r in M.graph_sample(uni, 3).collect()] == ["10", "11", "12"]
    assert {r.rel_type for r in M.types_of_label(uni, "Students").collect()} == {"ENROLLMENTS"}


def plain_count(graph, pattern, where=None, per=None):
    text = " AND ".join(f"({c})" for c in (where or {}).values()) or None
    rows = match(graph, pattern, where=text, returns={"k": f"{pattern[0].var}.node_key"}).collect()
    return sorted((k, sum(r.k == k for r in rows)) for k in {r.k for r in rows}) if per else len(rows)


@pytest.fixture
def crowd(spark):
    """People with a home club and memberships, one of them twice in one club."""
    from graphlift import ForeignKey

    rows = lambda text, data: spark.createDataFrame(data, text)
    s = Source(
        spark,
        {
            "club": rows("cid int, city string", [(1, "x"), (2, "y"), (3, "x")]),
            "person": rows("pid int, age int, home int", [(i, 20 + i, 1 + i % 2) for i in range(6)]),
            "member": rows("pid int, cid int, since int", [(0, 1, 7), (1, 1, 8), (1, 2, 9), (2, 1, 7), (2, 1, 8), (4, 3, 1)]),
        },
        primary_keys={"club": ("cid",), "person": ("pid",), "member": ("pid", "cid")},
        foreign_keys=(
            ForeignKey("home", "person", "home", "club", "cid"), ForeignKey("mp", "member", "pid", "person", "pid"),
            ForeignKey("mc", "member", "cid", "club", "cid"),
        ),
    )
    return build_graph(s, assume_complete=True)


@pytest.mark.parametrize("where", [{}, {"p": "p.age > 21"}, {"c": "c.city = 'x'", "q": "q.age < 24"}])
@pytest.mark.parametrize("kind", ["home", "member", "mixed", "one", "long"])
def test_counts_equal_the_paths(crowd, kind, where):
    home = next(e.rel_type for e in crowd.edge_types if e.fk.name == "home")
    member = next(e.rel_type for e in crowd.edge_types if e.fk.table == "member")
    p, c, q = node("p", "Person"), node("c", "Club"), node("q", "Person")
    pattern = {
        "home": [p, step(home), c, step(home, "in"), q],
        "member": [p, step(member), c, step(member, "in"), q],
        "mixed": [p, step(home), c, step(member, "in"), q],
        "one": [p, step(member), c],
        "long": [q, step(home), c, step(member, "in"), p],
    }[kind]
    names = {n.var for n in pattern[0::2]}
    used = {k: v for k, v in where.items() if k in names}
    inner = {k: v.replace(f"{k}.", "") for k, v in used.items()}
    assert M.count_paths(crowd, pattern, where=inner).first().n == plain_count(crowd, pattern, used)
    per = sorted((r.node_key, r.n) for r in M.count_paths(crowd, pattern, where=inner, per_start=True).collect())
    assert per == plain_count(crowd, pattern, used, per=True)


def test_counts_refuse_what_they_cannot_tell_apart(crowd):
    home = next(e.rel_type for e in crowd.edge_types if e.fk.name == "home")
    p, c, q = node("p", "Person"), node("c", "Club"), node("q", "Person")
    with pytest.raises(ValueError):
        M.count_paths(crowd, [p, step(home), c, step(home, "in"), q, step(home), node("d", "Club")])
    with pytest.raises(ValueError):
        M.count_paths(crowd, [p, step(home), c], where={"z": "1 = 1"})
    with pytest.raises(ValueError):
        M.count_paths(crowd, [p])


def test_spread_steps_between_keys_of_different_types(spark):
    from graphlift import ForeignKey

    parent = spark.range(4).selectExpr("CAST(id AS INT) AS id", "concat('p', id) AS name")
    child = spark.range(40).selectExpr("id AS n", "CAST(id % 3 AS DECIMAL(9, 1)) AS parent")
    s = Source(spark, {"parent": parent, "child": child}, primary_keys={"parent": ("id",), "child": ("n",)}, foreign_keys=(ForeignKey("f", "child", "parent", "parent", "id"),))
    g = build_graph(s)
    pattern = [node("c", "Child"), step(g.edge_types[0].rel_type), node("p", "Parent")]
    for spread in (False, True):
        assert match(g, pattern, spread=spread, hot_rows=5).count() == 40
    assert sorted({r.to_key for r in g.edges.collect()}) == ["0", "1", "2"]


def test_counts_of_a_table_with_several_keys_join_none_of_their_parents(university):
    from graphlift.operators.match import _step_ends

    courses = university["courses"].selectExpr("*", "CAST(7 AS BIGINT) AS professor_id")
    keys = (*university.foreign_keys, ForeignKey("course_professor", "courses", "professor_id", "professors", "professor_id"))
    s = Source(university.spark, {**university.tables, "courses": courses}, primary_keys=university.primary_keys, foreign_keys=keys)
    g = build_graph(s)
    e = next(e for e in g.edge_types if e.fk.name == "course_department")
    ends = _step_ends(g, node("c", "Courses"), step(e.rel_type), node("d", "Departments"))
    assert "Join" not in ends._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.x, r.y) for r in ends.collect()) == [("10", "1"), ("11", "1"), ("12", "2")]
    assert M.count_paths(g, [node("c", "Courses"), step(e.rel_type), node("d", "Departments")]).first().n == 3

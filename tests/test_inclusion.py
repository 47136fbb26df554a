"""Inclusion dependencies and foreign keys of several columns, against brute force."""

import random
from itertools import permutations

import pyarrow as pa
import pytest

from graphlift import ForeignKey, Source, analyze, build_graph, validate
from graphlift.operators import inclusion as I
from graphlift.operators import profile as P


def source(spark, tables, **keys):
    frames = {t: spark.createDataFrame(pa.table({c: pa.array(v, k) for c, (k, v) in cols.items()})) for t, cols in tables.items()}
    return Source(spark, frames, **keys)


def some_tables(seed):
    r = random.Random(seed)
    tables = {}
    for t in ("a", "b", "c"):
        n = r.choice([0, 3, 40])
        cols = {}
        for i in range(4):
            kind = r.choice([pa.int64(), pa.int32(), pa.string(), pa.date32()])
            low, wide = r.choice([0, 0, 2]), r.choice([1, 3, 8])
            values = [None if r.random() < 0.2 else r.randint(low, low + wide) for _ in range(n)]
            cols[f"c{i}"] = (kind, [None if v is None else ("x" * 70 + str(v) if v % 3 else str(v)) for v in values] if kind == pa.string() else values)
        tables[t] = cols
    return tables


def brute(tables):
    columns = [(t, c, "i" if pa.types.is_integer(k) else str(k), {x for x in v if x is not None}, v) for t, cols in tables.items() for c, (k, v) in cols.items()]
    return sorted(
        (t, c, rt, rc, len(x), len(y), len(y) == len(v2))
        for t, c, k, x, _ in columns for rt, rc, rk, y, v2 in columns
        if (t, c) != (rt, rc) and k == rk and x and x <= y
    )


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("word", [63, 2])
def test_inclusions_equal_brute_force(spark, monkeypatch, seed, word):
    monkeypatch.setattr(I, "_WORD", word)
    tables = some_tables(seed)
    got = I.inclusion_dependencies(source(spark, tables)).drop("shares_name").collect()
    assert sorted(map(tuple, got)) == brute(tables)


def test_references_that_no_name_gives_away(spark):
    s = source(
        spark,
        {
            "people": {"id": (pa.int64(), [1, 2, 3, 4]), "manager": (pa.int64(), [None, 1, 1, 2])},
            "cars": {"plate": (pa.string(), ["a", "b"]), "owner": (pa.int32(), [3, 4])},
            "visits": {"n": (pa.int64(), [70, 80]), "people_id": (pa.int64(), [1, 1])},
        },
        primary_keys={"people": ("id",), "cars": ("plate",), "visits": ("n",)},
    )
    got = {(r.table_name, r.column_name, r.ref_table, r.ref_column): (r.shares_name, r.is_unique) for r in I.inclusion_dependencies(s, to_keys=True).collect()}
    assert got == {
        ("people", "manager", "people", "id"): (False, True), ("cars", "owner", "people", "id"): (False, True),
        ("visits", "people_id", "people", "id"): (True, True),
    }
    assert [(fk.table, fk.column) for fk in I.discover_foreign_keys(s)] == [("visits", "people_id")]
    assert {(fk.table, fk.column) for fk in I.discover_foreign_keys(s, need_name=False)} == {("people", "manager"), ("cars", "owner"), ("visits", "people_id")}


def test_one_value_outside_is_found_beyond_any_sketch(spark):
    child = spark.range(60_000).selectExpr("IF(id = 31234, 60001, id) AS x")
    s = Source(spark, {"c": child, "p": spark.range(60_000).selectExpr("id AS y", "id * 2 AS z")})
    pairs = {(r.column_name, r.ref_column) for r in I.inclusion_dependencies(s).collect()}
    assert pairs == set()
    s = s.with_tables(c=spark.range(60_000).selectExpr("id AS x"))
    assert {(r.column_name, r.ref_column) for r in I.inclusion_dependencies(s).collect()} == {("x", "y"), ("y", "x")}


def test_no_tables_and_empty_tables(spark):
    assert I.inclusion_dependencies(Source(spark, {})).count() == 0
    assert I.inclusion_dependencies(source(spark, {"t": {"a": (pa.int64(), []), "b": (pa.int64(), [])}})).count() == 0
    assert I.composite_inclusions(Source(spark, {})) == []


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("width", [2, 3])
def test_composite_inclusions_equal_brute_force(spark, seed, width):
    r = random.Random(seed)
    names = ["p", "q", "r"][:width]
    parent = sorted({tuple(r.randint(0, 3) for _ in names) for _ in range(40)})
    rows = [tuple(r.choice(parent)) for _ in range(12)]
    child = {f"x{i}": [row[i] for row in rows] for i in range(width)}
    child["x0"][3] = None
    child["odd"] = [r.randint(0, 3) for _ in rows]
    tables = {
        "parent": {n: (pa.int32(), [row[i] for row in parent]) for i, n in enumerate(names)},
        "child": {c: (pa.int64(), v) for c, v in child.items()},
    }
    s = source(spark, tables, primary_keys={"parent": tuple(names)})
    found = {(t, c) for (t, c), (rt, rc) in I.composite_inclusions(s) if (rt, rc) == ("parent", tuple(names))}
    want = set()
    for t, cols in (("child", child), ("parent", {n: [row[i] for row in parent] for i, n in enumerate(names)})):
        for choice in permutations(cols, width):
            tuples = {x for x in zip(*[cols[c] for c in choice]) if None not in x}
            single = all({x for x in cols[c] if x is not None} for c in choice)
            if tuples and single and tuples <= set(parent) and (t, choice) != ("parent", tuple(names)):
                want.add((t, choice))
    assert found == want


@pytest.fixture
def stock(spark):
    """Bins by (hall, shelf); moves refer to them by two columns, checks by the label, one move has no shelf and one no bin."""
    return source(
        spark,
        {
            "bin": {"hall": (pa.string(), ["A", "A", "B|1"]), "shelf": (pa.int32(), [1, 2, 1]), "label": (pa.string(), ["x", "y", "z"])},
            "move": {"n": (pa.int64(), [1, 2, 3, 4, 5]), "to_hall": (pa.string(), ["A", "A", "B|1", "A", "C"]), "to_shelf": (pa.int64(), [1, 2, 1, None, 1])},
            "audit": {"m": (pa.int64(), [7, 8, 9]), "bin_label": (pa.string(), ["y", "y", None])},
        },
        primary_keys={"bin": ("hall", "shelf"), "move": ("n",), "audit": ("m",)},
        unique_keys={"bin": (("label",),)},
        foreign_keys=(
            ForeignKey("move_bin", "move", ("to_shelf", "to_hall"), "bin", ("shelf", "hall")),
            ForeignKey("audit_bin", "audit", "bin_label", "bin", "label"),
        ),
    )


def ends(graph):
    return sorted((r.fk_name, r.from_key, r.to_key) for r in graph.edges.collect())


def test_edges_of_composite_and_translated_keys(spark, stock):
    want = [
        ("audit_bin", "7", "A|2"), ("audit_bin", "8", "A|2"),
        ("move_bin", "1", "A|1"), ("move_bin", "2", "A|2"), ("move_bin", "3", "B\\|1|1"),
    ]
    profile = P.materialize(P.fk_profile(stock))
    by_name = {r.fk_name: r for r in profile.collect()}
    assert (by_name["move_bin"].null_rows, by_name["move_bin"].orphan_rows, by_name["move_bin"].column_name) == (1, 1, "to_shelf,to_hall")
    for mode in ("direct", "enriched"):
        assert ends(build_graph(stock, mode)) == want
        assert ends(build_graph(stock, mode, evidence=profile)) == want
        assert ends(build_graph(stock, mode, row_counts={"bin": 10**9})) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ends(build_graph(stock, evidence=profile, row_counts={"bin": 3})) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = analyze(stock)
    report = validate(found.source, build_graph(found.source, evidence=found.evidence))
    assert {r.phase: r.errors for r in report["summary"].collect()} == {"pre": 0, "post": 0}
    assert {(r.fk_name, r.instances, r.edges) for r in report["instances"].collect()} == {("move_bin", 4, 3), ("audit_bin", 2, 2)}


def test_rules_see_all_columns_of_a_key(spark):
    """A junction of two composite keys, and a subclass that shares a key of two columns."""
    ints = lambda *v: (pa.int64(), list(v))
    s = source(
        spark,
        {
            "room": {"house": ints(1, 1, 2), "no": ints(1, 2, 1)},
            "suite": {"house": ints(1), "no": ints(2), "bath": ints(1)},
            "door": {"h1": ints(1), "n1": ints(1), "h2": ints(1), "n2": ints(2), "width": ints(80)},
        },
        primary_keys={"room": ("house", "no"), "suite": ("house", "no"), "door": ("h1", "n1", "h2", "n2")},
        foreign_keys=(
            ForeignKey("suite_room", "suite", ("no", "house"), "room", ("no", "house")),
            ForeignKey("door_from", "door", ("h1", "n1"), "room", ("house", "no")),
            ForeignKey("door_to", "door", ("h2", "n2"), "room", ("house", "no")),
        ),
    )
    g = build_graph(s)
    assert sorted(g.nodes) == ["Room", "Suite"]
    assert sorted((r.rel_type, r.from_key, r.to_key, r.props) for r in g.edges.collect()) == [("DOOR", "1|1", "1|2", '{"width":80}'), ("IS_A_ROOM", "1|2", "1|2", None)]


def test_lengths_must_agree():
    with pytest.raises(ValueError):
        ForeignKey("f", "a", ("x", "y"), "b", "z")

from itertools import combinations

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphlift import ForeignKey, Source
from graphlift.operators import profile as P


def brute_key(pdf: pd.DataFrame) -> tuple[str, ...]:
    complete = [c for c in pdf.columns if pdf[c].notna().all()]
    for n in range(1, len(complete) + 1):
        for combo in combinations(complete, n):
            if not pdf.duplicated(list(combo)).any():
                return combo
    return ()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 2)), min_size=1, max_size=12))
def test_primary_key_matches_brute_force(spark, rows):
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"])
    assert P.discover_primary_key(spark.createDataFrame(pa.Table.from_pandas(pdf))) == brute_key(pdf)


def test_near_unique_key_is_refused(spark):
    """One duplicate in 20,000 rows: too few for a sketch to see, so the exact test must."""
    df = spark.range(20_000).selectExpr("id % 100 AS b", "id DIV 100 AS c", "IF(id = 19999, 7, id) AS a")
    assert P.discover_primary_key(df) == ("b", "c")


def test_no_key_and_empty(spark):
    df = spark.createDataFrame(pa.table({"a": [1, 1, 1], "b": [2, 2, None]}))
    assert P.discover_primary_key(df) == ()
    assert P.discover_primary_key(df.limit(0)) == ()


def test_profile_counts(spark):
    s = Source(spark, {"t": spark.createDataFrame(pa.table({"x": [0.0, -0.0, None], "s": ["a" * 100, "a" * 99 + "b", "a" * 100], "k": [1, 2, 3]}))})
    got = {r.column_name: r for r in P.column_profile(s).collect()}
    assert (got["x"].ndv, got["x"].null_count, got["x"].is_unique) == (1, 1, False)
    assert (got["s"].ndv, got["s"].max_length) == (2, 100)
    assert got["k"].is_unique and (got["k"].min_value, got["k"].max_value) == ("1", "3")


def test_sketch_ignores_nulls(spark):
    s = {"t": spark.createDataFrame(pa.table({"x": pa.array([1, 1, None, None], pa.int64())}))}
    assert P.column_stats(s).first().approx_ndv == 1


def test_fk_profile(spark):
    child = spark.createDataFrame(pa.table({"id": list(range(9)), "p": [1, 1, 1, 2, 9, 9, None, None, 3]}))
    parent = spark.createDataFrame(pa.table({"p": [1, 2, 3, 4, 5]}))
    s = Source(spark, {"c": child, "p": parent}, foreign_keys=(ForeignKey("f", "c", "p", "p", "p"),))
    r = P.fk_profile(s).first()
    assert (r.child_rows, r.null_rows, r.non_null_rows, r.orphan_rows, r.orphan_values) == (9, 2, 7, 2, 1)
    assert (r.max_children, r.parent_rows, r.parents_with_child, r.max_parents) == (3, 5, 3, 1)


def test_foreign_keys_need_name_and_containment(spark):
    s = Source(
        spark,
        {
            "a": spark.createDataFrame(pa.table({"a_key": [1, 2, 3], "size": [1, 2, 3]})),
            "b": spark.createDataFrame(pa.table({"b_id": [1, 2], "b_key": [1, 3], "x_size": [1, 2]})),
            "c": spark.createDataFrame(pa.table({"c_id": [1, 2], "c_key": [1, 9]})),
        },
        primary_keys={"a": ("a_key",), "b": ("b_id",), "c": ("c_id",)},
    )
    assert [(fk.table, fk.column, fk.ref_table) for fk in P.discover_foreign_keys(s)] == [("b", "b_key", "a")]


def test_only_direct_foreign_keys_are_kept(people, spark):
    """manager -> employee -> person on the same column: manager -> person is implied."""
    names = ["person", "employee", "manager"]
    s = Source(spark, {t: people[t] for t in names}, primary_keys={t: ("person_id",) for t in names})
    found = {(fk.table, fk.ref_table) for fk in P.discover_foreign_keys(s)}
    assert found == {("employee", "person"), ("manager", "employee")}
    same = {t: people["person"].select("person_id") for t in names}
    left = P.discover_foreign_keys(Source(spark, same, primary_keys={t: ("person_id",) for t in names}))
    assert {fk.table for fk in left} == set(names)  # equal tables: a ring is left, not nothing


def test_foreign_keys_of_blog(blog):
    s = Source(blog.spark, blog.tables, primary_keys=blog.primary_keys)
    found = {(fk.table, fk.column, fk.ref_table) for fk in P.discover_foreign_keys(s)}
    assert found == {("posts", "user_id", "users"), ("post_tags", "post_id", "posts"), ("post_tags", "tag_id", "tags")}


def test_auto_increment_and_unique(spark):
    s = Source(
        spark,
        {"t": spark.createDataFrame(pa.table({"id": [1, 2, 3], "gap": [1, 2, 4], "dup": [1, 2, 2], "u": ["a", "b", "c"]}))},
        primary_keys={"t": ("id",)},
    )
    assert [r.column_name for r in P.auto_increment_columns(s).collect()] == ["id"]
    assert sorted(r.column_name for r in P.unique_columns(s).collect()) == ["gap", "u"]


def test_profile_of_blog(blog):
    got = {r.fk_name: r for r in P.fk_profile(blog).collect()}
    assert got["posts_user"].parents_with_child == 2
    assert got["pt_tag"].max_children == 2
    assert P.materialize(P.fk_profile(blog)).count() == 3


@pytest.mark.parametrize("parallel", [1, 4])
def test_discover_all(blog, parallel):
    s = Source(blog.spark, blog.tables)
    assert P.discover_primary_keys(s, parallel=parallel) == {
        "users": ("id",), "posts": ("id",), "tags": ("id",), "post_tags": ("post_id", "tag_id"),
    }


@pytest.mark.parametrize("sizes", [(10, 10, 10), (20, 20, 20), (3, 4, 5, 7)])
def test_keys_of_any_width(spark, sizes):
    from itertools import product

    names = [f"c{i}" for i in range(len(sizes))]
    df = spark.createDataFrame(list(product(*[range(n) for n in sizes])), ", ".join(f"{n} int" for n in names))
    assert P.discover_primary_key(df) == tuple(names)
    assert P.discover_primary_key(df.unionByName(df.limit(1))) == ()


def test_wide_tables_shrink_the_whole_set(spark, monkeypatch):
    from itertools import product

    monkeypatch.setattr(P, "_MOST_CANDIDATES", 0)
    df = spark.createDataFrame([(a, b, 0, c) for a, b, c in product(range(6), range(6), range(6))], "a int, b int, x int, c int")
    assert P.discover_primary_key(df) == ("a", "b", "c")
    assert P.discover_primary_key(df.unionByName(df)) == ()


def test_distinct_counts_of_integers(spark):
    import random

    r = random.Random(4)
    far = [-(2**63), 2**63 - 1, -1, 0, 63, 64, -64, -65]
    columns = {
        "x": pa.array([r.choice([*far, None, r.randint(-200, 200)]) for _ in range(500)], pa.int64()),
        "y": pa.array([r.choice([None, *range(-128, 128)]) for _ in range(500)], pa.int8()),
        "z": pa.array([None] * 500, pa.int32()),
        "k": pa.array(r.sample(range(-250, 250), 500), pa.int16()),
        "t": pa.array([r.choice("abc") for _ in range(500)], pa.string()),
    }
    s = Source(spark, {"t": spark.createDataFrame(pa.table(columns)).repartition(5), "none": spark.createDataFrame([], "a int, b string")})
    got = {r.column_name: (r.ndv, r.is_unique) for r in P.column_profile(s).collect()}
    want = {c: (len(set(v.drop_null().to_pylist())), c == "k") for c, v in columns.items()}
    assert got == want | {"a": (0, False), "b": (0, False)}
    assert {r.column_name for r in P.unique_columns(s).collect()} == {"k"}
    assert [(r.column_name, r.first_value, r.last_value) for r in P.auto_increment_columns(s).collect()] == [("k", -250, 249)]

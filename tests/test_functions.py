import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphlift.functions import naming as N
from graphlift.functions import types as TY
from graphlift.functions import values as V


def apply(spark, rule, *columns):
    names = "abcd"[: len(columns)]
    df = spark.createDataFrame(pa.table(dict(zip(names, columns))))
    return [r[0] for r in df.select(F.expr(rule)).collect()]


def test_node_label(spark):
    names = ["order_items", "users", "_foo", "1a", "", "___", "a b-c_d", "OrderItems", "é_a"]
    assert apply(spark, N.node_label("a"), names) == [
        "OrderItems", "Users", "NFoo", "N1a", "Node", "N", "AbcD", "Orderitems", "NA",
    ]


def test_property_name(spark):
    names = ["first_name", "id", "_x_", "a b-c", "", "__", "FooBar", "o_orderkey"]
    assert apply(spark, N.property_name("a"), names) == ["firstName", "id", "x", "aBC", "property", "property", "foobar", "oOrderkey"]


def test_relationship_type(spark):
    pairs = [("posts", "users"), ("OrderItems", "address"), ("order-lines", "item"), ("ss", "x")]
    got = apply(spark, N.relationship_type("a", "b"), [p[0] for p in pairs], [p[1] for p in pairs])
    assert got == ["POST_USER", "ORDER_ITEM_ADDRE", "ORDER_LINE_ITEM", "X"]


def test_identifier(spark):
    names = ["a", "_a1", "1a", "", "a b", "é9", "a-b", None, "a\n"]
    assert apply(spark, N.is_valid_identifier("a"), names) == [True, True, False, False, False, True, False, False, False]


@pytest.mark.parametrize(
    "column, table, loose, expected",
    [
        ("manager_id", "people", False, "MANAGES"),
        ("user_id", "customer", False, "USED_BY"),
        ("c", "customers", False, "PURCHASED_BY"),
        ("department_id", "d", False, "WORKS_IN"),
        ("video_id", "videos", False, None),
        ("idowner", "x", True, "OWNS"),
        ("owidner", "x", True, "OWNS"),
        ("owidner", "x", False, None),
    ],
)
def test_verbs(spark, column, table, loose, expected):
    assert apply(spark, N.verb_for("a", "b", as_coded=loose), [column], [table]) == [expected]


def test_relationship_name(spark):
    rule = N.relationship_name("a", "b", "c", "d")
    got = apply(spark, rule, ["x", "x", "x", "x"], ["tbl_Order_Line"] * 4, [True, False, False, True], [False, True, False, True])
    assert got == ["IS_A_TBL_ORDER_LINE", "PART_OF_ORDERLINE", "HAS_ORDERLINE", "IS_A_TBL_ORDER_LINE"]


TYPES = {
    "bigint": ("BIGINT", "INTEGER", "INTEGER", "INTEGER"),
    "datetime": ("DATETIME", "DATE", "DATETIME", "DATETIME"),
    "character varying(20)": ("VARCHAR", "CHAR", "STRING", "STRING"),
    "interval": ("UNKNOWN", "INTEGER", "STRING", "INTEGER"),
    "decimal(10,2)": ("DECIMAL", "DECIMAL", "FLOAT", "FLOAT"),
    "timestamp without time zone": ("TIMESTAMP", "TIMESTAMP", "DATETIME", "DATETIME"),
    "array<float>": ("UNKNOWN", "FLOAT", "LIST", "FLOAT"),
    "jsonb": ("JSON", "JSON", "MAP", "MAP"),
    "date": ("DATE", "DATE", "DATE", "DATE"),
    "BIT": ("BOOLEAN", "BOOLEAN", "BOOLEAN", "BOOLEAN"),
    "blob": ("BINARY", "BINARY", "STRING", "STRING"),
    "serial": ("INTEGER", "UNKNOWN", "INTEGER", "INTEGER"),
}


def test_types(spark):
    names = list(TYPES)
    rules = [
        TY.column_type("a"), TY.column_type("a", as_coded=True), TY.graph_type("a"), TY.graph_type("a", as_coded=True),
    ]
    got = list(zip(*[apply(spark, r, names) for r in rules]))
    assert dict(zip(names, got)) == TYPES


def test_temporal_text(spark):
    stamps = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 120000), None]
    assert apply(spark, V.temporal_text("a"), stamps) == [None if t is None else str(t) for t in stamps]


def test_json_value(spark):
    rule = f"to_json(struct({V.json_value('a')} AS v))"
    assert apply(spark, rule, ['{"k": 1}', "oops", "[1,2]"]) == ['{"v":{"k":1}}', '{"v":"oops"}', '{"v":[1,2]}']


def test_node_key_is_injective(spark):
    df = spark.createDataFrame(pa.table({"a": ["x|y", "x", "x\\", "x"], "b": ["z", "y|z", "|z", "\\|z"]}))
    keys = [r[0] for r in df.select(F.expr(V.node_key(df.schema, ("a", "b")))).collect()]
    assert len(set(keys)) == 4
    assert df.select(F.expr(V.node_key(df.schema, ()))).distinct().count() == 4

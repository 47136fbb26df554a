import datetime as dt

import pyarrow as pa
import pytest

from graphlift.sources import files, paging


def numbered(df, key, **options):
    rows = paging.with_row_number(df, key, **options).collect()
    return [tuple(r[c] for c in key) for r in sorted(rows, key=lambda r: r.row_number)], sorted(r.row_number for r in rows)


FRAMES = {
    "dense": (["k"], lambda s: s.range(1000).selectExpr("id * 3 - 900 AS k")),
    "sparse": (["k"], lambda s: s.range(1000).selectExpr("xxhash64(id) AS k")),
    "outlier": (["k"], lambda s: s.range(1000).selectExpr("IF(id = 999, 9000000000000000000, id) AS k")),
    "text": (["k"], lambda s: s.range(1000).selectExpr("hex(xxhash64(id)) AS k")),
    "two": (["a", "b"], lambda s: s.range(1000).selectExpr("id % 37 AS a", "id DIV 37 AS b")),
    "date": (["k"], lambda s: s.createDataFrame(pa.table({"k": [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(300)]}))),
    "one": (["k"], lambda s: s.range(1).selectExpr("id AS k")),
    "none": (["k"], lambda s: s.range(0).selectExpr("id AS k")),
}


@pytest.mark.parametrize("name", FRAMES)
def test_row_numbers(spark, name):
    key, make = FRAMES[name]
    df = make(spark)
    order, numbers = numbered(df, key, rows_per_range=50)
    want = sorted(tuple(r[c] for c in key) for r in df.collect())
    assert order == want and numbers == list(range(len(want)))


def test_batches_and_pages_agree(spark):
    df = spark.range(1005).selectExpr("id * 7 % 1009 AS k", "id AS v")
    b = paging.batches(df, ["k"], 100, rows_per_range=64)
    assert b.select("k", "v").exceptAll(df).count() == 0 and b.count() == 1005
    for n in (0, 4, 10):
        want = sorted(r.k for r in b.where(f"batch_id = {n}").collect())
        assert [r.k for r in paging.page(df, ["k"], n * 100, 100).collect()] == want
        assert [r.k for r in paging.page(df, ["k"], n * 100, 100, top_rows=0, rows_per_range=64).collect()] == want
    with pytest.raises(ValueError):
        paging.batches(df, ["k"], 0)


def test_key_range(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    df = paging.key_range(spark.read.parquet(str(tmp_path / "t")), ["id"], 10, 13)
    assert [r.id for r in df.collect()] == [10, 11, 12]
    assert "GreaterThanOrEqual(id,10)" in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        paging.key_range(df, ["a", "b"], 1, 2)


def test_source_sql_and_selection(blog):
    got = blog.sql("SELECT name FROM {users} WHERE id = :id", {"id": 2}).collect()
    assert [r.name for r in got] == ["Bob Jones"]
    only = blog.only(["users", "posts"])
    assert set(only.tables) == {"users", "posts"} and [fk.name for fk in only.foreign_keys] == ["posts_user"]
    assert {r.table_name: r.row_count for r in blog.row_counts().collect()} == {"users": 3, "posts": 3, "tags": 2, "post_tags": 3}


# -- JDBC, without a database -----------------------------------------------------------------


def test_jdbc_urls():
    assert files.jdbc_url("mysql", "h", "d") == "jdbc:mysql://h:3306/d"
    assert files.jdbc_url("postgresql", "h", "d", 6000) == "jdbc:postgresql://h:6000/d"
    assert files.jdbc_url("sqlserver", "h", "d") == "jdbc:sqlserver://h:1433;databaseName=d"
    assert [files.qualified_name(k, "t") for k in ("mysql", "postgresql", "sqlserver")] == ["t", "public.t", "dbo.t"]
    with pytest.raises(ValueError):
        files.jdbc_url("oracle", "h", "d")


class FakeReader:
    def __init__(self, bounds):
        self.bounds, self.calls = bounds, []

    @property
    def read(self):
        return self

    def jdbc(self, url, table, **options):
        self.calls.append((table, options))
        return self

    def first(self):
        return self.bounds


def test_jdbc_is_split_on_the_key_range():
    fake = FakeReader((5, 99))
    files.read_jdbc(fake, "u", "t", key="id", partitions=4)
    (bounds, _), (table, options) = fake.calls
    assert "MIN(id)" in bounds and table == "t"
    assert (options["column"], options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("id", 5, 99, 4)
    empty = FakeReader((None, None))
    files.read_jdbc(empty, "u", "t", key="id", partitions=4)
    assert "column" not in empty.calls[-1][1]
    plain = FakeReader(None)
    files.read_jdbc(plain, "u", "t")
    assert len(plain.calls) == 1


class TextReader:
    """Stands in for a database: holds rows of a text key and answers the bounds and the conditions itself."""

    def __init__(self, spark, keys):
        self.df, self.spark, self.parts = spark.createDataFrame([(k,) for k in keys], "k string"), spark, None
        self.df.createOrReplaceTempView("texts_here")

    @property
    def read(self):
        return self

    def jdbc(self, url, table, *, predicates=None, properties=None):
        if predicates is None:
            return self.spark.sql(f"SELECT * FROM {table}")
        self.parts = [self.df.where(p) for p in predicates]
        return self.parts[0] if len(self.parts) == 1 else self.parts[0].unionByName(self.parts[1]) if len(self.parts) == 2 else None


@pytest.mark.parametrize("keys", [[f"k{i:03d}" for i in range(100)], ["a"] * 30 + ["b'c", "d\\e", None, None], ["only"], ["x", None]])
def test_jdbc_split_of_a_text_key_sees_every_row_once(spark, keys):
    old = spark.conf.get("spark.sql.parser.escapedStringLiterals")
    spark.conf.set("spark.sql.parser.escapedStringLiterals", "true")  # as in most databases, a backslash is itself
    try:
        reader = TextReader(spark, keys)
        files.read_jdbc(reader, "jdbc:postgresql://h/d", "texts_here", key="k", partitions=4)
        got = [r.k for p in reader.parts for r in p.collect()]
    finally:
        spark.conf.set("spark.sql.parser.escapedStringLiterals", old)
    assert sorted(map(str, got)) == sorted(map(str, keys))
    if len(keys) == 100:
        assert [p.count() for p in reader.parts] == [25] * 4


def test_text_ranges_escape():
    assert files.text_ranges("k", ["a", "o'x\\", "o'x\\", "z"], backslash=True) == ["k < 'o''x\\\\' OR k IS NULL", "k >= 'o''x\\\\' AND k < 'z'", "k >= 'z'"]
    assert files.text_ranges("k", []) == files.text_ranges("k", ["a"]) == ["1 = 1"]


@pytest.mark.parametrize("columns", [["k.y"], ["a.b", "k.y"]])
def test_many_ranges_and_dotted_names(spark, monkeypatch, columns):
    monkeypatch.setattr(paging, "_COARSE_RANGES", 8)
    df = spark.range(3000).selectExpr("hex(xxhash64(id)) AS `k.y`", "id % 3 AS `a.b`")
    numbered = paging.with_row_number(df, columns, rows_per_range=10)
    got = [(tuple(r[c] for c in columns), r.row_number) for r in numbered.collect()]
    assert [k for k, _ in sorted(got, key=lambda r: r[1])] == sorted(k for k, _ in got) and sorted(n for _, n in got) == list(range(3000))
    ranged = paging._with_range(df, columns, 10).groupBy("_range").count().collect()
    assert len(ranged) > 200 and max(r["count"] for r in ranged) < 60


def test_many_ranges_put_no_keys_of_others_into_a_row_and_no_range_list_into_one_task(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(paging, "_COARSE_RANGES", 4)
    monkeypatch.setattr(paging, "scratch_table", lambda df, f=paging.scratch_table: stored.append(df) or f(df))
    df = spark.range(2000).selectExpr("IF(id = 5, NULL, hex(xxhash64(id))) AS k", "id AS v")
    got = paging.with_row_number(df, ["k"], rows_per_range=1).collect()
    want = sorted((r for r in df.collect()), key=lambda r: (r.k is not None, r.k or ""))
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.row_number)] == [(r.k, r.v) for r in want]
    assert sorted(r.row_number for r in got) == list(range(2000))
    assert stored and not any("array" in kind for s in stored for _, kind in s.dtypes)
    ranged = paging._with_range(df, ["k"], 1)
    assert ranged.select("_part").distinct().count() <= 4

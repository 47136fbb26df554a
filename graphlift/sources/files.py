"""File and database readers that produce table DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Database kind -> (JDBC URL template, default port, default schema).
DIALECTS = {
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306, None),
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", 5432, "public"),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}", 1433, "dbo"),
}


def read_parquet(spark: SparkSession, directory: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """One DataFrame per ``<directory>/<name>.parquet``."""
    return {n: spark.read.parquet(f"{directory}/{n}.parquet") for n in names}


def jdbc_url(kind: str, host: str, database: str, port: int | None = None) -> str:
    """JDBC URL of a supported database kind, with its default port."""
    if kind not in DIALECTS:
        raise ValueError(f"Unsupported database type: {kind}")
    template, default_port, _ = DIALECTS[kind]
    return template.format(host=host, port=port or default_port, database=database)


def qualified_name(kind: str, table: str, schema: str | None = None) -> str:
    schema = schema or DIALECTS[kind][2]
    return f"{schema}.{table}" if schema else table


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    key: str | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Table over JDBC, split on the range of an integer, date or timestamp key, or on the order of a text key.

    The bounds are asked of the database itself: two of them for a key that can be divided, so each
    of the ``partitions`` tasks reads an equal part of the range; for any other key the least one of
    every ``partitions``-th of the rows, so each task reads as many rows. Every row is read once, those
    without a key by the first task. Filters and column selection are pushed down.
    """
    options = {**(properties or {}), "fetchsize": str(fetch_size)}
    if key is None or partitions <= 1:
        return spark.read.jdbc(url, table, properties=options)
    bounds = spark.read.jdbc(
        url, f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) key_bounds", properties=options
    ).first()
    lower, upper = bounds[0], bounds[1]
    if lower is None:
        return spark.read.jdbc(url, table, properties=options)
    if isinstance(lower, str):
        tiles = f"SELECT {key} AS k, NTILE({int(partitions)}) OVER (ORDER BY {key}) AS part FROM {table} WHERE {key} IS NOT NULL"
        first = spark.read.jdbc(url, f"(SELECT part, MIN(k) AS k FROM ({tiles}) tiles GROUP BY part) key_bounds", properties=options)
        firsts = [r[1] for r in sorted(first.collect(), key=lambda r: r[0])]
        return spark.read.jdbc(url, table, predicates=text_ranges(key, firsts, backslash=url.startswith("jdbc:mysql")), properties=options)
    return spark.read.jdbc(
        url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options
    )


def text_ranges(key: str, firsts: Iterable[str], *, backslash: bool = False) -> list[str]:
    """Conditions that cut a text key into ranges that begin at these values; every row meets exactly one.

    ``firsts`` come in the database's own order, in which it compares them too. ``backslash`` doubles
    that character, for databases that take it as an escape inside texts.
    """
    cuts = list(dict.fromkeys(firsts))[1:]
    if backslash:
        cuts = [c.replace("\\", "\\\\") for c in cuts]
    texts = ["'" + c.replace("'", "''") + "'" for c in cuts]
    if not texts:
        return ["1 = 1"]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(texts, texts[1:])]
    return [f"{key} < {texts[0]} OR {key} IS NULL", *inner, f"{key} >= {texts[-1]}"]

"""Profiling: what the rows say about columns, keys and foreign keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import fk_value, literal, quoted
from ..sources.source import ForeignKey, Source, local_frame, union_all
from .inclusion import discover_foreign_keys as discover_foreign_keys
from .inclusion import value_kind, value_text

# Distinct-count sketches of 2^12 registers: a standard error of 1.6 %. A key candidate whose
# estimate lies more than five of those below the row count is dropped without an exact check.
_SKETCH_SIZE = 12
_MARGIN = 1 - 5 * 0.0163

_KEY_TYPES = (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _approx_distinct(columns: Sequence[str]) -> str:
    """Estimated distinct count. One binary buffer per estimate, so many fit one aggregate."""
    names = ", ".join(quoted(c) for c in columns)
    known = " AND ".join(f"{quoted(c)} IS NOT NULL" for c in columns)  # a hash of null is a value
    return f"hll_sketch_estimate(hll_sketch_agg(CASE WHEN {known} THEN xxhash64({names}) END, {_SKETCH_SIZE}))"


def column_stats(tables: Mapping[str, DataFrame], *, distinct: bool = True) -> DataFrame:
    """One row per column from one pass per table, without a shuffle of rows.

    ``approx_ndv`` is a sketch (left out unless ``distinct``); minimum and maximum are text.
    """
    return union_all(_table_stats(t, df, distinct) for t, df in tables.items())


def _table_stats(table: str, df: DataFrame, distinct: bool) -> DataFrame:
    aggs, rows = ["count(1) AS n"], []
    for i, f in enumerate(df.schema.fields):
        c, plain = quoted(f.name), not isinstance(f.dataType, _NESTED)
        aggs.append(f"count({c}) AS c{i}")
        ndv = lo = hi = length = "NULL"
        if plain and distinct:
            aggs.append(f"{_approx_distinct([f.name])} AS d{i}")
            ndv = f"d{i}"
        if plain:
            aggs += [f"min({c}) AS lo{i}", f"max({c}) AS hi{i}"]
            lo, hi = f"lo{i}", f"hi{i}"
        if isinstance(f.dataType, T.StringType):
            aggs.append(f"max(length({c})) AS len{i}")
            length = f"len{i}"
        precision, scale = (f.dataType.precision, f.dataType.scale) if isinstance(f.dataType, T.DecimalType) else ("NULL", "NULL")
        rows.append(
            f"struct({literal(f.name)} AS column_name, {i + 1} AS ordinal, {literal(f.dataType.simpleString())} AS sql_type, "
            f"n AS row_count, n - c{i} AS null_count, CAST({ndv} AS BIGINT) AS approx_ndv, "
            f"CAST({lo} AS STRING) AS min_value, CAST({hi} AS STRING) AS max_value, CAST({length} AS BIGINT) AS max_length, "
            f"CAST({precision} AS INT) AS precision, CAST({scale} AS INT) AS scale)"
        )
    return df.selectExpr(*aggs).selectExpr(f"{literal(table)} AS table_name", f"inline(array({', '.join(rows)}))")


def value_multiplicity(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Exact distinct counts and the largest multiplicity per column, nulls left out.

    A table is read once: its columns are turned into ``(column, value)`` pairs that are counted
    map-side before the one shuffle, so a value that fills a third of a column travels as one row
    per task. Long texts are compared by digest, so that they do not travel at all.
    """
    return union_all(
        _multiplicity(t, df, list((columns or {}).get(t, df.columns)))
        for t, df in tables.items()
        if columns is None or columns.get(t)
    )


def _comparable(name: str, data_type: T.DataType) -> str:
    c = quoted(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        c = f"({c} + CAST(0 AS {data_type.simpleString()}))"  # -0.0 and 0.0 are one value
    if isinstance(data_type, (T.StringType, T.ArrayType)):
        text = f"CAST({c} AS STRING)"
        return f"CASE WHEN length({text}) > 64 THEN sha2({text}, 256) ELSE {text} END"
    return f"CAST({c} AS STRING)"


def _multiplicity(table: str, df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = ", ".join(
        f"struct({i} AS i, {_comparable(c, df.schema[c].dataType)} AS value)" for i, c in enumerate(columns)
    )
    names = ", ".join(literal(c) for c in columns)
    return (
        df.selectExpr(f"inline(array({pairs}))")
        .where("value IS NOT NULL")
        .groupBy("i", "value")
        .agg(F.expr("count(1) AS n"))
        .groupBy("i")
        .agg(F.expr("count(1) AS ndv"), F.expr("max(n) AS max_count"))
        .selectExpr(f"{literal(table)} AS table_name", f"array({names})[i] AS column_name", "ndv", "max_count")
    )


def distinct_counts(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``(table_name, column_name, ndv)``: exact distinct counts, nulls left out.

    Integers travel as bitmaps of 64 neighbouring numbers, merged on the map side, so a gapless key
    costs a 64th of its rows, and no column more than its distinct values. Other columns are counted
    by value (``value_multiplicity``).
    """
    wanted = {t: list((columns or {}).get(t, df.columns if columns is None else ())) for t, df in tables.items()}
    whole = {t: [c for c in cs if isinstance(tables[t].schema[c].dataType, T.IntegralType)] for t, cs in wanted.items()}
    other = {t: [c for c in cs if c not in whole[t]] for t, cs in wanted.items()}
    frames = [_distinct_integers(t, tables[t], cs) for t, cs in whole.items() if cs]
    if any(other.values()):
        frames.append(value_multiplicity({t: tables[t] for t, cs in other.items() if cs}, other).select("table_name", "column_name", "ndv"))
    return union_all(frames)


def _distinct_integers(table: str, df: DataFrame, columns: list[str]) -> DataFrame:
    values = [f"CAST({quoted(c)} AS BIGINT)" for c in columns]
    pairs = ", ".join(f"struct({i} AS i, shiftright({v}, 6) AS word, shiftleft(1L, CAST({v} & 63L AS INT)) AS bit)" for i, v in enumerate(values))
    names = ", ".join(literal(c) for c in columns)
    return (
        df.selectExpr(f"inline(array({pairs}))")
        .where("word IS NOT NULL")
        .groupBy("i", "word")
        .agg(F.bit_or("bit").alias("bits"))
        .groupBy("i")
        .agg(F.sum(F.bit_count("bits")).alias("ndv"))
        .selectExpr(f"{literal(table)} AS table_name", f"array({names})[i] AS column_name", "CAST(ndv AS BIGINT) AS ndv")
    )


def column_profile(source: Source) -> DataFrame:
    """Column statistics with exact distinct counts and a uniqueness flag."""
    exact = distinct_counts(source.tables)
    stats = column_stats(source.tables, distinct=False).drop("approx_ndv")
    return stats.join(exact, ["table_name", "column_name"], "left").selectExpr(
        "* EXCEPT (ndv)",
        "coalesce(ndv, 0) AS ndv",
        "coalesce(ndv, 0) = row_count AND row_count > 0 AS is_unique",
    )


# -- keys -------------------------------------------------------------------------------------


# A candidate is first tried on one part in sixteen of its values. Rows with equal keys fall into
# the same part, so a duplicate there settles the matter; a key is only accepted on all rows.
_REFUTE_PARTS = 16


def _has_duplicates(df: DataFrame, key: Sequence[str]) -> bool:
    return not df.groupBy(*[_q(c) for c in key]).agg(F.expr("count(1) AS n")).where("n > 1").isEmpty()


def _unique(df: DataFrame, key: Sequence[str]) -> bool:
    part = df.where(f"pmod(xxhash64({quoted(key[0])}), {_REFUTE_PARTS}) = 0")
    return not _has_duplicates(part, key) and not _has_duplicates(df, key)


# Sets of one size that are sketched at most, and sketches of one pass.
_MOST_CANDIDATES, _SKETCHES = 2000, 200


def discover_primary_key(df: DataFrame, *, max_arity: int | None = None) -> tuple[str, ...]:
    """Smallest set of columns without nulls that is unique, first in column order; else ``()``.

    Distinct counts are estimated by sketches, the candidates of one size together and without a
    shuffle. A set is passed over only if what is known bounds its distinct count below the row
    count: the product of its columns' counts, or of two parts that were sketched. Candidates whose
    estimate comes close to the row count are tested exactly, in order, until one holds. Where a
    size has very many candidates, columns are taken away from the whole set for as long as it stays
    unique instead; that key can't be made smaller, but need not be the smallest.
    """
    usable = [f.name for f in df.schema.fields if isinstance(f.dataType, _KEY_TYPES)]
    if not usable:
        return ()
    head = df.selectExpr(
        "count(1)", *[f"count({quoted(c)})" for c in usable], *[_approx_distinct([c]) for c in usable]
    ).first()
    rows, k = head[0], len(usable)
    if rows == 0:
        return ()
    complete = [c for c, n in zip(usable, head[1 : k + 1]) if n == rows]
    estimates = {(c,): e for c, e in zip(usable, head[k + 1 :]) if c in complete}
    if complete and not any(e >= _MARGIN * rows for e in estimates.values()):
        if df.selectExpr(_approx_distinct(complete)).first()[0] < _MARGIN * rows:
            return ()
    for arity in range(1, min(max_arity or len(complete), len(complete)) + 1):
        if arity > 1:
            candidates = [c for c in combinations(complete, arity) if _could_be_unique(c, estimates, rows)]
            if len(candidates) > _MOST_CANDIDATES:
                return _shrunk(df, complete)
            for i in range(0, len(candidates), _SKETCHES):
                some = candidates[i : i + _SKETCHES]
                estimates.update(zip(some, df.selectExpr(*[_approx_distinct(c) for c in some]).first()))
        for candidate in combinations(complete, arity):
            if estimates.get(candidate, 0) >= _MARGIN * rows and _unique(df, candidate):
                return candidate
    return ()


def _could_be_unique(candidate: tuple[str, ...], estimates: Mapping[tuple[str, ...], int], rows: int) -> bool:
    """Whether the value combinations suffice: distinct(A and B) is at most distinct(A) * distinct(B)."""
    bound = 1.0
    for c in candidate:
        bound *= max(1, estimates[(c,)])
    for c in candidate:
        rest = tuple(x for x in candidate if x != c)
        bound = min(bound, estimates[(c,)] * estimates.get(rest, float("inf")))
    return bound >= rows * _MARGIN**2


def _shrunk(df: DataFrame, columns: Sequence[str]) -> tuple[str, ...]:
    """The columns without those, from the last, that uniqueness does not need; ``()`` if all together repeat."""
    key = tuple(columns)
    if not _unique(df, key):
        return ()
    for c in reversed(columns):
        rest = tuple(x for x in key if x != c)
        if rest and _unique(df, rest):
            key = rest
    return key


def discover_primary_keys(source: Source, *, max_arity: int | None = None, parallel: int = 4) -> dict[str, tuple[str, ...]]:
    """Key per table; a declared key wins over a discovered one.

    Tables are independent, so the jobs of ``parallel`` of them overlap.
    """

    @inheritable_thread_target(source.spark)
    def find(table: str) -> tuple[str, ...]:
        return source.primary_key(table) or discover_primary_key(source[table], max_arity=max_arity)

    with ThreadPoolExecutor(parallel) as pool:
        return dict(zip(source.tables, pool.map(find, source.tables)))


def primary_key_table(source: Source, keys: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """``(table_name, key_columns, arity, row_count)``; tables without a key have arity 0."""
    found = local_frame(
        source.spark,
        [("table_name", pa.string()), ("key_columns", pa.string()), ("arity", pa.int64())],
        [(t, ",".join(k) or None, len(k)) for t, k in keys.items()],
    )
    return found.join(source.row_counts(), "table_name")


def _confirmed_unique(source: Source, candidates: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """The candidates that exact counts confirm; only their columns are shuffled."""
    wanted: dict[str, list[str]] = {}
    for r in candidates.select("table_name", "column_name").collect():
        if r.column_name in columns[r.table_name]:
            wanted.setdefault(r.table_name, []).append(r.column_name)
    if not wanted:
        return candidates.limit(0).selectExpr("table_name", "column_name", "0L AS ndv")
    rows = candidates.select("table_name", "column_name", "row_count")
    return distinct_counts(source.tables, wanted).join(rows, ["table_name", "column_name"]).where("ndv = row_count").drop("row_count")


def unique_columns(source: Source) -> DataFrame:
    """Columns without nulls and duplicates that are not the primary key.

    One sketch pass per table without a shuffle names the candidates.
    """
    columns = {
        t: [f.name for f in df.schema.fields if isinstance(f.dataType, _KEY_TYPES) and (f.name,) != source.primary_key(t)]
        for t, df in source.tables.items()
    }
    stats = column_stats({t: source[t].select(*map(_q, c)) for t, c in columns.items() if c})
    candidates = stats.where(f"null_count = 0 AND row_count > 0 AND approx_ndv >= {_MARGIN} * row_count")
    return _confirmed_unique(source, candidates, columns)


def auto_increment_columns(source: Source) -> DataFrame:
    """Integer columns, unique and without gaps: ``max - min + 1 = count``.

    The range test needs one pass without a shuffle; uniqueness is counted only where it holds.
    """
    columns = {
        t: [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
        for t, df in source.tables.items()
    }
    ranges = materialize(
        column_stats({t: source[t].select(*map(_q, c)) for t, c in columns.items() if c}, distinct=False)
        .where("null_count = 0 AND CAST(max_value AS DECIMAL(38, 0)) - CAST(min_value AS DECIMAL(38, 0)) + 1 = row_count")
    )
    return ranges.join(_confirmed_unique(source, ranges, columns), ["table_name", "column_name"]).selectExpr(
        "table_name", "column_name", "CAST(min_value AS BIGINT) AS first_value", "CAST(max_value AS BIGINT) AS last_value"
    )


# -- foreign keys -----------------------------------------------------------------------------


def fk_profile(source: Source, fks: Sequence[ForeignKey] | None = None) -> DataFrame:
    """Evidence behind each foreign key, one row per key.

    Child rows, nulls, rows without a parent, fan-out in both directions and participation. A table is
    read once for all its foreign keys and all keys that refer to it, and one shuffle brings the values
    of both sides together. They are counted before it, so a hub parent costs one row per task.
    """
    fks = list(source.foreign_keys if fks is None else fks)
    if not fks:
        return local_frame(source.spark, [(c, pa.string()) for c in _FK_NAMES] + [(c, pa.int64()) for c in _FK_COUNTS], [])
    together = [fk for fk in fks if all(_equal_as_text(source, fk, c, r) for c, r in zip(fk.columns, fk.ref_columns))]
    frames = [_one_fk(source, fk) for fk in fks if fk not in together]
    return union_all([*frames, _many_fks(source, together)] if together else frames)


def _equal_as_text(source: Source, fk: ForeignKey, column: str, ref_column: str) -> bool:
    kinds = [value_kind(source[t].schema[c].dataType) for t, c in ((fk.table, column), (fk.ref_table, ref_column))]
    return kinds[0] is not None and kinds[0] == kinds[1]


def _many_fks(source: Source, fks: list[ForeignKey]) -> DataFrame:
    by_table: dict[str, list[str]] = {}
    for i, fk in enumerate(fks):
        by_table.setdefault(fk.table, []).append(f"struct({i} AS i, {value_text(source, (fk.table, fk.columns))} AS k, 1L AS c, 0L AS p)")
        by_table.setdefault(fk.ref_table, []).append(f"struct({i} AS i, {value_text(source, (fk.ref_table, fk.ref_columns))} AS k, 0L AS c, 1L AS p)")
    values = union_all(source[t].selectExpr(f"inline(array({', '.join(rows)}))") for t, rows in by_table.items())
    counts = values.groupBy("i", "k").agg(F.sum("c").alias("n_child"), F.sum("p").alias("n_parent"))
    known = "k IS NOT NULL"
    facts = counts.groupBy("i").agg(
        F.expr("sum(n_child)").alias("child_rows"),
        F.expr(f"sum(n_child) FILTER (WHERE {known})").alias("non_null_rows"),
        F.expr("sum(n_child) FILTER (WHERE k IS NULL)").alias("null_rows"),
        F.expr(f"sum(n_child) FILTER (WHERE {known} AND n_parent = 0)").alias("orphan_rows"),
        F.expr(f"count_if({known} AND n_parent = 0)").alias("orphan_values"),
        F.expr(f"count_if({known} AND n_child > 0)").alias("distinct_values"),
        F.expr(f"max(n_child) FILTER (WHERE {known})").alias("max_children"),
        F.expr("sum(n_parent)").alias("parent_rows"),
        F.expr(f"sum(n_parent) FILTER (WHERE {known} AND n_child > 0)").alias("parents_with_child"),
        F.expr("max(n_parent)").alias("max_parents"),
    )
    names = local_frame(
        source.spark, [("i", pa.int32()), *[(c, pa.string()) for c in _FK_NAMES]], [(i, fk.name, fk.table, ",".join(fk.columns), fk.ref_table) for i, fk in enumerate(fks)]
    )
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in _FK_COUNTS]
    return names.join(facts, "i", "left").select(*_FK_NAMES, *zeros)


_FK_NAMES = ("fk_name", "table_name", "column_name", "ref_table")
_FK_COUNTS = (
    "child_rows", "non_null_rows", "null_rows", "orphan_rows", "orphan_values", "distinct_values",
    "max_children", "parent_rows", "parents_with_child", "max_parents",
)


def _one_fk(source: Source, fk: ForeignKey) -> DataFrame:
    child = source[fk.table].groupBy(F.expr(fk_value(fk.columns)).alias("k")).agg(F.expr("count(1) AS n_child"))
    parent = source[fk.ref_table].groupBy(F.expr(fk_value(fk.ref_columns)).alias("k")).agg(F.expr("count(1) AS n_parent"))
    return child.join(parent, "k", "full_outer").selectExpr(
        f"{literal(fk.name)} AS fk_name",
        f"{literal(fk.table)} AS table_name",
        f"{literal(','.join(fk.columns))} AS column_name",
        f"{literal(fk.ref_table)} AS ref_table",
        "coalesce(sum(n_child), 0) AS child_rows",
        "coalesce(sum(n_child) FILTER (WHERE k IS NOT NULL), 0) AS non_null_rows",
        "coalesce(sum(n_child) FILTER (WHERE k IS NULL), 0) AS null_rows",
        "coalesce(sum(n_child) FILTER (WHERE k IS NOT NULL AND n_parent IS NULL), 0) AS orphan_rows",
        "count(n_child) FILTER (WHERE k IS NOT NULL AND n_parent IS NULL) AS orphan_values",
        "count(n_child) FILTER (WHERE k IS NOT NULL) AS distinct_values",
        "coalesce(max(n_child) FILTER (WHERE k IS NOT NULL), 0) AS max_children",
        "coalesce(sum(n_parent), 0) AS parent_rows",
        "coalesce(sum(n_parent) FILTER (WHERE n_child IS NOT NULL), 0) AS parents_with_child",
        "coalesce(max(n_parent), 0) AS max_parents",
    )


def orphan_values(source: Source, fk: ForeignKey) -> DataFrame:
    """``(k, n)``: foreign-key values without a parent and their rows.

    Values are counted first, so the anti join sees each value once however often it occurs.
    """
    values = source[fk.table].select(F.expr(fk_value(fk.columns)).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.expr("count(1) AS n"))
    return values.join(source[fk.ref_table].select(F.expr(fk_value(fk.ref_columns)).alias("k")), "k", "left_anti")


def materialize(df: DataFrame) -> DataFrame:
    """A catalog-sized result (one row per column, key or foreign key) as a local relation.

    Its size is set by the schema, not by the data, so the driver may hold it and later plans
    may use it without running the profile again.
    """
    return df.sparkSession.createDataFrame(df.toArrow())

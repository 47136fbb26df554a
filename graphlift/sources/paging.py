"""Ordered reading of a table: batches, single pages, key ranges.

Batches need every row's global position. No global sort with an unpartitioned window is used:
rows are put into ranges of the key, the ranges are counted (map-side combined), a running total
over the ranges gives each range its offset, and rows are numbered inside their range only.

Up to some hundred ranges come from literal split points of a sample of fixed size. For more, Spark deals
the rows out by ranges of the key, as many as the rows need; each part is sorted and its rows are numbered
where they lie. No task and no row holds the keys of others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import quoted
from .scratch import scratch_table

_SAMPLES_PER_RANGE = 64
#: Ranges that are told apart by literal split points. Above that rows are dealt out in at least so many parts, of so many rows.
_COARSE_RANGES = 256
_PART_ROWS = 1_000_000


def _q(name: str) -> Column:
    return F.col(quoted(name))


def _integer_range(df: DataFrame, key: str, rows_per_range: int) -> Column | None:
    """Range number by arithmetic, for integer keys dense enough to keep the ranges few.

    Keys are unique, so a range of that width cannot hold more than ``2 * rows_per_range`` rows.
    """
    lo, hi, n = df.agg(F.min(_q(key)), F.max(_q(key)), F.count(F.lit(1))).first()
    if lo is None or (hi - lo) > 16 * n + 1000 * rows_per_range:
        return None
    return F.expr(f"{quoted(key)} div {rows_per_range}")


def _split(key: Column, bounds: list, lo: int, hi: int) -> Column:
    """Balanced tree of comparisons, so a row needs log2(ranges) of them."""
    if lo == hi:
        return F.lit(lo).cast("bigint")
    mid = (lo + hi) // 2
    return F.when(key < bounds[mid], _split(key, bounds, lo, mid)).otherwise(_split(key, bounds, mid + 1, hi))


def _point(df: DataFrame, key: Sequence[str]) -> Column:
    return F.struct(*[_q(c).alias(f"k{i}") for i, c in enumerate(key)])


def _coarse_range(df: DataFrame, key: Sequence[str], ranges: int, n: int) -> Column:
    """Range number from split points of a sample of the keys, whose size is set by the number of ranges."""
    if ranges <= 1:
        return F.lit(0).cast("bigint")
    sample = df.select(*map(_q, key)).sample(min(1.0, 1.2 * ranges * _SAMPLES_PER_RANGE / n), seed=7)
    rows = sorted(tuple(r) for r in sample.collect() if None not in tuple(r))
    cuts = sorted({rows[i * len(rows) // ranges] for i in range(1, ranges)}) if rows else []
    types = [df.schema[c].dataType for c in key]
    bounds = [F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(cut, types))]) for cut in cuts]
    return _split(_point(df, key), bounds, 0, len(bounds))


def _with_range(df: DataFrame, key: Sequence[str], rows_per_range: int) -> DataFrame:
    """``df`` plus ``_range``, ascending with the key; about ``rows_per_range`` rows each, however many that makes."""
    n = df.count()
    ranges = max(1, -(-n // rows_per_range))
    coarse = min(ranges, _COARSE_RANGES)
    ranged = df.withColumn("_range", _coarse_range(df, key, coarse, n))
    if ranges == coarse:
        return ranged
    # Too many for literal split points: Spark deals the rows out by their key and sorts each part, where a row's place is
    # known as soon as it stands. Written once, since the parts depend on a sample that is drawn anew for every plan.
    parts = max(coarse, -(-n // _PART_ROWS))
    # A row is numbered within its task from 0, below the 33 bits that hold the task.
    place = F.monotonically_increasing_id()
    placed = scratch_table(df.repartitionByRange(parts, *map(_q, key)).sortWithinPartitions(*map(_q, key)).withColumn("_place", place))
    placed = placed.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1))
    return placed.withColumn("_range", F.shiftleft("_part", 33) + F.expr(f"_place div {rows_per_range}"))


def with_row_number(df: DataFrame, key: Sequence[str], *, rows_per_range: int = 1_000_000) -> DataFrame:
    """``df`` plus ``row_number``, the 0-based position in key order. ``key`` must be unique."""
    single_integer = len(key) == 1 and isinstance(df.schema[key[0]].dataType, T.IntegralType)
    part = _integer_range(df, key[0], rows_per_range) if single_integer else None
    ranged = _with_range(df, key, rows_per_range) if part is None else df.withColumn("_range", part)
    placed = "_place" in set(ranged.columns) - set(df.columns)
    unit = "_part" if placed else "_range"
    # One row per range, or per part where there are many ranges.
    offsets = (
        ranged.groupBy(unit)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col(unit).alias("_at"), (F.sum("_n").over(Window.orderBy(unit)) - F.col("_n")).alias("_offset"))
    )
    if placed:
        numbered = ranged.join(F.broadcast(offsets), ranged["_part"] == offsets["_at"])
        return numbered.withColumn("row_number", F.col("_offset") + F.col("_place")).drop("_range", "_part", "_place", "_at", "_offset")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*map(_q, key))) - 1
    return (
        ranged.withColumn("_inside", inside)
        .join(offsets, ranged["_range"].eqNullSafe(offsets["_at"]))
        .withColumn("row_number", F.col("_offset") + F.col("_inside"))
        .drop("_range", "_at", "_offset", "_inside")
    )


def batches(df: DataFrame, key: Sequence[str], batch_size: int = 1000, **options) -> DataFrame:
    """``df`` plus ``batch_id``: batch *n* holds rows ``n * size`` to ``(n + 1) * size - 1`` in key order."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    numbered = with_row_number(df, key, **options)
    return numbered.withColumn("batch_id", F.expr(f"row_number div {int(batch_size)}")).drop("row_number")


def page(
    df: DataFrame, key: Sequence[str], offset: int = 0, limit: int = 1000, *, top_rows: int = 100_000, **options
) -> DataFrame:
    """One page in key order.

    A page near the start is a top-k. A deep one is cut out by row number, so the rows before it
    are never sorted into one task.
    """
    if offset + limit <= top_rows:
        return df.orderBy(*map(_q, key)).offset(offset).limit(limit)
    numbered = with_row_number(df, key, **options)
    return numbered.where(F.col("row_number").between(offset, offset + limit - 1)).drop("row_number").orderBy(*map(_q, key))


def key_range(df: DataFrame, key: Sequence[str], start, end) -> DataFrame:
    """Rows with ``start <= key < end``, in key order; the filter reaches the scan."""
    if len(key) != 1:
        raise ValueError("a key range needs a single-column primary key")
    c = _q(key[0])
    return df.where((c >= F.lit(start)) & (c < F.lit(end))).orderBy(c)

"""Inclusion dependencies: which columns, or sets of columns, hold only values of others.

All pairs are decided by one shuffle. Every value meets once and learns the set of columns that hold
it, as a bitmap; a column's bitmaps intersected over its values leave the columns that include it. So a
table is read once for all its columns, a self reference is a pair like any other, and a value that
fills a third of a column is one row per task.

Before that, one pass without a shuffle takes the range and a theta sketch of every column. A sketch
keeps a column's smallest hashes; one that the other column ought to have among its own, but has not,
refutes the pair for certain. Only columns of pairs that are left are read again. No true pair is lost.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import name_stem
from ..functions.values import literal, quoted
from ..sources.source import ForeignKey, Source, local_frame, union_all

#: Hashes kept per column are 2 to this power, 8 bytes each.
SKETCH_SIZE = 10
#: Columns per word of a bitmap.
_WORD = 63

_KINDS = (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)

Columns = tuple[str, tuple[str, ...]]


def value_kind(data_type: T.DataType) -> str | None:
    """Columns of one kind can hold each other's values; None: not compared."""
    if not isinstance(data_type, _KINDS):
        return None
    return "integer" if isinstance(data_type, T.IntegralType) else data_type.simpleString()


def _kind_of(source: Source, columns: Columns) -> str | None:
    kinds = [value_kind(source[columns[0]].schema[c].dataType) for c in columns[1]]
    return None if None in kinds else ",".join(kinds)


def _text(data_type: T.DataType, name: str) -> str:
    """A value as text that no other value of its kind has; a long one by its digest."""
    text = f"CAST({quoted(name)} AS STRING)"
    return f"CASE WHEN length({text}) > 64 THEN concat('#', sha2({text}, 256)) ELSE {text} END" if isinstance(data_type, T.StringType) else text


def value_text(source: Source, columns: Columns) -> str:
    """One text per value of a column or tuple; null where a part is null."""
    schema = source[columns[0]].schema
    parts = [_text(schema[c].dataType, c) for c in columns[1]]
    if len(parts) == 1:
        return parts[0]
    return "concat(" + ", ".join(f"length({p}), ':', {p}" for p in parts) + ")"  # null as soon as one is


# -- what can be ruled out --------------------------------------------------------------------


def _sketches(source: Source, attributes: Sequence[Columns]) -> DataFrame:
    """``(i, kind, n, low, high, low_text, high_text, sketch)``, one row per attribute, one pass per table."""
    by_table: dict[str, list[int]] = {}
    for i, (t, _) in enumerate(attributes):
        by_table.setdefault(t, []).append(i)
    frames = []
    for t, numbers in by_table.items():
        schema, aggs, rows = source[t].schema, [], []
        for i in numbers:
            value = value_text(source, attributes[i])
            aggs += [f"count({value}) AS n{i}", f"theta_sketch_agg(xxhash64({value}), {SKETCH_SIZE}) FILTER (WHERE {value} IS NOT NULL) AS s{i}"]
            low = high = low_text = high_text = "NULL"
            if len(attributes[i][1]) == 1:
                c = attributes[i][1][0]
                kind = schema[c].dataType
                x = f"CAST({quoted(c)} AS BIGINT)" if isinstance(kind, T.IntegralType) else f"CAST(unix_date({quoted(c)}) AS BIGINT)"
                if isinstance(kind, (T.IntegralType, T.DateType)):
                    aggs += [f"min({x}) AS lo{i}", f"max({x}) AS hi{i}"]
                    low, high = f"lo{i}", f"hi{i}"
                elif isinstance(kind, T.StringType):  # beginnings keep the order of the whole texts
                    aggs += [f"min(substring({quoted(c)}, 1, 32)) AS lo{i}", f"max(substring({quoted(c)}, 1, 32)) AS hi{i}"]
                    low_text, high_text = f"lo{i}", f"hi{i}"
            rows.append(
                f"struct({i} AS i, {literal(_kind_of(source, attributes[i]))} AS kind, n{i} AS n, CAST({low} AS BIGINT) AS low, CAST({high} AS BIGINT) AS high, "
                f"CAST({low_text} AS STRING) AS low_text, CAST({high_text} AS STRING) AS high_text, s{i} AS sketch)"
            )
        frames.append(source[t].selectExpr(*aggs).selectExpr(f"inline(array({', '.join(rows)}))"))
    return union_all(frames)


def _possible(source: Source, attributes: Sequence[Columns]) -> set[tuple[int, int]]:
    """Pairs (a, b) of attributes whose ranges and sketches leave room for all values of a in b."""
    stats = _sketches(source, attributes).where("n > 0")
    stats = source.spark.createDataFrame(stats.toArrow())  # a row per attribute
    pairs = stats.alias("a").join(stats.alias("b"), F.expr("a.kind = b.kind AND a.i <> b.i")).where(
        """(a.low IS NULL OR a.low >= b.low AND a.high <= b.high) AND (a.low_text IS NULL OR a.low_text >= b.low_text AND a.high_text <= b.high_text)
        AND theta_sketch_estimate(theta_difference(a.sketch, b.sketch)) = 0"""
    )
    return {(r.a, r.b) for r in pairs.selectExpr("a.i AS a", "b.i AS b").collect()}


# -- the one shuffle --------------------------------------------------------------------------


def _included(source: Source, attributes: Sequence[Columns]) -> tuple[list[int], set[tuple[int, int]]]:
    """Distinct values per attribute, and all pairs (a, b) with every value of a in b."""
    words = range((len(attributes) + _WORD - 1) // _WORD)
    by_table: dict[str, list[str]] = {}
    for i, a in enumerate(attributes):
        by_table.setdefault(a[0], []).append(f"struct({literal(_kind_of(source, a))} AS kind, {value_text(source, a)} AS value, {i} AS i)")
    held = union_all(source[t].selectExpr(f"inline(array({', '.join(rows)}))") for t, rows in by_table.items()).where("value IS NOT NULL")
    bits = [f"CASE WHEN i DIV {_WORD} = {w} THEN shiftleft(1L, i % {_WORD}) ELSE 0L END AS w{w}" for w in words]
    sets = (
        held.selectExpr("kind", "value", *bits)
        .groupBy("kind", "value")
        .agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in words])
        .groupBy(*[f"w{w}" for w in words])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    members = ", ".join(f"filter(sequence({w * _WORD}, {min((w + 1) * _WORD, len(attributes)) - 1}), i -> getbit(w{w}, i % {_WORD}) = 1)" for w in words)
    rows = (
        sets.selectExpr("*", f"explode(concat({members})) AS i")
        .groupBy("i")
        .agg(F.sum("n").alias("n"), *[F.bit_and(f"w{w}").alias(f"w{w}") for w in words])
        .collect()  # a row per attribute
    )
    values, pairs = [0] * len(attributes), set()
    for r in rows:
        values[r.i] = r.n
        pairs |= {(r.i, b) for b in range(len(attributes)) if b != r.i and r[f"w{b // _WORD}"] >> (b % _WORD) & 1}
    return values, pairs


def _decided(source: Source, attributes: Sequence[Columns], wanted: set[tuple[int, int]] | None) -> tuple[dict[int, int], set[tuple[int, int]]]:
    """The wanted pairs that hold (None: any), with the distinct values of their attributes."""
    if len(attributes) < 2:
        return {}, set()
    possible = _possible(source, attributes)
    if wanted is not None:
        possible &= wanted
    used = sorted({x for p in possible for x in p})
    if not used:
        return {}, set()
    values, pairs = _included(source, [attributes[i] for i in used])
    held = {(used[a], used[b]) for a, b in pairs}
    return {used[i]: n for i, n in enumerate(values)}, held if wanted is None else held & wanted


# -- columns ----------------------------------------------------------------------------------


def _stems(source: Source) -> dict[tuple[str, str], str]:
    rows = source.cat_columns().selectExpr("table_name", "column_name", f"{name_stem('column_name')} AS stem").collect()
    return {(r.table_name, r.column_name): r.stem for r in rows}


def shares_name(stems: Mapping[tuple[str, str], str], child: tuple[str, str], parent: tuple[str, str]) -> bool:
    """Whether a column's name says which column it refers to: ``o_custkey`` -> ``c_custkey``, ``user_id`` -> ``users.id``.

    A bare ``id`` says nothing, so the child has to name the table.
    """
    table, stem = parent[0].lower(), stems[parent]
    names = {stem} if stem != "id" else {f"{table}_id", f"{table.removesuffix('s')}_id"}
    return stems[child] in names or child[1].lower() in names


_FIELDS = [
    ("table_name", pa.string()), ("column_name", pa.string()), ("ref_table", pa.string()), ("ref_column", pa.string()),
    ("distinct_values", pa.int64()), ("ref_values", pa.int64()), ("shares_name", pa.bool_()), ("is_unique", pa.bool_()),
]


def inclusion_dependencies(source: Source, *, to_keys: bool = False, named: bool = False) -> DataFrame:
    """``(table_name, column_name, ref_table, ref_column, distinct_values, ref_values, shares_name, is_unique)``.

    Every pair of columns of one kind (integers; equal text, date, time or decimal types) such that all
    values of the first, of which there is at least one, occur in the second; nulls are no values.
    ``is_unique`` says that no value repeats in the second column and none is null, so that the pair can
    be a foreign key. ``to_keys`` looks at pairs whose second column is a primary key only, ``named`` at
    pairs whose names agree only. What the driver holds is a row per column or pair that holds.
    """
    attributes = [
        (t, (f.name,)) for t, df in source.tables.items() for f in df.schema.fields if value_kind(f.dataType) is not None
    ]
    stems = _stems(source)
    wanted = None
    if to_keys or named:
        wanted = {
            (i, j)
            for j, (rt, rc) in enumerate(attributes)
            if not to_keys or source.primary_key(rt) == rc
            for i, (t, c) in enumerate(attributes)
            if i != j and _kind_of(source, attributes[i]) == _kind_of(source, attributes[j])
            and (not named or shares_name(stems, (t, c[0]), (rt, rc[0])))
        }
        used = sorted({x for p in wanted for x in p})
        at = {x: k for k, x in enumerate(used)}
        attributes, wanted = [attributes[x] for x in used], {(at[a], at[b]) for a, b in wanted}
    values, pairs = _decided(source, attributes, wanted)
    rows = {r.table_name: r.row_count for r in source.only({attributes[b][0] for _, b in pairs}).row_counts().collect()} if pairs else {}
    out = []
    for a, b in sorted(pairs):
        (t, (c,)), (rt, (rc,)) = attributes[a], attributes[b]
        out.append((t, c, rt, rc, values[a], values[b], shares_name(stems, (t, c), (rt, rc)), values[b] == rows[rt]))
    return local_frame(source.spark, _FIELDS, out)


def discover_foreign_keys(source: Source, *, need_name: bool = True) -> list[ForeignKey]:
    """Foreign keys to single-column primary keys: every value is contained, and the name says so.

    Dense numbers are contained in each other by chance, hence the name; ``need_name=False`` takes every
    inclusion in a key, self references too, and leaves the choice to the caller. Keys that two others
    imply are left out.
    """
    rows = inclusion_dependencies(source, to_keys=True, named=need_name).collect()
    order = {t: i for i, t in enumerate(source.tables)}
    rows.sort(key=lambda r: (order[r.ref_table], order[r.table_name], source[r.table_name].columns.index(r.column_name)))
    return direct_only([ForeignKey(f"{r.table_name}_{r.column_name}_{r.ref_table}", r.table_name, r.column_name, r.ref_table, r.ref_column) for r in rows])


def direct_only(fks: list[ForeignKey]) -> list[ForeignKey]:
    """Without the keys that two others imply: a -> c goes if a -> b and b -> c hold on the same columns."""
    kept = {(fk.table, fk.column, fk.ref_table, fk.ref_column): fk for fk in fks}
    for a in fks:
        for b in fks:
            first = (a.table, a.column, b.table, b.column)
            second = (b.table, b.column, a.ref_table, a.ref_column)
            if len({a.table, b.table, a.ref_table}) == 3 and first in kept and second in kept:
                kept.pop((a.table, a.column, a.ref_table, a.ref_column), None)
    return list(kept.values())


# -- sets of columns --------------------------------------------------------------------------


def _keys_of(source: Source) -> list[Columns]:
    """Declared keys of several columns: primary ones first."""
    keys = [(t, k) for t, k in source.primary_keys.items() if t in source.tables and len(k) > 1]
    keys += [(t, tuple(k)) for t, many in source.unique_keys.items() if t in source.tables for k in many if len(k) > 1]
    return list(dict.fromkeys(keys))


def composite_inclusions(source: Source, *, need_name: bool = False) -> list[tuple[Columns, Columns]]:
    """``((table, columns), (ref_table, key columns))``: tuples of columns contained in a key of several columns.

    Level by level: the key's columns one by one, then its first two, first three and so on. A tuple is
    tried only if every column is contained in its counterpart and the tuple without the last column
    was contained as well. All tuples of a level, of all tables and keys, are decided by one shuffle.
    Rows with a null in any of the columns refer to nothing. ``need_name`` wants every column's name to
    agree with its counterpart's.
    """
    keys = _keys_of(source)
    stems = _stems(source)
    single = [(t, (f.name,)) for t, df in source.tables.items() for f in df.schema.fields if value_kind(f.dataType) is not None]
    at = {x: i for i, x in enumerate(single)}
    targets = {at[t, (c,)] for t, k in keys for c in k if (t, (c,)) in at}
    wanted = {
        (i, j) for j in targets for i in range(len(single)) if i != j and _kind_of(source, single[i]) == _kind_of(source, single[j])
        and (not need_name or shares_name(stems, (single[i][0], single[i][1][0]), (single[j][0], single[j][1][0])))
    }
    used = sorted({x for p in wanted for x in p})
    renamed = {x: k for k, x in enumerate(used)}
    _, held = _decided(source, [single[x] for x in used], {(renamed[a], renamed[b]) for a, b in wanted})
    parts: dict[tuple[str, str, str], list[str]] = {}  # (table, ref table, ref column) -> columns contained in it
    for a, b in held:
        (t, (c,)), (rt, (rc,)) = single[used[a]], single[used[b]]
        parts.setdefault((t, rt, rc), []).append(c)
    for t, k in keys:  # a column includes itself, which matters for tuples that refer to their own table
        for c in k:
            parts.setdefault((t, t, c), []).append(c)
    order = {t: {c: i for i, c in enumerate(df.columns)} for t, df in source.tables.items()}
    grown: dict[tuple[Columns, str], list[tuple[str, ...]]] = {
        (key, t): [(c,) for c in sorted(parts.get((t, key[0], key[1][0]), []), key=order[t].get)] for key in keys for t in source.tables
    }
    found: list[tuple[Columns, Columns]] = []
    for level in range(2, max((len(k) for _, k in keys), default=1) + 1):
        pairs: list[tuple[Columns, Columns]] = []
        for (key, t), begun in grown.items():
            rt, columns = key
            if len(columns) < level:
                continue
            for x in begun:
                for c in sorted(parts.get((t, rt, columns[level - 1]), []), key=order[t].get):
                    if c not in x and (t, (*x, c)) != (rt, columns[:level]):
                        pairs.append(((t, (*x, c)), (rt, columns[:level])))
                if t == rt and x == columns[: level - 1]:  # the key's own columns, as far as they go, lead to other tuples
                    pairs.append(((t, columns[:level]), (rt, columns[:level])))
        tuples = list(dict.fromkeys(x for p in pairs for x in p))
        number = {x: i for i, x in enumerate(tuples)}
        _, held = _decided(source, tuples, {(number[a], number[b]) for a, b in pairs if a != b})
        good = {(a, b) for a, b in pairs if a == b or (number[a], number[b]) in held}
        for (key, t), begun in grown.items():
            if len(key[1]) >= level:
                begun[:] = [a[1] for a, b in pairs if (a, b) in good and a[0] == t and b == (key[0], key[1][:level])]
                begun[:] = list(dict.fromkeys(begun))
        found += [(a, b) for a, b in dict.fromkeys(pairs) if (a, b) in good and a != b and b in keys]
    return found


def discover_composite_foreign_keys(source: Source, *, need_name: bool = True) -> list[ForeignKey]:
    """Foreign keys of several columns to the declared keys of several columns, as ``composite_inclusions`` finds them."""
    found = composite_inclusions(source, need_name=need_name)
    return [ForeignKey(f"{t}_{'_'.join(c)}_{rt}", t, c, rt, rc) for (t, c), (rt, rc) in found]


"""A relational source: tables as DataFrames plus what is declared about them.

The catalog methods give the declarations as small DataFrames. They are local relations of
known size, so Spark itself broadcasts them and constant-folds projections over them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import literal

_TEXTS = pa.list_(pa.string())


@dataclass(frozen=True)
class ForeignKey:
    """Foreign key ``table.column -> ref_table.ref_column``; tuples of names where it has several columns.

    A row refers to a parent only if all its columns are there. The columns referred to need not be
    the parent's primary key.
    """

    name: str
    table: str
    column: str | tuple[str, ...]
    ref_table: str
    ref_column: str | tuple[str, ...]
    on_delete: str | None = None
    on_update: str | None = None

    def __post_init__(self):
        if len(self.columns) != len(self.ref_columns):
            raise ValueError(f"foreign key {self.name}: {self.columns} and {self.ref_columns} differ in length")

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,) if isinstance(self.column, str) else tuple(self.column)

    @property
    def ref_columns(self) -> tuple[str, ...]:
        return (self.ref_column,) if isinstance(self.ref_column, str) else tuple(self.ref_column)


def local_frame(spark: SparkSession, fields: Sequence[tuple[str, pa.DataType]], rows: Iterable[tuple]) -> DataFrame:
    """Small DataFrame of driver-side metadata, one tuple per row."""
    columns = list(zip(*rows)) or [()] * len(fields)
    arrays = [pa.array(list(c), type=t) for c, (_, t) in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, schema=pa.schema(fields)))


@dataclass(frozen=True)
class Source:
    """Tables, keys and foreign keys of one relational database.

    ``not_null`` holds declared NOT NULL columns per table; a field that is not nullable in the
    DataFrame schema counts too. ``sql_types`` overrides the type name of a column, which is how
    JSON text is told from plain text.
    """

    spark: SparkSession
    tables: Mapping[str, DataFrame]
    primary_keys: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()
    unique_keys: Mapping[str, tuple[tuple[str, ...], ...]] = field(default_factory=dict)
    not_null: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    sql_types: Mapping[tuple[str, str], str] = field(default_factory=dict)
    name: str = "source"

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]

    def primary_key(self, table: str) -> tuple[str, ...]:
        return tuple(self.primary_keys.get(table, ()))

    def fks_of(self, table: str) -> list[ForeignKey]:
        return [fk for fk in self.foreign_keys if fk.table == table]

    def sql_type(self, table: str, column: str) -> str:
        return self.sql_types.get((table, column)) or self.tables[table].schema[column].dataType.simpleString()

    def is_json(self, table: str, column: str) -> bool:
        return "json" in self.sql_types.get((table, column), "").lower()

    def is_not_null(self, table: str, column: str) -> bool:
        return column in self.not_null.get(table, ()) or not self.tables[table].schema[column].nullable

    def only(self, names: Iterable[str]) -> Source:
        """The source restricted to the named tables; foreign keys need both ends."""
        keep = [n for n in names if n in self.tables]
        return replace(
            self,
            tables={n: self.tables[n] for n in keep},
            foreign_keys=tuple(fk for fk in self.foreign_keys if fk.table in keep and fk.ref_table in keep),
        )

    def with_tables(self, **tables: DataFrame) -> Source:
        """The source with some tables replaced or added."""
        return replace(self, tables={**self.tables, **tables})

    # -- catalog tables, made once per source ---------------------------------------------

    @cached_property
    def _cat_tables(self) -> DataFrame:
        rows = [
            (t, i, len(df.columns), list(self.primary_key(t)), [c for fk in self.fks_of(t) for c in fk.columns], len(self.fks_of(t)))
            for i, (t, df) in enumerate(self.tables.items(), 1)
        ]
        fields = [
            ("table_name", pa.string()),
            ("table_ordinal", pa.int32()),
            ("n_columns", pa.int64()),
            ("pk_columns", _TEXTS),
            ("fk_columns", _TEXTS),
            ("n_fks", pa.int32()),
        ]
        return local_frame(self.spark, fields, rows)

    @cached_property
    def _cat_columns(self) -> DataFrame:
        rows = [
            (t, c, i, self.sql_type(t, c), not self.is_not_null(t, c))
            for t, df in self.tables.items()
            for i, c in enumerate(df.columns, 1)
        ]
        fields = [
            ("table_name", pa.string()),
            ("column_name", pa.string()),
            ("ordinal", pa.int32()),
            ("sql_type", pa.string()),
            ("nullable", pa.bool_()),
        ]
        return local_frame(self.spark, fields, rows)

    @cached_property
    def _cat_keys(self) -> DataFrame:
        rows = [(t, list(k), True, True) for t, k in self.primary_keys.items() if k and t in self.tables]
        rows += [
            (t, list(k), False, True) for t, keys in self.unique_keys.items() if t in self.tables for k in keys
        ]
        fields = [
            ("table_name", pa.string()),
            ("columns", _TEXTS),
            ("is_primary", pa.bool_()),
            ("is_unique", pa.bool_()),
        ]
        return local_frame(self.spark, fields, rows)

    @cached_property
    def _cat_fks(self) -> DataFrame:
        seen: dict[str, int] = {}
        rows = []
        for fk in self.foreign_keys:
            if fk.table not in self.tables:
                continue
            seen[fk.table] = seen.get(fk.table, 0) + 1
            not_null = all(self.is_not_null(fk.table, c) for c in fk.columns)
            names = (",".join(fk.columns), ",".join(fk.ref_columns))
            rows.append(
                (fk.name, fk.table, names[0], seen[fk.table], fk.ref_table, names[1], fk.on_delete, not_null,
                 list(fk.columns), list(fk.ref_columns))
            )
        fields = [
            ("fk_name", pa.string()),
            ("table_name", pa.string()),
            ("column_name", pa.string()),
            ("fk_ordinal", pa.int32()),
            ("ref_table", pa.string()),
            ("ref_column", pa.string()),
            ("on_delete", pa.string()),
            ("declared_not_null", pa.bool_()),
            ("columns", _TEXTS),
            ("ref_columns", _TEXTS),
        ]
        return local_frame(self.spark, fields, rows)

    def cat_tables(self) -> DataFrame:
        return self._cat_tables

    def cat_columns(self) -> DataFrame:
        return self._cat_columns

    def cat_keys(self) -> DataFrame:
        return self._cat_keys

    def cat_fks(self) -> DataFrame:
        """Foreign keys; ``fk_ordinal`` counts within a table, in declaration order.

        ``column_name`` and ``ref_column`` join the names of several columns by commas; ``columns``
        and ``ref_columns`` are the lists.
        """
        return self._cat_fks

    # -- reading ------------------------------------------------------------------------

    def row_counts(self) -> DataFrame:
        """``(table_name, row_count)``, one row per table, empty tables included."""
        frames = (
            df.groupBy().agg(F.expr("count(1)").alias("row_count")).selectExpr(f"{literal(t)} AS table_name", "row_count")
            for t, df in self.tables.items()
        )
        return union_all(frames, empty=no_rows(self.spark, table_name=pa.string(), row_count=pa.int64()))

    def sql(self, text: str, args: Mapping | Sequence | None = None) -> DataFrame:
        """Ad-hoc SQL over the tables, named in braces: ``SELECT * FROM {orders} WHERE ...``.

        ``args`` are bound by Spark, never pasted into the text.
        """
        used = {t: df for t, df in self.tables.items() if "{" + t + "}" in text}
        return self.spark.sql(text, args=args, **used)


def no_rows(spark: SparkSession, **fields: pa.DataType) -> DataFrame:
    """An empty frame with these columns."""
    return local_frame(spark, list(fields.items()), [])


def union_all(frames: Iterable[DataFrame], *, empty: DataFrame | None = None) -> DataFrame:
    """Union of frames with the same columns; ``empty`` is the answer where there are none."""
    frames = list(frames)
    if not frames and empty is not None:
        return empty
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df)
    return first

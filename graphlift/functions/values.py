"""Value conversion and node identity, as Spark SQL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

KEY_SEPARATOR = "|"


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str | None) -> str:
    """A text as a SQL literal; None is a null text."""
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def temporal_text(x: str) -> str:
    """``YYYY-MM-DD[ hh:mm:ss[.ffffff]]``: six fraction digits, or none when they are zero."""
    text = f"CAST({x} AS STRING)"
    return f"CASE WHEN contains({text}, '.') THEN rpad({text}, 26, '0') ELSE {text} END"


def json_value(x: str) -> str:
    """JSON text -> variant; text that is not JSON stays, as a string variant."""
    return f"coalesce(try_parse_json({x}), CAST({x} AS VARIANT))"


def graph_value(x: str, data_type: T.DataType, *, is_json: bool = False) -> str:
    """Value as it is stored on a node or edge."""
    if isinstance(data_type, T.DatetimeType):
        return temporal_text(x)
    if is_json and isinstance(data_type, T.StringType):
        return json_value(x)
    return x


def _key_text(name: str, data_type: T.DataType) -> str:
    if not isinstance(data_type, T.StringType):
        return f"CAST({quoted(name)} AS STRING)"
    return rf"regexp_replace({quoted(name)}, r'([\\|])', r'\\$1')"


def fk_value(columns: Sequence[str]) -> str:
    """What a row's foreign key or a parent's referred columns hold: one value, or a struct that is null where a part is."""
    if len(columns) == 1:
        return quoted(columns[0])
    known = " AND ".join(f"{quoted(c)} IS NOT NULL" for c in columns)
    return f"CASE WHEN {known} THEN struct({', '.join(f'{quoted(c)} AS k{i}' for i, c in enumerate(columns))}) END"


def node_key(schema: T.StructType, key: Sequence[str]) -> str:
    """Node identity as text.

    One key column is cast; several are joined by ``|`` with that character escaped inside
    string values, so different keys never meet. Without a key the digest of the whole row
    stands in.
    """
    if not key:
        return f"sha2(to_json(struct({', '.join(quoted(f.name) for f in schema)})), 256)"
    if len(key) == 1:
        return f"CAST({quoted(key[0])} AS STRING)"
    return f"concat_ws('{KEY_SEPARATOR}', {', '.join(_key_text(c, schema[c].dataType) for c in key)})"

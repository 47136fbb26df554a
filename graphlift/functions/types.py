"""SQL type name -> column type -> graph property type, as Spark SQL expressions."""

from __future__ import annotations

from .naming import text_map

# SQL type name -> column type. In `as_coded` mode the first name that is a
# substring decides, so the order matters there.
COLUMN_TYPES = {
    "int": "INTEGER",
    "integer": "INTEGER",
    "smallint": "SMALLINT",
    "bigint": "BIGINT",
    "decimal": "DECIMAL",
    "numeric": "NUMERIC",
    "float": "FLOAT",
    "double": "DOUBLE",
    "real": "DOUBLE",
    "varchar": "VARCHAR",
    "char": "CHAR",
    "text": "TEXT",
    "date": "DATE",
    "datetime": "DATETIME",
    "timestamp": "TIMESTAMP",
    "time": "TIME",
    "boolean": "BOOLEAN",
    "bool": "BOOLEAN",
    "bit": "BOOLEAN",
    "binary": "BINARY",
    "blob": "BINARY",
    "json": "JSON",
    "jsonb": "JSON",
}

# Further names that databases and Spark report; matched on the whole name only.
MORE_COLUMN_TYPES = {
    "tinyint": "SMALLINT",
    "mediumint": "INTEGER",
    "serial": "INTEGER",
    "bigserial": "BIGINT",
    "character varying": "VARCHAR",
    "character": "CHAR",
    "nchar": "CHAR",
    "nvarchar": "VARCHAR",
    "string": "VARCHAR",
    "longtext": "TEXT",
    "datetime2": "DATETIME",
    "timestamp_ntz": "TIMESTAMP",
    "varbinary": "BINARY",
    "variant": "JSON",
}

# Column type -> graph property type.
GRAPH_TYPES = {
    "INTEGER": "INTEGER",
    "BIGINT": "INTEGER",
    "SMALLINT": "INTEGER",
    "DECIMAL": "FLOAT",
    "NUMERIC": "FLOAT",
    "FLOAT": "FLOAT",
    "DOUBLE": "FLOAT",
    "DATE": "DATE",
    "DATETIME": "DATETIME",
    "TIMESTAMP": "DATETIME",
    "TIME": "DATETIME",
    "BOOLEAN": "BOOLEAN",
    "JSON": "MAP",
}


def column_type(sql_type: str, *, as_coded: bool = False) -> str:
    """Column type of a SQL type name.

    The default rule reads the whole name without its length, falling back to its first word
    (``timestamp without time zone``). ``as_coded`` takes the first known name that occurs
    anywhere in the text, so ``bigint`` gives INTEGER and ``datetime`` gives DATE.
    """
    name = f"lower({sql_type})"
    if as_coded:
        hits = [f"WHEN contains({name}, '{k}') THEN '{v}'" for k, v in COLUMN_TYPES.items()]
        return f"CASE {' '.join(hits)} ELSE 'UNKNOWN' END"
    known = text_map({**COLUMN_TYPES, **MORE_COLUMN_TYPES})
    whole = rf"trim(regexp_replace({name}, r'\(.*?\)', ''))"
    first = rf"regexp_extract({name}, r'^\w+', 0)"
    return (
        f"CASE WHEN {name} rlike '^(array|map|struct)<' THEN 'UNKNOWN' "
        f"ELSE coalesce(try_element_at({known}, {whole}), try_element_at({known}, {first}), 'UNKNOWN') END"
    )


def graph_type(sql_type: str, *, as_coded: bool = False) -> str:
    """Graph property type of a SQL type name; unknown types are STRING, arrays LIST."""
    name = f"lower({sql_type})"
    if not as_coded:
        return (
            f"CASE WHEN startswith({name}, 'array<') THEN 'LIST' WHEN {name} rlike '^(map|struct)<' THEN 'MAP' "
            f"ELSE coalesce(try_element_at({text_map(GRAPH_TYPES)}, {column_type(sql_type)}), 'STRING') END"
        )
    return (
        f"CASE WHEN {name} rlike 'int|serial' THEN 'INTEGER' "
        f"WHEN {name} rlike 'float|double|real|decimal|numeric' THEN 'FLOAT' "
        f"WHEN {name} rlike 'bool|bit' THEN 'BOOLEAN' "
        f"WHEN {name} rlike 'date' AND NOT {name} rlike 'time' THEN 'DATE' "
        f"WHEN {name} rlike 'date|time' THEN 'DATETIME' "
        f"WHEN {name} rlike 'json' THEN 'MAP' ELSE 'STRING' END"
    )

"""Naming rules as Spark SQL expressions.

Each rule takes SQL text (a column name is the simplest) and gives SQL text, so rules nest and
run inside codegen on a catalog table or on a data column alike: ``F.expr(node_label("name"))``.
Non-ASCII letters count as "not a word character".
"""

from __future__ import annotations

# Keyword -> verb; the first keyword found decides, so the order matters.
RELATIONSHIP_VERBS = {
    "manager": "MANAGES",
    "employee": "EMPLOYS",
    "supervisor": "SUPERVISES",
    "owner": "OWNS",
    "creator": "CREATES",
    "author": "AUTHORED_BY",
    "user": "USED_BY",
    "customer": "PURCHASED_BY",
    "department": "WORKS_IN",
    "company": "WORKS_FOR",
    "category": "BELONGS_TO",
    "parent": "CHILD_OF",
    "project": "ASSIGNED_TO",
}

# Names used when only the cardinality is known.
CARDINALITY_VERBS = {"1:N": "HAS", "N:1": "BELONGS_TO", "N:M": "ASSOCIATED_WITH"}


def text_map(table: dict[str, str]) -> str:
    """A fixed table as a SQL map."""
    return f"map({', '.join(f"'{x}'" for kv in table.items() for x in kv)})"


def _pascal(x: str) -> str:
    return f"replace(initcap(translate({x}, '_', ' ')), ' ', '')"


def node_label(name: str) -> str:
    """``order_items`` -> ``OrderItems``; a leading non-letter is prefixed with ``N``."""
    word = f"regexp_replace({name}, '[^a-zA-Z0-9_]', '')"
    word = f"regexp_replace({word}, '^([^a-zA-Z])', 'N$1')"
    return f"coalesce(nullif({_pascal(word)}, ''), 'Node')"


def property_name(name: str) -> str:
    """``first_name`` -> ``firstName``."""
    word = f"trim(BOTH '_' FROM regexp_replace({name}, '[^a-zA-Z0-9_]', '_'))"
    head = f"lower(substring_index({word}, '_', 1))"
    tail = _pascal(f"regexp_replace({word}, '^[^_]*', '')")
    return f"coalesce(nullif(concat({head}, {tail}), ''), 'property')"


def relationship_type(from_table: str, to_table: str) -> str:
    """Direct-mode name: both tables without their trailing ``s``, in SCREAMING_SNAKE_CASE."""
    pair = f"concat_ws('_', regexp_replace({from_table}, 's+$', ''), regexp_replace({to_table}, 's+$', ''))"
    snake = f"upper(regexp_replace({pair}, '([A-Z])', '_$1'))"
    snake = f"regexp_replace(regexp_replace({snake}, '[^A-Z0-9_]', '_'), '_+', '_')"
    return f"trim(BOTH '_' FROM {snake})"


def junction_type(table: str) -> str:
    """A junction table names its relationship: ``post_tags`` -> ``POST_TAGS``."""
    return f"upper(translate({table}, ' ', '_'))"


def is_valid_identifier(name: str) -> str:
    """Letter or underscore first, then letters, digits, underscores; empty is invalid."""
    return rf"coalesce({name} rlike r'^[\p{{L}}_][\p{{L}}\p{{N}}_]*\z', false)"


def verb_for(fk_column: str, ref_table: str, *, as_coded: bool = False) -> str:
    """Verb of the first keyword found in the fk column or the referenced table, else null."""
    if as_coded:
        fk = f"replace(replace(lower({fk_column}), '_id', ''), 'id', '')"
    else:
        fk = f"regexp_replace(lower({fk_column}), '_?id$', '')"
    hits = [
        f"WHEN contains({fk}, '{k}') OR contains(lower({ref_table}), '{k}') THEN '{v}'"
        for k, v in RELATIONSHIP_VERBS.items()
    ]
    return f"CASE {' '.join(hits)} END"


def relationship_name(
    fk_column: str, ref_table: str, is_inheritance: str, is_aggregation: str, *, as_coded: bool = False
) -> str:
    """Enriched name: ``IS_A_X`` for inheritance, else a verb, else ``PART_OF_X`` / ``HAS_X``."""
    plain = f"upper(replace(replace({ref_table}, 'tbl', ''), '_', ''))"
    prefix = f"CASE WHEN {is_aggregation} THEN 'PART_OF_' ELSE 'HAS_' END"
    verb = verb_for(fk_column, ref_table, as_coded=as_coded)
    return (
        f"CASE WHEN {is_inheritance} THEN concat('IS_A_', upper({ref_table})) "
        f"ELSE coalesce({verb}, concat({prefix}, {plain})) END"
    )


def name_stem(column: str) -> str:
    """Column name without a one-letter table prefix: ``o_custkey`` -> ``custkey``."""
    return f"regexp_replace(lower({column}), '^[a-z]_', '')"

"""The commands of the library: analyse, enrich, migrate, validate.

Each step takes what the one before it found, so nothing is profiled twice:

    found = analyze(source)
    graph = migrate(found, "/shared/graph")
    report = validate(found.source, graph)
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..graph import Graph
from ..operators import checks as CK
from ..operators import inclusion as I
from ..operators import profile as P
from ..operators import semantics as S
from ..sources import sinks
from ..sources.source import Source
from .build import GraphMapping, build_graph

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Analysis:
    """A source with its keys settled, and the evidence behind its foreign keys."""

    source: Source
    row_counts: dict[str, int]
    evidence: DataFrame


def readable(source: Source) -> tuple[Source, dict[str, int]]:
    """The tables that can be read, with their row counts; the others are logged and left out."""
    try:
        return source, {r.table_name: r.row_count for r in source.row_counts().collect()}
    except Exception:  # one bad table fails the common job; find out which
        counts = {}
        for name, df in source.tables.items():
            try:
                counts[name] = df.count()
            except Exception as error:
                log.error("table %s cannot be read and is skipped: %s", name, error)
        return source.only(counts), counts


def analyze(source: Source, *, discover: bool = False, max_arity: int | None = None) -> Analysis:
    """Count the tables and profile the foreign keys; a table that fails is logged and skipped.

    ``discover`` looks for primary and foreign keys where none are declared. What is kept on the
    driver is one row per table and per foreign key.
    """
    source, counts = readable(source)
    if discover:
        source = replace(source, primary_keys=P.discover_primary_keys(source, max_arity=max_arity))
        declared = {(fk.table, fk.columns) for fk in source.foreign_keys}
        found = [*I.discover_foreign_keys(source), *I.discover_composite_foreign_keys(source)]
        found = [fk for fk in found if (fk.table, fk.columns) not in declared]
        source = replace(source, foreign_keys=(*source.foreign_keys, *found))
    usable = [fk for fk in source.foreign_keys if fk.table in source.tables and fk.ref_table in source.tables]
    return Analysis(source, counts, P.materialize(P.fk_profile(source, usable)))


def enrich(found: Analysis, *, rule: str = "shared_key") -> S.ConceptualModel:
    """Schema -> conceptual model, NOT NULL and the like taken from the rows where not declared."""
    return S.enrich(found.source, rule=rule, evidence=found.evidence)


def migrate(
    found: Analysis,
    path: str | None = None,
    *,
    mode: str = "enriched",
    rule: str = "shared_key",
    mapping: GraphMapping | None = None,
    clear: bool = True,
    sort_by: dict[str, list[str]] | None = None,
) -> Graph:
    """Build the graph and store it below ``path``; what is returned is then the graph as it is stored there.

    A load is a version of its own that is switched to when it is complete, so one that fails leaves
    the graph before it readable. ``clear`` replaces that graph; without it, nodes and edges of the
    same key are replaced and the others stay. Without a path nothing runs (dry run).
    """
    graph = build_graph(
        found.source, mode, rule=rule, mapping=mapping, evidence=found.evidence, row_counts=found.row_counts
    )
    if path is None:
        return graph
    spark = found.source.spark
    return sinks.read_graph(spark, sinks.store_graph(spark, graph, path, clear=clear, sort_by=sort_by), graph)


def validate(source: Source, graph: Graph, *, rule: str = "shared_key") -> dict[str, DataFrame]:
    """All checks of a graph against its source, lazily, by name."""
    found = CK.findings(source, graph, rule=rule)
    return {
        "summary": CK.validation_summary(found),
        "findings": found,
        "counts": CK.reconcile_counts(source, graph),
        "totals": CK.target_totals(graph),
        "relationships": CK.relationship_counts(graph),
        "instances": CK.instance_counts(source, graph),
    }

"""Source -> graph: the plan that puts the operators together."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions.values import literal
from ..graph import Graph
from ..operators import edges as E
from ..operators import nodes as ND
from ..operators import semantics as S
from ..sources.source import ForeignKey, Source

MODES = ("direct", "enriched")

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class GraphMapping:
    """Choices of the user about what becomes a node or an edge.

    ``custom_relationships`` gives the type name for a junction table, or for all foreign keys of
    a table.
    """

    tables_as_nodes: tuple[str, ...] | None = None
    foreign_keys_as_relationships: bool = True
    junction_tables_as_relationships: bool = True
    custom_relationships: Mapping[str, str] = field(default_factory=dict)
    preserve_inheritance: bool = True
    infer_cardinality: bool = True
    generate_semantic_names: bool = True




def build_graph(
    source: Source,
    mode: str = "enriched",
    *,
    rule: str = "shared_key",
    mapping: GraphMapping | None = None,
    evidence: DataFrame | None = None,
    assume_complete: bool = False,
    row_counts: Mapping[str, int] | None = None,
    derived: Mapping[str, Mapping[str, str]] | None = None,
) -> Graph:
    """Nodes and edges of a source, lazily.

    ``mode='direct'`` names relationships after the tables; ``'enriched'`` uses the conceptual
    model. An edge exists only if both its nodes do, so parents are looked up. With ``evidence``
    (a materialized ``profile.fk_profile``) keys without orphans need no join, and the few orphans
    of the others are broadcast; ``assume_complete`` skips the lookup for all. ``row_counts`` lets
    a lookup in a big parent spread its hot keys.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    mapping = mapping or GraphMapping()
    labels = ND.labels_of(source)
    names = ND.property_names(source)
    junctions = {r.table_name for r in S.junction_flags(source, rule=rule).where("is_junction").select("table_name").collect()}
    entities = [t for t in source.tables if t not in junctions]
    if mapping.tables_as_nodes is not None:
        entities = [t for t in entities if t in mapping.tables_as_nodes]
    planned = _plan_edges(source, mode, rule, mapping, evidence, labels, entities, junctions)
    unproven, orphans = _unproven(source, evidence, assume_complete)
    sizes = {"orphans": orphans, "row_counts": row_counts}

    enriched = mode == "enriched"
    nodes, carriers, edge_sets = {}, {}, {}
    of_label: dict[str, list[str]] = {}
    for t in entities:
        of_label.setdefault(labels[t], []).append(t)
    for label, tables in of_label.items():
        frames = [ND.table_nodes(source, t, label=label, names=names, keep_foreign_keys=enriched) for t in tables]
        frames = [_with_derived(df, (derived or {}).get(t)) for t, df in zip(tables, frames)]
        if len(tables) > 1:
            log.warning("tables %s share the label %s; their nodes are put together", ", ".join(tables), label)
        nodes[label] = ND.union_nodes(frames) if len(frames) > 1 else frames[0]
    by_table: dict[str, list[E.EdgeType]] = {}
    for e in planned:
        by_table.setdefault(e.fk.table, []).append(e)
    for t, types in by_table.items():
        if t in junctions:
            check = [fk for fk in source.fks_of(t) if fk.name in unproven]
            edge_sets[t] = E.junction_edges(source, t, types[0], names, check=check, **sizes)
        else:
            check = [e.fk for e in types if e.fk.name in unproven]
            edge_sets[t] = E.fk_edges(source, t, types, check=check, **sizes)
            if len(of_label[labels[t]]) == 1:
                carrier = _carrier(source, t, labels[t], names, enriched, [e.fk for e in types])
                carriers[labels[t]] = _with_derived(carrier, (derived or {}).get(t))
    model_labels = ND.label_table(source, entities, keep_foreign_keys=enriched)
    placed = {t: (labels[t], labels[t]) for t in entities}
    return Graph(source, mode, nodes, edge_sets, tuple(planned), carriers, model_labels, placed, names)


def _with_derived(df: DataFrame, derived: Mapping[str, str] | None) -> DataFrame:
    for name, text in (derived or {}).items():
        df = ND.derive_property(df, name, text)
    return df


def _carrier(source: Source, table: str, label: str, names, keep_fks: bool, fks: list[ForeignKey]) -> DataFrame:
    """Node rows plus their raw foreign keys, from the same projection of the table."""
    df = source[table]
    fks = [fk for fk in fks if len(fk.columns) == 1]
    extended = replace(source, tables={**source.tables, table: df.withColumns({f"_fk:{fk.name}": F.col(f"`{fk.columns[0]}`") for fk in fks})})
    all_names = {**names, **{(table, f"_fk:{fk.name}"): f"_fk:{fk.name}" for fk in fks}}
    return ND.table_nodes(extended, table, label=label, names=all_names, keep_foreign_keys=keep_fks)


def _unproven(source: Source, evidence: DataFrame | None, assume_complete: bool) -> tuple[set[str], dict[str, int]]:
    """Foreign keys whose parents must be looked up, and the orphan values known of each."""
    if assume_complete:
        return set(), {}
    names = {fk.name for fk in source.foreign_keys}
    if evidence is None:
        return names, {}
    known = {r.fk_name: r.orphan_values for r in evidence.select("fk_name", "orphan_values").collect()}
    return {n for n in names if known.get(n) != 0}, known


def _plan_edges(source, mode, rule, mapping, evidence, labels, entities, junctions) -> list[E.EdgeType]:
    """Names and ends of all edge types; catalog-sized, so it is resolved on the driver."""
    fks = {fk.name: fk for fk in source.foreign_keys if fk.table in source.tables}
    plain = N.relationship_type("table_name", "ref_table")
    if mode == "direct":
        rows = source.cat_fks().selectExpr(
            "fk_name", f"{plain} AS name", "CAST(NULL AS STRING) AS cardinality", "CAST(NULL AS STRING) AS semantics"
        )
    else:
        name, semantics, cardinality = "relationship_name", "semantics", "cardinality"
        if not mapping.preserve_inheritance:
            flat = N.relationship_name("column_name", "ref_table", "false", "not_null")
            name = f"CASE WHEN is_inheritance THEN {flat} ELSE relationship_name END"
            semantics = "CASE WHEN is_inheritance THEN 'ASSOCIATION' ELSE semantics END"
        if not mapping.generate_semantic_names:
            name = plain
        if not mapping.infer_cardinality:
            cardinality = "CAST(NULL AS STRING)"
        rows = S.enriched_fks(source, rule=rule, evidence=evidence).selectExpr(
            "fk_name", f"{name} AS name", f"{cardinality} AS cardinality", f"{semantics} AS semantics"
        )
    named = {r.fk_name: r for r in rows.collect()}
    planned: list[E.EdgeType] = []
    for name, fk in fks.items():
        if fk.table in junctions or not mapping.foreign_keys_as_relationships:
            continue
        if fk.table in entities and fk.ref_table in entities:
            r = named[name]
            rel = mapping.custom_relationships.get(fk.table, r.name)
            planned.append(E.EdgeType(fk, rel, labels[fk.table], labels[fk.ref_table], r.cardinality, r.semantics))
    if mapping.junction_tables_as_relationships and junctions:
        types = {
            r.table_name: r.name
            for r in source.cat_tables().selectExpr("table_name", f"{N.junction_type('table_name')} AS name").collect()
        }
        for t in junctions:
            a, b = source.fks_of(t)
            if a.ref_table in entities and b.ref_table in entities:
                rel = mapping.custom_relationships.get(t, types[t])
                many = "N:M" if mode == "enriched" and mapping.infer_cardinality else None
                edge = ForeignKey(t, t, b.column, b.ref_table, b.ref_column)
                semantics = "ASSOCIATION" if mode == "enriched" else None
                planned.append(E.EdgeType(edge, rel, labels[a.ref_table], labels[b.ref_table], many, semantics))
    return planned


def merge_inheritance(graph: Graph, *, evidence: DataFrame | None = None) -> Graph:
    """The graph with every subclass folded into its root: one node, several labels.

    A subclass shares the key of its superclass, so node keys stay what they were. IS-A edges inside a
    hierarchy disappear, all others now start and end at the root's label. A table may have several
    superclasses: its rows are folded along the first, and carry the labels of all. Superclasses that
    lead to the same root add nothing but labels that the node has anyway; where they lead to another
    root, the IS-A edge to the node there stays.
    """
    isa: dict[str, E.EdgeType] = {}
    every: dict[str, list[E.EdgeType]] = {}
    for e in graph.edge_types:
        if e.semantics == "INHERITANCE":
            isa.setdefault(e.from_label, e)
            every.setdefault(e.from_label, []).append(e)
    complete = set()
    if evidence is not None:
        complete = {r.fk_name for r in evidence.where("orphan_values = 0").select("fk_name").collect()}

    def root_of(label: str) -> str:
        seen = set()
        while label in isa and label not in seen:
            seen.add(label)
            label = isa[label].to_label
        return label

    def depth_of(label: str) -> int:
        depth, seen = 0, set()
        while label in isa and label not in seen:
            seen.add(label)
            label, depth = isa[label].to_label, depth + 1
        return depth

    def above(label: str, seen: tuple[str, ...] = ()) -> list[str]:
        """All superclasses, near ones first."""
        found: dict[str, None] = {}
        for e in every.get(label, ()):
            if e.to_label not in (*seen, label):
                found |= dict.fromkeys([e.to_label, *above(e.to_label, (*seen, label))])
        return list(found)

    roots = {label: root_of(label) for label in graph.nodes}
    subs = sorted((label for label in graph.nodes if roots[label] != label and roots[label] not in isa), key=depth_of)
    nodes, key_of = dict(graph.nodes), {}
    for sub in subs:
        e, root = isa[sub], roots[sub]
        single = len(e.fk.columns) == 1
        key_of.setdefault(root, graph.names[e.fk.ref_table, e.fk.ref_columns[0]] if single else "node_key")
        nodes[root] = ND.merge_subclass(
            nodes[root],
            nodes.pop(sub),
            parent_key=key_of[root],
            child_key=graph.names[e.fk.table, e.fk.columns[0]] if single else "node_key",
            child_label=sub,
            keep_orphans=e.fk.name not in complete,
            also=[label for label in above(sub) if roots[label] != root],
        )
    # An IS-A edge whose ends are now one node says what the labels say.
    gone = {e.fk.name for sub in subs for e in every[sub] if roots[e.to_label] == roots[sub]}
    moved = {sub: roots[sub] for sub in subs}
    types = tuple(
        replace(e, from_label=moved.get(e.from_label, e.from_label), to_label=moved.get(e.to_label, e.to_label))
        for e in graph.edge_types
        if e.fk.name not in gone
    )
    edge_sets = {t: _relabel(df, moved, gone) for t, df in graph.edge_sets.items()} if moved else dict(graph.edge_sets)
    touched = {*moved, *moved.values()}
    carriers = {label: df for label, df in graph.carriers.items() if label not in touched}
    placed = {t: (moved.get(at, at), label) for t, (at, label) in graph.tables.items()}
    return replace(graph, nodes=nodes, edge_sets=edge_sets, edge_types=types, carriers=carriers, tables=placed)


def _relabel(edges: DataFrame, moved: Mapping[str, str], gone: set[str]) -> DataFrame:
    new = N.text_map(dict(moved))
    return edges.where(f"fk_name IS NULL OR fk_name NOT IN ({', '.join(literal(n) for n in gone)})").withColumns(
        {c: F.expr(f"coalesce(try_element_at({new}, {c}), {c})") for c in ("from_label", "to_label")}
    )

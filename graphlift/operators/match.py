"""Pattern queries over a graph, as joins.

A pattern alternates nodes and steps, built from ``node`` and ``step``:

    match(graph, [node("o", "Orders"), step("PURCHASED_BY"), node("c", "Customer")],
          where="c.cMktsegment = 'BUILDING'", returns={"name": "c.cName"})

Conditions and results are ordinary Spark SQL expressions over ``<variable>.<property>``, so
Catalyst pushes filters to the scans and reads only the columns that are used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Graph
from ..sources.source import no_rows, union_all
from .edges import HOT_ROWS, fk_edges, hot_keys, same_hash, with_parts, with_salt


@dataclass(frozen=True)
class Node:
    var: str
    label: str


@dataclass(frozen=True)
class Step:
    rel_type: str | None
    direction: str
    var: str | None


def node(var: str, label: str) -> Node:
    return Node(var, label)


def step(rel_type: str | None = None, direction: str = "out", var: str | None = None) -> Step:
    """``out`` is ``-[..]->``, ``in`` is ``<-[..]-``. Name ``var`` to use the edge's own columns."""
    if direction not in ("out", "in"):
        raise ValueError(f"unknown direction: {direction}")
    return Step(rel_type, direction, var)


def match(
    graph: Graph,
    pattern: Sequence[Node | Step],
    *,
    where: str | None = None,
    returns: Mapping[str, str] | None = None,
    order_by: Sequence[str] = (),
    limit: int | None = None,
    spread: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows of a path pattern.

    A step along a foreign key is joined through the key that the child node carries, typed and
    without touching an edge table. A named step, or one along a junction or user-defined type,
    goes through its edges. An edge is not used twice within a pattern, as paths require.

    ``spread`` cuts the hubs of every step (nodes with at least ``hot_rows`` edges) into parts, for
    node sets too big to broadcast whose hubs hold a large share of the edges. The result is the
    same; without it Spark decides between broadcast, sort-merge and its own skew handling.
    """
    nodes, steps = list(pattern[0::2]), list(pattern[1::2])
    if len(nodes) != len(steps) + 1 or not all(isinstance(n, Node) for n in nodes):
        raise ValueError("a pattern alternates nodes and steps, nodes at both ends")
    carried = [_carried(graph, a, s, b) for a, s, b in zip(nodes, steps, nodes[1:])]
    carries = {(a if s.direction == "out" else b).var for a, s, b, way in zip(nodes, steps, nodes[1:], carried) if way}
    frames = {n.var: (graph.carriers if n.var in carries else graph.nodes)[n.label] for n in nodes}

    joins, used, tests = [], [], []
    for i, (a, s, b, way) in enumerate(zip(nodes, steps, nodes[1:], carried)):
        child, parent = (a, b) if s.direction == "out" else (b, a)
        if way is not None:
            fk = f"_fk:{way[0]}"
            on = F.col(f"{child.var}.`{fk}`") == F.col(f"{parent.var}.{way[1]}")
            if spread and same_hash(graph.carriers[child.label].schema[fk].dataType, frames[parent.var].schema[way[1]].dataType):
                hot = hot_keys(graph.carriers[child.label], fk, hot_rows)
                frames[child.var] = with_salt(frames[child.var], fk, hot, f"_salt{i}", by=["node_key"])
                frames[parent.var] = with_parts(frames[parent.var], way[1], hot, f"_part{i}")
                on = on & (F.col(f"{child.var}._salt{i}") == F.col(f"{parent.var}._part{i}"))
            joins.append((b.var, on))
            edge = (F.lit(way[0]), F.col(f"{child.var}.node_key"), F.col(f"{parent.var}.node_key"))
        else:
            var = s.var or f"_r{i}"
            edges = _edges(graph, child, s, parent)
            near, far = ("from_key", "to_key") if s.direction == "out" else ("to_key", "from_key")
            frames[var] = edges
            ends = []
            for end, key in ((a, near), (b, far)):
                on = F.col(f"{end.var}.node_key") == F.col(f"{var}.{key}")
                if spread:
                    hot = hot_keys(edges, key, hot_rows)
                    frames[var] = with_salt(frames[var], key, hot, f"_salt_{key}", by=["from_key", "to_key"])
                    frames[end.var] = with_parts(frames[end.var], "node_key", hot, f"_part{i}_{key}")
                    on = on & (F.col(f"{var}._salt_{key}") == F.col(f"{end.var}._part{i}_{key}"))
                ends.append(on)
            joins += [(var, ends[0]), (b.var, ends[1])]
            edge = tuple(F.col(f"{var}.{c}") for c in ("fk_name", "from_key", "to_key"))
        for other, rel_type, labels in used:
            if labels == (child.label, parent.label) and (None in (rel_type, s.rel_type) or rel_type == s.rel_type):
                tests.append(~(other[0].eqNullSafe(edge[0]) & (other[1] == edge[1]) & (other[2] == edge[2])))
        used.append((edge, s.rel_type, (child.label, parent.label)))

    df = frames[nodes[0].var].alias(nodes[0].var)
    for var, on in joins:
        df = df.join(frames[var].alias(var), on)
    for test in tests:
        df = df.where(test)
    if where:
        df = df.where(where)
    if returns:
        df = df.select(*[F.expr(text).alias(name) for name, text in returns.items()])
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(limit) if limit is not None else df


def _carried(graph: Graph, a: Node, s: Step, b: Node) -> tuple[str, str] | None:
    """The single foreign key behind a step and the parent property it points to, if any."""
    child, parent = (a, b) if s.direction == "out" else (b, a)
    if s.var is not None or child.label not in graph.carriers:
        return None
    hits = [e for e in graph.edge_types if _fits(e, child, s, parent)]
    if len(hits) != 1 or f"_fk:{hits[0].fk.name}" not in graph.carriers[child.label].columns:
        return None
    fk = hits[0].fk
    prop = graph.names.get((fk.ref_table, fk.ref_columns[0]))
    types = [graph.source[t].schema[c].dataType for t, c in ((fk.table, fk.columns[0]), (fk.ref_table, fk.ref_columns[0]))]
    if prop not in graph.nodes[parent.label].columns or any(isinstance(t, T.DatetimeType) for t in types):
        return None
    return fk.name, prop


def _fits(e, child: Node, s: Step, parent: Node) -> bool:
    return (s.rel_type in (None, e.rel_type)) and e.from_label == child.label and e.to_label == parent.label


def _edges(graph: Graph, child: Node, s: Step, parent: Node) -> DataFrame:
    """Edges of one step: only the edge sets that can hold the type, as planned."""
    planned = {e.fk.table for e in graph.edge_types}
    tables = {e.fk.table for e in graph.edge_types if _fits(e, child, s, parent)}
    tables |= {t for t in graph.edge_sets if t not in planned}
    if not tables:
        raise ValueError(f"no relationship {s.rel_type} from {child.label} to {parent.label}")
    edges = union_all(graph.edge_sets[t] for t in sorted(tables))
    test = (F.col("from_label") == child.label) & (F.col("to_label") == parent.label)
    return edges.where(test if s.rel_type is None else test & (F.col("rel_type") == s.rel_type))


def _taking_part(graph: Graph, n: Node, where: Mapping[str, str]) -> DataFrame:
    """``(k,)``: keys of the nodes that meet their variable's condition."""
    df = graph.nodes[n.label]
    df = df.where(where[n.var]) if n.var in where else df
    return df.select(F.col("node_key").alias("k")).distinct()


def _step_ends(graph: Graph, a: Node, s: Step, b: Node) -> DataFrame:
    """``(x, y)``: the keys at both ends of a step's edges, a's first."""
    child, parent = (a, b) if s.direction == "out" else (b, a)
    x, y = ("from_key", "to_key") if s.direction == "out" else ("to_key", "from_key")
    hits = [e for e in graph.edge_types if _fits(e, child, s, parent)]
    of_user = set(graph.edge_sets) - {e.fk.table for e in graph.edge_types}
    if len(hits) == 1 and hits[0].fk in graph.source.foreign_keys and child.label in graph.carriers and not of_user:
        # One foreign key of a table: neither its other keys are looked up, nor parents, which are joined as nodes anyway.
        edges = fk_edges(graph.source, hits[0].fk.table, hits)
    else:
        edges = _edges(graph, child, s, parent)
    return edges.select(F.col(x).alias("x"), F.col(y).alias("y"))


def _walked(graph: Graph, nodes: Sequence[Node], steps: Sequence[Step], where: Mapping[str, str]) -> DataFrame:
    """``(k, n)``: how many ways lead from the first node to each key of the last one, which need not take part yet."""
    counts = _taking_part(graph, nodes[0], where).withColumn("n", F.lit(1).cast("bigint"))
    for i, (a, s, b) in enumerate(zip(nodes, steps, nodes[1:])):
        if i:
            counts = counts.join(_taking_part(graph, a, where), "k")
        ends = _step_ends(graph, a, s, b)
        counts = ends.join(counts, ends["x"] == counts["k"]).groupBy(F.col("y").alias("k")).agg(F.sum("n").alias("n"))
    return counts


def count_paths(graph: Graph, pattern: Sequence[Node | Step], *, where: Mapping[str, str] | None = None, per_start: bool = False) -> DataFrame:
    """``n``: how many rows ``match`` has for a pattern; ``(node_key, n)`` for each start node with ``per_start``.

    No path is formed. Counts are passed along the steps, added up per node before they are shuffled,
    and meet in the middle of the pattern, so two hops over a hub of n edges move n numbers and not the
    n * n paths. ``where`` gives a condition on a variable's own properties; it takes nodes away before
    anything is counted.

    As in ``match``, an edge is used once in a path. Two steps that could take the same edges must
    therefore be the only ones of the pattern; paths that go back over their edge are then counted and
    subtracted. Keys are taken to be unique among the nodes of a label; one that repeats counts as one node.
    """
    nodes, steps, where = list(pattern[0::2]), list(pattern[1::2]), dict(where or {})
    if len(nodes) != len(steps) + 1 or not steps or not all(isinstance(n, Node) for n in nodes):
        raise ValueError("a pattern alternates nodes and steps, nodes at both ends")
    if unknown := set(where) - {n.var for n in nodes}:
        raise ValueError(f"no such variable: {', '.join(sorted(unknown))}")
    kinds = []
    for a, s, b in zip(nodes, steps, nodes[1:]):
        child, parent = (a, b) if s.direction == "out" else (b, a)
        kinds.append((child.label, parent.label, s.rel_type))
    shared = [(p, q) for i, p in enumerate(kinds) for q in kinds[:i] if p[:2] == q[:2] and (None in (p[2], q[2]) or p[2] == q[2])]
    if shared and len(steps) > 2:
        raise ValueError("two steps could take the same edge; use match for this pattern")
    total = lambda column: F.coalesce(F.sum(column), F.lit(0)).cast("bigint")
    back = [replace(s, direction="in" if s.direction == "out" else "out") for s in steps]
    first, last = nodes[0], nodes[-1]
    if per_start:
        found = _walked(graph, nodes[::-1], back[::-1], where).join(_taking_part(graph, first, where), "k")
    else:
        mid = len(steps) // 2
        met = _walked(graph, nodes[mid:][::-1], back[mid:][::-1], where).join(_taking_part(graph, nodes[mid], where), "k")
        if mid:
            met = met.withColumnRenamed("n", "r").join(_walked(graph, nodes[: mid + 1], steps[:mid], where), "k").withColumn("n", F.col("n") * F.col("r"))
        found = met.agg(total("n").alias("n"))
    if shared and first.label == last.label and steps[0].direction != steps[1].direction:
        edges = _step_ends(graph, first, steps[0], nodes[1]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("m"))
        for n, key in ((first, "x"), (last, "x"), (nodes[1], "y")):
            edges = edges.join(_taking_part(graph, n, where).withColumnRenamed("k", key), key)
        again = F.col("m") * F.col("m")
        if per_start:
            lost = edges.groupBy(F.col("x").alias("k")).agg(F.sum(again).alias("lost"))
            found = found.join(lost, "k", "left").select("k", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n")).where("n > 0")
        else:
            found = found.unionByName(edges.agg((-total(again)).alias("n"))).agg(F.sum("n").alias("n"))
    return found.withColumnRenamed("k", "node_key") if per_start else found


def collect_over_hub(
    graph: Graph,
    start: Node,
    hub: Node,
    end: Node,
    *,
    start_step: str,
    end_step: str,
    value: str,
    returns: Mapping[str, str],
    alias: str,
    where: str | None = None,
) -> DataFrame:
    """``(start)-[..]->(hub)<-[..]-(end)`` with ``collect(DISTINCT end.value)`` per start node.

    All start nodes of a hub see the same end nodes. The values are collected once per hub and
    handed to its start nodes, so no start-end pairs are formed, however full the hub is.
    The array holds each distinct value once, sorted. ``where`` may speak of the hub and the end.
    """
    key = F.col(f"{hub.var}.node_key").alias("_hub")
    values = (
        match(graph, [hub, step(end_step, "in"), end], where=where)
        .select(key, F.expr(value).alias("_value"))
        .distinct()
        .groupBy("_hub")
        .agg(F.array_sort(F.collect_list("_value")).alias(alias))
    )
    starts = match(graph, [start, step(start_step), hub])
    starts = starts.select(key, *[F.expr(text).alias(name) for name, text in returns.items()])
    return starts.join(values, "_hub").drop("_hub")


def collect_groups(
    graph: Graph,
    start: Node,
    hub: Node,
    end: Node,
    *,
    start_step: str,
    end_step: str,
    value: str,
    returns: Mapping[str, str],
    alias: str,
    distinct: bool = False,
    where: str | None = None,
) -> DataFrame:
    """``(start)-[..]->(hub)<-[..]-(end)`` with ``collect(end.value)`` per group of returned columns.

    A value comes once for every match, or once with ``distinct``; the array is sorted. Start nodes and
    values are counted per hub and only the counts are multiplied, so no start-end pairs are formed.
    """
    key = F.col(f"{hub.var}.node_key").alias("_hub")
    values = match(graph, [hub, step(end_step, "in"), end], where=where).select(key, F.expr(value).alias("_value"))
    values = values.where(F.col("_value").isNotNull()).groupBy("_hub", "_value").agg(F.count(F.lit(1)).alias("_n"))
    starts = match(graph, [start, step(start_step), hub]).select(key, *[F.expr(text).alias(name) for name, text in returns.items()])
    names = [f"`{n}`" for n in returns]
    starts = starts.groupBy("_hub", *names).agg(F.count(F.lit(1)).alias("_m"))
    held = starts.join(values, "_hub").groupBy(*names, "_value").agg(F.sum(F.col("_m") * F.col("_n")).alias("_k"))
    times = F.lit(1) if distinct else F.col("_k").cast("int")
    pairs = F.array_sort(F.collect_list(F.struct("_value", times.alias("_k"))))
    return held.groupBy(*names).agg(F.flatten(F.transform(pairs, lambda x: F.array_repeat(x["_value"], x["_k"]))).alias(alias))


# -- counts -----------------------------------------------------------------------------------


def node_counts(graph: Graph, label: str | None = None) -> DataFrame:
    """``(label, n)`` per label; labels without nodes count 0."""
    nodes = graph.nodes if label is None else {label: graph.nodes[label]}
    counts = (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n") for name, df in nodes.items())
    return union_all(counts, empty=no_rows(graph.source.spark, label=pa.string(), n=pa.int64()))


def edge_counts(graph: Graph, rel_type: str | None = None) -> DataFrame:
    """``(rel_type, from_label, to_label, n)`` of the edges that exist."""
    edges = graph.edges if rel_type is None else graph.edges.where(F.col("rel_type") == rel_type)
    return edges.groupBy("rel_type", "from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))


def histogram(graph: Graph) -> DataFrame:
    """Counts per label and per type with a total of each kind (``name`` is null there)."""
    nodes = node_counts(graph).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    edges = edge_counts(graph).select(F.lit("edge").alias("kind"), F.col("rel_type").alias("name"), "n")
    both = nodes.unionByName(edges)
    return (
        both.rollup("kind", "name").agg(F.sum("n").alias("n"), F.grouping_id().alias("_g")).where("_g < 3").drop("_g")
    )


def graph_sample(graph: Graph, n: int = 50) -> DataFrame:
    """The first ``n`` nodes in ``(label, node_key)`` order."""
    return graph.all_nodes.orderBy("label", "node_key").limit(n)


# -- model summary ----------------------------------------------------------------------------


def model_summary(graph: Graph) -> DataFrame:
    """``(kind, name, from_label, to_label, n_properties)`` of labels and relationship types."""
    labels = graph.labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_properties"))
    text = F.lit(None).cast("string")
    kinds = labels.select(
        F.lit("label").alias("kind"), F.col("label").alias("name"), text.alias("from_label"), text.alias("to_label"),
        "n_properties",
    )
    types = graph.rel_types().select(
        F.lit("type").alias("kind"), F.col("rel_type").alias("name"), "from_label", "to_label",
        F.lit(None).cast("bigint").alias("n_properties"),
    )
    return kinds.unionByName(types)


def types_of_label(graph: Graph, label: str) -> DataFrame:
    """Relationship types that start or end at a label."""
    return graph.rel_types().where((F.col("from_label") == label) | (F.col("to_label") == label))

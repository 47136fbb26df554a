"""The property graph as a set of lazy DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.edges import EDGE_COLUMNS, EdgeType
from .sources.source import Source, local_frame, no_rows, union_all


@dataclass(frozen=True)
class Graph:
    """A property graph as lazy DataFrames.

    ``nodes`` holds one wide DataFrame per label, ``edge_sets`` one edge DataFrame per source
    table. ``carriers`` are the node DataFrames with their foreign keys still on board
    (``_fk:<name>``): a pattern step along such a key needs one join instead of two.
    """

    source: Source
    mode: str
    nodes: Mapping[str, DataFrame]
    edge_sets: Mapping[str, DataFrame]
    edge_types: tuple[EdgeType, ...]
    carriers: Mapping[str, DataFrame] = field(default_factory=dict)
    labels: DataFrame | None = None
    #: Source table -> (key in ``nodes`` its rows are under, label they carry there).
    tables: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    names: Mapping[tuple[str, str], str] = field(default_factory=dict)

    @property
    def edges(self) -> DataFrame:
        return union_all(self.edge_sets.values()) if self.edge_sets else self._no_edges()

    def _no_edges(self) -> DataFrame:
        return local_frame(self.source.spark, [(c, pa.string()) for c in EDGE_COLUMNS], [])

    @property
    def all_nodes(self) -> DataFrame:
        """``(label, node_key)`` of every node."""
        one = (df.select(F.lit(name).alias("label") if "label" not in df.columns else "label", "node_key") for name, df in self.nodes.items())
        return union_all(one, empty=no_rows(self.source.spark, label=pa.string(), node_key=pa.string()))

    def rel_types(self) -> DataFrame:
        """Relationship types as a catalog table."""
        fields = [(n, pa.string()) for n in ("fk_name", "rel_type", "from_label", "to_label", "cardinality", "semantics")]
        rows = [(e.fk.name, e.rel_type, e.from_label, e.to_label, e.cardinality, e.semantics) for e in self.edge_types]
        return local_frame(self.source.spark, fields, rows)

    def with_nodes(self, label: str, df: DataFrame) -> Graph:
        """The graph with the nodes of one label replaced or added."""
        carriers = {k: v for k, v in self.carriers.items() if k != label}
        return replace(self, nodes={**self.nodes, label: df}, carriers=carriers)

    def with_edges(self, name: str, df: DataFrame) -> Graph:
        """The graph plus user-defined edges; columns they lack are null."""
        some = next(iter(self.edge_sets.values()), None) or self._no_edges()
        df = some.limit(0).unionByName(df, allowMissingColumns=True).select(*EDGE_COLUMNS)
        return replace(self, edge_sets={**self.edge_sets, name: df})

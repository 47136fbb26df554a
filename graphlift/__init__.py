"""graphlift: relational tables to a property graph, as PySpark DataFrames."""

from .graph import Graph
from .operators.match import collect_groups, collect_over_hub, count_paths, match, node, step
from .plans.build import GraphMapping, build_graph, merge_inheritance
from .plans.pipeline import Analysis, analyze, enrich, migrate, validate
from .sources.source import ForeignKey, Source

__all__ = [
    "Analysis",
    "ForeignKey",
    "Graph",
    "GraphMapping",
    "Source",
    "analyze",
    "build_graph",
    "collect_groups",
    "collect_over_hub",
    "count_paths",
    "enrich",
    "match",
    "merge_inheritance",
    "migrate",
    "node",
    "step",
    "validate",
]

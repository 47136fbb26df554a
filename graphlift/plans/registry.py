"""All registered queries by inventory key."""

from __future__ import annotations

from . import q_catalog, q_checks, q_graph, q_semantics, q_sources

_MODULES = (q_sources, q_catalog, q_semantics, q_graph, q_checks)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}

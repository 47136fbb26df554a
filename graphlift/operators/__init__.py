"""Profiling, enrichment, graph construction, checks and pattern queries."""

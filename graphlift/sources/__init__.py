"""Relational sources, reading patterns and graph sinks."""

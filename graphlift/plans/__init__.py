"""End-to-end plans: build a graph, reconcile it, and the registered queries."""

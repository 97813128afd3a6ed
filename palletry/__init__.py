"""Palletry: load-feasibility analytics and heuristic evaluation as Spark jobs."""

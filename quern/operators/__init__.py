"""Relational, graph, vector and pipeline operators."""

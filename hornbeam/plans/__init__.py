"""Whole queries: the lift of relational tables to a graph, and the registered queries with their SQL."""

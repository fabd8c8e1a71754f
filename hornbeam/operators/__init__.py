"""Relational operators of the rule engine: every one takes and returns DataFrames."""

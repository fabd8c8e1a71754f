"""Readers and writers: triples, rules, ontologies, configurations, logs and result tables."""

"""The schema's vetoes on small random graphs, against checks written from their definition."""

import random

import pytest
from pyspark.sql import functions as F
from test_rules import search

from hornbeam.operators import grounding, materialize, rules, semantic
from hornbeam.operators.schema import OWL, RDF_TYPE, RDFS, Schema
from hornbeam.sources.shared import written

TRIPLE = "s string, p string, o string"
RULE = "owns(X,Y) <= signed(X,A), covers(B,A), names(B,Y)"
DOMAIN, RANGE = "party", "asset"


def schema_of(spark, functional, inverse, types):
    rows = [("owns", RDF_TYPE, f"{OWL}ObjectProperty"), ("owns", f"{RDFS}domain", DOMAIN), ("owns", f"{RDFS}range", RANGE), (DOMAIN, f"{OWL}disjointWith", RANGE)]
    rows += [("owns", RDF_TYPE, f"{OWL}FunctionalProperty")] * functional + [("owns", RDF_TYPE, f"{OWL}InverseFunctionalProperty")] * inverse
    abox = spark.createDataFrame([(e, RDF_TYPE, c) for e, c in types.items()], TRIPLE)
    return Schema(spark.createDataFrame(rows, TRIPLE), abox)


def deal(seed):
    """A random graph of deeds: people sign papers, files cover papers and name things, and some things are owned."""
    rnd = random.Random(seed)
    pick = lambda kind, n: f"{kind}{rnd.randrange(n)}"
    triples = {(pick("ann", 9), "signed", pick("deed", 8)) for _ in range(14)} | {(pick("file", 6), "covers", pick("deed", 8)) for _ in range(10)}
    triples |= {(pick("file", 6), "names", pick("lot", 9)) for _ in range(9)} | {(pick("ann", 9), "owns", pick("lot", 9)) for _ in range(3)}
    types = {x: rnd.choice((DOMAIN, RANGE)) for x in sorted({e for s, _, o in triples for e in (s, o)}) if rnd.random() < 0.2}
    return sorted(triples), types


def allowed(side, anchor, found, triples, types, functional, inverse):
    """Whether all that is found for the anchor may be predicted."""
    one, other = (functional, inverse) if side == "obj" else (inverse, functional)
    own, far = (DOMAIN, RANGE) if side == "obj" else (RANGE, DOMAIN)
    known = {(s, o) if side == "obj" else (o, s) for s, p, o in triples if p == "owns"}
    clash = lambda x, cls: x in types and types[x] != cls
    if clash(anchor, own) or (one and (len(found) > 1 or any(a == anchor for a, _ in known))):
        return False
    return not any(clash(c, far) or (other and any(x == c and a != anchor for a, x in known)) for c in found)


@pytest.mark.parametrize(("functional", "inverse"), [(False, False), (True, False), (False, True), (True, True)])
def test_vetoes_are_those_of_the_definition(spark, functional, inverse):
    rule = rules.parse_rule(RULE, 0.5, 1)
    table, steps = rules.rule_table(spark, [rule]), rules.step_table(spark, [rule])
    kept = dropped = 0
    for seed in (11,):
        triples, types = deal(seed)
        graph, schema = spark.createDataFrame(triples, TRIPLE), schema_of(spark, functional, inverse, types)
        found = written(grounding.candidates(table, steps, grounding.adjacency(graph, steps), [3], 3).withColumn("head_p", F.lit("owns")), "found")
        want = set()
        for side in ("obj", "sub"):
            groups = {}
            for a, c in search(rule, side, triples):
                groups.setdefault(a, set()).add(c)
            for a, cs in groups.items():
                ok = allowed(side, a, cs, triples, types, functional, inverse)
                kept, dropped = kept + ok, dropped + (not ok)
                want |= {(side, a, c) for c in cs if ok}
        assert {(r["side"], r["anchor"], r["candidate"]) for r in semantic.consistent(found, schema, graph).collect()} == want
        # without the schema's engine nothing is dropped
        assert found.count() == len(search(rule, "obj", triples)) + len(search(rule, "sub", triples))
    assert kept + dropped >= 8 and (dropped or not functional + inverse)


def test_start_nodes_of_a_constant_are_checked_if_they_satisfy_the_body(spark):
    """owns(X,lot7) by a body of one step: owners who do not satisfy it are no matter, one who does takes all with him."""
    rule = rules.parse_rule("owns(X,lot7) <= signed(X,deed0)", 0.5, 1)
    table, steps = rules.rule_table(spark, [rule]), rules.step_table(spark, [rule])
    edges = [("ann1", "signed", "deed0"), ("ann4", "signed", "deed0"), ("ann3", "signed", "deed4"), ("ann3", "owns", "lot5")]
    for more, want in (([], {"ann1", "ann4"}), ([("ann4", "owns", "lot3")], set())):
        graph = spark.createDataFrame(edges + more, TRIPLE)
        found = written(grounding.candidates(table, steps, grounding.adjacency(graph, steps), [1], 1).withColumn("head_p", F.lit("owns")), "found")
        rows = semantic.consistent(found, schema_of(spark, True, False, {}), graph).collect()
        assert {r["candidate"] for r in rows if r["side"] == "sub"} == want


def test_a_pair_may_come_from_the_side_that_is_not_vetoed(spark):
    rule = rules.parse_rule(RULE, 0.5, 1)
    table, steps = rules.rule_table(spark, [rule]), rules.step_table(spark, [rule])
    edges = [("ann0", "signed", "deed0"), ("file0", "covers", "deed0"), ("file0", "names", "lot0"), ("file0", "names", "lot1"), ("file0", "names", "lot2")]
    graph, schema = spark.createDataFrame(edges, TRIPLE), schema_of(spark, True, False, {})
    rows = materialize.predictions(table, steps, graph, semantic.SemanticEngine(schema, graph), [3], 3)
    assert {(r["s"], r["o"]) for r in materialize.new_triples(rows, graph).collect()} == {("ann0", f"lot{i}") for i in range(3)}
    assert {r["side"] for r in rows.collect()} == {"sub"}

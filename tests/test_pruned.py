"""Materialization, vetoes and violations that leave out what cannot count."""

import pytest
from pyspark.sql import functions as F

from hornbeam.operators import grounding, materialize, rules, semantic, violations
from hornbeam.operators.codec import Codec
from hornbeam.plans import queries
from hornbeam.plans.graph import Graph

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture
def no_table(monkeypatch):
    """No table of all new triples is made."""

    def fail(self):
        raise AssertionError("a table of all new triples")

    monkeypatch.setattr(materialize.New, "table", fail)


def ground(spark, texts, triples):
    own = [rules.parse_rule(t, 0.5, i, i, pattern) for i, (t, pattern) in enumerate(texts, 1)]
    graph = spark.createDataFrame(triples, "s string, p string, o string")
    codec = Codec(graph.select("s").union(graph.select("o")), ["k/1"])
    return rules.rule_table(spark, own), rules.step_table(spark, own), codec, grounding.adjacency(codec.encode(graph, "s", "o"))


TEXTS = [
    ("h(X,Y) <= a(X,A), b(A,Y)", False), ("h(X,Y) <= a(X,A), b(A,B), a(B,Y)", False), ("h(X,k/1) <= a(X,A), b(A,k/1)", False), ("h(k/1,Y) <= b(Y,A)", False),
    ("h(X,Y) <= a(X,A), b(Y,A)", True), ("h(X,Y) <= b(X,A), b(A,Y)", False), ("h(X,Y) <= nothing(X,Y)", False),
]
TRIPLES = [("n/1", "a", "n/2"), ("n/2", "b", "n/2"), ("n/3", "a", "n/4"), ("n/4", "b", "k/1"), ("n/5", "a", "n/6"), ("n/6", "b", "n/7"), ("n/7", "a", "n/6"), ("n/7", "a", "n/8"), ("n/9", "b", "n/9"), ("n/9", "b", "n/1"), ("n/8", "b", "n/4")]


def test_groups_are_those_of_the_pairs(spark):
    table, steps, codec, adj = ground(spark, TEXTS, TRIPLES)
    want = grounding.candidates(table, steps, adj, [1, 2, 3], 20, codec=codec).select("rule_id", "side", "anchor").distinct()
    got = grounding.groups(table, steps, adj, codec)
    assert rows(got) == rows(want) and got.count() > 8
    every = rows(grounding.first_groups(table, steps, adj, codec))
    assert set(rows(want)) <= set(every)


def test_hops_to_constants_lead_to_these_alone(spark):
    _, steps, codec, adj = ground(spark, TEXTS, TRIPLES)
    step = [r for r in steps.collect() if r["literal"] is not None]
    _, hops = grounding._hops(adj, step, codec.code)
    assert hops.count() == 1


def test_target_without_all_triples(spark, no_table):
    g = Graph(spark, SF)
    table, steps, lengths, n = g.planned(g.own_rules())
    want = materialize.until_target(g.predicted(), g.train, 5000)  # in the last of five rules
    got = materialize.first_by_groups(table, steps, g.known, g.coded(*g.HEADS), lengths, n, 5000, g.codec)
    assert rows(got.select("s", "p", "o", "rule_rank")) == rows(want.select("s", "p", "o", "rule_rank"))
    assert queries.QUERIES["materialize_until_target"](spark, SF).count() == 1000


def test_stats_keep_no_triples(spark, no_table, monkeypatch):
    monkeypatch.setattr(materialize, "PART_ROWS", 8_000)
    monkeypatch.setattr(materialize, "TASKS", 4)
    want = materialize.new_triples(Graph(spark, SF).predicted(), Graph(spark, SF).train).groupBy("rule_rank").agg(F.count("*").alias("new"))
    assert rows(Graph(spark, SF).new().by_rule()) == rows(want)
    assert queries.QUERIES["materialize_stats"](spark, SF).count() == 1


def test_rules_that_cannot_violate_are_left_out(spark):
    g = Graph(spark, SF)
    kinds = {k: (sorted(r.rule_id for r in chosen), sorted(more)) for k in ("func", "invf", "dom", "ran") for chosen, more in [queries._predicted(g, k)]}
    assert kinds == {"func": ([2, 5, 6], ["placedBy"]), "invf": ([], ["placed"]), "dom": ([], ["placed"]), "ran": ([], ["placedBy"])}
    assert sorted(r.rule_id for r in g.vetoable()) == [2, 5, 6]
    new, base = queries._violating(g), queries._base(g)
    for kind, f in (("func", lambda n: violations.functional(n, base, g.coded_schema)), ("dom", lambda n: violations.domain(n, g.coded_schema, False))):
        assert rows(f(queries._violating(g, kind)).select("s", "p", "o")) == rows(f(new).select("s", "p", "o"))
    every = semantic.vetoed_groups(g.unchecked_codes(), g.coded_schema, g.coded(*g.HEADS))
    assert rows(semantic.vetoed_groups(g.unchecked_codes(2, 5, 6), g.coded_schema, g.flagged())) == rows(every)


def test_examples_without_all_triples(spark, no_table):
    assert queries.QUERIES["violation_examples"](spark, SF).count() == 20

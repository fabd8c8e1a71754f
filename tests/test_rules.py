"""Rule parsing and compilation, and grounding against a search written from the semantics."""

import itertools
import random

import numpy as np
import pytest

from hornbeam.operators import grounding, rules


def test_atoms_keep_brackets_in_terms():
    assert rules.parse_atom("p(X,http://e/f(g),h)") == rules.Atom("p", "X", "http://e/f(g),h")


def test_kinds_and_malformed_rows():
    kind = lambda t, **k: getattr(rules.parse_rule(t, 0.5, **k), "kind", None)
    assert kind("h(X,Y) <= a(X,A), b(A,Y)") == "binary" and kind("h(X,c1) <= a(X,A)") == "unary" and kind("h(X,Y) <= a(X,Y)", pattern=True) == "pattern"
    assert kind("h(X,Y) <= ") is None and kind("h(X,Y)") is None and kind("h X Y <= a(X,Y)") is None
    with pytest.warns(UserWarning):
        assert kind("h(X,Y) <= a(X,const)", pattern=True) is None


def test_confidence_is_a_smoothed_float_and_filtered():
    assert rules.smoothed(100, 42) == float(np.float32(0.4))
    loaded, bad = rules.load_rules([(1, 100, 42, 0, "h(X,Y) <= a(X,Y)"), (2, 2000, 1999, 0, "h(X,Y) <= b(X,Y)"), (3, 1, 1, 0, "broken")])
    assert [r.line_no for r in loaded] == [1] and bad == 1


def test_amie_rows():
    head = "Rule\tHead Coverage\tStd Confidence\tPCA Confidence\tPositive Examples\tBody size\tPCA Body size\tFunctional variable"
    lines = [head, "?a  <p>  ?c  ?c  <q>  ?b   => ?a  <h>  ?b\t0.1\t0.5\t0.6\t10\t20\t15\t?a", "?a  <p>  ?b   => ?a  <h>  ?b\t0.1\t1.0\t1\t9\t9\t9\t?a"]
    assert rules.amie_rows(lines) == [(20.0, 10.0, 0.5, "<h>(a,b) <= <p>(a,c), <q>(c,b)")]


def test_pattern_order_takes_the_first_reachable_atom_and_drops_the_rest():
    r = rules.parse_rule("h(X,Y) <= c(B,C), a(X,B), b(B,Y), z(P,Q)", 0.5, pattern=True)
    steps = [s for s in rules.compile_rule(r) if s[1] == "obj"]
    assert [(s[4], s[5]) for s in steps] == [("a", "F"), ("c", "F"), ("b", "F")]


def search(rule, side, triples):
    """Candidates by anchor, by depth-first search over the rule's body."""
    out, h = set(), rule.head
    nodes = sorted({x for t in triples for x in (t[0], t[2])})

    def path(at, atoms, reached, constants, done):
        if not atoms:
            done(reached)
            return
        node, var = at
        a = atoms[0]
        to, ends = (a.o, [o for s, p, o in triples if (s, p) == (node, a.p)]) if a.s == var else (a.s, [s for s, p, o in triples if (o, p) == (node, a.p)])
        for x in ends:
            if constants and len(to) > 1:
                if x == to:
                    path((x, to), atoms[1:], reached, constants, done)
            elif x not in [v for _, v in reached]:
                path((x, to), atoms[1:], [*reached, (to, x)], constants, done)

    def pattern(bound, atoms, done):
        a = next((a for a in atoms if a.s in bound or a.o in bound), None)
        if a is None:
            done(bound)
            return
        rest = [x for x in atoms if x is not a]
        for s, p, o in triples:
            if p == a.p and bound.get(a.s, s) == s and bound.get(a.o, o) == o:
                new = {k: v for k, v in ((a.s, s), (a.o, o)) if k not in bound}
                if not any(v in bound.values() for v in new.values()):
                    pattern(bound | new, rest, done)

    for n in nodes:
        if rule.kind == "pattern":
            start, end = (h.s, h.o) if side == "obj" else (h.o, h.s)
            pattern({start: n}, list(rule.body), lambda b, n=n, end=end: out.add((n, b[end])))
        elif rule.kind == "binary":
            start, end, body = (h.s, h.o, rule.body) if side == "obj" else (h.o, h.s, rule.body[::-1])
            path((n, start), list(body), [], False, lambda r, n=n, end=end: out.add((n, dict(r)[end])))
        else:
            var, const, const_side = (h.s, h.o, "obj") if len(h.s) == 1 else (h.o, h.s, "sub")
            path((n, var), list(rule.body), [], True, lambda r, n=n, c=const, cs=const_side: out.add((n, c) if side == cs else (c, n)))
    return out


TEXTS = ["h(X,Y) <= p(X,Y)", "h(X,Y) <= p(X,A), q(A,Y)", "h(X,Y) <= p(A,X), q(A,Y)", "h(X,Y) <= p(X,A), p(B,A), q(B,Y)", "h(X,e1) <= p(X,A), q(A,B)", "h(e2,Y) <= q(Y,e3)", "h(X,e1) <= p(A,X), q(A,e4)"]
PATTERNS = ["h(X,Y) <= p(X,A), q(A,Y), p(X,Y)", "h(X,Y) <= p(X,A), q(Y,A)", "h(X,Y) <= p(X,Y), q(X,A)"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_joins_find_what_the_search_finds(spark, seed):
    rnd = random.Random(seed)
    triples = sorted({(f"e{rnd.randint(0, 6)}", rnd.choice("pq"), f"e{rnd.randint(0, 6)}") for _ in range(26)})
    all_rules = [rules.parse_rule(t, 0.5, i) for i, t in enumerate(TEXTS)] + [rules.parse_rule(t, 0.5, 100 + i, pattern=True) for i, t in enumerate(PATTERNS)]
    graph = spark.createDataFrame([*triples, triples[0]], "s string, p string, o string")
    table, steps = rules.rule_table(spark, all_rules), rules.step_table(spark, all_rules)
    lengths = sorted({len(r.body) for r in all_rules})
    want = {(r.rule_id, side, *x) for r in all_rules for side in ("obj", "sub") for x in search(r, side, triples)}
    got = grounding.candidates(table, steps, grounding.adjacency(graph), lengths, 50)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    asked = [(r.rule_id, side, f"e{n}") for r, side, n in itertools.product(all_rules, ("obj", "sub"), (0, 1, 2))]
    some = grounding.candidates(table, steps, grounding.adjacency(graph), lengths, 50, spark.createDataFrame(asked, "rule_id int, side string, anchor string"))
    assert {tuple(r) for r in some.collect()} == {x for x in want if x[2] in ("e0", "e1", "e2")}

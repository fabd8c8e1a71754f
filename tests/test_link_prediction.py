"""Link prediction by groups of queries against a plain loop over queries, and the rows that it makes."""

from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hornbeam.operators import evaluate, rules, schema, semantic
from hornbeam.operators.codec import Codec
from hornbeam.sources.shared import shared_dir

KEEP = 100


def _graph(n: int = 150, queries: int = 12):
    """a: n subjects of x, b and c: further ones, h: known and held-out triples."""
    train = [(f"s{i}", "a", "x") for i in range(n)] + [(f"s{i}", "b", f"z{i % 7}") for i in range(0, 2 * n, 3)] + [(f"z{i}", "c", y) for i in range(7) for y in ("x", "y")[: 1 + i % 2]]
    train += [(f"s{i}", "h", "x") for i in range(1, 9)] + [("s3", "h", "y"), ("s300", "h", "y")]
    test = [(f"s{i}", "h", "x") for i in range(20, 20 + queries)] + [("s24", "h", "y"), ("s20", "h", "x"), ("s299", "h", "x"), ("nobody", "h", "y"), ("s1", "other", "x")]
    return train, test


def _brute(train, test, confs):
    """Per query and side: the raw order with confidences, the filtered one, and the target's block."""
    p = lambda name: [(s, o) for s, q, o in train if q == name]
    found = [set(p("a")), {(s, y) for s, z in p("b") for w, y in p("c") if z == w and s != y}]
    facts, order = {(s, o) for s, q, o in train + test if q == "h"}, sorted(range(2), key=lambda i: -confs[i])
    out = {}
    for s, q, o in set(test):
        for side, anchor, target in (("obj", s, o), ("sub", o, s)) if q == "h" else ():
            of = lambda i: {y if side == "obj" else x for x, y in found[i] if (x if side == "obj" else y) == anchor}  # noqa: E731, B023
            kept, seen = [], set()
            for i in order:
                kept.append(i)
                seen |= of(i)
                if side == "sub" and len(seen) >= KEEP + sum(y == anchor for _, y in facts):
                    break
            score = {c: sorted((confs[i] for i in kept if c in of(i)), reverse=True) for c in {c for i in kept for c in of(i)}}
            ranked = sorted(score, key=lambda c: ([-x for x in score[c]] + [1], c))
            free = [c for c in ranked if c == target or ((anchor, c) if side == "obj" else (c, anchor)) not in facts]
            block = {c: (1 + sum(score[x] > score[c] for x in free), sum(score[x] >= score[c] for x in free)) for c in free}
            out[f"{s}\t{q}\t{o}", side] = ranked, free, block, target
    return out


def _run(spark, confs, train, test, codec):
    own = [rules.parse_rule(t, c, i, i) for i, (t, c) in enumerate(zip(("h(X,Y) <= a(X,Y)", "h(X,Y) <= b(X,A), c(A,Y)"), confs, strict=True), 1)]
    frame = lambda rows: spark.createDataFrame(rows, "s string, p string, o string")
    parts = [frame(train), frame(train + test), frame(test)]
    codes = Codec(parts[1].select(F.explode(F.array("s", "o")))) if codec else None
    parts = [codes.encode(x, "s", "o") if codec else x for x in parts]
    return evaluate.LinkPrediction(rules.rule_table(spark, own), rules.step_table(spark, own), *parts, semantic.Engine(), [1, 2], 3, codes)


@pytest.mark.parametrize("confs, codec", [((0.5, 0.4), True), ((0.4, 0.5), False), ((0.5, 0.5), False)])
def test_groups_give_what_a_loop_over_queries_gives(spark, confs, codec):
    train, test = _graph()
    want, lp = _brute(train, test, confs), _run(spark, confs, train, test, codec)
    rows = lp.rows("name", "raw_rank").collect()
    assert sorted(map(tuple, rows)) == sorted((*k, c, i) for k, x in want.items() for i, c in enumerate(x[0], 1))
    assert sorted(map(tuple, lp.blocks().collect())) == sorted((*k, c, *x[2][c]) for k, x in want.items() for c in x[1])
    assert sorted(map(tuple, lp.rows("name", filtered=True).collect())) == sorted((*k, c) for k, x in want.items() for c in x[1])
    empty = schema.Schema(spark.createDataFrame([], "s string, p string, o string"))
    got = lp.metrics(empty).first()
    hits, mrr = Fraction(0), Fraction(0)
    for s, q, o in test:
        for side in ("obj", "sub"):
            _, _, block, target = want.get((f"{s}\t{q}\t{o}", side), ([], [], {}, None))
            if target in block:
                a, b = block[target]
                hits += Fraction(max(0, min(10, b) - a + 1), b - a + 1)
                mrr += sum(Fraction(1, r) for r in range(a, b + 1)) / (b - a + 1)
    n = 2 * len(test)
    assert got["total"] == n and abs(got["hits10"] - hits / n) < 1e-9 and abs(got["mrr"] - mrr / n) < 1e-9


def test_rows_are_not_made_for_each_query(spark):
    """300 queries share the subject side's group of 600 candidates."""
    train, test = _graph(600, 300)
    folder = Path(shared_dir(spark).removeprefix("file://"), "hornbeam")
    before = {*folder.glob("lp-*")}
    _run(spark, (0.5, 0.4), train, test, False).metrics(schema.Schema(spark.createDataFrame([], "s string, p string, o string"))).collect()
    made = sum(spark.read.parquet(f"file://{x}").count() for x in {*folder.glob("lp-*")} - before)
    assert made < 10_000

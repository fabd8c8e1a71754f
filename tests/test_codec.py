"""Entities as codes: names come back exactly, and rules find the same over codes as over names."""

from pyspark.sql import functions as F

from hornbeam.operators import codec, grounding, rules

NAMES = ["order/0", "order/17", "order/017", "order/", "17", "0", "", "a b/9999999999999", "x/12345678901234", "nation/é7", "line\n3", "order/-5", None]


def test_names_come_back(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    c = codec.Codec(names, ["absent/1"])
    coded = c.encode(names.withColumn("was", F.col("name")), "name")
    assert dict(coded.dtypes)["name"] == "bigint" and coded.select("name").distinct().count() == len(NAMES)
    rows = c.decode(coded.withColumn("code", F.col("name")), "name").collect()
    assert sorted(str(r["name"]) for r in rows) == sorted(map(str, NAMES)) and all(r["name"] == r["was"] for r in rows)
    assert all(c.code(r["was"]) == r["code"] for r in rows if r["was"] is not None)


def test_rules_over_codes(spark):
    """Both sides of a path come from one plan, checked at each side by itself: X may not meet the middle at sub, nor Y at obj."""
    triples = spark.createDataFrame([("e1", "p", "e1"), ("e1", "q", "e2"), ("e2", "p", "e3"), ("e3", "q", "e3"), ("e2", "p", "e4"), ("e4", "q", "e1")], "s string, p string, o string")
    some = [rules.parse_rule("h(X,Y) <= p(X,A), q(A,Y)", 0.5, 1), rules.parse_rule("h(X,e9) <= p(X,e4)", 0.4, 2)]
    table, steps = rules.rule_table(spark, some), rules.step_table(spark, some)
    c = codec.Codec(triples.select(F.explode(F.array("s", "o"))), ["e9", "e4"])
    found = grounding.candidates(table, steps, grounding.adjacency(c.encode(triples, "s", "o")), [1, 2], 3, codec=c)
    assert [p.side for p in grounding.plans(steps, True)] == ["both", "body"]
    want = {(1, "obj", "e1", "e2"), (1, "sub", "e3", "e2"), (1, "obj", "e2", "e1"), (1, "sub", "e1", "e2"), (2, "obj", "e2", "e9"), (2, "sub", "e9", "e2")}
    assert {tuple(r) for r in c.decode(found, "anchor", "candidate").collect()} == want

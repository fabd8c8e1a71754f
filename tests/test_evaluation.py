"""Ranking, tie blocks, cuts and data tools by hand-computed results."""

from pyspark.sql import functions as F

from hornbeam.functions import expected_hits, expected_reciprocal_rank
from hornbeam.operators import materialize, ranking, rules, schema, tools, violations


def test_ranking_prefers_the_longer_list_on_a_common_prefix(spark):
    rows = [("q", "obj", n, c) for n, c in (("w", [0.9]), ("x", [0.9, 0.5]), ("y", [0.95]), ("z", [0.9, 0.6, 0.1]))]
    table = spark.createDataFrame(rows, "qid string, side string, candidate string, confs array<float>")
    assert [r[0] for r in ranking.ranked(table).orderBy("raw_rank").select("candidate").collect()] == ["y", "z", "x", "w"]


def test_expected_metrics_of_a_tie_block(spark):
    rows = [("q", "obj", n, c) for n, c in (("A", [0.9]), ("B", [0.9]), ("C", [0.5]))]
    table = spark.createDataFrame(rows, "qid string, side string, candidate string, confs array<float>")
    block = ranking.tie_blocks(table).filter("candidate = 'B'")
    a, b = F.col("block_start"), F.col("block_end")
    assert tuple(block.select(expected_hits(a, b, 1), expected_hits(a, b, 5), expected_reciprocal_rank(a, b)).first()) == (0.5, 1.0, 0.75)


def test_early_stop_keeps_the_rule_that_reaches_the_limit(spark):
    rows = [("q", f"c{i}", rank) for rank, n in ((1, 3), (2, 5), (3, 9)) for i in range(n)]
    cands = spark.createDataFrame(rows, "qid string, candidate string, rule_rank int")
    queries = spark.createDataFrame([("q", "p", "a")], "qid string, head_p string, anchor string")
    known = spark.createDataFrame([("p", "a", 1)], "head_p string, anchor string, subjects long")
    assert ranking.stopped(cands, queries, known, 4).agg(F.max("rule_rank")).first()[0] == 2
    assert ranking.stopped(cands, queries, known, 50).agg(F.max("rule_rank")).first()[0] == 3


def test_top_rules_rounds_up(spark):
    table = rules.rule_table(spark, [rules.parse_rule(f"h(X,Y) <= p{i}(X,Y)", i / 100, i, i) for i in range(45)])
    assert materialize.top_rules(table, 10, 45).count() == 5


def test_violation_share(spark):
    triples = spark.createDataFrame([("a", "p", "b"), ("a", "p", "c"), ("d", "p", "e"), ("f", "q", "g")], "s string, p string, o string")
    tbox = [("p", schema.RDF_TYPE, f"{schema.OWL}FunctionalProperty"), ("p", f"{schema.RDFS}domain", "x"), ("x", f"{schema.OWL}disjointWith", "y")]
    abox = [("d", schema.RDF_TYPE, "y")]
    frame = lambda rows: spark.createDataFrame(rows, "s string, p string, o string")
    row = violations.counts(triples, triples.limit(0), schema.Schema(frame(tbox), frame(abox))).first()
    assert (row["triples"], row["func"], row["invf"], row["dom"], row["ran"], row["inc"], row["sem"]) == (4, 2, 0, 1, 0, 3, 0.25)
    empty = violations.counts(triples.limit(0), triples, schema.Schema(frame(tbox), frame(abox))).first()
    assert empty["triples"] == 0 and empty["sem"] is None


def test_inverse_of_functional_is_inverse_functional(spark):
    tbox = [("p", schema.RDF_TYPE, f"{schema.OWL}FunctionalProperty"), ("p", f"{schema.OWL}inverseOf", "i"), ("i", f"{schema.RDFS}domain", "_:u")]
    rows = {r["p"]: r for r in schema.constraints(spark.createDataFrame(tbox, "s string, p string, o string")).collect()}
    assert rows["i"]["inverse_functional"] and not rows["i"]["functional"] and rows["i"]["domain"] == [] and rows["p"]["functional"]


def test_flip_and_split(spark):
    t = spark.createDataFrame([("s", "birthPlace", "o"), ("s", "x", "o")], "s string, p string, o string")
    assert sorted(map(tuple, tools.flip(t, {"birthPlace": "birthPlaceOf"}).collect())) == [("o", "birthPlaceOf", "s"), ("s", "x", "o")]
    many = spark.range(1000).select(F.col("id").cast("string").alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"))
    parts = [x.count() for x in tools.split(many)]
    assert sum(parts) == 1000 and 700 < parts[0] < 900
    tbox = spark.createDataFrame([("p", f"{schema.RDFS}domain", "d"), ("p", schema.RDF_TYPE, f"{schema.OWL}FunctionalProperty")], "s string, p string, o string")
    assert sorted(map(tuple, tools.flip_tbox(tbox, {"p": "i"}).collect())) == [("i", schema.RDF_TYPE, f"{schema.OWL}InverseFunctionalProperty"), ("i", f"{schema.RDFS}range", "d")]

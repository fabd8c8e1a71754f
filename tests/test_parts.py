"""Materialization part by part over codes that are worked out from keys."""

from pyspark.sql import functions as F

from hornbeam.operators import materialize, semantic
from hornbeam.plans.graph import Graph
from hornbeam.sources.shared import written

SF = "/root/testdata/sf0.001"
EDGES = ("placedBy", "hasPart", "suppliedBy", "brand", "segment", "did")


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_codes_of_keys_are_those_of_names(spark):
    g = Graph(spark, SF)
    names = g.train.filter(F.col("p").isin(list(EDGES)))
    assert rows(g.codec.decode(g.coded(*EDGES).distinct(), "s", "o").select("s", "p", "o")) == rows(names)
    assert rows(g.coded(*EDGES).distinct()) == rows(g.codec.encode(names, "s", "o").select("s", "p", "o"))


def test_keys_that_are_no_numbers_of_names(spark, tmp_path):
    for t in ("customer", "supplier", "nation", "orders", "lineitem", "part", "events"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "customer":
            df = df.withColumn("c_custkey", F.when(F.col("c_custkey") == 3, -3).when(F.col("c_custkey") == 4, None).otherwise(F.col("c_custkey")))
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    g = Graph(spark, str(tmp_path))
    got = g.codec.decode(g.coded("custNation", "placedBy").distinct(), "s", "o").select("s", "p", "o")
    assert ("customer", "c_custkey") not in g.keyed.numbers and ("orders", "o_custkey") in g.keyed.numbers
    assert rows(got) == rows(g.train.filter("p IN ('custNation', 'placedBy')").distinct())


def test_parts_make_the_whole(spark, monkeypatch):
    monkeypatch.setattr(materialize, "PART_ROWS", 8_000)
    monkeypatch.setattr(materialize, "TASKS", 4)
    g = Graph(spark, SF)
    want = materialize.new_triples(g.predicted(), g.train)
    new = g.new_codes()
    assert rows(g.codec.decode(new, "s", "o").select("s", "p", "o", "rule_rank")) == rows(want.select("s", "p", "o", "rule_rank"))
    cands = written(g.predicted().select("rule_id", "side", "anchor", "candidate", "head_p", "rule_rank").distinct(), "names")
    coded = written(g.unchecked_codes(), "codes")
    assert rows(g.codec.decode(coded, "anchor", "candidate").select(cands.columns)) == rows(cands)
    of_codes = semantic.vetoed_groups(coded, g.coded_schema, g.coded(*g.HEADS))
    assert rows(g.codec.decode(of_codes, "anchor").select(*semantic.GROUP)) == rows(semantic.vetoed_groups(cands, g.schema, g.train).select(*semantic.GROUP))
    assert {r[0] for r in g.firing().collect()} == {r[0] for r in cands.select("rule_id").distinct().collect()}

"""Schema checks as semi and anti joins.

A (rule, side, anchor) whose anchor breaks the schema is not asked at all (query check), and one of whose candidates
any breaks it loses all of them (veto). Checks are per side: what one side loses the other may still predict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.operators.grounding import in_part, small
from hornbeam.operators.schema import Schema, type_conflicts
from hornbeam.sources.shared import drop, release, written

GROUP = ["rule_id", "side", "anchor"]
#: One in so many candidates is tried for violations before the others are.
TRIED = 16


def _flags(schema: Schema) -> DataFrame:
    return schema.constraints.select(F.col("p").alias("head_p"), "functional", "inverse_functional")


def violates_domain(pairs: DataFrame, schema: Schema) -> DataFrame:
    """entity, p of pairs (entity, p) where a type of the entity is disjoint with a domain of p."""
    return type_conflicts(pairs.select(F.col("entity").alias("node"), "p"), schema.types, schema.domain).withColumnRenamed("node", "entity")


def violates_range(pairs: DataFrame, schema: Schema) -> DataFrame:
    return type_conflicts(pairs.select(F.col("entity").alias("node"), "p"), schema.types, schema.range).withColumnRenamed("node", "entity")


def _other_end(triples: DataFrame, graph: DataFrame, flagged: DataFrame, end: str, many: str) -> DataFrame:
    """The rows of triples with a flagged p for which graph has another `many` at the same `end`. The least and the greatest
    say so, and sums of these combine before the shuffle, however many rows an end has."""
    ends = graph.join(flagged, "p", "left_semi").groupBy("p", end).agg(F.min(many).alias("low"), F.max(many).alias("high"))
    found = triples.join(flagged, "p", "left_semi").join(ends, ["p", end])
    return found.filter((F.col("low") != F.col(many)) | (F.col("high") != F.col(many))).select(triples.columns)


def violates_functionality(triples: DataFrame, graph: DataFrame, schema: Schema) -> DataFrame:
    """The rows of triples (s, p, o) whose functional p has another object for s in graph."""
    return _other_end(triples, graph, schema.constraints.filter("functional").select("p"), "s", "o")


def violates_inverse_functionality(triples: DataFrame, graph: DataFrame, schema: Schema) -> DataFrame:
    """The rows of triples whose inverse functional p has another subject for o in graph."""
    return _other_end(triples, graph, schema.constraints.filter("inverse_functional").select("p"), "o", "s")


def rejected_queries(queries: DataFrame, schema: Schema, graph: DataFrame) -> DataFrame:
    """anchor, side, head_p of the queries (anchor, side, head_p) that the schema rules out: the anchor's types are
    disjoint with the domain (side obj) or range (sub), or the anchor already has the one value that p allows."""
    q = queries.select("anchor", "side", "head_p").distinct()
    nodes = lambda side: q.filter(F.col("side") == side).select(F.col("anchor").alias("node"), F.col("head_p").alias("p"))
    out = []
    for side, classes, flag, end in (("obj", schema.domain, "functional", "s"), ("sub", schema.range, "inverse_functional", "o")):
        typed = schema.conflicting(nodes(side), "node", "p", classes)
        one = nodes(side).join(schema.constraints.filter(flag).select("p"), "p", "left_semi")
        has = one.join(graph.select(F.col(end).alias("node"), "p").distinct(), ["node", "p"], "left_semi")
        out.append(typed.unionByName(has).select(F.col("node").alias("anchor"), F.lit(side).alias("side"), F.col("p").alias("head_p")))
    return out[0].unionByName(out[1]).distinct()


def valid_queries(queries: DataFrame, schema: Schema, graph: DataFrame) -> DataFrame:
    return queries.join(rejected_queries(queries, schema, graph), ["anchor", "side", "head_p"], "left_anti")


def vetoed_groups(cands: DataFrame, schema: Schema, graph: DataFrame) -> DataFrame:
    """rule_id, side, anchor of the groups of cands (rule_id, side, anchor, candidate, head_p) that hold a violation."""
    c = cands.join(F.broadcast(_flags(schema)), "head_p")
    single = F.when(F.col("side") == "obj", F.col("functional")).otherwise(F.col("inverse_functional"))
    # more than one value where one is allowed
    many = c.filter(single).groupBy(*GROUP).agg(F.min("candidate").alias("low"), F.max("candidate").alias("high")).filter("low < high").select(*GROUP)
    # a candidate whose one place is taken by another than the anchor
    obj = c.filter("side = 'obj' AND inverse_functional").alias("c")
    taken_obj = obj.join(graph.alias("g"), F.expr("c.candidate = g.o AND c.head_p = g.p AND c.anchor <> g.s"), "left_semi").select(*GROUP)
    sub = c.filter("side = 'sub' AND functional").alias("c")
    taken_sub = sub.join(graph.alias("g"), F.expr("c.candidate = g.s AND c.head_p = g.p AND c.anchor <> g.o"), "left_semi").select(*GROUP)
    out = many.unionByName(taken_obj).unionByName(taken_sub)
    for side, classes in (("obj", schema.range), ("sub", schema.domain)):
        own = c.filter(F.col("side") == side)
        out = out.unionByName(schema.conflicting(own, "candidate", "head_p", classes).select(*GROUP))
    return out.distinct()


def consistent(cands: DataFrame, schema: Schema, graph: DataFrame) -> DataFrame:
    """cands without the groups whose query is rejected or that hold a violation."""
    asked = valid_queries(cands, schema, graph)
    return asked.join(vetoed_groups(asked, schema, graph), GROUP, "left_anti")


def consistent_table(cands: DataFrame, schema: Schema, graph: DataFrame) -> DataFrame:
    """consistent() as a table, for many candidates: each step's rows are kept, and a violation among some candidates already
    says that the whole group goes, so that of large groups few rows are checked."""
    asked = written(valid_queries(cands, schema, graph), "valid")
    release(cands.sparkSession)
    some = written(vetoed_groups(asked.filter(in_part("candidate", (0, TRIED))), schema, graph), "vetoed")
    left = written(asked.join(small(some, some.count()), GROUP, "left_anti"), "not-vetoed")
    out = written(left.join(vetoed_groups(left, schema, graph), GROUP, "left_anti"), "consistent")
    for df in (asked, some, left):
        drop(df)
    release(cands.sparkSession)
    return out


class Engine:
    """The standard engine: no checks. Hooks: which queries are asked, and which candidates stay."""

    name = "standard"
    #: whether kept() reads its rows more than once
    reads_again = False

    def asked(self, queries: DataFrame) -> DataFrame:
        return queries

    def kept(self, cands: DataFrame) -> DataFrame:
        return cands


class SemanticEngine(Engine):
    name = "semantic"
    reads_again = True

    def __init__(self, schema: Schema, graph: DataFrame):
        self.schema, self.graph = schema, graph

    def asked(self, queries: DataFrame) -> DataFrame:
        return valid_queries(queries, self.schema, self.graph)

    def vetoed(self, cands: DataFrame) -> DataFrame:
        """rule_id, side, anchor of groups that hold a violation among cands, which may be some of their candidates."""
        return vetoed_groups(cands, self.schema, self.graph)

    def kept(self, cands: DataFrame) -> DataFrame:
        return consistent(cands, self.schema, self.graph)

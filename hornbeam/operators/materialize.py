"""Materialization: the new triples of the best rules, for every entity and both sides, in one pass."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornbeam.operators import grounding, ranking, semantic
from hornbeam.operators.codec import Codec
from hornbeam.sources.shared import local, new_path, release, written

#: A graph is materialized in as many parts of its subjects as it has times so many triples, so that the shuffle files of
#: one part are there at a time. A part's rows are dealt to TASKS tasks.
PART_ROWS, TASKS = 16_000_000, 64
#: So many groups of a rule, at most, are asked one after the other until a target is reached.
GROUPS = 1_000_000


def top_rules(rules: DataFrame, percent: float, n: int) -> DataFrame:
    """The first ceil(n * percent / 100) rules in order of confidence."""
    return rules.filter(F.col("rule_rank") <= math.ceil(n * percent / 100))


def predictions(rules: DataFrame, steps: DataFrame, graph: DataFrame, engine: semantic.Engine, lengths: list[int], n_steps: int, codec: Codec | None = None) -> DataFrame:
    """rule_id, rule_rank, side, anchor, candidate, s, p, o: all that the rules predict, after the engine's checks, once or more.
    codec: that of the graph's names."""
    chosen = steps.join(grounding.small(rules.select("rule_id"), n_steps), "rule_id", "left_semi")
    found = grounding.pairs(rules, chosen, grounding.adjacency(graph, chosen), lengths, n_steps, codec=codec)
    if engine.reads_again:
        found = written(found, "predictions")
    found = grounding.sides(found).join(grounding.small(rules.select("rule_id", "head_p", "rule_rank"), n_steps), "rule_id")
    return ranking.as_facts(engine.kept(found))


def _first(predicted: DataFrame, facts: DataFrame) -> DataFrame:
    """s, p, o, rule_rank of the first rule, and by_obj, by_sub of the first at each side: predicted triples that are not known.
    Known triples go through the same aggregation, so that nothing is sorted or shuffled twice."""
    rank, none = F.col("rule_rank").cast("int"), F.lit(None).cast("int")
    by = lambda side: F.when(F.col("side") == side, rank)
    rows = predicted.select("s", "p", "o", by("obj").alias("by_obj"), by("sub").alias("by_sub"), F.lit(False).alias("known"))
    known = facts.filter("s IS NOT NULL AND o IS NOT NULL").select("s", "p", "o", none.alias("by_obj"), none.alias("by_sub"), F.lit(True).alias("known"))
    each = rows.unionByName(known).groupBy("s", "p", "o").agg(F.min("by_obj").alias("by_obj"), F.min("by_sub").alias("by_sub"), F.max("known").alias("known"))
    return each.filter("NOT known").withColumn("rule_rank", F.least("by_obj", "by_sub")).drop("known")


def _parts(*graphs: DataFrame) -> list[tuple[int, int] | None]:
    parts = math.ceil(sum(g.count() for g in graphs) / PART_ROWS)
    return [None] if parts <= 1 else [(k, parts) for k in range(parts)]


def _by_parts(parts: list, of: Callable, name: str, spark: SparkSession) -> DataFrame:
    """The frames of(part) as one table, one made after the other; part is None if one is enough. Each triple is of one part, by its s."""
    if parts == [None]:
        return written(of(None), name)
    path = new_path(spark, name)
    for part in parts:
        rows = of(part)
        rows.write.mode("append").parquet(path)
        schema = rows.schema
        del rows
        release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.hornbeam_path = path
    return out


def _dealt(rows: DataFrame, part: tuple[int, int] | None, *keys: str) -> DataFrame:
    """rows by keys, if they are a part's: nearly all of them differ, so that combining them before the shuffle only spills."""
    return rows.repartition(max(TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys) if part else rows


class New:
    """The new triples of the standard engine, part by part. facts: known triples of the heads. more: further predicted
    pairs (s, o) by head, as of a rank 0 at obj. checked: side, anchor, candidate, head_p and rule_rank of other rules with
    the heads checked_heads, after an engine's checks."""

    def __init__(self, rules: DataFrame, steps: DataFrame, graph: DataFrame, facts: DataFrame, lengths: list[int], n_steps: int, codec: Codec, more: dict[str, DataFrame], checked: DataFrame | None = None, checked_heads: tuple[str, ...] = ()):
        self.rules, self.steps, self.facts, self.lengths, self.n_steps, self.codec, self.more, self.checked = rules, steps, facts, lengths, n_steps, codec, more, checked
        spark = self.spark = graph.sparkSession
        self.own = rules.select("rule_id", "head_p", F.col("rule_rank").cast("int").alias("rank")).collect()
        self.heads = sorted({r["head_p"] for r in self.own} | {*more, *checked_heads})
        self.ranks = local(spark, [(r["rule_id"], self.heads.index(r["head_p"]), r["rank"]) for r in self.own], "rule_id int, head int, rank int")
        self.named = local(spark, list(enumerate(self.heads)), "head int, p string")
        self.adj = grounding.adjacency(graph, steps)
        self.parts = _parts(self.adj, *more.values())

    def of(self, part: tuple[int, int] | None) -> DataFrame:
        """head (its place), s, o, by_obj, by_sub of a part."""
        some = lambda df: df.filter(grounding.in_part("s", part)) if part else df
        found = grounding.pairs(self.rules, self.steps, self.adj, self.lengths, self.n_steps, codec=self.codec, part=part).join(grounding.small(self.ranks, len(self.own)), "rule_id")
        at = lambda bit: F.when(F.col("ok").bitwiseAND(F.lit(bit)) != 0, F.col("rank"))
        rows = [found.select("head", "s", "o", at(1).alias("by_obj"), at(2).alias("by_sub"))]
        rows += [some(df).select(F.lit(self.heads.index(p)).alias("head"), "s", "o", F.lit(0).alias("by_obj"), F.lit(None).cast("int").alias("by_sub")) for p, df in self.more.items()]
        if self.checked is not None:
            kept, by = ranking.as_facts(self.checked), lambda side: F.when(F.col("side") == side, F.col("rule_rank").cast("int"))
            kept = some(kept).join(grounding.small(self.named, len(self.heads)), "p")
            rows.append(kept.select("head", "s", "o", by("obj").alias("by_obj"), by("sub").alias("by_sub")))
        known = some(self.facts.filter("s IS NOT NULL AND o IS NOT NULL")).join(grounding.small(self.named, len(self.heads)), "p")
        rows.append(known.select("head", "s", "o", F.lit(-1).alias("by_obj"), F.lit(-1).alias("by_sub")))
        each = _dealt(reduce(DataFrame.unionByName, rows), part, "s", "o").groupBy("head", "s", "o").agg(F.min("by_obj").alias("by_obj"), F.min("by_sub").alias("by_sub"))
        return each.filter(F.least("by_obj", "by_sub") >= 0)

    def table(self) -> DataFrame:
        """s, p, o, by_obj and by_sub, the rank of the first rule at each side, as a table."""
        # in order, so that the table is small
        made = _by_parts(self.parts, lambda part: self.of(part).sortWithinPartitions("head", "s", "o"), "new-triples", self.spark)
        return made.join(grounding.small(self.named, len(self.heads)), "head").select("s", "p", "o", "by_obj", "by_sub", F.least("by_obj", "by_sub").alias("rule_rank"))

    def by_rule(self) -> DataFrame:
        """rule_rank and new, how many triples a rule is the first to add: counted part by part, so that they are not kept."""
        counts: Counter = Counter()
        for part in self.parts:
            rows = self.of(part).groupBy(F.least("by_obj", "by_sub").alias("rule_rank")).count()
            counts.update({r["rule_rank"]: r["count"] for r in rows.collect()})
            del rows
            release(self.spark)
        return local(self.spark, sorted(counts.items()), "rule_rank int, new long")


def new_table(rules: DataFrame, steps: DataFrame, graph: DataFrame, facts: DataFrame, lengths: list[int], n_steps: int, codec: Codec, more: dict[str, DataFrame]) -> DataFrame:
    """s, p, o, by_obj, by_sub and rule_rank of New, as a table."""
    return New(rules, steps, graph, facts, lengths, n_steps, codec, more).table()


def pair_table(rules: DataFrame, steps: DataFrame, graph: DataFrame, lengths: list[int], n_steps: int, codec: Codec) -> DataFrame:
    """rule_id, s, o and ok, distinct, of all that the rules predict without checks, as a table."""
    adj = grounding.adjacency(graph, steps)

    def of(part: tuple[int, int] | None) -> DataFrame:
        rows = _dealt(grounding.pairs(rules, steps, adj, lengths, n_steps, codec=codec, part=part), part, "s", "o")
        return rows.groupBy("rule_id", "s", "o").agg(F.bit_or("ok").alias("ok")).sortWithinPartitions("rule_id", "s", "o")

    return _by_parts(_parts(adj), of, "pairs", graph.sparkSession)


def firing(rules: DataFrame, steps: DataFrame, graph: DataFrame, lengths: list[int], n_steps: int, codec: Codec) -> DataFrame:
    """rule_id of the rules that predict anything, without checks: part by part, each of the rules that have not yet."""
    spark, adj = graph.sparkSession, grounding.adjacency(graph, steps)
    parts, found = math.ceil(adj.count() / PART_ROWS), set()
    for k in range(max(parts, 1)):
        left = steps.filter(~F.col("rule_id").isin(sorted(found)))
        rows = grounding.pairs(rules, left, adj, lengths, n_steps, codec=codec, part=(k, parts) if parts > 1 else None)
        found |= {r[0] for r in rows.select("rule_id").distinct().collect()}
        release(spark)
    return local(spark, [(r,) for r in sorted(found)], "rule_id int")


def new_triples(predicted: DataFrame, facts: DataFrame) -> DataFrame:
    """s, p, o, rule_rank of the first rule that predicts it: predicted triples that are not known."""
    return _first(predicted, facts).select("s", "p", "o", "rule_rank")


def until_target(predicted: DataFrame, facts: DataFrame, target: int) -> DataFrame:
    """s, p, o, rule_rank: new triples in order of (rule, anchor, side obj before sub, candidate) up to `target` of them.
    A rule's new triples are counted first, so that only the one rule in which the target is reached is ordered."""
    return first_until(_first(predicted, facts), target, lambda upto: _first(predicted.filter(F.col("rule_rank") <= upto), facts))


def first_until(first: DataFrame, target: int, again: Callable | None = None, codec: Codec | None = None) -> DataFrame:
    """until_target() of the new triples first (s, p, o, rule_rank, by_obj, by_sub). again: makes them anew without the rules
    after a rank. codec: that of the names, which are in the order of names."""
    upto = first.groupBy("rule_rank").agg(F.count("*").alias("new")).withColumn("upto", F.sum("new").over(Window.orderBy("rule_rank")))
    upto = written(upto, "new-by-rule")  # a row for each rule
    crossing = upto.filter((F.col("upto") > target) & (F.col("upto") - F.col("new") < target)).first()
    if crossing is not None and again:  # later rules have no part
        first = again(crossing["rule_rank"])
    named = lambda rows: codec.decode(rows, "s", "o") if codec else rows
    whole = named(first.join(F.broadcast(upto.filter(F.col("upto") <= target)), "rule_rank", "left_semi").select("s", "p", "o", "rule_rank"))
    if crossing is None:
        return whole
    place = lambda side, anchor, candidate: F.when(F.col(f"by_{side}") == F.col("rule_rank"), F.struct(F.col(anchor).alias("anchor"), F.lit(side).alias("side"), F.col(candidate).alias("candidate")))
    before = crossing["upto"] - crossing["new"]
    some = named(first.filter(F.col("rule_rank") == crossing["rule_rank"])).orderBy(F.least(place("obj", "s", "o"), place("sub", "o", "s"))).limit(target - before).select("s", "p", "o", "rule_rank")
    return whole.unionByName(some) if before else some


def first_by_groups(rules: DataFrame, steps: DataFrame, graph: DataFrame, facts: DataFrame, lengths: list[int], n_steps: int, target: int, codec: Codec) -> DataFrame | None:
    """until_target() rule by rule, without making all triples: a rule's groups (anchor, side) are taken in order, ever more
    of them, until the target is reached among their triples; a triple of a later group alone comes after all of these.
    None if more than GROUPS groups of a rule would be asked: then the triples are made by parts."""
    adj, left, taken = grounding.adjacency(graph, steps), target, None
    key = ["s", "p", "o"]
    for r in rules.orderBy("rule_rank").select("rule_id", "head_p", "rule_rank").collect():
        own, own_steps = rules.filter(F.col("rule_id") == r["rule_id"]), steps.filter(F.col("rule_id") == r["rule_id"])
        order = grounding.first_groups(own, own_steps, adj, codec).withColumn("name", F.col("anchor"))
        order, k = codec.decode(order, "name").orderBy("name", "side"), max(target, 1)
        while left > 0:
            asked = written(order.limit(k), "first-groups")
            last = asked.count() < k
            found = grounding.candidates(own, own_steps, adj, lengths, n_steps, asked.select("rule_id", "side", "anchor"), codec)
            found = written(ranking.as_facts(found.withColumn("head_p", F.lit(r["head_p"]))).select("side", "anchor", "candidate", *key), "first-found")
            some = found.select(*key).distinct()
            known = facts.join(grounding.small(some, found.count()), key, "left_semi").select(*key)
            known = known.unionByName(codec.encode(taken.select(*key), "s", "o")) if taken is not None else known
            named = codec.decode(found.join(known, key, "left_anti"), "anchor", "candidate")
            first = named.groupBy(*key).agg(F.min(F.struct("anchor", "side", "candidate")).alias("place"))
            first = written(codec.decode(first, "s", "o").withColumn("rule_rank", F.lit(r["rule_rank"])).orderBy("place").limit(left).select(*key, "rule_rank"), "first-new")
            n = first.count()
            if n == left or last:
                taken, left = first if taken is None else taken.unionByName(first), left - n
                break
            k *= 16
            if k > GROUPS:
                return None
        if left == 0:
            break
    return taken


def stats(rules: DataFrame, predicted: DataFrame, new: DataFrame) -> DataFrame:
    """One row: processed, with_predictions, without_predictions, applied (rules that add a triple first), triples."""
    return stats_of(rules, predicted, new.groupBy("rule_rank").agg(F.count("*").alias("new")))


def stats_of(rules: DataFrame, predicted: DataFrame, by_rule: DataFrame) -> DataFrame:
    """stats() from by_rule: rule_rank, and new, how many triples the rule is the first to add."""
    firing = predicted.select("rule_id").distinct()
    processed = rules.agg(F.count("*").alias("processed"))
    with_ = firing.agg(F.count("*").alias("with_predictions"))
    added = by_rule.agg(F.count("*").alias("applied"), F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("triples"))
    return processed.crossJoin(with_).crossJoin(added).withColumn("without_predictions", F.col("processed") - F.col("with_predictions"))

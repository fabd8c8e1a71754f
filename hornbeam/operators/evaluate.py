"""Link prediction: ranked candidates of both sides of test triples, and their metrics.

Queries with one side, anchor and head predicate are a group. Its candidates, early stop, scores, ranks and known facts
are worked out once, however many queries it has, in one shuffle by group; what a query's own target changes is added
where rows of queries are wanted.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornbeam.functions import expected_hits, expected_reciprocal_rank
from hornbeam.operators import grounding, ranking, semantic
from hornbeam.operators.codec import Codec
from hornbeam.operators.schema import Schema
from hornbeam.sources.shared import local, written

#: Marks of a candidate that are no places of rules: a fact, a train triple, a target.
FACT, TRAIN, TARGET = -1, -2, -3
#: Rules of one head whose places are bits of a number; of more, or with equal confidences, they are lists.
BITS = 60
#: Groups in a partition, and queries a group from which its rows are dealt out anew before they are repeated for each query.
GROUPS, FAN = 2_048, 16
#: One in so many values of the last step is tried first by an engine with vetoes.
TRIED = 16


def queries(test: DataFrame, codec: Codec | None = None) -> DataFrame:
    """qid, side, anchor, head_p, target: two for each test triple (s, p, o); qid is the same for equal queries with equal targets."""
    named = test.select("s", "p", "o", F.col("s").alias("_s"), F.col("o").alias("_o"))
    named = (codec.decode(named, "_s", "_o") if codec else named).withColumn("qid", F.concat_ws("\t", "_s", "p", "_o"))
    obj = named.select("qid", F.lit("obj").alias("side"), F.col("s").alias("anchor"), F.col("p").alias("head_p"), F.col("o").alias("target"))
    sub = named.select("qid", F.lit("sub").alias("side"), F.col("o").alias("anchor"), F.col("p").alias("head_p"), F.col("s").alias("target"))
    return obj.unionByName(sub)


def known_counts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """s, p, objects; and p, o, subjects."""
    return facts.groupBy("s", "p").agg(F.count("*").alias("objects")), facts.groupBy("p", "o").agg(F.count("*").alias("subjects"))


def _side() -> Column:
    return F.when(F.col("ask") % 2 == 0, "obj").otherwise("sub").alias("side")


class LinkPrediction:
    """One evaluation: rules (with rule_rank), their steps, the train triples, all facts, and an engine. codec: that of the
    names, if the triples hold codes, those of the engine and of the schemas too."""

    def __init__(self, rules: DataFrame, steps: DataFrame, train: DataFrame, facts: DataFrame, test: DataFrame, engine: semantic.Engine, lengths: list[int], n_steps: int, codec: Codec | None = None):
        self.spark, self.rules, self.steps, self.engine, self.lengths, self.n_steps, self.codec = rules.sparkSession, rules, steps, engine, lengths, n_steps, codec
        own = sorted(rules.select("rule_id", "head_p", "conf", "rule_rank").collect(), key=lambda r: r["rule_rank"])
        self.heads = {p: [r for r in own if r["head_p"] == p] for p in sorted({r["head_p"] for r in own})}
        #: head predicate and side by number
        self.asks = [(p, side) for p in self.heads for side in ("obj", "sub")]
        self.wide = any(len(x) > BITS or any(a["conf"] <= b["conf"] for a, b in zip(x, x[1:])) for x in self.heads.values())
        of_heads = lambda df: df.select("s", "p", "o").filter(F.col("p").isin(list(self.heads)))
        self.train, self.facts = of_heads(train), of_heads(facts)
        self.queries = queries(test, codec)
        self.adjacency = grounding.adjacency(train, steps)
        self._firsts: dict[int, DataFrame] = {}

    def _table(self, rows: list[tuple], ddl: str) -> DataFrame:
        return grounding.small(local(self.spark, rows, ddl), len(rows))

    @cached_property
    def asked(self) -> DataFrame:
        """qid, side, anchor, target, ask, distinct, of the queries for heads of rules; ask: the number of head and side."""
        own = self._table([(p, side, i) for i, (p, side) in enumerate(self.asks)], "head_p string, side string, ask int")
        out = written(self.queries.join(own, ["head_p", "side"]).distinct(), "lp-asked")
        out.hornbeam_rows = out.count()
        return out

    @cached_property
    def requests(self) -> DataFrame:
        """rule_id, side, anchor, distinct: what the rules are asked."""
        groups = self.engine.asked(self.asked.select("anchor", "side", "head_p").distinct())
        return written(groups.join(F.broadcast(self.rules.select("rule_id", "head_p")), "head_p").select("rule_id", "side", "anchor"), "lp-requests")

    def _answers(self, requests: DataFrame, steps: DataFrame | None = None, tried: tuple[int, int] | None = None) -> DataFrame:
        return grounding.answers(self.rules, self.steps if steps is None else steps, self.adjacency, self.lengths, self.n_steps, requests, self.codec, tried)

    @cached_property
    def _kept(self) -> DataFrame:
        """rule_id, side, anchor, candidate that an engine with vetoes leaves. A violation among some candidates says that the
        whole group goes, so that the others of such groups are not made."""
        heads = F.broadcast(self.rules.select("rule_id", "head_p"))
        some = written(self._answers(self.requests, tried=(0, TRIED)).distinct().join(heads, "rule_id"), "lp-some")
        left = written(self.requests.join(self.engine.vetoed(some), semantic.GROUP, "left_anti"), "lp-requests")
        found = written(self._answers(left).distinct().join(heads, "rule_id"), "lp-candidates")
        return written(self.engine.kept(found).select("rule_id", "side", "anchor", "candidate"), "lp-kept")

    def _raw(self, asks: list[int]) -> DataFrame:
        """rule_id, side, anchor, candidate of these asks, once or more."""
        wanted = [(r["rule_id"], self.asks[i][1]) for i in asks for r in self.heads[self.asks[i][0]]]
        if self.engine.reads_again:
            return self._kept.join(self._table(wanted, "rule_id int, side string"), ["rule_id", "side"], "left_semi")
        requests = self.requests.join(self._table(wanted, "rule_id int, side string"), ["rule_id", "side"], "left_semi")
        bodies = self._table([(r, "body") for r in sorted({r for r, _ in wanted})], "rule_id int, side string")
        steps = self.steps.join(self._table(wanted, "rule_id int, side string").unionByName(bodies), ["rule_id", "side"], "left_semi")
        return self._answers(requests, steps)

    def _marked(self, asks: list[int]) -> DataFrame:
        """anchor, ask, candidate and marks: the places of the rules that predict it among those of its head, and what else it
        is, as bits or as a list. All rows of a group are in one partition."""
        of = [(r["rule_id"], self.asks[i][1], i, place) for i in asks for place, r in enumerate(self.heads[self.asks[i][0]])]
        rows = self._raw(asks).join(self._table(of, "rule_id int, side string, ask int, mark int"), ["rule_id", "side"]).select("anchor", "ask", "candidate", "mark")
        kinds = self._table([(*self.asks[i], i) for i in asks], "p string, side string, ask int")
        own = self.asked.filter(F.col("ask").isin(asks))
        for df, mark in ((self.facts, FACT), (self.train, TRAIN)):
            obj = F.col("side") == "obj"
            at = df.join(kinds, "p").select(F.when(obj, F.col("s")).otherwise(F.col("o")).alias("anchor"), "ask", F.when(obj, F.col("o")).otherwise(F.col("s")).alias("candidate"), F.lit(mark).alias("mark"))
            groups = own.select("anchor", "ask").distinct()
            rows = rows.unionByName(at.join(grounding.small(groups, self.asked.hornbeam_rows), ["anchor", "ask"], "left_semi"))
        rows = rows.unionByName(own.select("anchor", "ask", F.col("target").alias("candidate"), F.lit(TARGET).alias("mark")))
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.asked.hornbeam_rows // GROUPS + 1)
        marks = F.sort_array(F.collect_set("mark")) if self.wide else F.expr(f"bit_or(shiftleft(1L, {BITS - 1} - mark))")
        return rows.repartition(n, "anchor", "ask").groupBy("anchor", "ask", "candidate").agg(marks.alias("marks"))

    def _is(self, mark: int) -> Column:
        return F.array_contains("marks", mark) if self.wide else F.col("marks").bitwiseAND(F.lit(1 << BITS - 1 - mark)) != 0

    def _groups(self, asks: list[int]) -> DataFrame:
        """The candidates of the groups of these asks after the subject side's early stop: anchor, ask, candidate, name,
        places of their rules, first (the best of these), score (ascending from the best), raw_rank, free (no known fact),
        above and equal (free candidates with a better and with the same score), is_target, in_train, and taken (whether
        the anchor has any candidate in train)."""
        own = Window.partitionBy("anchor", "ask")
        rows = self._marked(asks).withColumns({"free": ~self._is(FACT), "in_train": self._is(TRAIN), "is_target": self._is(TARGET)})
        rows = rows.withColumn("places", F.filter("marks", lambda x: x >= 0) if self.wide else F.col("marks").bitwiseAND(F.lit((1 << BITS) - 1)))
        some = F.size("places") > 0 if self.wide else F.col("places") != 0
        first = F.when(some, F.element_at("places", 1) if self.wide else F.expr(f"{BITS} - length(bin(places))"))
        rows = rows.withColumn("first", first).withColumn("taken", F.max("in_train").over(own))
        if any(self.asks[i][1] == "sub" and len(self.heads[self.asks[i][0]]) > 1 for i in asks):
            rows = rows.withColumn("limit", F.lit(ranking.KEEP) + F.sum((~F.col("free")).cast("long")).over(own))
            rows = rows.withColumn("nth", F.row_number().over(own.orderBy(F.col("first").asc_nulls_last())))
            rows = rows.withColumn("last", F.max(F.when((F.col("nth") == F.col("limit")) & (F.col("ask") % 2 == 1), F.col("first"))).over(own)).drop("limit", "nth")
            kept = F.filter("places", lambda x: x <= F.col("last")) if self.wide else F.expr(f"places & shiftleft(-1L, {BITS - 1} - last)")
            rows = rows.filter("last IS NULL OR first <= last").withColumn("places", F.when(F.col("last").isNull(), F.col("places")).otherwise(kept)).drop("last")
        rows = rows.filter("first IS NOT NULL").withColumn("name", F.col("candidate"))
        if self.codec:
            rows = self.codec.decode(rows, "name")
        if self.wide:
            rows = rows.withColumn("score", F.concat(F.transform(self.confs(), lambda x: -x), F.array(F.lit(float("inf")).cast("float"))))
        else:
            rows = rows.withColumn("score", -F.col("places"))
        rows = rows.withColumn("raw_rank", F.row_number().over(own.orderBy("score", "name")))
        free = F.col("free").cast("long")
        rows = rows.withColumn("above", F.sum(free).over(own.orderBy("score").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        rows = rows.withColumn("equal", F.sum(free).over(Window.partitionBy("anchor", "ask", "score")))
        return rows.withColumn("above", F.col("above") - F.col("equal")).drop("marks")

    def _list(self) -> Column:
        """places as a list."""
        at = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(BITS - 1) - i)
        return F.col("places") if self.wide else F.filter(F.sequence(F.lit(0), F.lit(max(map(len, self.heads.values())) - 1)), lambda i: F.col("places").bitwiseAND(at(i)) != 0)

    def confs(self) -> Column:
        """The confidences of the rules of places, descending."""
        of = F.element_at(F.array(*[F.array(*[F.lit(r["conf"]).cast("float") for r in self.heads[p]]) for p in self.heads]), F.floor(F.col("ask") / 2).cast("int") + 1)
        confs = F.transform(self._list(), lambda i: F.element_at(of, i + 1))
        return F.sort_array(confs, False) if self.wide else confs

    def _fans(self, sides: tuple[str, ...] = ("obj", "sub")) -> list[tuple[list[int], int, bool]]:
        """The asks of these sides whose groups have few queries and those whose groups have many, each with the number of
        their queries, and whether they are many."""
        counts = {r["ask"]: r for r in self.asked.groupBy("ask").agg(F.count("*").alias("n"), F.count_distinct("anchor").alias("groups")).collect()}
        asks = [i for i, (_, side) in enumerate(self.asks) if side in sides]
        many = [i for i in asks if i in counts and counts[i]["n"] >= FAN * counts[i]["groups"]]
        parts = [([i for i in asks if i not in many], False), (many, True)]
        return [(some, sum(counts[i]["n"] for i in some if i in counts), fan) for some, fan in parts if some]

    def _fanned(self, rows: DataFrame, queries: DataFrame, n: int, fan: bool) -> DataFrame:
        """rows (anchor, ask, _candidate, ...) of groups for each of the n queries (anchor, ask, ...)."""
        if fan:  # else all rows of a group would be written by one task
            rows = rows.repartition(max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism), "_candidate")
        return rows.join(grounding.small(queries, n), ["anchor", "ask"])

    def rows(self, *columns: str | Column, filtered: bool = False, sides: tuple[str, ...] = ("obj", "sub")) -> DataFrame:
        """qid, side and these columns of the groups' rows, for each query. filtered: without known facts other than its target."""
        out = []
        for some, n, fan in self._fans(sides):
            rows = self._groups(some).select("anchor", "ask", F.col("candidate").alias("_candidate"), "free", *columns)
            rows = self._fanned(rows, self.asked.filter(F.col("ask").isin(some)).select("anchor", "ask", "qid", "target"), n, fan)
            out.append(rows.filter("free OR _candidate = target") if filtered else rows)
        names = [c for c in out[0].columns if c not in ("anchor", "ask", "_candidate", "free", "qid", "target")]
        return reduce(DataFrame.unionByName, out).select("qid", _side(), *names)

    def stopped(self) -> DataFrame:
        """qid, candidate, rule_rank of the subject side: the rules of each candidate after the early stop."""
        table = self._table([(i, place, r["rule_rank"]) for i, (p, side) in enumerate(self.asks) for place, r in enumerate(self.heads[p]) if side == "sub"], "ask int, place int, rule_rank int")
        rows = self.rows(F.col("name").alias("candidate"), F.col("ask").alias("_ask"), self._list().alias("of"), sides=("sub",))
        return rows.select("qid", "candidate", F.col("_ask").alias("ask"), F.explode("of").alias("place")).join(table, ["ask", "place"]).select("qid", "candidate", "rule_rank")

    def _first(self, most: int = ranking.KEEP) -> DataFrame:
        """The groups' rows with ranks to `most`, and those that are targets."""
        if most not in self._firsts:
            columns = ["anchor", "ask", "candidate", "score", "raw_rank", "free", "above", "equal", "is_target", "in_train", "taken"]
            rows = self._groups([*range(len(self.asks))]).select(columns)
            self._firsts[most] = written(rows.filter((F.col("raw_rank") <= most) | F.col("is_target")), "lp-first")
        return self._firsts[most]

    @cached_property
    def targets(self) -> DataFrame:
        """qid, side, anchor, ask, target, and, if the target is a candidate, target_score, extra (1 if it is a known fact, so
        that it stands among the filtered candidates for its own query only), and its tie block's block_start and block_end."""
        found = self._first().filter("is_target").withColumn("extra", F.when(F.col("free"), 0).otherwise(1))
        found = found.select("anchor", "ask", F.col("candidate").alias("target"), F.col("score").alias("target_score"), "extra", (F.col("above") + 1).alias("block_start"), (F.col("above") + F.col("equal") + F.col("extra")).alias("block_end"))
        return written(self.asked.join(found, ["anchor", "ask", "target"], "left"), "lp-targets")

    def blocks(self) -> DataFrame:
        """qid, side, candidate, block_start and block_end of the filtered candidates of each query."""
        out = []
        for some, n, fan in self._fans():
            targets = self.targets.filter(F.col("ask").isin(some)).select("qid", "anchor", "ask", "target", "target_score", "extra")
            rows = self._groups(some).select("anchor", "ask", F.col("candidate").alias("_candidate"), "name", "score", "free", "above", "equal")
            out.append(self._fanned(rows, targets, n, fan).filter("free OR _candidate = target"))
        rows = reduce(DataFrame.unionByName, out)
        own = lambda c: F.coalesce(F.when(c, F.col("extra")), F.lit(0))
        start = F.col("above") + 1 + own(F.col("target_score") < F.col("score"))
        rows = rows.withColumn("block_start", start)
        return rows.select("qid", _side(), F.col("name").alias("candidate"), "block_start", (F.col("block_start") + F.col("equal") - 1 + own(F.col("target_score") == F.col("score"))).alias("block_end"))

    def per_query(self) -> DataFrame:
        """qid, side, hits1, hits5, hits10, mrr of the queries whose target is a candidate."""
        t = self.targets.filter("block_start IS NOT NULL")
        a, b = F.col("block_start"), F.col("block_end")
        hits = [expected_hits(a, b, k).cast("double").alias(f"hits{k}") for k in (1, 5, 10)]
        # a block of many ties is summed once, not for each query
        of = t.select("block_start", "block_end").distinct().select("*", *hits, expected_reciprocal_rank(a, b).alias("mrr"))
        return t.join(of, ["block_start", "block_end"]).select("qid", "side", "hits1", "hits5", "hits10", "mrr")

    def _counted(self, schema: Schema, most: int) -> tuple[DataFrame, DataFrame]:
        """The groups' rows to rank `most`, with `ok`; and the queries with `stop`, the rank up to which they count."""
        first, levels = self._first(most), ["anchor", "ask", "target_score"]
        free = first.filter((F.col("raw_rank") <= most) & F.col("free")).groupBy("anchor", "ask", "score").agg(F.min("raw_rank").alias("rank"))
        ends = self.targets.filter("block_start IS NOT NULL").select(levels).distinct()
        stops = ends.join(free, ["anchor", "ask"]).filter("score > target_score").groupBy(levels).agg(F.min("rank").alias("stop"))
        asked = self.targets.join(stops, levels, "left").select("qid", "anchor", "ask", F.coalesce("stop", F.lit(most)).alias("stop"))
        flags = {r["p"]: r for r in schema.constraints.filter(F.col("p").isin(list(self.heads))).select("p", "functional", "inverse_functional").collect()}
        one = lambda p, way: bool(p in flags and flags[p][way])
        ways = {"obj": ("functional", "inverse_functional"), "sub": ("inverse_functional", "functional")}
        table = self._table([(i, p, side, *[one(p, w) for w in ways[side]]) for i, (p, side) in enumerate(self.asks)], "ask int, p string, side string, one_candidate boolean, one_anchor boolean")
        rows = first.filter(F.col("raw_rank") <= most).select("anchor", "ask", "candidate", "raw_rank", "taken", "in_train").join(table, "ask")
        # what a candidate has by itself: a type that the property's end may not have, and anchors in train
        own = rows.select("ask", "p", "side", "candidate").distinct()
        typed = [schema.conflicting(own.filter(F.col("side") == side), "candidate", "p", classes) for side, classes in (("obj", schema.range), ("sub", schema.domain))]
        obj = F.col("side") == "obj"
        known = self.train.join(table.filter("one_anchor"), "p").select("ask", F.when(obj, F.col("o")).otherwise(F.col("s")).alias("candidate"), F.when(obj, F.col("s")).otherwise(F.col("o")).alias("other"))
        known = known.groupBy("ask", "candidate").agg(F.min("other").alias("low"), F.max("other").alias("high"), F.lit(False).alias("typed"))
        typed = [x.select("ask", "candidate", F.lit(None).cast(dict(known.dtypes)["low"]).alias("low"), F.lit(None).cast(dict(known.dtypes)["low"]).alias("high"), F.lit(True).alias("typed")) for x in typed]
        of = reduce(DataFrame.unionByName, [known, *typed]).groupBy("ask", "candidate").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("typed").alias("typed"))
        bad = (F.col("one_candidate") & F.col("taken") & ~F.col("in_train")) | F.coalesce("typed", F.lit(False)) | F.coalesce((F.col("low") != F.col("anchor")) | (F.col("high") != F.col("anchor")), F.lit(False))
        return rows.join(of, ["ask", "candidate"], "left").select("anchor", "ask", "raw_rank", (~bad).alias("ok")), asked

    def counted(self, schema: Schema, most: int = ranking.KEEP) -> DataFrame:
        """qid, side, raw_rank and ok of the raw candidates that count for Sem@k: ranks to `most`, but not beyond the first
        unfiltered candidate below the target's tie block."""
        rows, asked = self._counted(schema, most)
        rows = rows.join(grounding.small(asked, self.asked.hornbeam_rows), ["anchor", "ask"]).filter("raw_rank <= stop")
        return rows.select("qid", _side(), "raw_rank", "ok")

    def metrics(self, schema: Schema) -> DataFrame:
        """One row: hits1, hits5, hits10, mrr, sem1, sem5, sem10, sem100, total. Queries without candidates count as 0
        for hits and mrr, and not at all for sem."""
        found = self.queries.select("qid", "side").join(self.per_query(), ["qid", "side"], "left")
        share = [F.coalesce(F.sum(c) / F.count("*"), F.lit(0.0)).alias(c) for c in ("hits1", "hits5", "hits10", "mrr")]
        first = found.agg(*share, F.count("*").alias("total"))
        rows, asked = self._counted(schema, ranking.KEEP)
        cut = lambda k: F.when(F.col("raw_rank") <= k, F.col("ok").cast("double"))
        ends = asked.select("anchor", "ask", "stop").distinct()
        per = ends.join(rows, ["anchor", "ask"]).filter("raw_rank <= stop").groupBy("anchor", "ask", "stop").agg(*[F.avg(cut(k)).alias(f"sem{k}") for k in (1, 5, 10, 100)])
        per = asked.join(per, ["anchor", "ask", "stop"]).select("qid", _side(), *[f"sem{k}" for k in (1, 5, 10, 100)])
        # test triples that repeat count each
        sem = self.queries.select("qid", "side").join(per, ["qid", "side"]).agg(*[F.coalesce(F.avg(f"sem{k}"), F.lit(0.0)).alias(f"sem{k}") for k in (1, 5, 10, 100)])
        return first.crossJoin(sem).select("hits1", "hits5", "hits10", "mrr", "sem1", "sem5", "sem10", "sem100", "total")

    def log_lines(self) -> DataFrame:
        """s, p, o, heads, tails: each test triple with its filtered candidates in order and their best confidence."""
        text = F.concat_ws("\t", "name", F.element_at(self.confs(), 1).cast("string")).alias("text")
        rows = self.rows("raw_rank", text, filtered=True).withColumn("entry", F.struct("raw_rank", "text"))
        listed = rows.groupBy("qid", "side").agg(F.array_join(F.transform(F.sort_array(F.collect_list("entry")), lambda e: e["text"]), "\t").alias("listed"))
        side = lambda x, name: listed.filter(F.col("side") == x).select("qid", F.col("listed").alias(name))
        return self.queries.filter("side = 'obj'").select("qid").distinct().join(side("sub", "heads"), "qid", "left").join(side("obj", "tails"), "qid", "left").fillna("", ["heads", "tails"])

"""Max-plus ranking, tie blocks, filtering and early stop, as aggregates and windows within a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP = 100


def scores(cands: DataFrame, rules: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, side, candidate, confs (descending, one of each rule that predicts it). queries: qid, side, anchor, head_p, target."""
    ruled = cands.join(F.broadcast(rules.select("rule_id", "conf", F.col("head_p").alias("rule_p"), "rule_rank")), "rule_id")
    asked = queries.select("qid", F.col("side").alias("of_side"), F.col("anchor").alias("of"), "head_p")
    rows = ruled.join(asked, (F.col("anchor") == F.col("of")) & (F.col("side") == F.col("of_side")) & (F.col("rule_p") == F.col("head_p")))
    return rows.groupBy("qid", "side", "candidate").agg(F.sort_array(F.collect_list("conf"), False).alias("confs"))


def stopped(cands: DataFrame, queries: DataFrame, known: DataFrame, keep: int = KEEP) -> DataFrame:
    """Subject side only: the rules of a query end after the one with which `keep` + known subjects distinct candidates
    are reached. Rows of cands (with qid, rule_rank) of rules up to that one. known: head_p, anchor, subjects."""
    first = cands.groupBy("qid", "candidate").agg(F.min("rule_rank").alias("rule_rank"))
    per = first.groupBy("qid", "rule_rank").agg(F.count("*").alias("new"))
    upto = per.withColumn("upto", F.sum("new").over(Window.partitionBy("qid").orderBy("rule_rank")))
    limit = queries.join(known, ["head_p", "anchor"], "left").select("qid", (F.lit(keep) + F.coalesce("subjects", F.lit(0))).alias("limit"))
    last = upto.join(limit, "qid").filter(F.col("upto") >= F.col("limit")).groupBy("qid").agg(F.min("rule_rank").alias("last_rank"))
    return cands.join(last, "qid", "left").filter("last_rank IS NULL OR rule_rank <= last_rank").drop("last_rank")


def ranked(scored: DataFrame) -> DataFrame:
    """Adds raw_rank: by descending list of confidences, the longer first on a common prefix; ties by candidate."""
    return scored.withColumn("raw_rank", F.row_number().over(Window.partitionBy("qid", "side").orderBy(F.col("confs").desc(), "candidate")))


def as_facts(rows: DataFrame) -> DataFrame:
    """Adds s, p, o of the triple that (side, anchor, head_p, candidate) predicts."""
    obj = F.col("side") == "obj"
    return rows.withColumn("s", F.when(obj, F.col("anchor")).otherwise(F.col("candidate"))).withColumn("p", F.col("head_p")).withColumn("o", F.when(obj, F.col("candidate")).otherwise(F.col("anchor")))


def filtered(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows (with s, p, o, candidate, target) but known facts other than the target."""
    other = rows.filter("candidate <> target").join(facts.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    return rows.filter("candidate = target").unionByName(other)


def tie_blocks(rows: DataFrame) -> DataFrame:
    """Adds block_start and block_end: the filtered ranks that a candidate shares with those of equal confidences."""
    own = Window.partitionBy("qid", "side")
    start = F.rank().over(own.orderBy(F.col("confs").desc()))
    size = F.count("*").over(Window.partitionBy("qid", "side", "confs"))
    return rows.withColumn("block_start", start).withColumn("block_end", start + size - 1)

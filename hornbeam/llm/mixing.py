"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every document of a source gets a place in the source's shuffled order. A copy of it (epoch 0, 1, ... below
`cap`) finishes at the virtual time `tokens of its source up to its end / weight of its source`. The mix is the
longest prefix, in order of virtual finish time, whose sizes sum up to the budget (all sizes together). A source
that has given `cap` times its size is exhausted, and the others go on sharing by weight: so the targets are those
of water-filling, min(cap * size, weight * F) for the one F at which they sum up to the budget.

A hot source is dealt over buckets of the shuffle key: a bucket's offset is a prefix sum over the (source, bucket)
sums, and windows run within one bucket. The cut is found from sums by bucket of virtual time, then by a window
over the one bucket in which the budget is reached; no row is moved for that.

Defined cases: a null source is a source, the last; a null or wordless text has size 0 and is never counted as
taken; the shuffle key is a hash of doc_id, source and text, so rows that share a doc_id or have none are dealt like any
others, and only rows equal in all three are interchangeable; equal finish times follow the shuffle key, then doc_id;
repeated rows are documents of their own; an empty table gives an empty mix. Columns of the input that are named like the
operator's own (mix_size, mix_epoch, mix_finish) stay, and the operator's are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornbeam.llm import common

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix"


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: mix_source, mix_source_size, one row a source. Adds mix_weight, mix_budget, mix_level (F) and mix_target."""
    every = Window.partitionBy()
    by_rank = every.orderBy(F.col("mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_rank) - 1) % len(weights) + 1)
    capped = F.lit(cap) * F.col("mix_source_size")
    filled = every.orderBy(capped / F.col("mix_weight"), F.col("mix_source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # each source's line is an upper bound of what is given at virtual time F, so the highest root is the root
    line = (F.col("mix_budget") - F.coalesce(F.sum(capped).over(before), F.lit(0))) / F.sum("mix_weight").over(after)
    return (
        sizes.withColumn("mix_weight", weight)
        .withColumn("mix_budget", F.sum("mix_source_size").over(every))
        .withColumn("mix_line", line)
        .withColumn("mix_level", F.max("mix_line").over(every))
        .drop("mix_line")
        .withColumn("mix_target", F.least(capped.cast("double"), F.col("mix_weight") * F.col("mix_level")))
    )


def _keyed(docs: DataFrame, digits: int, seed: str) -> DataFrame:
    """mix_row (all columns of docs), doc_id, and the operator's own columns."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.md5(F.concat(text("doc_id"), F.lit(f"/{seed}/"), text("source"), F.lit("/"), F.md5(text("text"))))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"),
        "doc_id",
        F.col("source").alias("mix_source"),
        words(F.col("text")).alias("mix_size"),
        key.alias("mix_key"),
    ).withColumn("mix_bucket", F.substring("mix_key", 1, digits))


def _placed(keyed: DataFrame, buckets: DataFrame) -> DataFrame:
    """Adds mix_end: the tokens of the source up to and with the document."""
    same = keyed["mix_source"].eqNullSafe(buckets["mix_source"]) & (keyed["mix_bucket"] == buckets["mix_bucket"])
    own = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_key", "doc_id")
    return (
        keyed.join(buckets, same, "left")
        .drop(buckets["mix_source"])
        .drop(buckets["mix_bucket"])
        .withColumn("mix_end", F.col("mix_offset") + F.sum("mix_size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    )


def _copies(placed: DataFrame, cap: int) -> DataFrame:
    finish = (F.col("mix_epoch") * F.col("mix_source_size") + F.col("mix_end")) / F.col("mix_weight")
    return placed.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).withColumn("mix_finish", finish)


_ORDER = ("mix_finish", "mix_key", "doc_id", "mix_epoch")


def plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """mix_row (the columns of docs), doc_id, mix_size, mix_source_size, mix_target, mix_weight, mix_end and mix_epochs: the copies that the mix takes."""
    n = docs.count()
    digits = min(5, max(1, math.ceil(math.log(max(n, 1) / 2048 + 1, 16))))
    keyed = _keyed(docs, digits, seed)
    narrow = common.written(keyed.select("doc_id", "mix_source", "mix_size", "mix_key", "mix_bucket"), "mix-keys")
    sums = narrow.groupBy("mix_source", "mix_bucket").agg(F.sum("mix_size").alias("mix_bucket_size"))
    shares = targets(sums.groupBy("mix_source").agg(F.sum("mix_bucket_size").alias("mix_source_size")), weights, cap)
    offset = F.sum("mix_bucket_size").over(Window.partitionBy("mix_source").orderBy("mix_bucket")) - F.col("mix_bucket_size")
    sums = sums.withColumn("mix_offset", offset)
    buckets = common.written(
        sums.join(shares, sums["mix_source"].eqNullSafe(shares["mix_source"])).drop(shares["mix_source"]).drop("mix_bucket_size"),
        "mix-buckets",
    )
    total = buckets.agg(F.max("mix_budget").alias("budget"), F.max("mix_level").alias("level")).first()
    budget, level = total["budget"] or 0, total["level"] or 0.0
    parts = min(65536, max(16, n // 4096))
    copies = _copies(_placed(narrow, buckets), cap).select("mix_size", *_ORDER)
    copies = copies.withColumn("part", F.least(F.floor(F.col("mix_finish") * parts / F.lit(level or 1.0)), F.lit(2 * parts)))
    upto = F.sum("size").over(Window.orderBy("part"))
    full = copies.groupBy("part").agg(F.sum("mix_size").alias("size")).withColumn("upto", upto)
    over = full.filter(F.col("upto") > budget).orderBy("part").select("part", (F.col("upto") - F.col("size")).alias("before")).first()
    taken = F.sequence(F.lit(0), F.lit(cap - 1))
    if over:
        within = Window.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
        at = copies.filter(F.col("part") == over["part"]).withColumn("upto", F.lit(over["before"]) + F.sum("mix_size").over(within))
        cut = at.filter(F.col("upto") > budget).orderBy("upto", *_ORDER).select(*_ORDER).first()
        finish = lambda e: (e * F.col("mix_source_size") + F.col("mix_end")) / F.col("mix_weight")
        last = F.struct(*[F.lit(cut[c]).cast(at.schema[c].dataType).alias(c) for c in _ORDER])
        taken = F.filter(taken, lambda e: F.struct(finish(e).alias("mix_finish"), "mix_key", "doc_id", e.alias("mix_epoch")) < last)
    return _placed(keyed, buckets).withColumn("mix_epochs", taken)


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed documents, range-sorted by mix_finish: a row for each copy taken (mix_epoch 0, 1, ...), with the columns of docs."""
    own = {c.lower() for c in docs.columns}
    rows = plan(docs, weights, cap, seed).withColumn("mix_epoch", F.explode("mix_epochs"))
    finish = (F.col("mix_epoch") * F.col("mix_source_size") + F.col("mix_end")) / F.col("mix_weight")
    rows = rows.select("mix_row", "mix_key", "doc_id", "mix_size", "mix_epoch", finish.alias("mix_finish")).orderBy(*_ORDER)
    return rows.select("mix_row.*", *[c for c in ("mix_size", "mix_epoch", "mix_finish") if c not in own])

"""Violations of the schema among new triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.operators import semantic
from hornbeam.operators.schema import RDF_TYPE, Schema


def _asserted(new: DataFrame) -> DataFrame:
    """entity, cls: types that the new triples assert."""
    return new.filter(F.col("p") == RDF_TYPE).select(F.col("s").alias("entity"), F.col("o").alias("cls"))


def functional(new: DataFrame, base: DataFrame, schema: Schema) -> DataFrame:
    return semantic.violates_functionality(new, base.select("s", "p", "o").unionByName(new.select("s", "p", "o")), schema)


def inverse_functional(new: DataFrame, base: DataFrame, schema: Schema) -> DataFrame:
    return semantic.violates_inverse_functionality(new, base.select("s", "p", "o").unionByName(new.select("s", "p", "o")), schema)


def domain(new: DataFrame, schema: Schema, typing: bool = True) -> DataFrame:
    """typing: whether new triples may assert types."""
    return schema.conflicting(new, "s", "p", schema.domain, _asserted(new) if typing else None)


def range_(new: DataFrame, schema: Schema, typing: bool = True) -> DataFrame:
    return schema.conflicting(new, "o", "p", schema.range, _asserted(new) if typing else None)


def counts(new: DataFrame, base: DataFrame, schema: Schema, typing: bool = True) -> DataFrame:
    """One row: triples, func, invf, dom, ran, inc (distinct triples with any), sem = 1 - inc / triples (null if none)."""
    new = new.select("s", "p", "o").distinct()
    kinds = {"func": functional(new, base, schema), "invf": inverse_functional(new, base, schema), "dom": domain(new, schema, typing), "ran": range_(new, schema, typing)}
    rows = new.withColumn("kind", F.lit("triples"))
    for kind, x in kinds.items():
        rows = rows.unionByName(x.select("s", "p", "o").distinct().withColumn("kind", F.lit(kind)))
    each = rows.groupBy("s", "p", "o").agg(*[F.max(F.col("kind") == k).cast("int").alias(k) for k in kinds])
    sums = each.agg(F.count("*").alias("triples"), *[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in kinds], F.coalesce(F.sum(F.greatest(*kinds)), F.lit(0)).cast("long").alias("inc"))
    return sums.withColumn("sem", F.when(F.col("triples") > 0, 1 - F.col("inc") / F.col("triples")))


def _other_end_by(new: DataFrame, base: DataFrame, flagged: DataFrame, end: str, many: str, by: str) -> DataFrame:
    """The rows of new (by, s, p, o) whose flagged p has another `many` at the same `end`, in base or among new rows of the same `by`."""
    spread = lambda rows, *keys: rows.groupBy(*keys, "p", end).agg(F.min(many).alias("low"), F.max(many).alias("high"))
    rows = new.join(flagged, "p", "left_semi")
    own = spread(rows, by).withColumnsRenamed({"low": "own_low", "high": "own_high"})
    found = rows.join(own, [by, "p", end]).join(spread(base.join(flagged, "p", "left_semi")), ["p", end], "left")
    return found.filter((F.least("low", "own_low") != F.col(many)) | (F.greatest("high", "own_high") != F.col(many))).select(new.columns)


def _conflicts_by(new: DataFrame, schema: Schema, classes: DataFrame, end: str, by: str) -> DataFrame:
    """The rows of new whose `end` has a type among the classes of p, in the schema or by new rows of the same `by`."""
    nodes = new.select(by, F.col(end).alias("node"), "p").distinct()
    own = new.filter(F.col("p") == RDF_TYPE).select(by, F.col("s").alias("node"), F.col("o").alias("cls")).distinct()
    known = nodes.join(schema.types.withColumnRenamed("entity", "node"), "node").select(by, "node", "p", "cls")
    typed = known.unionByName(nodes.join(own, [by, "node"]).select(by, "node", "p", "cls"))
    bad = typed.join(classes, ["p", "cls"], "left_semi").select(by, F.col("node").alias(end), "p").distinct()
    return new.join(bad, [by, end, "p"], "left_semi").select(new.columns)


def counts_by_file(new: DataFrame, base: DataFrame, schema: Schema, by: str = "file") -> DataFrame:
    """A row of counts, as counts() gives it, for each result file; files are judged apart, all in one job."""
    new, base = new.select(by, "s", "p", "o").distinct(), base.select("s", "p", "o")
    flagged = lambda c: schema.constraints.filter(c).select("p")
    kinds = {
        "func": _other_end_by(new, base, flagged("functional"), "s", "o", by), "invf": _other_end_by(new, base, flagged("inverse_functional"), "o", "s", by),
        "dom": _conflicts_by(new, schema, schema.domain, "s", by), "ran": _conflicts_by(new, schema, schema.range, "o", by),
    }
    rows = new.withColumn("kind", F.lit("triples"))
    for kind, x in kinds.items():
        rows = rows.unionByName(x.distinct().withColumn("kind", F.lit(kind)))
    each = rows.groupBy(by, "s", "p", "o").agg(*[F.max(F.col("kind") == k).cast("int").alias(k) for k in kinds])
    sums = each.groupBy(by).agg(F.count("*").alias("triples"), *[F.sum(k).cast("long").alias(k) for k in kinds], F.sum(F.greatest(*kinds)).cast("long").alias("inc"))
    return sums.withColumn("sem", 1 - F.col("inc") / F.col("triples"))


def domain_examples(new: DataFrame, schema: Schema, n: int = 20) -> DataFrame:
    return domain(new, schema).select("s", "p", "o").distinct().orderBy("s", "p", "o").limit(n)

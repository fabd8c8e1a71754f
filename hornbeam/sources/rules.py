"""Rule files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.operators import rules
from hornbeam.sources.triples import exists


def scan_rules(spark: SparkSession, path: str) -> DataFrame:
    """line_no, predicted, correct, given, rule of `predicted TAB correct TAB confidence TAB rule`; blank lines and # skipped."""
    line = F.trim("value")
    parts = F.split("value", "\t")
    rows = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()).filter((line != "") & ~line.startswith("#"))
    rows = rows.withColumn("parts", parts).filter(F.size("parts") >= 4)
    number = lambda i: F.expr(f"try_cast(trim(parts[{i}]) AS float)")
    return rows.select("line_no", number(0).alias("predicted"), number(1).alias("correct"), number(2).alias("given"), F.trim(F.col("parts")[3]).alias("rule")).filter("predicted IS NOT NULL AND correct IS NOT NULL")


def load(spark: SparkSession, path: str | None, pattern: bool = False, first_id: int = 1, confidence_column: bool = False) -> tuple[list[rules.Rule], int]:
    """The rules of a file on the driver, where they are planned, and the number of malformed rows; none for a missing file."""
    if not exists(spark, path):
        return [], 0
    rows = [tuple(r) for r in scan_rules(spark, path).orderBy("line_no").toLocalIterator()]
    return rules.load_rules(rows, pattern, first_id, confidence_column)


def load_sets(spark: SparkSession, plain: str | None, patterns: str | None) -> list[rules.Rule]:
    """Path rules and pattern rules together, with ids of their own."""
    first, _ = load(spark, plain)
    second, _ = load(spark, patterns, True, 1 + len(first))
    return first + second


def convert_amie(spark: SparkSession, path: str, out: str) -> int:
    """A miner's table to a rule file; returns how many rules it has."""
    rows = rules.amie_rows(r[0] for r in spark.read.text(path).toLocalIterator())
    whole = lambda x: str(int(x)) if x == int(x) else repr(x)
    lines = [(i, f"{whole(a)}\t{whole(b)}\t{c}\t{t}") for i, (a, b, c, t) in enumerate(rows)]
    spark.createDataFrame(lines, "i int, value string").repartition(1).sortWithinPartitions("i").select("value").write.text(out)
    return len(rows)



"""Writers, and discovery of what earlier runs wrote."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("hits1", "hits5", "hits10", "mrr", "sem10", "sem100")


def write_ntriples(triples: DataFrame, path: str) -> None:
    """`<s> <p> <o> .`, one a line, in no order."""
    triples.select(F.format_string("<%s> <%s> <%s> .", "s", "p", "o").alias("value")).write.text(path)


def write_prediction_log(lines: DataFrame, path: str) -> None:
    """lines: qid (s, p, o by tabs), heads, tails. Three lines and an empty one for each test triple."""
    block = F.concat(F.translate("qid", "\t", " "), F.lit("\nHeads: "), "heads", F.lit("\nTails: "), "tails", F.lit("\n"))
    lines.select(block.alias("value")).write.text(path)


def metrics_header() -> str:
    return "".join(["Engine".ljust(15), *[x.ljust(10) for x in ("Hits@1", "Hits@5", "Hits@10", "MRR", "Sem@10", "Sem@100")]])


def metrics_row(name: str, row) -> str:
    return f"{name:<15}" + "".join(f"{row[c]:<10.4f}" for c in METRICS)


def write_results(df: DataFrame, csv: str, markdown: str | None = None) -> str:
    """A small result table as CSV and as Markdown; returns the Markdown."""
    rows = df.collect()
    text = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    text += "".join("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |\n" for r in rows)
    df.repartition(1).write.option("header", True).csv(csv)
    if markdown:
        df.sparkSession.createDataFrame([(text,)], "value string").repartition(1).write.text(markdown)
    return text


def output_name(dataset: str, rule_set: str, engine: str, percent: float, stamp: str, what: str = "rules") -> str:
    """With the whole percentage, so that 0.1 and 0.5 have names of their own."""
    return f"{dataset}_{rule_set}_{engine}_{percent:g}_{what}_{stamp}.nt"


def latest_run(spark: SparkSession, folder: str, dataset: str | None = None) -> list[str]:
    """The .nt outputs in the newest subfolder by name (or in the folder itself), by name; of a data set if one is given."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = [(s.getPath().getName(), s.isDirectory(), s.getPath().toString()) for s in fs.listStatus(path)]
    outputs = sorted(p for name, _, p in listed if name.endswith(".nt") and (dataset is None or dataset in name))
    runs = sorted((name, p) for name, is_dir, p in listed if is_dir and not name.endswith(".nt"))
    return outputs if outputs or not runs else latest_run(spark, runs[-1][1], dataset)


def scan_outputs(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """s, p, o, file of all N-Triples outputs under a folder, or of those listed, in one job."""
    term = r"<([^>]*)>"
    rows = spark.read.option("recursiveFileLookup", True).text(folder).withColumn("path", F.input_file_name())
    rows = rows.select(*[F.regexp_extract("value", rf"^{term}\s+{term}\s+{term}", i).alias(c) for i, c in enumerate("spo", 1)], F.regexp_extract("path", r"([^/]+\.nt)(?:/|$)", 1).alias("file"))
    return rows.filter("s <> ''")


def logger(path: str | None = None, name: str = "hornbeam") -> logging.Logger:
    """Logs to the console and, if a path is given, to that file too."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    log.handlers = [logging.StreamHandler(sys.stdout), *([logging.FileHandler(path)] if path else [])]
    return log

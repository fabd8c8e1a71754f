"""`python -m hornbeam.cli lp|mat|mateval CONFIG [--rules 1,5,10] [--triples 10] [--out FOLDER]`: the three stages."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from hornbeam.operators import evaluate, grounding, materialize, rules, semantic, violations
from hornbeam.operators.schema import Schema, rdfs_closure
from hornbeam.sources import config as configs
from hornbeam.sources import rdf, sinks, triples
from hornbeam.sources import rules as rule_files
from hornbeam.sources.shared import written


def _schema(spark: SparkSession, c: configs.Config) -> Schema:
    types = rdf.scan_rdf(spark, c.types_file) if triples.exists(spark, c.types_file) else None
    return Schema(rdf.scan_rdf(spark, c.schema), types)


def _engine(name: str, schema: Schema, graph: DataFrame) -> semantic.Engine:
    return semantic.SemanticEngine(schema, graph) if name == "semantic" else semantic.Engine()


def _planned(spark: SparkSession, path: str, pattern: bool) -> tuple[list[rules.Rule], DataFrame, DataFrame, list[int], int]:
    found, bad = rule_files.load(spark, path, pattern)
    if bad:
        sinks.logger().warning("%s: %d malformed rows", path, bad)
    return found, rules.rule_table(spark, found), rules.step_table(spark, found), sorted({len(r.body) for r in found}), sum(len(r.body) for r in found)


def _graph(frame: DataFrame) -> DataFrame:
    if frame.isEmpty():
        raise ValueError("the graph has no triples")
    return frame.select("s", "p", "o")


def link_prediction(spark: SparkSession, c: configs.Config, out: str | None = None, limit: int | None = None) -> list[str]:
    """A row of metrics for each rule set and engine; with out, the prediction logs too."""
    log, lines = sinks.logger(), [sinks.metrics_header()]
    train = _graph(triples.scan_triples(spark, c.train))
    facts, test, schema = triples.known_facts(spark, c.train, c.valid, c.test), triples.scan_test(spark, c.test, limit), _schema(spark, c)
    for name, (path, pattern) in c.rule_sets().items():
        found, table, steps, lengths, n = _planned(spark, path, pattern)
        for engine in c.engines() if found else []:
            run = evaluate.LinkPrediction(table, steps, train, facts, test, _engine(engine, schema, train), lengths, n)
            lines.append(sinks.metrics_row(f"{name} {engine}"[:15], run.metrics(schema).first()))
            log.info(lines[-1])
            if out:
                sinks.write_prediction_log(run.log_lines(), f"{out}/{c.dataset_name}_{name}_{engine}.log")
    return lines


def materialization(spark: SparkSession, c: configs.Config, out: str, percent_rules: list[float], percent_triples: list[float]) -> list[str]:
    """N-Triples files of the new triples, one for each rule set, engine and percentage; returns their paths."""
    parts = [triples.scan_triples(spark, p) for p in (c.train, c.valid, c.test) if triples.exists(spark, p)]
    graph = _graph(triples.union(*parts))
    facts, schema, stamp, paths = triples.known_facts(spark, c.train, c.valid, c.test), _schema(spark, c), time.strftime("%Y%m%d-%H%M%S"), []
    known = facts.count()
    for name, (path, pattern) in c.rule_sets().items():
        found, table, steps, lengths, n = _planned(spark, path, pattern)
        for engine in c.engines() if found else []:
            for what, percent in [("rules", p) for p in percent_rules] + [("triples", p) for p in percent_triples]:
                chosen = materialize.top_rules(table, percent, len(found)) if what == "rules" else table
                predicted = written(materialize.predictions(chosen, steps, graph, _engine(engine, schema, graph), lengths, n), "predicted")
                new = materialize.new_triples(predicted, facts) if what == "rules" else materialize.until_target(predicted, facts, int(known * percent / 100))
                new = written(new, "new")
                paths.append(f"{out}/{sinks.output_name(c.dataset_name, name, engine, percent, stamp, what)}")
                sinks.write_ntriples(new, paths[-1])
                sinks.logger().info("%s %s", paths[-1], materialize.stats(chosen, predicted, new).first().asDict())
    return paths


def violation_counts(spark: SparkSession, c: configs.Config, out: str) -> list[dict]:
    """Counts for each file of the newest run under out."""
    tbox, schema = rdf.scan_rdf(spark, c.schema), _schema(spark, c)
    base = written(rdfs_closure(rdf.scan_rdf(spark, c.graph, tsv=True), tbox), "base")
    paths = sinks.latest_run(spark, out, c.dataset_name or None)
    if not paths:
        return []
    counted = violations.counts_by_file(written(sinks.scan_outputs(spark, paths), "outputs"), base, schema).orderBy("file")
    rows = [r.asDict() for r in counted.toLocalIterator()]  # a row for each file
    for row in rows:
        sinks.logger().info("%s", row)
    return rows


def main() -> None:
    arguments = argparse.ArgumentParser(description=__doc__)
    arguments.add_argument("stage", choices=("lp", "mat", "mateval"))
    arguments.add_argument("config")
    arguments.add_argument("--rules", default="1,5,10")
    arguments.add_argument("--triples", default="")
    arguments.add_argument("--out", default=None)
    a = arguments.parse_args()
    c, spark = configs.load(a.config), SparkSession.builder.getOrCreate()
    out = a.out or c.predictions_dir
    if a.stage == "lp":
        link_prediction(spark, c, a.out)
    elif a.stage == "mat":
        materialization(spark, c, out, configs.percentages(a.rules), configs.percentages(a.triples))
    else:
        violation_counts(spark, c, out)


if __name__ == "__main__":
    main()

"""Readers and writers on small files."""

from hornbeam.operators.schema import OWL, RDF_TYPE, Schema
from hornbeam.sources import config, rdf, rules, sinks, triples


def put(folder, name, text):
    (folder / name).write_text(text)
    return f"file://{folder / name}"


def test_graph_and_fact_files_are_tokenized_differently(spark, tmp_path):
    path = put(tmp_path, "g.txt", "# note\n\n a b \tp\t c \textra\nshort\tp\nx\tq\ty\nx\tq\ty\n")
    assert [tuple(r)[:3] for r in triples.scan_triples(spark, path).orderBy("pos").collect()] == [("a b", "p", "c"), ("x", "q", "y"), ("x", "q", "y")]
    facts = {tuple(r) for r in triples.known_facts(spark, path, None, f"file://{tmp_path}/missing").collect()}
    assert ("x", "q", "y") in facts and len([f for f in facts if f[0] == "x"]) == 1
    assert triples.known_facts(spark, None, "").count() == 0
    assert triples.scan_test(spark, path, 5).count() == triples.scan_test(spark, path).count() - 1


def test_rule_files(spark, tmp_path):
    path = put(tmp_path, "rules", "# c\n100\t42\t0.9\th(X,Y) <= a(X,A), b(A,Y)\n\n10\t9.99\t1\tbad\nx\ty\tz\th(X,Y) <= a(X,Y)\n")
    found, bad = rules.load(spark, path)
    assert [r.text for r in found] == ["h(X,Y) <= a(X,A), b(A,Y)"] and bad == 1
    assert rules.load(spark, None) == ([], 0) and rules.load(spark, f"file://{tmp_path}/none") == ([], 0)
    assert rules.load(spark, path, confidence_column=True)[0][0].conf > 0.89


def test_ontologies_in_three_formats(spark, tmp_path):
    ttl = put(tmp_path, "o.ttl", f"@prefix owl: <{OWL}> . @prefix : <http://e/> . # note\n:p a owl:ObjectProperty , owl:FunctionalProperty ; owl:inverseOf :q .\n:C a owl:Class ; owl:unionOf ( :A :B ) ; :label \"x; y.\"@en .")
    xml = put(tmp_path, "o.owl", f'<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="{OWL}"><owl:ObjectProperty rdf:about="http://e/p"><owl:inverseOf rdf:resource="http://e/q"/></owl:ObjectProperty><owl:Class rdf:about="http://e/C"/></rdf:RDF>')
    nt = put(tmp_path, "o.nt", f'<http://e/p> <{RDF_TYPE}> <{OWL}ObjectProperty> .\n# c\n<http://e/p> <http://e/l> "a \\" b"@en .\n')
    for path in (ttl, xml, nt):
        rows = {tuple(r) for r in rdf.scan_rdf(spark, path).collect()}
        assert ("http://e/p", RDF_TYPE, f"{OWL}ObjectProperty") in rows
        assert Schema(rdf.scan_rdf(spark, path)).constraints.count() >= 1
    assert {r["p"] for r in rdf.scan_rdf(spark, ttl).collect()} >= {f"{OWL}inverseOf", f"{OWL}unionOf", "http://e/label"}


def test_outputs_are_found_and_read_again(spark, tmp_path):
    t = spark.createDataFrame([("a", "p", "b"), ("c", "q", "d")], "s string, p string, o string")
    for run, name in (("run1", sinks.output_name("set", "ALL", "standard", 0.5, "1")), ("run2", sinks.output_name("set", "ALL", "semantic", 1, "2"))):
        sinks.write_ntriples(t, f"file://{tmp_path}/{run}/{name}")
    found = sinks.latest_run(spark, f"file://{tmp_path}", "set")
    assert len(found) == 1 and found[0].endswith("set_ALL_semantic_1_rules_2.nt")
    rows = sinks.scan_outputs(spark, f"file://{tmp_path}").collect()
    assert len(rows) == 4 and {r["file"] for r in rows} == {"set_ALL_standard_0.5_rules_1.nt", "set_ALL_semantic_1_rules_2.nt"}


def test_configuration(tmp_path):
    (tmp_path / "c.json").write_text('{"train": "t", "grounding_type": "semantic", "anyburl_rules": "r", "other": 1}')
    c = config.load(str(tmp_path / "c.json"))
    assert c.train == "t" and c.engines() == ["semantic"] and list(c.rule_sets()) == ["ALL"]
    assert config.percentages("1, 5,10") == [1.0, 5.0, 10.0] and config.percentages(None, (1.0,)) == [1.0]


def test_results_as_csv_and_markdown(spark, tmp_path):
    rows = spark.createDataFrame([("ALL", 0.5, None), ("CP", 0.25, 3)], "name string, mrr double, n long")
    text = sinks.write_results(rows, f"file://{tmp_path}/r.csv", f"file://{tmp_path}/r.md")
    assert text.splitlines() == ["| name | mrr | n |", "|---|---|---|", "| ALL | 0.5000 |  |", "| CP | 0.2500 | 3 |"]
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"file://{tmp_path}/r.csv").collect())) == [("ALL", "0.5", None), ("CP", "0.25", "3")]
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/r.md").collect()] == text.splitlines() + [""]

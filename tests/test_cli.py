"""The three stages on small files."""

import json

from hornbeam import cli
from hornbeam.operators.schema import OWL, RDF_TYPE, RDFS
from hornbeam.sources import config


def test_stages_from_files(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and f"file://{tmp_path}/{name}"
    given = {
        "dataset_name": "tiny",
        "train": put("train.tsv", "s1\tr1\tm1\ns2\tr1\tm1\nm1\tr2\tc1\ns2\tp1\tc1\n"),
        "test": put("test.tsv", "s1\tp1\tc1\n"),
        "graph": put("graph.nt", "<s2> <p1> <c9> .\n<s1> <r1> <m1> .\n"),
        "schema": put("schema.nt", f"<p1> <{RDF_TYPE}> <{OWL}ObjectProperty> .\n<p1> <{RDF_TYPE}> <{OWL}FunctionalProperty> .\n<p1> <{RDFS}range> <K> .\n"),
        "types_file": put("types.nt", f"<c1> <{RDF_TYPE}> <K> .\n"),
        "anyburl_rules": put("rules", "100\t50\t0\tp1(X,Y) <= r1(X,A), r2(A,Y)\n"),
        "grounding_type": "both",
    }
    (tmp_path / "c.json").write_text(json.dumps(given))
    c = config.load(str(tmp_path / "c.json"))
    lines = cli.link_prediction(spark, c, f"file://{tmp_path}/log")
    assert [x.split()[:3] for x in lines[1:]] == [["ALL", "standard", "1.0000"], ["ALL", "semantic", "1.0000"]]
    logged = "".join(p.read_text() for p in (tmp_path / "log" / "tiny_ALL_standard.log").glob("part-*"))
    assert "s1 p1 c1" in logged and "Heads: s1\t" in logged and "Tails: c1\t" in logged
    # what is to be predicted must not be known
    paths = cli.materialization(spark, config.Config(**(vars(c) | {"test": ""})), f"file://{tmp_path}/out", [100.0], [50.0])
    assert len(paths) == 4
    rows = {r["file"]: r for r in cli.violation_counts(spark, c, f"file://{tmp_path}/out")}
    assert len(rows) == 4 and all(r["triples"] == 1 and r["func"] == 0 for r in rows.values())

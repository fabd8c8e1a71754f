"""Registered queries of sources, sinks, data preparation and schema axioms, each with its DuckDB counterpart.

What a query reads it writes before, from whole tables, in the format that it is about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.operators import grounding, materialize, rules, schema, tools, violations
from hornbeam.operators.schema import OWL, RDF_TYPE, RDFS
from hornbeam.plans import lift
from hornbeam.plans.graph import Graph
from hornbeam.plans.queries import _grounded, _rounded, _values, query
from hornbeam.sources import rdf, sinks
from hornbeam.sources import rules as rule_files
from hornbeam.sources import triples as sources
from hornbeam.sources.shared import new_path, written

_KIND = "split_part({}, '/', 1)"


def _table(g: Graph, name: str) -> DataFrame:
    return g.spark.read.parquet(f"{g.sf_dir}/{name}.parquet")


def _text(g: Graph, name: str, rows: DataFrame, line: F.Column, suffix: str = "") -> str:
    path = new_path(g.spark, name) + suffix
    rows.select(line.alias("value")).write.text(path)
    return path


def _tabbed(*columns: str) -> F.Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in columns])


# sources and sinks


#: Support and confidence of `inverse <= p` for each predicate, with four decimals of the confidence.
_MINED = "SELECT p, count(*) AS n, count(DISTINCT o) AS k, CAST(floor(count(DISTINCT o) * 10000 / count(*)) AS INT) AS per FROM {} GROUP BY p"


def _mined(g: Graph) -> DataFrame:
    rows = g.triples.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("o").alias("k"))
    per = F.floor(F.col("k") * 10000 / F.col("n")).cast("int")
    decimals = F.concat(F.floor(per / 10000).cast("string"), F.lit("{}"), F.lpad((per % 10000).cast("string"), 4, "0"))
    return rows.withColumn("decimals", decimals)


@query("rule_scan", "SELECT CAST(n AS FLOAT) AS predicted, CAST(k AS FLOAT) AS correct, round(per / 10000, 4) AS given, 'inv_' || p || '(X,Y) <= ' || p || '(Y,X)' AS rule FROM mined", {"mined": _MINED.format("g")})
def _(g: Graph) -> DataFrame:
    """A rule file with a comment, a blank, a short and a wordy line for each rule."""
    rows = _mined(g).withColumn("given", F.replace("decimals", F.lit("{}"), F.lit("."))).withColumn("rule", F.expr("concat('inv_', p, '(X,Y) <= ', p, '(Y,X)')"))
    good = _tabbed("n", "k", "given", "rule")
    path = _text(g, "rules", rows, F.explode(F.array(good, F.concat(F.lit("# "), good), F.lit(" "), _tabbed("n", "k", "given"), F.concat(F.lit("many"), good))))
    return rule_files.scan_rules(g.spark, path).select("predicted", "correct", F.round(F.col("given").cast("double"), 4).alias("given"), "rule")


_UNARY = {
    "unary": "SELECT 'segment/' || c_mktsegment AS seg, 'nation/' || c_nationkey AS nat, sum(count(*)) OVER (PARTITION BY c_nationkey) AS predicted, count(*) AS correct FROM customer GROUP BY c_mktsegment, c_nationkey",
}


@query(
    "rule_load",
    "SELECT 'segment(X,' || seg || ') <= custNation(X,' || nat || ')' AS text, 'unary' AS kind, 'segment' AS head_p, 'X' AS head_s, seg AS head_o, round(CAST(CAST(correct AS FLOAT) / (CAST(predicted AS FLOAT) + CAST(5 AS FLOAT)) AS DOUBLE), 6) AS conf FROM unary",
    _UNARY,
)
def _(g: Graph) -> DataFrame:
    """Rules with constants, mined from customers: parsed, told apart by kind, with smoothed confidences. One certain rule for each is left out."""
    rows = _table(g, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("correct"))
    rows = rows.join(rows.groupBy("c_nationkey").agg(F.sum("correct").alias("predicted")), "c_nationkey")
    rows = rows.withColumn("rule", F.expr("concat('segment(X,segment/', c_mktsegment, ') <= custNation(X,nation/', c_nationkey, ')')")).withColumn("one", F.lit("1"))
    path = _text(g, "unary-rules", rows, F.explode(F.array(_tabbed("predicted", "correct", "one", "rule"), F.concat(F.lit("1000\t999\t1\t"), "rule"), F.lit("5\t5\t1\tno rule"))))
    found, _ = rule_files.load(g.spark, path)
    return rules.rule_table(g.spark, found).select("text", "kind", "head_p", "head_s", "head_o", F.round(F.col("conf").cast("double"), 6).alias("conf"))


@query(
    "amie_conversion",
    "SELECT CAST(n AS FLOAT) AS predicted, CAST(k AS FLOAT) AS correct, round(per / 10000, 4) AS given, 'inv_' || p || '(a,b) <= ' || p || '(b,a), ' || p || '(b,c)' AS rule FROM mined WHERE n > 1 AND per < 10000",
    {"mined": _MINED.format("g")},
)
def _(g: Graph) -> DataFrame:
    """A miner's table of whole counts, with decimal commas, turned into a rule file and scanned."""
    rows = _mined(g).withColumn("conf", F.replace("decimals", F.lit("{}"), F.lit(","))).withColumn("mined", F.expr("concat('?b  ', p, '  ?a  ?b  ', p, '  ?c   => ?a  inv_', p, '  ?b')"))
    rows = rows.withColumn("coverage", F.lit("0,5"))
    path = _text(g, "mined", rows, F.explode(F.array(F.lit("Rule\tHead Coverage\tStd Confidence\tPCA Confidence\tPositive Examples\tBody size"), _tabbed("mined", "coverage", "conf", "conf", "k", "n"))))
    out = new_path(g.spark, "converted")
    rule_files.convert_amie(g.spark, path, out)
    return rule_files.scan_rules(g.spark, out).select("predicted", "correct", F.round(F.col("given").cast("double"), 4).alias("given"), "rule")


@query("ntriples_sink", "SELECT s, p, o FROM g")
def _(g: Graph) -> DataFrame:
    path = new_path(g.spark, "graph") + ".nt"
    sinks.write_ntriples(g.triples, path)
    return rdf.scan_rdf(g.spark, path)


#: nation n in region r, as an ontology: a class, its superclass, and a label.
_ONTOLOGY = (
    f"SELECT 'http://example.org/nation/' || n_nationkey AS s, '{RDFS}subClassOf' AS p, 'http://example.org/region/' || n_regionkey AS o FROM nation "
    f"UNION ALL SELECT 'http://example.org/nation/' || n_nationkey, '{RDF_TYPE}', '{OWL}Class' FROM nation UNION ALL SELECT 'http://example.org/nation/' || n_nationkey, '{RDFS}label', '\"' || n_name || '\"' FROM nation"
)


@query("ontology_scan", "SELECT kind, s, p, o FROM (VALUES ('nt'), ('ttl'), ('owl'), ('tsv')) k(kind) CROSS JOIN onto", {"onto": _ONTOLOGY})
def _(g: Graph) -> DataFrame:
    """One ontology as N-Triples, Turtle, RDF/XML, and tab-separated columns without an extension that names a format."""
    n, space = _table(g, "nation").repartition(1), "http://example.org/"
    short = "concat('<{0}nation/', n_nationkey, '>')".format(space)
    lines = {
        "nt": f"concat({short}, ' <{RDFS}subClassOf> <{space}region/', n_regionkey, '> .\n', {short}, ' <{RDF_TYPE}> <{OWL}Class> .\n', {short}, ' <{RDFS}label> \"', n_name, '\" .')",
        "ttl": f"concat('@prefix rdfs: <{RDFS}> . @prefix owl: <{OWL}> .\n', {short}, ' a owl:Class ; rdfs:subClassOf <{space}region/', n_regionkey, '> ; rdfs:label \"', n_name, '\" .')",
        "tsv": f"concat({short}, '\t<{RDFS}subClassOf>\t<{space}region/', n_regionkey, '>\n', {short}, '\t<{RDF_TYPE}>\t<{OWL}Class>\n', {short}, '\t<{RDFS}label>\t\"', n_name, '\"')",
    }
    paths = {k: _text(g, "ontology", n, F.expr(e), "" if k == "tsv" else f".{k}") for k, e in lines.items()}
    each = f"concat('<owl:Class rdf:about=\"{space}nation/', n_nationkey, '\"><rdfs:subClassOf rdf:resource=\"{space}region/', n_regionkey, '\"/><rdfs:label>', n_name, '</rdfs:label></owl:Class>')"
    whole = n.agg(F.array_join(F.collect_list(F.expr(each)), "\n").alias("body"))  # one row of an ontology's size
    paths["owl"] = _text(g, "ontology", whole, F.expr(f"concat('<?xml version=\"1.0\"?>\n<rdf:RDF xmlns:rdf=\"{rdf.RDF}\" xmlns:rdfs=\"{RDFS}\" xmlns:owl=\"{OWL}\">', body, '</rdf:RDF>')"), ".owl")
    out = [rdf.scan_rdf(g.spark, path, tsv=kind == "tsv").select(F.lit(kind).alias("kind"), "s", "p", "o") for kind, path in paths.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    "prediction_log",
    "SELECT replace(q.qid, chr(9), ' ') AS triple, coalesce(h.listed, '') AS heads, coalesce(t.listed, '') AS tails FROM (SELECT DISTINCT qid FROM qry) q LEFT JOIN listed h ON h.qid = q.qid AND h.side = 'sub' LEFT JOIN listed t ON t.qid = q.qid AND t.side = 'obj'",
    {"listed": "SELECT qid, side, string_agg(candidate || ' ' || printf('%.4f', CAST(confs[1] AS DOUBLE)), ' ' ORDER BY raw_rank) AS listed FROM filt GROUP BY qid, side"},
)
def _(g: Graph) -> DataFrame:
    """The log of a link prediction, read back: blocks of three lines, confidences to four decimals."""
    path = new_path(g.spark, "log")
    sinks.write_prediction_log(g.link_prediction().log_lines(), path)
    blocks = g.spark.read.option("lineSep", "\n\n").text(path).select(F.split("value", "\n").alias("lines")).filter(F.size("lines") >= 3)
    pairs = lambda i, word: F.split(F.expr(f"substr(lines[{i}], {len(word) + 1})"), "\t")
    short = lambda c: F.array_join(F.transform(c, lambda x, at: F.when(at % 2 == 1, F.format_string("%.4f", x.cast("float").cast("double"))).otherwise(x)), " ")
    return blocks.select(F.expr("lines[0]").alias("triple"), short(pairs(1, "Heads: ")).alias("heads"), short(pairs(2, "Tails: ")).alias("tails"))


@query("latest_run", "SELECT n_nationkey || '.nt' AS file FROM nation WHERE n_regionkey = (SELECT max(n_regionkey) FROM nation)")
def _(g: Graph) -> DataFrame:
    """Runs named by region, with an output for each nation: those of the last run."""
    folder, jvm = new_path(g.spark, "runs"), g.spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(g.spark._jsc.hadoopConfiguration())
    for run, n in _table(g, "nation").select("n_regionkey", "n_nationkey").toLocalIterator():  # a file for each nation
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/run-{run:03d}/{n}.nt")).close()
    return g.spark.createDataFrame([(x.rsplit("/", 1)[-1],) for x in sinks.latest_run(g.spark, folder)], "file string")


@query("test_first_lines", "SELECT s, p, o FROM (SELECT DISTINCT s, p, o FROM test) ORDER BY s, p, o LIMIT 50")
def _(g: Graph) -> DataFrame:
    """The first 50 lines of a sorted test file."""
    lines = g.test.distinct().repartition(1).sortWithinPartitions("s", "p", "o")
    return sources.scan_test(g.spark, _text(g, "test", lines, _tabbed("s", "p", "o")), 50).select("s", "p", "o")


@query("union_of_splits", "SELECT s, p, o FROM g UNION ALL SELECT s, p, o FROM test")
def _(g: Graph) -> DataFrame:
    """Train, valid, test, and test again: repeated triples stay."""
    return sources.union(g.folded.filter("fold < 8"), g.folded.filter("fold = 8"), g.test, g.test)


# rules


@query(
    "materialize_all_rules",
    "SELECT s, p, o, min(rule_rank) AS rule_rank FROM allfacts x JOIN rul r USING (rule_id) WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.s = x.s AND t.p = x.p AND t.o = x.o) GROUP BY s, p, o",
    {
        "train": "SELECT DISTINCT s, p, o FROM lifted",
        "allfacts": "SELECT 1 AS rule_id, x AS s, 'placedBy' AS p, y AS o FROM r1 "
        + "".join(f"UNION ALL SELECT {i}, x, '{p}', y FROM r{i} " for i, p in ((2, "custNation"), (3, "hasSupplier"), (4, "suppliedBy"), (5, "custNation"), (6, "segment"), (7, "did"), (8, "placedBy")))
        + "UNION ALL SELECT 9, x.s, 'rival', w.s FROM train x JOIN train w ON x.p = 'suppNation' AND w.p = 'suppNation' AND x.o = w.o "
        "UNION ALL SELECT 101, x.s, 'sourcedFrom', w.o FROM train x JOIN train w ON x.p = 'hasPart' AND w.p = 'suppliedBy' AND x.o = w.s JOIN train z ON z.p = 'hasSupplier' AND z.s = x.s AND z.o = w.o "
        "UNION ALL SELECT 102, x.s, 'peer', w.s FROM train x JOIN train w ON x.p = 'suppNation' AND w.p = 'suppNation' AND x.o = w.o AND x.s <> w.s",
    },
)
def _(g: Graph) -> DataFrame:
    """All rules and patterns over all triples: train, valid and test."""
    table, steps, lengths, n = g.some()
    facts = written(g.triples.distinct(), "all-triples")
    return materialize.new_triples(materialize.predictions(table, steps, facts, g.engine("standard", facts), lengths, n), facts)


@query(
    "pattern_order",
    "SELECT DISTINCT x.s AS anchor, w.o AS candidate FROM train x JOIN train w ON x.p = 'hasPart' AND w.p = 'suppliedBy' AND x.o = w.s JOIN train z ON z.p = 'hasSupplier' AND z.s = x.s AND z.o = w.o",
)
def _(g: Graph) -> DataFrame:
    """A pattern whose first atoms touch nothing that is bound yet, and one that never will be."""
    rule = rules.parse_rule("sourcedFrom(X,Y) <= brand(C,D), suppliedBy(A,Y), hasPart(X,A), hasSupplier(X,Y)", 0.5, 1, pattern=True)
    table, steps = rules.rule_table(g.spark, [rule]), rules.step_table(g.spark, [rule])
    graph = g.coded(*sorted({a.p for a in rule.body}))
    found = grounding.candidates(table, steps, grounding.adjacency(graph, steps), [3, 4], 4, codec=g.codec)
    return g.codec.decode(found.filter("side = 'obj'").select("anchor", "candidate"), "anchor", "candidate")


_FILE = "SELECT DISTINCT x AS s, '{}' AS p, y AS o FROM {} x WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.s = x.x AND t.p = '{}' AND t.o = x.y)"
_FILES = {"f2": _FILE.format("custNation", "r2", "custNation"), "f5": _FILE.format("custNation", "r5", "custNation"), "f8": _FILE.format("placedBy", "r8", "placedBy")}
_OTHER = "EXISTS (SELECT 1 FROM (SELECT s, p, o FROM train UNION ALL SELECT s, p, o FROM {f}) b WHERE b.p = n.p AND b.{end} = n.{end} AND b.{many} <> n.{many})"
_CASES = ", ".join([
    "n.p IN (SELECT p FROM flags WHERE functional) AND " + _OTHER.format(f="{f}", end="s", many="o") + " AS func",
    "n.p IN (SELECT p FROM flags WHERE inverse_functional) AND " + _OTHER.format(f="{f}", end="o", many="s") + " AS invf",
    "EXISTS (SELECT 1 FROM typ JOIN dd ON dd.cls = typ.cls WHERE typ.e = n.s AND dd.p = n.p) AS dom",
    "EXISTS (SELECT 1 FROM typ JOIN dr ON dr.cls = typ.cls WHERE typ.e = n.o AND dr.p = n.p) AS ran",
])


@query(
    "violations_by_file",
    " UNION ALL ".join(
        f"SELECT 'rule-{f}.nt' AS file, count(*) AS triples, " + ", ".join(f"CAST(sum(CAST({k} AS INT)) AS BIGINT) AS {k}" for k in ("func", "invf", "dom", "ran"))
        + f", CAST(sum(CAST(func OR invf OR dom OR ran AS INT)) AS BIGINT) AS inc, round(1 - sum(CAST(func OR invf OR dom OR ran AS INT)) / count(*), 9) AS sem FROM j{f}"
        for f in (2, 5, 8)
    ),
    _FILES | {f"j{f}": f"SELECT n.*, {_CASES.format(f=f'f{f}')} FROM f{f} n" for f in (2, 5, 8)},
)
def _(g: Graph) -> DataFrame:
    """An output for each of three rules; outputs are judged apart, in one job."""
    # only known triples of the heads can be predicted, or be other ends of what is predicted
    folder, base = new_path(g.spark, "outputs"), written(g.train.filter("p IN ('custNation', 'placedBy')").distinct(), "base")
    for i, head, n, kind, side in ((2, "custNation", 3, "binary", "obj"), (5, "custNation", 1, "unary", "obj"), (8, "placedBy", 1, "binary", "obj")):
        rows = _grounded(g, head, n, kind, side).select(F.col("anchor").alias("s"), F.lit(head).alias("p"), F.col("candidate").alias("o"))
        sinks.write_ntriples(rows.distinct().join(base, ["s", "p", "o"], "left_anti"), f"{folder}/rule-{i}.nt")
    return _rounded(violations.counts_by_file(written(sinks.scan_outputs(g.spark, folder), "scanned"), base, g.schema))


# data preparation


@query("type_triples", f"SELECT e AS s, '{RDF_TYPE}' AS p, {_KIND.format('e')} AS o FROM ent WHERE e IN (SELECT s FROM g WHERE p = 'custNation' UNION SELECT o FROM g WHERE p = 'custNation')")
def _(g: Graph) -> DataFrame:
    own = grounding.entities(g.triples).select(F.col("entity").alias("s"), F.lit(RDF_TYPE).alias("p"), tools.type_by_prefix(F.col("entity"), "/").alias("o"))
    return tools.type_triples(g.triples.unionByName(own), g.triples.filter("p = 'custNation'"))


#: Observed classes at both ends, with the two predicates of nations as one.
_ENDS = {
    "seen": f"SELECT DISTINCT CASE WHEN p IN ('custNation', 'suppNation') THEN 'nationOf' ELSE p END AS p, {_KIND.format('s')} AS d, {_KIND.format('o')} AS r FROM g",
    "ends": "SELECT p, list_sort(list(DISTINCT d)) AS ds, list_sort(list(DISTINCT r)) AS rs FROM seen GROUP BY p",
}


def _domains(g: Graph) -> DataFrame:
    kind = lambda c: tools.type_by_prefix(F.col(c), "/")
    p = F.when(F.col("p").isin("custNation", "suppNation"), "nationOf").otherwise(F.col("p"))
    seen = g.triples.select(p.alias("prop"), kind("s").alias("d"), kind("o").alias("r")).distinct()
    rows = seen.select(F.col("prop").alias("s"), F.lit("http://schema.org/domainIncludes").alias("p"), F.col("d").alias("o"))
    rows = rows.unionByName(seen.select(F.col("prop").alias("s"), F.lit(f"{RDFS}range").alias("p"), F.col("r").alias("o")))
    return tools.domain_range(rows.unionByName(seen.select(F.col("prop").alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit("thing").alias("o"))))


@query("domain_range_lookup", "SELECT p, array_to_string(ds, ' ') AS domains, array_to_string(rs, ' ') AS ranges FROM ends", _ENDS)
def _(g: Graph) -> DataFrame:
    return _domains(g).select("p", F.array_join("domains", " ").alias("domains"), F.array_join("ranges", " ").alias("ranges"))


@query(
    "tbox_builder",
    f"SELECT p AS s, '{RDF_TYPE}' AS p, '{OWL}ObjectProperty' AS o FROM ends"
    + "".join(
        f" UNION ALL SELECT p, '{RDFS}{k}', CASE WHEN len({c}) > 1 THEN '_:{k}-' || md5(p) ELSE {c}[1] END FROM ends UNION ALL SELECT '_:{k}-' || md5(p), '{OWL}unionOf', unnest({c}) FROM ends WHERE len({c}) > 1"
        for k, c in (("domain", "ds"), ("range", "rs"))
    ),
    _ENDS,
)
def _(g: Graph) -> DataFrame:
    return tools.tbox_of(_domains(g))


@query(
    "named_entities",
    "SELECT coalesce(x.name, s) AS s, p, coalesce(y.name, o) AS o FROM g LEFT JOIN names x ON x.id = s LEFT JOIN names y ON y.id = o",
    {"names": "SELECT 'nation/' || n_nationkey AS id, trim(n_name) AS name FROM nation UNION ALL SELECT 'region/' || r_regionkey, trim(r_name) FROM region UNION ALL SELECT 'customer/' || c_custkey, trim(c_name) FROM customer"},
)
def _(g: Graph) -> DataFrame:
    """Nations, regions and customers by their names, from a two-column file; other entities have none."""
    names = None
    for table, key, name in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"), ("customer", "c_custkey", "c_name")):
        rows = _table(g, table).select(F.concat(F.lit(f"{table}/"), key).alias("id"), F.col(name).alias("name"))
        names = rows if names is None else names.unionByName(rows)
    return tools.named(g.triples, sources.scan_names(g.spark, _text(g, "names", names, _tabbed("id", "name")))).select("s", "p", "o")


@query("metaedges", f"SELECT DISTINCT {_KIND.format('s')} AS source, p AS relation, {_KIND.format('o')} AS target FROM g")
def _(g: Graph) -> DataFrame:
    """Edges in words, functional ones directed (`order > placed By > customer`), the others not (`order - has Part - part`)."""
    kind = lambda c: tools.type_by_prefix(F.col(c), "/")
    word = F.regexp_replace("p", "([A-Z])", " $1")
    sign = F.when(F.col("p").isin(lift.FUNCTIONAL), " > ").otherwise(" - ")
    edges = g.triples.select(kind("s").alias("a"), word.alias("w"), kind("o").alias("b"), sign.alias("sign")).distinct()
    return edges.select(tools.metaedge(F.concat("a", "sign", "w", "sign", "b")).alias("e")).select("e.*")


@query("iris", f"SELECT 'http://example.org/' || e AS s, '{RDF_TYPE}' AS p, 'http://example.org/' || {_KIND.format('e')} AS o FROM ent")
def _(g: Graph) -> DataFrame:
    """Entities named `Kind::entity`, and their kinds, as IRIs."""
    own = grounding.entities(g.triples).select("entity", tools.type_by_prefix(F.col("entity"), "/").alias("kind"))
    return own.select(tools.iri(F.concat("kind", F.lit("::"), "entity"), "http://example.org/").alias("s"), F.lit(RDF_TYPE).alias("p"), tools.iri(F.col("kind"), "http://example.org/").alias("o"))


@query("flip_counts_lossy", "SELECT 'placedBy' AS p, 'placed' AS inverse, count(*) AS n_before, count(*) FILTER (WHERE fold < 8) AS n_after FROM lifted WHERE p = 'placedBy'")
def _(g: Graph) -> DataFrame:
    """After a flip of the train triples alone, the held-out ones are missed."""
    return tools.flip_counts(g.triples, tools.flip(g.folded.filter("fold < 8").select("s", "p", "o"), lift.INVERSE), lift.INVERSE)


@query("flip_remaining_some", "SELECT count(*) AS n FROM test WHERE p = 'placedBy'")
def _(g: Graph) -> DataFrame:
    """Originals that stay where the test triples were not flipped."""
    return tools.remaining(tools.flip(g.folded.filter("fold < 8").select("s", "p", "o"), lift.INVERSE).unionByName(g.test), list(lift.INVERSE))


_TURN = {f"{RDFS}domain": f"{RDFS}range", f"{OWL}FunctionalProperty": f"{OWL}InverseFunctionalProperty"}
_TURN |= {b: a for a, b in _TURN.items()}


@query(
    "flip_tbox",
    "SELECT CASE s WHEN 'placedBy' THEN 'placed' ELSE s END AS s, " + ", ".join(f"CASE WHEN s = 'placedBy' THEN CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TURN.items()) + f" ELSE {c} END ELSE {c} END AS {c}" for c in ("p", "o")) + " FROM tb",
    {"tb": _values(lift.tbox_rows(), "s, p, o")},
)
def _(g: Graph) -> DataFrame:
    return tools.flip_tbox(lift.tbox(g.spark), lift.INVERSE)


@query(
    "satisfaction_untyped",
    f"SELECT t.p, count(*) AS n_triples, count(*) FILTER (WHERE {_KIND.format('t.o')} <> 'supplier') AS n_typed, count(*) FILTER (WHERE {_KIND.format('t.o')} <> 'supplier' AND EXISTS (SELECT 1 FROM typ JOIN ran d ON d.cls = typ.cls WHERE typ.e = t.o AND d.p = t.p)) AS n_satisfied FROM (SELECT DISTINCT s, p, o FROM g) t GROUP BY t.p",
)
def _(g: Graph) -> DataFrame:
    """Suppliers have no types."""
    types = g.schema.types.filter(~F.col("entity").startswith("supplier/"))
    return tools.satisfaction(g.triples, g.schema.constraints.select("p", F.explode("range").alias("cls")), types, "o")


# schema axioms


@query(
    "property_axioms",
    "SELECT 'prop/' || k AS p, 'region/' || n_regionkey AS disjoint_props, k % 2 = 0 OR (k <> 12 AND (24 - k) % 7 = 0) AS functional, k % 3 = 0 AS symmetric, k % 5 = 0 AS transitive, k % 7 = 0 OR (k <> 12 AND (24 - k) % 2 = 0) AS inverse_functional FROM (SELECT n_nationkey AS k, n_regionkey FROM nation)",
)
def _(g: Graph) -> DataFrame:
    """A property for each nation, with kinds by its key, the inverse of that whose key makes 24 with its own, and one disjoint property."""
    n, prop = _table(g, "nation"), F.concat(F.lit("prop/"), "n_nationkey")
    of = lambda when, p, o: n.filter(when).select(prop.alias("s"), F.lit(p).alias("p"), (F.lit(o) if isinstance(o, str) else o).alias("o"))
    rows = of("true", RDF_TYPE, f"{OWL}ObjectProperty").unionByName(of("true", f"{OWL}propertyDisjointWith", F.concat(F.lit("region/"), "n_regionkey")))
    for every, kind in ((2, "Functional"), (3, "Symmetric"), (5, "Transitive"), (7, "InverseFunctional")):
        rows = rows.unionByName(of(f"n_nationkey % {every} = 0", RDF_TYPE, f"{OWL}{kind}Property"))
    rows = rows.unionByName(of("n_nationkey < 12", f"{OWL}inverseOf", F.concat(F.lit("prop/"), 24 - F.col("n_nationkey"))))
    return schema.constraints(rows).select("p", F.array_join("disjoint_props", " ").alias("disjoint_props"), "functional", "symmetric", "transitive", "inverse_functional")


@query(
    "blank_and_system_classes",
    "SELECT 'sub' AS kind, 'nation/' || n_nationkey AS a, 'region/' || n_regionkey AS b FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 0 "
    "UNION ALL SELECT 'type', 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation WHERE n_nationkey % 4 <> 0",
)
def _(g: Graph) -> DataFrame:
    """Subjects that are blank nodes have no superclass, and classes of the vocabularies are none."""
    n = _table(g, "nation")
    above = F.when(F.col("n_nationkey") % 4 == 0, f"{OWL}Thing").otherwise(F.concat(F.lit("region/"), "n_regionkey"))
    named = F.concat(F.lit("nation/"), "n_nationkey")
    subject = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("_:"), "n_nationkey")).otherwise(named)
    sub = schema.subclasses(n.select(subject.alias("s"), F.lit(f"{RDFS}subClassOf").alias("p"), above.alias("o")))
    types = schema.entity_types(n.select(named.alias("s"), F.lit(RDF_TYPE).alias("p"), above.alias("o")), sub.limit(0))
    return sub.select(F.lit("sub").alias("kind"), F.col("sub").alias("a"), F.col("super").alias("b")).unionByName(types.select(F.lit("type").alias("kind"), F.col("entity").alias("a"), F.col("cls").alias("b")))


_ABOVE = [("custNation", "nationOf"), ("suppNation", "nationOf"), ("nationOf", "locatedIn")]


@query(
    "rdfs_subproperties",
    f"SELECT * FROM fact UNION SELECT s, '{RDF_TYPE}', cls FROM fact JOIN dom USING (p) UNION SELECT o, '{RDF_TYPE}', cls FROM fact JOIN ran2 USING (p) "
    f"UNION SELECT s, '{RDF_TYPE}', b FROM fact JOIN dom USING (p) JOIN clos ON cls = a UNION SELECT o, '{RDF_TYPE}', b FROM fact JOIN ran2 USING (p) JOIN clos ON cls = a",
    {
        "nations": "SELECT s, p, o FROM train WHERE p IN ('custNation', 'suppNation')",
        "fact": "SELECT s, p, o FROM nations UNION SELECT s, 'nationOf', o FROM nations UNION SELECT s, 'locatedIn', o FROM nations",
        "ran2": "SELECT p, cls FROM ran UNION ALL SELECT 'locatedIn', 'region'",
    },
)
def _(g: Graph) -> DataFrame:
    """Two steps of subproperties, the upper with a range of its own."""
    more = [(a, f"{RDFS}subPropertyOf", b) for a, b in _ABOVE] + [("locatedIn", f"{RDFS}range", "region")]
    return schema.rdfs_closure(g.train.filter("p IN ('custNation', 'suppNation')"), lift.tbox(g.spark).unionByName(g.spark.createDataFrame(more, "s string, p string, o string")))

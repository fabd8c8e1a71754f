"""Preparation and verification of data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornbeam.operators.schema import OWL, RDF_TYPE, RDFS

#: Fixed value: predicates and terms of the RDF, RDFS, OWL and SHACL vocabularies make schema triples.
SCHEMA_WORDS = r"(?i)http://www\.w3\.org/(1999/02/22-rdf-syntax-ns|2000/01/rdf-schema|2002/07/owl|ns/shacl)#"


def degrees(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("s", "o")).alias("entity")).groupBy("entity").agg(F.count("*").alias("degree"))


def degree_filter(triples: DataFrame, more_than: int = 10) -> DataFrame:
    """Triples whose subject and object both occur more than so often; one pass."""
    often = degrees(triples).filter(F.col("degree") > more_than).select("entity")
    kept = triples.join(often.withColumnRenamed("entity", "s"), "s", "left_semi")
    return kept.join(often.withColumnRenamed("entity", "o"), "o", "left_semi").select(triples.columns)


def without_literals(triples: DataFrame) -> DataFrame:
    """Triples that are neither of a schema vocabulary nor have a quoted object."""
    return triples.filter(~F.concat_ws(" ", "s", "p", "o").rlike(SCHEMA_WORDS) & ~F.col("o").startswith('"'))


def type_triples(triples: DataFrame, kept: DataFrame) -> DataFrame:
    """Type triples of the entities in kept."""
    own = kept.select(F.explode(F.array("s", "o")).alias("s")).distinct()
    return triples.filter(F.col("p") == RDF_TYPE).join(own, "s", "left_semi").select("s", "p", "o")


def split(triples: DataFrame, shares: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 42) -> list[DataFrame]:
    """Disjoint parts by a hash of the triple: the same on every run, whatever the partitions."""
    at = F.pmod(F.xxhash64("s", "p", "o", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    edges = [sum(shares[:i]) / sum(shares) for i in range(len(shares))] + [1.0]
    return [triples.filter((at >= a) & (at < b)) for a, b in zip(edges, edges[1:], strict=False)]


def domain_range(tbox: DataFrame) -> DataFrame:
    """p, domains, ranges."""
    rows = tbox.filter(F.col("p").isin(f"{RDFS}domain", f"{RDFS}range", "http://schema.org/domainIncludes", "http://schema.org/rangeIncludes"))
    of = lambda k: F.sort_array(F.collect_set(F.when(F.lower("p").contains(k), F.col("o"))))
    return rows.groupBy(F.col("s").alias("prop")).agg(of("domain").alias("domains"), of("range").alias("ranges")).withColumnRenamed("prop", "p")


def tbox_of(domains: DataFrame) -> DataFrame:
    """s, p, o of properties with domains and ranges (p, domains, ranges): several are a union, written as a blank node."""
    out = domains.select(F.col("p").alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(f"{OWL}ObjectProperty").alias("o"))
    for name in ("domain", "range"):
        many = F.size(f"{name}s") > 1
        value = F.when(many, F.concat(F.lit(f"_:{name}-"), F.md5("p"))).otherwise(F.element_at(f"{name}s", 1))
        some = domains.filter(F.size(f"{name}s") > 0)
        out = out.unionByName(some.select(F.col("p").alias("s"), F.lit(f"{RDFS}{name}").alias("p"), value.alias("o")))
        union = some.filter(many).select(F.concat(F.lit(f"_:{name}-"), F.md5("p")).alias("s"), F.lit(f"{OWL}unionOf").alias("p"), F.explode(f"{name}s").alias("o"))
        out = out.unionByName(union)
    return out


def pairwise_disjoint(classes: DataFrame, both: bool = True) -> DataFrame:
    """s, owl:disjointWith, o of all pairs of the classes of a schema (cls); a schema has few."""
    a, b = classes.select(F.col("cls").alias("s")).distinct(), classes.select(F.col("cls").alias("o")).distinct()
    pairs = a.join(F.broadcast(b), F.col("s") != F.col("o") if both else F.col("s") < F.col("o"))
    return pairs.select("s", F.lit(f"{OWL}disjointWith").alias("p"), "o")


def named(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Ids of subjects and objects replaced by names (id, name); ids without a name stay."""
    out = triples
    for c in ("s", "o"):
        n = names.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name"))
        out = out.join(n, out[c] == n[f"{c}_id"], "left").withColumn(c, F.coalesce(f"{c}_name", c)).drop(f"{c}_id", f"{c}_name")
    return out


def type_by_prefix(entity: Column, separator: str = "_") -> Column:
    return F.substring_index(entity, separator, 1)


def metaedge(edge: Column) -> Column:
    """source, relation and target, without spaces, of `Source - relation - Target` or, if directed, `Source > relation > Target`."""
    parts = F.transform(F.when(edge.contains("-"), F.split(edge, " - ")).otherwise(F.split(edge, " > ")), lambda x: F.replace(x, F.lit(" "), F.lit("")))
    return F.struct(F.get(parts, F.lit(0)).alias("source"), F.get(parts, F.lit(1)).alias("relation"), F.get(parts, F.lit(2)).alias("target"))


def iri(name: Column, space: str) -> Column:
    """The name's last part after `::` in a name space."""
    return F.concat(F.lit(space), F.substring_index(name, "::", -1))


def flip(triples: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """(s, p, o) becomes (o, inverse of p, s) for the properties that have one in `inverse`."""
    name = F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv])
    to = F.try_element_at(name, F.col("p"))
    return triples.withColumn("to", to).select(F.when(F.col("to").isNull(), F.col("s")).otherwise(F.col("o")).alias("s"), F.coalesce("to", "p").alias("p"), F.when(F.col("to").isNull(), F.col("o")).otherwise(F.col("s")).alias("o"))


def flip_tbox(tbox: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """Axioms of flipped properties are those of their inverse: domain and range, and functional and inverse functional, change places."""
    name = F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv])
    swap = F.create_map(*[F.lit(x) for a, b in ((f"{RDFS}domain", f"{RDFS}range"), (f"{OWL}FunctionalProperty", f"{OWL}InverseFunctionalProperty")) for x in (a, b, b, a)])
    rows = tbox.withColumn("to", F.try_element_at(name, F.col("s")))
    turned = lambda c: F.when(F.col("to").isNull(), F.col(c)).otherwise(F.coalesce(F.try_element_at(swap, F.col(c)), F.col(c)))
    return rows.select(F.coalesce("to", "s").alias("s"), turned("p").alias("p"), turned("o").alias("o"))


def flip_counts(before: DataFrame, after: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """p, n_before, n_after for each flipped property: equal if nothing was lost."""
    pairs = before.sparkSession.createDataFrame(list(inverse.items()), "p string, inverse string")
    b = before.groupBy("p").agg(F.count("*").alias("n_before"))
    a = after.groupBy(F.col("p").alias("inverse")).agg(F.count("*").alias("n_after"))
    return F.broadcast(pairs).join(b, "p", "left").join(a, "inverse", "left").select("p", "inverse", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def inverse_functionality(triples: DataFrame) -> DataFrame:
    """p, n_objects, n_single: how many of its objects have one subject."""
    per = triples.groupBy("p", "o").agg(F.countDistinct("s").alias("subjects"))
    return per.groupBy("p").agg(F.count("*").alias("n_objects"), F.sum((F.col("subjects") == 1).cast("long")).alias("n_single"))


def remaining(triples: DataFrame, properties: list[str]) -> DataFrame:
    """n: triples that still have one of the properties."""
    return triples.filter(F.col("p").isin(properties)).agg(F.count("*").alias("n"))


def satisfaction(triples: DataFrame, expected: DataFrame, types: DataFrame, end: str) -> DataFrame:
    """p, n_triples, n_typed, n_satisfied: triples whose `end` (s or o) has a type, and one among expected (p, cls)."""
    rows = triples.select("s", "p", "o").distinct()
    typed = rows.join(types.select(F.col("entity").alias(end)).distinct().withColumn("typed", F.lit(1)), end, "left")
    good = rows.join(types.withColumnRenamed("entity", end), end).join(expected, ["p", "cls"], "left_semi").select("s", "p", "o").distinct().withColumn("good", F.lit(1))
    return typed.join(good, ["s", "p", "o"], "left").groupBy("p").agg(F.count("*").alias("n_triples"), F.count("typed").alias("n_typed"), F.count("good").alias("n_satisfied"))


def reciprocal_leakage(triples: DataFrame) -> DataFrame:
    """r1, r2, pairs: how many (s, r1, o) come with an (o, r2, s)."""
    t = triples.select("s", "p", "o").distinct()
    x, y = t.alias("x"), t.alias("y")
    rows = x.join(y, F.expr("x.s = y.o AND x.o = y.s"))
    return rows.groupBy(F.col("x.p").alias("r1"), F.col("y.p").alias("r2")).agg(F.count("*").alias("pairs"))


def summary(triples: DataFrame) -> DataFrame:
    return triples.agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("p").alias("predicates"))

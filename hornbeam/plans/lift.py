"""The lift of the relational tables to a graph, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from hornbeam.operators.codec import DIGITS, Codec
from hornbeam.operators.schema import OWL, RDF_TYPE, RDFS
from hornbeam.sources.shared import local

#: predicate, tables, subject, object, and the key that splits train from test (null: all in train).
EDGES = [
    ("placedBy", "orders", "concat('order/', o_orderkey)", "concat('customer/', o_custkey)", "o_orderkey"),
    ("custNation", "customer", "concat('customer/', c_custkey)", "concat('nation/', c_nationkey)", "c_custkey"),
    ("suppNation", "supplier", "concat('supplier/', s_suppkey)", "concat('nation/', s_nationkey)", "0"),
    ("inRegion", "nation", "concat('nation/', n_nationkey)", "concat('region/', n_regionkey)", "0"),
    ("hasPart", "lineitem", "concat('order/', l_orderkey)", "concat('part/', l_partkey)", "0"),
    ("hasSupplier", "lineitem", "concat('order/', l_orderkey)", "concat('supplier/', l_suppkey)", "0"),
    ("suppliedBy", "lineitem", "concat('part/', l_partkey)", "concat('supplier/', l_suppkey)", "0"),
    ("brand", "part", "concat('part/', p_partkey)", "concat('brand/', p_brand)", "0"),
    ("ptype", "part", "concat('part/', p_partkey)", "concat('ptype/', p_type)", "0"),
    ("segment", "customer", "concat('customer/', c_custkey)", "concat('segment/', c_mktsegment)", "0"),
    ("did", "events", "concat('customer/', user_id)", "concat('event/', event_type)", "0"),
]
TABLES = sorted({e[1] for e in EDGES})
#: s, p, o and fold: 0 to 7 train, 8 valid, 9 test.
TRIPLES_SQL = " UNION ALL ".join(
    f"SELECT {'DISTINCT ' if t in ('lineitem', 'events') else ''}{s} AS s, '{p}' AS p, {o} AS o, CAST({k} % 10 AS INT) AS fold FROM {{{t}}}" for p, t, s, o, k in EDGES
)
#: The same triples: a name is its key behind a prefix, so that the keys are made distinct, not the names.
TRIPLES_OF_KEYS_SQL = " UNION ALL ".join(
    f"SELECT {s} AS s, '{p}' AS p, {o} AS o, CAST({k} % 10 AS INT) AS fold FROM "
    + (f"(SELECT DISTINCT {', '.join(x[:-1].split(', ')[1] for x in (s, o))} FROM {{{t}}})" if t in ("lineitem", "events") else f"{{{t}}}")
    for p, t, s, o, k in EDGES
)
#: (table, prefix, key) of every column that names entities.
KEYS = sorted({(e[1], *re.fullmatch(r"concat\('(.*)', (\w+)\)", name).groups()) for e in EDGES for name in e[2:4]})
FUNCTIONAL = ["placedBy", "custNation", "suppNation", "inRegion", "brand", "ptype", "segment"]
INVERSE = {"placedBy": "placed"}
DOMAIN_RANGE = {
    "placedBy": ("order", "agent"), "placed": ("agent", "order"), "custNation": ("customer", "place"), "suppNation": ("supplier", "place"), "inRegion": ("place", "place"),
    "hasPart": ("order", "part"), "hasSupplier": ("order", "agent"), "suppliedBy": ("part", "agent"), "brand": ("part", "brand"), "ptype": ("part", "ptype"),
    "segment": ("customer", "segment"), "did": ("agent", "event"),
}
SUBCLASSES = [("customer", "agent"), ("supplier", "agent"), ("agent", "thing"), ("nation", "place"), ("region", "place"), ("place", "thing")]
DISJOINT = [("agent", "place"), ("agent", "part"), ("order", "agent")]


def tbox_rows() -> list[tuple[str, str, str]]:
    rows = [(p, RDF_TYPE, f"{OWL}ObjectProperty") for p in DOMAIN_RANGE]
    rows += [(p, RDF_TYPE, f"{OWL}FunctionalProperty") for p in FUNCTIONAL]
    rows += [("placed", RDF_TYPE, f"{OWL}InverseFunctionalProperty")]
    rows += [(p, f"{RDFS}{k}", c) for p, ends in DOMAIN_RANGE.items() for k, c in zip(("domain", "range"), ends, strict=True)]
    rows += [(a, f"{RDFS}subClassOf", b) for a, b in SUBCLASSES]
    return rows + [(a, f"{OWL}disjointWith", b) for a, b in DISJOINT]


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRIPLES_OF_KEYS_SQL, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})


class Coded:
    """The triples with entities as codes, worked out from the keys: a key of a column without negative or overlong ones is
    the number of its name, so that no name is made, parsed or made distinct."""

    def __init__(self, spark: SparkSession, sf_dir: str, constants: list[str]):
        self.tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
        self.numbers = set()
        for t, df in self.tables.items():
            keys = [k for of, _, k in KEYS if of == t and isinstance(df.schema[k].dataType, IntegralType)]
            if keys:
                ends = df.agg(*[f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)]).first()
                self.numbers |= {(t, k) for k in keys if ends[f"min_{k}"] is None or ends[f"min_{k}"] >= 0 and ends[f"max_{k}"] < 10**DIGITS}
        names = [self.tables[t].select(F.concat(F.lit(stem), k).alias("name")).distinct() for t, stem, k in KEYS if (t, k) not in self.numbers]
        first = [f"{stem}0" for t, stem, k in KEYS if (t, k) in self.numbers]
        self.codec = Codec(reduce(DataFrame.unionByName, names) if names else local(spark, [], "name string"), [*constants, *first])

    def triples(self, *predicates: str) -> DataFrame:
        """s, p, o and fold of these predicates, read from the tables whenever they are used; rows may repeat."""
        out = []
        for p, t, *ends, k in EDGES:
            if p in predicates:
                columns, named = [], []
                for name, end in zip("so", ends, strict=True):
                    stem, key = next((x[1:] for x in KEYS if x[0] == t and end == f"concat('{x[1]}', {x[2]})"))
                    if self.codec.whole and (t, key) in self.numbers:
                        columns.append((F.lit(self.codec.code(f"{stem}0")) + F.col(key).cast("long")).alias(name))
                    else:
                        named.append(name)
                        columns.append(F.concat(F.lit(stem), key).alias(name))
                rows = self.tables[t].select(columns[0], F.lit(p).alias("p"), columns[1], F.expr(f"CAST({k} % 10 AS INT)").alias("fold"))
                out.append(self.codec.encode(rows, *named).select("s", "p", "o", "fold"))
        return reduce(DataFrame.unionByName, out)

    def places(self, predicate: str) -> list[set[int] | None]:
        """The places of the stems that the subjects and the objects of a predicate have; None: any."""
        of = [e for e in EDGES if e[0] == predicate]
        out: list[set[int] | None] = [set(), set()]
        for i in (0, 1):
            for _, t, *ends, _ in of:
                stem, key = next((x[1:] for x in KEYS if x[0] == t and ends[i] == f"concat('{x[1]}', {x[2]})"))
                known = out[i] is not None and self.codec.whole and (t, key) in self.numbers
                out[i] = out[i] | {self.codec.places[stem]} if known else None
        return out

    def present(self, names: list[str]) -> set[str]:
        """Those of the names that are entities of the triples."""
        some = [self.tables[t].select(F.concat(F.lit(stem), k).alias("name")) for t, stem, k in KEYS if any(n.startswith(stem) for n in names)]
        return {r[0] for r in reduce(DataFrame.unionByName, some).filter(F.col("name").isin(names)).distinct().collect()} if some else set()


def tbox(spark: SparkSession) -> DataFrame:
    return local(spark, tbox_rows(), "s string, p string, o string")


#: predicted, correct, text; the last three are patterns.
RULES = [
    (900, 60, "placedBy(X,Y) <= hasPart(X,A), hasPart(B,A), placedBy(B,Y)"),
    (500, 90, "custNation(X,Y) <= placedBy(A,X), hasSupplier(A,B), suppNation(B,Y)"),
    (400, 300, "hasSupplier(X,Y) <= hasPart(X,A), suppliedBy(A,Y)"),
    (300, 200, "suppliedBy(X,Y) <= hasPart(A,X), hasSupplier(A,Y)"),
    (120, 30, "custNation(X,nation/7) <= segment(X,segment/MACHINERY)"),
    (100, 25, "segment(X,segment/BUILDING) <= custNation(X,nation/5)"),
    (80, 10, "did(X,event/purchase) <= placedBy(A,X), hasSupplier(A,supplier/3)"),
    (70, 2, "placedBy(X,Y) <= hasPart(X,Y)"),
    (60, 20, "rival(X,Y) <= suppNation(X,A), suppNation(Y,A)"),
    (2000, 1999, "suppNation(X,Y) <= suppNation(X,Y)"),
]
PATTERNS = [
    (95, 40, "sourcedFrom(X,Y) <= hasPart(X,A), suppliedBy(A,Y), hasSupplier(X,Y)"),
    (65, 20, "peer(X,Y) <= suppNation(X,A), suppNation(Y,A)"),
]

"""Entities as 64-bit codes, so that joins and shuffles carry numbers.

A name is a stem and the decimal number behind it: `order/17` is (`order/`, 17). The code holds the stem's place in a
table and the number, so that no table of all entities is needed, and decoding gives the name back exactly. A name
without such a number (none, leading zeros, more than DIGITS digits) is a stem of its own. A graph of more than STEMS
stems keeps its names: every operator takes either.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.sources.shared import local

STEMS, DIGITS, BITS = 10_000, 13, 47


def _parted(df: DataFrame, name: str) -> DataFrame:
    """df with _stem, and _number: the number + 1 (0: the name is all stem). A column each, so that nothing is computed twice."""
    df = df.withColumn("_head", F.regexp_extract(name, "(?s)^.*[^0-9]", 0))
    df = df.withColumn("_digits", F.substring(name, F.length("_head") + 1, F.lit(1 << 30)))
    df = df.withColumn("_regular", F.length("_digits").between(1, DIGITS) & ((F.col("_digits") == "0") | ~F.col("_digits").startswith("0")))
    stem, number = F.when(F.col("_regular"), F.col("_head")).otherwise(F.col(name)), F.when(F.col("_regular"), F.col("_digits").try_cast("long") + 1).otherwise(F.lit(0).cast("long"))
    return df.withColumn("_stem", stem).withColumn("_number", number).drop("_head", "_digits", "_regular")


class Codec:
    def __init__(self, names: DataFrame, constants: Iterable[str] = ()):
        """names: frames of one column with every name of the graph, repeated or not. constants: further names, of rules."""
        spark = names.sparkSession
        if constants := sorted(set(constants)):
            names = names.toDF("name").unionByName(local(spark, [(c,) for c in constants], "name string"))
        stems = _parted(names.toDF("name").filter("name IS NOT NULL"), "name").select("_stem").distinct().limit(STEMS + 1).collect()
        self.whole = len(stems) <= STEMS
        self.places = {r[0]: i for i, r in enumerate(sorted(stems))} if self.whole else {}
        self.table = local(spark, list(self.places.items()), "stem string, place long")

    def code(self, name: str) -> int | str:
        """What encode() makes of a name."""
        if not self.whole:
            return name
        head = name.rstrip("0123456789")
        digits = name[len(head) :]
        regular = 1 <= len(digits) <= DIGITS and (digits == "0" or digits[0] != "0")
        return self.places[head if regular else name] << BITS | (int(digits) + 1 if regular else 0)

    def encode(self, df: DataFrame, *columns: str) -> DataFrame:
        """df with the names in columns as codes."""
        for c in columns if self.whole else ():
            places = F.broadcast(self.table.select(F.col("stem").alias("_key"), F.col("place").alias("_place")))
            code = F.when(F.col(c).isNotNull(), F.coalesce(F.shiftleft("_place", BITS), F.raise_error(F.concat(F.lit("not a name of the graph: "), c)).cast("long")).bitwiseOR(F.col("_number")))
            df = _parted(df, c).join(places, F.col("_stem") == F.col("_key"), "left").withColumn(c, code).drop("_key", "_number", "_stem", "_place")
        return df

    def decode(self, df: DataFrame, *columns: str) -> DataFrame:
        for c in columns if self.whole else ():
            places = F.broadcast(self.table.select(F.col("stem").alias("_stem"), F.col("place").alias("_place")))
            number = F.col(c).bitwiseAND(F.lit((1 << BITS) - 1))
            name = F.when(number > 0, F.concat("_stem", (number - 1).cast("string"))).otherwise(F.col("_stem"))
            df = df.join(places, F.shiftright(c, BITS) == F.col("_place"), "left").withColumn(c, name).drop("_stem", "_place")
        return df

"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_variable(term: Column) -> Column:
    """A term of one character is a variable."""
    return F.length(term) == 1


def smoothed_confidence(predicted: Column, correct: Column) -> Column:
    """correct / (predicted + 5) as a 32-bit float; predicted and correct are floats themselves."""
    return (correct.cast("float") / (predicted.cast("float") + F.lit(5).cast("float"))).cast("float")


def kept_confidence(conf: Column) -> Column:
    """Rules at 0.99 or above are not used."""
    return conf.cast("double") < F.lit(0.99)


def expected_hits(first: Column, last: Column, k: int) -> Column:
    """Hits@k of a target in a block of ties at ranks first to last, in the mean over orders of the block."""
    return F.when(last <= k, 1.0).when(first > k, 0.0).otherwise((F.lit(k) - first + 1) / (last - first + 1))


def expected_reciprocal_rank(first: Column, last: Column) -> Column:
    total = F.aggregate(F.sequence(first.cast("int"), last.cast("int")), F.lit(0.0), lambda acc, r: acc + F.lit(1.0) / r)
    return total / (last - first + 1)


def is_system_class(cls: Column) -> Column:
    """owl:Thing, rdfs:Resource and whatever lies in the RDF, RDFS and OWL vocabularies, or is a blank node."""
    spaces = ("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "_:")
    out = F.lit(False)
    for x in spaces:
        out = out | cls.startswith(x)
    return out

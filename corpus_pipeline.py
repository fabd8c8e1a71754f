"""A corpus pipeline of the llm operators: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All stages but the last keep the columns of documents, and
further columns, however they are named. Rows with nulls, empty texts or repeated ids go through every stage; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm import common, decontam, mixing, neardup, quality, token_io
from hornbeam.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labels, does not reject."""
    model = quality.fit(docs, common.read(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each component of near duplicates. Of rows that share a doc_id the
    least stays; rows with a null doc_id all stay."""
    found = common.written(neardup.near_duplicates(docs), "one-of-each")
    gone = common.written(found.filter(~F.col("kept")).select("doc_id").distinct(), "not-kept", True)
    repeated = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = common.written(repeated, "repeated-ids", True)
    common.drop(found)
    # ids are sent to all executors if they are counted to be few; else texts are shuffled
    out = docs.join(F.broadcast(gone) if gone.count() <= neardup.BROADCAST_IDS else gone, "doc_id", "left_anti")
    if not repeated.isEmpty():
        order = ["text", *[c for c in docs.columns if c != "text"]]
        least = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*order)).alias("row"))
        out = out.join(repeated, "doc_id", "left_anti").unionByName(least.select("row.*"))
    return out.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, each row judged by its own text."""
    return decontam.clean(docs, common.read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes, in its order."""
    return mixing.mix(docs).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the token files."""
    return token_io.encode_corpus(docs, tokenizer_path())


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_files", token_files),
]

#: SQL cannot express the classifier or the tokenizer; tests/llm compares run() with a brute-force version of the stages after the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done, docs = docs, common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        common.drop(done)
        common.release(spark)
    return docs

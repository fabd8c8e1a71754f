"""Benchmark decontamination: which short test items are contained in which documents, of any length.

An item is contained in a document if 100 * |shared distinct shingles| >= percent * |distinct shingles of the item|.

Containment search by size-partitioned MinHash. Items are partitioned by their number of shingles into classes (upper
bounds double). An item's signature is its minwise shingle under each of FUNCTIONS hash functions (in classes of at most
FUNCTIONS shingles, all of its shingles). A minwise shingle is any of the item's with equal probability, so a document has
it with a probability of just the item's containment in it, whatever the document's length: the share of the signature
that a document has estimates containment without a signature of the document, all of whose shingles are looked up.
Each class has a least number of hits, the largest that a contained item falls short of with probability MISS at most
(8 of 32; none in small classes), and is skipped for documents with fewer shingles than its smallest item needs.
Candidates are verified by counting the shared shingles of the whole sets. There is no shuffle but of result rows.

Items are sent to the executors in blocks of at most BLOCK items and BLOCK_WORDS words, one pass over the documents a
block, so what is broadcast is bounded however large the benchmark is.

Defined cases: items of fewer words than a shingle are one shingle of their k words and are looked for among the
document's k-word runs; null, empty and wordless items and texts contain nothing and are contained nowhere; rows
that repeat an item_id or doc_id are items or documents each, and equal result rows are given once; null ids are
kept as null; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.llm import common

PERCENT, FUNCTIONS, MISS, BLOCK, BLOCK_WORDS = 75, 32, 1e-9, 20_000, 4_000_000
_SEEDS = common.mixed(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * common.GOLDEN)
_OUT = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())]


def least_hits(percent: int, miss: float = MISS) -> int:
    """The largest number of hits that an item at the threshold falls short of with probability miss at most."""
    p, below = percent / 100, 0.0
    for hits in range(FUNCTIONS + 1):
        below += math.comb(FUNCTIONS, hits) * p**hits * (1 - p) ** (FUNCTIONS - hits)
        if below > miss:
            return max(1, hits)
    return FUNCTIONS


class Items:
    """A block of items with their signatures, by length of shingle and size."""

    def __init__(self, rows: list[tuple[int | None, str]], percent: int, k: int = common.SHINGLE):
        self.ids, self.sets, self.percent = [r[0] for r in rows], [], percent
        by: dict[tuple[int, int], list[int]] = {}
        for i, (_, text) in enumerate(rows):
            words = common.word_hashes(text.encode("utf-8", "surrogatepass"))
            own = min(k, len(words))
            self.sets.append(np.unique(common.combined(words, own)) if own else words)
            if own:
                by.setdefault((own, int(np.ceil(np.log2(len(self.sets[i]))))), []).append(i)
        #: length of shingle, shingles that its smallest item needs, least hits of each item, signature values (sorted), first and last + 1 of each value's items, items
        self.classes = []
        for (own, power), items in sorted(by.items()):
            whole = 2**power <= FUNCTIONS
            signatures = [self.sets[i] if whole else self.signature(i) for i in items]
            values, owner = np.concatenate(signatures), np.repeat(np.arange(len(items)), [len(x) for x in signatures])
            hits = np.array([self.needed(i) if whole else least_hits(percent) for i in items])
            order = np.argsort(values, kind="stable")
            value, first = np.unique(values[order], return_index=True)
            self.classes.append((own, min(map(self.needed, items)), hits, value, np.append(first, len(values)), owner[order], np.array(items)))

    def signature(self, i: int) -> np.ndarray:
        """The item's minwise shingle under each hash function."""
        return self.sets[i][common.mixed(self.sets[i][:, None] ^ _SEEDS).argmin(0)]

    def needed(self, i: int) -> int:
        return (self.percent * len(self.sets[i]) + 99) // 100

    def candidates(self, have: np.ndarray, own: int) -> Iterator[int]:
        """Items of shingles of own words, of whose signature the sorted set has enough."""
        for length, need, hits, values, first, owner, items in self.classes:
            if length != own or len(have) < need:
                continue
            small, large = (values, have) if len(values) < len(have) else (have, values)
            hit = small[large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small]
            if len(hit):
                at = np.searchsorted(values, hit)
                size = first[at + 1] - first[at]
                found = owner[np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                yield from items[np.bincount(found, minlength=len(items)) >= hits].tolist()

    def contained(self, text: str | None) -> list[tuple[int, int]]:
        """The items that the text contains, each with the shingles it shares."""
        words = common.word_hashes((text or "").encode("utf-8", "surrogatepass"))
        out = []
        for own in sorted({c[0] for c in self.classes}):
            have = np.unique(common.combined(words, own))
            for i in self.candidates(have, own):
                mine = self.sets[i]
                shared = int((have[np.minimum(np.searchsorted(have, mine), len(have) - 1)] == mine).sum())
                if shared >= self.needed(i):
                    out.append((i, shared))
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    block, words = [], 0
    for r in items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append((r[0], r[1]))
        words += r[1].count(" ") + 1
        if len(block) >= BLOCK or words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    yield block


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of every item that a document contains."""
    schema = pa.schema(_OUT)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for block in _blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Items(sent.value, percent)
            for batch in batches:
                found = [(doc, block.ids[i], shared, len(block.sets[i])) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for i, shared in block.contained(text.as_py())]
                columns = list(zip(*found, strict=True)) if found else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        parts.append(rows.mapInArrow(find, "doc_id long, item_id long, n_shared long, n_item long"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out.distinct().withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose text contains no item, with all their columns; each row is judged by its own text, whatever its doc_id."""
    for block in _blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = Items(sent.value, percent)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not found.contained(x.as_py()) for x in texts], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs

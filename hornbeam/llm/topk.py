"""Exact top-k by inner product with vector-approximation files.

Every block of rows is a vector-approximation file of its own: each dimension's range within the block is cut into
2**BITS equal cells, and a vector's approximation is its cell numbers, a byte a component. A search scans the
approximations alone: with equal cells, a score lies between the query's product with the cells' lower edges plus what
its negative part, and plus what its positive part, adds over a cell's width, so that one product of bytes bounds all
scores of a block, at a distance that depends on the query only. Then exact vectors are read in order of their bounds,
a few at a time, until the kth exact score is above the bound of the next. So each block yields its k best for every
query, and a window keeps the k best of all blocks; no row is dropped on a bound that is not certain.

Components become integers, floor(scale * x) with x as double, and scores are exact integers: where a block's sums could
leave the whole numbers of a double, they are summed as Python integers without an approximation.

The queries are collected in blocks of QUERY_ROWS and each block is sent to every task, so what is broadcast is
bounded and the number of passes grows with the queries.

Defined cases: vectors that are null, empty or have null or non-finite components (before or after scaling), or rows with
a null id, take no part; vectors meet only those of the same length; equal scores go to the smaller id; rows that repeat
an id are candidates each, and of query rows that repeat an id the least vector asks; if there are fewer than k candidates,
all are returned; scores that no long can hold become its least or greatest value; no query or no row gives no result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE, BITS, QUERY_ROWS, BLOCK, STEP = 1024, 8, 2048, 4096, 64
WHOLE = 2.0**53  # a double holds all integers up to here


def quantised(batch: pa.RecordBatch, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector: ids and integer vectors of the rows that take part."""
    ids, vectors = batch.column(0), batch.column(1)
    flat = vectors.flatten()
    values = np.floor(np.nan_to_num(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=np.nan) * float(scale))
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    good = np.isfinite(values)
    upto = np.concatenate([[0], np.cumsum(~good)])
    whole = (upto[starts + lengths] == upto[starts]) & (lengths > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {}
    for n in np.unique(lengths[whole]):
        rows = np.flatnonzero(whole & (lengths == n))
        out[int(n)] = keys[rows], values[starts[rows][:, None] + np.arange(n)]
    return out


class Approximation:
    """Cell numbers of a block of integer vectors, a byte each."""

    def __init__(self, vectors: np.ndarray, bits: int = BITS):
        self.low = vectors.min(0)
        self.width = np.maximum((vectors.max(0) - self.low) / 2**bits, 1e-9)
        self.cells = np.minimum((vectors - self.low) / self.width, 2**bits - 1).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores' part that the cells decide, a row for each query, and what is to be added for the lower and for the upper bounds."""
        scaled = (queries * self.width).astype(np.float32)
        part = scaled @ self.cells.T.astype(np.float32)
        base, size = queries @ self.low, np.abs(queries)
        # sums of 32-bit floats are off by some units in the last place a term; a component may lie just outside its cell by rounding
        off = size @ self.width * (queries.shape[1] + 8) * 2.0**-15 + size.sum(1) + 1e-9 * np.abs(base) + 1
        return part, base + np.minimum(queries, 0) @ self.width - off, base + np.maximum(queries, 0) @ self.width + off


def _exact(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """search() by Python integers, for components of any size."""
    ends, whole = np.iinfo(np.int64), [[int(x) for x in v] for v in vectors]
    for own, q in zip(query_ids, queries, strict=True):
        q = [int(x) for x in q]
        scores = sorted((-sum(map(int.__mul__, q, v)), int(i)) for i, v in zip(ids, whole, strict=True) if i != own)[:k]
        if scores:
            yield own, np.array([i for _, i in scores]), np.array([min(max(-s, ends.min), ends.max) for s, _ in scores], np.int64)


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its id, and the ids and scores of the block's k best."""
    if not len(ids) or not len(query_ids):
        return
    if np.abs(vectors).max() * np.abs(queries).max() * vectors.shape[1] >= WHOLE:
        yield from _exact(ids, vectors, query_ids, queries, k)
        return
    part, lower, upper = Approximation(vectors).bounds(queries)
    for j, own in enumerate(query_ids):
        others = np.flatnonzero(ids != own)  # of rows with the query's id there may be any number
        if not len(others):
            continue
        kth, mine = min(k, len(others)), part[j][others].astype(np.float64)
        certain = np.partition(mine, len(others) - kth)[len(others) - kth] + lower[j]
        near = mine + upper[j] >= certain
        order, most = others[near], mine[near] + upper[j]
        first = np.argsort(-most, kind="stable")
        order, most = order[first], most[first]
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(order), STEP):
            if len(best) >= k and most[at] < best[k - 1]:
                break
            some = order[at : at + STEP]
            best_ids, best = np.concatenate([best_ids, ids[some]]), np.concatenate([best, vectors[some] @ queries[j]])
            keep = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[keep], best[keep]
        if len(best):
            yield own, best_ids, best


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to BLOCK rows or more, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BLOCK:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _scan(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, scale: int) -> Callable:
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in joined(batches):
            for begin in range(0, len(whole), BLOCK):
                for n, (ids, vectors) in quantised(whole.slice(begin, BLOCK), scale).items():
                    found = list(search(ids, vectors, *queries[n], k)) if n in queries else []
                    if found:
                        columns = np.concatenate([np.full(len(f[1]), f[0]) for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2].astype(np.int64) for f in found])
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return scan


def top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), the id column and score of each query's k best among all rows but those with its own id."""
    narrow = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = rows.filter(is_query & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    found = []
    each = asked.toLocalIterator()
    more = True
    while more:
        block = list(itertools.islice(each, QUERY_ROWS))
        more = len(block) == QUERY_ROWS
        if block or not found:
            batch = pa.RecordBatch.from_arrays([pa.array([r["id"] for r in block], pa.int64()), pa.array([r["v"] for r in block], pa.list_(pa.float64()))], names=["id", "v"])
            found.append(narrow.mapInArrow(_scan(quantised(batch, scale), k, scale), "query_id long, id long, score long"))
    best = found[0]
    for x in found[1:]:
        best = best.unionAll(x)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")

"""What the operators share: tables, the folder that all executors share, and word shingles."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
SHINGLE = 5


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Workers find this package where the driver did, if it is not installed and that folder is there for them too; and
    Arrow batches, which hold whole texts, are of about 4 MB unless the session sets another size."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only on a local master without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="hornbeam-")
    return shared_dir.own


def new_path(spark: SparkSession, name: str) -> str:
    prepare(spark)
    return f"{shared_dir(spark)}/hornbeam/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df as a table in the shared folder: computed once, and its lineage is cut there. narrow: for tables of ids, which
    are dealt to an eighth of the shuffle's tasks once they are made, so that there are not as many files as tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if narrow:
        df = df.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.hornbeam_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what written() made, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "hornbeam_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now; else they stay until the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes with A-Z lower-cased, in order: a sum of one random
    value for each byte and its place in the word, so that no algebra of the bytes makes words collide."""
    raw = np.frombuffer(data, dtype=np.uint8)
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    first = np.cumsum(size) - size
    place = (np.arange(int(size.sum())) - np.repeat(first, size)).astype(np.uint64)
    values = mixed(_LOWER[raw[~gap]].astype(np.uint64) * _BASE + (place + np.uint64(1)) * GOLDEN)
    return mixed(np.add.reduceat(values, first) + size.astype(np.uint64) * GOLDEN)


def combined(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k words."""
    n = len(words) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k):
        out = mixed(out * _BASE + words[i : i + n]) if n > 0 else out
    return out


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; fewer words make one shingle, no words none."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    return np.unique(combined(words, min(k, len(words))) + np.uint64(min(k, len(words)) % k))

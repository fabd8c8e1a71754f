"""Token ids as flat binary files with 64-bit offsets.

A written set is a folder of parts: `part-NNNNN.ids` (unsigned little-endian ids, 16 bits wide if the vocabulary
fits, else 32), `part-NNNNN.offsets` (n + 1 unsigned 64-bit places, within the part, at which documents begin) and
`part-NNNNN.docs` (n signed 64-bit doc_ids), plus `manifest.json` with each part's base: the ids in all parts
before it, a prefix sum over the parts' totals. Parts are ranges of doc_id and ascend, and so do rows in a part.
A part is written under another name and then renamed, so an attempt that is repeated leaves one whole file.

A text is cut before each white space that follows something else, and after each run of letters that begins a word
if an ASCII sign or digit follows. No piece of the byte-level pattern reaches over such places (a text that has "<|"
is cut at white space alone, as special tokens may begin there), so the ids of the cuts, each of which the library
encodes once and a bounded cache keeps, are the ids of the whole text.

Defined cases: a null text is empty and has the end id alone; a null doc_id sorts first and is kept as the least
64-bit integer in the file and read as null; rows that repeat a doc_id are written each, in order of their text's
hash; an empty table makes empty parts; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm import common

END, NO_DOC = 0, -(2**63)
CACHED, CACHED_CHARS, AT_ONCE, JOINED = 500_000, 8_000_000, 2_000_000, 4_000
#: The characters of the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
_WHITE = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-@\[-`{-~"
_COARSE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_CUTS = re.compile(f"[{WHITE}]*(?:[{_LETTERS}]+(?![^{WHITE}{_SIGNS}])|[^{WHITE}]+)|[{WHITE}]+")
_LOADED: dict[str, Encoder] = {}


class _Numbers(dict):
    """Numbers for strings in order of first use; new: those not yet encoded."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, s: str) -> int:
        n = self[s] = len(self)
        self.new.append(s)
        return n


class Encoder:
    """A tokenizer file of the tokenizers library, with the ids of texts seen before kept in flat arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 65536 else "<u4")
        vocabulary = self.library.get_vocab()
        #: Bytes of each token: a byte-level vocabulary writes a byte as one character.
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.clear()

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def clear(self) -> None:
        self.place, self.chars = _Numbers(), 0
        self.ids, self.starts, self.used = np.zeros(1 << 16, self.dtype), np.zeros(1 << 12, np.int64), 0

    def _each(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [x.ids for x in self.library.encode_batch_fast(cuts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum())), sizes

    def _encoded(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each cut has. Cuts that begin with white space and end with something else go to the library
        JOINED at a time, as one text, since no piece reaches over their ends; the tokens' bytes tell where each ends. Where
        the bytes do not meet the ends, and for other cuts, the library gets each cut."""
        joins = np.fromiter((x[0] in _WHITE and x[-1] not in _WHITE and "<|" not in x for x in cuts), bool, len(cuts))
        apart, groups = [i for i, x in enumerate(joins) if not x], np.flatnonzero(joins)
        groups = [groups[i : i + JOINED].tolist() for i in range(0, len(groups), JOINED)]
        found = []
        for group, whole in zip(groups, self.library.encode_batch_fast(["".join([cuts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(whole.ids, np.int64)
            upto = np.cumsum(self.bytes[ids])
            ends = np.cumsum([len(cuts[i].encode()) for i in group])
            at = np.searchsorted(upto, ends)
            if len(upto) and upto[-1] == ends[-1] and (upto[at] == ends).all():
                found.append((group, ids, np.diff(at + 1, prepend=0)))
            else:
                apart += group
        if apart:
            found.append((apart, *self._each([cuts[i] for i in apart])))
        sizes = np.zeros(len(cuts), np.int64)
        for group, _, n in found:
            sizes[group] = n
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int64)
        for group, ids, n in found:
            out[np.repeat(starts[group] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, sizes

    def _keep(self, new: list[str]) -> None:
        """The ids of new cuts, the last that were numbered."""
        self.chars += sum(map(len, new))
        ids, sizes = self._encoded(new)
        total, n = self.used + len(ids), len(self.place)
        while total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : total] = ids
        self.starts[n - len(new) + 1 : n + 1] = self.used + np.cumsum(sizes)
        self.used = total

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has, its end id included."""
        if len(self.place) > CACHED or self.chars > CACHED_CHARS:
            self.clear()
        cuts = [(_COARSE if "<|" in x else _CUTS).findall(x) if x else [] for x in texts]
        per_text = np.fromiter(map(len, cuts), np.int64, len(cuts))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cuts)), np.int64, int(per_text.sum()))
        if self.place.new:
            self._keep(self.place.new)
            self.place.new = []
        first = self.starts[at]
        per_cut = self.starts[at + 1] - first
        upto = np.concatenate([[0], np.cumsum(per_cut)])
        ids = self.ids[np.repeat(first - upto[:-1], per_cut) + np.arange(upto[-1])]
        ends = upto[np.cumsum(per_text)]
        return np.insert(ids, ends, END), np.diff(ends, prepend=0) + 1


def bounded(texts: list[str | None], most: int = AT_ONCE) -> Iterator[slice]:
    """Slices of about `most` characters."""
    begin = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _store(path: str):
    """A file system for path, and the path in it."""
    import pyarrow.fs as fs

    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), url.path
    return fs.FileSystem.from_uri(path)


def _part_writer(path: str, tokenizer: str, schema: pa.Schema):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        k, attempt = context.partitionId(), context.taskAttemptId()
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        encoder = Encoder.load(tokenizer)
        names = {x: f"{folder}/.attempt-{attempt}-part-{k:05d}.{x}" for x in ("ids", "offsets", "docs")}
        docs = total = 0
        with store.open_output_stream(names["ids"]) as ids, store.open_output_stream(names["offsets"]) as places, store.open_output_stream(names["docs"]) as keys:
            places.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                texts = batch.column("text").to_pylist()
                keys.write(batch.column("doc_id").fill_null(NO_DOC).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                for part in bounded(texts):
                    out, lengths = encoder.encode(texts[part])
                    ids.write(out.tobytes())
                    places.write((total + np.cumsum(lengths)).astype("<u8").tobytes())
                    total, docs = total + len(out), docs + len(lengths)
        for x, name in names.items():
            final = f"{folder}/part-{k:05d}.{x}"
            if isinstance(store, type(_store("/")[0])):
                os.replace(name, final)
            else:
                store.move(name, final)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (k, docs, total)], schema=schema)

    return write


def write(docs: DataFrame, path: str, tokenizer: str, parts: int | None = None) -> dict:
    """Write the token files of docs (doc_id, text) to the shared folder path; returns the manifest."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # by the whole order, so that rows that share a doc_id, or have none, need not be one part
    rows = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = pa.schema([("part", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])
    made = sorted(rows.mapInArrow(_part_writer(path, tokenizer, schema), "part long, docs long, ids long").collect())
    bases = np.concatenate([[0], np.cumsum([r["ids"] for r in made], dtype=np.int64)])
    manifest = {
        "dtype": Encoder.load(tokenizer).dtype.str,
        "end": END,
        "parts": [{"part": r["part"], "docs": r["docs"], "ids": r["ids"], "base": int(b)} for r, b in zip(made, bases, strict=False)],
    }
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(path: str) -> dict:
    store, folder = _store(path)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


def _mapped(store, name: str, dtype: str, size: int) -> np.ndarray:
    """The file as an array: memory-mapped where the store is a file system of this machine."""
    if not size:
        return np.zeros(0, dtype)
    if isinstance(store, type(_store("/")[0])):
        return np.memmap(name, dtype, "r", shape=(size,))
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype)


def documents(path: str, manifest: dict, part: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, place among all ids, and ids of each document of a part, in order."""
    store, folder = _store(path)
    name = f"{folder}/part-{part['part']:05d}"
    places = _mapped(store, f"{name}.offsets", "<u8", part["docs"] + 1)
    keys = _mapped(store, f"{name}.docs", "<i8", part["docs"])
    ids = _mapped(store, f"{name}.ids", manifest["dtype"], part["ids"])
    for i in range(part["docs"]):
        a, b = int(places[i]), int(places[i + 1])
        yield None if keys[i] == NO_DOC else int(keys[i]), part["base"] + a, ids[a:b]


def read(spark: SparkSession, path: str, manifest: dict | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files at path."""
    manifest = manifest or read_manifest(path)
    parts = manifest["parts"]
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows: list[list] = [[], [], [], []]
                for doc, start, ids in documents(path, manifest, parts[k]):
                    for column, v in zip(rows, (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types, strict=True)], schema=schema)

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_corpus(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs as token files to a new folder under the shared one and read them back."""
    spark = docs.sparkSession
    path = common.new_path(spark, "tokens")
    return read(spark, path, write(docs, path, tokenizer))

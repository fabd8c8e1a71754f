"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages, windows of PASSAGE bytes of its whole text. A passage is encoded by shares of
character classes and of neighbouring pairs of coarser classes, by case and length of words, and by how much of it
repeats what stands before in the passage. With h = tanh(W x + w) for each passage, gated attention gives weights
a = softmax over the bag of v . (tanh(V h) * sigmoid(U h)), and the score is sigmoid(c . sum(a h) + b). The
parameters are learned from document labels only, by gradient descent (Adam) on the log loss.

Fitting uses a bounded sample: about ROWS labelled documents of each label, those of least hash of doc_id, with all
their passages. Only their encoded passages reach the driver. Scoring reads whole texts.

Defined cases: a null or empty text is one empty passage and is scored; without labels of both kinds the score is
the share of label 1 among those there are, or 0.5; of labels that contradict each other for a doc_id the least
counts; labels other than 0 and 1, and rows with a null doc_id, are not learned from; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

PASSAGE, ROWS, HIDDEN, GATE, STEPS, SEED, THRESHOLD, AT_ONCE = 512, 1200, 24, 16, 300, 7, 0.7, 1_000_000
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_FINE = np.full(256, 5, np.uint8)  # control characters and what is not ASCII
_FINE[97:123], _FINE[65:91], _FINE[48:58], _FINE[32], _FINE[10] = 0, 1, 2, 3, 4
_FINE[_SIGNS] = 7 + np.arange(len(_SIGNS))
_FINE[128:] = 6
FINE = 7 + len(_SIGNS)
_COARSE = np.minimum(_FINE, 7)
_COARSE[[46, 44]] = 8
COARSE = 9
WIDTH = FINE + COARSE * COARSE + 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages, and of which text each is."""
    sizes = np.array([len(x) for x in texts], np.int64)
    blocks = np.maximum(1, -(-sizes // PASSAGE))
    owner = np.repeat(np.arange(len(texts)), blocks)
    data = np.frombuffer(b"".join(texts), np.uint8)
    first_block = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(texts)), sizes)
    within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block = first_block[text] + within // PASSAGE
    n = len(owner)
    fine, coarse = _FINE[data], _COARSE[data].astype(np.int64)
    length = np.maximum(np.bincount(block, minlength=n), 1)[:, None]
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :FINE] = np.bincount(block * FINE + fine, minlength=n * FINE).reshape(n, FINE) / length
    if len(data) > 1:
        same = block[1:] == block[:-1]
        pair = coarse[:-1] * COARSE + coarse[1:]
        out[:, FINE : FINE + COARSE**2] = np.bincount((block[:-1] * COARSE**2 + pair)[same], minlength=n * COARSE**2).reshape(n, -1) / length
        # of its 8-byte windows on a grid of word beginnings, those that the passage has had before
        begin = np.flatnonzero((coarse[1:] < 3) & ((coarse[:-1] == 3) | (coarse[:-1] == 4))) + 1
        # within the text: what stands beside it says nothing of it
        begin = begin[(text[begin] == text[begin - 1]) & (begin + 8 <= np.cumsum(sizes)[text[begin]])]
        if len(begin):
            window = np.zeros(len(begin), np.uint64)
            for i in range(8):
                window = window << np.uint64(8) | (data[begin + i] | np.uint8(32)).astype(np.uint64)
            order = np.lexsort((window, block[begin]))
            w, b = window[order], block[begin][order]
            again = np.append(False, (w[1:] == w[:-1]) & (b[1:] == b[:-1]))
            words = np.bincount(b, minlength=n)
            out[:, -1] = np.bincount(b[again], minlength=n) / np.maximum(words, 1)
            out[:, -2] = words / length[:, 0] * 4
    out[:, -3] = (length[:, 0] / PASSAGE)
    out[:, -4] = (sizes == 0)[owner]
    return np.sqrt(out), owner


class Model:
    NAMES = ("mean", "scale", "W", "w", "V", "U", "v", "c", "b")

    def __init__(self, values: dict[str, np.ndarray]):
        self.p = values

    def _forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> tuple:
        p = self.p
        x = (x - p["mean"]) / p["scale"]
        h = np.tanh(x @ p["W"] + p["w"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["v"]
        first = np.searchsorted(owner, np.arange(n))  # a bag's passages stand together, and each bag has one
        a = np.exp(e - np.maximum.reduceat(e, first)[owner])
        a /= np.add.reduceat(a, first)[owner]
        bag = np.add.reduceat(a[:, None] * h, first, axis=0)
        return x, h, t, g, a, bag, 1 / (1 + np.exp(-(bag @ p["c"] + p["b"][0])))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if "share" in self.p:
            return np.full(len(texts), float(self.p["share"]))
        x, owner = passages(texts)
        return self._forward(x, owner, len(texts))[-1]

    @classmethod
    def fit(cls, x: np.ndarray, owner: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Model:
        if not len(y) or y.min() == y.max():
            return cls({"share": np.array(y.mean() if len(y) else 0.5)})
        rng = np.random.default_rng(SEED)
        n, d = len(y), x.shape[1]
        scale = x.std(0) + 0.02
        p = {"mean": x.mean(0), "scale": scale, "W": rng.normal(0, d**-0.5, (d, HIDDEN)), "w": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, GATE)), "U": rng.normal(0, 0.2, (HIDDEN, GATE)), "v": rng.normal(0, 0.2, GATE), "c": rng.normal(0, 0.2, HIDDEN), "b": np.zeros(1)}
        model = cls(p)
        learned = [k for k in cls.NAMES if k not in ("mean", "scale")]
        m, s = {k: 0 for k in learned}, {k: 0 for k in learned}
        weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
        for step in range(1, steps + 1):
            xs, h, t, g, a, bag, score = model._forward(x, owner, n)
            d_out = (score - y) * weight / n
            d_bag = np.outer(d_out, p["c"])
            d_a = (d_bag[owner] * h).sum(1)
            d_e = a * (d_a - np.bincount(owner, a * d_a, n)[owner])
            d_tg = np.outer(d_e, p["v"])
            d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
            d_h = (a[:, None] * d_bag[owner] + d_t @ p["V"].T + d_g @ p["U"].T) * (1 - h * h)
            grad = {"W": xs.T @ d_h, "w": d_h.sum(0), "V": h.T @ d_t, "U": h.T @ d_g, "v": (t * g).T @ d_e, "c": bag.T @ d_out, "b": np.array([d_out.sum()])}
            rate = 0.01 * (1 - step / (steps + 1)) + 1e-4
            for k in learned:
                grad[k] = grad[k] + 1e-5 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                s[k] = 0.999 * s[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        # weighted classes count alike above; the bias is set back to the labels' shares by Newton's method
        score = model._forward(x, owner, n)[-1]
        logit = np.log(np.clip(score, 1e-9, 1 - 1e-9) / np.clip(1 - score, 1e-9, 1))
        shift = 0.0
        for _ in range(25):
            q = 1 / (1 + np.exp(-(logit + shift)))
            shift += (y - q).sum() / max((q * (1 - q)).sum(), 1e-6) * 0.5
        p["b"] = p["b"] + shift
        return model


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All encoded passages of each labelled text."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            x, _ = passages([(text or "").encode("utf-8", "surrogatepass")])
            out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Learns from the labels (doc_id, quality) of rows that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(2**40)) / F.lit(2.0**40)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return Model.fit(np.zeros((0, WIDTH)), np.zeros(0, int), np.zeros(0))
    share = F.when(F.col("label") == 1, F.lit(rows / counts.get(1, rows))).otherwise(F.lit(rows / counts.get(0, rows)))
    # about 2 * rows rows, so this side is bounded and may be broadcast
    chosen = F.broadcast(known.filter(order < share))
    found = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(_spread, "doc_id long, label int, x binary")
    found = sorted(found.collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    if not found:
        return Model.fit(np.zeros((0, WIDTH)), np.zeros(0, int), np.zeros(0))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in found]
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    # the sample has the kinds in other shares than the labels; the bias is set to the labels' own
    total = sum(counts.values())
    seen = np.array([r["label"] for r in found], float)
    model = Model.fit(np.concatenate(bags), owner, seen)
    if "share" not in model.p:
        odds = lambda p: np.log(p / (1 - p))
        model.p["b"] = model.p["b"] + odds(counts[1] / total) - odds(seen.mean())
    return model


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are predicted 1, with their columns and no others, however these are named."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return score(rows, model, threshold).filter("predicted = 1").select("row.*")


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs but those named held_out, score or predicted, and held_out, score and predicted."""
    own = ("held_out", "score", "predicted")
    rows = docs.drop(*[c for c in docs.columns if c.lower() in own]).withColumn("held_out", held_out(F.col("doc_id")))
    sent = docs.sparkSession.sparkContext.broadcast(model.p)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Model(sent.value)
        for batch in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            part = np.cumsum([len(x) for x in texts]) // AT_ONCE
            found = [machine.score(texts[slice(*np.searchsorted(part, [p, p + 1]))]) for p in np.unique(part)]
            result = np.concatenate([np.zeros(0), *found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result), pa.array((result >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(judge, schema)

"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a sample of its labelled texts. A text is parsed with it into
phrases, each the longest that occurs in the sample (or one character, if that occurs nowhere). A language's
cross-entropy is phrases * log2(length of its sample) / characters; the language of the least wins.

Texts are lower-cased; every run of characters that are not letters is one boundary symbol. Whole texts are parsed. Texts
run side by side, one look-up a symbol and language for all; those of more than BLOCK symbols run as several blocks, each
from the state at which its predecessor ends: blocks start from a guess, and those whose guess was wrong run again until
every block starts where its predecessor ended, so phrases reach over the edges of blocks.

An automaton is learned from the whole texts of at most ROWS labelled rows of a language, those of least hash of
doc_id. Its transitions are a dense table if that has at most DENSE entries, else sorted keys.

Defined cases: a null text or one without a letter is "und" with score 0; score is 1 - least / second least entropy
(1 if one language was learned; ties go to the lesser name and score 0); without any labelled row every text is
"und"; rows with a null lang or doc_id are not learned from; repeated rows are judged each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, BLOCK, DENSE, AT_ONCE = 16, 4096, 16_000_000, 4_000_000
_LOADED: dict[str, Model] = {}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def symbols(text: str) -> np.ndarray:
    """Lower-cased code points with one 32 for each run of other characters than letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, np.uint32(32))
    return points[(points != 32) | (np.append(np.uint32(0), points[:-1]) != 32)]


def _letters() -> np.ndarray:
    if not hasattr(_letters, "table"):
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _letters.table = table
    return _letters.table


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the root, and paths from it spell the substrings of text."""
    go, link, longest = [{}], [-1], [0]
    last = 0
    for c in text:
        now = len(go)
        go.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if longest[q] == longest[p] + 1:
                link[now] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return go


class Parser:
    """A language's parser: from state and symbol to the next state and the phrases that end there."""

    def __init__(self, sample: np.ndarray):
        alphabet = np.unique(sample)
        self.bits = math.log2(max(2, len(sample)))
        self.symbol = np.zeros(0x110000, np.int32)  # 0: not in the sample
        self.symbol[alphabet] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        go = suffix_automaton(self.symbol[sample].tolist())
        self.start = np.full(self.width, 1, np.int64)  # an unknown symbol is a phrase of its own, and ends at the root
        self.start[list(go[0])] = np.array(list(go[0].values()), np.int64) << 2
        self.dense = len(go) * self.width <= DENSE
        if self.dense:
            # elsewhere than at the root a phrase ends where it cannot be longer, and the next begins with the symbol
            table = np.tile(self.start + 1, (len(go), 1)).astype(np.int32)
            table[0] = self.start
            for state, edges in enumerate(go):
                for c, q in edges.items():
                    table[state, c] = q << 2
            self.table = table.reshape(-1)
        else:
            rows = sorted((state * self.width + c, q << 2) for state, edges in enumerate(go) for c, q in edges.items())
            self.keys, self.values = (np.array(x, np.int64) for x in zip(*rows, strict=True))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Four times the next state, plus the phrases that end."""
        at = state * self.width + symbol
        if self.dense:
            return self.table[at]
        place = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[place] == at, self.values[place], self.start[symbol] + (state > 0))

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states at which blocks of data end, and the phrases that end in them, from their entry states."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state, count = entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        for t, n in enumerate(np.searchsorted(-lengths, -np.arange(1, lengths.max(initial=0) + 1), side="right")):
            got = self.step(state[:n], data[starts[:n] + t])
            count[:n] += got & 3
            state[:n] = got >> 2
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def phrases(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of phrases of each of the texts that points hold one after another."""
        data = self.symbol[points]
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        lengths = np.minimum(BLOCK, np.repeat(sizes, blocks) - nth * BLOCK)
        entry = np.zeros(len(owner), np.int64)
        leave, count = self.run(data, starts, lengths, entry)
        while True:
            before = np.where(nth > 0, np.append(0, leave[:-1]), 0)
            again = np.flatnonzero(entry != before)
            if not len(again):
                break
            entry[again] = before[again]
            leave[again], count[again] = self.run(data, starts[again], lengths[again], entry[again])
        open_at_end = (nth == np.repeat(blocks, blocks) - 1) & (leave > 0)
        return np.bincount(owner, count + open_at_end, len(sizes))


class Model:
    """The parsers of all languages."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.parsers = [Parser(symbols(samples[x])) for x in self.langs]
        self.bits = [x.bits for x in self.parsers]

    @classmethod
    def load(cls, samples: dict[str, str]) -> Model:
        key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = cls(samples)
        return _LOADED[key]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """The number of phrases of each text (symbols), a row for each language."""
        sizes = np.array([len(x) for x in texts], np.int64)
        points = np.concatenate([np.zeros(0, np.uint32), *texts])
        return np.array([x.phrases(points, sizes) for x in self.parsers]).reshape(len(self.langs), len(texts))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        points = [symbols(x or "") for x in texts]
        points = [x if (x != 32).any() else x[:0] for x in points]
        sizes = np.array([len(x) for x in points])
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        entropy = self.phrases(points) * np.array(self.bits)[:, None] / np.maximum(sizes, 1)
        best = entropy.argmin(0)
        two = np.sort(entropy, 0)[:2]
        score = 1 - two[0] / two[1] if len(two) > 1 else np.ones(len(texts))
        return [self.langs[b] if n else "und" for b, n in zip(best, sizes, strict=True)], np.where(sizes > 0, np.clip(score, 0, 1), 0.0)


def fit(docs: DataFrame, rows: int = ROWS) -> dict[str, str]:
    """The whole texts of at most `rows` rows of each language that are not held out, joined; two narrow passes, nothing is shuffled but counts."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return {}
    order = F.pmod(F.xxhash64("doc_id"), F.lit(2**40)) / F.lit(2.0**40)
    # several times the rows wanted, so that there are enough
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 4.0 * rows / n)])
    chosen = known.filter(order < F.try_element_at(share, F.col("lang"))).select("lang", order.alias("o"), "doc_id", "text")
    samples: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["o"], r["doc_id"], r["text"])):
        if len(samples.setdefault(r["lang"], [])) < rows:
            samples[r["lang"]].append(r["text"])
    return {lang: "\n".join(["", *texts]) for lang, texts in samples.items()}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema_of = lambda t: pa.schema([("doc_id", t), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(samples)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            part = np.cumsum([len(x or "") for x in texts]) // AT_ONCE
            langs: list[str] = []
            scores = [np.zeros(0)]
            for p in np.unique(part):
                a, b = np.searchsorted(part, [p, p + 1])
                lang, score = model.predict(texts[a:b])
                langs += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], schema=schema_of(batch.schema.field("doc_id").type))

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(judge, f"doc_id {kind}, held_out boolean, lang_pred string, score double")

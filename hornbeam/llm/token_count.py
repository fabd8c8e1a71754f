"""Token counts by a finite-state transducer compiled from a byte-level BPE tokenizer file.

The transducer reads UTF-8 bytes. F(x) is the number of tokens of the text x; a transition on byte b is annotated
with F(xb) - F(x), which depends on the state alone, so a count is a sum over a path. A state holds

- where the splitting pattern is: within letters, numbers, other characters or white space, or in a contraction;
- the bytes of a character that is not complete, and how much of a special token's string has been read;
- for the piece being read, its last token, the Aho-Corasick node of its longest suffix from which a token may still
  grow and, for each place at which such a token would start, what the last token up to there does to those after it.

The last is enough because of two facts on byte-pair encoding: each prefix of a tokenization is the tokenization of
its bytes, and tokens t1..tn are the tokenization of their bytes if each neighbouring pair is that of its own. So
the last token after one more byte is the one suffix token that forms such a pair with the last token before it.
A pair's tokens are merged as they would be alone if no token at the right end of the first merges with one at the
left end of the second before either is merged on; places after which no token can pass that test are left out.

There are finitely many states, but far too many to list; transitions are worked out as texts first need them and
kept in a dense table (at most STATES of them, then the table is begun again).

Texts are cut into chunks of about CHUNK bytes, which run side by side, one table look-up a byte for all of them.
A chunk's map takes the state at its start to the state at its end and a count. Where a chunk begins with ASCII
white space after another ASCII character, the map is constant: no piece reaches over that place. Any other chunk's map
is known at the entry states tried so far. A parallel prefix scan composes the maps of each text's chunks in
log2(chunks) steps of doubling reach: a composed map is known if each chunk's entry state is its predecessor's exit
state, or its map is constant. Chunks at which that fails are run from the exit state that the scan gives them, all at
once, and the scan is repeated until the map of every text is known from its beginning.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special tokens in a text count as one, which is the
library's default; very long texts are just more chunks; repeated rows are counted each; columns other than doc_id
and text are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES, CHUNK, SEEK, AT_ONCE, NEVER = 100_000, 1024, 128, 8_000_000, 1 << 60
#: The endings of the pattern's contractions ('s 't 're 've 'm 'll 'd).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_LOADED: dict[str, Transducer] = {}


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without a normalizer can be compiled")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("this BPE model has options that the compiler does not know")
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["content"][0] in t["content"][1:] for t in spec["added_tokens"]):
            raise ValueError("these added tokens cannot be compiled")
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        of = byte_characters()
        special = set(self.special)
        self.bytes = {i: bytes(of[c] for c in t) for t, i in model["vocab"].items() if t not in special}
        self.id = {b: i for i, b in self.bytes.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merge = {(model["vocab"][a], model["vocab"][b]): (rank, model["vocab"][a + b]) for rank, (a, b) in enumerate(pairs)}
        self._trie()
        self._spines()
        self.open: dict[tuple, tuple | None] = {}
        self.classes: dict[str, str] = {}
        self.clear()

    @classmethod
    def load(cls, path: str) -> Transducer:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    # the automaton over a piece's bytes

    def _trie(self) -> None:
        self.go: list[dict[int, int]] = [{}]
        self.depth, self.ends, self.text, order = [0], [-1], [b""], [0]
        for t, b in self.bytes.items():
            node = 0
            for c in b:
                if c not in self.go[node]:
                    self.go[node][c] = len(self.go)
                    self.go.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.text.append(self.text[node] + bytes([c]))
                    self.ends.append(-1)
                node = self.go[node][c]
            self.ends[node] = t
        self.fail = [0] * len(self.go)
        for node in order:
            for c, child in self.go[node].items():
                order.append(child)
                if node:
                    self.fail[child] = self._next(self.fail[node], c)

    def _next(self, node: int, c: int) -> int:
        while node and c not in self.go[node]:
            node = self.fail[node]
        return self.go[node].get(c, 0)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Byte-pair encoding as defined: merge the pair of least rank, the leftmost first."""
        ids = [self.id[bytes([b])] for b in piece]
        while len(ids) > 1:
            rank, at = min((self.merge.get(p, (NEVER,))[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == NEVER:
                break
            ids[at : at + 2] = [self.merge[ids[at], ids[at + 1]][1]]
        return ids

    def _spines(self) -> None:
        """For each token the tokens at its right end while it is being merged, each with the ranks from and until which
        it stands there; for each token the merges that have it on the left, by first byte; and those it grows by."""
        made = {t: (rank, a, b) for (a, b), (rank, t) in self.merge.items()}
        self.formed = {t: made[t][0] if t in made else -1 for t in self.bytes}
        self.left = {t: a for t, (_, a, _) in made.items()}
        self.right: dict[int, list[tuple[int, int, int]]] = {}
        self.grown_to: dict[int, list[tuple[int, int]]] = {}
        self.beside: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t in self.bytes:
            spine, x, until = [], t, NEVER
            while True:
                spine.append((x, self.formed[x], until))
                if x not in made:
                    break
                until, _, x = made[x]
            self.right[t] = spine
            if t in made:
                self.grown_to.setdefault(made[t][1], []).append((made[t][0], t))
        for (x, y), (rank, _) in self.merge.items():
            self.beside.setdefault(x, {}).setdefault(self.bytes[y][0], []).append((y, rank))

    def _blocks(self, before: int | None, first: int) -> tuple:
        """What follows `before` and begins with byte first is merged with its right end, if it is one of these tokens y
        and stands there until this rank or later: (y, rank), sorted. Tokens with the same blocks are as one."""
        if before is None:
            return ()
        if (before, first) not in self.open:
            least: dict[int, int] = {}
            for x, since, until in self.right[before]:
                for y, rank in self.beside.get(x, {}).get(first, ()):
                    if rank < until and until > self.formed[y]:
                        least[y] = min(least.get(y, NEVER), max(rank, since + 1))
            self.open[before, first] = tuple(sorted(least.items()))
        return self.open[before, first]

    def _fits(self, blocks: tuple, t: int) -> bool:
        """Whether t is a token after something with these blocks: its left spine grows to t undisturbed."""
        at = dict(blocks)
        y, until = t, NEVER
        while y is not None:
            if until >= at.get(y, NEVER + 1):
                return False
            y, until = self.left.get(y), self.formed[y]
        return True

    def _narrowed(self, blocks: tuple, node: int) -> tuple | None:
        """The blocks that matter for tokens that begin with the node's bytes; None if no such token can follow."""
        if not blocks:
            return blocks
        if (blocks, node) not in self.open:
            want = self.text[node]
            near = tuple(x for x in blocks if self.bytes[x[0]].startswith(want) or want.startswith(self.bytes[x[0]]))
            at, todo, found = dict(near), [self.id[want[:1]]], False
            while todo and not found:
                y = todo.pop()
                most = at.get(y, NEVER + 1)
                found = len(self.bytes[y]) >= len(want) and most > NEVER
                todo += [z for rank, z in self.grown_to.get(y, ()) if rank < most and (self.bytes[z].startswith(want) or want.startswith(self.bytes[z]))]
            self.open[blocks, node] = near if found else None
        return self.open[blocks, node]

    #: A piece's state: node, last token (None at the beginning), and (depth, blocks of the last token there, tokens
    #: there less tokens now) for each earlier place from which a token may yet reach on. The node is that of the deepest.
    EMPTY = (0, None, ())

    def _feed(self, piece: tuple, data: bytes) -> tuple[tuple, int]:
        """The state of the piece after data, and by how much its tokens grow."""
        node, last, places = piece
        grown = 0
        for c in data:
            # a place d bytes back from here was d - 1 bytes back before this byte
            at = {d + 1: (blocks, n) for d, blocks, n in places}
            at[1] = (self._blocks(last, c), 0)
            u = node = self._next(node, c)
            chain = []
            while u:
                if self.depth[u] in at:
                    chain.append(u)
                u = self.fail[u]
            last, now = next((self.ends[u], at[self.depth[u]][1] + 1) for u in chain if self.ends[u] >= 0 and self._fits(at[self.depth[u]][0], self.ends[u]))
            places = tuple((self.depth[u], blocks, at[self.depth[u]][1] - now) for u in chain if (blocks := self._narrowed(at[self.depth[u]][0], u)) is not None)
            while self.depth[node] and (not places or self.depth[node] != places[0][0]):
                node = self.fail[node]
            grown += now
        return (node, last, places), grown

    # the splitting pattern

    def _class(self, c: str) -> str:
        """L, N, O or W, as the library's own pattern sees the character."""
        if c not in self.classes:
            alone = lambda s: len(self.splitter.pre_tokenize_str(s)) == 1
            self.classes[c] = "L" if alone("a" + c) else "N" if alone("1" + c) else "O" if alone("!" + c) else "W"
        return self.classes[c]

    def _begin(self, c: str) -> tuple[tuple, int]:
        """The state after the first character of a piece that no space precedes."""
        kind = self._class(c)
        if kind == "W":
            return ("W", self.EMPTY, c), self._feed(self.EMPTY, c.encode())[1]
        piece, n = self._feed(self.EMPTY, c.encode())
        return ("'" if c == "'" else kind, piece, ""), n

    def _read(self, state: tuple, c: str) -> tuple[tuple, int]:
        """A state is (kind, piece, extra). Kinds: "" at a boundary; L N O within such a piece; ' after a piece's leading
        apostrophe; ? after an apostrophe and the letter in extra; W after white space, of which extra is the last and piece the rest."""
        kind, piece, extra = state
        own = self._class(c)
        if kind == "":
            return self._begin(c)
        if kind == "W":
            with_last, n = self._feed(piece, extra.encode())
            if own == "W":
                return ("W", with_last, c), self._feed(with_last, c.encode())[1]
            if extra == " ":
                start, m = self._feed(self.EMPTY, b" " + c.encode())
                return (own, start, ""), m - n
            after, m = self._begin(c)
            return after, self._feed(self.EMPTY, extra.encode())[1] + m - n
        if kind == "'":
            if c in ENDINGS:
                return ("", None, ""), len(self.encode_piece(b"'" + c.encode())) - 1
            if any(x[0] == c for x in ENDINGS):
                return ("?", None, c), 1
            kind = "O"
        elif kind == "?":
            if extra + c in ENDINGS:
                return ("", None, ""), len(self.encode_piece(("'" + extra + c).encode())) - 2
            kind, piece = "L", self._feed(self.EMPTY, extra.encode())[0]
        if own == kind:
            piece, n = self._feed(piece, c.encode())
            return (kind, piece, ""), n
        return self._begin(c)

    # the whole: (state, bytes of an unfinished character, special token, characters of it read, tokens before it less tokens now)

    START = (("", None, ""), b"", -1, 0, 0)

    def _step(self, key: tuple, byte: int) -> tuple[tuple, int]:
        state, held, which, length, before = key
        held += bytes([byte])
        if held[0] >= 0x80 and len(held) < (2 if held[0] < 0xE0 else 3 if held[0] < 0xF0 else 4):
            return (state, held, which, length, before), 0
        c = held.decode("utf-8", "replace")[0]
        state, n = self._read(state, c)
        if which >= 0 and self.special[which][length] == c:
            length, before = length + 1, before - n
            if length == len(self.special[which]):
                return self.START, n + before + 1
            return (state, b"", which, length, before), n
        which = next((i for i, s in enumerate(self.special) if s[0] == c), -1)
        return (state, b"", which, int(which >= 0), -n if which >= 0 else 0), n

    def clear(self) -> None:
        self.keys, self.number = [], {}
        self.open.clear()
        self.table = np.full((1024, 256), -1, np.int32)
        self.begin = self._number(self.START)

    def _number(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.keys)
            self.keys.append(key)
            if len(self.keys) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return self.number[key]

    def _fill(self, at: int) -> None:
        key, n = self._step(self.keys[at >> 8], at & 255)
        if not -128 <= n < 128:
            raise ValueError("a byte changes the count by more than its eight bits of a table entry hold")
        to = self._number(key)
        self.table.reshape(-1)[at] = (to << 8) | (n + 128)

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of the chunks of data, run side by side from their entry states."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, state = starts[order], lengths[order], entry[order].astype(np.int64)
        count = np.zeros(len(order), np.int64)
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(order) else []
        for t, n in enumerate(active):
            at = (state[:n] << 8) | data[starts[:n] + t]
            got = self.table.reshape(-1)[at]
            while got.min() < 0:
                for x in np.unique(at[got < 0]).tolist():
                    self._fill(x)
                got = self.table.reshape(-1)[at]
            state[:n] = got >> 8
            count[:n] += (got & 255) - 128
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def _cuts(self, data: np.ndarray, begin: int, end: int) -> tuple[list[int], list[bool]]:
        """Where the chunks of a text begin, and whether the map of each is constant."""
        cuts, constant = [begin], [True]
        at = begin + CHUNK
        while at < end:
            near = data[at - 1 : min(at + SEEK, end)]
            white = (near == 32) | ((near >= 9) & (near <= 13))
            place = np.flatnonzero(white[1:] & ~white[:-1] & (near[:-1] < 128))
            if len(place):
                cut, same = at + int(place[0]), True
            else:
                cut, same = at, False
                while cut < end and data[cut] & 0xC0 == 0x80:
                    cut += 1
            if cut >= end:
                break
            cuts.append(cut)
            constant.append(same)
            at = cut + CHUNK
        return cuts, constant

    def count(self, texts: list[bytes]) -> np.ndarray:
        """The number of tokens of each text."""
        if len(self.keys) > STATES:
            self.clear()
        sizes = np.array([len(x) for x in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(sizes)
        starts, constant, owner = [], [], []
        for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            if b > a:
                cuts, same = ([a], [True]) if b - a <= CHUNK else self._cuts(data, a, b)
                starts += cuts
                constant += same
                owner += [i] * len(cuts)
        if not starts:
            return np.zeros(len(texts), np.int64)
        starts, constant, owner = np.array(starts), np.array(constant), np.array(owner)
        lengths = np.diff(np.append(starts, len(data)))
        entry = np.full(len(starts), self.begin)
        leave, counts = self.run(data, starts, lengths, entry)
        last = np.cumsum(np.bincount(owner, minlength=len(texts))) - 1
        while True:
            known, upto = self.scanned(entry, leave, counts, constant, owner)
            if known.all():
                return np.where(sizes > 0, upto[last], 0)
            # of these the exit state of what stands before may be wrong yet, but the first of each text has the right one
            again = np.flatnonzero(~constant & (entry != np.append(self.begin, leave[:-1])))
            entry[again] = leave[again - 1]
            leave[again], counts[again] = self.run(data, starts[again], lengths[again], entry[again])

    def scanned(self, entry: np.ndarray, leave: np.ndarray, counts: np.ndarray, constant: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maps of the first chunks of each text up to each chunk, composed by a prefix scan: whether the composed map is
        known at the state in which the text begins, and its count there. First chunks have constant maps."""
        fits = constant | (entry == np.append(self.begin, leave[:-1]))  # each map can follow the one before it
        known, total, reach = fits.copy(), counts.astype(np.int64), 1
        while reach < len(owner) and (owner[reach:] == owner[:-reach]).any():
            same = np.append(np.zeros(reach, bool), owner[reach:] == owner[:-reach])
            before = np.maximum(np.arange(len(owner)) - reach, 0)
            known, total = known & (known[before] | ~same), total + np.where(same, total[before], 0)
            reach *= 2
        return known, total


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs."""
    schema = pa.schema([("doc_id", docs.schema["doc_id"].dataType.typeName() == "integer" and pa.int32() or pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.load(tokenizer)
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in texts], np.int64)
            part = np.cumsum(sizes) // AT_ONCE
            tokens = [machine.count([texts[i] for i in np.flatnonzero(part == p)]) for p in np.unique(part)]
            tokens = np.concatenate([np.zeros(0, np.int64), *tokens])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(schema.types[0]), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], schema=schema)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(counts, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")

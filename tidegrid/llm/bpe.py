"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece has one last token: the only token that ends there, starts where another prefix ends, and is
compatible with that prefix's last token. A suffix automaton of the vocabulary lists the tokens that end at a position.
Back-pointers then give the ids. All distinct new pieces of a batch advance together, one byte a step.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PieceCoder, bounded_batches, slices, texts_of

#: Pieces of more than LONG bytes, and the FEW longest of a batch if above SHORT, advance alone by looking up what is known, as a numpy call for a few rows costs more; entries that these lookups keep at most.
LONG, FEW, SHORT, KEPT = 2000, 16, 500, 500_000

#: Fixed pattern of the byte-level pre-tokenizer.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A run of spaces stays with the word after it: no match of PATTERN crosses such a border.
_CHUNKS = re.compile(r"\s*\S+|\s+")
#: Marks that end a word as one piece; an apostrophe isn't one.
_MARKS = frozenset(".,;:!?)")
#: Spaces to Python, but not to PATTERN.
_ODD = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones stand for themselves, others from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class IntMap:
    """A read-only map from non-negative long keys to ints that looks up whole arrays: open addressing, linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for keys that aren't there."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


class SuffixAutomaton:
    """Of a set of byte strings. Each string is the longest of its own state, so a state holds at most one of them."""

    def __init__(self, strings: list[bytes]):
        go: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def grow(last: int, c: int) -> int:
            if c in go[last]:
                q = go[last][c]
                return q if length[q] == length[last] + 1 else split(last, c, q)
            new = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = new
                p = link[p]
            if p >= 0:
                q = go[p][c]
                link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
            return new

        def split(p: int, c: int, q: int) -> int:
            copy = len(go)
            go.append(dict(go[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = copy
            while p >= 0 and go[p].get(c) == q:
                go[p][c] = copy
                p = link[p]
            return copy

        ends = []
        for s in strings:
            at = 0
            for c in s:
                at = grow(at, c)
            ends.append(at)
        # A later string can split the state that an earlier one ended in, so ends are looked up once all are in.
        for k, s in enumerate(strings):
            at = 0
            for c in s:
                at = go[at][c]
            ends[k] = at
        self.length, self.link = np.array(length, np.int32), np.array(link, np.int32)
        self.token = np.full(len(go), -1, np.int32)
        self.token[ends] = np.arange(len(strings))
        #: The nearest state on the way of suffix links, the state itself included, that holds a string.
        self.near = np.full(len(go), -1, np.int32)
        for s in np.argsort(self.length, kind="stable").tolist():
            self.near[s] = s if self.token[s] >= 0 else (self.near[link[s]] if s else -1)
        keys = [s << 8 | c for s, x in enumerate(go) for c in x]
        self.go = IntMap(np.array(keys, np.int64), np.array([t for x in go for t in x.values()], np.int32))

    def step(self, state: np.ndarray, matched: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states and the lengths of the longest matches after one more byte."""
        state, matched = state.astype(np.int64), matched.copy()
        out = self.go.get(state << 8 | c)
        todo = np.flatnonzero(out < 0)
        while len(todo):
            up = self.link[state[todo]]
            gone = up < 0
            out[todo[gone]], matched[todo[gone]] = 0, -1
            todo, up = todo[~gone], up[~gone]
            state[todo], matched[todo] = up, self.length[up]
            out[todo] = self.go.get(state[todo] << 8 | c[todo])
            todo = todo[out[todo] < 0]
        return out, matched + 1


class Vocabulary:
    """Tokens are numbered by the rank of their merge here: first the bytes, then the merges in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab, letters = said["model"]["vocab"], byte_letters()
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        names = [c for c in letters if c in vocab]
        number = {c: k for k, c in enumerate(names)}
        left, right = list(range(len(names))), list(range(len(names)))
        for pair in said["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if a in number and b in number and a + b not in number and a + b in vocab:
                number[a + b] = len(names)
                names.append(a + b)
                left.append(number[a])
                right.append(number[b])
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.ids = np.array([vocab[x] for x in names], np.int32)
        strings = [bytes(map(letters.__getitem__, x)) for x in names]
        self.size = np.array(list(map(len, strings)), np.int64)
        self.n = len(names)
        merged = np.flatnonzero(self.left != np.arange(self.n))
        self.pairs = IntMap(self.left[merged] * self.n + self.right[merged], merged.astype(np.int32))
        self.automaton = SuffixAutomaton(strings)
        self.moves: dict[int, tuple[int, int]] = {}
        self.ending: dict[int, tuple[tuple[int, int], ...]] = {}
        self.fitting: dict[int, bool] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves token a before token b as they are: undone merge by merge, the latest first, no pair at the border merges earlier than what stands there."""
        n, ok = len(a), np.ones(len(a), bool)
        a, b, limit, todo = a.copy(), b.copy(), np.full(n, self.n, np.int64), np.arange(n)
        while len(todo):
            x, y = a[todo], b[todo]
            pair = self.pairs.get(x * self.n + y)
            bad = (pair >= 0) & (pair < limit[todo])
            ok[todo[bad]] = False
            todo, x, y = todo[~bad], x[~bad], y[~bad]
            if not len(todo):
                break
            # The token that was merged last comes apart; one that can't leaves it to the other.
            whole_x, whole_y = self.left[x] == x, self.left[y] == y
            undo_x = ((x > y) | whole_y) & ~whole_x
            undo_y = ~undo_x & ~whole_y
            limit[todo] = np.where(undo_x, x, np.where(undo_y, y + 1, limit[todo]))
            a[todo] = np.where(undo_x, self.right[x], x)
            b[todo] = np.where(undo_y, self.left[y], y)
            todo = todo[undo_x | undo_y]
        return ok

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, whole."""
        out: list = [None] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k]))
        at = 0
        while at < len(order) and len(pieces[order[at]]) > (LONG if at >= FEW else SHORT):
            out[order[at]] = self._encode_long(pieces[order[at]])
            at += 1
        while at < len(order):
            # Pieces of like length share a table of at most about a million cells.
            rows = max(1, min(20_000, (1 << 20) // max(1, len(pieces[order[at]]))))
            some = order[at : at + rows]
            for k, ids in zip(some, self._encode([pieces[k] for k in some])):
                out[k] = ids
            at += rows
        return out

    def _move(self, state: int, c: int) -> tuple[int, int]:
        """The state after one more byte, and the length of its match if a suffix link was taken, else 0."""
        key = state << 8 | c
        if key not in self.moves:
            auto, linked = self.automaton, 0
            to = int(auto.go.get(np.array([key]))[0])
            while to < 0 and auto.link[state] >= 0:
                state = int(auto.link[state])
                to, linked = int(auto.go.get(np.array([state << 8 | c]))[0]), int(auto.length[state]) + 1
            if len(self.moves) >= KEPT:
                self.moves.clear()
            self.moves[key] = (max(to, 0), linked)
        return self.moves[key]

    def _ends(self, at: int) -> tuple[tuple[int, int], ...]:
        """The tokens that end where the automaton is in this state, longest first, and their sizes."""
        if at not in self.ending:
            auto, found, up = self.automaton, [], at
            while up >= 0:
                token = int(auto.token[up])
                found.append((token, int(self.size[token])))
                up = int(auto.near[auto.link[up]]) if auto.link[up] >= 0 else -1
            if len(self.ending) >= KEPT:
                self.ending.clear()
            self.ending[at] = tuple(found)
        return self.ending[at]

    @cached_property
    def plain(self) -> tuple[list[int], list[int], dict[int, int]]:
        """left, right and pairs as Python has them: far faster one at a time."""
        held = self.pairs.keys >= 0
        return self.left.tolist(), self.right.tolist(), dict(zip(self.pairs.keys[held].tolist(), self.pairs.values[held].tolist()))

    def _fits(self, a: int, b: int) -> bool:
        """compatible() of two tokens."""
        key = a * self.n + b
        fits = self.fitting.get(key)
        if fits is None:
            left, right, pairs = self.plain
            n, limit = self.n, self.n
            while fits is None:
                if pairs.get(a * n + b, limit) < limit:
                    fits = False
                elif left[a] != a and (a > b or left[b] == b):
                    limit, a = a, right[a]
                elif left[b] != b:
                    limit, b = b + 1, left[b]
                else:
                    fits = True
            if len(self.fitting) >= KEPT:
                self.fitting.clear()
            self.fitting[key] = fits
        return fits

    def _encode_long(self, piece: bytes) -> np.ndarray:
        """The same for one long piece, whose states, tokens and pairs soon repeat."""
        auto, fits = self.automaton, self._fits
        last = array("i", bytes(4 * (len(piece) + 1)))
        state = matched = 0
        for i, c in enumerate(piece, 1):
            before = state
            state, linked = self._move(before, c)
            matched = linked or matched + 1
            at = state if auto.token[state] >= 0 and auto.length[state] == matched else int(auto.near[auto.link[state]])
            for token, size in self._ends(at):
                if size == i or fits(last[i - size], token):
                    last[i] = token
                    break
        ids, at = [], len(piece)
        while at:
            ids.append(self.ids[last[at]])
            at -= int(self.size[last[at]])
        return np.array(ids[::-1], np.int32)

    def _encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        auto = self.automaton
        size = np.array(list(map(len, pieces)), np.int64)
        width = int(size[0])
        if not width:
            return [np.zeros(0, np.int32) for _ in pieces]
        table = np.zeros((len(pieces), width), np.uint8)
        table[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        last = np.zeros((len(pieces), width + 1), np.int64)
        state, matched = np.zeros(len(pieces), np.int32), np.zeros(len(pieces), np.int32)
        for i in range(1, width + 1):
            k = int(np.searchsorted(-size, -i, side="right"))
            state, matched = auto.step(state[:k], matched[:k], table[:k, i - 1].astype(np.int64))
            at = np.where((auto.token[state] >= 0) & (auto.length[state] == matched), state, auto.near[auto.link[state]])
            todo = np.arange(k)
            while len(todo):
                token = auto.token[at[todo]].astype(np.int64)
                start = i - self.size[token]
                fits = start == 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self.compatible(last[todo[inner], start[inner]], token[inner])
                last[todo[fits], i] = token[fits]
                todo = todo[~fits]
                at[todo] = auto.near[auto.link[at[todo]]]
        back = np.zeros((len(pieces), width), np.int32)
        number, at, todo = np.zeros(len(pieces), np.int64), size.copy(), np.flatnonzero(size)
        while len(todo):
            token = last[todo, at[todo]]
            number[todo] += 1
            back[todo, width - number[todo]] = self.ids[token]
            at[todo] -= self.size[token]
            todo = todo[at[todo] > 0]
        return [row[width - n :] for row, n in zip(back, number.tolist())]


@cache
def coder(path: str) -> PieceCoder:
    """Built once in a worker."""
    vocab = Vocabulary(path)
    special = re.compile("(" + "|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None

    def plain(text: str) -> list[str]:
        return PATTERN.findall(text) if _ODD.search(text) else _CHUNKS.findall(text)

    def split(text: str) -> list[str]:
        if special and special.search(text):
            return [x for part in special.split(text) for x in ([part] if part in vocab.special else plain(part))]
        return plain(text)

    def alone(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = vocab.encode([b"" if x in vocab.special else x.encode() for x in pieces])
        found = [np.array([vocab.special[x]], np.int32) if x in vocab.special else ids for x, ids in zip(pieces, found)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found)

    # Pieces are kept beside chunks: a word is the same piece whatever stands behind it.
    known = PieceCoder(None, alone, limit=100_000)

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        per, pieces = [], []
        for c in chunks:
            word = c[1:] if c[0] == " " else c
            # A word, alone or after one space, is one piece; one mark behind it is another.
            if word.isalpha() or c in vocab.special:
                per.append(1)
                pieces.append(c)
            elif word[-1:] in _MARKS and word[:-1].isalpha():
                per.append(2)
                pieces += c[:-1], c[-1]
            else:
                found = PATTERN.findall(c)
                per.append(len(found))
                pieces += found
        n, ids = known.lookup(pieces)
        return np.add.reduceat(n, np.cumsum(per) - per), ids

    return PieceCoder(split, encode, limit=200_000)


@cache
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id; all that decoding needs of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    letters = byte_letters()
    known = {i: bytes(map(letters.__getitem__, x)) for x, i in said["model"]["vocab"].items() if all(c in letters for c in x)} | {x["id"]: x["content"].encode() for x in said["added_tokens"]}
    return [known.get(k, b"") for k in range(max(known) + 1)]


def _decoded(table: list[bytes], ids: list[int] | None) -> str:
    try:
        raw = b"".join(map(table.__getitem__, ids or ()))
    except IndexError:
        raw = b"".join(table[k] for k in ids if k < len(table))
    return raw.decode("utf-8", "replace")


def _encoded(path: str, parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """doc_id and ids by pieces of a batch."""
    for part in parts:
        for at, column in slices(part.column(1)):
            n, ids = coder(path).batch(texts_of(column))
            yield part.column(0).slice(at, len(column)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))


def bpe_encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id and ids of every whole text, as the tokenizers library gives them with add_special_tokens=False.

    Null and empty texts have no ids. Strings of special tokens in a text become their ids. Repeated rows are encoded
    each, a null doc_id stays null; a very long text is read whole, and a very long run without a space is one piece. An
    empty table gives no rows; other columns are not read.
    """

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _encoded(path, parts):
            yield pa.RecordBatch.from_arrays(list(found), ["doc_id", "ids"])

    return _texts(docs, text).mapInArrow(encode, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded text of each row (doc_id, ids).

    Bytes that aren't UTF-8 become U+FFFD; unknown ids decode to nothing; null and empty ids to an empty text. Repeated
    rows are decoded each, however long; an empty table gives no rows; other columns are not read.
    """
    bounded_batches(encoded.sparkSession)

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([_decoded(table, x) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, decoded string")


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """What bpe_decode gives for the rows of bpe_encode, in one step: a task has one Python worker, not two."""

    def both(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for doc_id, ids in _encoded(path, parts):
            yield pa.RecordBatch.from_arrays([doc_id, ids, pa.array([_decoded(table, x) for x in ids.to_pylist()], pa.string())], ["doc_id", "ids", "decoded"])

    return _texts(docs, text).mapInArrow(both, "doc_id long, ids array<int>, decoded string")

"""Vector bin packing of token sequences.

Every example is a vector (tokens, segments, loss-bearing tokens) and every sequence a bin with a limit on each. A bin
takes the example with the largest dot product of its vector with the bin's free room, both as shares of the limits,
until none fits; then an example is cut to fill what is left. Each partition of the input fills its own bins from a
bounded pool, so that no row is shuffled. A partition's last tokens, and examples too small to fill a sequence within
its limit of segments, form sequences whose lengths are powers of two.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import byte_letters
from .common import SPACES, PieceCoder, batches, bounded_batches, give_back, joined, raw_of, slices, spread

#: Limits of a sequence: tokens, segments, and tokens that bear loss; examples to choose from.
CAPACITY, SEGMENTS, LOSS, POOL = 4096, 32, 4096, 256
#: Words that a worker keeps the ids of, about 0.6 KB each.
KEPT = 250_000
END = 2

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("segment", pa.int32()), ("loss_tokens", pa.int64()), ("ids", pa.binary())])
_PIECES_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long, ids binary"


#: Bytes of a word that a key holds.
_KEY = 24
_CAPITALS, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))
_LOWER = bytes.maketrans(_CAPITALS, _SMALL)
#: 0 for bytes that end a word, 1 for letters, 2 for others.
_KIND = bytes(0 if c in SPACES else 1 if c in _CAPITALS + _SMALL else 2 for c in range(256))
#: Second bytes of letters of Latin-1 behind 0xC3; upper case is 0x20 below lower case.
_SECOND = np.zeros(256, bool)
_SECOND[[*range(0x80, 0x97), *range(0x98, 0x9F), *range(0xA0, 0xB7), *range(0xB8, 0xC0)]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _equal_words(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions in an order that puts equal words together, and where in it each distinct word begins. A word is one number of each key."""
    mixed = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        mixed = (mixed + k) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    new = np.diff(mixed[order], prepend=~mixed[order[:1]]) != 0
    differ = np.logical_or.reduce([np.diff(k[order], prepend=~k[order[:1]]) != 0 for k in keys])
    if (differ & ~new).any():  # two words of one mix
        order = np.lexsort(keys)
        differ = np.logical_or.reduce([np.diff(k[order], prepend=~k[order[:1]]) != 0 for k in keys])
    return order, np.flatnonzero(differ)


class WordCoder:
    """Ids of the lower-casing word tokenizer. White space separates its words and is dropped, so words encode alone.

    Most words are letters of Latin-1 with at most one full stop or comma behind them. Their letters, in lower case, are
    told apart in numpy, and each distinct one of a slice is looked up once. kept: how many words a worker keeps the ids
    of, of letters and of others each.
    """

    def __init__(self, path: str, kept: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()

        def alone(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            return joined([x.ids for x in t.encode_batch_fast(words, add_special_tokens=False)])

        model, spelled = t.model, {b: c for c, b in byte_letters().items()}

        def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Runs of letters in lower case, one character for each byte: all that is left of the tokenizer's steps is its model."""
            return joined([[x.id for x in model.tokenize(w if w.isascii() else w.translate(spelled))] for w in words])

        self.runs, self.others = PieceCoder(None, letters, limit=kept), PieceCoder(None, alone, limit=kept)
        self.mark = np.full(256, -1, np.int32)
        self.mark[[46, 44]] = alone([".", ","])[1]

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all texts; null as empty."""
        raws = raw_of(column)
        whole = b" ".join([b"", *raws, bytes(_KEY)])
        a = np.frombuffer(whole, np.uint8)
        low, kind = np.frombuffer(bytearray(whole.translate(_LOWER)), np.uint8), np.frombuffer(whole.translate(_KIND), np.uint8)
        letter, inside = kind == 1, kind > 0
        inside[-_KEY:] = False
        two = np.flatnonzero(a[:-1] == 0xC3)
        two = two[_SECOND[a[two + 1]]]
        letter[two] = letter[two + 1] = True
        low[two + 1] |= 0x20
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        mark = np.where(end - start > 1, self.mark[a[end - 1]], -1)
        size = end - start - (mark >= 0)
        odd = np.flatnonzero(inside & ~letter)
        word = np.searchsorted(start, odd, side="right") - 1
        plain = size <= _KEY
        plain[word[odd < (start + size)[word]]] = False
        mark[~plain] = -1
        at, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        length, place, pool = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), []
        if len(at):
            first, n = start[at], size[at]
            eight = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
            order, new = _equal_words([eight[first + k] & _MASKS[np.clip(n - k, 0, 8)] for k in range(0, _KEY, 8)])
            number = np.diff(new, append=len(order))
            text, one = low.tobytes().decode("latin-1"), order[new]
            got, ids = self.runs.lookup([text[x:y] for x, y in zip(first[one].tolist(), (first + n)[one].tolist())], number)
            length[at[order]], place[at[order]] = np.repeat(got, number), np.repeat(np.cumsum(got) - got, number)
            pool.append(ids)
        if len(other):
            got, ids = self.others.lookup([whole[x:y].decode() for x, y in zip(start[other].tolist(), end[other].tolist())])
            length[other], place[other] = got, np.cumsum(got) - got + sum(map(len, pool))
            pool.append(ids)
        ends = np.cumsum(length + (mark >= 0))
        out = np.zeros(ends[-1] if len(ends) else 0, np.int32)
        if pool:
            to = ends - length - (mark >= 0)
            out[spread(to, length)] = np.concatenate(pool)[spread(place, length)]
            out[ends[mark >= 0] - 1] = mark[mark >= 0]
        # Words before the end of each text, and ids before it.
        words = np.searchsorted(start, 1 + np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1))
        return np.diff(np.concatenate([[0], ends])[words], prepend=0), out


@cache
def word_coder(path: str, kept: int = KEPT) -> WordCoder:
    """Built once in a worker."""
    return WordCoder(path, kept)


class Packer:
    """Fills bins from a pool of examples. An example is (key, ids, first position, loss flags or None)."""

    def __init__(self, first_id: int, capacity: int, segments: int, loss: int, pool: int, cut: bool):
        self.next, self.pool, self.cut = first_id, pool, cut
        self.limits = np.array([capacity, segments, loss], np.float64)
        self.items: list = []
        self.sizes = np.zeros((0, 3))

    def _vector(self, item) -> tuple[float, float, float]:
        _, ids, start, flags = item
        # Without flags every token but a document's first bears loss.
        return len(ids), 1, int(flags.sum()) if flags is not None else len(ids) - (start == 0)

    def add(self, items: list) -> Iterator[tuple]:
        whole = []
        for key, ids, start, flags in items:
            room = int(self.limits[0])
            while len(ids) > room or self._vector((key, ids, start, flags))[2] > self.limits[2]:
                n = room if flags is None else self._fits((key, ids, start, flags), self.limits)
                if flags is None and n - (start == 0) > self.limits[2]:
                    n = int(self.limits[2]) + (start == 0)
                whole.append((key, ids[:n], start, None if flags is None else flags[:n]))
                ids, start, flags = ids[n:], start + n, None if flags is None else flags[n:]
            if len(ids):
                whole.append((key, ids, start, flags))
        for at in range(0, len(whole), self.pool):
            self._take(whole[at : at + self.pool])
            while len(self.items) > self.pool:
                yield from self._fill()

    def _take(self, items: list) -> None:
        if items:
            self.items += items
            self.sizes = np.concatenate([self.sizes, np.array([self._vector(x) for x in items], np.float64)])

    def _drop(self, i: int):
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.sizes[i] = self.sizes[-1]
        self.sizes = self.sizes[:-1]
        return item

    def _fits(self, item, room) -> int:
        """How many leading tokens of the item fit."""
        _, ids, start, flags = item
        n = min(len(ids), int(room[0]))
        if flags is None:
            return min(n, int(room[2]) + (start == 0))
        over = np.flatnonzero(np.cumsum(flags[:n]) > room[2])
        return int(over[0]) if len(over) else n

    @staticmethod
    def _short(tokens: np.ndarray, room: np.ndarray) -> bool:
        """Whether the largest examples that may still come hold fewer tokens than there is room for."""
        k = int(room[1])
        return bool((tokens if len(tokens) <= k else np.partition(tokens, -k)[-k:]).sum() < room[0])

    def _fill(self, limit: int | None = None) -> Iterator[tuple]:
        room = self.limits.copy()
        if limit is not None:
            room[0] = limit
        if self.cut and len(self.items) > self.limits[1]:
            # Where as many examples as a bin may hold can't fill it, its length is a power of two that they do fill.
            most = int(np.partition(self.sizes[:, 0], -int(self.limits[1]))[-int(self.limits[1]) :].sum())
            if most < room[0]:
                room[0] = 1 << (most.bit_length() - 1)
        taken = []
        while self.items and room[0] >= 1 and room[1] >= 1:
            fits = (self.sizes <= room).all(axis=1)
            # Whole examples come first, unless all that may still come can't fill the bin: then a longer one is cut.
            if fits.any() and not (self.cut and self._short(self.sizes[fits, 0], room) and (self.sizes[:, 0] > room[0]).any()):
                gain = self.sizes @ (room / self.limits / self.limits)
                item = self._drop(int(np.argmax(np.where(fits, gain, -1.0))))
            elif self.cut:
                i = int(np.argmax(self.sizes[:, 0]))
                n = self._fits(self.items[i], room)
                if n < 1:
                    break
                key, ids, start, flags = self._drop(i)
                item = (key, ids[:n], start, None if flags is None else flags[:n])
                self._take([(key, ids[n:], start + n, None if flags is None else flags[n:])])
            else:
                break
            taken.append(item)
            room -= self._vector(item)
        offset = 0
        for k, item in enumerate(taken):
            (doc_id, total), ids, start, _ = item
            yield doc_id, start, len(ids), total, self.next, offset, k, int(self._vector(item)[2]), ids.astype("<u4").tobytes()
            offset += len(ids)
        self.next += 1

    def close(self) -> Iterator[tuple]:
        while self.items:
            left = int(self.sizes[:, 0].sum())
            # Less than a bin: its length becomes the largest power of two that the rest fills.
            yield from self._fill(1 << (left.bit_length() - 1) if self.cut and left < self.limits[0] else None)


def piece_rows(parts: Iterator[pa.RecordBatch], tokenizer: str, packer: Packer, end_id: int, kept: int = KEPT) -> Iterator[tuple]:
    """Packed pieces of the documents (doc_id, text) of a partition, sequence by sequence."""
    coder = word_coder(tokenizer, kept)
    for part in parts:
        for at, column in slices(part.column(1)):
            n, ids = coder.batch(column)
            items, to = [], 0
            for doc_id, k in zip(part.column(0).slice(at, len(column)).to_pylist(), n.tolist()):
                items.append(((doc_id, k + 1), np.append(ids[to : to + k], np.int32(end_id)), 0, None))
                to += k
            yield from packer.add(items)
    yield from packer.close()
    give_back()


def own_packer(capacity: int, segments: int, loss: int, pool: int, cut: bool) -> Packer:
    """A packer whose sequence numbers are those of the task's partition."""
    return Packer(TaskContext.get().partitionId() << 33, capacity, segments, loss, pool, cut)


def document_texts(docs: DataFrame, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text"))


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL, end_id: int = END, cut: bool = True, kept: int = KEPT) -> DataFrame:
    """Pieces of documents in sequences of at most capacity tokens: doc_id, start, length, doc_tokens, sequence_id, offset, segment, loss_tokens, ids (little-endian unsigned 32-bit).

    A document is its ids and end_id; null and empty texts are end_id alone. Every token but a document's first bears
    loss. Ties of the dot product go to the example that came first. Long documents are cut into several pieces. Repeated
    rows are packed each; an empty table gives no rows; other columns are not read. sequence_id is unique, and the same
    whenever the input is split the same way. kept bounds the memory of a worker, not the result.
    """

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(piece_rows(parts, tokenizer, own_packer(capacity, segments, loss, pool, cut), end_id, kept), _PIECES, 500)

    return document_texts(docs, text).mapInArrow(pack, _PIECES_DDL)


def pack_examples(examples: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL, cut: bool = False) -> DataFrame:
    """The same for instruction data that is tokenised already: doc_id long, ids array<int>, bears_loss array<boolean>.

    With cut false an example stays whole unless it exceeds a limit by itself. Null or empty ids give no piece; null
    bears_loss means that every token but the first bears loss.
    """
    bounded_batches(examples.sparkSession)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = own_packer(capacity, segments, loss, pool, cut)

        def rows():
            for part in parts:
                items = []
                for doc_id, ids, flags in zip(*(c.to_pylist() for c in part.columns)):
                    if ids:
                        items.append(((doc_id, len(ids)), np.array(ids, np.int32), 0, None if flags is None else np.array(flags, bool)))
                yield from packer.add(items)
            yield from packer.close()

        yield from batches(rows(), _PIECES, 500)

    return examples.select(examples["doc_id"].cast("long").alias("doc_id"), examples["ids"].cast("array<int>").alias("ids"), examples["bears_loss"].cast("array<boolean>").alias("bears_loss")).mapInArrow(pack, _PIECES_DDL)

"""A gated recurrent language model in numpy.

The output is factored: first a class, then a word of the class. The most frequent words, and the end of a document,
form classes by frequency, and their probabilities inside a class depend on the state. All other words form classes by
their last two bytes; inside these, counts over the whole training text decide, with one added to each. So every word
has a probability, known or not.

Training is distributed: in each of ROUNDS rounds every partition starts from the shared weights, runs once over its
share of the training documents with backpropagation truncated to STEPS words, and the weights are averaged by words.
Scoring takes blocks of documents together with the counts of the block's words; the state runs through a document from
its first to its last word.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, slices

#: Frequent words with weights of their own; words of a class; classes of other words; size of the state.
HEAD, MEMBERS, TAILS, STATE = 1024, 32, 32, 16
#: Passes of averaging (each document takes part in one); lanes and steps of an update; step size; bytes of a scoring block.
ROUNDS, LANES, STEPS, RATE, BLOCK = 2, 256, 20, 0.01, 16 << 20
#: The end of a document. No word holds a line feed.
END = b"\n"
#: Rows of averaged weights.
_SLICE = 8192
#: Words whose class probabilities are worked out at once: a table of these fits a core's cache.
_SOME = 1024
#: The class of each symbol.
_GROUPS = np.concatenate([np.arange(HEAD) // MEMBERS, HEAD // MEMBERS + np.arange(TAILS)]).astype(np.uint8)


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


@dataclass
class Gru:
    """Weights as views of one vector. Symbols: 0 .. HEAD-1 are frequent words, HEAD + k is any other word of class k.

    Inside, features come first and words last, so that every operation runs along many words.
    """

    flat: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        at = 0
        for name, shape in self.shapes().items():
            n = int(np.prod(shape))
            self.p[name] = self.flat[at : at + n].reshape(shape)
            at += n

    @staticmethod
    def shapes() -> dict[str, tuple]:
        groups = HEAD // MEMBERS
        return {"table": (3 * STATE, HEAD + TAILS), "u": (3 * STATE, STATE), "v": (groups + TAILS, STATE), "vb": (groups + TAILS,), "w": (groups, MEMBERS, STATE), "wb": (groups, MEMBERS)}

    @classmethod
    def new(cls, head_counts: np.ndarray, tail_counts: np.ndarray, seed: int = 1) -> Gru:
        """Starts at the unigram probabilities of words and classes."""
        rng = np.random.default_rng(seed)
        g = cls(np.zeros(sum(int(np.prod(s)) for s in cls.shapes().values()), np.float32))
        g.p["table"][:] = rng.standard_normal(g.p["table"].shape) * 0.1
        g.p["u"][:] = rng.standard_normal(g.p["u"].shape) / np.sqrt(STATE)
        counts = np.zeros(HEAD)
        counts[: len(head_counts)] = head_counts
        groups = counts.reshape(-1, MEMBERS)
        g.p["vb"][:] = np.log(np.concatenate([groups.sum(1), tail_counts]) + 1e-3 + (tail_counts.sum() + counts.sum()) * 1e-7)
        g.p["wb"][:] = np.where(groups > 0, np.log(np.maximum(groups, 1)), -30)
        return g

    def states(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, memory: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """x: steps x lanes of symbols read; keep: 0 where a document starts; h: state x lanes. Returns the states (state x steps x lanes) and the last.

        memory takes, of all steps, the states before ("h"), the gates as tanh of half their sums ("g": first that of the
        reset, then that of the update), the new states ("new") and the old ones' half part in them ("a").
        """
        n, half = STATE, np.full((3 * STATE, 1), 0.5, self.flat.dtype)
        # A gate is (1 + tanh(half its sum)) / 2; the halves are taken once, from the weights.
        u = self.p["u"] * half
        half[2 * n :] = 1
        pre = (self.p["table"] * half).take(x, axis=1)
        out = np.empty((n, *x.shape), self.flat.dtype)
        if memory is not None:
            memory |= {name: np.empty((k, *x.shape), self.flat.dtype) for name, k in (("h", n), ("g", 2 * n), ("new", n), ("a", n))}
        for t in range(len(x)):
            h = h * keep[t]
            a = u @ h
            g = pre[: 2 * n, t] + a[: 2 * n]
            np.tanh(g, out=g)
            an = a[2 * n :]
            new = g[:n] * an
            new += an
            new += pre[2 * n :, t]
            np.tanh(new, out=new)
            if memory is not None:
                memory["h"][:, t], memory["g"][:, t], memory["new"][:, t], memory["a"][:, t] = h, g, new, an
            z = g[n:]
            z *= 0.5
            z += 0.5
            h -= new
            h *= z
            h += new
            out[:, t] = h
        return out, h

    def log_p(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probability of each symbol y given the state before it (words x state); for symbols of TAILS that of the class alone."""
        return self._log_p(np.ascontiguousarray(h.T), y)

    def _log_p(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """With grads, adds the gradient of the summed negative log-likelihood there, that of h as "h"."""
        p, groups, dtype = self.p, HEAD // MEMBERS, self.flat.dtype
        # Words of a class lie together; below the states runs a row of ones, for the constant terms.
        group = _GROUPS[y]
        order = np.argsort(group, kind="stable")
        group, y = group[order].astype(np.intp), y[order]
        states = np.empty((STATE + 1, len(y)), dtype)
        h.take(order, axis=1, out=states[:STATE], mode="clip")
        states[STATE] = 1
        # Shifted by the greatest constant term, sums of exponentials stay in range without their own greatest term, as long as weights are moderate.
        reach = max(1.0, float(h.max(initial=0)), -float(h.min(initial=0)))
        tame = reach * max(float(np.abs(p[k]).sum(-1).max()) for k in ("v", "w")) < 40
        v = np.concatenate([p["v"], (p["vb"] - p["vb"].max())[:, None]], axis=1)
        w = np.concatenate([p["w"], (p["wb"] - p["wb"].max(1)[:, None])[:, :, None]], axis=2)
        got = np.empty(len(y), dtype)
        if grads is not None:
            dh, dv = np.empty((STATE, len(y)), dtype), np.zeros_like(v)

        def of(e: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """e: log-weights, a column for each word; at: the words' own rows. Returns the log-probabilities; with grads, e times the factor of each column, which comes second, is what gradients are made of."""
            at = at * e.shape[1] + np.arange(e.shape[1])
            if not tame:
                e -= e.max(0)
            own = e.ravel().take(at)
            np.exp(e, out=e)
            total = e.sum(0)
            own -= np.log(total)
            if grads is not None:
                e.ravel()[at] -= total
                np.divide(1, total, out=total)
            return own, total

        for a in range(0, len(y), _SOME):
            b = min(a + _SOME, len(y))
            e = v @ states[:, a:b]
            got[a:b], part = of(e, group[a:b])
            if grads is not None:
                dv += e @ (states[:, a:b] * part).T
                np.matmul(p["v"].T, e, out=dh[:, a:b])
                dh[:, a:b] *= part
        edges = np.searchsorted(group, np.arange(groups + 1)).tolist()
        k = 0
        while k < groups:
            # Classes are taken together up to some number of words.
            first, k = k, k + 1
            a = edges[first]
            while k < groups and edges[k + 1] - a <= 2 * _SOME:
                k += 1
            b = edges[k]
            if a == b:
                continue
            e, runs = np.empty((MEMBERS, b - a), dtype), [(j, edges[j], edges[j + 1]) for j in range(first, k) if edges[j] < edges[j + 1]]
            for j, c, d in runs:
                np.matmul(w[j], states[:, c:d], out=e[:, c - a : d - a])
            own, part = of(e, y[a:b] % MEMBERS)
            got[a:b] += own
            if grads is not None:
                some, back = states[:, a:b] * part, np.empty((STATE, b - a), dtype)
                for j, c, d in runs:
                    dw = e[:, c - a : d - a] @ some[:, c - a : d - a].T
                    grads["w"][j] += dw[:, :STATE]
                    grads["wb"][j] += dw[:, STATE]
                    np.matmul(p["w"][j].T, e[:, c - a : d - a], out=back[:, c - a : d - a])
                back *= part
                dh[:, a:b] += back
        place = np.empty(len(y), np.intp)
        place[order] = np.arange(len(y))
        if grads is not None:
            grads["v"] += dv[:, :STATE]
            grads["vb"] += dv[:, STATE]
            grads["h"] = dh.take(place, axis=1)
        return got[place]

    def gradient(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, h0: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Summed negative log-likelihood of a window, its gradient as one vector, and the last state (h0 and it: lanes x state)."""
        n, memory, g = STATE, {}, Gru(np.zeros_like(self.flat))
        states, last = self.states(x, keep, np.ascontiguousarray(h0.T), memory)
        loss = -self._log_p(states.reshape(n, -1), y.ravel(), g.p).sum()
        dh_out = g.p["h"].reshape(states.shape)
        h, new, r, z = memory["h"], memory["new"], memory["g"][:n], memory["g"][n:]
        for gate in (r, z):
            gate *= 0.5
            gate += 0.5
        # What a step multiplies its gradient with, for all steps at once.
        rest = 1 - z
        by_new = rest * (1 - new * new)
        by_z = h - new
        by_z *= z
        by_z *= rest
        by_r = 1 - r
        by_r *= r
        by_r *= memory["a"]
        by_r *= 2
        dx, da = np.empty((3 * n, *x.shape), self.flat.dtype), np.empty((3 * n, *x.shape), self.flat.dtype)
        back = np.ascontiguousarray(self.p["u"].T)
        dh, now = np.zeros_like(last), np.empty((3 * n, x.shape[1]), self.flat.dtype)
        for t in range(len(x) - 1, -1, -1):
            dh += dh_out[:, t]
            dpn = dh * by_new[:, t]
            np.multiply(dpn, by_r[:, t], out=now[:n])
            np.multiply(dh, by_z[:, t], out=now[n : 2 * n])
            np.multiply(dpn, r[:, t], out=now[2 * n :])
            dx[2 * n :, t] = dpn
            da[:, t] = now
            dh *= z[:, t]
            dh += back @ now
            dh *= keep[t]
        dx[: 2 * n] = da[: 2 * n]
        g.p["u"][:] = da.reshape(3 * n, -1) @ h.reshape(n, -1).T
        ids = x.ravel().astype(np.intp, copy=False)
        g.p["table"][:] = [np.bincount(ids, row, HEAD + TAILS) for row in dx.reshape(3 * n, -1)]
        return float(loss), g.flat, last.T


class Trainer:
    """Adam over windows of a stream of documents, cut into lanes."""

    def __init__(self, model: Gru, rate: float):
        self.model, self.rate = model, rate
        self.m, self.s, self.n, self.words = np.zeros_like(model.flat), np.zeros_like(model.flat), 0, 0

    def update(self, x, y, keep, h):
        _, g, h = self.model.gradient(x, y, keep, h)
        g /= x.size
        g *= min(1.0, 1.0 / max(float(np.sqrt(g @ g)), 1e-9))
        self.n += 1
        self.m += 0.1 * (g - self.m)
        self.s += 0.005 * (g * g - self.s)
        self.model.flat -= self.rate / (1 - 0.9**self.n) * self.m / (np.sqrt(self.s / (1 - 0.995**self.n)) + 1e-8)
        return h

    def stream(self, y: np.ndarray, starts: np.ndarray, end: int = 0) -> None:
        """y: symbols of whole documents, one after the other; starts: 1 at each first symbol."""
        self.words += len(y)
        x = np.where(starts, end, np.concatenate([[end], y[:-1]]))
        # Fewer lanes where the stream is short, for some fifty updates at least.
        lanes = max(1, min(LANES, len(y) // STEPS, max(8, len(y) // (50 * STEPS))))
        size = -(-len(y) // lanes)
        # The last lane is filled from the front of the stream.
        at = np.arange(size * lanes) % len(y)
        x, y, keep = (a[at].reshape(lanes, size).T for a in (x, y, 1 - starts.astype(np.float32)))
        h = np.zeros((lanes, STATE), np.float32)
        for t in range(0, size, STEPS):
            h = self.update(x[t : t + STEPS], y[t : t + STEPS], keep[t : t + STEPS], h)


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, in lower case, one after the other, and the number of each text's. Null texts have none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    words, ends = split.flatten().cast(pa.binary()), np.cumsum(pc.list_value_length(split).to_numpy())
    # Space at either end of a text leaves an empty word there.
    there = pc.not_equal(pc.binary_length(words), 0)
    ends = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[np.concatenate([[0], ends])]
    return words.filter(there), np.diff(ends)


def with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """ids of the words of texts, each text's followed by end."""
    out = np.full(len(ids) + len(sizes), end, ids.dtype)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes + 1) - 1] = False
    out[inner] = ids
    return out


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each word among others, -1 where it isn't there."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy()


#: Tail classes by the last two bytes of a word, as a number; then those of words of one byte.
_KINDS = np.array([*(tail_class(bytes((a, b))) for a in range(256) for b in range(256)), *(tail_class(bytes((a,))) for a in range(256))], np.int32)


def tail_classes(words: pa.Array) -> np.ndarray:
    """tail_class of all words."""
    _, offsets, data = words.buffers()
    if not len(words):
        return np.zeros(0, np.int32)
    offsets, data = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1], np.frombuffer(data, np.uint8)
    last = offsets[1:] - 1
    short = offsets[:-1] == last
    return _KINDS[np.where(short, 1 << 16, data[last - ~short].astype(np.int32) << 8) + data[last]]


class Symbols:
    """Symbols of words: the places of frequent ones, the classes of all others."""

    def __init__(self, head: list[bytes]):
        self.head = pa.array(head, pa.binary())

    def of(self, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts with their ends, and a 1 at each first one."""
        ids, sizes = [], []
        for column in columns:
            words, n = words_of(column)
            at = places(words, self.head)
            rare = np.flatnonzero(at < 0)
            at = at.astype(np.int32)
            at[rare] = HEAD + tail_classes(words)[rare]
            ids.append(with_ends(at, n, 0))
            sizes.append(n + 1)
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        starts = np.zeros(len(ids), np.int8)
        starts[np.cumsum(sizes) - sizes] = 1
        return ids, starts


def score_documents(model: Gru, y: np.ndarray, sizes: np.ndarray, lanes: int = 2 * LANES) -> np.ndarray:
    """Sum of natural log_p over each document. Documents queue up in lanes; every state runs from first to last word."""
    lanes = max(1, min(lanes, len(sizes)))
    ends = np.cumsum(sizes)
    queue = [(0, k) for k in range(lanes)]
    held: list[list[int]] = [[] for _ in range(lanes)]
    for d in np.argsort(-sizes, kind="stable").tolist():
        n, k = queue[0]
        held[k].append(d)
        heapq.heapreplace(queue, (n + int(sizes[d]), k))
    held.sort(key=lambda ds: -int(sizes[ds].sum()))
    long = np.array([sizes[ds].sum() for ds in held])
    steps = int(long[0])
    at = np.full((lanes, steps), -1, np.int32 if len(y) < 1 << 31 else np.int64)
    for k, ds in enumerate(held):
        at[k, : long[k]] = np.concatenate([np.arange(ends[d] - sizes[d], ends[d]) for d in ds])
    first = np.zeros(len(y), bool)
    first[ends - sizes] = True
    got = np.zeros(len(y), np.float64)
    h = np.zeros((STATE, lanes), np.float32)
    t = 0
    while t < steps:
        k = int((long > t).sum())
        # Where few lanes are left, windows grow: the work outside the recurrence is done for some 10,000 words at once.
        size = max(STEPS, 10_000 // k)
        i = at[:k, t : t + size].T
        t += size
        there = i >= 0
        start = first[i]
        x = np.where(start, 0, y[np.maximum(i - 1, 0)])
        states, h = model.states(x, (~start).astype(np.float32), h[:, :k])
        got[i[there]] = model._log_p(states.reshape(STATE, -1)[:, there.ravel()], y[i[there]])
    return np.add.reduceat(got, ends - sizes)


@dataclass
class LanguageModel:
    """Everything here has a fixed size. counts: HEAD frequent words; totals: words and distinct words of each tail class."""

    gru: Gru
    head: list[bytes]
    tail_words: np.ndarray
    tail_distinct: np.ndarray
    words: int
    distinct: int


def _block(text: str, blocks: int) -> Column:
    """The block of a row, by its id and text, so that rows without an id are spread as well."""
    return F.pmod(F.xxhash64("doc_id", text, F.lit(5)), F.lit(blocks)).cast("int")


#: Bits of the number of a block's part.
_PARTS = 20


#: Bytes of text whose words a task holds until it counts them.
_HELD = 24 << 20


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each block with their numbers in training texts, 0 for words of other texts alone. at: the block, and which part of its words this is."""
    # Of each block the words of training texts and of others, and how many texts there are.
    found: dict[int, tuple[list, list, list]] = {}
    given: Counter = Counter()

    def out():
        for block, (learnt, other, texts) in found.items():
            told = pa.concat_arrays([*learnt, *other]).dictionary_encode()
            numbers = np.bincount(told.indices.to_numpy()[: sum(map(len, learnt))], minlength=len(told.dictionary))
            words = pa.concat_arrays([told.dictionary, pa.array([END], pa.binary())])
            numbers = pa.array(np.append(numbers, texts[0]), pa.int64())
            at = pa.array(np.full(len(words), block << _PARTS | given[block]))
            given[block] += 1
            for k in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([x.slice(k, 20_000) for x in (at, words, numbers)], ["at", "word", "n"])

    held = 0
    for part in parts:
        blocks, train = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
        for at, column in slices(part.column(2)):
            words, sizes = words_of(column)
            kinds = blocks[at : at + len(column)].astype(np.int64) << 1 | ~train[at : at + len(column)]
            each = np.repeat(kinds, sizes)
            for kind, n in zip(*np.unique(kinds, return_counts=True)):
                kept = found.setdefault(int(kind >> 1), ([], [], [0, 0]))
                kept[kind & 1].append(words if len(kinds) == n else words.filter(pa.array(each == kind)))
                kept[2][kind & 1] += int(n)
            held += words.nbytes
            if held > _HELD:
                yield from out()
                found.clear()
                held = 0
    yield from out()


def word_counts(docs: DataFrame, train: Column, blocks: int, text: str = "text") -> DataFrame:
    """block, word, n, kind, first: for every word of the block its number in all training texts and its tail class; first is set in one block of each word."""
    rows = docs.select(_block(text, blocks).alias("block"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    # Documents of a block meet first, so that a word leaves its block once.
    local = checkpointed(rows.repartition("block").mapInArrow(_count, "at long, word binary, n long"))
    kind = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(TAILS)).cast("int")
    # A word has as many rows as there are blocks, at most: one sort gives each of them the word's total.
    own = Window.partitionBy("word")
    # A block that gave out its words in parts has some twice, with the same total.
    return checkpointed(local.select(F.shiftright("at", _PARTS).cast("int").alias("block"), "word", F.sum("n").over(own).alias("n"), kind.alias("kind"), (F.col("at") == F.min("at").over(own)).alias("first")))


def fit_language_model(docs: DataFrame, train: Column, counts: DataFrame, text: str = "text", rounds: int = ROUNDS) -> LanguageModel:
    """The model of all documents for which train holds. counts: as from word_counts."""
    spark = docs.sparkSession
    known = counts.where("first AND n > 0").select("word", "n", "kind")
    top = known.where(F.col("word") != F.lit(END)).orderBy(F.desc("n"), "word").limit(HEAD - 1).collect()
    head = [END, *(bytes(r.word) for r in top)]
    rows = known.groupBy(F.col("kind").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    end_n = known.where(F.col("word") == F.lit(END)).collect()
    head_counts = np.array([end_n[0].n if end_n else 0, *(r.n for r in top)], np.float64)
    words, distinct = np.zeros(TAILS), np.zeros(TAILS)
    for r in rows:
        words[r.k], distinct[r.k] = r.n, r.v
    model = LanguageModel(Gru.new(np.zeros(0), np.zeros(TAILS)), head, words.copy(), distinct.copy(), int(words.sum()), int(distinct.sum()))
    for w, n in zip(head, head_counts):
        if n:
            model.tail_words[tail_class(w)] -= n
            model.tail_distinct[tail_class(w)] -= 1
    model.gru = Gru.new(head_counts, model.tail_words)
    learn = docs.where(train)
    for k in range(rounds):
        part = learn.where(F.pmod(F.xxhash64("doc_id", text, F.lit(9)), F.lit(rounds)) == k).select(F.col(text).alias("text"))
        shared = spark.sparkContext.broadcast((model.gru.flat, head))
        got = part.mapInArrow(_trained(shared, RATE / (1 + k)), "slice int, words double, weights binary").repartition("slice").mapInArrow(_averaged, "slice int, words double, weights binary").collect()
        flat = model.gru.flat.copy()
        for r in got:
            flat[r.slice * _SLICE : (r.slice + 1) * _SLICE] = np.frombuffer(r.weights, np.float64) / r.words
        model.gru = Gru(flat)
    return model


def _rows(found) -> Iterator[pa.RecordBatch]:
    for k, words, weights in found:
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([float(words)]), pa.array([weights.astype(np.float64).tobytes()], pa.binary())], ["slice", "words", "weights"])


def _streams(columns: Iterator[pa.Array], size: int) -> Iterator[list[pa.Array]]:
    """Texts in pieces; a stream ends with the text that brings it above size bytes."""
    kept: list[pa.Array] = []
    held = 0
    for column in columns:
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(column):
            before = int(ends[at - 1]) if at else 0
            to = min(len(column), int(np.searchsorted(ends, before + size - held, side="right")) + 1)
            kept += [piece for _, piece in slices(column.slice(at, to - at))]
            held += int(ends[to - 1]) - before
            at = to
            if held > size:
                yield kept
                kept, held = [], 0
    if kept:
        yield kept


def _trained(shared, rate: float):
    def train(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, head = shared.value
        symbols, trainer = Symbols(head), Trainer(Gru(flat.copy()), rate)
        for texts in _streams((part.column(0) for part in parts), 6 << 20):
            trainer.stream(*symbols.of(texts))
        n = trainer.words
        if n:
            flat = trainer.model.flat.astype(np.float64) * n
            yield from _rows((k, n, flat[k * _SLICE : (k + 1) * _SLICE]) for k in range(-(-len(flat) // _SLICE)))

    return train


def _averaged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for part in parts:
        for k, words, weights in zip(*(c.to_pylist() for c in part.columns)):
            held = total.setdefault(k, [0.0, 0.0])
            held[0] += words
            held[1] = held[1] + np.frombuffer(weights, np.float64)
    yield from _rows((k, n, w) for k, (n, w) in total.items())


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scorer(shared):
    def score(docs: pa.Table, counts: pa.Table) -> pa.Table:
        model = shared.value
        if not docs.num_rows:
            return _SCORES.empty_table()
        # For each word of the block its symbol, its count, and its place in the table of both. Of a word that came twice one place is used.
        known = counts.column("word").combine_chunks()
        n = counts.column("n").to_numpy().astype(np.float64)
        kind = counts.column("kind").to_numpy()
        symbol = places(known, pa.array(model.head, pa.binary()))
        symbol = np.where(symbol < 0, HEAD + kind, symbol).astype(np.int32)
        base = np.log10((n + 1) / (model.words + model.distinct + 1))
        inside = np.where(symbol < HEAD, 0.0, np.log10((n + 1) / (np.maximum(model.tail_words, 0) + np.maximum(model.tail_distinct, 0) + 1)[kind]))
        found = [words_of(column) for chunk in docs.column("text").chunks for _, column in slices(chunk)]
        sizes = np.concatenate([x for _, x in found])
        at = places(pa.concat_arrays([x for x, _ in found]), known)
        found.clear()
        if at.min(initial=0) < 0:
            raise ValueError("a block's counts lack some of its words")
        at = with_ends(at, sizes, int(places(pa.array([END], pa.binary()), known)[0]))
        sizes = sizes.astype(np.int64) + 1
        first = np.cumsum(sizes) - sizes
        whole = score_documents(model.gru, symbol[at], sizes) / np.log(10)
        out = [docs.column("doc_id").combine_chunks(), sizes, np.add.reduceat((n[at] > 0).astype(np.int64), first), np.full(len(sizes), model.words, np.int64), np.add.reduceat(base[at], first), whole + np.add.reduceat(inside[at], first)]
        return pa.Table.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in out], schema=_SCORES)

    return score


def score_texts(docs: DataFrame, train: Column, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    The model and the counts learn from the documents for which train holds; all are scored, whole. Null and empty texts
    are their end alone. Frequent words of equal count are ordered by their bytes. Equal texts get equal scores up to
    rounding; without training documents words have uniform class probabilities; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK
    counts = word_counts(docs, train, blocks)
    shared = spark.sparkContext.broadcast(fit_language_model(docs, train, counts))
    left = docs.select(_block("text", blocks).alias("block"), "doc_id", "text").groupBy("block")
    return left.cogroup(counts.select("block", "word", "n", "kind").groupBy("block")).applyInArrow(_scorer(shared), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Quality rules: counts of a document's words, symbols and repeats, judged by fixed limits and by an isolation forest.

The forest is grown on all labelled rows of a fold, level by level: tasks give the ranges and the sizes of their nodes,
Spark merges them, the driver draws the splits. Splits are drawn over the range of all rows, but only good rows count
for a node's size: a part of the space that no good document reaches is isolated at once, so what is unlike good
documents has short paths. The limit on the score comes from all labelled rows of the other fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, raw_of, record

#: Trees; a node is isolated with a share of 1 / PSI of all good rows; how much a good document lost outweighs a bad one kept; limits to choose from.
TREES, PSI, LOSS, LIMITS = 200, 512, 50.0, 1 << 16
#: Labelled rows that a task sends down the trees at a time.
_ROWS = 20_000

_OTHER = bytes(set(range(256)) - set(b"#*$%&|<>"))
_NOT_DIGIT, _NOT_UPPER, _NOT_MARK = (bytes(set(range(256)) - set(x)) for x in (b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?()'\"-=/[]"))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "digits", "upper", "marks", "distinct", "short", "line_words", "longest", "non_ascii")
_DDL = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", rates array<float>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("rates", pa.list_(pa.float32()))])


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside three-word windows that occur twice or more, and distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(ids) < 3:
        return 0, len(seen)
    v = len(seen)
    if v < 2_000_000:
        window = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        window = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0, v
    again = np.zeros(len(window), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum()), v


def measure(raw: bytes) -> tuple:
    """The counts and the rates of one text."""
    words = raw.split()
    n = len(words)
    bare = b"".join(words)
    chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))
    symbols = len(raw.translate(None, _OTHER))
    lines = [x for x in raw.split(b"\n") if x.strip(b"\x20\x09\x0b\x0c\x0d")]
    dup = len(lines) - len(set(lines))
    repeats, distinct = repeat_words(words)
    w, c = max(n, 1), max(chars, 1)
    rates = (np.log1p(n), chars / w, symbols / w, dup / max(len(lines), 1), repeats / w, len(raw.translate(None, _NOT_DIGIT)) / c, len(raw.translate(None, _NOT_UPPER)) / c, len(raw.translate(None, _NOT_MARK)) / w, distinct / w, sum(len(x) <= 3 for x in words) / w, np.log1p(n / max(len(lines), 1)), np.log1p(max(map(len, words), default=0)), (len(bare) - chars) / c)
    return n, chars, symbols, dup, repeats, [float(x) for x in rates]


def quality_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the counts and the rates of every whole text; null counts as a text without words."""
    bounded_batches(docs.sparkSession)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                yield record([(d, *measure(raw)) for d, raw in zip(part.column(0).to_pylist(), raw_of(part.column(1)))], _SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, _DDL)


def _average_path(n: np.ndarray | float):
    """Mean depth of an unsuccessful search in a binary tree of n rows; between whole numbers a straight line."""
    n = np.asarray(n, np.float64)

    def whole(k):
        m = np.maximum(k, 2)
        return np.where(k > 2, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, np.where(k == 2, 1.0, 0.0))

    k = np.floor(n)
    return whole(k) + (n - k) * (whole(k + 1) - whole(k))


class Extent:
    """Of the nodes of one level in all trees: number of good rows, and least and greatest value of each feature among all rows. Extents of parts of the rows merge to that of all."""

    def __init__(self, level: int, width: int):
        nodes = 1 << level
        self.size = np.zeros((TREES, nodes), np.int64)
        self.low, self.high = np.full((TREES, nodes, width), np.inf, np.float32), np.full((TREES, nodes, width), -np.inf, np.float32)

    def merge(self, tree: int, nodes, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.size[tree, nodes] += size
        self.low[tree, nodes] = np.minimum(self.low[tree, nodes], low)
        self.high[tree, nodes] = np.maximum(self.high[tree, nodes], high)


@dataclass
class IsolationForest:
    """Trees as arrays: node k of a tree sends a row to 2k+1 or 2k+2; leaves have feature -1 and their path length."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    norm: float
    limit: float = 1.0

    @classmethod
    def bare(cls, n_good: int) -> IsolationForest:
        """Roots alone."""
        psi = min(PSI, n_good)
        nodes = (1 << (cls.depth(n_good) + 1)) - 1
        return cls(np.full((TREES, nodes), -1, np.int16), np.zeros((TREES, nodes), np.float32), np.zeros((TREES, nodes), np.float32), float(_average_path(psi)) or 1.0)

    @staticmethod
    def depth(n_good: int) -> int:
        return max(1, int(np.ceil(np.log2(max(min(PSI, n_good), 2)))))

    @classmethod
    def grow(cls, x: np.ndarray, good: np.ndarray, seed: int = 7) -> IsolationForest:
        n = int(good.sum())
        forest = cls.bare(n)
        for level in range(cls.depth(n) + 1):
            extent = Extent(level, x.shape[1])
            forest.measure(x, good, level, extent)
            if not forest.split(level, extent, n, seed):
                break
        return forest

    def measure(self, x: np.ndarray, good: np.ndarray, level: int, extent: Extent) -> None:
        """Adds these rows to the extent of the level's nodes."""
        first = (1 << level) - 1
        for t in range(len(self.feature)):
            k = self._down(x, t)
            at = np.flatnonzero(k >= first)
            k = (k[at] - first).astype(np.int16)
            order = np.argsort(k, kind="stable")
            at, k = at[order], k[order]
            if len(k):
                edges = np.flatnonzero(np.diff(k, prepend=-1))
                rows = x[at]
                extent.merge(t, k[edges], np.add.reduceat(good[at].astype(np.int64), edges), np.minimum.reduceat(rows, edges), np.maximum.reduceat(rows, edges))

    def split(self, level: int, extent: Extent, n_good: int, seed: int = 7) -> bool:
        """Draws the splits of the level's nodes, or ends them as leaves; whether any was split."""
        rng = np.random.default_rng((seed, level))
        first, share = (1 << level) - 1, min(PSI, n_good) / n_good
        size, wide = extent.size * share, extent.high > extent.low
        f = np.where(wide, rng.random(wide.shape), -1.0).argmax(2)
        low, high = (np.take_along_axis(a, f[:, :, None], 2)[:, :, 0].astype(np.float64) for a in (extent.low, extent.high))
        inner = (size > 1) & wide.any(2) & (level < self.depth(n_good))
        here = slice(first, 2 * first + 1)
        with np.errstate(invalid="ignore"):
            cut = np.where(inner, low + rng.random(low.shape) * (high - low), 0.0)
        self.feature[:, here], self.cut[:, here] = np.where(inner, f, -1), cut
        self.path[:, here] = np.where(inner, 0.0, level + _average_path(size))
        return bool(inner.any())

    def _down(self, x: np.ndarray, t: int) -> np.ndarray:
        """The leaf of each row in tree t."""
        feature, cut = self.feature[t], self.cut[t]
        flat, width = x.ravel(), x.shape[1]
        rows = np.arange(0, len(flat), width)
        k = np.zeros(len(x), np.int64)
        if feature[0] >= 0:
            k += 1 + (x[:, feature[0]] >= cut[0])
        while True:
            f = feature.take(k)
            inner = f >= 0
            if not inner.any():
                return k
            k = np.where(inner, 2 * k + 1 + (flat.take(rows + np.maximum(f, 0)) >= cut.take(k)), k)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that few splits isolate."""
        x = np.ascontiguousarray(x)
        total = np.zeros(len(x))
        for t, path in enumerate(self.path):
            total += path[self._down(x, t)]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def calibrate(scores: np.ndarray, good: np.ndarray, n: np.ndarray | None = None) -> float:
    """The limit with the best share of bad rows above it less LOSS times the share of good ones; 1 where either is missing. n: how many rows each score stands for, one by default."""
    if good.all() or not good.any():
        return 1.0
    n = np.ones(len(scores), np.int64) if n is None else n
    order = np.argsort(-scores, kind="stable")
    bad_above, good_above = np.cumsum((n * ~good)[order]) / n[~good].sum(), np.cumsum((n * good)[order]) / n[good].sum()
    value = bad_above - LOSS * good_above
    ends = np.append(scores[order][1:] != scores[order][:-1], True)  # rows of one score fall on one side
    best = int(np.argmax(np.where(ends, value, -np.inf)))
    if value[best] <= 0:
        return 1.0
    after = scores[order][best + 1] if best + 1 < len(scores) else 0.0
    return float((scores[order][best] + after) / 2)


_EXTENT_DDL = "tree int, nodes binary, size binary, low binary, high binary"


def _extent_of(rows: DataFrame, forest: IsolationForest, level: int) -> Extent:
    """The extent of a level's nodes over all rows (rates, good): each task's by tree, merged by tree."""
    shared, width = rows.sparkSession.sparkContext.broadcast(forest), len(RATES)

    def given(extent: Extent) -> Iterator[pa.RecordBatch]:
        for t in range(TREES):
            nodes = np.flatnonzero(extent.low[t, :, 0] <= extent.high[t, :, 0])
            if len(nodes):
                held = nodes.astype(np.int64), extent.size[t, nodes], extent.low[t, nodes], extent.high[t, nodes]
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in held)], ["tree", "nodes", "size", "low", "high"])

    def measured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extent, kept, n = Extent(level, width), [], 0

        def add():
            x, good = (np.concatenate(a) for a in zip(*kept))
            shared.value.measure(x, good, level, extent)
            kept.clear()

        for part in parts:
            kept.append((part.column(0).flatten().to_numpy().reshape(-1, width), part.column(1).to_numpy(zero_copy_only=False)))
            n += part.num_rows
            if n >= _ROWS:
                add()
                n = 0
        if n:
            add()
        yield from given(extent)

    def merge(extent: Extent, rows) -> None:
        for t, nodes, size, low, high in rows:
            extent.merge(t, np.frombuffer(nodes, np.int64), np.frombuffer(size, np.int64), *(np.frombuffer(a, np.float32).reshape(-1, width) for a in (low, high)))

    def merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extent = Extent(level, width)
        for part in parts:
            merge(extent, zip(*(c.to_pylist() for c in part.columns)))
        yield from given(extent)

    extent = Extent(level, width)
    # One row for each tree reaches the driver.
    merge(extent, rows.select("rates", "good").mapInArrow(measured, _EXTENT_DDL).repartition("tree").mapInArrow(merged, _EXTENT_DDL).collect())
    return extent


def fit_forest(counted: DataFrame, labels: DataFrame) -> IsolationForest | None:
    """A forest from all labelled rows; None without two good ones.

    Three of four rows, by the hash of their ids, grow it, the fourth ones set its limit, one of LIMITS; where those are
    all good or all bad, all rows do. Of labels of one document that disagree the best counts.
    """
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3
    rows = checkpointed(counted.select("doc_id", "rates").join(one, "doc_id").select("rates", (F.col("quality") == 1).alias("good"), held.alias("held")))
    number = {(r.good, r.held): r.n for r in rows.groupBy("good", "held").agg(F.count("*").alias("n")).collect()}  # four rows at most
    n_good = number.get((True, False), 0)
    if n_good + number.get((True, True), 0) < 2:
        return None
    grown = rows.where("NOT held") if n_good >= 2 else rows
    n_good = n_good if n_good >= 2 else n_good + number.get((True, True), 0)
    forest = IsolationForest.bare(n_good)
    for level in range(forest.depth(n_good) + 1):
        if not forest.split(level, _extent_of(grown, forest, level), n_good):
            break
    fold = rows.where("held") if number.get((True, True)) and number.get((False, True)) else rows
    shared = counted.sparkSession.sparkContext.broadcast(forest)

    # A border of these steps falls below it.
    @F.pandas_udf("long")
    def step(rates):
        return pd.Series(np.ceil(shared.value.score(np.stack(rates.to_numpy()).astype(np.float32)) * LIMITS).astype(np.int64) - 1)

    found = fold.groupBy("good", step("rates").alias("step")).agg(F.count("*").alias("n")).toPandas()  # two rows a step at most
    forest.limit = calibrate((found["step"].to_numpy() + 0.5) / LIMITS, found["good"].to_numpy().astype(bool), found["n"].to_numpy())
    return forest


def judge_quality(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, anomaly, kept.

    Null and empty texts have no words and fail. Without labelled good rows nothing but the fixed limits counts. A row
    whose anomaly equals the limit stays. Equal texts get equal verdicts, repeated rows one each; very long texts are
    counted whole; an empty table gives no rows; other columns are not read.
    """
    counted = checkpointed(quality_counts(docs, text))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # Rows that the fixed limits fail need no second verdict, so the forest doesn't learn from them.
    shared = docs.sparkSession.sparkContext.broadcast(fit_forest(counted.where(~failed), labels))

    @F.pandas_udf("double")
    def anomaly(rates):
        if shared.value is None or not len(rates):
            return rates.map(lambda _: 0.0).astype("float64")
        return pd.Series(shared.value.score(np.stack(rates.to_numpy()).astype(np.float32)))

    limit = shared.value.limit if shared.value else 1.0
    out = counted.withColumn("base_failed", failed).withColumn("anomaly", anomaly("rates"))
    return out.select("doc_id", *COUNTS, "base_failed", "anomaly", (~F.col("base_failed") & (F.col("anomaly") <= limit)).alias("kept"))

"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows, and a window occurs in a document where all its words follow each other. Seen as sets of
shingles, the window must be contained whole. Its shingles are ordered by rarity, counted over all documents; of a set
that must be contained whole the necessary prefix is one token, its rarest shingle. Documents' shingles are joined with
these alone. A pair that meets must have room for the window: enough words in the document, and enough of them before and
behind the shingle. Then the words themselves are compared over the whole window.

A bitmap of fixed size says which shingles can't be asked for, so they don't leave the task; what it lets through by
chance the join drops.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, give_back, raw_of, slices

#: Words of a window and of a shingle, and bits of the bitmap as a power of two: 4 MB, whatever the benchmark holds.
WINDOW, SHINGLE, BITS = 10, 5, 25

#: Letters A-Z become small; all other ASCII but digits and small letters ends a word.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("shingle", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("near", pa.string())])
_FOUND_DDL = "row long, doc_id long, n_words long, shingle long, at long, first long, near string"
_CUT_DDL = "item_id string, words array<string>, shingles array<long>"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the runs of width words, from those of the words."""
    s = np.full(max(0, len(hashes) - width + 1), width, np.uint64)
    for j in range(width):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(s)])
    return s


class Hasher:
    """Hashes of words; a word is hashed once, as long as no more than LIMIT words are kept."""

    LIMIT = 300_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.LIMIT:
            self.known, new = {}, set(words)
        self.known.update(zip(new, map(xxhash.xxh3_64_intdigest, new)))
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


class Words:
    """The words of some texts as one list, with the place of each text in it."""

    def __init__(self, raws: list[bytes], hashes: Hasher):
        texts = [words_of(raw) for raw in raws]
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(self.size)
        self.words = list(chain.from_iterable(texts))
        self.hashes = hashes(self.words)

    def asked(self, width: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place in the list and hash of the shingles of width words that lie in one text and that the bitmap lets through."""
        s = shingles_of(self.hashes, width)
        at = np.flatnonzero(_asked(s, known))
        text = np.searchsorted(self.end, at, side="right")
        inside = at + width <= self.end[text]
        return text[inside], at[inside], s[at[inside]]


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """window (number), item_id, words, shingles of the windows of all items; equal windows have one number.

    An item of fewer words is one window, and a window of fewer words than a shingle has one shingle, all its words.
    """

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hasher()
        for part in parts:
            for at, column in slices(part.column(1)):
                texts = [words_of(x) for x in raw_of(column)]
                names = part.column(0).slice(at, len(texts)).to_pylist()
                rows = []
                for name, words in zip(names, texts):
                    h = hashes(words)
                    width = min(window, len(words))
                    s = shingles_of(h, min(shingle, width)).view(np.int64) if width else ()
                    per = width - min(shingle, width) + 1
                    rows += [(name, [w.decode() for w in words[k : k + width]], s[k : k + per]) for k in range(len(words) - width + 1)] if width else []
                for k in range(0, len(rows), 2000):
                    some = list(zip(*rows[k : k + 2000]))
                    yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.string()), pa.array(some[1], pa.list_(pa.string())), pa.array(some[2], pa.list_(pa.int64()))], names=["item_id", "words", "shingles"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    found = rows.mapInArrow(cut, _CUT_DDL).distinct()
    return checkpointed(found.withColumn("window", F.xxhash64("words")))


def bitmap(shingles: DataFrame, bits: int = BITS) -> np.ndarray:
    """Which of 2**bits remainders the column shingle has; at most 2**(bits - 6) rows reach the driver."""
    word = shingles.selectExpr(f"shiftright(shingle & {(1 << bits) - 1}, 6) AS word", "shiftleft(1L, CAST(shingle & 63 AS int)) AS bit")
    out = np.zeros(1 << (bits - 6), np.int64)
    rows = word.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out[rows["word"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64)
    return out.view(np.uint64)


def _asked(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    slot = s & np.uint64((len(known) << 6) - 1)
    return (known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def shingle_counts(docs: DataFrame, known, widths: list[int]) -> DataFrame:
    """shingle, n: how often each shingle of docs that the bitmap lets through occurs in all of them."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hasher()
        for part in parts:
            for _, column in slices(part.column(0)):
                words = Words(raw_of(column), hashes)
                s, n = np.unique(np.concatenate([words.asked(width, known.value)[2] for width in widths]), return_counts=True)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n)], names=["shingle", "n"])
        give_back()

    return docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, known, widths: list[int], window: int) -> DataFrame:
    """A row of every document (row, doc_id, n_words), and one of each of its shingles that the bitmap lets through.

    at is the shingle's place, near the words around it as far as any window with it can reach, from word first on.
    """

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = Hasher(), TaskContext.get().partitionId() << 40
        for part in parts:
            for start, column in slices(part.column(1)):
                texts = Words(raw_of(column), hashes)
                doc_ids, size, end = part.column(0).slice(start, len(column)).to_pylist(), texts.size.tolist(), texts.end.tolist()
                rows = [(number + k, doc_id, n, None, None, None, None) for k, (doc_id, n) in enumerate(zip(doc_ids, size))]
                for width in widths:
                    for k, at, s in zip(*(x.tolist() for x in texts.asked(width, known.value))):
                        begin = end[k] - size[k]
                        first = max(begin, at + width - window)
                        near = b" ".join(texts.words[first : min(end[k], at + window)]).decode()
                        rows.append((number + k, doc_ids[k], size[k], s - (s >> 63 << 64), at - begin, first - begin, near))
                        if len(rows) >= 4000:
                            yield _record(rows)
                            rows = []
                number += len(column)
                if rows:
                    yield _record(rows)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(look, _FOUND_DDL)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND)


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents (row, doc_id, n_words), all occurrences of windows (row, start, size, window), and window with item_id.

    docs (doc_id, text) and items (item_id, text) have no other columns.
    """
    spark = docs.sparkSession
    cut = item_windows(items, window, shingle)
    widths = sorted(r.w for r in cut.select(F.least(F.size("words"), F.lit(shingle)).alias("w")).distinct().collect())
    distinct = cut.groupBy("window", "words").agg(F.first("shingles").alias("shingles"))
    every = distinct.select("window", "words", F.posexplode("shingles").alias("offset", "shingle"))
    counts = checkpointed(shingle_counts(docs, spark.sparkContext.broadcast(bitmap(every)), widths)) if widths else None
    rarity = every if counts is None else every.join(counts, "shingle", "left")
    n = F.lit(0) if counts is None else F.coalesce("n", F.lit(0))
    rarest = F.min_by(F.struct("shingle", "offset"), F.struct(n, "shingle", "offset"))
    # A window none of whose shingles occurs, or whose rarest one doesn't, is nowhere.
    prefix = rarity.groupBy("window", "words").agg(rarest.alias("p"), F.min(n).alias("n")).where("n > 0").select("window", "words", "p.*")
    prefix = checkpointed(prefix)
    found = checkpointed(candidates(docs, spark.sparkContext.broadcast(bitmap(prefix)), widths, window))
    size, start = F.size("words"), F.col("at") - F.col("offset")
    met = found.where("shingle IS NOT NULL").join(prefix, "shingle")
    met = met.where((F.col("n_words") >= size) & (start >= F.col("first")) & (start + size <= F.col("n_words")))
    here = F.slice(F.split("near", " ", -1), (start - F.col("first") + 1).cast("int"), size)
    same = F.array_join(here, " ") == F.array_join("words", " ")
    hits = met.where(same).select("row", start.alias("start"), size.alias("size"), "window", "words")
    return found.where("shingle IS NULL").select("row", "doc_id", "n_words"), hits, cut.select("window", "words", "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items (sorted item_ids), contaminated.

    Words are runs of digits, of letters a-z after A-Z are made small, and of characters beyond ASCII. A window is
    `window` consecutive words of an item; a shorter item, unless it has none, is one window. A word of a document is hit
    if it lies in an occurrence of a window. Null, empty and blank texts have no words and neither hit nor are hit; very
    long ones are read whole. Equal windows of several items count for each; items of one item_id are one item; a null
    item_id is the empty text. Repeated documents and rows without a doc_id are judged each. Empty tables give no rows,
    an empty benchmark hits nothing. Extra columns are not read.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    every, hits, named = occurrences(docs, items.select("item_id", "text"), window, shingle)
    hits = checkpointed(hits)
    end = F.col("start") + F.col("size")
    before = F.max(end).over(Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    covered = hits.select("row", "start", "size").distinct().select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    shown = hits.select("row", "window", "words").distinct().join(named, ["window", "words"]).groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = every.join(covered, "row", "left").join(shown, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (n_hit > 0).alias("contaminated"))

"""Repeated passages by prefix doubling.

The full method sorts every byte position by the rank of its prefix, then by pairs of ranks at growing offsets, and drops
positions whose prefix is unique. Here the first ranks, of 50 bytes, are taken at anchors alone: the anchor of a window
of 200 bytes is the least 50-byte prefix in it. Equal windows have equal anchors at equal places, so a window whose
anchor's prefix is unique is unique. Positions that survive are sorted again by longer prefixes: all windows of an
anchor together, then in groups of 16, then one by one. A group is repeated where all that it covers occurs elsewhere,
unique where what its windows share doesn't, and divided otherwise. Each level is one sort by Spark of rank pairs, and
rows next to each other tell which ranks are shared; what is unique or settled takes no part in the next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, raw_of

#: Bytes of a passage; bytes of an anchor's prefix.
LENGTH, PREFIX = 200, 50
#: Windows of a group at the second level.
GROUP = 16
_POSITION_BITS = 28

_rng = np.random.default_rng(17)
_LETTERS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), np.uint64(base))
        held[0] = 1
        held = _powers[base] = np.multiply.accumulate(held)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Fingerprints:
    """64-bit fingerprints of any substrings of one text: differences of prefix sums."""

    def __init__(self, raw: bytes):
        c = _LETTERS[np.frombuffer(raw, np.uint8)]
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(c * powers(_BASE, len(raw)), out=self.sums[1:])
        self.back = powers(_BACK, len(raw) + 1)

    def all(self, length: int) -> np.ndarray:
        """Of every substring of that length."""
        return mix((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours: prefix minima of blocks of w against suffix minima."""
    n = len(x)
    whole = -(-n // w) * w
    padded = np.full(whole, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(raw: bytes) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, number of windows, the anchor's distance from the first, fingerprint of the anchor's prefix, and of all that the windows cover."""
    prints = Fingerprints(raw)
    prefix = prints.all(PREFIX)
    rank = (prefix >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | np.arange(len(prefix), dtype=np.uint64)
    anchor = (sliding_min(rank, LENGTH - PREFIX + 1) & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.append(first, len(anchor)))
    at = anchor[first]
    return first, n, at - first, prefix[at], prints.of(first, first + n - 1 + LENGTH)


def groups(prints: Fingerprints, first: np.ndarray, n: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows of the runs in groups of GROUP by their distance from the anchor: first window, number, fingerprint of what the whole group shares, and of what it covers.

    Groups are aligned by the anchor, so equal windows are in groups with equal shared bytes. A group that its text cuts
    off covers nothing that could be found elsewhere; it gets a fingerprint of its own.
    """
    low, high = (ahead - n + 1) // GROUP, ahead // GROUP
    k = high - low + 1
    run = np.repeat(np.arange(len(first)), k)
    block = low[run] + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    anchor = (first + ahead)[run]
    # Distances of the group are block * GROUP .. block * GROUP + GROUP - 1; those of the run are ahead - n + 1 .. ahead.
    near, far = np.maximum(block * GROUP, (ahead - n + 1)[run]), np.minimum(block * GROUP + GROUP - 1, ahead[run])
    core_start, core_end = anchor - block * GROUP, anchor - (block * GROUP + GROUP - 1) + LENGTH
    all_start, all_end = anchor - (block * GROUP + GROUP - 1), anchor - block * GROUP + LENGTH
    size = len(prints.sums) - 1
    inside = (all_start >= 0) & (all_end <= size)
    cover = prints.of(np.maximum(all_start, 0), np.minimum(all_end, size))
    own = mix(prints.sums[-1] + (anchor - far).astype(np.uint64) * np.uint64(_BASE))
    # With the distance in it: groups of two anchors can be the same bytes of one text.
    core = mix(prints.of(core_start, core_end) + block.astype(np.uint64))
    return anchor - far, far - near + 1, core, np.where(inside, cover, own)


def place(first: np.ndarray, n: np.ndarray, ahead: np.ndarray | int = 0) -> np.ndarray:
    """First window, number of windows and the anchor's distance in one number."""
    return first << 16 | n << 8 | ahead


def placed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 16, at >> 8 & 255, at & 255


_RANKED_DDL = "doc long, place long, rank long, next long, known int, salt long"
_SEEN_DDL = "doc long, place long, rank long, kind int"


def _ranked(doc: np.ndarray, at: np.ndarray, rank: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    """Rows of a level. known: 0, or 1 and 2 for the first row and the others of a pair that is here more than once; others carry a salt, as no sort need find them."""
    pair = mix(rank * np.uint64(_BASE) + second)
    _, first, group, number = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
    known = np.where(number[group] > 1, 2, 0).astype(np.int32)
    known[first[number > 1]] = 1
    salt = np.where(known == 2, mix(doc.view(np.uint64) + at.view(np.uint64)).view(np.int64) | 1, 0)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(rank.view(np.int64)), pa.array(second.view(np.int64)), pa.array(known), pa.array(salt)], ["doc", "place", "rank", "next", "known", "salt"])


def _each(expand):
    """A function over batches of (doc, text, ...) from one that gives the places and ranks of one text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found: list = []
            size = 0
            for row in zip(part.column(0).to_pylist(), raw_of(part.column(1)), *(c.to_pylist() for c in part.columns[2:])):
                got = expand(*row[1:])
                if got is not None and len(got[0]):
                    found.append((np.full(len(got[0]), row[0], np.int64), *got))
                    size += len(got[0])
                if size > 100_000:
                    yield _ranked(*map(np.concatenate, zip(*found)))
                    found, size = [], 0
            if found:
                yield _ranked(*map(np.concatenate, zip(*found)))

    return run


def _first(raw: bytes):
    if len(raw) < LENGTH:
        return None
    if len(raw) >> _POSITION_BITS:
        raise ValueError(f"a text of {len(raw)} bytes: positions have {_POSITION_BITS} bits")
    first, n, ahead, rank, cover = anchors(raw)
    return place(first, n, ahead), rank, cover


def _second(packed: bytes, places: list[int]):
    first, n, core, cover = groups(Fingerprints(zstandard.decompress(packed)), *placed(np.array(places, np.int64)))
    return place(first, n), core, cover


def _third(packed: bytes, places: list[int]):
    first, n, _ = placed(np.array(places, np.int64))
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    prints = Fingerprints(zstandard.decompress(packed))
    return place(at, np.ones_like(at)), prints.of(at, at + LENGTH // 2), prints.of(at + LENGTH // 2, at + LENGTH)


def _neighbours(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rank, next), with kind. 0: no other row has the pair; 1: the first of a shared pair; 2: another of it."""
    held: list[np.ndarray] | None = None  # the row before the batch and the last row, not yet given out
    for part in parts:
        if not part.num_rows:
            continue
        new = [c.to_numpy() for c in part.columns]
        rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        yield from _told(rows, 0 if held is None or len(held[0]) < 2 else 1, len(rows[0]) - 1)
        held = [x[-2:] for x in rows]
    if held is not None:
        yield from _told(held, len(held[0]) - 1, len(held[0]))


def _told(rows: list[np.ndarray], start: int, stop: int) -> Iterator[pa.RecordBatch]:
    doc, at, rank, second, known = rows
    same = np.concatenate([[False], (rank[1:] == rank[:-1]) & (second[1:] == second[:-1]), [False]])
    kind = np.where((known == 2) | same[:-1], 2, np.where((known == 1) | same[1:], 1, 0)).astype(np.int32)
    if stop > start:
        yield pa.RecordBatch.from_arrays([pa.array(x[start:stop]) for x in (doc, at, rank, kind)], ["doc", "place", "rank", "kind"])


def _sorted(ranked: DataFrame) -> DataFrame:
    """One level: Spark sorts the rank pairs, and rows with a rank of their own go.

    Rows are dealt out by the pair, so a rank with many continuations (a very common string) is spread over all tasks;
    which ranks are shared is then counted from one row for each pair. Of a very common pair every batch sends one row
    to its place and deals out the others by their salt, since these are known to be shared.
    """
    dealt = ranked.repartition("rank", "next", "salt").sortWithinPartitions("rank", "next", "known")
    paired = checkpointed(dealt.select("doc", "place", "rank", "next", "known").mapInArrow(_neighbours, _SEEN_DDL))
    shared = paired.where("kind < 2").groupBy("rank").agg(F.count("*").alias("pairs")).where("pairs > 1").select("rank")
    singles = checkpointed(paired.where("kind = 0").join(shared, "rank", "left_semi").select("doc", "place", "rank", "kind"))
    return paired.where("kind > 0").union(singles)


def _undecided(seen: DataFrame) -> DataFrame:
    """Per document the places to divide further: those whose pair nobody shares, and one of each shared pair that they may match in part."""
    open_ranks = seen.where("kind = 0").select("rank").distinct()
    partners = seen.where("kind = 1").join(open_ranks, "rank", "left_semi")
    return seen.where("kind = 0").unionByName(partners).groupBy("doc").agg(F.collect_list("place").alias("places"))


_CUT_DDL = "doc long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary, kept_sha256 string"


def cut(raw: bytes, places: list[int]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs of covered bytes, and the bytes that are left."""
    first, n, _ = placed(np.array(places, np.int64))
    change = np.zeros(len(raw) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + n - 1 + LENGTH, -1)
    covered = np.cumsum(change)[:-1] > 0
    edges = np.flatnonzero(np.diff(covered, prepend=False, append=False))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist())), np.frombuffer(raw, np.uint8)[~covered].tobytes()


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = []
        for doc, packed, places in zip(*(c.to_pylist() for c in part.columns)):
            spans, kept = cut(zstandard.decompress(packed), places)
            rows.append((doc, sum(b - a for a, b in spans), len(spans), [{"start": a, "end": b} for a, b in spans], kept, hashlib.sha256(kept).hexdigest()))
        if rows:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["doc", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for part in parts:
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack(raw) for raw in raw_of(part.column(1))], pa.binary())], ["doc", "packed"])


def repeated_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document with a removed byte: doc (hash of doc_id and text), n_removed, n_spans, spans, kept, kept_sha256.

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same text or another one.
    Null and empty texts and those shorter than LENGTH lose nothing. Rows with equal doc_id and text share a hash and
    lose everything if they are long enough, as each repeats the other. Equality is that of two 64-bit fingerprints, of
    overlapping parts at the first two levels. A text of 2**28 bytes or more is an error. An empty table gives no rows; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.xxhash64("doc_id", text).alias("doc"), F.col(text).alias("text"))
    first = _sorted(texts.mapInArrow(_each(_first), _RANKED_DDL))
    some = texts.join(first.select("doc").distinct(), "doc").dropDuplicates(["doc"])
    packed = checkpointed(some.select("doc", "text").mapInArrow(_packed, "doc long, packed binary"))
    second = _sorted(packed.join(_undecided(first), "doc").select("doc", "packed", "places").mapInArrow(_each(_second), _RANKED_DDL))
    third = _sorted(packed.join(_undecided(second), "doc").select("doc", "packed", "places").mapInArrow(_each(_third), _RANKED_DDL))
    gone = first.union(second).union(third).where("kind > 0").groupBy("doc").agg(F.collect_list("place").alias("places"))
    return packed.join(gone, "doc").select("doc", "packed", "places").mapInArrow(_cut, _CUT_DDL)


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = repeated_passages(docs, text).select("doc", "n_removed", "n_spans", "kept_sha256")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("doc"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha256"))
    none = F.lit(0).cast("long")
    return rows.join(found, "doc", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))

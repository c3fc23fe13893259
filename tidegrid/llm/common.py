"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get Arrow batches of at most 2000 rows and about 8 MB, so that very long texts can't fill them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that the driver and all executors see: below spark.checkpoint.dir, or of its own where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/{name}"


def checkpointed(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df, computed once into a table in the shared folder.

    A table is read back with its real size and without the constraints that a plan of many rounds gathers.
    """
    path = shared_folder(df.sparkSession, f"tidegrid-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns never clash with what an operator adds."""
    return docs.select(*columns)


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(n))


def texts_of(column: pa.Array) -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in column.to_pylist()]


#: Bytes of text that a worker turns into words at a time.
SLICE = 2 << 20


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """The column in pieces of about size bytes, one text at least, each with its first position: what a worker holds as Python objects is bounded by a piece."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, column.slice(at, to - at)
        at = to


def raw_of(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 of every i, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def joined(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the sequences, and all of them as one."""
    return np.fromiter(map(len, found), np.int64, len(found)), np.array([x for y in found for x in y], np.int32) if found else np.zeros(0, np.int32)


class PieceCoder:
    """Ids of texts whose pieces encode independently: every distinct piece is encoded once and then looked up.

    encode gets a list of distinct new pieces and returns the number of ids of each and all ids. Between lookups at most
    limit pieces of together weight characters are kept; beyond that those that were used most stay, half as many.
    """

    def __init__(self, split: Callable[[str], list[str]] | None, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 300_000, weight: int = 16 << 20):
        self.split, self.encode, self.limit, self.weight = split, encode, limit, weight
        self.index: dict[str, int] = {}
        self.held = 0
        self.start, self.length, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def shrink(self) -> None:
        names = list(self.index)
        order = np.argsort(-self.used, kind="stable")
        size = np.fromiter(map(len, names), np.int64, len(names))
        fits = np.cumsum(size[order]) <= self.weight // 2
        kept = np.sort(order[fits][: self.limit // 2])
        self.index = dict(zip(map(names.__getitem__, kept.tolist()), range(len(kept))))
        self.held = int(size[kept].sum())
        self.ids = self.ids[spread(self.start[kept], self.length[kept])]
        self.length, self.used = self.length[kept], self.used[kept] // 2
        self.start = np.cumsum(self.length) - self.length

    def lookup(self, words: list[str], times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and the ids of all. times: for distinct pieces how often each is used."""
        if len(self.index) > self.limit or self.held > self.weight:
            self.shrink()
        at = np.array(list(map(self.index.get, words, repeat(-1))), np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            wanted = list(map(words.__getitem__, missing.tolist()))
            new = list(dict.fromkeys(wanted))
            n, ids = self.encode(new)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            self.length = np.concatenate([self.length, n])
            self.ids = np.concatenate([self.ids, ids])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.held += sum(map(len, new))
            at[missing] = list(map(self.index.__getitem__, wanted))
        if times is None:
            self.used += np.bincount(at, minlength=len(self.used))
        else:
            self.used[at] += times
        lengths = self.length[at]
        return lengths, self.ids[spread(self.start[at], lengths)]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all texts."""
        per, words = [], []
        for text in texts:
            pieces = self.split(text)
            per.append(len(pieces))
            words += pieces
        lengths, ids = self.lookup(words)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.concatenate([[0], np.cumsum(per)])
        return ends[edges[1:]] - ends[edges[:-1]], ids


def give_back() -> None:
    """Returns memory that a task no longer uses to the system: its Python worker lives on, and other stages' workers beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def batches(rows: Iterator, schema: pa.Schema, size: int = 4000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    kept = []
    for row in rows:
        kept.append(row)
        if len(kept) >= size:
            yield record(kept, schema)
            kept = []
    if kept:
        yield record(kept, schema)


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

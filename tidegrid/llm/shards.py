"""Training order: every packed sequence gets a global slot, and shards of fixed stride hold the slots in order.

A keyed Feistel network permutes the numbers of the sequences; results beyond the last number walk on along their cycle.
A shard holds the slots of one range, so a reader finds slot s at byte s % per_shard * stride of shard s // per_shard.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, checkpointed
from .packing import CAPACITY, END, LOSS, POOL, SEGMENTS, document_texts, own_packer, piece_rows

#: Rounds of the network, and sequences of a shard.
ROUNDS, PER_SHARD = 6, 2048


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 .. n - 1 applied to x."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & mask
        for k in range(ROUNDS):
            f = (b + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        out[todo] = a << np.uint64(half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slot_column(index: str | Column, n: int, key: int) -> Column:
    """The slot of each number of 0 .. n - 1; numbers are not null and not repeated, so slots aren't either."""

    @F.pandas_udf("long")
    def slots(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), n, key))

    return slots(index)


_SEQUENCES = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ids", pa.binary())])
_SEQUENCES_DDL = "sequence_id long, n_tokens long, doc_ids array<long>, ids binary"


def whole_sequences(pieces: Iterator[tuple], capacity: int, pad: int) -> Iterator[tuple]:
    """sequence_id, n_tokens, doc_ids, ids (little-endian unsigned 16-bit, padded to capacity) from pieces in the order of packing."""
    for sequence, some in groupby(pieces, key=itemgetter(4)):
        some = list(some)
        ids = np.concatenate([np.frombuffer(x[8], "<u4") for x in some])
        if len(ids) and ids.max() > 0xFFFF:
            raise ValueError("ids don't fit 16 bits")
        whole = np.full(capacity, pad, "<u2")
        whole[: len(ids)] = ids
        yield sequence, len(ids), [x[0] for x in some], whole.tobytes()


def sequences(pieces: DataFrame, capacity: int, pad: int) -> DataFrame:
    """The pieces that pack_documents gives as whole sequences: sequence_id, n_tokens, doc_ids, ids (padded to capacity)."""

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc_id, None, None, None, sequence, None, None, None, ids) for part in parts for sequence, doc_id, ids in zip(*(c.to_pylist() for c in part.columns)))
        yield from batches(whole_sequences(rows, capacity, pad), _SEQUENCES, 500)

    return pieces.select("sequence_id", "doc_id", "ids").mapInArrow(join, _SEQUENCES_DDL)


def packed_sequences(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL, end_id: int = END) -> DataFrame:
    """Documents packed as by pack_documents, one row for each sequence: sequence_id, n_tokens, doc_ids, ids (padded with end_id).

    Packing and joining are one step, so a task has one Python worker. Null and empty texts are end_id alone; long
    texts lie in several sequences; repeated rows are packed each; an empty table gives no rows; other columns are not read.
    """

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_rows(parts, tokenizer, own_packer(capacity, segments, loss, pool, True), end_id)
        yield from batches(whole_sequences(pieces, capacity, end_id), _SEQUENCES, 500)

    return document_texts(docs, text).mapInArrow(pack, _SEQUENCES_DDL)


_MANIFEST = "manifest.json"


def _name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(rows: DataFrame, folder: str, key: int = 1, per_shard: int = PER_SHARD) -> DataFrame:
    """Writes sequence_id, n_tokens, doc_ids, ids to shards in folder; returns slot, shard, position, sequence_id, n_tokens, doc_ids, crc32.

    The high bits of sequence_id are its partition and the low 33 bits count within it, as packing gives them. Each
    attempt of a task writes a shard under a name of its own and then moves it to its place, so a task that runs again
    replaces it whole. The manifest (count of sequences, their bytes, sequences of a shard, key) comes last: without it a
    folder is not complete. A folder is for one run. Ties can't occur: slots are a permutation. No sequences give no
    shards; a repeated sequence_id is an error of the input.
    """
    from pyarrow import fs

    spark = rows.sparkSession
    rows = checkpointed(rows.select("sequence_id", "n_tokens", "doc_ids", "ids"), compression="zstd")
    part = F.shiftrightunsigned("sequence_id", 33)
    numbers = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.max(F.octet_length("ids")).alias("stride"))
    counts = sorted((r.part, r.n, r.stride) for r in numbers.collect())  # one row for each partition
    starts = np.cumsum([0, *(n for _, n, _ in counts)]).tolist()
    n, stride = starts[-1], max((s for *_, s in counts), default=0)
    first = spark.createDataFrame([(p, s) for (p, *_), s in zip(counts, starts)], "part long, first long")
    index = F.col("first") + F.col("sequence_id").bitwiseAND((1 << 33) - 1)
    # One row of two numbers for each partition: by broadcast, so that the sequences are shuffled once, to their shards.
    slotted = rows.withColumn("part", part).join(F.broadcast(first), "part").withColumn("slot", slot_column(index, n, key))
    placed = slotted.select("slot", F.floor(F.col("slot") / per_shard).cast("int").alias("shard"), "sequence_id", "n_tokens", "doc_ids", "ids")
    shards = max(1, -(-n // per_shard))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out = shard = None

        def close():
            out.close()
            system.move(f"{path}/.{attempt}-{_name(shard)}", f"{path}/{_name(shard)}")

        for batch in parts:
            sums = []
            for to, raw in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist()):
                if to != shard:
                    if out:
                        close()
                    shard = to
                    out = system.open_output_stream(f"{path}/.{attempt}-{_name(shard)}")
                out.write(raw)
                sums.append(zlib.crc32(raw))
            position = pa.array([s % per_shard for s in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), position, *batch.columns[2:5], pa.array(sums, pa.int64())], ["slot", "shard", "position", "sequence_id", "n_tokens", "doc_ids", "crc32"])
        if out:
            close()

    ordered = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    written = checkpointed(ordered.mapInArrow(write, "slot long, shard int, position long, sequence_id long, n_tokens long, doc_ids array<long>, crc32 long"))
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{_MANIFEST}") as f:
        f.write(json.dumps({"count": n, "stride": stride, "per_shard": per_shard, "key": key}).encode())
    return written


def read_from(folder: str, slot: int, stride: int | None = None, per_shard: int | None = None) -> Iterator[np.ndarray]:
    """The ids of slot and all that follow it, one sequential read of each shard: what a resumed training run does.

    A stride or number of sequences of a shard that isn't the manifest's is an error.
    """
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{_MANIFEST}") as f:
        said = json.loads(f.read())
    if stride not in (None, said["stride"]) or per_shard not in (None, said["per_shard"]):
        raise ValueError(f"the shards of {folder} hold {said}")
    while slot < said["count"]:
        shard, at = divmod(slot, said["per_shard"])
        with system.open_input_file(f"{path}/{_name(shard)}") as f:
            f.seek(at * said["stride"])
            for _ in range(min(said["per_shard"] - at, said["count"] - slot)):
                raw = f.read(said["stride"])
                if len(raw) < said["stride"]:
                    raise EOFError(f"{_name(shard)} is too short")
                yield np.frombuffer(raw, "<u2")
                slot += 1

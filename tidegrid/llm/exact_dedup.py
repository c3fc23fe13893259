"""Exact dedup by a tree merge of sorted digest runs.

Each partition of the documents is a leaf. Its documents become one sorted run of (digest, best identifier, copies).
In every round, FAN neighbouring runs meet: Spark's sort merges them, and one pass over the merged rows keeps the best
identifier of every digest. After log_FAN(leaves) rounds each digest range has one run. The winners then go back down:
first to the leaves, where a digest has one row however many copies it has, then to the documents of the leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, batches, bounded_batches, checkpointed, only, raw_of

#: Runs that meet in a round, and digests that a range holds on average.
FAN, PER_RANGE = 8, 100_000

_LEAF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.int32()), ("digest", pa.binary()), ("proof", pa.binary()), ("points", pa.int64())])
_RUN = pa.schema([("span", pa.int32()), ("run", pa.int32()), ("digest", pa.binary()), ("proof", pa.binary()), ("points", pa.int64()), ("keep_id", pa.int64()), ("copies", pa.int64())])
_LEAF_DDL = "doc_id long, leaf int, digest binary, proof binary, points long"
_RUN_DDL = "span int, run int, digest binary, proof binary, points long, keep_id long, copies long"


def _ordered(runs: DataFrame) -> DataFrame:
    return runs.sortWithinPartitions("span", "run", "digest", "proof", F.desc("points"), F.asc_nulls_last("keep_id"))


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leaf = TaskContext.get().partitionId()
    for part in parts:
        rows = []
        for doc_id, raw in zip(part.column(0).to_pylist(), raw_of(part.column(1))):
            bare = raw.translate(None, SPACES)
            proof = hashlib.blake2b(bare, digest_size=12).digest() + len(bare).to_bytes(8, "big")
            rows.append((doc_id, leaf, hashlib.sha256(bare).digest(), proof, len(raw.decode("utf-8", "replace")) if not raw.isascii() else len(raw)))
        yield from batches(iter(rows), _LEAF)


def _merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by run and digest, best identifier first, become one row for each digest of a run."""

    def merged():
        key = best = None
        copies = 0
        for part in parts:
            for span, run, digest, proof, points, keep_id, n in zip(*(c.to_pylist() for c in part.columns)):
                if (span, run, digest, proof) == key:
                    copies += n
                    continue
                if key:
                    yield *key, *best, copies
                key, best, copies = (span, run, digest, proof), (points, keep_id), n
        if key:
            yield *key, *best, copies

    yield from batches(merged(), _RUN)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (binary digest as hex).

    Texts are equal when identical without spaces; null counts as empty, so all empty and null texts form one group.
    Equality is verified by a second digest and the length, kept beside the first at every level. Of equal texts the one
    with the most code points, then the smallest doc_id stays (null ids last). An empty table gives no rows; repeated
    rows count each; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = checkpointed(only(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text").mapInArrow(_digests, _LEAF_DDL))
    total, leaves = rows.agg(F.count("*"), F.coalesce(F.max("leaf"), F.lit(0))).first()
    ranges = max(1, total // PER_RANGE)
    # Two leading bytes of the digest deal out the ranges evenly.
    span = F.floor(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int") * ranges / 65536).cast("int")
    runs = rows.select(span.alias("span"), F.col("leaf").alias("run"), "digest", "proof", "points", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    runs = bottom = checkpointed(_ordered(runs).mapInArrow(_merge, _RUN_DDL))
    while leaves > 0:
        leaves //= FAN
        met = runs.withColumn("run", F.floor(F.col("run") / FAN).cast("int"))
        runs = _ordered(met.repartition("span", "run")).mapInArrow(_merge, _RUN_DDL)
    winners = runs.select("digest", "proof", F.col("keep_id"), F.col("copies").alias("group_size"))
    down = bottom.select(F.col("run").alias("leaf"), "digest", "proof").join(winners, ["digest", "proof"])
    out = rows.join(down, ["leaf", "digest", "proof"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

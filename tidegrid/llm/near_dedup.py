"""Near duplicates by min-max hashing.

Each permutation gives two values of a signature, the least and the greatest hash of the shingle set, so a signature of
2 p values costs p hashes of every shingle. Bands of eight values put documents into buckets. Documents with one set are
one node from the start. Every bucket has a pivot, its node with most company in all its buckets, and each node is tested
against the pivots of its buckets, on full sets: a group of copies holds together by that alone.

What is left are pairs of nodes of one bucket that no chain of links joins. They are found without meeting in pairs. The
nodes that share a pivot form a cluster; its centre is the set of shingles that more than half of them hold, and a node
is written as its difference from the centre, shingles it lacks and shingles it adds. For two nodes x, y with differences
X, Y the sets share |centre| - lacks(x) - lacks(y) + |X and Y| shingles, so the similarity asked for is a number c(x, y) of
differences that both must have. It is additive in x and y. Nodes that need none with the node of least weight are linked
to it (near); for all others (far) two nodes can only be linked if they share one of their |X| - c + 1 rarest
differences, c being the least that any partner asks for. These few are joined, and each pair that meets is tested.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, bounded_batches, checkpointed, give_back, only, raw_of, slices
from .graph import connected_components, relabelled

#: Values of a band (four permutations), and the chance that two documents at the threshold share no band.
BAND, MISS = 8, 1e-5

_SIGNATURES = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(raws: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text, A-Z lower-cased; all words as one if there are fewer."""
    texts = [raw.lower().split() for raw in raws]
    known = {w: xxhash.xxh3_64_intdigest(w) for words in texts for w in words}
    out = []
    for words in texts:
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(k, len(h))
        if not width:
            out.append(h)
            continue
        s = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(s)])
        out.append(np.unique(s))
    return out


class MinMax:
    """Permutations of 32 bits: odd multiples of the upper half of a shingle's hash."""

    def __init__(self, similarity: float, seed: int = 11):
        self.bands = math.ceil(math.log(MISS) / math.log1p(-(similarity**BAND)))
        n = self.bands * BAND // 2
        self.times = np.random.default_rng(seed).integers(0, 1 << 31, (n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def extremes(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest value of each set, which isn't empty, under each permutation."""
        n = len(self.times)
        low, high = np.full((len(sets), n), np.iinfo(np.uint32).max, np.uint32), np.zeros((len(sets), n), np.uint32)
        for k, s in enumerate(sets):
            x = (s >> np.uint64(32)).astype(np.uint32)
            for at in range(0, len(x), 1024):
                y = x[at : at + 1024] * self.times
                np.minimum(low[k], y.min(1), out=low[k])
                np.maximum(high[k], y.max(1), out=high[k])
        return low, high

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """One key for each set and band."""
        low, high = self.extremes(sets)
        values = np.stack([low, high], axis=2).reshape(len(sets), self.bands, BAND).astype(np.uint64)
        key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), (len(sets), self.bands))
        for j in range(BAND):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, j])
        return key.view(np.int64)


def signatures(docs: DataFrame, words: int, similarity: float, text: str = "text") -> DataFrame:
    """doc_id, key (hash of doc_id and text), n_shingles, digest of the whole set, and the band keys."""

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        min_max = MinMax(similarity)
        for part in parts:
            for at, column in slices(part.column(2)):
                sets = shingle_sets(raw_of(column), words)
                bands = iter(min_max([s for s in sets if len(s)]))
                ids, keys = (part.column(c).slice(at, len(sets)).to_pylist() for c in (0, 1))
                yield from batches(((d, k, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(bands) if len(s) else None) for d, k, s in zip(ids, keys, sets)), _SIGNATURES)
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, key long, n_shingles long, digest binary, bands array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, column in slices(part.column(1)):
                nodes = part.column(0).slice(at, len(column)).to_pylist()
                yield from batches(((d, s.view(np.int64)) for d, s in zip(nodes, shingle_sets(raw_of(column), words))), _SETS, 500)
        give_back()

    return texts.select("node", "text").mapInArrow(make, "node long, shingles array<long>")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (node, pivot) with both sets. Wide rows meet at a popular pivot, so that AQE sees the skew and splits it."""
    whole = pairs.join(sets.select("node", F.col("shingles").alias("own")), "node")
    return whole.join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("other")), "pivot")


def _labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    return df.join(labels.select(F.col("node").alias(node), F.col("component").alias(name)), node)


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after links (a, b) between components."""
    links = checkpointed(links.select("a", "b").distinct())
    return labels if links.isEmpty() else checkpointed(relabelled(labels, connected_components(links)))


def _tested(pairs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """labels after the pairs (node, pivot) of different components have been compared on their full sets."""
    apart = _labelled(_labelled(pairs.select("node", "pivot"), labels, "node", "a"), labels, "pivot", "b").where("a <> b")
    common = F.size(F.array_intersect("own", "other"))
    return _merged(labels, _with_sets(apart, sets).where(100 * common >= percent * (F.size("own") + F.size("other") - common)))


def _by_differences(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """labels after all pairs of nodes of a cluster; members (node, pivot) are the nodes that share a bucket with a pivot."""
    ends = _labelled(members, labels, "node", "label").groupBy("pivot").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    unsettled = checkpointed(ends.where("low < high").select("pivot"))
    if unsettled.isEmpty():
        return labels
    every = members.join(unsettled, "pivot", "left_semi").union(unsettled.select(F.col("pivot").alias("node"), "pivot"))
    lacks, adds = F.array_except("other", "own"), F.array_except("own", "other")
    written = checkpointed(_with_sets(every, sets).select("pivot", "node", F.size("own").alias("n"), F.size("other").alias("n_pivot"), lacks.alias("lacks"), adds.alias("adds")))
    size = written.groupBy("pivot").agg(F.count("*").alias("size"), F.max("n_pivot").alias("n_pivot"))
    seen = written.select("pivot", F.explode("lacks").alias("s"), F.lit(1).alias("held")).union(written.select("pivot", F.explode("adds").alias("s"), F.lit(0).alias("held")))
    often = checkpointed(seen.groupBy("pivot", "s").agg(F.count("*").alias("k"), F.max("held").alias("held")))
    # The centre: differences of more than half of the nodes change sides.
    turned = often.join(size, "pivot").where("2 * k > size").groupBy("pivot").agg(F.collect_list("s").alias("turned"), F.sum(1 - 2 * F.col("held")).alias("grown"))
    centres = checkpointed(size.join(turned, "pivot", "left").select("pivot", "size", (F.col("n_pivot") + F.coalesce("grown", F.lit(0))).alias("centre"), F.coalesce("turned", F.array().cast("array<long>")).alias("turned")))
    differences = F.concat("lacks", "adds")
    q = 100 + percent
    other = F.concat(F.array_except(differences, "turned"), F.array_except("turned", differences))
    moved = written.join(centres, "pivot").select("pivot", "node", "n", "centre", other.alias("x")).withColumn("d", F.size("x"))
    weight = q * (F.col("d") + F.col("centre") - F.col("n")) / 2 + percent * F.col("n")
    moved = checkpointed(moved.select("pivot", "node", "x", "d", weight.cast("long").alias("w"), (q * F.col("centre")).cast("long").alias("whole")))
    first = moved.groupBy("pivot").agg(F.min("w").alias("w_first"), F.min_by("node", F.struct("w", "node")).alias("first"))
    far = (F.col("w") + F.col("w_first") > F.col("whole")).alias("far")
    sided = checkpointed(moved.join(first, "pivot").select("pivot", "node", "d", "w", "whole", "w_first", "first", far))
    # A node asks of its far partners for `shorter` at least, and of near ones, if it is far itself, for `longer`.
    w_far = sided.where("far").groupBy("pivot").agg(F.min("w").alias("w_far"))

    def prefix(least: str):
        return (F.col("d") - F.greatest(F.lit(1), F.ceil((F.col("w") + F.col(least) - F.col("whole")) / q)) + 1).cast("int")

    cut = sided.join(w_far, "pivot").select("pivot", "node", "d", "w", "whole", "far", prefix("w_far").alias("shorter"), F.when(F.col("far"), prefix("w_first")).otherwise(0).alias("longer"))
    cut = cut.where("shorter > 0 OR longer > 0")
    rare = often.join(centres.select("pivot", "size"), "pivot").select("pivot", "s", F.least("k", F.col("size") - F.col("k")).alias("k"))
    listed = _labelled(cut, labels, "node", "label").join(moved.select("pivot", "node", "x"), ["pivot", "node"]).withColumn("s", F.explode("x")).drop("x").join(rare, ["pivot", "s"])
    listed = listed.withColumn("turn", F.row_number().over(Window.partitionBy("pivot", "node").orderBy("k", "s")))
    listed = checkpointed(listed.where(F.col("turn") <= F.greatest("shorter", "longer")).drop("k"))
    a = listed.where("turn <= shorter").select("pivot", "s", F.col("node").alias("a"), F.col("label").alias("label_a"), F.col("far").alias("far_a"), F.col("d").alias("d_a"), F.col("w").alias("w_a"))
    b = listed.where("far").select("pivot", "s", F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("turn"), F.col("shorter"), F.col("d").alias("d_b"), F.col("w").alias("w_b"), "whole")
    asked = F.col("w_a") + F.col("w_b") - F.col("whole")
    can = (F.col("label_a") != F.col("label_b")) & (~F.col("far_a") | ((F.col("turn") <= F.col("shorter")) & (F.col("a") < F.col("b")))) & (q * F.least("d_a", "d_b") >= asked)
    met = a.join(b, ["pivot", "s"]).where(can).groupBy("a", "b").agg(F.min_by(F.struct("pivot", "label_a", "label_b", asked.alias("asked")), "pivot").alias("m")).select("a", "b", "m.*")
    of_a, of_b = (moved.select("pivot", F.col("node").alias(c), F.col("x").alias(f"x_{c}")) for c in ("a", "b"))
    linked = met.join(of_a, ["pivot", "a"]).join(of_b, ["pivot", "b"]).where(q * F.size(F.array_intersect("x_a", "x_b")) >= F.col("asked"))
    near = _labelled(_labelled(sided.where("NOT far AND node <> first").select("node", "first"), labels, "node", "a"), labels, "first", "b").where("a <> b")
    return _merged(labels, linked.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).union(near.select("a", "b")))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have a Jaccard similarity of at least `similarity` (in whole percent) are linked;
    component_id is the smallest doc_id reachable, and that document is kept. Null, empty and blank texts have an empty
    set and are linked with nothing. Rows that share a doc_id are judged each by its own text. A null doc_id is no name: a
    component of such rows alone has a null component_id. Equal sets are always linked, and every link is confirmed on
    full sets; a pair at the threshold shares no band, and can so be missed, with a chance of MISS. Ties don't matter:
    components don't depend on order. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    percent = round(100 * similarity)
    docs = only(docs, "doc_id", text)
    # The number of a row is fixed once it is written.
    signed = checkpointed(signatures(docs, words, similarity, text).withColumn("row", F.monotonically_increasing_id()))
    whole = signed.where("n_shingles > 0")
    classes = checkpointed(whole.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id")))
    first = whole.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    buckets = first.select(F.explode("bands").alias("bucket"), F.col("row").alias("node"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    active = checkpointed(buckets.join(sizes, "bucket"))
    company = active.groupBy("node").agg(F.sum("size").alias("company"))
    pivots = active.join(company, "node").groupBy("bucket").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("pivot"))
    shared = active.join(pivots, "bucket").where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("shared"))
    members = checkpointed(shared.select("node", "pivot", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "pivot")).alias("turn")))
    wanted = checkpointed(members.select("node").union(members.select("pivot")).distinct())
    labels = wanted.select("node", F.col("node").alias("component"))
    if not wanted.isEmpty():
        keys = whole.join(wanted.select(F.col("node").alias("row")), "row", "left_semi").select("key", F.col("row").alias("node"))
        sources = docs.select(F.xxhash64("doc_id", text).alias("key"), F.col(text).alias("text")).join(keys, "key").dropDuplicates(["node"])
        sets = checkpointed(_sets(sources, words))
        # Most nodes of a group meet in one component by the pivot with which they share most buckets.
        labels = _tested(members.where("turn = 1"), labels, sets, percent)
        labels = _tested(members.where("turn > 1"), labels, sets, percent)
        labels = _by_differences(members.select("node", "pivot"), labels, sets, percent)
    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = signed.select("doc_id", "n_shingles", "digest").join(named.join(least, "component").select("digest", "component_id"), "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

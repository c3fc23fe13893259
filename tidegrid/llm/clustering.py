"""k-means on integer vectors, its nearest centroids found by the threshold algorithm.

For every dimension the centroids stand in a list sorted by their value there. From a vector's value each list is walked
outward, the nearer side first. A centroid that is met for the first time gets its exact distance. A centroid that no
list has shown yet is, in every dimension, at least as far away as that list's frontier; so once the sum of the squared
frontier distances strictly exceeds the best exact distance, no centroid is left that could win, not even by a tie.

Spark deals out the vectors: each task sums up its vectors by centroid, and only centroids times dimensions numbers reach
the driver in a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

#: Centroids, rounds, components, steps of one unit, and what stands before an id whose hash decides who begins.
CENTROIDS, ROUNDS, WIDTH, SCALE, SALT = 8, 10, 64, 1024, "3:"
#: Components from here on would take squared distances out of 64 bits.
LIMIT = 1 << 27
#: Vectors that walk together.
TOGETHER = 1024


class Lists:
    """The centroids sorted by their value in each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row of x (ties: the smaller number), and its squared distance."""
        k, width = self.values.shape
        far, dims = np.iinfo(np.int64).max, np.arange(width)
        best, number = np.full(len(x), far), np.full(len(x), k)
        right = np.stack([np.searchsorted(self.values[:, d], x[:, d]) for d in dims], axis=1) if len(x) else np.zeros((0, width), np.int64)
        left = right - 1
        seen = np.zeros((len(x), k), bool)
        rows = np.arange(len(x))
        for _ in range(k):
            at = x[rows]
            below = np.where(left >= 0, at - self.values[np.maximum(left, 0), dims], far)
            above = np.where(right < k, self.values[np.minimum(right, k - 1), dims] - at, far)
            down = below <= above
            met = self.order[np.where(down, left, right), dims]
            frontier = np.minimum(below, above)
            left, right = left - down, right + ~down
            shown = np.zeros((len(rows), k), bool)
            shown[np.arange(len(rows))[:, None], met] = True
            new_row, new = np.nonzero(shown & ~seen[rows])
            seen[rows] |= shown
            gap = at[new_row] - self.centroids[new]
            exact = (gap * gap).sum(1)
            # The last to be written stays, so the nearest comes last, and of equally near ones the smallest number.
            last = np.lexsort((-new, -exact))
            new_row, new, exact = new_row[last], new[last], exact[last]
            found, named = np.full(len(rows), far), np.full(len(rows), k)
            found[new_row], named[new_row] = exact, new
            old, old_name = best[rows], number[rows]
            better = (found < old) | ((found == old) & (named < old_name))
            best[rows], number[rows] = np.where(better, found, old), np.where(better, named, old_name)
            on = ((frontier * frontier).sum(1) <= best[rows]) & ~seen[rows].all(1)
            rows, left, right = rows[on], left[on], right[on]
            if not len(rows):
                break
        return number, best


def _whole(part: pa.RecordBatch, scale: int, width: int) -> np.ndarray:
    """The vectors of a batch as integers; every one has width components."""
    flat = pc.list_flatten(part.column(1)).to_numpy(zero_copy_only=False).astype(np.float64)
    steps = np.floor(scale * flat)
    if len(steps) and np.abs(steps).max() >= LIMIT:
        raise ArithmeticError(f"a component beyond {LIMIT // scale} has no squared distance in 64 bits")
    return steps.astype(np.int64).reshape(len(part), width)


def _assigned(parts: Iterator[pa.RecordBatch], centroids: np.ndarray, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    lists = Lists(centroids)
    for whole in parts:
        for at in range(0, len(whole), TOGETHER):
            part = whole.slice(at, TOGETHER)
            x = _whole(part, scale, centroids.shape[1])
            yield part, x, *lists.nearest(x)


def _moved(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round; those without a vector stay."""
    k, width = centroids.shape

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last column counts the vectors.
        sums = np.zeros((k, width + 1), np.int64)
        for _, x, number, _ in _assigned(parts, centroids, scale):
            np.add.at(sums, number, np.pad(x, ((0, 0), (0, 1)), constant_values=1))
        cluster, at = np.divmod(np.arange(sums.size), width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(at, pa.int32()), pa.array(sums.ravel())], names=["cluster", "at", "s"])

    # Sums of sums pass 64 bits once there are enough vectors, so exact decimals.
    sums = np.zeros((k, width + 1), object)
    for r in vectors.mapInArrow(add, "cluster int, at int, s long").groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).collect():
        sums[r.cluster, r["at"]] = int(r.s)
    return np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old.tolist() for old, row in zip(centroids, sums)], np.int64)


def cluster_vectors(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Kept are vectors with exactly width components, none null or not finite; a component x becomes floor(scale * x). The
    k vectors with the smallest sha256 of salt and id begin as centroids, in that order; ids that repeat go by their
    components, a null id counts as empty text. With fewer than k vectors all of them begin. Repeated rows count each.
    Of equally near centroids the smaller number wins; one without vectors stays. Vectors may be of any size up to
    components of LIMIT / scale, beyond which the job fails, since 64 bits can't say such distances. Without a kept
    vector there are no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    sound = (F.size("embedding") == width) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).where(sound)
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(name, "embedding").limit(k).select(F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("at")).collect()
    ddl = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{ddl}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["at"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = _moved(rows, centroids, scale)

    def last(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, number, distance in _assigned(parts, centroids, scale):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    found = checkpointed(rows.mapInArrow(last, ddl))
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

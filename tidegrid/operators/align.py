"""Point-in-time and range joins.

Every as-of join is one union, one shuffle by key and one pass in time order: linear in the rows of a key, without a
theta join. Right rows come before left rows of the same time, so a value known at t counts at t.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], values: dict[str, Column | str], tie: str = "id", ts: str = "ts", max_age: int | None = None, chunk: int | None = None) -> DataFrame:
    """left with `values` of the latest right row at or before its time, right_ts, and missing (1 where there is none).

    values: output name -> column of right. tie: a column of right that orders rows of one time; the last one wins. With
    max_age a match older than that counts as missing. A null key or time matches nothing. A column of left that is named
    like an output gives way to it. Without keys (on is empty, max_age is needed) both sides meet on time buckets as wide
    as max_age, into the next of which right rows are copied, so one series for all left rows needs no single task. With
    chunk a key's rows are scanned in chunks of that much time, each of which starts with the last match of those before
    it: a key with most of the rows then takes as many tasks as it has chunks.
    """
    outputs = {"right_ts", "missing", *values}
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    match = F.struct(F.col(ts).alias("right_ts"), *(as_col(c).alias(name) for name, c in values.items()))
    right = right.dropna(subset=[*on, ts])
    keys = [F.col(c) for c in on]
    if not on:
        if max_age is None:
            raise ValueError("a join without keys needs max_age")
        bucket = F.floor(F.col(ts) / max(1, max_age)).cast("long")
        keys, right = [bucket.alias("__bucket")], right.withColumn("__bucket", F.explode(F.array(bucket, bucket + 1)))
    r = right.select(*(on or ["__bucket"]), F.col(ts).alias("__ts"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), match.alias("__match"))
    l = left.select(*keys, F.col(ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*(c for c in left.columns if c not in outputs), F.col(ts).alias("__at")).alias("__row"))
    names = list(on or ["__bucket"])
    both = r.unionByName(l, allowMissingColumns=True)
    if chunk is not None:
        names.append("__chunk")
        both = both.withColumn("__chunk", F.floor(F.col("__ts") / chunk).cast("long"))
        # Of each chunk the last match, and from these what every later one starts with: one row for each key and chunk.
        ends = both.groupBy(*names).agg(F.max_by("__match", F.when(F.col("__side") == 0, F.struct("__ts", "__tie"))).alias("__match"))
        before = Window.partitionBy(*names[:-1]).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        starts = ends.withColumn("__match", F.last("__match", ignorenulls=True).over(before)).where(F.col("__match").isNotNull())
        starts = starts.withColumn("__ts", F.col("__chunk") * chunk).withColumn("__side", F.lit(-1))
        both = both.unionByName(starts, allowMissingColumns=True)
    by = Window.partitionBy(*names).orderBy("__ts", "__side", "__tie")
    found = F.last("__match", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__found", found).where("__side = 1").select("__row", "__found")
    if max_age is not None:
        fresh = F.col("__row.__at") - F.col("__found.right_ts") <= max_age
        out = out.withColumn("__found", F.when(fresh, F.col("__found")))
    return out.select("__row.*", "__found.*", F.col("__found").isNull().cast("int").alias("missing")).drop("__at")


def with_previous(right: DataFrame, value: str, on: Sequence[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    """right with the value of the row before: prev_<value>. With tie only the last row of each time stays, so the row before is one of an earlier time."""
    if tie is not None:
        rest = [c for c in right.columns if c not in (*on, ts)]
        right = right.groupBy(*on, ts).agg(F.max_by(F.struct(*rest), tie).alias("__last")).select(*on, ts, "__last.*")
    return right.withColumn(f"prev_{value}", F.lag(value).over(Window.partitionBy(*on).orderBy(ts)))


def asof_wide(left: DataFrame, long: DataFrame, names: Sequence[str], on: Sequence[str], name: str = "metric", value: str = "value", tie: str = "id", ts: str = "ts") -> DataFrame:
    """left with the latest value of each named metric of a long table, and <name>_missing. One pass serves all metrics; null keys and times match nothing."""
    columns = [F.when(F.col(name) == n, F.struct(F.col(value).alias("v"))).alias(n) for n in names]
    r = long.dropna(subset=[*on, ts]).where(F.col(name).isin(list(names))).select(*on, F.col(ts).alias("__ts"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), *columns)
    l = left.select(*on, F.col(ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"))
    by = Window.partitionBy(*on).orderBy("__ts", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l, allowMissingColumns=True)
    seen = both.select("__row", "__side", *(F.last(n, ignorenulls=True).over(by).alias(n) for n in names)).where("__side = 1")
    return seen.select("__row.*", *(F.col(f"{n}.v").alias(n) for n in names), *(F.col(n).isNull().cast("int").alias(f"{n}_missing") for n in names))


def range_join(left: DataFrame, right: DataFrame, on: Sequence[str], low: int, high: int, how: str = "inner", ts: str = "ts", right_ts: str = "right_ts") -> DataFrame:
    """Pairs of one key with low <= right_ts - ts <= high. The right side's time column is named right_ts.

    Both sides meet on time buckets as wide as the range, so an equi join does the work: a range touches two buckets at
    most, so each right row also stands in the bucket before its own, and a left row looks into one bucket alone. With
    how "left" a left row without a match stays, once for each time that it is there; null keys and times match nothing.
    """
    width = max(1, high - low)
    bucket = lambda c: F.floor(c / width).cast("long")
    at = bucket(F.col(right_ts))
    r = right.withColumn("__right_bucket", F.explode(F.array(at, at - 1))).withColumnsRenamed({c: f"__right_{c}" for c in on})
    l = left.withColumn("__bucket", bucket(F.col(ts) + low))
    same = (F.col("__bucket") == F.col("__right_bucket")) & (F.col(right_ts) - F.col(ts)).between(low, high)
    for c in on:
        same &= F.col(c) == F.col(f"__right_{c}")
    return l.join(r, same, how).drop("__bucket", "__right_bucket", *(f"__right_{c}" for c in on))


def resolve_snapshot(snapshots: DataFrame, at: int, ts: str = "ts") -> DataFrame:
    """The row with the greatest time at or before `at`."""
    return snapshots.where(F.col(ts) <= at).agg(F.max_by(F.struct(*snapshots.columns), ts).alias("r")).select("r.*")


def exact_join(left: DataFrame, required: dict[str, DataFrame], on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """left with the columns of every required table at the same keys; rows that one of them lacks are gone."""
    for df in required.values():
        left = left.join(df, list(on))
    return left


def check_context(left: DataFrame, context: DataFrame, on: Sequence[str] = ("symbol", "ts")) -> None:
    """Raises where a row of left has no context at its keys."""
    lacking = left.join(context, list(on), "left_anti").limit(1).collect()
    if lacking:
        raise ValueError(f"no context for {lacking[0]}")

"""Ranks and quantiles of tables that no single task can sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import scratch

#: Ranges that a key's values are counted in at a time, and the most values that the last sort of a range holds.
RANGES, FEW = 1024, 100_000


def written(df: DataFrame) -> DataFrame:
    """df, computed once into a table in a scratch folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order: Column | str, rank: str = "rank") -> DataFrame:
    """df with its place, from 1, in the given order.

    Rows are dealt out by ranges of the order and sorted there; a row's place is its place in the range and the number
    of rows in the ranges before. The order must tell all rows apart, or equal ones get places in any order. An empty
    table stays empty; a column named like the rank gives way to it.
    """
    columns = [c for c in df.columns if c != rank]
    placed = df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    # Ranges are drawn anew by each run, so their rows are written before they are counted.
    placed = written(placed.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range, so the window and what is broadcast are as large as the number of tasks.
    offsets = F.broadcast(sizes.select("__part", "__first", before.alias("__before")))
    found = placed.withColumn("__part", part).join(offsets, "__part")
    return found.select(*columns, (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias(rank))


def quantiles(df: DataFrame, keys: Sequence[str], value: Column | str, qs: Mapping[str, float], few: int = FEW, ranges: int = RANGES, stored: bool = False) -> DataFrame:
    """keys and one column for each of qs (name -> share): exact quantiles with linear interpolation, as percentile gives them.

    Selection by narrowing ranges: values are counted in equal ranges between their bounds, the range that holds a wanted
    place is cut again, until it holds `few` values at most or one value alone; those are sorted. So no buffer ever holds
    a key's values, and each round is one scan with small sums. Null and NaN values don't count; a key without any gets
    null. Without keys there is one row, also for an empty table. stored: df is a table with this value, so it isn't written again.
    """
    on = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    keyed = df.select(*on, v.cast("double").alias("__v")) if on else df.select(F.lit(0).alias("__all"), v.cast("double").alias("__v"))
    names = on or ["__all"]
    rows = keyed if stored else written(keyed)
    known = rows.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    size = known.groupBy(*names).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    # The places on both sides of every quantile, from 0.
    exact = lambda q: q * (F.col("n") - 1)
    places = F.array(*(F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), side_of(exact(q)).cast("long").alias("place")) for name, q in qs.items() for side, side_of in ((0, F.floor), (1, F.ceil))))
    wanted = size.select(*names, "low", "high", F.explode(places).alias("p")).select(*names, F.col("p.place").alias("place"), "low", "high", F.lit(0).cast("long").alias("below"), F.lit(1 << 62).alias("inside")).distinct()
    wanted = written(wanted)
    while True:
        open_ = wanted.where((F.col("inside") > few) & (F.col("low") < F.col("high")))
        if open_.isEmpty():
            break
        # Different places of a key often share a range; its values are counted once.
        spans = open_.select(*names, "low", "high").distinct()
        step = (F.col("high") - F.col("low")) / ranges
        held = known.join(spans, names).where(F.col("__v").between(F.col("low"), F.col("high")))
        bin_ = F.when(step > 0, F.least(F.floor((F.col("__v") - F.col("low")) / step), F.lit(ranges - 1))).otherwise(F.when(F.col("__v") > F.col("low"), 1).otherwise(0))
        counts = held.groupBy(*names, "low", "high", bin_.cast("long").alias("bin")).agg(F.count("*").alias("inside"), F.min("__v").alias("from"), F.max("__v").alias("to"))
        upto = F.sum("inside").over(Window.partitionBy(*names, "low", "high").orderBy("bin"))
        counts = counts.withColumn("upto", upto)
        cut = open_.select(*names, "low", "high", "place", "below").join(counts, [*names, "low", "high"])
        hit = (F.col("place") - F.col("below") < F.col("upto")) & (F.col("place") - F.col("below") >= F.col("upto") - F.col("inside"))
        cut = cut.where(hit).select(*names, "place", F.col("from").alias("low"), F.col("to").alias("high"), (F.col("below") + F.col("upto") - F.col("inside")).alias("below"), "inside")
        closed = wanted.where(~((F.col("inside") > few) & (F.col("low") < F.col("high"))))
        wanted = written(closed.unionByName(cut))
    alone = wanted.where("low = high").select(*names, "place", F.col("low").alias("x"))
    last = wanted.where("low < high")
    spans = last.select(*names, "low", "high", "below").distinct()
    held = known.join(spans, names).where(F.col("__v").between(F.col("low"), F.col("high")))
    at = F.row_number().over(Window.partitionBy(*names, "low", "high").orderBy("__v")) - 1 + F.col("below")
    picked = held.withColumn("place", at.cast("long")).join(last.select(*names, "low", "high", "place"), [*names, "low", "high", "place"], "left_semi").select(*names, "place", F.col("__v").alias("x"))
    values = alone.union(picked)
    asked = size.select(*names, "n", F.explode(places).alias("p")).select(*names, "n", "p.*").join(values, [*names, "place"])
    sides = asked.groupBy(*names, "n").agg(*(F.max(F.when((F.col("q") == name) & (F.col("side") == s), F.col("x"))).alias(f"{name}__{s}") for name in qs for s in (0, 1)))
    share = lambda q: exact(q) - F.floor(exact(q))
    # As percentile does it: a weighted mean of both sides.
    found = sides.select(*names, *(F.when(share(q) == 0, F.col(f"{name}__0")).otherwise((1 - share(q)) * F.col(f"{name}__0") + share(q) * F.col(f"{name}__1")).alias(name) for name, q in qs.items()))
    if on:
        return rows.select(*names).distinct().join(found, names, "left")
    return rows.sparkSession.range(1).select(F.lit(0).alias("__all")).join(found, "__all", "left").drop("__all")


def sketched(df: DataFrame, keys: Sequence[str], value: Column | str, qs: Mapping[str, float], error: float = 1e-4) -> DataFrame:
    """The same by mergeable sketches in one pass: each result is a value of the key whose rank is off by `error` of its rows at most."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    found = df.groupBy(*keys).agg(F.percentile_approx(v, list(qs.values()), int(1 / error)).alias("__q"))
    return found.select(*keys, *(F.col("__q")[k].alias(name) for k, name in enumerate(qs)))

"""Trades to bars, bars to wider bars, and bars of several widths as the context of a grid."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import asof_join, with_previous


def to_bars(ticks: DataFrame, width: int) -> DataFrame:
    """symbol, ts (start of the bucket), open, high, low, close, volume, trades. Ties of ts go by id."""
    order = F.struct("ts", "id")
    bucket = (F.col("ts") - F.pmod("ts", F.lit(width))).alias("bucket")
    rows = ticks.groupBy("symbol", bucket).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("size").cast("double").alias("volume"), F.count("*").alias("trades"),
    )
    return rows.withColumnRenamed("bucket", "ts")


def roll_up(bars: DataFrame, widths: Mapping[str, int], base: int) -> DataFrame:
    """symbol, tf, ts and the bar of every width, from bars of width base alone.

    A bar is a state that merges: the first open, the highest high, the lowest low, the last close, sums. So wider bars
    need no trades, and all widths are one aggregation of the narrow bars. Every width must be a multiple of base.
    """
    odd = [name for name, width in widths.items() if width % base]
    if odd:
        raise ValueError(f"{odd} can't be made of bars of {base}")
    buckets = F.array(*(F.struct(F.lit(name).alias("tf"), (F.col("ts") - F.pmod("ts", F.lit(width))).alias("bucket")) for name, width in widths.items()))
    rows = bars.select("symbol", "ts", "open", "high", "low", "close", "volume", "trades", F.explode(buckets).alias("b")).groupBy("symbol", F.col("b.tf").alias("tf"), F.col("b.bucket").alias("bucket"))
    merged = rows.agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("trades").alias("trades"))
    return merged.withColumnRenamed("bucket", "ts")


def fan_out(grid: DataFrame, ladder: DataFrame, widths: Mapping[str, int]) -> DataFrame:
    """symbol, as_of, context and coverage (maps by timeframe) of each row (symbol, ts) of grid.

    ladder: bars of all widths with their tf. A bar is known at its end. context holds close, ret_1 (against the bar
    before), volume, bar_ts and lag_sec of the latest known bar; a timeframe without one is missing (1), with nulls.
    One as-of pass serves all timeframes.
    """
    ends = F.element_at(F.create_map(*(x for name, width in widths.items() for x in (F.lit(name), F.lit(width)))), F.col("tf"))
    known = ladder.where(F.col("tf").isin(list(widths))).select("symbol", "tf", (F.col("ts") + ends).alias("ts"), "close", "volume")
    known = with_previous(known, "close", ["symbol", "tf"])
    asked = grid.select("symbol", "ts").distinct().withColumn("tf", F.explode(F.array(*map(F.lit, widths))))
    found = asof_join(asked, known, ["symbol", "tf"], {"close": "close", "prev": "prev_close", "volume": "volume"}, tie="ts")
    ret = F.when(F.abs("prev") > 1e-12, F.col("close") / F.col("prev") - 1)
    lag = ((F.col("ts") - F.col("right_ts")) / 1e6).alias("lag_sec")
    value = F.struct("missing", "close", ret.alias("ret_1"), "volume", F.col("right_ts").alias("bar_ts"), lag)
    entries = F.collect_list(F.struct("tf", value.alias("v"), F.struct("missing", lag).alias("c"))).alias("e")
    maps = found.groupBy("symbol", F.col("ts").alias("as_of")).agg(entries)

    def by_tf(part: str):
        return F.map_from_entries(F.transform("e", lambda x: F.struct(x["tf"], x[part])))

    return maps.select("symbol", "as_of", by_tf("v").alias("context"), by_tf("c").alias("coverage"))

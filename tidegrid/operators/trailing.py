"""Sums over trailing windows of time, linear in events and grid however long the windows are.

Time is cut into blocks as wide as a window, so a window reaches over two blocks at most: the end of the older one and
the start of the newer one. In each block one running sum goes forward and one backward; a grid time reads the forward
sum at itself and the backward sum at the window's start. Nothing is subtracted, so no digits are lost, and a block of a
key is all that a task needs to have in order.

An exponential decay is a product of one factor of the event and one of the grid time, both measured from the block's
start, so decayed sums are running sums as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trailing:
    """A window of `width` that ends with the grid time, which belongs to it; its start does with closed.

    sums: name -> column of the events. decayed: name -> (column, time in which it falls to 1/e).
    """

    width: int
    sums: Mapping[str, Column] = field(default_factory=dict)
    decayed: Mapping[str, tuple[Column, float]] = field(default_factory=dict)
    closed: bool = False


def trailing_sums(grid: DataFrame, events: DataFrame, windows: Sequence[Trailing], keys: Sequence[str] = ("symbol",), ts: str = "ts", step: int | None = None) -> DataFrame:
    """keys, ts and the sums of every window, 0.0 where it has no event, for each different (keys, ts) of grid.

    Names of sums differ between windows. Null values add nothing; null keys and times match nothing. With step all grid
    times and widths are multiples of it, others are an error: then events between two of these times are summed up before they
    are dealt out and sorted, and what follows grows with the grid and no longer with the events.
    """
    on = list(keys)
    time = F.col(ts)
    if step is not None:
        if any(w.width % step for w in windows):
            raise ValueError(f"widths that aren't multiples of {step}: {[w.width for w in windows]}")
        time = F.when(F.pmod(time, F.lit(step)) == 0, time).otherwise(F.raise_error(F.format_string(f"a grid time that isn't a multiple of {step}: %s", time)).cast("long"))
    at = grid.dropna(subset=[*on, ts]).select(*on, time.alias("__t")).distinct()
    known = events.dropna(subset=[*on, ts])
    names = [n for w in windows for n in (*w.sums, *w.decayed)]
    if len(set(names)) < len(names):
        raise ValueError(f"names that repeat: {names}")
    parts = []
    for k, w in enumerate(windows):
        far = [n for n, (_, half) in w.decayed.items() if w.width / half > 600]
        if far:
            raise ValueError(f"over a window of {w.width} these decay below what a double holds: {far}")
        block = F.floor(F.col("__at") / w.width).cast("long")
        # The order within a time: what the backward sum must still see comes before its reader, what it mustn't behind.
        first = 0 if w.closed else 2
        values = [c.cast("double").alias(n) for n, c in w.sums.items()]
        values += [(c.cast("double") * F.exp((F.col(ts) - F.floor(F.col(ts) / w.width) * w.width) / half)).alias(n) for n, (c, half) in w.decayed.items()]
        there = known.select(*on, F.col(ts).alias("__at"), *values)
        if step is not None:
            # A border is a cell of its own, as windows differ in whether it belongs to them; all times between two borders are one cell.
            over = F.pmod("__at", F.lit(step))
            cell = F.when(over == 0, F.col("__at")).otherwise(F.col("__at") - over + max(1, step // 2))
            there = there.groupBy(*on, cell.alias("__at")).agg(*(F.sum(n).alias(n) for n in (*w.sums, *w.decayed)))
        rows = [
            there.withColumns({"__side": F.lit(1), "__t": F.lit(None).cast("long"), "__up": F.lit(None).cast("boolean")}),
            at.select(*on, F.col("__t").alias("__at"), F.lit(2).alias("__side"), "__t", F.lit(True).alias("__up")),
            at.select(*on, (F.col("__t") - w.width).alias("__at"), F.lit(first).alias("__side"), "__t", F.lit(False).alias("__up")),
        ]
        parts += [r.withColumn("__block", block).withColumn("__w", F.lit(k)) for r in rows]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    of = Window.partitionBy(*on, "__w", "__block").rowsBetween(Window.unboundedPreceding, 0)
    ahead, back = of.orderBy("__at", "__side"), of.orderBy(F.desc("__at"), F.desc("__side"))
    fading = {n: (w.width, half) for w in windows for n, (_, half) in w.decayed.items()}

    def read(n: str) -> Column:
        found = F.when(F.col("__up"), F.sum(n).over(ahead)).otherwise(F.sum(n).over(back))
        if n in fading:
            width, half = fading[n]
            found = found * F.exp(-(F.col("__t") - F.col("__block") * width) / half)
        return found.alias(n)

    seen = both.select(*on, "__t", *map(read, names)).where("__t IS NOT NULL")
    return seen.groupBy(*on, F.col("__t").alias(ts)).agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names))


def _above(prices: np.ndarray, bases: np.ndarray, low: np.ndarray, high: np.ndarray, share: float, part: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """For each base: how many of prices[low:high] rise by more than share against it, and how many fall by more.

    Whole parts are sorted once and searched; only the ends of a range are compared one by one.
    """
    up, down = np.zeros(len(bases), np.int64), np.zeros(len(bases), np.int64)
    for start in range(0, len(prices), part):
        some = prices[start : start + part]
        stop = start + len(some)
        whole = np.flatnonzero((low <= start) & (high >= stop))
        ordered = np.sort(some)
        b = bases[whole]
        # The search is for a product, the condition is on a quotient: borders move by a step where these differ.
        k = np.searchsorted(ordered, b * (1 + share), side="right")
        while (k < len(some)).any() and (move := (k < len(some)) & ~(ordered[np.minimum(k, len(some) - 1)] / b - 1 > share)).any():
            k = k + move
        while (move := (k > 0) & (ordered[np.maximum(k - 1, 0)] / b - 1 > share)).any():
            k = k - move
        up[whole] += len(some) - k
        k = np.searchsorted(ordered, b * (1 - share), side="left")
        while (move := (k > 0) & ~(ordered[np.maximum(k - 1, 0)] / b - 1 < -share)).any():
            k = k - move
        while (k < len(some)).any() and (move := (k < len(some)) & (ordered[np.minimum(k, len(some) - 1)] / b - 1 < -share)).any():
            k = k + move
        down[whole] += k
        for q in np.flatnonzero((low < stop) & (high > start) & ~((low <= start) & (high >= stop))):
            move = prices[max(low[q], start) : min(high[q], stop)] / bases[q] - 1
            up[q] += (move > share).sum()
            down[q] += (move < -share).sum()
    return up, down


def direction_counts(prices: DataFrame, low: int, high: int, share: float, price: str = "close") -> DataFrame:
    """symbol, ts, price, and how many prices of the symbol in [ts + low, ts + high] are up, down or flat against it, by more than share.

    Each row asks two blocks of time at most, as wide as the range; there the prices in order are counted, so no pair of
    rows is ever made. Null symbols, times and prices, and prices that aren't positive, aren't there. Repeated rows count each.
    """
    width = max(1, high - low + 1)
    rows = prices.dropna(subset=["symbol", "ts", price]).where(F.col(price) > 0).select("symbol", "ts", F.col(price).cast("double").alias("p"), F.monotonically_increasing_id().alias("row"))
    block = lambda c: F.floor(c / width).cast("long")
    first, last = block(F.col("ts") + low), block(F.col("ts") + high)
    asked = rows.withColumn("block", F.explode(F.array_distinct(F.array(first, last)))).withColumn("ask", F.lit(True))
    there = rows.withColumn("block", block(F.col("ts"))).withColumn("ask", F.lit(False))

    def count(block: pa.Table) -> pa.Table:
        asks, held = block.filter(block["ask"]), block.filter(pc.invert(block["ask"])).sort_by("ts")
        times, at = held["ts"].to_numpy(), asks["ts"].to_numpy()
        a, b = np.searchsorted(times, at + low, side="left"), np.searchsorted(times, at + high, side="right")
        up, down = _above(held["p"].to_numpy(), asks["p"].to_numpy(), a, b, share)
        return pa.table([*(asks[c] for c in ("symbol", "ts", "p", "row")), pa.array(up), pa.array(down), pa.array(b - a)], names=["symbol", "ts", "p", "row", "up", "down", "n"])

    kind = prices.schema["symbol"].dataType.simpleString()
    met = asked.unionByName(there).groupBy("symbol", "block").applyInArrow(count, f"symbol {kind}, ts long, p double, row long, up long, down long, n long")
    return met.groupBy("symbol", "row", "ts", "p").agg(*(F.sum(c).alias(c) for c in ("up", "down", "n"))).select("symbol", "ts", F.col("p").alias(price), "up", "down", (F.col("n") - F.col("up") - F.col("down")).alias("flat"))

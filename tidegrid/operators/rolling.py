"""Rolling features of series. Deviations are population ones; every frame is by symbol in time order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BY = ("symbol",)


def by(*keys: str, order: str = "ts"):
    return Window.partitionBy(*(keys or _BY)).orderBy(order)


def rows(n: int, *keys: str, until: int = 0, order: str = "ts"):
    """The last n rows up to `until`."""
    return by(*keys, order=order).rowsBetween(until - n + 1, until)


def correlation(a: str | Column, b: str | Column, over=None) -> Column:
    """Correlation of the rows that have both; null where one of them doesn't move. The built-in one divides by zero there."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    of = (lambda c: c) if over is None else (lambda c: c.over(over))
    return of(F.covar_pop(x, y)) / F.nullif(of(F.stddev_pop(x)) * of(F.stddev_pop(y)), F.lit(0.0))


def k_return(k: int, price: str = "close") -> Column:
    """Return over k bars, or over all there are."""
    base = F.coalesce(F.lag(price, k).over(by()), F.first(price).over(by()))
    return (F.col(price) - base) / F.greatest(base, F.lit(1e-12))


def volume_impact(price: str = "close", volume: str = "volume") -> Column:
    """Size of the last return against the root of the volume."""
    return F.abs(k_return(1, price)) / F.sqrt(F.greatest(F.lit(1.0), F.col(volume)))


def log_return(price: str = "close") -> Column:
    return F.log(F.col(price) / F.lag(price).over(by()))


def realised_vol(k: int, ret: str = "ret") -> Column:
    """Deviation of the last k returns; 0 with fewer than three prices."""
    return F.when(F.row_number().over(by()) < 3, 0.0).otherwise(F.stddev_pop(ret).over(rows(k)))


def zscore(c: str, n: int) -> Column:
    mean, dev = F.avg(c).over(rows(n)), F.stddev_pop(c).over(rows(n))
    return F.when(dev > 1e-12, (F.col(c) - mean) / dev).otherwise(0.0)


def finite_ewm(c: str, span: int, n: int) -> Column:
    """Exponential mean over the last n rows, oldest first, seeded with the current value: a closed form, no recursion."""
    a = 2 / (span + 1)
    values = F.collect_list(c).over(rows(n))
    return F.aggregate(values, F.col(c).cast("double"), lambda acc, x: acc * F.lit(1 - a) + x * F.lit(a))


def skew(c: str, n: int) -> Column:
    """Population skewness from moments; 0 where the deviation is."""
    w = rows(n)
    m, m2, m3 = F.avg(c).over(w), F.avg(F.col(c) ** 2).over(w), F.avg(F.col(c) ** 3).over(w)
    var = m2 - m * m
    return F.when(var > 1e-14, (m3 - 3 * m * m2 + 2 * m**3) / F.pow(var, F.lit(1.5))).otherwise(0.0)


def stats_pack(c: str, n: int) -> dict[str, Column]:
    """mean, std, min, max, last, zscore, exponential mean and the deviation of its course, lag-1 autocorrelation and quantiles of the last n rows, or of all there are.

    c has no nulls. The course of the exponential mean starts at the frame's first row.
    """
    w, a = rows(n), 2 / (n + 1)
    mean, dev = F.avg(c).over(w), F.stddev_pop(c).over(w)
    start = F.struct(F.lit(None).cast("double").alias("e"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))

    def step(acc, x):
        e = F.coalesce(a * x + (1 - a) * acc["e"], x)
        return F.struct(e.alias("e"), (acc["s1"] + e).alias("s1"), (acc["s2"] + e * e).alias("s2"))

    course = F.aggregate(F.collect_list(c).over(w), start, step)
    size = F.count(c).over(w)
    spread = lambda acc: F.sqrt(F.greatest(F.lit(0.0), acc["s2"] / size - (acc["s1"] / size) * (acc["s1"] / size)))
    before, pairs = f"{c}__before", rows(n - 1)
    varied = (F.row_number().over(by()) > 2) & (F.stddev_pop(before).over(pairs) > 1e-12) & (F.stddev_pop(F.when(F.col(before).isNotNull(), F.col(c))).over(pairs) > 1e-12)
    return {
        "mean": mean, "std": dev, "min": F.min(c).over(w), "max": F.max(c).over(w), "last": F.col(c), "zscore": (F.col(c) - mean) / F.greatest(dev, F.lit(1e-9)),
        "ewm_mean": course["e"], "ewm_std": spread(course), "autocorr1": F.when(varied, correlation(c, before, pairs)).otherwise(0.0), "quantile_10": F.percentile(c, 0.1).over(w), "quantile_90": F.percentile(c, 0.9).over(w),
    }


def with_stats(df: DataFrame, c: str, windows: tuple[int, ...]) -> DataFrame:
    """df without rows whose c is null, and the pack of each window as <name>_<n>."""
    known = df.where(F.col(c).isNotNull()).withColumn(f"{c}__before", F.lag(c).over(by()))
    return known.select(*df.columns, *(v.alias(f"{name}_{n}") for n in windows for name, v in stats_pack(c, n).items()))


#: What regime features read; a null counts as masked.
REGIME_INPUTS = ("ret_1", "vol_12", "orderbook_spread_bps", "orderbook_depth_total", "orderbook_imbalance", "funding_rate", "basis_rate", "open_interest", "ret_48", "ret_288", "text_coverage", "text_disagreement", "event_count_1h")


def regime_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """symbol, ts, the columns in keep, regime (16 values) and regime_mask (1 where an input is missing) of rows with the columns of REGIME_INPUTS; those that aren't there are missing."""
    there = [c for c in REGIME_INPUTS if c in df.columns]
    v = lambda c: F.col(f"__v_{c}")
    m = lambda *cs: F.greatest(*(F.col(f"__m_{c}") for c in cs)) if len(cs) > 1 else F.col(f"__m_{cs[0]}")
    d = df.select("symbol", "ts", *keep, *((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in there else F.lit(0.0)).alias(f"__v_{c}") for c in REGIME_INPUTS), *((F.col(c).isNull().cast("byte") if c in there else F.lit(1).cast("byte")).alias(f"__m_{c}") for c in REGIME_INPUTS))
    vol, oi, w96 = F.stddev_pop(v("ret_1")).over(rows(24)), v("open_interest"), rows(96)
    change = oi - F.coalesce(F.lag(oi).over(by()), oi)
    zero = F.lit(0.0)
    fall = F.greatest(zero, -change) * (1 + F.greatest(zero, v("orderbook_spread_bps"))) * (1 + vol)
    skewed = F.when(F.row_number().over(by()) >= 3, skew("__v_ret_1", 48)).otherwise(0.0)
    funding = v("funding_rate")
    z = (funding - F.avg(funding).over(w96)) / F.greatest(F.lit(1e-8), F.stddev_pop(funding).over(w96))
    values = [vol, F.stddev_pop(v("vol_12")).over(rows(24)), skewed, v("orderbook_spread_bps"), F.log1p(F.greatest(zero, v("orderbook_depth_total"))), v("orderbook_imbalance"), funding, z, v("basis_rate"), oi, change, fall, 0.6 * v("ret_48") + 0.4 * v("ret_288"), v("text_coverage"), v("text_disagreement"), v("event_count_1h")]
    masks = [m("ret_1", "vol_12"), m("ret_1", "vol_12"), m("ret_1"), m("orderbook_spread_bps"), m("orderbook_depth_total"), m("orderbook_imbalance"), m("funding_rate"), m("funding_rate"), m("basis_rate"), m("open_interest"), m("open_interest"), m("open_interest", "orderbook_spread_bps", "ret_1"), m("ret_48", "ret_288"), m("text_coverage"), m("text_disagreement"), m("event_count_1h")]
    return d.select("symbol", "ts", *keep, F.array(*values).alias("regime"), F.array(*masks).alias("regime_mask"))


def prefix_mean(df: DataFrame, c: str, n: int, out: str) -> DataFrame:
    """Mean of the last n rows from running sums: linear in the rows for any n, where a frame costs n a row."""
    run = df.withColumn("__sum", F.sum(c).over(by().rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(by()))
    before = F.coalesce(F.lag("__sum", n).over(by()), F.lit(0.0))
    return run.withColumn(out, (F.col("__sum") - before) / F.least("__n", F.lit(n))).drop("__sum", "__n")


def trailing_row(df: DataFrame, history: int = 96) -> DataFrame:
    """symbol, ts and 20 price features of rows (close, volume) with `history` rows before them.

    Returns over k bars; deviations of the log returns between the k prices before the row, which isn't one of them; their
    differences; the volume's logarithm, its score against the 12 before, and its impact.
    """
    d = df.withColumn("__ret", log_return()).withColumn("__i", F.row_number().over(by()))
    ret = {k: k_return(k) for k in (1, 3, 12, 48, 96, 288)}
    vol = {k: F.coalesce(F.stddev_pop("__ret").over(rows(k - 1, until=-1)), F.lit(0.0)) for k in (3, 12, 48, 96, 288)}
    before = rows(12, until=-1)
    z = (F.col("volume") - F.avg("volume").over(before)) / F.greatest(F.stddev_pop("volume").over(before), F.lit(1e-6))
    d = d.withColumns({f"ret_{k}": c for k, c in ret.items()} | {f"vol_{k}": c for k, c in vol.items()} | {"vol_z": z, "volume_impact": volume_impact(), "volume_log": F.log1p(F.greatest(F.col("volume"), F.lit(0.0)))})
    differences = {f"ret_accel_{a}_{b}": F.col(f"ret_{a}") - F.col(f"ret_{b}") for a, b in ((1, 3), (3, 12), (12, 48))} | {f"vol_term_{a}_{b}": F.col(f"vol_{a}") - F.col(f"vol_{b}") for a, b in ((3, 12), (12, 48), (48, 288))}
    names = [*(f"ret_{k}" for k in ret), *(f"vol_{k}" for k in vol), *differences, "volume_log", "vol_z", "volume_impact"]
    return d.withColumns(differences).where(F.col("__i") > history).select("symbol", "ts", *names)


def gaps(times: DataFrame, start: int, end: int, width: int, keys: tuple = _BY) -> DataFrame:
    """Runs of missing buckets of [start, end] per key: gap_start, gap_end (last missing bucket), missing."""
    bucket = times.select(*keys, (F.col("ts") - F.pmod("ts", F.lit(width))).alias("b")).where(F.col("b").between(start, end)).distinct()
    edges = bucket.select(*keys).distinct().select(*keys, F.explode(F.array(F.lit(start - width), F.lit(end + width))).alias("b"))
    following = bucket.union(edges).withColumn("next", F.lead("b").over(by(*keys, order="b")))
    wide = following.where(F.col("next") - F.col("b") > width)
    return wide.select(*keys, (F.col("b") + width).alias("gap_start"), (F.col("next") - width).alias("gap_end"), ((F.col("next") - F.col("b")) / width - 1).cast("long").alias("missing"))


def fill_grid(points: DataFrame, end: int, width: int, value: str = "value", parity: bool = False, start: int = 0, chunk: int | None = None) -> DataFrame:
    """Every bucket from a symbol's first point to end with the latest value: interval expansion, no join with a grid.

    A point counts from the next bucket border on. With parity it counts from its bucket's start, and the first value
    extends back to start, as the older ingestion did; that looks ahead. With chunk a symbol's points are scanned in
    chunks of that much time.
    """
    floor = F.col("ts") - F.pmod("ts", F.lit(width))
    at = floor if parity else F.when(F.pmod("ts", F.lit(width)) == 0, F.col("ts")).otherwise(floor + width)
    last = points.groupBy("symbol", at.alias("b")).agg(F.max_by(value, F.struct("ts", "id")).alias(value)).where(F.col("b") <= end)
    first = F.row_number().over(by(order="b")) == 1
    begin = F.when(first, F.least("b", F.lit(start))).otherwise(F.col("b")) if parity else F.col("b")
    until = F.coalesce(F.lead("b").over(by(order="b")) - width, F.lit(end))
    if chunk is not None:
        # The next point of a chunk's last one is the first of a later chunk: the same scan with time turned round.
        turned = carried(last.withColumn("__at", -F.col("b")), _BY, chunk, {"__next": (F.min("b"), F.min("__next"))}, ts="__at")
        by_chunk = Window.partitionBy(*_BY, "__chunk").orderBy("b")
        until = F.coalesce(F.lead("b").over(by_chunk), F.col("__next")) - width
        until, last = F.coalesce(until, F.lit(end)), turned
        if parity:
            lead = last.groupBy(*_BY).agg(F.min("b").alias("__first"))
            last = last.join(lead, list(_BY))
            begin = F.when(F.col("b") == F.col("__first"), F.least("b", F.lit(start))).otherwise(F.col("b"))
    spans = last.select("symbol", value, begin.alias("begin"), until.alias("until"))
    return spans.select("symbol", F.explode(F.sequence("begin", "until", F.lit(width))).alias("ts"), value)


def carried(df: DataFrame, keys: Sequence[str], chunk: int, states: dict[str, tuple[Column, Column]], ts: str = "ts") -> DataFrame:
    """df with __chunk, its chunk of time, and for every state what the chunks of its key before that hold of it.

    states: name -> (aggregate of a chunk, window function that makes the state of several chunks of their <name>). So a
    scan in order needs a task for a chunk of a key, not for a key: first the sums of chunks, then a scan of these, then
    each chunk from where the one before it ends. Names begin with __.
    """
    at = F.floor(F.col(ts) / chunk).cast("long")
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, at.alias("__chunk")).agg(*(one.alias(name) for name, (one, _) in states.items()))
    starts = ends.select(*keys, "__chunk", *(over.over(before).alias(name) for name, (_, over) in states.items()))
    # A null key is a key as well.
    k = starts.withColumnsRenamed({c: f"__k_{c}" for c in (*keys, "__chunk")})
    same = F.col("__chunk").eqNullSafe(F.col("__k___chunk"))
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return df.withColumn("__chunk", at).join(k, same, "left").drop(*(f"__k_{c}" for c in (*keys, "__chunk")))


def previous(df: DataFrame, c: str, chunk: int, keys: Sequence[str] = _BY, order: Sequence[str] = ("ts", "id"), out: str | None = None) -> DataFrame:
    """df with prev_<c>, the value of the row before in the order (times first), in chunks of time."""
    last = (F.max_by(F.struct(F.col(c).alias("v")), F.struct(*order)), F.last("__last", ignorenulls=True))
    d = carried(df, keys, chunk, {"__last": last}, order[0])
    within = F.lag(F.struct(F.col(c).alias("v"))).over(Window.partitionBy(*keys, "__chunk").orderBy(*order))
    return d.withColumn(out or f"prev_{c}", F.coalesce(within, F.col("__last"))["v"]).drop("__chunk", "__last")


def equity(df: DataFrame, ret: str = "ret", keys: tuple = _BY, include_initial: bool = False, chunk: int | None = None) -> DataFrame:
    """df with equity (product of 1 + ret, 0 once a step loses all) and drawdown from the running peak.

    With chunk a key's steps are scanned in chunks of that much ts: growth and ruin are carried on first, then peaks.
    """
    grown, ruin = F.when(F.col(ret) > -1, F.log1p(ret)).otherwise(0.0), (F.col(ret) <= -1).cast("int")
    parts, d = list(keys), df
    if chunk is not None:
        d = carried(df, keys, chunk, {"__grown": (F.sum(grown), F.sum("__grown")), "__ruin": (F.max(ruin), F.max("__ruin"))})
        parts.append("__chunk")
    w = by(*parts).rowsBetween(Window.unboundedPreceding, 0)
    total, dead = F.sum(grown).over(w), F.max(ruin).over(w)
    if chunk is not None:
        total, dead = total + F.coalesce("__grown", F.lit(0.0)), F.greatest(dead, "__ruin")
    out = d.withColumn("equity", F.when(dead == 1, 0.0).otherwise(F.exp(total)))
    if chunk is not None:
        out = carried(out.drop("__chunk", "__grown", "__ruin"), keys, chunk, {"__peak": (F.max("equity"), F.max("__peak"))})
        peak = F.greatest(F.max("equity").over(w), "__peak")
    else:
        peak = F.max("equity").over(w)
    peak = F.greatest(peak, F.lit(1.0)) if include_initial else peak
    return out.withColumn("drawdown", F.when(peak > 0, F.col("equity") / peak - 1).otherwise(-1.0)).drop("__chunk", "__peak")

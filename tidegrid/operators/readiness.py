"""Whether a universe is ready: coverage of its modalities, whole label windows, and what to do about the rest."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tagged(modalities: Mapping[str, DataFrame]) -> DataFrame:
    """symbol, modality, ts of all modalities (name -> rows with symbol and ts): one union, scanned once for all counts."""
    return reduce(DataFrame.union, (df.select("symbol", F.lit(name).alias("modality"), "ts") for name, df in modalities.items()))


def span(times: DataFrame, width: int) -> DataFrame:
    """One row: start and end, the first and the last bucket of the table, and how many lie between, both included."""
    low, high = (f("ts") - F.pmod(f("ts"), F.lit(width)) for f in (F.min, F.max))
    return times.agg(low.alias("start"), high.alias("end")).withColumn("expected", ((F.col("end") - F.col("start")) / width + 1).cast("long"))


def coverage(rows: DataFrame, within: DataFrame, width: int) -> DataFrame:
    """symbol, modality, coverage (share of the expected buckets with a row), first_ts and last_ts, of rows (symbol, modality, ts) within the one-row span."""
    inside = rows.crossJoin(F.broadcast(within)).where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end") + width))
    # Two levels: a bucket is one row before it is counted, so no distinct count expands the rows.
    buckets = inside.groupBy("symbol", "modality", F.floor((F.col("ts") - F.col("start")) / width).alias("b")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.first("expected").alias("expected"))
    return buckets.groupBy("symbol", "modality").agg((F.count("*") / F.first("expected")).alias("coverage"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def label_windows(times: DataFrame, width: int, lookback: int, ahead: int) -> DataFrame:
    """symbol, rows (buckets that are there), viable, first_label and last_label: the buckets t whose window from t - lookback + 1 to t + ahead has no gap.

    Buckets that follow each other form an island; an island of n buckets holds n - lookback - ahead + 1 whole windows. So
    windows are counted by their ends, not looked at. Symbols without a whole window have 0 and nulls; null times aren't there.
    """
    size = lookback + ahead
    b = times.dropna(subset=["symbol", "ts"]).select("symbol", (F.col("ts") - F.pmod("ts", F.lit(width))).alias("b")).distinct()
    by = Window.partitionBy("symbol").orderBy("b")
    # An island is told by its number of buckets before minus its place in time, which is the same for all of them.
    named = b.withColumn("island", F.col("b") - F.row_number().over(by) * width)
    islands = named.groupBy("symbol", "island").agg(F.min("b").alias("a"), F.max("b").alias("z"), F.count("*").alias("n"))
    whole = F.col("n") >= size
    windows = F.when(whole, F.col("n") - size + 1).otherwise(0)
    return islands.groupBy("symbol").agg(F.sum("n").alias("rows"), F.sum(windows).alias("viable"), F.min(F.when(whole, F.col("a") + (lookback - 1) * width)).alias("first_label"), F.max(F.when(whole, F.col("z") - ahead * width)).alias("last_label"))


def readiness(covered: DataFrame, windows: DataFrame, needed: Mapping[str, float], wanted: Mapping[str, float], lookback: int, ahead: int, spare: int = 8) -> DataFrame:
    """symbol, a column of coverage for each modality, label_rows, viable, status and reasons.

    A symbol with less coverage than needed of a modality, or too few rows for labels, is BLOCKED; with less than wanted it is
    DEGRADED; else READY. All reasons are told. A modality without rows has coverage 0.
    """
    names = [*needed, *wanted]
    wide = covered.groupBy("symbol").pivot("modality", names).agg(F.max("coverage")).fillna(0.0, names)
    d = wide.join(windows.select("symbol", F.col("rows").alias("label_rows"), "viable"), "symbol", "left").fillna(0, ["label_rows", "viable"])
    least = lookback + ahead + spare
    blocked = F.array_compact(F.array(*(F.when(F.col(m) < k, f"{m}_coverage") for m, k in needed.items()), F.when(F.col("label_rows") < least, "label_window_insufficient"), F.when(F.col("viable") == 0, "no_whole_label_window")))
    poor = F.array_compact(F.array(*(F.when(F.col(m) < k, f"{m}_coverage") for m, k in wanted.items())))
    status = F.when(F.size(blocked) > 0, "BLOCKED").when(F.size(poor) > 0, "DEGRADED").otherwise("READY")
    return d.withColumn("status", status).withColumn("reasons", F.concat(blocked, poor))


def zero_filled(rows: DataFrame, latest: int = 64, share: float = 0.98, least: int = 500) -> DataFrame:
    """symbol, entries, zeros and anomaly: whether of the unmasked entries of a symbol's latest rows (symbol, ts, values, mask) nearly all are 0. Fewer than `least` entries say nothing."""
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    last = rows.withColumn("__rn", rn).where(F.col("__rn") <= latest)
    seen = F.filter(F.arrays_zip(F.col("values").alias("v"), F.col("mask").alias("m")), lambda x: (x["m"] == 0) & x["v"].isNotNull())
    d = last.select("symbol", F.size(seen).alias("n"), F.size(F.filter(seen, lambda x: x["v"] == 0)).alias("z"))
    found = d.groupBy("symbol").agg(F.sum("n").alias("entries"), F.sum("z").alias("zeros"))
    return found.withColumn("anomaly", (F.col("zeros") >= share * F.col("entries")) & (F.col("entries") >= least))


def contract_audit(rows: DataFrame, dims: int, schema_hash: str, keys: list[str]) -> DataFrame:
    """keys, n, dim_mismatch, null_time, hash_mismatch and zero_vector of feature rows (ts, values, mask, schema_hash)."""
    size = lambda c: F.coalesce(F.size(c), F.lit(-1))
    zero = F.coalesce(F.forall("values", lambda v: v == 0), F.lit(False))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if((size("values") != dims) | (size("mask") != dims)).alias("dim_mismatch"), F.count_if(F.col("ts").isNull()).alias("null_time"), F.count_if(~F.col("schema_hash").eqNullSafe(F.lit(schema_hash))).alias("hash_mismatch"), F.count_if(zero).alias("zero_vector"))


def cache_gate(rows: DataFrame, keys: list[str], most_missing: float = 0.6, most_synthetic: float = 0.5) -> DataFrame:
    """keys, missing_ratio (mean share of masked values of a row), synthetic_ratio (mean of the rows') and passed."""
    share = F.aggregate("mask", F.lit(0.0), lambda s, m: s + m) / F.greatest(F.lit(1), F.size("mask"))
    found = rows.groupBy(*keys).agg(F.avg(share).alias("missing_ratio"), F.avg(F.coalesce("synthetic_ratio", F.lit(0.0))).alias("synthetic_ratio"))
    return found.withColumn("passed", (F.col("missing_ratio") <= most_missing) & (F.col("synthetic_ratio") <= most_synthetic))

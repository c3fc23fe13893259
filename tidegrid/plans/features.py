"""Feature assembly, labels, samples and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..functions import expr as X
from ..operators import assemble as S
from ..operators import rolling as R
from ..operators import sizing as Z
from ..operators.align import asof_join, asof_wide
from ..sources.fixtures import BARS, DAY, FILLS, HOUR, PREDICTIONS, TICKS, bars, fills, micros, news, predictions, table, ticks
from ..sources.io import scratch
from ..sources.panel import PanelStore
from .aggregates import _PROFILE, event_profile_at
from .registry import query
from .scalars import _COSTS, _TOTAL, costed

_W = "PARTITION BY symbol ORDER BY ts"
_RET = BARS + f", r AS (SELECT *, ln(close / lag(close) OVER ({_W})) AS ret, row_number() OVER ({_W}) AS rn FROM bars)"


def r6(c, name, n=6):
    return F.round(c, n).alias(name)


CONTRACT = (S.Feature("ret_1", required=True), S.Feature("vol_12"), S.Feature("volume_log"), S.Feature("events_6h", "event"), S.Feature("other_price", "derivatives", "ffill"), S.Feature("lag_sec", "quality", "median"))


_CORE = ("symbol", "ts", "ret_1", "vol_12", "volume_log", "events_6h", "other_price", "lag_sec")


def _snapshot(spark, sf):
    b = bars(spark, sf).withColumn("ret", R.log_return())
    price = {f"ret_{k}": R.k_return(k) for k in (1, 12)} | {f"vol_{k}": R.realised_vol(k) for k in (12, 48)}
    rows = b.select("symbol", "ts", *(c.alias(n) for n, c in price.items()), F.log1p("volume").alias("volume_log"), R.zscore("volume", 49).alias("volume_z"))
    counts = A.rolling_events(rows.select("symbol", "ts"), news(spark, sf), {"1h": HOUR, "6h": 6 * HOUR}, "sentiment")
    joined = rows.join(counts.select("symbol", "ts", F.col("n_1h").alias("events_1h"), F.col("n_6h").alias("events_6h")), ["symbol", "ts"])
    other = bars(spark, sf).where("symbol = 'purchase'").select("ts", "close", "trades")
    found = asof_join(joined, other, [], {"other_price": "close"}, tie="trades", max_age=HOUR)
    return found.withColumn("lag_sec", (F.col("ts") - F.col("right_ts")) / 1e6).drop("right_ts", "missing")


_SNAP = _RET + f", n AS (SELECT symbol, ts + size * 1000000 AS ts FROM ticks), cnt AS (SELECT b.symbol, b.ts, count(n.ts) FILTER (WHERE n.ts >= b.ts - {HOUR}) AS events_1h, count(n.ts) AS events_6h FROM bars b LEFT JOIN n ON n.symbol = b.symbol AND n.ts BETWEEN b.ts - {6 * HOUR} AND b.ts GROUP BY 1, 2), oth AS (SELECT ts, close FROM bars WHERE symbol = 'purchase'), px AS (SELECT *, close / coalesce(lag(close) OVER ({_W}), close) - 1 AS ret_1, close / coalesce(lag(close, 12) OVER ({_W}), first_value(close) OVER ({_W})) - 1 AS ret_12, CASE WHEN rn < 3 THEN 0 ELSE stddev_pop(ret) OVER ({_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END AS vol_12, CASE WHEN rn < 3 THEN 0 ELSE stddev_pop(ret) OVER ({_W} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) END AS vol_48, ln(1 + volume) AS volume_log, CASE WHEN stddev_pop(volume) OVER z > 1e-12 THEN (volume - avg(volume) OVER z) / stddev_pop(volume) OVER z ELSE 0 END AS volume_z FROM r WINDOW z AS ({_W} ROWS BETWEEN 48 PRECEDING AND CURRENT ROW)), snap AS (SELECT px.symbol, px.ts, ret_1, ret_12, vol_12, vol_48, volume_log, volume_z, events_1h, events_6h, CASE WHEN px.ts - oth.ts <= {HOUR} THEN oth.close END AS other_price, CASE WHEN px.ts - oth.ts <= {HOUR} THEN (px.ts - oth.ts) / 1e6 END AS lag_sec FROM px JOIN cnt ON px.symbol = cnt.symbol AND px.ts = cnt.ts ASOF LEFT JOIN oth ON px.ts >= oth.ts)"
_METRICS = ("m0", "m1", "m2")
_FULL = _SNAP + f", book AS (SELECT symbol, ts, (high - low) / ((high + low) / 2) * 1e4 AS spread_bps, (volume - trades) / (volume + trades) AS imbalance, volume + trades AS depth, trades % 2 = 0 AS synthetic FROM bars WHERE trades % 4 <> 0), fund AS (SELECT symbol, ts - ts % {8 * HOUR} + {8 * HOUR} AS ts, avg(price) / 1e4 AS rate FROM ticks GROUP BY 1, ticks.ts - ticks.ts % {8 * HOUR}), " + ", ".join(f"{m} AS (SELECT symbol, ts, last(price ORDER BY id) AS v FROM ticks WHERE id % 3 = {k} GROUP BY 1, 2)" for k, m in enumerate(_METRICS)) + f", s1 AS (SELECT snap.*, CASE WHEN snap.ts - k.ts <= {2 * HOUR} THEN k.ts END AS bts, spread_bps, imbalance, depth, synthetic FROM snap ASOF LEFT JOIN book k ON snap.symbol = k.symbol AND snap.ts >= k.ts), s2 AS (SELECT s1.*, f.ts AS fts, rate FROM s1 ASOF LEFT JOIN fund f ON s1.symbol = f.symbol AND s1.ts >= f.ts), s3 AS (SELECT s2.*, m0.v AS m0 FROM s2 ASOF LEFT JOIN m0 ON s2.symbol = m0.symbol AND s2.ts >= m0.ts), s4 AS (SELECT s3.*, m1.v AS m1 FROM s3 ASOF LEFT JOIN m1 ON s3.symbol = m1.symbol AND s3.ts >= m1.ts), s5 AS (SELECT s4.*, m2.v AS m2 FROM s4 ASOF LEFT JOIN m2 ON s4.symbol = m2.symbol AND s4.ts >= m2.ts)"


@query(f"WITH {_FULL} SELECT symbol, ts, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("ret_1", "ret_12", "vol_12", "vol_48", "volume_log", "volume_z")) + ", events_1h, events_6h, other_price, lag_sec, CASE WHEN bts IS NOT NULL THEN round(spread_bps, 5) END AS spread_bps, CASE WHEN bts IS NOT NULL THEN round(imbalance, 6) + 0.0 END AS imbalance, CASE WHEN bts IS NOT NULL THEN depth::DOUBLE END AS depth, (ts - bts) / 1e6 AS book_lag_sec, (bts IS NULL)::INT AS book_missing, round(rate, 9) AS funding_rate, (ts - fts) / 1e6 AS funding_lag_sec, (fts IS NULL)::INT AS funding_missing, m0, m1, m2, (m0 IS NULL)::INT AS m0_missing, (m1 IS NULL)::INT AS m1_missing, (m2 IS NULL)::INT AS m2_missing, round((CASE WHEN bts IS NOT NULL AND synthetic THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN fts IS NOT NULL AND ts - fts > 0 THEN 1 ELSE 0 END) / 2, 6) AS synthetic_ratio FROM s5")
def fx01_feature_snapshot(spark, sf):
    """Price, event, book, funding and metric blocks with their ages, what is missing and what is synthetic; a funding rate that isn't of its own hour counts as carried on."""
    s = _snapshot(spark, sf)
    b, t = bars(spark, sf), ticks(spark, sf)
    mid, sizes = (F.col("high") + F.col("low")) / 2, F.col("volume") + F.col("trades")
    book = b.where("trades % 4 <> 0").select("symbol", "ts", ((F.col("high") - F.col("low")) / mid * 1e4).alias("spread_bps"), ((F.col("volume") - F.col("trades")) / sizes).alias("imbalance"), sizes.alias("depth"), (F.col("trades") % 2 == 0).alias("synthetic"))
    funding = t.groupBy("symbol", (F.col("ts") - F.pmod("ts", F.lit(8 * HOUR)) + 8 * HOUR).alias("at")).agg((F.avg("price") / 1e4).alias("rate")).withColumnRenamed("at", "ts")
    s = S.with_block(s, book, "book", {c: c for c in ("spread_bps", "imbalance", "depth", "synthetic")}, max_age=2 * HOUR)
    s = S.with_block(s, funding, "funding", {"funding_rate": "rate"})
    metrics = t.select("symbol", "ts", "id", F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("metric"), F.col("price").alias("value"))
    s = asof_wide(s, metrics, _METRICS, ["symbol"])
    synthetic = S.synthetic_ratio([F.col("synthetic"), F.col("funding_lag_sec") > 0])
    rounded = {"spread_bps": 5, "funding_rate": 9}
    named = ("ret_1", "ret_12", "vol_12", "vol_48", "volume_log", "volume_z", "spread_bps", "imbalance", "funding_rate")
    kept = ("events_1h", "events_6h", "other_price", "lag_sec", "depth", "book_lag_sec", "book_missing", "funding_lag_sec", "funding_missing", *_METRICS, *(f"{m}_missing" for m in _METRICS))
    return s.select("symbol", "ts", *((F.round(c, rounded.get(c, 6)) + 0.0).alias(c) for c in named), *kept, r6(synthetic, "synthetic_ratio"))


@query(f"WITH {_SNAP}, m AS (SELECT quantile_cont(lag_sec, 0.5) AS med FROM snap) SELECT symbol, ts, events_6h::DOUBLE AS v0, round(coalesce(lag_sec, med, 0)::FLOAT::DOUBLE, 3) AS v1, round(coalesce(other_price, last_value(other_price IGNORE NULLS) OVER ({_W}), 0)::FLOAT::DOUBLE, 3) AS v2, round(ret_1::FLOAT::DOUBLE, 4) + 0.0 AS v3, round(vol_12::FLOAT::DOUBLE, 4) AS v4, (lag_sec IS NULL)::INT + (other_price IS NULL)::INT AS masked FROM snap, m")
def fx02_contract(spark, sf):
    a = S.align(_snapshot(spark, sf).select(*_CORE), CONTRACT)
    v = [F.col("values")[k].cast("double") for k in range(5)]
    masked = F.aggregate("mask", F.lit(0), lambda s, m: s + m.cast("int"))
    return a.select("symbol", "ts", v[0].alias("v0"), r6(v[1], "v1", 3), r6(v[2], "v2", 3), (F.round(v[3], 4) + 0.0).alias("v3"), r6(v[4], "v4", 4), masked.alias("masked"))


@query(f"WITH {BARS}, t AS (SELECT symbol, ts - ts % {6 * HOUR} + {6 * HOUR} AS ts, [avg(price), count(*)::DOUBLE] AS block FROM ticks GROUP BY 1, ticks.ts - ticks.ts % {6 * HOUR}), j AS (SELECT b.symbol, b.ts, close, block, (b.ts - t.ts) / 1e6 AS lag, CASE WHEN block IS NULL THEN 'none' WHEN b.ts - t.ts > {4 * HOUR} THEN 'stale' ELSE 'fresh' END AS text_case FROM bars b ASOF LEFT JOIN t ON b.symbol = t.symbol AND b.ts >= t.ts) SELECT symbol, ts, round(close::FLOAT::DOUBLE, 2) AS v0, CASE WHEN text_case = 'fresh' THEN round(block[1]::FLOAT::DOUBLE, 2) ELSE 0 END AS v1, CASE WHEN text_case = 'fresh' THEN block[2] ELSE 0 END AS v2, (text_case <> 'fresh')::INT AS m1, text_case, lag AS text_lag_sec FROM j")
def fx03_view_merge(spark, sf):
    end = (F.col("ts") - F.pmod("ts", F.lit(6 * HOUR)) + 6 * HOUR).alias("e")
    text = ticks(spark, sf).groupBy("symbol", end).agg(F.array(F.avg("price"), F.count("*").cast("double")).alias("block")).withColumnRenamed("e", "ts")
    zero = F.lit(0.0)
    b = bars(spark, sf).select("symbol", "ts", F.array(F.col("close"), zero, zero).cast("array<float>").alias("values"), F.array(F.lit(0), F.lit(1), F.lit(1)).cast("array<tinyint>").alias("mask"))
    m = S.merge_views(b, text, 1, 2, max_age=4 * HOUR)
    v = [F.col("values")[k].cast("double") for k in range(3)]
    return m.select("symbol", "ts", r6(v[0], "v0", 2), r6(v[1], "v1", 2), v[2].alias("v2"), F.col("mask")[1].cast("int").alias("m1"), "text_case", "text_lag_sec")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS mismatched, count(*) FILTER (WHERE len(embedding) <> 64) / count(*) > 0.05 AS abort FROM embeddings")
def fx04_dim_audit(spark, sf):
    bad = F.count_if(F.size("embedding") != 64)
    return table(spark, sf, "embeddings").agg(F.count("*").alias("n"), bad.alias("mismatched"), (bad / F.count("*") > 0.05).alias("abort"))


@query(f"WITH {BARS}, f AS (SELECT symbol, ts, close, h, CASE h WHEN '1h' THEN lead(close, 1) OVER w WHEN '4h' THEN lead(close, 4) OVER w ELSE lead(close, 24) OVER w END AS fut FROM bars, (VALUES ('1h'), ('4h'), ('1d')) t(h) WINDOW w AS (PARTITION BY symbol, h ORDER BY ts)) SELECT symbol, ts, h AS horizon, round(ln(fut / close), 6) AS raw, round(ln(fut / close) - sign(ln(fut / close)) * 0.0012, 6) AS net, sign(ln(fut / close))::INT AS direction, round(abs(ln(fut / close)), 6) AS risk FROM f WHERE fut IS NOT NULL")
def fx05_labels(spark, sf):
    l = S.labels(bars(spark, sf).select("symbol", "ts", "close"), {"1h": 1, "4h": 4, "1d": 24}, F.lit(12.0))
    return l.select("symbol", "ts", "horizon", r6(F.col("raw"), "raw"), r6(F.col("net"), "net"), "direction", r6(F.col("risk"), "risk"))


@query(f"WITH {_RET} SELECT symbol, ts, round(stddev_pop(ret) OVER ({_W} ROWS BETWEEN 2 FOLLOWING AND 12 FOLLOWING), 6) AS future_vol, round(min(close) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) / lead(close) OVER ({_W}) - 1, 6) + 0.0 AS future_drawdown FROM r")
def fx06_path_labels(spark, sf):
    return S.path_labels(bars(spark, sf).select("symbol", "ts", "close"), 12).select("symbol", "ts", r6(F.col("future_vol"), "future_vol"), (F.round("future_drawdown", 6) + 0.0).alias("future_drawdown"))


@query(f"WITH {BARS}, z AS (SELECT max(ts) AS z FROM bars), g AS (SELECT DISTINCT symbol, z - {HOUR} * unnest(range(48)) AS ts FROM bars, z) SELECT g.symbol, count(b.ts) AS present, round(count(b.ts) / 48, 6) AS coverage, 48 AS length FROM g LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts = b.ts GROUP BY 1")
def fx07_sequence(spark, sf):
    """The last 48 hours of the table for each symbol."""
    b = bars(spark, sf)
    end = b.agg(F.max("ts").alias("z"))
    grid = b.select("symbol").distinct().crossJoin(F.broadcast(end)).select("symbol", F.explode(F.sequence(F.col("z") - 47 * HOUR, F.col("z"), F.lit(HOUR))).alias("ts"))
    row = F.struct("ts", F.coalesce("close", F.lit(0.0)).alias("close"), F.col("close").isNull().cast("int").alias("missing"))
    seq = grid.join(b.select("symbol", "ts", "close"), ["symbol", "ts"], "left").groupBy("symbol").agg(F.array_sort(F.collect_list(row)).alias("s"))
    present = F.size(F.filter("s", lambda x: x["missing"] == 0)).cast("long")
    return seq.select("symbol", present.alias("present"), r6(present / F.size("s"), "coverage"), F.size("s").alias("length"))


@query(f"WITH {BARS}, n AS (SELECT symbol, ts, row_number() OVER ({_W}) - 1 AS t_idx, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, ts, t_idx FROM n WHERE t_idx + 1 >= 96 AND t_idx + 1 <= n - 24")
def fx08_sample_index(spark, sf):
    found = S.sample_index(bars(spark, sf).select("symbol", "ts"), 96, 24)
    return found.join(S.leaks(found).select("symbol", "ts"), ["symbol", "ts"], "left_anti").select("symbol", "ts", "t_idx")


@query(f"WITH {_RET} SELECT symbol, count(*) AS n, round(count(*) FILTER (WHERE ret IS NULL) / count(*), 6) AS missing_ratio, count(*) >= 600 AS enough FROM r GROUP BY 1")
def fx09_panel_report(spark, sf):
    r = bars(spark, sf).withColumn("ret", R.log_return())
    return r.groupBy("symbol").agg(F.count("*").alias("n"), r6(F.count_if(F.col("ret").isNull()) / F.count("*"), "missing_ratio"), (F.count("*") >= 600).alias("enough"))


@query(f"WITH {_RET}, f AS (SELECT symbol, ts, close, (close / coalesce(lag(close) OVER ({_W}), close) - 1)::FLOAT::DOUBLE AS ret_1, (CASE WHEN rn < 3 THEN 0 ELSE stddev_pop(ret) OVER ({_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END)::FLOAT::DOUBLE AS vol_12, trades % 5 = 0 AS hidden FROM r), v AS (SELECT *, CASE WHEN hidden THEN 0 ELSE vol_12 END AS seen FROM f) SELECT symbol, ts, close, round(ret_1, 5) + 0.0 AS ret_1, hidden::INT AS hidden, round(stddev_pop(ret_1) OVER ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 5) AS realized_vol, round(stddev_pop(seen) OVER ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 5) AS vol_of_vol, hidden::INT AS vol_masked FROM v")
def fx09_panel_store(spark, sf):
    """A panel built in two overlapping ranges, whose rows are those of one build: the second one writes only the days that it touches."""
    b = bars(spark, sf).withColumn("ret", R.log_return())
    f = b.select("symbol", "ts", "close", R.k_return(1).alias("ret_1"), R.realised_vol(12).alias("vol_12"), (F.col("trades") % 5 == 0).cast("byte").alias("hidden"))
    rows = f.select("symbol", "ts", "close", F.array("ret_1", "vol_12").cast("array<float>").alias("values"), F.array(F.lit(0).cast("byte"), F.col("hidden")).alias("mask"))
    store = PanelStore(spark, scratch(spark), ["ret_1", "vol_12"], lookback=24, horizons={"1h": 1, "4h": 4})
    first, last = table(spark, sf, "events").agg(F.min(micros("ts")), F.max(micros("ts"))).first() or (None, None)
    store.build(rows, first - HOUR, first + (last - first) * 3 // 5)
    store.build(rows, first + (last - first) // 2, last)
    v, g = F.col("values"), F.col("regime")
    return store.read().select("symbol", "ts", "close", (F.round(v[0].cast("double"), 5) + 0.0).alias("ret_1"), F.col("mask")[1].cast("int").alias("hidden"), r6(g[0], "realized_vol", 5), r6(g[1], "vol_of_vol", 5), F.col("regime_mask")[0].cast("int").alias("vol_masked"))


_LENGTHS = {"train": 10 * DAY, "val": 3 * DAY, "test": 3 * DAY}
#: Folds from the table's first day to its last, every three days, with a day between their parts.
_FOLD_SQL = f"rng AS (SELECT min(ts) - min(ts) % {DAY} AS a0, max(ts) - max(ts) % {DAY} + {DAY} AS z0 FROM ticks), fold AS (SELECT k::INT AS fold, split, a0 + k * {3 * DAY} + off AS a, a0 + k * {3 * DAY} + off + len AS b FROM rng, (SELECT unnest(range(0, 10000)) AS k), (VALUES ('train', 0, {10 * DAY}), ('val', {11 * DAY}, {3 * DAY}), ('test', {15 * DAY}, {3 * DAY})) s(split, off, len) WHERE a0 + k * {3 * DAY} + {18 * DAY} <= z0)"


def _folds(spark, sf):
    """The fold table is made on the driver, of the first and the last time alone."""
    low, high = table(spark, sf, "events").agg(F.min(micros("ts")), F.max(micros("ts"))).first()
    return [] if low is None else S.walk_forward(low - low % DAY, high - high % DAY + DAY, *_LENGTHS.values(), DAY, 3 * DAY)


@query(f"WITH {BARS}, {_FOLD_SQL} SELECT fold, split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM bars JOIN fold ON ts >= a AND ts < b GROUP BY 1, 2")
def fx10_walk_forward(spark, sf):
    return S.assign_folds(bars(spark, sf), _folds(spark, sf)).groupBy("fold", "split").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"WITH {BARS}, n AS (SELECT symbol, row_number() OVER ({_W}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars), k AS (SELECT symbol, rn, unnest(range(5)) AS fold, n FROM n) SELECT symbol, fold, count(*) FILTER (WHERE rn > fold * n // 5 AND rn <= (fold + 1) * n // 5) AS test, count(*) FILTER (WHERE rn <= fold * n // 5 - 24 OR rn > (fold + 1) * n // 5 + 24) AS train FROM k GROUP BY 1, 2")
def fx11_purged_kfold(spark, sf):
    n = bars(spark, sf).select("symbol", F.row_number().over(R.by()).alias("rn"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    k = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")))
    low, high = F.floor(F.col("fold") * F.col("n") / 5), F.floor((F.col("fold") + 1) * F.col("n") / 5)
    return k.groupBy("symbol", "fold").agg(F.count_if((F.col("rn") > low) & (F.col("rn") <= high)).alias("test"), F.count_if((F.col("rn") <= low - 24) | (F.col("rn") > high + 24)).alias("train"))


@query(f"WITH {BARS}, n AS (SELECT symbol, ts, row_number() OVER ({_W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), k AS (SELECT *, unnest(range(0, greatest(0, (n - 260) // 48 + 1))) AS fold FROM n WHERE n >= 260) SELECT symbol, fold::INT AS fold, CASE WHEN i < fold * 48 + 200 THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM k WHERE i BETWEEN fold * 48 AND fold * 48 + 199 OR i BETWEEN fold * 48 + 212 AND fold * 48 + 259 GROUP BY 1, 2, 3")
def fx11_row_folds(spark, sf):
    f = S.row_folds(bars(spark, sf).select("symbol", "ts"), train=200, test=48, purge=12)
    return f.groupBy("symbol", "fold", "split").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"WITH {PREDICTIONS}, {_FOLD_SQL}, j AS (SELECT fold, split, mu FROM predictions JOIN fold ON ts >= a AND ts < b), s AS (SELECT fold, avg(mu) AS m, stddev_pop(mu) AS d FROM j WHERE split = 'train' GROUP BY 1) SELECT j.fold, count(*) AS n, round(avg((mu - m) / d), 6) AS mean, round(stddev_pop((mu - m) / d), 6) AS std FROM j JOIN s ON j.fold = s.fold WHERE split = 'test' GROUP BY 1")
def fx12_standardise(spark, sf):
    j = S.assign_folds(predictions(spark, sf).select("ts", "mu"), _folds(spark, sf))
    stats = j.where("split = 'train'").groupBy("fold").agg(F.avg("mu").alias("m"), F.stddev_pop("mu").alias("d"))
    z = (F.col("mu") - F.col("m")) / F.col("d")
    return j.where("split = 'test'").join(stats, "fold").groupBy("fold").agg(F.count("*").alias("n"), r6(F.avg(z), "mean"), r6(F.stddev_pop(z), "std"))


@query(f"WITH {PREDICTIONS}, {_FOLD_SQL}, j AS (SELECT fold, split, mu AS a, sigma AS b, y FROM predictions JOIN fold ON ts >= a AND ts < b), g AS (SELECT fold, sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM j WHERE split = 'train' GROUP BY 1) SELECT j.fold, round(any_value((bb * ay - ab * byy) / (aa * bb - ab * ab)), 6) AS w_mu, round(any_value((aa * byy - ab * ay) / (aa * bb - ab * ab)), 6) AS w_sigma, round(avg((y - a * (bb * ay - ab * byy) / (aa * bb - ab * ab) - b * (aa * byy - ab * ay) / (aa * bb - ab * ab)) ** 2), 6) AS mse FROM j JOIN g ON j.fold = g.fold WHERE split = 'test' GROUP BY 1")
def fx13_ridge(spark, sf):
    """Ridge without intercept, one plan for all folds: the normal equations are sums."""
    j = S.assign_folds(predictions(spark, sf).select("ts", F.col("mu").alias("a"), F.col("sigma").alias("b"), "y"), _folds(spark, sf))
    w = S.ridge(j.where("split = 'train'"), ["fold"], ["a", "b"], "y")
    error = F.col("y") - F.col("a") * F.col("weights")[0] - F.col("b") * F.col("weights")[1]
    return j.where("split = 'test'").join(w, "fold").groupBy("fold").agg(r6(F.first(F.col("weights")[0]), "w_mu"), r6(F.first(F.col("weights")[1]), "w_sigma"), r6(F.avg(error * error), "mse"))


@query(f"WITH {_RET} SELECT symbol, ts, round(lead(ret, 4) OVER ({_W}), 6) AS target FROM r")
def fx14_shifted_target(spark, sf):
    return bars(spark, sf).withColumn("ret", R.log_return()).select("symbol", "ts", r6(F.lead("ret", 4).over(R.by()), "target"))


@query(f"WITH {_RET}, d AS (SELECT *, abs(ret - lag(ret) OVER ({_W})) AS d FROM r) SELECT symbol, ts, round(greatest(0.05, least(2.0, coalesce(avg(d) OVER ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 0.05))), 6) AS turnover_base FROM d")
def fx15_turnover_base(spark, sf):
    r = bars(spark, sf).withColumn("ret", R.log_return()).withColumn("d", F.abs(F.col("ret") - F.lag("ret").over(R.by())))
    base = F.greatest(F.lit(0.05), F.least(F.lit(2.0), F.coalesce(F.avg("d").over(R.rows(24)), F.lit(0.05))))
    return r.select("symbol", "ts", r6(base, "turnover_base"))


_EXPECTED = _COSTS + f", k AS (SELECT *, CASE h WHEN 1 THEN '1h' WHEN 4 THEN '4h' WHEN 24 THEN '1d' ELSE '7d' END AS horizon, ({_TOTAL}) / 1e4 AS cost FROM c), e AS (SELECT k.symbol, k.ts, horizon, cost, k.mu / 50 * sqrt(h) AS expected, k.vol / 10 * sqrt(h) AS vol, 0.5 + 0.4 * p_up AS confidence, trades % 3 * 0.08 * k.vol * sqrt(h) AS width FROM k JOIN predictions p ON k.symbol = p.symbol AND k.ts = p.ts JOIN bars b ON k.symbol = b.symbol AND k.ts = b.ts)"


def _expected(spark, sf):
    """Predictions for four horizons with cost, volatility, quantiles and confidence."""
    p = costed(spark, sf).join(bars(spark, sf).select("symbol", "ts", "trades"), ["symbol", "ts"])
    root, h = F.sqrt("h"), F.col("h")
    cost = X.cost_breakdown(F.col("vol"), F.col("liq"), F.col("turnover"), h, F.lit(10.0), F.col("mu") / 1000, F.lit(50_000.0))["total"] / 1e4
    width = F.col("trades") % 3 * 0.08 * F.col("vol") * root
    expected = F.col("mu") / 50 * root
    name = F.when(h == 1, "1h").when(h == 4, "4h").when(h == 24, "1d").otherwise("7d")
    return p.select("symbol", "ts", name.alias("horizon"), expected.alias("expected"), cost.alias("cost"), (F.col("vol") / 10 * root).alias("vol"), (expected - width / 2).alias("p10"), (expected + width / 2).alias("p90"), (0.5 + 0.4 * F.col("p_up")).alias("confidence"))


_BAND = "CASE horizon WHEN '1h' THEN 0.20 WHEN '4h' THEN 0.16 WHEN '1d' THEN 0.10 ELSE 0.08 END::DOUBLE * (1 + least(3, risk / greatest(1e-4, abs(edge) + 1e-4)))"


@query(f"WITH {_EXPECTED}, r AS (SELECT *, expected - cost AS edge, greatest(vol, abs((expected + width / 2) - (expected - width / 2)), 1e-4) AS risk FROM e), s AS (SELECT *, edge / risk AS score, {_BAND} AS band FROM r) SELECT symbol, ts, horizon, round(edge, 6) + 0.0 AS edge, round(risk, 6) AS risk, round(score, 5) + 0.0 AS score, round(band, 5) AS band, CASE WHEN confidence < CASE horizon WHEN '1h' THEN 0.55 WHEN '4h' THEN 0.52 WHEN '1d' THEN 0.50 ELSE 0.48 END THEN 'hold' WHEN score >= band THEN 'buy' WHEN score <= -band THEN 'sell' ELSE 'hold' END AS action FROM s")
def fx16_horizon_signal(spark, sf):
    s = Z.horizon_signal(_expected(spark, sf))
    return s.select("symbol", "ts", "horizon", (F.round("edge", 6) + 0.0).alias("edge"), r6(F.col("risk"), "risk"), (F.round("score", 5) + 0.0).alias("score"), r6(F.col("band"), "band", 5), "action")


#: Snapshots of an account every six hours, with the positions of some symbols.
_ACCOUNT = f"snap AS (SELECT *, ts // {6 * HOUR} AS k FROM (SELECT DISTINCT ts - ts % {6 * HOUR} AS ts FROM ticks)), acc AS (SELECT ts, k % 13 <> 0 AS fresh, 1 + k % 10 / 10.0 AS margin, k % 7 * 40.0 AS free, k % 11 / 12.0 AS rejects, k % 5 * 5.0 AS slip, k % 4 * 0.03 AS vol FROM snap), held AS (SELECT snap.ts, symbol, (k % 5 - 2) / 4.0 AS qty FROM snap, (SELECT DISTINCT symbol FROM ticks) WHERE (k + length(symbol)) % 3 <> 0)"
_RISK = "st AS (SELECT ts, CASE WHEN NOT fresh OR margin < 1.05 OR free < 50 OR rejects > 0.6 THEN 'red' WHEN slip > 15 OR margin < 1.3 OR vol > 0.08 THEN 'yellow' ELSE 'green' END AS regime, CASE WHEN slip > 15 THEN 0.7 ELSE 1 END * CASE WHEN margin < 1.3 THEN 0.5 ELSE 1 END AS ps, CASE WHEN vol > 0.08 THEN 1.5 ELSE 1 END AS bs, concat_ws(',', CASE WHEN NOT fresh THEN 'account_state_stale' END, CASE WHEN margin < 1.05 THEN 'margin_ratio_red' END, CASE WHEN free < 50 THEN 'free_margin_low' END, CASE WHEN rejects > 0.6 THEN 'reject_rate_red' END) AS hard, concat_ws(',', CASE WHEN slip > 15 THEN 'slippage_p90_high' END, CASE WHEN margin < 1.3 THEN 'margin_ratio_yellow' END, CASE WHEN vol > 0.08 THEN 'vol_spike' END) AS soft FROM acc)"


@query(f"WITH {PREDICTIONS}, {_ACCOUNT}, {_RISK}, sc AS (SELECT symbol, ts, greatest(-1, least(1, (0.4 * (mu / 10 - 0.001) / greatest(1e-4, sigma) + 0.3 * (mu / 5 - 0.002) / greatest(1e-4, 2 * sigma) + CASE WHEN sigma > 1 THEN 0.2 * (mu / 2 - 0.005) / greatest(1e-4, 5 * sigma) ELSE 0 END) / CASE WHEN sigma > 1 THEN 0.4 + 0.3 + 0.2 ELSE 0.4 + 0.3 END)) AS base FROM predictions), j AS (SELECT sc.*, st.* EXCLUDE (ts), st.ts AS snapped FROM sc ASOF LEFT JOIN st ON sc.ts >= st.ts), k AS (SELECT j.symbol, j.ts, base * CASE WHEN regime = 'red' THEN 1 ELSE ps END AS target, 0.02 * CASE WHEN regime = 'red' THEN 1 ELSE bs END AS band, coalesce(qty, 0) AS current, regime, CASE WHEN regime = 'red' THEN hard ELSE soft END AS reasons FROM j LEFT JOIN held ON held.ts = snapped AND held.symbol = j.symbol) SELECT symbol, ts, round(target, 6) + 0.0 AS target, round(current, 6) AS current, CASE WHEN abs(target - current) <= band THEN 'hold' WHEN target > current THEN 'buy' ELSE 'sell' END AS action, round(CASE WHEN abs(target - current) <= band THEN 0 ELSE abs(target - current) END, 6) + 0.0 AS qty, round(band, 6) AS band, regime, regime = 'red' AS reduce_only, reasons FROM k")
def fx17_position_intent(spark, sf):
    """Predictions with the account as it was known then: its state of risk, and of its positions those of that snapshot alone."""
    mu, sigma = F.col("mu"), F.col("sigma")

    def of(h1, h4, d1):
        return F.map_from_entries(F.array_compact(F.array(*(F.struct(F.lit(h).alias("h"), c.alias("v")) for h, c in (("1h", h1), ("4h", h4))), F.when(sigma > 1, F.struct(F.lit("1d").alias("h"), d1.alias("v"))))))

    p = predictions(spark, sf).select(F.lit("main").alias("account"), "symbol", "ts", of(mu / 10, mu / 5, mu / 2).alias("mu"), of(sigma, 2 * sigma, 5 * sigma).alias("sigma"), of(F.lit(0.001), F.lit(0.002), F.lit(0.005)).alias("cost"))
    k = F.col("k")
    snap = ticks(spark, sf).select((F.col("ts") - F.pmod("ts", F.lit(6 * HOUR))).alias("ts")).distinct().withColumn("k", F.floor(F.col("ts") / (6 * HOUR)))
    accounts = snap.select(F.lit("main").alias("account"), "ts", (k % 13 != 0).alias("fresh"), F.lit(True).alias("recon_ok"), (1 + k % 10 / 10.0).alias("margin_ratio"), (k % 7 * 40.0).alias("free_margin"), (k % 11 / 12.0).alias("reject_rate"), (k % 5 * 5.0).alias("slippage_p90"), (k % 4 * 0.03).alias("realised_vol"))
    held = snap.withColumn("symbol", F.explode(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))))).where((k + F.length("symbol")) % 3 != 0)
    i = Z.position_intent(p, accounts, held.select(F.lit("main").alias("account"), "ts", "symbol", ((k % 5 - 2) / 4.0).alias("qty")), chunk=7 * DAY)
    return i.select("symbol", "ts", (F.round("target", 6) + 0.0).alias("target"), r6(F.col("current"), "current"), "action", (F.round("qty", 6) + 0.0).alias("qty"), r6(F.col("band"), "band"), "regime", "reduce_only", F.array_join("reasons", ",").alias("reasons"))


_MOVES = f"mv AS (SELECT symbol, ts, close / coalesce(lag(close) OVER ({_W}), close) - 1 AS r1, close / coalesce(lag(close, 12) OVER ({_W}), first_value(close) OVER ({_W})) - 1 AS r12, CASE WHEN stddev_pop(volume) OVER z > 1e-12 THEN (volume - avg(volume) OVER z) / stddev_pop(volume) OVER z ELSE 0 END AS vz FROM bars WINDOW z AS ({_W} ROWS BETWEEN 48 PRECEDING AND CURRENT ROW))"


@query(f"WITH {PREDICTIONS}, {_MOVES} SELECT p.symbol, CASE WHEN p.ts // {DAY} % 9 = 0 THEN 'event' WHEN abs(tanh(r12 / 100 * 8 + r1 / 1000 * 3 + mu / 10 * 2)) > 0.35 AND p_up > 0.55 AND abs(vz) < 1.2 THEN 'trend' WHEN abs(r1 / 1000) + abs(r12 / 100) < 0.004 AND p_up > 0.6 AND abs(vz) < 1.2 THEN 'mean_reversion' ELSE 'event' END AS bucket, count(*) AS n FROM predictions p JOIN mv ON p.symbol = mv.symbol AND p.ts = mv.ts GROUP BY 1, 2")
def fx18_strategy_bucket(spark, sf):
    moves = bars(spark, sf).select("symbol", "ts", R.k_return(1).alias("r1"), R.k_return(12).alias("r12"), R.zscore("volume", 49).alias("vz"))
    p = predictions(spark, sf).join(moves, ["symbol", "ts"])
    track = F.when(F.floor(F.col("ts") / DAY) % 9 == 0, "vc").otherwise("liquid")
    label = Z.strategy_bucket(track, F.col("mu") / 10, F.col("p_up"), F.col("r1") / 1000, F.col("r12") / 100, F.col("vz"))
    return p.groupBy("symbol", label.alias("bucket")).agg(F.count("*").alias("n"))


_FILL_FOLD = "list_reduce(list({'q': q, 'p': p, 'held': q, 'cost': CASE WHEN q = 0 THEN 0 ELSE p END, 'real': 0.0::DOUBLE} ORDER BY ts, order_id, line), lambda s, x: {'q': x.q, 'p': x.p, 'held': s.held + x.q, 'cost': CASE WHEN s.held + x.q = 0 THEN 0 WHEN s.held = 0 OR (s.held > 0) = (x.q > 0) THEN (s.cost * abs(s.held) + x.p * abs(x.q)) / abs(s.held + x.q) WHEN (s.held + x.q > 0) <> (s.held > 0) THEN x.p ELSE s.cost END, 'real': CASE WHEN s.held = 0 OR (s.held > 0) = (x.q > 0) THEN s.real ELSE s.real + least(abs(s.held), abs(x.q)) * CASE WHEN s.held > 0 THEN 1 ELSE -1 END * (x.p - s.cost) END})"


@query(f"WITH {FILLS}, f AS (SELECT *, CASE WHEN side = 'buy' THEN qty ELSE -qty END AS q, price AS p FROM fills WHERE status = 'filled'), s AS (SELECT account, target, {_FILL_FOLD} AS s FROM f GROUP BY 1, 2) SELECT account, target, s.held AS qty, round(s.cost, 6) AS avg_cost, round(s.real, 4) + 0.0 AS realised, round((s.p - s.cost) * s.held, 4) + 0.0 AS unrealised FROM s")
def fx19_positions(spark, sf):
    f = fills(spark, sf).where("status = 'filled'").withColumn("qty", F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty")))
    p = S.positions(f, ["account", "target"], ["ts", "order_id", "line"])
    return p.select("account", "target", "qty", r6(F.col("avg_cost"), "avg_cost"), (F.round("realised", 4) + 0.0).alias("realised"), (F.round("unrealised", 4) + 0.0).alias("unrealised"))


_ROW_METRICS = (*S.MARKET, *S.DERIVATIVES)
_KRET = f"close / coalesce(lag(close, {{k}}) OVER ({_W}), first_value(close) OVER ({_W})) - 1"
_PRICE_ROW = f", pb AS (SELECT symbol, ts, close, volume, ret, rn, " + ", ".join(f"{_KRET.format(k=k)} AS r{k}" for k in (1, 3, 12, 48, 96, 288)) + ", " + ", ".join(f"coalesce(stddev_pop(ret) OVER ({_W} ROWS BETWEEN {k - 1} PRECEDING AND 1 PRECEDING), 0) AS s{k}" for k in (3, 12, 48, 96, 288)) + f", (volume - avg(volume) OVER z) / greatest(stddev_pop(volume) OVER z, 1e-6) AS vz FROM r WINDOW z AS ({_W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), f0 AS (SELECT * FROM pb WHERE rn > 96)"
_METRIC_TABLES = "".join(f", q{k} AS (SELECT symbol, ts, last(price ORDER BY id) / {1000 if name == 'basis_rate' else 100}.0 AS v FROM ticks WHERE id % 10 = {k} GROUP BY 1, 2)" for k, name in enumerate(_ROW_METRICS))
_METRIC_JOINS = "".join(f", f{k + 1} AS (SELECT f{k}.*, q{k}.v AS q{k} FROM f{k} ASOF LEFT JOIN q{k} ON f{k}.symbol = q{k}.symbol AND f{k}.ts >= q{k}.ts)" for k in range(9))
_SHAPED = ["coalesce(q0, 0)", "coalesce(q1, 0)", "tanh(coalesce(q2, 0) / 1e6)", *(f"tanh(ln(greatest(1e-9, coalesce(q{k}, 0))))" for k in range(3, 7)), "tanh(25 * coalesce(q7, 0))", "tanh(5 * coalesce(q8, 0))"]
_PLACES = [*(f"r{k}" for k in (1, 3, 12, 48, 96, 288)), *(f"s{k}" for k in (3, 12, 48, 96, 288)), "r1 - r3", "r3 - r12", "r12 - r48", "s3 - s12", "s12 - s48", "s48 - s288", "ln(1 + greatest(volume, 0))", "vz", "abs(r1) / sqrt(greatest(1, volume))", *_SHAPED, "event_decay", *(f"(q{k} IS NULL)::INT" for k in range(9)), *S.PROFILE]


@query(f"WITH {_PROFILE}, {_RET.removeprefix('WITH ').removeprefix(TICKS + ', ')}{_PRICE_ROW}{_METRIC_TABLES}{_METRIC_JOINS} SELECT f9.symbol, f9.ts, " + ", ".join(f"round(({c})::DOUBLE + 3e-7, 5) + 0.0 AS v{k:02d}" for k, c in enumerate(_PLACES)) + " FROM f9 JOIN prof ON f9.symbol = prof.symbol AND f9.ts = prof.ts")
def wn06_feature_row(spark, sf):
    """The 61 values at every sixth hour, where the event profile is; moved off the borders of rounding, on which many of its shares lie."""
    t = ticks(spark, sf)
    names = F.array(*map(F.lit, _ROW_METRICS))
    k = F.col("id") % 10
    metrics = t.where(k < 9).select("symbol", "ts", "id", F.element_at(names, (k + 1).cast("int")).alias("metric"), (F.col("price") / F.when(k == 7, 1000.0).otherwise(100.0)).alias("value"))
    rows = S.feature_row(bars(spark, sf).select("symbol", "ts", "close", "volume"), metrics, event_profile_at(spark, sf)[1])
    return rows.select("symbol", "ts", *((F.round(F.col("values")[j] + 3e-7, 5) + 0.0).alias(f"v{j:02d}") for j in range(len(_PLACES))))

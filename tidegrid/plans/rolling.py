"""Window functions and rolling features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import rolling as R
from ..sources.fixtures import BARS, DAY, FILLS, HOUR, PREDICTIONS, TICKS, bars, fills, predictions, ticks
from .registry import query

_W = "PARTITION BY symbol ORDER BY ts"
_ROWS = lambda n, end="CURRENT ROW": f"({_W} ROWS BETWEEN {n} PRECEDING AND {end})"
_RET = BARS + f", r AS (SELECT *, ln(close / lag(close) OVER ({_W})) AS ret, row_number() OVER ({_W}) AS rn FROM bars)"


def _ret(spark, sf):
    return bars(spark, sf).withColumn("ret", R.log_return())


def r6(c, name):
    return F.round(c, 6).alias(name)


_KS = (1, 3, 12, 48, 96, 288)


@query(f"WITH {BARS} SELECT symbol, ts, " + ", ".join(f"round(close / coalesce(lag(close, {k}) OVER ({_W}), first_value(close) OVER ({_W})) - 1, 6) AS ret_{k}" for k in _KS) + " FROM bars")
def wn01_returns(spark, sf):
    return bars(spark, sf).select("symbol", "ts", *(r6(R.k_return(k), f"ret_{k}") for k in _KS))


@query(f"WITH {_RET} SELECT symbol, ts, " + ", ".join(f"round(CASE WHEN rn < 3 THEN 0 ELSE stddev_pop(ret) OVER {_ROWS(k - 1)} END, 6) AS vol_{k}" for k in (12, 48, 96)) + " FROM r")
def wn02_realised_vol(spark, sf):
    return _ret(spark, sf).select("symbol", "ts", *(r6(R.realised_vol(k), f"vol_{k}") for k in (12, 48, 96)))


@query(f"WITH {_RET} SELECT symbol, ts, round(CASE WHEN stddev_pop(volume) OVER w > 1e-12 THEN (volume - avg(volume) OVER w) / stddev_pop(volume) OVER w ELSE 0 END, 6) AS volume_z, round(ln(1 + volume), 6) AS log_volume, round(abs(close / coalesce(lag(close) OVER ({_W}), close) - 1) / sqrt(greatest(1, volume)), 6) AS impact FROM r WINDOW w AS {_ROWS(48)}")
def wn03_volume(spark, sf):
    return _ret(spark, sf).select("symbol", "ts", r6(R.zscore("volume", 49), "volume_z"), r6(F.log1p("volume"), "log_volume"), r6(R.volume_impact(), "impact"))


def _ewm_sql(span, n, c="close"):
    a = 2 / (span + 1)
    values = f"list({c}) OVER {_ROWS(n - 1)}"
    return f"list_reduce(list_prepend({c}, {values}), lambda acc, x: acc * {1 - a!r} + x * {a!r})"


@query(f"WITH {BARS} SELECT symbol, ts, round({_ewm_sql(12, 97)}, 6) AS ewm_12, round({_ewm_sql(48, 97)}, 6) AS ewm_48 FROM bars")
def wn04_finite_ewm(spark, sf):
    return bars(spark, sf).select("symbol", "ts", r6(R.finite_ewm("close", 12, 97), "ewm_12"), r6(R.finite_ewm("close", 48, 97), "ewm_48"))


@query(f"WITH {_RET} SELECT symbol, ts, round(ret - lag(ret) OVER ({_W}), 6) AS acceleration, round(stddev_pop(ret) OVER {_ROWS(11)} - stddev_pop(ret) OVER {_ROWS(47)}, 6) AS term FROM r")
def wn05_acceleration(spark, sf):
    r = _ret(spark, sf)
    return r.select("symbol", "ts", r6(F.col("ret") - F.lag("ret").over(R.by()), "acceleration"), r6(F.stddev_pop("ret").over(R.rows(12)) - F.stddev_pop("ret").over(R.rows(48)), "term"))


@query(f"WITH {_RET} SELECT symbol, ts, " + ", ".join(f"round(stddev_pop(ret) OVER {_ROWS(k, '1 PRECEDING')}, 6) AS vol_{k}" for k in (6, 24)) + f", round((volume - avg(volume) OVER {_ROWS(12, '1 PRECEDING')}) / nullif(stddev_pop(volume) OVER {_ROWS(12, '1 PRECEDING')}, 0), 6) AS volume_z FROM r")
def wn06_trailing_row(spark, sf):
    w = R.rows(12, until=-1)
    r = _ret(spark, sf)
    z = (F.col("volume") - F.avg("volume").over(w)) / F.nullif(F.stddev_pop("volume").over(w), F.lit(0.0))
    return r.select("symbol", "ts", *(r6(F.stddev_pop("ret").over(R.rows(k, until=-1)), f"vol_{k}") for k in (6, 24)), r6(z, "volume_z"))


_BOOK = BARS + ", book AS (SELECT symbol, ts, low AS bid_px, high AS ask_px, volume AS bid_sz, trades::DOUBLE AS ask_sz, CASE WHEN trades % 2 = 0 THEN 12.5::DOUBLE END AS spread_bps FROM bars)"


def _book(spark, sf):
    return bars(spark, sf).select("symbol", "ts", F.col("low").alias("bid_px"), F.col("high").alias("ask_px"), F.col("volume").alias("bid_sz"), F.col("trades").cast("double").alias("ask_sz"), F.when(F.col("trades") % 2 == 0, 12.5).alias("spread_bps"))


@query(f"WITH {_BOOK} SELECT symbol, ts, round(coalesce(spread_bps, (ask_px - bid_px) / ((ask_px + bid_px) / 2) * 1e4), 6) AS spread_bps, round((bid_sz - ask_sz) / (bid_sz + ask_sz), 6) AS imbalance, bid_sz + ask_sz AS depth FROM book")
def wn07_microstructure(spark, sf):
    mid = (F.col("ask_px") + F.col("bid_px")) / 2
    depth = F.col("bid_sz") + F.col("ask_sz")
    return _book(spark, sf).select("symbol", "ts", r6(F.coalesce("spread_bps", (F.col("ask_px") - F.col("bid_px")) / mid * 1e4), "spread_bps"), r6((F.col("bid_sz") - F.col("ask_sz")) / depth, "imbalance"), depth.alias("depth"))


@query(f"WITH {TICKS} SELECT id, round(tanh(ln(greatest(1e-9, price))), 6) AS level, round(tanh(25 * price / 1e4), 6) AS rate, round(tanh(5 * price / 1e3), 6) AS ratio, round(tanh(price * size / 1e6), 6) AS flow FROM ticks")
def wn08_transforms(spark, sf):
    p = F.col("price")
    return ticks(spark, sf).select("id", r6(F.tanh(F.log(F.greatest(F.lit(1e-9), p))), "level"), r6(F.tanh(25 * p / 1e4), "rate"), r6(F.tanh(5 * p / 1e3), "ratio"), r6(F.tanh(p * F.col("size") / 1e6), "flow"))


_PACK = 24
_EW = 2 / (_PACK + 1)


@query(f"""WITH {_RET}, k AS (SELECT symbol, ts, ret, row_number() OVER ({_W}) AS rn FROM r WHERE ret IS NOT NULL), p AS (SELECT *, lag(ret) OVER ({_W}) AS prev FROM k),
f AS (SELECT *, list(ret) OVER w AS seg, avg(ret) OVER w AS mean, stddev_pop(ret) OVER w AS std, min(ret) OVER w AS low, max(ret) OVER w AS high, quantile_cont(ret, 0.1) OVER w AS q10, quantile_cont(ret, 0.9) OVER w AS q90, corr(ret, prev) OVER v AS ac, stddev_pop(prev) OVER v AS da, stddev_pop(CASE WHEN prev IS NOT NULL THEN ret END) OVER v AS db FROM p WINDOW w AS {_ROWS(_PACK - 1)}, v AS {_ROWS(_PACK - 2)}),
e AS (SELECT *, list_transform(range(1, len(seg) + 1), lambda i: list_reduce(seg[1:i], lambda acc, x: {_EW!r} * x + {1 - _EW!r} * acc)) AS ew FROM f)
SELECT symbol, ts, round(mean, 6) + 0.0 AS mean_24, round(std, 6) AS std_24, round(low, 6) AS min_24, round(high, 6) AS max_24, round(ret, 6) AS last_24, round((ret - mean) / greatest(std, 1e-9), 4) + 0.0 AS zscore_24, round(ew[-1], 6) AS ewm_mean_24, round(list_stddev_pop(ew), 6) AS ewm_std_24, round(CASE WHEN rn > 2 AND da > 1e-12 AND db > 1e-12 THEN ac ELSE 0 END, 5) AS autocorr1_24, round(q10, 6) AS quantile_10_24, round(q90, 6) AS quantile_90_24 FROM e""")
def wn09_stats_pack(spark, sf):
    packed = R.with_stats(_ret(spark, sf).select("symbol", "ts", "ret"), "ret", (_PACK,))
    digits = {"zscore_24": 4, "autocorr1_24": 5}
    return packed.select("symbol", "ts", *((F.round(c, digits.get(c, 6)) + 0.0).alias(c) for c in packed.columns if c.endswith("_24")))


_REG = BARS + f""", i0 AS (SELECT *, ln(close / lag(close) OVER ({_W})) AS lr, row_number() OVER ({_W}) AS rn FROM bars),
i AS (SELECT symbol, ts, close / coalesce(lag(close) OVER ({_W}), close) - 1 AS ret_1, CASE WHEN rn < 3 THEN 0 ELSE stddev_pop(lr) OVER {_ROWS(11)} END AS vol_12, CASE WHEN trades % 3 <> 0 THEN least(35.0, greatest(1.5, 1.5 + abs(ln(close / open)) * 2800 + 8 / greatest(1, ln(2 + volume)))) END AS spread, volume * 2 AS depth, greatest(-0.95, least(0.95, tanh(2 * (close - open) / greatest(high - low, close * 0.0005)))) AS imb, (close - open) / close AS funding, CASE WHEN trades % 2 = 0 THEN volume END AS oi, close / coalesce(lag(close, 48) OVER ({_W}), first_value(close) OVER ({_W})) - 1 AS ret_48, close / coalesce(lag(close, 288) OVER ({_W}), first_value(close) OVER ({_W})) - 1 AS ret_288, least(1, trades / 20) AS cov, trades AS n, rn FROM i0),
z AS (SELECT * REPLACE (coalesce(spread, 0) AS spread, coalesce(oi, 0) AS oi), (spread IS NULL)::INT AS sm, (oi IS NULL)::INT AS om FROM i),
y AS (SELECT *, stddev_pop(ret_1) OVER {_ROWS(23)} AS vol, stddev_pop(vol_12) OVER {_ROWS(23)} AS vv, avg(ret_1) OVER s AS m1, avg(ret_1 ** 2) OVER s AS m2, avg(ret_1 ** 3) OVER s AS m3, (funding - avg(funding) OVER f) / greatest(1e-8, stddev_pop(funding) OVER f) AS fz, oi - coalesce(lag(oi) OVER ({_W}), oi) AS change FROM z WINDOW s AS {_ROWS(47)}, f AS {_ROWS(95)})"""


@query(f"WITH {_REG} SELECT symbol, ts, round(vol, 6) AS r0, round(vv, 6) AS r1, round(CASE WHEN rn >= 3 AND m2 - m1 * m1 > 1e-14 THEN (m3 - 3 * m1 * m2 + 2 * m1 ** 3) / (m2 - m1 * m1) ** 1.5 ELSE 0 END, 4) + 0.0 AS r2, round(spread, 5) AS r3, round(ln(1 + depth), 6) AS r4, round(imb, 6) + 0.0 AS r5, round(funding, 6) + 0.0 AS r6, round(fz, 4) + 0.0 AS r7, 0.0::DOUBLE AS r8, oi::DOUBLE AS r9, change::DOUBLE + 0.0 AS r10, round(greatest(0, -change) * (1 + spread) * (1 + vol), 4) AS r11, round(0.6 * ret_48 + 0.4 * ret_288, 6) + 0.0 AS r12, cov::DOUBLE AS r13, 0.0::DOUBLE AS r14, n::DOUBLE AS r15, sm AS m3, om AS m9, greatest(sm, om) AS m11, 2 + sm + om * 2 + greatest(sm, om) AS masked FROM y")
def wn10_regime(spark, sf):
    b = bars(spark, sf).withColumn("ret", R.log_return())
    book = E.proxy_book(*(F.col(c) for c in ("open", "high", "low", "close", "volume")))
    n = F.col("trades")
    rows = b.select("symbol", "ts", R.k_return(1).alias("ret_1"), R.realised_vol(12).alias("vol_12"), F.when(n % 3 != 0, book["spread_bps"]).alias("orderbook_spread_bps"), (F.col("volume") * 2).alias("orderbook_depth_total"), book["imbalance"].alias("orderbook_imbalance"), ((F.col("close") - F.col("open")) / F.col("close")).alias("funding_rate"), F.when(n % 2 == 0, F.col("volume")).alias("open_interest"), R.k_return(48).alias("ret_48"), R.k_return(288).alias("ret_288"), F.least(F.lit(1.0), n / 20).alias("text_coverage"), n.alias("event_count_1h"))
    x = R.regime_features(rows)
    digits = {2: 4, 3: 5, 7: 4, 11: 4}
    masked = F.aggregate("regime_mask", F.lit(0), lambda s, m: s + m.cast("int"))
    return x.select("symbol", "ts", *((F.round(F.col("regime")[k], digits.get(k, 6)) + 0.0).alias(f"r{k}") for k in range(16)), *(F.col("regime_mask")[k].cast("int").alias(f"m{k}") for k in (3, 9, 11)), masked.alias("masked"))


@query(f"WITH {FILLS} SELECT target, ts, order_id, line, rn FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts DESC, order_id DESC, line DESC) AS rn FROM fills) WHERE rn <= 2")
def wn11_latest_two(spark, sf):
    w = Window.partitionBy("target").orderBy(F.desc("ts"), F.desc("order_id"), F.desc("line"))
    return fills(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("target", "ts", "order_id", "line", "rn")


@query(f"WITH {TICKS} SELECT DISTINCT ON (user_id) user_id, id, ts, price FROM ticks ORDER BY user_id, ts DESC, id DESC")
def wn12_latest_per_key(spark, sf):
    latest = ticks(spark, sf).groupBy("user_id").agg(F.max_by(F.struct("id", "ts", "price"), F.struct("ts", "id")).alias("r"))
    return latest.select("user_id", "r.*")


def _span(t):
    """The first and the last time of the table, 0 where it is empty."""
    low, high = t.agg(F.min("ts"), F.max("ts")).first()
    return low or 0, high or 0


@query(f"WITH {TICKS}, span AS (SELECT min(ts) - min(ts) % {HOUR} AS a, max(ts) - max(ts) % {HOUR} AS z FROM ticks), b AS (SELECT DISTINCT symbol, user_id, ts - ts % {HOUR} AS b FROM ticks), k AS (SELECT DISTINCT symbol, user_id FROM b), e AS (SELECT * FROM b UNION ALL SELECT symbol, user_id, a - {HOUR} FROM k, span UNION ALL SELECT symbol, user_id, z + {HOUR} FROM k, span), n AS (SELECT symbol, user_id, b, lead(b) OVER (PARTITION BY symbol, user_id ORDER BY b) AS nx FROM e) SELECT symbol, user_id, b + {HOUR} AS gap_start, nx - {HOUR} AS gap_end, ((nx - b) // {HOUR} - 1)::BIGINT AS missing FROM n WHERE nx - b > {HOUR}")
def wn13_gaps(spark, sf):
    # By symbol and user, whose hours are sparse at any size of the table.
    t = ticks(spark, sf)
    start, end = _span(t)
    return R.gaps(t, start - start % HOUR, end - end % HOUR, HOUR, ("symbol", "user_id"))


@query(f"WITH {TICKS}, p AS (SELECT symbol, CASE WHEN ts % {HOUR} = 0 THEN ts ELSE ts - ts % {HOUR} + {HOUR} END AS b, last(price ORDER BY ts, id) AS value FROM ticks GROUP BY 1, 2), g AS (SELECT symbol, unnest(range(min(b), (SELECT max(b) FROM p) + 1, {HOUR})) AS ts FROM p GROUP BY 1) SELECT g.symbol, g.ts, value FROM g ASOF JOIN p ON g.symbol = p.symbol AND g.ts >= p.b")
def wn14_forward_fill(spark, sf):
    t = ticks(spark, sf)
    end = _span(t)[1]
    return R.fill_grid(t.withColumnRenamed("price", "value"), end + -end % HOUR, HOUR, chunk=7 * DAY)


@query(f"WITH {TICKS}, f AS (SELECT user_id, ts, id, price, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, id) AS next_ts FROM ticks WHERE symbol = 'signup') SELECT user_id, id, next_ts, count(*) AS steps FROM (SELECT *, unnest(range(ts, coalesce(next_ts, ts + 1), {8 * HOUR})) AS step FROM f) GROUP BY 1, 2, 3")
def wn15_funding(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    f = ticks(spark, sf).where("symbol = 'signup'").withColumn("next_ts", F.lead("ts").over(w))
    steps = f.select("user_id", "id", "next_ts", F.explode(F.sequence("ts", F.coalesce(F.col("next_ts") - 1, F.col("ts")), F.lit(8 * HOUR))).alias("step"))
    return steps.groupBy("user_id", "id", "next_ts").agg(F.count("*").alias("steps"))


_PNL = PREDICTIONS + ", pnl AS (SELECT symbol, ts, sign(mu) AS pos, y, sign(mu) * y AS ret FROM predictions)"


def _pnl(spark, sf):
    return predictions(spark, sf).select("symbol", "ts", F.signum("mu").alias("pos"), "y", (F.signum("mu") * F.col("y")).alias("ret"))


@query(f"WITH {_PNL}, s AS (SELECT symbol, ts, ret * 0.01 AS r FROM pnl), e AS (SELECT symbol, ts, exp(sum(ln(1 + r)) OVER ({_W})) AS equity FROM s), d AS (SELECT *, equity / max(equity) OVER ({_W}) - 1 AS dd FROM e) SELECT symbol, round(last(equity ORDER BY ts), 6) AS final, round(min(dd), 6) AS max_drawdown FROM d GROUP BY 1")
def wn16_drawdown(spark, sf):
    e = R.equity(_pnl(spark, sf).withColumn("ret", F.col("ret") * 0.01), chunk=7 * DAY)
    return e.groupBy("symbol").agg(F.round(F.max_by("equity", "ts"), 6).alias("final"), F.round(F.min("drawdown"), 6).alias("max_drawdown"))


@query(f"WITH {_PNL}, t AS (SELECT *, CASE WHEN mu > 0.5 THEN 1 ELSE 0 END AS hold FROM (SELECT symbol, ts, mu FROM predictions)), u AS (SELECT symbol, ts, hold, abs(hold - coalesce(lag(hold) OVER ({_W}), 0)) AS turn, sum(1 - hold) OVER ({_W}) AS island FROM t), i AS (SELECT symbol, island, sum(hold) AS run FROM u GROUP BY 1, 2 HAVING sum(hold) > 0) SELECT symbol, (SELECT sum(turn) FROM u WHERE u.symbol = i.symbol)::BIGINT AS turnover, round(avg(run), 6) AS holding FROM i GROUP BY 1")
def wn17_turnover(spark, sf):
    p = predictions(spark, sf).select("symbol", "ts", (F.col("mu") > 0.5).cast("long").alias("hold"))
    island = F.sum(1 - F.col("hold")).over(R.by())
    u = p.withColumn("turn", F.abs(F.col("hold") - F.coalesce(F.lag("hold").over(R.by()), F.lit(0)))).withColumn("island", island)
    runs = u.groupBy("symbol", "island").agg(F.sum("hold").alias("run"), F.sum("turn").alias("turn"))
    return runs.groupBy("symbol").agg(F.sum("turn").alias("turnover"), F.round(F.avg(F.when(F.col("run") > 0, F.col("run"))), 6).alias("holding"))


@query(f"WITH {_PNL}, n AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM pnl) SELECT symbol, coalesce(min(rn) FILTER (WHERE ret >= 0) - 1, count(*)) AS streak FROM n GROUP BY 1")
def wn18_loss_streak(spark, sf):
    n = _pnl(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))))
    return n.groupBy("symbol").agg(F.coalesce(F.min(F.when(F.col("ret") >= 0, F.col("rn"))) - 1, F.count("*")).cast("long").alias("streak"))


@query(f"WITH {_PNL}, c AS (SELECT symbol, ts, ts // {DAY} AS day, sum(ret) OVER (PARTITION BY symbol, ts // {DAY} ORDER BY ts) AS cum FROM pnl), d AS (SELECT *, max(cum) OVER (PARTITION BY symbol, day ORDER BY ts) - cum AS dd FROM c) SELECT symbol, day, round(max(dd), 6) AS drawdown FROM d GROUP BY 1, 2")
def wn19_intraday_drawdown(spark, sf):
    w = Window.partitionBy("symbol", "day").orderBy("ts")
    p = _pnl(spark, sf).withColumn("day", F.floor(F.col("ts") / DAY)).withColumn("cum", F.sum("ret").over(w))
    return p.withColumn("dd", F.max("cum").over(w) - F.col("cum")).groupBy("symbol", "day").agg(F.round(F.max("dd"), 6).alias("drawdown"))


@query(f"WITH {_RET}, g AS (SELECT symbol, ts, avg(ret) OVER w AS m, stddev_pop(ret) OVER w AS s, count(ret) OVER w AS n FROM r WINDOW w AS {_ROWS(96, '1 PRECEDING')}) SELECT symbol, CASE WHEN n < 2 THEN 'sideways' WHEN m > greatest(8e-4, 0.35 * s) THEN 'bull' WHEN m < -greatest(8e-4, 0.35 * s) THEN 'bear' ELSE 'sideways' END AS regime, count(*) AS n FROM g GROUP BY 1, 2")
def wn20_regime_label(spark, sf):
    w = R.rows(96, until=-1)
    g = _ret(spark, sf).select("symbol", F.avg("ret").over(w).alias("m"), F.stddev_pop("ret").over(w).alias("s"), F.count("ret").over(w).alias("k"))
    band = F.greatest(F.lit(8e-4), 0.35 * F.col("s"))
    label = F.when(F.col("k") < 2, "sideways").when(F.col("m") > band, "bull").when(F.col("m") < -band, "bear").otherwise("sideways")
    return g.groupBy("symbol", label.alias("regime")).agg(F.count("*").alias("n"))


@query(f"WITH {_RET}, l AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM r) SELECT symbol, count(*) AS prices, round(max(abs(ret)), 6) AS worst, count(*) >= 32 AND max(abs(ret)) > 0.08 AS tripped FROM l WHERE k <= 96 GROUP BY 1")
def wn21_breaker(spark, sf):
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    last = _ret(spark, sf).withColumn("k", k).where("k <= 96").groupBy("symbol").agg(F.count("*").alias("prices"), F.max(F.abs("ret")).alias("w"))
    return last.select("symbol", "prices", r6(F.col("w"), "worst"), ((F.col("prices") >= 32) & (F.col("w") > 0.08)).alias("tripped"))


@query(f"WITH {PREDICTIONS}, k AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY mu, ts) AS a, row_number() OVER (PARTITION BY symbol ORDER BY y, ts) AS b FROM predictions) SELECT symbol, round(corr(a, b), 6) AS ic FROM k GROUP BY 1")
def wn22_spearman(spark, sf):
    rank = lambda c: F.row_number().over(Window.partitionBy("symbol").orderBy(c, "ts")).cast("double")
    k = predictions(spark, sf).select("symbol", rank("mu").alias("a"), rank("y").alias("b"))
    return k.groupBy("symbol").agg(F.round(F.corr("a", "b"), 6).alias("ic"))


_NEXT = {"signup": ("view", "click"), "view": ("view", "click", "purchase", "error"), "click": ("view", "click", "purchase"), "purchase": ("view", "click"), "error": ("view",)}


@query(f"WITH {TICKS}, s AS (SELECT user_id, symbol AS state, lag(symbol) OVER (PARTITION BY user_id ORDER BY ts, id) AS prev FROM ticks), a(f, t) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in _NEXT.items() for b in bs) + ") SELECT prev, state, count(*) AS n FROM s WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE f = prev AND t = state) GROUP BY 1, 2")
def wn23_illegal_transitions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    s = ticks(spark, sf).select(F.col("symbol").alias("state"), F.lag("symbol").over(w).alias("prev")).where("prev IS NOT NULL")
    allowed = spark.createDataFrame([(a, b) for a, bs in _NEXT.items() for b in bs], "prev string, state string")
    return s.join(allowed, ["prev", "state"], "left_anti").groupBy("prev", "state").agg(F.count("*").alias("n"))

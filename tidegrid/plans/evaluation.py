"""Evaluation, drift, parity and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import evaluate as E
from ..operators import rolling as R
from ..operators import sizing as Z
from ..operators.order import quantiles, written
from ..sources.fixtures import BARS, DAY, FILLS, PREDICTIONS, TICKS, bars, fills, predictions, table, ticks
from .registry import query
from .scalars import _COSTS, _PARTS, _TOTAL, costed

_T0 = 1_704_067_200_000_000
_CUT = _T0 + 15 * DAY
_W = "PARTITION BY symbol ORDER BY ts"


def r6(c, name, n=6):
    return F.round(c, n).alias(name)


def _z(c, name, n=6):
    return (F.round(c, n) + 0.0).alias(name)


@query(f"""WITH {PREDICTIONS}, d AS (SELECT symbol, ts, mu, sigma, p_up, y, y - sign(y) * 0.0012 AS net, greatest(-1, least(1, mu / greatest(sigma, 1e-6))) AS pos FROM predictions),
e AS (SELECT *, coalesce(lag(pos) OVER ({_W}), 0) AS prev, row_number() OVER (PARTITION BY symbol ORDER BY mu, ts) AS rm, row_number() OVER (PARTITION BY symbol ORDER BY net, ts) AS ry FROM d),
c AS (SELECT symbol, (5 + 3 * 1.6 + 2 * (1 + 0.3 * avg(abs(pos - prev))) * (1 + 0.5 * avg(abs(y)))) / 1e4 AS cost FROM e GROUP BY 1),
p AS (SELECT e.*, pos * y - abs(pos - prev) * cost AS pnl FROM e JOIN c ON e.symbol = c.symbol),
q AS (SELECT *, CASE WHEN max((pnl <= -1)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN pnl > -1 THEN ln(1 + pnl) ELSE 0 END) OVER w) END AS curve FROM p WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN max(curve) OVER w > 0 THEN curve / max(curve) OVER w - 1 ELSE -1 END AS dd FROM q WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)),
b AS (SELECT symbol, least(floor(p_up * 10), 9) AS bin, count(*) AS n, avg(p_up) AS p, avg((net >= 0)::INT) AS h FROM f GROUP BY 1, 2), x AS (SELECT symbol, sum(n * abs(p - h)) / sum(n) AS ece FROM b GROUP BY 1)
SELECT f.symbol, count(*) AS n, round(avg((mu - net) ** 2), 6) AS mse, round(avg(abs(mu - net)), 6) AS mae, round(corr(rm, ry), 6) AS spearman_ic, round(avg((sign(mu) = sign(net))::INT), 6) AS hit_rate, round(avg(pnl) / greatest(1e-9, stddev_pop(pnl)), 6) AS sharpe, round(abs(min(dd)), 6) AS max_drawdown, round(avg(abs(pos - prev)), 6) AS turnover, round(count(*) FILTER (WHERE abs(pos) > 1e-9) / greatest(1, count(*) FILTER (WHERE abs(pos) > 1e-9 AND abs(prev) <= 1e-9)), 6) AS avg_holding, round(avg((p_up - (net >= 0)::INT) ** 2), 6) AS brier, round(any_value(ece), 6) AS ece, round(avg((net BETWEEN mu - 1.2816 * sigma AND mu + 1.2816 * sigma)::INT), 6) AS coverage FROM f JOIN x ON f.symbol = x.symbol GROUP BY 1""")
def ev01_metric_pack(spark, sf):
    p = predictions(spark, sf)
    spread = 1.2816 * F.col("sigma")
    d = p.select("symbol", "ts", "mu", "sigma", "p_up", F.col("y").alias("y_raw"), (F.col("y") - F.signum("y") * 0.0012).alias("y_net"), (F.col("mu") - spread).alias("q_low"), (F.col("mu") + spread).alias("q_high"))
    m = E.metric_pack(d, ["symbol"])
    return m.select("symbol", "n", *(r6(F.col(c), c) for c in m.columns if c not in ("symbol", "n")))


@query(f"WITH {PREDICTIONS}, b AS (SELECT symbol, least(floor(p_up * 10), 9) AS bin, count(*) AS n, avg(p_up) AS p, avg((y > 0)::INT) AS h FROM predictions GROUP BY 1, 2) SELECT symbol, round(sum(n * abs(p - h)) / sum(n), 6) AS ece FROM b GROUP BY 1")
def ev02_calibration_error(spark, sf):
    p = predictions(spark, sf).withColumn("up", (F.col("y") > 0).cast("int"))
    return E.calibration_error(p, ["symbol"], "p_up", "up").select("symbol", r6(F.col("ece"), "ece"))


_F = "PARTITION BY symbol, fold ORDER BY ts"


@query(f"""WITH {PREDICTIONS}, d AS (SELECT symbol, ts // {7 * DAY} AS fold, ts, mu, y, sign(mu) AS s FROM predictions), e AS (SELECT *, abs(s - coalesce(lag(s) OVER ({_F}), 0)) AS t FROM d),
c AS (SELECT symbol, fold, 5 + 3 * 1.6 + 2 * (1 + 0.3 * avg(t)) * (1 + 0.5 * avg(abs(y))) AS cost FROM e GROUP BY 1, 2), p AS (SELECT e.*, s * y - t * cost / 1e4 AS ret FROM e JOIN c ON e.symbol = c.symbol AND e.fold = c.fold),
q AS (SELECT *, CASE WHEN max((ret <= -1)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN ret > -1 THEN ln(1 + ret) ELSE 0 END) OVER w) END AS curve FROM p WINDOW w AS ({_F} ROWS UNBOUNDED PRECEDING)), x AS (SELECT *, CASE WHEN max(curve) OVER w > 0 THEN curve / max(curve) OVER w - 1 ELSE -1 END AS dd FROM q WINDOW w AS ({_F} ROWS UNBOUNDED PRECEDING)),
f AS (SELECT symbol, fold, CASE WHEN stddev_pop(y) * stddev_pop(mu) > 0 THEN corr(y, mu) ELSE 0 END AS ic, avg((sign(y) = s)::INT) AS hit, avg(t) AS turn, avg(ret) AS pnl, abs(min(dd)) AS dd FROM x GROUP BY 1, 2)
SELECT count(*) AS folds, round(avg(ic), 6) AS ic, round(avg(hit), 6) AS hit_rate, round(avg(turn), 6) AS turnover, round(avg(pnl), 6) AS pnl_after_cost, round(max(dd), 6) AS max_drawdown FROM f""")
def ev03_fold_summary(spark, sf):
    """Folds are the weeks of a symbol."""
    p = predictions(spark, sf).withColumn("fold", F.floor(F.col("ts") / (7 * DAY)))
    f = E.fold_summary(E.fold_metrics(p, ["symbol", "fold"]))
    return f.select("folds", *(r6(F.col(c), c) for c in ("ic", "hit_rate", "turnover", "pnl_after_cost", "max_drawdown")))


@query(f"WITH {PREDICTIONS}, m AS (SELECT quantile_cont(sigma, 0.5) AS med FROM predictions), s AS (SELECT sign(mu) * y AS pnl, unnest([CASE WHEN sigma > med THEN 'high_vol' ELSE 'low_vol' END, CASE WHEN abs(mu / sigma) > 2 THEN 'extreme' END, CASE WHEN mu > 0 THEN 'up' ELSE 'down' END]) AS slice FROM predictions, m) SELECT slice, count(*) AS n, round(avg(pnl), 6) AS pnl FROM s WHERE slice IS NOT NULL GROUP BY 1")
def ev04_regime_slices(spark, sf):
    p = predictions(spark, sf)
    p = p.crossJoin(F.broadcast(quantiles(p, [], "sigma", {"med": 0.5})))
    flags = F.array(F.when(F.col("sigma") > F.col("med"), "high_vol").otherwise("low_vol"), F.when(F.abs(F.col("mu") / F.col("sigma")) > 2, "extreme"), F.when(F.col("mu") > 0, "up").otherwise("down"))
    s = p.select((F.signum("mu") * F.col("y")).alias("pnl"), F.explode(F.array_compact(flags)).alias("slice"))
    return s.groupBy("slice").agg(F.count("*").alias("n"), r6(F.avg("pnl"), "pnl"))


@query(f"WITH {_COSTS} SELECT c.symbol, c.ts, h, round(greatest(-1, least(1, mu / greatest(1e-8, sg))) * yy, 6) + 0.0 AS pnl_raw, " + ", ".join(f"round(({x}) / 1e4, 9) AS {n}" for n, x in _PARTS.items()) + f", round(({_TOTAL}) / 1e4, 9) AS total_cost FROM c JOIN (SELECT symbol AS s2, ts AS t2, sigma AS sg, y AS yy FROM predictions) p ON c.symbol = s2 AND c.ts = t2")
def ev05_pnl_series(spark, sf):
    """A row for each prediction and horizon, its costs by the components of the shared model."""
    d = costed(spark, sf)
    parts = X.cost_breakdown(F.col("vol"), F.col("liq"), F.col("turnover"), F.col("h"), F.lit(10.0), F.col("mu") / 1000, F.lit(50_000.0))
    position = X.clamp(F.col("mu") / F.greatest(F.lit(1e-8), F.col("sigma")), -1.0, 1.0)
    return d.select("symbol", "ts", "h", _z(position * F.col("y"), "pnl_raw"), *(r6(c / 1e4, "total_cost" if n == "total" else n, 9) for n, c in parts.items()))


_GATE = "g AS (SELECT vec_id, unnest([exp(embedding[1]::DOUBLE), exp(embedding[2]::DOUBLE), exp(embedding[3]::DOUBLE)]) AS e, unnest([0, 1, 2]) AS gate FROM embeddings), w AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS w FROM g)"


@query(f"WITH {_GATE} SELECT gate, round(avg(w), 6) AS usage, round(avg(-w * ln(w)), 6) AS entropy, avg(w) > 0.9 AS collapsed FROM w GROUP BY 1")
def ev06_gate_usage(spark, sf):
    e = F.transform(F.slice("embedding", 1, 3), lambda v: F.exp(v.cast("double")))
    g = table(spark, sf, "embeddings").withColumn("e", e).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, v: a + v)).select(F.posexplode(F.transform("e", lambda v: v / F.col("total"))).alias("gate", "w"))
    return g.groupBy("gate").agg(r6(F.avg("w"), "usage"), r6(F.avg(-F.col("w") * F.log("w")), "entropy"), (F.avg("w") > 0.9).alias("collapsed"))


_GRID = "g AS (SELECT 0.5 + unnest(range(46)) * 0.1 AS t)"


@query(f"WITH {PREDICTIONS}, {_GRID}, l AS (SELECT t, round(avg(-ln(greatest(1e-12, CASE WHEN y > 0 THEN 1 / (1 + exp(-mu / sigma / t)) ELSE 1 - 1 / (1 + exp(-mu / sigma / t)) END))), 9) AS nll FROM predictions, g GROUP BY 1), s AS (SELECT sqrt(avg(((y - mu) / sigma) ** 2)) AS sc FROM predictions) SELECT round(arg_min(t, nll), 1)::DOUBLE AS temperature, round(min(nll), 6) AS nll, round(any_value(sc), 6) AS sigma_scale FROM l, s")
def ev07_temperature(spark, sf):
    p = predictions(spark, sf)
    grid = F.transform(F.sequence(F.lit(0), F.lit(45)), lambda k: 0.5 + k * 0.1)
    up = 1 / (1 + F.exp(-F.col("mu") / F.col("sigma") / F.col("t")))
    l = p.withColumn("t", F.explode(grid)).groupBy("t").agg(F.round(F.avg(-F.log(F.greatest(F.lit(1e-12), F.when(F.col("y") > 0, up).otherwise(1 - up)))), 9).alias("nll"))
    scale = p.agg(F.sqrt(F.avg(((F.col("y") - F.col("mu")) / F.col("sigma")) ** 2)).alias("sc"))
    return l.agg(F.round(F.min_by("t", "nll"), 1).alias("temperature"), r6(F.min("nll"), "nll")).crossJoin(scale).select("temperature", "nll", r6(F.col("sc"), "sigma_scale"))


@query(f"WITH {PREDICTIONS}, b AS (SELECT symbol, ntile(5) OVER (PARTITION BY symbol ORDER BY abs(mu / sigma), ts) AS bin, abs(mu / sigma) AS c, (sign(mu) = sign(y))::INT AS hit FROM predictions) SELECT symbol, bin, count(*) AS n, round(avg(c), 6) AS confidence, round(avg(hit), 6) AS hit FROM b GROUP BY 1, 2")
def ev08_confidence_bins(spark, sf):
    c = F.abs(F.col("mu") / F.col("sigma"))
    b = predictions(spark, sf).select("symbol", F.ntile(5).over(Window.partitionBy("symbol").orderBy(c, "ts")).alias("bin"), c.alias("c"), (F.signum("mu") == F.signum("y")).cast("int").alias("hit"))
    return b.groupBy("symbol", "bin").agg(F.count("*").alias("n"), r6(F.avg("c"), "confidence"), r6(F.avg("hit"), "hit"))


_HALVES = TICKS + f", v AS (SELECT symbol, price AS x, ts >= {_CUT} AS new FROM ticks)"
_PSI = _HALVES + ", q AS (SELECT symbol, unnest([" + ", ".join(f"quantile_cont(x, {k / 10})" for k in range(1, 10)) + "]) AS e FROM v WHERE NOT new GROUP BY 1), ed AS (SELECT symbol, list(e) AS edges FROM q GROUP BY 1), c AS (SELECT v.symbol, len(list_filter(edges, lambda e: x > e)) AS bin, count(*) FILTER (WHERE NOT new) AS a, count(*) FILTER (WHERE new) AS b FROM v JOIN ed ON v.symbol = ed.symbol GROUP BY 1, 2), s AS (SELECT symbol, greatest(a / sum(a) OVER (PARTITION BY symbol), 1e-6) AS pa, greatest(b / sum(b) OVER (PARTITION BY symbol), 1e-6) AS pb FROM c), psi AS (SELECT symbol, sum((pb - pa) * ln(pb / pa)) AS psi FROM s GROUP BY 1)"
_KS = ", u AS (SELECT symbol, x, count(*) FILTER (WHERE NOT new) AS a, count(*) FILTER (WHERE new) AS b FROM v GROUP BY 1, 2), k AS (SELECT symbol, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY symbol) - sum(b) OVER w / sum(b) OVER (PARTITION BY symbol)) AS gap FROM u WINDOW w AS (PARTITION BY symbol ORDER BY x)), ks AS (SELECT symbol, max(gap) AS ks FROM k GROUP BY 1)"


def _halves(spark, sf):
    return ticks(spark, sf).select("symbol", F.col("price").alias("x"), (F.col("ts") >= _CUT).alias("new"))


@query(f"WITH {_PSI} SELECT symbol, round(psi, 6) AS psi FROM psi")
def ev09_psi(spark, sf):
    return E.psi(_halves(spark, sf), ["symbol"], "x", "new").select("symbol", r6(F.col("psi"), "psi"))


@query(f"WITH {_HALVES}{_KS} SELECT symbol, round(ks, 6) AS ks FROM ks")
def ev10_ks(spark, sf):
    return E.ks(_halves(spark, sf), ["symbol"], "x", "new").select("symbol", r6(F.col("ks"), "ks"))


@query(f"WITH {TICKS}, v AS (SELECT unnest(['price', 'size', 'user', 'k']) AS name, unnest([price, size::DOUBLE, (user_id % 10)::DOUBLE, CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 97)::DOUBLE END]) AS x, ts >= {_CUT} AS new FROM ticks), q AS (SELECT name, unnest([" + ", ".join(f"quantile_cont(x, {k / 10})" for k in range(1, 10)) + "]) AS e FROM v WHERE NOT new AND x IS NOT NULL GROUP BY 1), e AS (SELECT name, list(e) AS edges FROM q GROUP BY 1), c AS (SELECT v.name, len(list_filter(edges, lambda e: x > e)) AS bin, count(*) FILTER (WHERE NOT new) AS a, count(*) FILTER (WHERE new) AS b FROM v JOIN e ON v.name = e.name WHERE x IS NOT NULL GROUP BY 1, 2), s AS (SELECT name, greatest(a / sum(a) OVER (PARTITION BY name), 1e-6) AS pa, greatest(b / sum(b) OVER (PARTITION BY name), 1e-6) AS pb FROM c), psi AS (SELECT name, sum((pb - pa) * ln(pb / pa)) AS psi FROM s GROUP BY 1), m AS (SELECT name, abs(avg(x) FILTER (WHERE new) - avg(x) FILTER (WHERE NOT new)) AS shift FROM v GROUP BY 1) SELECT round(avg(psi), 6) AS mean_psi, round(avg(shift), 6) AS mean_shift, count(*) AS features FROM psi JOIN m USING (name)")
def ev11_feature_drift(spark, sf):
    """All numeric keys of the payloads, each against its own past."""
    i = F.col("id")
    payload = F.create_map(F.lit("price"), F.col("price"), F.lit("size"), F.col("size").cast("double"), F.lit("user"), (F.col("user_id") % 10).cast("double"), F.lit("k"), F.when(i % 5 != 0, (i % 97).cast("double")))
    return E.feature_drift(ticks(spark, sf).select(payload.alias("payload"), (F.col("ts") >= _CUT).alias("is_new"))).select(r6(F.col("mean_psi"), "mean_psi"), r6(F.col("mean_shift"), "mean_shift"), "features")


_FPSI = ", fv AS (SELECT symbol, size::DOUBLE AS x, ts >= " + str(_CUT) + " AS new FROM ticks), fq AS (SELECT symbol, unnest([" + ", ".join(f"quantile_cont(x, {k / 10})" for k in range(1, 10)) + "]) AS e FROM fv WHERE NOT new GROUP BY 1), fe AS (SELECT symbol, list(e) AS edges FROM fq GROUP BY 1), fc AS (SELECT fv.symbol, len(list_filter(edges, lambda e: x > e)) AS bin, count(*) FILTER (WHERE NOT new) AS a, count(*) FILTER (WHERE new) AS b FROM fv JOIN fe ON fv.symbol = fe.symbol GROUP BY 1, 2), fs AS (SELECT symbol, greatest(a / sum(a) OVER (PARTITION BY symbol), 1e-6) AS pa, greatest(b / sum(b) OVER (PARTITION BY symbol), 1e-6) AS pb FROM fc), fpsi AS (SELECT symbol, sum((pb - pa) * ln(pb / pa)) AS fpsi FROM fs GROUP BY 1)"
_DELTAS = f", pr AS (SELECT symbol, abs(coalesce(avg((sign(mu) = sign(y))::INT) FILTER (WHERE ts >= {_CUT}), 0) - coalesce(avg((sign(mu) = sign(y))::INT) FILTER (WHERE ts < {_CUT}), 0)) AS hit FROM predictions GROUP BY 1), rj AS (SELECT symbol, abs(coalesce(avg((price < 5)::INT) FILTER (WHERE ts >= {_CUT}), 0) - coalesce(avg((price < 5)::INT) FILTER (WHERE ts < {_CUT}), 0)) AS rej FROM ticks GROUP BY 1), sl AS (SELECT symbol, avg(abs(close / open - 1)) AS slip FROM bars WHERE ts >= {_CUT} GROUP BY 1)"


@query(f"WITH {PREDICTIONS}{_PSI[len(TICKS):]}{_KS}{_FPSI}{_DELTAS}, v2 AS (SELECT psi.symbol, psi, ks, fpsi, hit, rej, coalesce(slip, 0) AS slip, psi >= 0.2 OR ks >= 0.2 OR fpsi >= 0.2 OR hit >= 0.15 OR rej >= 0.05 AS drift FROM psi JOIN ks ON psi.symbol = ks.symbol JOIN fpsi ON psi.symbol = fpsi.symbol JOIN pr ON psi.symbol = pr.symbol JOIN rj ON psi.symbol = rj.symbol LEFT JOIN sl ON psi.symbol = sl.symbol) SELECT symbol, round(psi, 6) AS psi, round(ks, 6) AS ks, round(fpsi, 6) AS feature_psi, round(hit, 6) AS label_stability_delta, round(rej, 6) AS reject_rate_delta, round(slip, 6) AS slippage_abs_mean, drift, CASE WHEN drift THEN 'rollback_check' WHEN psi > 0.14 THEN 'warn' ELSE 'keep' END AS action FROM v2")
def ev12_drift_verdict(spark, sf):
    t, new = ticks(spark, sf), (F.col("ts") >= _CUT).alias("is_new")
    scores = t.select("symbol", F.col("price").alias("value"), new)
    features = t.select("symbol", F.lit("size").alias("name"), F.col("size").cast("double").alias("value"), new)
    hits = predictions(spark, sf).select("symbol", (F.signum("mu") == F.signum("y")).cast("double").alias("value"), new)
    rejects = t.select("symbol", (F.col("price") < 5).cast("double").alias("value"), new)
    slippage = bars(spark, sf).where(F.col("ts") >= _CUT).select("symbol", (F.col("close") / F.col("open") - 1).alias("value"))
    d = E.drift_verdict(scores, features, hits, rejects, slippage, ["symbol"])
    return d.select("symbol", *(r6(F.col(c), c) for c in ("psi", "ks", "feature_psi", "label_stability_delta", "reject_rate_delta", "slippage_abs_mean")), "drift", "action")


_PAR = FILLS + ", b AS (SELECT target, sum(est_price * qty) AS n, avg(est_price) AS ret FROM fills GROUP BY 1), p AS (SELECT target, sum(price * qty) AS n, avg(price) AS ret, count(*) AS orders FROM fills WHERE status <> 'rejected' GROUP BY 1)"


#: Costs that a backtest assumes of a fill, as shares of its notional; the tables hold none.
_BACKTEST_COSTS = {"fee": 5.0e-4, "slippage": 2.1e-4, "impact": 1.4e-4}


def _paper_costs(live):
    """Fee, adverse slippage, and what is left of the assumed cost as impact; shares of the live fills' notional at the estimated price."""
    est, notional = F.col("est_price"), F.col("est_price") * F.col("qty")
    ok = live & (est > 0) & (F.col("qty") > 0)
    fee = F.greatest(F.lit(0.0), F.when(ok, F.col("fee") / notional))
    slip = F.greatest(F.lit(0.0), F.when(ok, F.when(F.col("side") == "buy", F.col("price") - est).otherwise(est - F.col("price")) / est))
    impact = F.greatest(F.lit(0.0), F.lit(sum(_BACKTEST_COSTS.values())) - fee - slip)
    total = F.sum(F.when(ok, notional))
    return [F.coalesce(F.sum(F.when(ok, c * notional)) / total, F.lit(0.0)).alias(n) for c, n in ((fee, "fee"), (slip, "slippage"), (impact, "impact"))]


def _parity(f, *keys, costs=True):
    """Keys and targets that have live fills, with all fills as the backtest and live ones as paper: one pass, one grouping."""
    live = F.col("status") != "rejected"
    only = lambda c: F.when(live, c)
    both = f.groupBy(*keys, "target").agg(
        F.sum(F.col("est_price") * F.col("qty")).alias("bn"), F.avg("est_price").alias("br"), F.sum(only(F.col("price") * F.col("qty"))).alias("pn"), F.avg(only(F.col("price"))).alias("pr"),
        F.count_if(live).alias("orders"), *(_paper_costs(live) if costs else ()),
    )
    return both.where("orders > 0")


_SPANS = FILLS + f", w(days) AS (VALUES (7), (30), (NULL)), f AS (SELECT days, fills.* FROM fills, (SELECT max(ts) AS last FROM fills), w WHERE days IS NULL OR last - ts < days * {DAY}), b AS (SELECT days, target, sum(est_price * qty) AS n, avg(est_price) AS ret FROM f GROUP BY 1, 2), p AS (SELECT days, target, sum(price * qty) AS n, avg(price) AS ret, count(*) AS orders FROM f WHERE status <> 'rejected' GROUP BY 1, 2), j AS (SELECT b.days, b.n AS bn, b.ret AS br, p.n AS pn, p.ret AS pr, orders FROM b JOIN p ON b.days IS NOT DISTINCT FROM p.days AND b.target = p.target), per AS (SELECT days, count(*) AS matched, sum(br * bn) / sum(bn) AS back, sum(pr * pn) / sum(pn) AS paper, CASE WHEN count(*) < 2 THEN 'insufficient_matched_targets' WHEN sum(orders) < 50 THEN 'insufficient_paper_orders' ELSE 'evaluated' END AS status FROM j GROUP BY 1)"


@query(f"WITH {_SPANS} SELECT w.days AS window_days, coalesce(matched, 0) AS matched, round(back, 4) AS backtest, round(paper, 4) AS paper, round(abs(paper - back) / greatest(1e-4, abs(back)), 5) AS deviation, coalesce(status, 'insufficient_matched_targets') AS status FROM w LEFT JOIN per ON w.days IS NOT DISTINCT FROM per.days")
def ev13_parity(spark, sf):
    back, paper = F.sum(F.col("br") * F.col("bn")) / F.sum("bn"), F.sum(F.col("pr") * F.col("pn")) / F.sum("pn")
    status = F.when(F.count("*") < 2, "insufficient_matched_targets").when(F.sum("orders") < 50, "insufficient_paper_orders").otherwise("evaluated")
    # The last 7 and 30 days up to the latest fill, and (null) all of them.
    # The latest fill must be known first, so the joined rows are written once, in their few columns.
    f = written(fills(spark, sf).select("target", "ts", "est_price", "qty", "price", "status"))
    age = F.col("last") - F.col("ts")
    spans = F.filter(F.array(F.when(age < 7 * DAY, 7), F.when(age < 30 * DAY, 30), F.lit(0)), lambda d: d.isNotNull())
    f = f.crossJoin(F.broadcast(f.agg(F.max("ts").alias("last")))).withColumn("days", F.explode(spans))
    per = _parity(f, "days", costs=False).groupBy("days").agg(F.count("*").alias("matched"), r6(back, "backtest", 4), r6(paper, "paper", 4), r6(F.abs(paper - back) / F.greatest(F.lit(1e-4), F.abs(back)), "deviation", 5), status.alias("status"))
    windows = spark.createDataFrame([(7,), (30,), (0,)], "days int")
    filled = F.coalesce("status", F.lit("insufficient_matched_targets")).alias("status")
    return windows.join(per, "days", "left").select(F.nullif("days", F.lit(0)).alias("window_days"), F.coalesce("matched", F.lit(0)).alias("matched"), "backtest", "paper", "deviation", filled)


_PAPER = "SELECT target, sum(greatest(0, fee / (est_price * qty)) * est_price * qty) / sum(est_price * qty) AS fee, sum(slip * est_price * qty) / sum(est_price * qty) AS slippage, sum(greatest(0, 0.00085 - greatest(0, fee / (est_price * qty)) - slip) * est_price * qty) / sum(est_price * qty) AS impact FROM (SELECT *, greatest(0, CASE WHEN side = 'buy' THEN price - est_price ELSE est_price - price END / est_price) AS slip FROM fills WHERE status <> 'rejected' AND est_price > 0 AND qty > 0) GROUP BY 1"


@query(f"WITH {_PAR}, c AS ({_PAPER}), x AS (SELECT b.target, b.ret AS br, p.ret AS pr, orders, 0.0005 - coalesce(fee, 0) AS fee_delta, 0.00021 - coalesce(slippage, 0) AS slippage_delta, 0.00014 - coalesce(impact, 0) AS impact_delta FROM b JOIN p ON b.target = p.target LEFT JOIN c ON b.target = c.target) SELECT target, round(pr - br, 4) AS gap, round(abs(pr - br) / greatest(0.02, abs(br), abs(pr)), 6) AS relative_deviation, orders, round(fee_delta, 6) AS fee_delta, round(slippage_delta, 6) AS slippage_delta, round(impact_delta, 6) AS impact_delta, round(fee_delta + slippage_delta + impact_delta, 6) AS total_delta FROM x")
def ev14_parity_gap(spark, sf):
    gap = F.col("pr") - F.col("br")
    relative = F.abs(gap) / F.greatest(F.lit(0.02), F.abs("br"), F.abs("pr"))
    deltas = {k: F.lit(c) - F.col(k) for k, c in _BACKTEST_COSTS.items()}
    deltas["total"] = deltas["fee"] + deltas["slippage"] + deltas["impact"]
    p = _parity(fills(spark, sf)).orderBy(F.desc(relative), "target")
    return p.select("target", r6(gap, "gap", 4), r6(relative, "relative_deviation"), "orders", *(r6(c, f"{k}_delta") for k, c in deltas.items()))


_RUNS = BARS + f", runs AS (SELECT symbol, ts // {DAY} AS run, sum(close - open) AS pnl, avg(close) AS sharpe, count(*) AS bars, max(high) - min(low) AS dd, count(*) FILTER (WHERE close < open) AS losses FROM bars GROUP BY 1, 2)"


def _runs(spark, sf):
    b = bars(spark, sf)
    return b.groupBy("symbol", F.floor(F.col("ts") / DAY).alias("run")).agg(F.sum(F.col("close") - F.col("open")).alias("pnl"), F.avg("close").alias("sharpe"), F.count("*").alias("bars"), (F.max("high") - F.min("low")).alias("dd"), F.count_if(F.col("close") < F.col("open")).alias("losses"))


@query(f"WITH {_RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY run DESC) AS rn FROM runs WHERE bars >= 12) SELECT symbol, count(*) AS runs, round(avg(sharpe), 6) AS sharpe, avg(sharpe) > 99 AND avg(dd) < 480 AS passed FROM k WHERE rn <= 10 GROUP BY 1")
def ev15_model_gate(spark, sf):
    k = _runs(spark, sf).where("bars >= 12").withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("run")))).where("rn <= 10")
    return k.groupBy("symbol").agg(F.count("*").alias("runs"), r6(F.avg("sharpe"), "sharpe"), ((F.avg("sharpe") > 99) & (F.avg("dd") < 480)).alias("passed"))


@query(f"WITH {_RUNS}, d AS (SELECT symbol, count(*) AS n, sum(bars) / 24 AS days, avg(sharpe) AS sharpe, max(abs(dd)) AS dd, count(*) FILTER (WHERE run % 31 = 0 OR bars = 9) AS leaking FROM runs WHERE losses > 3 AND run % 7 <> 0 GROUP BY 1), o AS (SELECT event_type AS symbol, avg((value < 5)::INT) AS rejects FROM events GROUP BY 1) SELECT symbol, n, round(days, 6) AS days, round(sharpe, 6) AS sharpe, round(dd, 6) AS max_drawdown, round(rejects, 6) AS reject_rate, leaking, concat_ws(',', CASE WHEN n < 20 THEN 'runs' END, CASE WHEN days < 20 THEN 'days' END, CASE WHEN sharpe < 100 THEN 'sharpe' END, CASE WHEN dd > 480 THEN 'drawdown' END, CASE WHEN rejects > 0.05 THEN 'rejects' END, CASE WHEN leaking > 0 THEN 'leakage' END) AS fails FROM d JOIN o USING (symbol)")
def ev16_hard_gate(spark, sf):
    """Days of a symbol as runs; some are superseded, some not completed, some leak."""
    r = _runs(spark, sf)
    runs = r.select("symbol", F.when(F.col("losses") > 3, "completed").otherwise("failed").alias("status"), (F.col("run") % 7 == 0).alias("superseded"), "sharpe", F.col("dd").alias("drawdown"), (F.col("bars") / 24).alias("days"), (F.col("run") % 31 != 0).alias("leak_free"), (F.col("bars") == 9).cast("int").alias("violations"))
    orders = ticks(spark, sf).select("symbol", (F.col("price") < 5).alias("rejected"))
    g = E.hard_gate(runs, orders, ["symbol"], 20, 20, 100, 480, 0.05)
    return g.select("symbol", "n", *(r6(F.col(c), c) for c in ("days", "sharpe", "max_drawdown", "reject_rate")), "leaking", F.array_join("fails", ",").alias("fails"))


@query("SELECT event_id, concat_ws(',', CASE WHEN NOT json_exists(props, '$.k') THEN 'k' END, 'sharpe') AS lacking, CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 0 AND 90 AS in_range FROM events")
def ev17_contract_keys(spark, sf):
    m = F.from_json("props", "map<string, bigint>")
    lacking = F.array_except(F.array(F.lit("k"), F.lit("sharpe")), F.map_keys(m))
    return table(spark, sf, "events").select("event_id", F.array_join(lacking, ",").alias("lacking"), m["k"].between(0, 90).alias("in_range"))


@query(f"WITH {_RUNS}, k AS (SELECT symbol, losses * 2 > bars AS failing, row_number() OVER (PARTITION BY symbol ORDER BY run DESC) AS rn FROM runs) SELECT symbol, coalesce(min(rn) FILTER (WHERE NOT failing) - 1, count(*)) AS failing, coalesce(min(rn) FILTER (WHERE NOT failing) - 1, count(*)) >= 2 AS roll_back FROM k GROUP BY 1")
def ev18_rollback(spark, sf):
    k = _runs(spark, sf).select("symbol", (F.col("losses") * 2 > F.col("bars")).alias("bad"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("run"))).alias("rn"))
    n = F.coalesce(F.min(F.when(~F.col("bad"), F.col("rn"))) - 1, F.count("*")).cast("long")
    return k.groupBy("symbol").agg(n.alias("failing")).withColumn("roll_back", F.col("failing") >= 2)


@query(f"WITH {BARS}, a AS (SELECT symbol, ts, close AS v FROM bars WHERE trades > 1), b AS (SELECT symbol, ts, round(close, 1) AS v FROM bars WHERE trades < 6) SELECT symbol, count(*) FILTER (WHERE a.v IS NULL OR b.v IS NULL) AS mismatched, round(max(abs(a.v - b.v)), 6) AS worst, round(avg(abs(a.v - b.v)), 6) AS mean, coalesce(max(abs(a.v - b.v)), 0) <= 0.01 AS within FROM a FULL JOIN b USING (symbol, ts) GROUP BY 1")
def ev19_replay_diff(spark, sf):
    x = bars(spark, sf)
    a, b = x.where("trades > 1").select("symbol", "ts", F.col("close").alias("a")), x.where("trades < 6").select("symbol", "ts", F.round("close", 1).alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    return a.join(b, ["symbol", "ts"], "full").groupBy("symbol").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("mismatched"), r6(F.max(d), "worst"), r6(F.avg(d), "mean"), (F.coalesce(F.max(d), F.lit(0.0)) <= 0.01).alias("within"))


@query(f"WITH {PREDICTIONS}, s AS (SELECT symbol, avg(sign(mu) * y) AS full_, avg(sign(y) * mu) AS no_event, avg(y) AS no_text FROM predictions GROUP BY 1) SELECT symbol, round(full_ - no_event, 6) + 0.0 AS d_event, round(full_ - no_text, 6) + 0.0 AS d_text, concat_ws(',', CASE WHEN full_ < no_event THEN 'event_hurts' END, CASE WHEN full_ < no_text THEN 'text_hurts' END) AS reasons FROM s")
def ev20_ablation(spark, sf):
    s = predictions(spark, sf).groupBy("symbol").agg(F.avg(F.signum("mu") * F.col("y")).alias("a"), F.avg(F.signum("y") * F.col("mu")).alias("e"), F.avg("y").alias("t"))
    reasons = F.array_compact(F.array(F.when(F.col("a") < F.col("e"), "event_hurts"), F.when(F.col("a") < F.col("t"), "text_hurts")))
    return s.select("symbol", _z(F.col("a") - F.col("e"), "d_event"), _z(F.col("a") - F.col("t"), "d_text"), F.array_join(reasons, ",").alias("reasons"))


_MOM = BARS + f", r AS (SELECT symbol, ts, ln(close / lag(close) OVER ({_W})) AS ret, row_number() OVER ({_W}) - 1 AS i FROM bars), f AS (SELECT *, (i - 96) // 24 AS fold FROM r), tr AS (SELECT k.symbol, k.fold, avg(f.ret) AS m, stddev_pop(f.ret) AS s FROM (SELECT DISTINCT symbol, fold FROM f WHERE i >= 96) k JOIN f ON f.symbol = k.symbol AND f.i >= k.fold * 24 AND f.i < k.fold * 24 + 96 GROUP BY 1, 2), sg AS (SELECT f.symbol, f.ts, f.ret, CASE WHEN ret > m + 0.2 * s THEN 1 WHEN ret < m - 0.2 * s THEN -1 ELSE 0 END AS sig FROM f JOIN tr ON f.symbol = tr.symbol AND f.fold = tr.fold WHERE i >= 96), p AS (SELECT *, coalesce(lag(sig) OVER ({_W}), 0) AS prev FROM sg)"


_BASE = BARS + f""", b0 AS (SELECT symbol, ts, close, volume, lag(close) OVER ({_W}) AS p, lag(volume) OVER ({_W}) AS v, row_number() OVER ({_W}) - 2 AS j, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
r AS (SELECT symbol, ts, close / p - 1 AS r, v, j, n, lag(close / p - 1) OVER ({_W}) AS before FROM b0 WHERE j >= 0 AND n >= 122),
f AS (SELECT *, (j - 96) // 24 AS fold FROM r WHERE j >= 96 AND j < n - 2),
t AS (SELECT a.symbol, a.fold, avg(r.r) AS mu, stddev_pop(r.r) AS sigma FROM (SELECT DISTINCT symbol, fold FROM f) a JOIN r ON a.symbol = r.symbol AND r.j >= a.fold * 24 AND r.j < a.fold * 24 + 96 GROUP BY 1, 2),
s AS (SELECT f.*, CASE WHEN before - mu > greatest(1e-6, 0.2 * sigma) THEN 1 WHEN before - mu < -greatest(1e-6, 0.2 * sigma) THEN -1 ELSE 0 END * greatest(0.2, least(1, 0.8 - 20 * sigma)) AS signal FROM f JOIN t ON f.symbol = t.symbol AND f.fold = t.fold),
u AS (SELECT *, abs(signal - coalesce(lag(signal) OVER ({_W}), 0)) AS turn FROM s),
c AS (SELECT *, signal * r - (5 + 3 + least(25, 1200 / sqrt(greatest(1, v)))) / 1e4 * turn AS pnl FROM u),
q AS (SELECT *, CASE WHEN max((pnl <= -1)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN pnl > -1 THEN ln(1 + pnl) ELSE 0 END) OVER w) END AS curve FROM c WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, 1 - curve / greatest(1, max(curve) OVER ({_W} ROWS UNBOUNDED PRECEDING)) AS dd FROM q)"""


@query(f"WITH {_BASE} SELECT symbol, count(*) AS samples, round(corr(signal, r), 5) + 0.0 AS ic, round(avg((signal * r > 0)::INT), 6) AS hit_rate, round(sum(turn), 5) AS turnover, round(last(curve ORDER BY j) - 1, 5) AS pnl_after_cost, round(max(dd), 5) AS max_drawdown FROM d GROUP BY 1")
def ev21_momentum(spark, sf):
    m = Z.momentum(bars(spark, sf).select("symbol", "ts", "close", "volume"), 96, 24, 5.0, 3.0)
    return m.select("symbol", "samples", _z(F.col("ic"), "ic", 5), r6(F.col("hit_rate"), "hit_rate"), r6(F.col("turnover"), "turnover", 5), r6(F.col("pnl_after_cost"), "pnl_after_cost", 5), r6(F.col("max_drawdown"), "max_drawdown", 5))


@query(f"WITH {PREDICTIONS} SELECT symbol, round(avg(greatest(0.9 * (y - mu - 1.2816 * sigma), -0.1 * (y - mu - 1.2816 * sigma))), 6) AS pinball, round(avg(-ln(CASE WHEN y > 0 THEN p_up ELSE 1 - p_up END)), 6) AS bce, round(avg(lgamma(2.5) - lgamma(2.0) - 0.5 * ln(4 * pi()) - ln(sigma) - 2.5 * ln(1 + ((y - mu) / sigma) ** 2 / 4)), 5) AS student_ll FROM predictions GROUP BY 1")
def ev22_losses(spark, sf):
    y, mu, s, p = (F.col(c) for c in ("y", "mu", "sigma", "p_up"))
    q = y - mu - 1.2816 * s
    lg = lambda v: X.stirling_lgamma(F.lit(v))
    student = lg(2.5) - lg(2.0) - 0.5 * F.log(4 * F.pi()) - F.log(s) - 2.5 * F.log(1 + ((y - mu) / s) ** 2 / 4)
    return predictions(spark, sf).groupBy("symbol").agg(r6(F.avg(F.greatest(0.9 * q, -0.1 * q)), "pinball"), r6(F.avg(-F.log(F.when(y > 0, p).otherwise(1 - p))), "bce"), r6(F.avg(student), "student_ll", 5))

"""Evaluation, drift and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import cost_breakdown
from .order import quantiles
from .rolling import correlation, equity


def calibration_error(df: DataFrame, keys: Sequence[str], p: str, hit: str, bins: int = 10) -> DataFrame:
    """Mean gap between probability and frequency over equal bins, weighted by their rows."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = df.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(hit).alias("h"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("h"))) / F.sum("n")).alias("ece"))


def psi(df: DataFrame, keys: Sequence[str], value: str, is_new: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index per key, with edges at quantiles of the old rows: one row of edges for each key."""
    probs = {f"__e{k}": k / bins for k in range(1, bins)}
    edges = quantiles(df.where(~F.col(is_new)), keys, value, probs).select(*keys, F.array(*probs).alias("edges"))
    joined = df.join(edges, list(keys)) if keys else df.crossJoin(F.broadcast(edges))
    bin_ = F.size(F.filter("edges", lambda e: F.col(value) > e))
    counts = joined.groupBy(*keys, bin_.alias("bin")).agg(F.count_if(~F.col(is_new)).alias("a"), F.count_if(F.col(is_new)).alias("b"))
    totals = counts.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    both = counts.join(totals, list(keys)) if keys else counts.crossJoin(F.broadcast(totals))
    pa, pb = F.greatest(F.col("a") / F.col("na"), F.lit(eps)), F.greatest(F.col("b") / F.col("nb"), F.lit(eps))
    return both.groupBy(*keys).agg(F.sum((pb - pa) * F.log(pb / pa)).alias("psi"))


def feature_drift(rows: DataFrame, payload: str = "payload", is_new: str = "is_new") -> DataFrame:
    """mean_psi and mean_shift (of absolute means) over all keys of the payloads (map<string, double>), and how many keys both sides have; zeros without any. Null values aren't there."""
    v = rows.select(F.col(is_new).alias("is_new"), F.explode(payload).alias("name", "value")).where("value IS NOT NULL")
    means = v.groupBy("name").agg(F.abs(F.avg(F.when(F.col("is_new"), F.col("value"))) - F.avg(F.when(~F.col("is_new"), F.col("value")))).alias("shift")).where("shift IS NOT NULL")
    found = psi(v, ["name"], "value", "is_new").join(means, "name")
    return found.agg(F.coalesce(F.avg("psi"), F.lit(0.0)).alias("mean_psi"), F.coalesce(F.avg("shift"), F.lit(0.0)).alias("mean_shift"), F.count("*").alias("features"))


def ks(df: DataFrame, keys: Sequence[str], value: str, is_new: str) -> DataFrame:
    """Two-sample distance per key: both distribution functions in one pass over distinct values."""
    points = df.groupBy(*keys, value).agg(F.count_if(~F.col(is_new)).alias("a"), F.count_if(F.col(is_new)).alias("b"))
    w = Window.partitionBy(*keys)
    run = w.orderBy(value)
    gap = F.abs(F.sum("a").over(run) / F.sum("a").over(w) - F.sum("b").over(run) / F.sum("b").over(w))
    return points.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.max("gap").alias("ks"))


def metric_pack(df: DataFrame, keys: Sequence[str], horizon_hours: int = 1, notional: float = 0.0, order: str = "ts", bins: int = 10) -> DataFrame:
    """Per key: n, mse, mae, spearman_ic, hit_rate, sharpe, max_drawdown, turnover, avg_holding, brier, ece, coverage.

    df: keys, order, y_raw, y_net, mu, sigma, p_up, q_low, q_high. The position is mu / sigma in [-1, 1]; its changes pay
    the cost of the shared profile at the key's own volatility and turnover. Ranks of equal values go by order.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    position = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("mu") / F.greatest(F.col("sigma"), F.lit(1e-6))))
    d = df.withColumn("__pos", position).withColumn("__prev", F.coalesce(F.lag("__pos").over(by), F.lit(0.0))).withColumn("__turn", F.abs(F.col("__pos") - F.col("__prev")))
    for c in ("mu", "y_net"):
        d = d.withColumn(f"__rank_{c}", F.row_number().over(Window.partitionBy(*keys).orderBy(c, order)))
    means = d.groupBy(*keys).agg(F.avg(F.abs("y_raw")).alias("__vol"), F.avg("__turn").alias("__mean_turn"))
    cost = cost_breakdown(F.col("__vol"), F.lit(0.0), F.col("__mean_turn"), F.lit(horizon_hours), F.lit(0.0), F.lit(0.0), F.lit(notional))["total"]
    priced = d.join(means.withColumn("__cost", cost / 1e4).drop("__mean_turn", "__vol"), list(keys))
    priced = priced.withColumn("pnl", F.col("__pos") * F.col("y_raw") - F.col("__turn") * F.col("__cost"))
    curved = equity(priced, "pnl", tuple(keys))
    held, label = F.abs("__pos") > 1e-9, (F.col("y_net") >= 0).cast("double")
    out = curved.withColumn("__label", label).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((F.col("mu") - F.col("y_net")) ** 2).alias("mse"), F.avg(F.abs(F.col("mu") - F.col("y_net"))).alias("mae"), correlation("__rank_mu", "__rank_y_net").alias("spearman_ic"),
        F.avg((F.signum("mu") == F.signum("y_net")).cast("double")).alias("hit_rate"), (F.avg("pnl") / F.greatest(F.lit(1e-9), F.stddev_pop("pnl"))).alias("sharpe"), F.abs(F.min("drawdown")).alias("max_drawdown"), F.avg("__turn").alias("turnover"),
        (F.count_if(held) / F.greatest(F.lit(1), F.count_if(held & (F.abs("__prev") <= 1e-9)))).alias("avg_holding"), F.avg((F.col("p_up") - F.col("__label")) ** 2).alias("brier"), F.avg(F.col("y_net").between(F.col("q_low"), F.col("q_high")).cast("double")).alias("coverage"),
    )
    return out.join(calibration_error(df.withColumn("__label", label), keys, "p_up", "__label", bins), list(keys))


def fold_metrics(df: DataFrame, keys: Sequence[str], horizon_hours: int = 1, order: str = "ts") -> DataFrame:
    """Per fold (keys): n, ic, hit_rate, turnover, pnl_after_cost, max_drawdown and cost_bps of predictions mu for y out of sample.

    The position is the sign of mu; its changes pay what the shared model asks for at the fold's own volatility and
    turnover. ic is 0 where one side doesn't move.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("__s", F.signum("mu")).withColumn("__t", F.abs(F.col("__s") - F.coalesce(F.lag("__s").over(w), F.lit(0.0))))
    means = d.groupBy(*keys).agg(F.avg(F.abs("y")).alias("__vol"), F.avg("__t").alias("__turn"))
    cost = cost_breakdown(F.col("__vol"), F.lit(0.0), F.col("__turn"), F.lit(horizon_hours))["total"]
    d = d.join(means.select(*keys, cost.alias("__cost")), list(keys))
    d = equity(d.withColumn("__ret", F.col("__s") * F.col("y") - F.col("__t") * F.col("__cost") / 1e4), "__ret", tuple(keys))
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(correlation("y", "mu"), F.lit(0.0)).alias("ic"), F.avg((F.signum("y") == F.col("__s")).cast("double")).alias("hit_rate"), F.avg("__t").alias("turnover"),
        F.avg("__ret").alias("pnl_after_cost"), F.abs(F.min("drawdown")).alias("max_drawdown"), F.first("__cost").alias("cost_bps"),
    )


def fold_summary(folds: DataFrame) -> DataFrame:
    """One row: folds, means of their metrics, and the worst drawdown; zeros without a fold."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return folds.agg(F.count("*").alias("folds"), *(zero(F.avg(c)).alias(c) for c in ("ic", "hit_rate", "turnover", "pnl_after_cost")), zero(F.max("max_drawdown")).alias("max_drawdown"))


def hard_gate(runs: DataFrame, orders: DataFrame, keys: Sequence[str], least_runs: int, least_days: float, sharpe: float, drawdown: float, rejects: float) -> DataFrame:
    """Per key n, days, sharpe, max_drawdown, reject_rate, leaking runs, what fails (array), and passed.

    runs: keys, status, superseded, sharpe, drawdown, days, leak_free, violations; superseded and uncompleted ones don't count.
    orders: keys, rejected. A key without orders rejects none.
    """
    done = runs.where("status = 'completed' AND NOT coalesce(superseded, false)")
    leaks = F.count_if(~F.coalesce("leak_free", F.lit(False)) | (F.coalesce("violations", F.lit(0)) > 0))
    g = done.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("days").alias("days"), F.avg("sharpe").alias("sharpe"), F.max(F.abs("drawdown")).alias("max_drawdown"), leaks.alias("leaking"))
    share = orders.groupBy(*keys).agg(F.avg(F.col("rejected").cast("double")).alias("reject_rate"))
    g = g.join(share, list(keys), "left").fillna(0.0, ["reject_rate"])
    fails = {"runs": F.col("n") < least_runs, "days": F.col("days") < least_days, "sharpe": F.col("sharpe") < sharpe, "drawdown": F.col("max_drawdown") > drawdown, "rejects": F.col("reject_rate") > rejects, "leakage": F.col("leaking") > 0}
    return g.withColumn("fails", F.array_compact(F.array(*(F.when(c, n) for n, c in fails.items())))).withColumn("passed", F.size("fails") == 0)


def drift_verdict(scores: DataFrame, features: DataFrame, hits: DataFrame, rejects: DataFrame, slippage: DataFrame, keys: Sequence[str], psi_limit: float = 0.2, ks_limit: float = 0.2, hit_limit: float = 0.15, reject_limit: float = 0.05) -> DataFrame:
    """Per key psi, ks, feature_psi, label_stability_delta, reject_rate_delta, slippage_abs_mean, drift and action.

    Each table has the keys, value and is_new (recent or reference rows); features also has name; slippage is of recent
    rows. Drift of scores, features, hit rates or rejects asks for a check whether to roll back; a score drift near its
    limit warns. A key that a table lacks has no drift there.
    """
    gap = lambda df, name: df.groupBy(*keys).agg(F.abs(F.coalesce(F.avg(F.when(F.col("is_new"), F.col("value"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(~F.col("is_new"), F.col("value"))), F.lit(0.0))).alias(name))
    out = psi(scores, keys, "value", "is_new").join(ks(scores, keys, "value", "is_new"), list(keys))
    per = psi(features, [*keys, "name"], "value", "is_new").groupBy(*keys).agg(F.avg("psi").alias("feature_psi"))
    slip = slippage.groupBy(*keys).agg(F.avg(F.abs("value")).alias("slippage_abs_mean"))
    for part in (per, gap(hits, "label_stability_delta"), gap(rejects, "reject_rate_delta"), slip):
        out = out.join(part, list(keys), "left")
    out = out.fillna(0.0, ["feature_psi", "label_stability_delta", "reject_rate_delta", "slippage_abs_mean"])
    drift = (F.col("psi") >= psi_limit) | (F.col("ks") >= ks_limit) | (F.col("feature_psi") >= psi_limit) | (F.col("label_stability_delta") >= hit_limit) | (F.col("reject_rate_delta") >= reject_limit)
    return out.withColumn("drift", drift).withColumn("action", F.when(drift, "rollback_check").when(F.col("psi") > 0.7 * psi_limit, "warn").otherwise("keep"))


def reviewer_agreement(reviews: DataFrame) -> DataFrame:
    """a, b, pairs, agreed of reviewers: the first review of each reviewer of an event (event, reviewer, verdict, ts) counts; reviews without an event don't."""
    first = reviews.where("event IS NOT NULL").groupBy("event", "reviewer").agg(F.min_by("verdict", "ts").alias("verdict"))
    a, b = (first.select("event", F.col("reviewer").alias(c), F.col("verdict").alias(f"v{c}")) for c in ("a", "b"))
    return a.join(b, "event").where("a < b").groupBy("a", "b").agg(F.count("*").alias("pairs"), F.count_if(F.col("va").eqNullSafe(F.col("vb"))).alias("agreed"))


def correlation_penalty(returns: DataFrame, threshold: float = 0.85, penalty: float = 0.5, least: int = 16) -> DataFrame:
    """symbol, strongest, pairs and factor of every symbol of returns (symbol, ts, ret): each other symbol whose correlation at common times is the threshold at least multiplies the factor by 1 - penalty (0.1 at least).

    Pairs of fewer than `least` common times, or of a series that doesn't move in them, don't count; strongest is null
    and the factor 1 where no pair does. Symbols are the universe: there is a row for each pair of symbols and time.
    """
    r = returns.dropna(subset=["symbol", "ts", "ret"]).select("symbol", "ts", "ret")
    a, b = (r.select("ts", F.col("symbol").alias(x), F.col("ret").alias(f"r{x}")) for x in ("a", "b"))
    pairs = a.join(b, "ts").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.stddev_pop("ra").alias("da"), F.stddev_pop("rb").alias("db"), correlation("ra", "rb").alias("rho"))
    sound = pairs.where((F.col("n") >= least) & (F.col("da") > 1e-12) & (F.col("db") > 1e-12) & F.col("rho").isNotNull() & ~F.isnan("rho"))
    each = sound.select(F.explode(F.array("a", "b")).alias("symbol"), F.abs("rho").alias("rho"))
    found = each.groupBy("symbol").agg(F.max("rho").alias("strongest"), F.count_if(F.col("rho") >= threshold).alias("hits"), F.count("*").alias("pairs"))
    out = r.select("symbol").distinct().join(found, "symbol", "left")
    return out.select("symbol", "strongest", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.pow(F.lit(max(0.1, 1 - penalty)), F.coalesce("hits", F.lit(0))).alias("factor"))


def portfolio_score(positions: DataFrame, keys: Sequence[str], budget: float) -> tuple[DataFrame, DataFrame]:
    """Per key alpha, expected_return and expected_volatility of positions (target, score, risk); and the positions with their action.

    A position with a positive score and less risk than the budget is to increase, one with a negative score to reduce.
    """
    alpha = F.avg(F.col("score") / F.greatest("risk", F.lit(0.01)))
    whole = positions.groupBy(*keys).agg(alpha.alias("alpha"), (alpha * 0.8).alias("expected_return"), F.least(F.lit(2.5), F.avg("risk") / budget).alias("expected_volatility"))
    action = F.when((F.col("score") > 0) & (F.col("risk") < budget), "increase").when(F.col("score") < 0, "reduce").otherwise("hold")
    return whole, positions.withColumn("action", action)


def audit_chain(frames: dict[str, DataFrame]) -> DataFrame:
    """decision, steps, chain: what happened for each decision in order. frames: kind -> (decision, ts, ref), in the order in which kinds of one time follow."""
    tagged = None
    for k, (kind, df) in enumerate(frames.items()):
        rows = df.select("decision", "ts", F.lit(k).alias("place"), F.lit(kind).alias("kind"), F.col("ref").cast("string").alias("ref"))
        tagged = rows if tagged is None else tagged.union(rows)
    grouped = tagged.where("decision IS NOT NULL").groupBy("decision").agg(F.count("*").alias("steps"), F.array_sort(F.collect_list(F.struct("ts", "place", "ref", "kind"))).alias("s"))
    return grouped.select("decision", "steps", F.transform("s", lambda x: F.struct(x["ts"].alias("ts"), x["kind"].alias("kind"), x["ref"].alias("ref"))).alias("chain"))

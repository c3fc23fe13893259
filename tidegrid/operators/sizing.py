"""From predictions to positions: signals by horizon, the account's state of risk, position intents, caps and allocation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clamp
from .align import asof_join
from .rolling import by, correlation, equity

# Score from which a horizon's signal acts, the least confidence it needs, and its weight in a position.
SCORE_ENTRY = {"1h": 0.20, "4h": 0.16, "1d": 0.10, "7d": 0.08}
LEAST_CONFIDENCE = {"1h": 0.55, "4h": 0.52, "1d": 0.50, "7d": 0.48}
HORIZON_WEIGHTS = {"1h": 0.40, "4h": 0.30, "1d": 0.20, "7d": 0.10}
# Limits of an account's state, and of a portfolio.
MARGIN_RED, MARGIN_YELLOW, FREE_MARGIN, REJECT_RED, SLIPPAGE_YELLOW, VOL_SPIKE = 1.05, 1.3, 50.0, 0.60, 15.0, 0.08
LIMITS = {"single": 0.2, "gross": 1.0, "turnover": 0.35, "drawdown": 0.2, "sector": 0.45, "style": 0.55, "warn": 0.08, "near": 0.10}
BUCKET_SHARES = {"trend": 0.55, "event": 0.70, "mean_reversion": 0.45}


def _by_horizon(horizon: Column, values: Mapping[str, float]) -> Column:
    """The value of a horizon; that of an hour for horizons without one."""
    out = F.lit(values["1h"])
    for h, v in values.items():
        out = F.when(horizon == h, v).otherwise(out)
    return out


def horizon_signal(rows: DataFrame, band_mult: float = 1.0, eps: float = 1e-4) -> DataFrame:
    """rows (horizon, expected, cost, vol, p10, p90, confidence) with edge, risk, score, band and action.

    The edge is the return less its cost, the risk the volatility or the width of the quantiles, whichever is more. The
    band within which nothing is done widens with risk against edge. Missing quantiles have no width.
    """
    edge = F.col("expected") - F.col("cost")
    risk = F.greatest(F.col("vol"), F.coalesce(F.abs(F.col("p90") - F.col("p10")), F.lit(0.0)), F.lit(eps))
    d = rows.withColumn("edge", edge).withColumn("risk", risk).withColumn("score", F.col("edge") / F.col("risk"))
    entry, least = _by_horizon(F.col("horizon"), SCORE_ENTRY), _by_horizon(F.col("horizon"), LEAST_CONFIDENCE)
    band = F.abs(entry) * max(0.1, band_mult) * (1 + F.least(F.lit(3.0), F.col("risk") / F.greatest(F.lit(eps), F.abs("edge") + eps)))
    d = d.withColumn("band", band)
    action = F.when(F.col("confidence") < least, "hold").when(F.col("score") >= F.col("band"), "buy").when(F.col("score") <= -F.col("band"), "sell").otherwise("hold")
    return d.withColumn("action", action)


def risk_state(accounts: DataFrame) -> DataFrame:
    """accounts (fresh, recon_ok, margin_ratio, free_margin, reject_rate, slippage_p90, realised_vol) with regime, pos_scale, band_scale and reasons.

    One hard limit makes the regime red, and soft penalties then don't count; one of these makes it yellow.
    """
    hard = F.array_compact(F.array(
        F.when(~F.col("fresh"), "account_state_stale"), F.when(~F.col("recon_ok"), "reconciliation_not_ok"), F.when(F.col("margin_ratio") < MARGIN_RED, "margin_ratio_red"),
        F.when(F.col("free_margin") < FREE_MARGIN, "free_margin_low"), F.when(F.col("reject_rate") > REJECT_RED, "reject_rate_red"),
    ))
    slow, thin, wild = F.col("slippage_p90") > SLIPPAGE_YELLOW, F.col("margin_ratio") < MARGIN_YELLOW, F.col("realised_vol") > VOL_SPIKE
    soft = F.array_compact(F.array(F.when(slow, "slippage_p90_high"), F.when(thin, "margin_ratio_yellow"), F.when(wild, "vol_spike")))
    d = accounts.withColumn("__hard", hard).withColumn("__soft", soft)
    red = F.size("__hard") > 0
    d = d.withColumn("regime", F.when(red, "red").when(F.size("__soft") > 0, "yellow").otherwise("green"))
    d = d.withColumn("pos_scale", F.when(red, 1.0).otherwise(F.when(slow, 0.7).otherwise(1.0) * F.when(thin, 0.5).otherwise(1.0)))
    d = d.withColumn("band_scale", F.when(~red & wild, 1.5).otherwise(1.0))
    return d.withColumn("reasons", F.when(red, F.col("__hard")).otherwise(F.col("__soft"))).drop("__hard", "__soft")


def position_intent(predictions: DataFrame, accounts: DataFrame, positions: DataFrame, pos_max: float = 1.0, budget: float = 1.0, base_band: float = 0.02, eps: float = 1e-4, chunk: int | None = None) -> DataFrame:
    """predictions with score, target, current, delta, band, action, qty, reduce_only, uncertainty, regime and reasons.

    predictions: account, symbol, ts, and maps mu, sigma and cost by horizon. accounts: account, ts and what risk_state
    reads: a snapshot holds until the next one. positions: account, ts, symbol, qty, the rows of a snapshot; a symbol that
    the snapshot lacks has no position, whatever older ones say. A prediction before the first snapshot has no position and a
    red regime, since nothing fresh is known.
    """
    state = risk_state(accounts).select("account", "ts", F.struct(F.col("ts").alias("at"), "regime", "pos_scale", "band_scale", "reasons").alias("__s"))
    d = asof_join(predictions, state, ["account"], {"__s": "__s"}, tie="ts", chunk=chunk).drop("right_ts", "missing")
    held = positions.groupBy("account", F.col("ts").alias("__at"), "symbol").agg(F.sum("qty").alias("__held"))
    d = d.withColumn("__at", F.col("__s.at")).join(held, ["account", "__at", "symbol"], "left")
    weights = {h: F.lit(w) for h, w in HORIZON_WEIGHTS.items()}
    there = {h: F.coalesce(F.map_contains_key("mu", F.lit(h)), F.lit(False)) for h in weights}
    get = lambda m, h: F.coalesce(F.try_element_at(F.col(m), F.lit(h)), F.lit(0.0))
    of = {h: (get("mu", h) - get("cost", h)) / F.greatest(F.lit(eps), get("sigma", h)) for h in weights}
    total = sum((F.when(there[h], w * of[h]).otherwise(0.0) for h, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(there[h], w).otherwise(0.0) for h, w in weights.items()), F.lit(0.0))
    sigmas = sum((F.when(there[h], get("sigma", h)).otherwise(0.0) for h in weights), F.lit(0.0))
    number = sum((there[h].cast("int") for h in weights), F.lit(0))
    d = d.withColumn("score", F.when(weight > 1e-9, total / weight).otherwise(0.0)).withColumn("uncertainty", F.when(number > 0, sigmas / number).otherwise(0.0))
    d = d.withColumn("target", clamp(budget * F.col("score"), -pos_max, pos_max) * F.coalesce("__s.pos_scale", F.lit(1.0)))
    d = d.withColumn("band", F.greatest(F.lit(1e-6), base_band * F.coalesce("__s.band_scale", F.lit(1.0)))).withColumn("current", F.coalesce("__held", F.lit(0.0)))
    d = d.withColumn("delta", F.col("target") - F.col("current"))
    inside = F.abs("delta") <= F.col("band")
    d = d.withColumn("action", F.when(inside, "hold").when(F.col("delta") > 0, "buy").otherwise("sell")).withColumn("qty", F.when(inside, 0.0).otherwise(F.abs("delta")))
    regime = F.coalesce("__s.regime", F.lit("red"))
    d = d.withColumn("regime", regime).withColumn("reduce_only", regime == "red").withColumn("reasons", F.coalesce("__s.reasons", F.array(F.lit("account_state_stale"))))
    return d.drop("__s", "__at", "__held")


def strategy_bucket(track: Column, score: Column, confidence: Column, ret_1: Column, ret_12: Column, vol_z: Column) -> Column:
    """trend, mean_reversion or event: by the strength of the trend, how little prices moved, the confidence and how usual the volume is. Missing features count as 0."""
    r1, r12, z = (F.coalesce(c, F.lit(0.0)) for c in (ret_1, ret_12, vol_z))
    strength, calm = F.tanh(r12 * 8 + r1 * 3 + score * 2), F.abs(z) < 1.2
    return F.when(track == "vc", "event").when((F.abs(strength) > 0.35) & (confidence > 0.55) & calm, "trend").when((F.abs(r1) + F.abs(r12) < 0.004) & (confidence > 0.6) & calm, "mean_reversion").otherwise("event")


def _all_in_order(*keys: str) -> Window:
    """All rows of the keys, in the order of their targets."""
    return Window.partitionBy(*keys).orderBy("target").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def exposure_checks(proposed: DataFrame, current: DataFrame, states: DataFrame, limits: Mapping[str, float] = LIMITS) -> tuple[DataFrame, DataFrame]:
    """The weights that a rebalance may have, and per rebalance gross, turnover and violations.

    proposed and current: rebalance, target, weight, and for proposed sector and style; states: rebalance, drawdown. Caps
    follow each other: single weights (tighter from the warning drawdown on), gross, sectors, styles; near the drawdown
    limit no weight may grow. Turnover counts targets of either side. Sums go in the order of targets, so that runs agree
    to the last digit.
    """
    dd = F.greatest(F.lit(0.0), F.col("drawdown"))
    worse = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (dd - limits["warn"]) / max(1e-9, limits["drawdown"] - limits["warn"])))
    single = F.when(dd >= limits["warn"], F.greatest(F.lit(0.01), limits["single"] * F.greatest(F.lit(0.25), 1 - 0.75 * worse))).otherwise(limits["single"])
    s = states.select("rebalance", "drawdown", single.alias("__single"), (dd >= limits["near"]).alias("__near"))
    one = F.col("weight")
    d = proposed.join(s, "rebalance").withColumn("__over", F.abs(one) > F.col("__single")).withColumn("weight", F.when(F.col("__over"), F.signum(one) * F.col("__single")).otherwise(one))

    def cap(df: DataFrame, keys: Sequence[str], limit: float, name: str) -> DataFrame:
        total = F.sum(F.abs("weight")).over(_all_in_order("rebalance", *keys))
        df = df.withColumn("__e", total).withColumn(name, F.col("__e") > limit)
        return df.withColumn("weight", F.when(F.col(name), F.col("weight") * limit / F.col("__e")).otherwise(F.col("weight"))).drop("__e")

    d = cap(cap(cap(d, [], limits["gross"], "__gross"), ["sector"], limits["sector"], "__sector"), ["style"], limits["style"], "__style")
    now = current.groupBy("rebalance", "target").agg(F.sum("weight").alias("__now"))
    both = d.join(now, ["rebalance", "target"], "full")
    grows = F.coalesce("__near", F.lit(False)) & (F.abs("weight") > F.abs(F.coalesce("__now", F.lit(0.0))) + 1e-9)
    both = both.withColumn("__blocked", F.coalesce(grows, F.lit(False))).withColumn("__now", F.coalesce("__now", F.lit(0.0)))
    both = both.withColumn("weight", F.when(F.col("__blocked"), F.col("__now")).otherwise(F.col("weight")))
    told = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array(
        F.when(F.col("__over"), F.concat(F.lit("single_weight_exceeded:"), F.col("target").cast("string"))), F.when(F.col("__gross"), "gross_exposure_exceeded"), F.when(F.col("__sector"), F.concat(F.lit("sector_exposure_exceeded:"), F.col("sector"))),
        F.when(F.col("__style"), F.concat(F.lit("style_exposure_exceeded:"), F.col("style"))), F.when(F.col("__blocked"), "drawdown_near_limit_reduce_only"),
    ))))))
    gross, turnover = F.sum(F.abs("weight")).over(_all_in_order("rebalance")), F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.col("__now"))).over(_all_in_order("rebalance"))
    summed = both.withColumn("__g", gross).withColumn("__t", turnover)
    whole = summed.groupBy("rebalance").agg(F.coalesce(F.first("__g"), F.lit(0.0)).alias("gross"), F.first("__t").alias("turnover"), told.alias("violations")).join(states.select("rebalance", "drawdown"), "rebalance")
    late = F.array_compact(F.array(F.when(F.col("turnover") > limits["turnover"], "turnover_exceeded"), F.when(F.col("drawdown") > limits["drawdown"], "drawdown_exceeded")))
    return both.where("weight IS NOT NULL").select(*proposed.columns), whole.withColumn("violations", F.concat("violations", late)).drop("drawdown")


def allocate(signals: DataFrame, factors: DataFrame, budget: float, single: float = 0.20, shares: Mapping[str, float] = BUCKET_SHARES) -> DataFrame:
    """at, target, raw and weight of each target of each time.

    signals: at, target, horizon, bucket, action, score, confidence; factors: target, factor, by which targets that move
    together count less. Strengths of a target add up over horizons; the budget is shared by them, single weights are
    capped, and a bucket (and a bucket with its horizon) beyond its limit scales every target that it holds; at last all
    within the budget. A time without strength has no weights.
    """
    side = F.when(F.lower("action") == "buy", 1.0).when(F.lower("action") == "sell", -1.0)
    bucket = F.coalesce(F.nullif(F.lower(F.trim("bucket")), F.lit("")), F.lit("event"))
    s = signals.withColumn("bucket", bucket).withColumn("__side", side).where("__side IS NOT NULL").join(factors.select("target", "factor"), "target", "left")
    strength = F.col("__side") * F.abs("score") * clamp(F.col("confidence"), 0.0, 1.0) * F.coalesce("factor", F.lit(1.0))
    per = s.groupBy("at", "target", "horizon").agg(F.sum(strength).alias("v"), F.max("bucket").alias("bucket"))
    of = Window.partitionBy("at", "target")
    per = per.withColumn("raw", F.sum("v").over(of)).withColumn("__share", F.abs("v") / F.sum(F.abs("v")).over(of))
    target = per.groupBy("at", "target").agg(F.first("raw").alias("raw")).withColumn("__gross", F.sum(F.abs("raw")).over(Window.partitionBy("at"))).where("__gross > 1e-12")
    share = F.col("raw") / F.col("__gross") * budget
    target = target.withColumn("weight", F.when(F.abs(share) > single, F.signum(share) * single).otherwise(share))
    split = per.drop("raw").join(target.select("at", "target", "weight"), ["at", "target"]).withColumn("__e", F.abs("weight") * F.col("__share"))
    keys = split.select("at", "target", "__e", F.explode(F.array(F.concat_ws(":", "bucket", "horizon"), F.col("bucket"))).alias("key"))
    limit = F.lit(budget)
    for b, k in shares.items():
        limit = F.when(F.substring_index("key", ":", 1) == b, k * budget).otherwise(limit)
    held = F.sum("__e").over(Window.partitionBy("at", "key"))
    scaled = keys.withColumn("__scale", F.when(held > F.greatest(limit, F.lit(1e-12)), F.least(F.lit(1.0), limit / held)).otherwise(1.0))
    # A key scales a target once, however many of its horizons it holds.
    once = scaled.groupBy("at", "target", "key").agg(F.min("__scale").alias("__scale")).groupBy("at", "target").agg(F.product("__scale").alias("__scale"))
    out = target.join(once, ["at", "target"]).withColumn("weight", F.col("weight") * F.col("__scale"))
    after = F.sum(F.abs("weight")).over(Window.partitionBy("at"))
    return out.withColumn("__after", after).select("at", "target", "raw", F.when(F.col("__after") > max(budget, 1e-12), F.col("weight") * budget / F.col("__after")).otherwise(F.col("weight")).alias("weight"))


def momentum(bars: DataFrame, train: int, test: int, fee_bps: float, slippage_bps: float) -> DataFrame:
    """symbol, samples, ic, hit_rate, turnover, pnl_after_cost and max_drawdown of the momentum baseline, walking forward.

    bars: symbol, ts, close, volume. A fold trades `test` returns by the mean and deviation of the `train` returns before
    it: with the return before, if that lies beyond 0.2 deviations from the mean, capped the more the wilder prices
    were; changes pay fees, slippage and an impact that falls with the root of volume. Symbols with fewer than train +
    test + 2 bars have no row.
    """
    w = by()
    ret = F.col("close") / F.greatest(F.lag("close").over(w), F.lit(1e-12)) - F.lag("close").over(w) / F.greatest(F.lag("close").over(w), F.lit(1e-12))
    n = F.count("*").over(Window.partitionBy("symbol"))
    # Return j leads from bar j to bar j + 1, so the volume is that of the bar where it begins.
    r = bars.select("symbol", "ts", ret.alias("r"), F.lag("volume").over(w).alias("volume"), (F.row_number().over(w) - 2).alias("j"), n.alias("n")).where((F.col("j") >= 0) & (F.col("n") >= train + test + 2))
    # The folds that a return trains.
    first, last = F.greatest(F.lit(0), F.floor((F.col("j") - train) / test) + 1), F.floor(F.col("j") / test)
    stats = r.withColumn("fold", F.explode(F.sequence(first, F.greatest(first, last)))).where((F.col("j") >= F.col("fold") * test) & (F.col("j") < F.col("fold") * test + train))
    stats = stats.groupBy("symbol", "fold").agg(F.avg("r").alias("mu"), F.stddev_pop("r").alias("sigma"))
    d = r.withColumn("before", F.lag("r").over(by(order="j"))).withColumn("fold", F.floor((F.col("j") - train) / test)).where((F.col("j") >= train) & (F.col("j") < F.col("n") - 2))
    d = d.join(stats, ["symbol", "fold"])
    edge, limit = F.col("before") - F.col("mu"), F.greatest(F.lit(1e-6), 0.2 * F.col("sigma"))
    cap = F.greatest(F.lit(0.2), F.least(F.lit(1.0), 0.8 - 20 * F.col("sigma")))
    d = d.withColumn("signal", F.when(edge > limit, cap).when(edge < -limit, -cap).otherwise(0.0))
    d = d.withColumn("turn", F.abs(F.col("signal") - F.coalesce(F.lag("signal").over(by(order="j")), F.lit(0.0))))
    cost = (fee_bps + slippage_bps + F.least(F.lit(25.0), 1200 / F.sqrt(F.greatest(F.lit(1.0), F.coalesce("volume", F.lit(0.0)))))) / 1e4 * F.col("turn")
    d = equity(d.withColumn("ret", F.col("signal") * F.col("r") - cost), "ret", include_initial=True)
    ic = F.coalesce(correlation("signal", "r"), F.lit(0.0))
    return d.groupBy("symbol").agg(F.count("*").alias("samples"), ic.alias("ic"), F.avg((F.col("signal") * F.col("r") > 0).cast("double")).alias("hit_rate"), F.sum("turn").alias("turnover"), (F.max_by("equity", "j") - 1).alias("pnl_after_cost"), F.max(-F.col("drawdown")).alias("max_drawdown"))

"""Aggregations over series, orders and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import ranked
from .readiness import span
from .trailing import Trailing, trailing_sums


def liquidity_rank(bars: DataFrame, min_days: int, day: int) -> DataFrame:
    """symbol, turnover, bars, days, rank of symbols with at least min_days active days; ties of turnover go by symbol."""
    # Days are counted by a second level of sums: a distinct count would expand every row.
    by_day = bars.groupBy("symbol", F.floor(F.col("ts") / day).alias("day")).agg(F.sum(F.abs(F.col("close") * F.col("volume"))).alias("turnover"), F.count("*").alias("bars"))
    rows = by_day.groupBy("symbol").agg(F.sum("turnover").alias("turnover"), F.sum("bars").alias("bars"), F.count("day").alias("days"))
    return ranked(rows.where(F.col("days") >= min_days), F.desc("turnover"), "symbol")


def hysteresis(ranked_: DataFrame, previous: Sequence, top: int, keep: int) -> DataFrame:
    """The new universe: members of before that rank no lower than keep come first, then others by rank, top in all."""
    order = F.array_position(F.array(*map(F.lit, previous)), F.col("symbol"))
    kept = (order > 0) & (F.col("rank") <= keep)
    # Nobody beyond these can get in: kept ones are previous, and of the others the best `top` are enough.
    near = ranked_.withColumn("kept", kept).where(F.col("kept") | (F.col("rank") <= top + len(previous)))
    place = F.row_number().over(Window.orderBy(F.desc("kept"), F.when(F.col("kept"), order), "rank"))
    return near.withColumn("place", place).where(F.col("place") <= top).select("symbol", "rank", "kept", "place")


def coverage(times: DataFrame, width: int) -> DataFrame:
    """symbol, buckets, expected and coverage: the different buckets of each symbol against those from the table's first to its last, in one pass."""
    whole = span(times, width).select("expected")
    per = times.groupBy("symbol", F.floor(F.col("ts") / width).alias("b")).agg(F.lit(1)).groupBy("symbol").agg(F.count("b").alias("buckets"))
    return per.crossJoin(F.broadcast(whole)).select("symbol", "buckets", "expected", F.round(F.col("buckets") / F.col("expected"), 6).alias("coverage"))


def weighted(value: Column | str, weight: Column | str) -> Column:
    v, w = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    return F.sum(v * w) / F.nullif(F.sum(w), F.lit(0.0))


def pool_vectors(items: DataFrame, keys: Sequence[str], vector: str, weight: Column) -> DataFrame:
    """Weighted mean vector and mean deviation of its dimensions per group: grouped by dimension, then put together."""
    flat = items.select(*keys, weight.alias("w"), F.posexplode(vector).alias("dim", "x"))
    dims = flat.groupBy(*keys, "dim").agg(weighted("x", "w").alias("mean"), F.stddev_pop("x").alias("dev"))
    pooled = dims.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("m"), F.avg("dev").alias("disagreement"))
    return pooled.select(*keys, F.col("m.mean").alias("pooled"), "disagreement")


def _ratio(top, bottom, least: float = 1e-9) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(least))


def event_profile(grid: DataFrame, events: DataFrame, window: int, half: float = 12.0, step: int | None = None) -> DataFrame:
    """symbol, ts and 23 features of the events of the last `window` (its start excluded) at each grid time; zeros where there are none.

    events: symbol, ts (when available), source, tier_weight, confidence, raw_confidence, importance, novelty,
    post_sentiment, comment_sentiment, is_social, engagement, followers, comments. An event weighs tier_weight *
    confidence; those without weight don't count. A null source is one source. Two levels of sums, first per source, then over
    sources, so neither the entropy nor the deviations need a list of events; the sums are running ones in blocks of
    time, so no event meets the grid times of its window one by one. With step, of which all grid times, the window and an
    hour are multiples, events between two such times are summed up first.
    """
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    e = events.withColumn("ew", F.col("tier_weight") * F.col("confidence")).where("ew > 0").withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    e = e.withColumn("s", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * (F.col("post_sentiment") + F.col("comment_sentiment")))))
    hour, ew, s, social = 3_600_000_000, F.col("ew"), F.col("s"), F.col("is_social")
    only = lambda c: F.when(social, c).otherwise(0.0)
    sums = {
        "mass": ew, "tiers": F.col("tier_weight"), "confidences": F.col("raw_confidence"), "n": F.lit(1.0),
        "s1": ew * s, "s2": ew * s * s, "sabs": ew * F.abs(s), "importances": ew * unit(F.col("importance")), "novelties": ew * unit(F.col("novelty")) * unit(F.col("raw_confidence")),
        "soc_n": only(F.lit(1.0)), "soc": only(ew), "posts": only(ew * F.col("post_sentiment")), "said": only(ew * F.col("comment_sentiment")),
        "engaged": only(ew * F.log1p("engagement")), "followed": only(ew * F.log1p("followers")), "answers": only(F.greatest(F.lit(0.0), F.col("comments").cast("double"))),
    }
    # A grid time is asked about the sources that had an event in its block of time or the one before.
    block = F.floor(F.col("ts") / window).cast("long")
    active = e.select("symbol", "source", F.explode(F.array(block, block + 1)).alias("block")).distinct()
    asked = grid.select("symbol", "ts", block.alias("block")).distinct().join(active, ["symbol", "block"]).drop("block")
    spans = [Trailing(window, sums, {"decayed": (ew, half * hour)}), Trailing(hour, {"young": ew}, closed=True), Trailing(6 * hour, {"recent": ew}, closed=True)]
    per = trailing_sums(asked, e, spans, ["symbol", "source"], step=step).where("n > 0")
    per = per.withColumn("mid", F.col("recent") - F.col("young")).withColumn("old", F.col("mass") - F.col("recent"))
    sums = [c for c in per.columns if c not in ("symbol", "source", "ts", "recent")]
    all_ = per.groupBy("symbol", "ts").agg(*(F.sum(k).alias(k) for k in sums), F.count("*").alias("sources"), F.sum(F.col("mass") * F.log("mass")).alias("mlm"), F.sum(F.col("s1") * F.col("s1") / F.col("mass")).alias("between"))
    mean = F.col("s1") / F.col("mass")
    dev = lambda second: F.sqrt(F.greatest(F.lit(0.0), F.col(second) / F.col("mass") - mean * mean))
    has = F.col("soc") > 0
    post, comment = F.when(has, _ratio("posts", "soc")).otherwise(0.0), F.when(has, _ratio("said", "soc")).otherwise(0.0)
    one = F.lit(1.0)
    features = {
        "event_decay": _ratio("decayed", "mass"), "source_tier_weight": _ratio("tiers", "n"), "source_confidence": _ratio("confidences", "n"),
        "social_post_sentiment": post, "social_comment_sentiment": comment,
        "social_engagement_norm": F.when(has, F.tanh(_ratio("engaged", "soc") / 6)).otherwise(0.0), "social_influence_norm": F.when(has, F.tanh(_ratio("followed", "soc") / 14)).otherwise(0.0),
        "social_event_ratio": _ratio("soc_n", "n"), "social_buzz": F.tanh("soc"), "event_velocity_1h": F.tanh("young"), "event_velocity_6h": F.tanh((F.col("young") + F.col("mid")) / 6),
        "event_disagreement": F.least(one, dev("s2")), "source_diversity": F.when(F.col("sources") >= 2, (F.log("mass") - F.col("mlm") / F.col("mass")) / F.log(F.col("sources").cast("double"))).otherwise(0.0),
        "cross_source_consensus": 1 - F.least(one, dev("between")), "comment_skew": comment - post,
        "event_lag_bucket_0_1h": _ratio("young", "mass"), "event_lag_bucket_1_6h": _ratio("mid", "mass"), "event_lag_bucket_6_24h": _ratio("old", "mass"),
        "event_density": F.least(one, F.col("n") / 32), "sentiment_abs": F.least(one, _ratio("sabs", "mass")), "social_comment_rate": F.when(F.col("soc_n") > 0, F.tanh(F.col("answers") / F.greatest(one, F.col("soc_n") * 20))).otherwise(0.0),
        "event_importance_mean": _ratio("importances", "mass"), "novelty_confidence_blend": _ratio("novelties", "mass"),
    }
    found = all_.select("symbol", "ts", *(c.alias(k) for k, c in features.items()))
    return grid.select("symbol", "ts").join(found, ["symbol", "ts"], "left").fillna(0.0, list(features))


def social_profile(grid: DataFrame, buckets: DataFrame, window: int, cap: int = 256) -> DataFrame:
    """symbol, ts and 12 features of the social buckets of the last `window`, its start included, the newest `cap` of them; no row without any.

    buckets: symbol, ts, items, posts, comments, engagement, authors, post_sentiment, comment_sentiment.
    """
    from .align import range_join

    met = range_join(grid.select("symbol", "ts"), buckets.withColumnRenamed("ts", "right_ts"), ["symbol"], -window, 0)
    newest = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(F.desc("right_ts")))
    met = met.withColumn("turn", newest).where(F.col("turn") <= cap)
    one, w = F.lit(1.0), F.greatest(F.lit(1.0), F.col("items").cast("double"))
    clipped = lambda c: F.greatest(F.lit(-1.0), F.least(one, F.col(c)))
    total = lambda c: F.sum(F.greatest(F.lit(0.0), F.col(c).cast("double")))
    hour = F.sum(F.when(F.col("ts") - F.col("right_ts") <= 3_600_000_000, F.col("items").cast("double")).otherwise(0.0))
    t = met.groupBy("symbol", "ts").agg(F.count("*").alias("rows"), *(total(c).alias(c) for c in ("items", "posts", "comments", "engagement", "authors")), hour.alias("hour"), F.sum(w * clipped("post_sentiment")).alias("post"), F.sum(w * clipped("comment_sentiment")).alias("comment"))
    den = F.greatest(one, F.col("items"))
    post, comment = F.col("post") / den, F.col("comment") / den
    features = {
        "social_post_sentiment": post, "social_comment_sentiment": comment, "social_engagement_norm": F.tanh(F.log1p(F.col("engagement") / den) / 3), "social_influence_norm": F.tanh(F.log1p(F.col("authors") / F.greatest(one, F.col("rows"))) / 2),
        "social_event_ratio": F.least(one, F.col("items") / 72), "social_buzz": F.tanh(F.log1p("items") / 4), "event_velocity_1h": F.tanh(F.col("hour") / 12), "event_velocity_6h": F.tanh(F.col("items") / 72),
        "comment_skew": comment - post, "event_density": F.least(one, F.col("items") / 72), "sentiment_abs": F.least(one, F.abs(0.5 * (post + comment))), "social_comment_rate": F.col("comments") / F.greatest(one, F.col("posts")),
    }
    return t.select("symbol", "ts", *(c.alias(k) for k, c in features.items()))


def blend_profiles(base: DataFrame, override: DataFrame, alpha: float = 0.35) -> DataFrame:
    """base with the features of override mixed in by alpha; where base has 0, override counts alone; base stays where override has no row."""
    shared = [c for c in override.columns if c not in ("symbol", "ts")]
    o = override.withColumnsRenamed({c: f"__{c}" for c in shared})
    mixed = [F.when(F.col(f"__{c}").isNull(), F.col(c)).when(F.abs(F.col(c)) <= 1e-12, F.col(f"__{c}")).otherwise((1 - alpha) * F.col(c) + alpha * F.col(f"__{c}")).alias(c) if c in shared else F.col(c) for c in base.columns]
    return base.join(o, ["symbol", "ts"], "left").select(*mixed)


def rolling_events(grid: DataFrame, events: DataFrame, windows: dict[str, int], value: str) -> DataFrame:
    """Counts and means of events in trailing windows, both ends included, at each grid time, one row for each row of the grid: running sums in blocks of time, so a long window costs no more than a short one."""
    v = F.col(value)
    spans = [Trailing(width, {f"n_{name}": F.when(v.isNotNull(), 1), f"sum_{name}": v}, closed=True) for name, width in windows.items()]
    found = trailing_sums(grid, events, spans)
    out = [c for name in windows for c in (F.col(f"n_{name}").cast("long").alias(f"n_{name}"), (F.col(f"sum_{name}") / F.nullif(f"n_{name}", F.lit(0.0))).alias(f"mean_{name}"))]
    return grid.select("symbol", "ts").join(found.select("symbol", "ts", *out), ["symbol", "ts"])


def rollup_fills(fills: DataFrame) -> DataFrame:
    """Per order: filled quantity, notional, average price, fees, status."""
    live = F.col("status") != "rejected"
    total = fills.groupBy("order_id").agg(F.sum("qty").alias("qty"), F.sum(F.when(live, F.col("qty")).otherwise(0.0)).alias("filled"), F.sum(F.when(live, F.col("qty") * F.col("price")).otherwise(0.0)).alias("notional"), F.sum(F.when(live, F.col("fee")).otherwise(0.0)).alias("fees"))
    status = F.when(F.col("filled") <= 0, "submitted").when(F.col("filled") < F.col("qty"), "partial").otherwise("filled")
    return total.select("order_id", "filled", "notional", (F.col("notional") / F.nullif("filled", F.lit(0.0))).alias("vwap"), "fees", status.alias("status"))


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """The least upper bound `le` whose cumulative count reaches q of all."""
    w = Window.partitionBy(*keys)
    cum = buckets.withColumn("cum", F.sum("n").over(w.orderBy("le"))).withColumn("total", F.sum("n").over(w))
    return cum.where(F.col("cum") >= q * F.col("total")).groupBy(*keys).agg(F.min("le").alias("quantile"))

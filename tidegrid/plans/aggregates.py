"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import rolling as R
from ..operators import sizing as Z
from ..operators.evaluate import portfolio_score
from ..operators.order import quantiles, ranked, written
from ..sources.fixtures import BARS, DAY, DAYS, FILLS, HOUR, NEWS, PREDICTIONS, TICKS, bars, days, fills, news, predictions, table, ticks
from .registry import query

_T0 = 1_704_067_200_000_000


def r6(c, name, n=6):
    return F.round(c, n).alias(name)


_RANK = DAYS + f", rank AS (SELECT symbol, turnover, bars, d AS days, row_number() OVER (ORDER BY turnover DESC, symbol) AS rank FROM (SELECT symbol, sum(abs(close * volume)) AS turnover, count(*) AS bars, count(DISTINCT ts // {DAY}) AS d FROM days GROUP BY 1 HAVING count(DISTINCT ts // {DAY}) >= 20))"


@query(f"WITH {_RANK} SELECT symbol, round(turnover, 2) AS turnover, bars, days, rank FROM rank")
def ag01_liquidity_rank(spark, sf):
    return A.liquidity_rank(days(spark, sf), 20, DAY).withColumn("turnover", F.round("turnover", 2))


@query(f"WITH {_RANK}, k AS (SELECT symbol, rank, list_position([7, 3, 5, 9, 1]::BIGINT[], symbol) AS pos FROM rank), f AS (SELECT symbol, rank, coalesce(pos > 0, false) AND rank <= 60 AS kept, pos FROM k), p AS (SELECT *, row_number() OVER (ORDER BY kept DESC, CASE WHEN kept THEN pos END, rank) AS place FROM f) SELECT symbol, rank, kept, place FROM p WHERE place <= 10")
def ag02_hysteresis(spark, sf):
    return A.hysteresis(A.liquidity_rank(days(spark, sf), 20, DAY), [7, 3, 5, 9, 1], 10, 60)


@query(f"WITH {_RANK} SELECT sha256(string_agg(symbol::VARCHAR, ',' ORDER BY rank)) AS snapshot_hash, count(*) AS members FROM rank WHERE rank <= 50")
def ag03_snapshot_hash(spark, sf):
    top = A.liquidity_rank(days(spark, sf), 20, DAY).where("rank <= 50").agg(F.array_sort(F.collect_list(F.struct("rank", "symbol"))).alias("s"))
    return top.select(F.sha2(F.array_join(F.col("s.symbol").cast("array<string>"), ","), 256).alias("snapshot_hash"), F.size("s").cast("long").alias("members"))


@query(f"WITH {TICKS}, g AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts, id) AS p FROM ticks) SELECT symbol, count(*) AS total, count(*) FILTER (WHERE price IS NULL) AS nulls, count(*) FILTER (WHERE price <= 1) AS invalid, count(*) FILTER (WHERE ts = p) AS duplicates, count(*) FILTER (WHERE ts - p > {2 * HOUR}) AS gaps, round(count(*) FILTER (WHERE ts - p > {2 * HOUR}) / count(*), 6) AS gap_rate, count(*) FILTER (WHERE ts - p > {2 * HOUR}) / count(*) < 0.05 AS passed FROM g GROUP BY 1")
def ag04_quality_window(spark, sf):
    t = R.previous(ticks(spark, sf), "ts", 7 * DAY)
    g = t.withColumn("gap", F.col("ts") - F.col("prev_ts")).groupBy("symbol").agg(F.count("*").alias("total"), F.count_if(F.col("price").isNull()).alias("nulls"), F.count_if(F.col("price") <= 1).alias("invalid"), F.count_if(F.col("gap") == 0).alias("duplicates"), F.count_if(F.col("gap") > 2 * HOUR).alias("gaps"))
    rate = F.col("gaps") / F.col("total")
    return g.withColumn("gap_rate", F.round(rate, 6)).withColumn("passed", rate < 0.05)


@query(f"WITH {TICKS}, rng AS (SELECT max(ts) // {HOUR} - min(ts) // {HOUR} + 1 AS n FROM ticks) SELECT symbol, count(DISTINCT ts // {HOUR}) AS buckets, any_value(n) AS expected, round(count(DISTINCT ts // {HOUR}) / any_value(n), 6) AS coverage FROM ticks, rng GROUP BY 1")
def ag05_coverage(spark, sf):
    return A.coverage(ticks(spark, sf), HOUR)


_QS = ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))


@query(f"WITH {NEWS} SELECT symbol, " + ", ".join(f"round(quantile_cont(greatest(0, available - occurred) / 1e6, {q}), 6) AS {n}" for q, n in _QS) + " FROM news GROUP BY 1")
def ag06_latency_quantiles(spark, sf):
    lag = F.greatest(F.lit(0), F.col("available") - F.col("occurred")) / 1e6
    found = quantiles(news(spark, sf), ["symbol"], lag, {n: q for q, n in _QS})
    return found.select("symbol", *(r6(F.col(n), n) for _, n in _QS))


@query("WITH d AS (SELECT DISTINCT conv_id, turn, role, length(text) AS n FROM conversations) SELECT role, count(*) FILTER (WHERE turn = 0) AS posts, count(*) FILTER (WHERE turn > 0) AS comments, count(DISTINCT conv_id) AS threads, round(count(*) FILTER (WHERE n > 100) / count(*), 6) AS enriched_ratio, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, round(avg(n), 6) AS mean FROM d GROUP BY 1 ORDER BY comments DESC LIMIT 20")
def ag07_ingest_coverage(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n")).distinct()
    return d.groupBy("role").agg(F.count_if(F.col("turn") == 0).alias("posts"), F.count_if(F.col("turn") > 0).alias("comments"), F.countDistinct("conv_id").alias("threads"), r6(F.count_if(F.col("n") > 100) / F.count("*"), "enriched_ratio"), F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.9).alias("p90"), r6(F.avg("n"), "mean")).orderBy(F.desc("comments")).limit(20)


@query("WITH p AS (SELECT conv_id % 10 AS bucket, count(*) AS posts FROM conversations WHERE turn = 0 GROUP BY 1), c AS (SELECT conv_id % 10 AS bucket, count(*) AS comments FROM conversations WHERE turn > 0 GROUP BY 1) SELECT bucket, coalesce(posts, 0) AS posts, coalesce(comments, 0) AS comments, round(coalesce(comments, 0) / nullif(posts, 0), 6) AS ratio, coalesce(comments, 0) < 2 * coalesce(posts, 0) AS abnormal FROM p FULL JOIN c USING (bucket)")
def ag08_comment_ratio(spark, sf):
    c = table(spark, sf, "conversations").withColumn("bucket", F.col("conv_id") % 10)
    posts, comments = (c.where(x).groupBy("bucket").agg(F.count("*").alias(n)) for x, n in (("turn = 0", "p"), ("turn > 0", "c")))
    p, k = F.coalesce("p", F.lit(0)), F.coalesce("c", F.lit(0))
    return posts.join(comments, "bucket", "full").select("bucket", p.alias("posts"), k.alias("comments"), r6(k / F.nullif("p", F.lit(0)), "ratio"), (k < 2 * p).alias("abnormal"))


@query("WITH w AS (SELECT label, 1 + sqrt(vec_id % 16) AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), d AS (SELECT label, dim, sum(x * w) / sum(w) AS m, stddev_pop(x) AS s FROM w GROUP BY 1, 2), g AS (SELECT label, avg(s) AS dis, list(m ORDER BY dim) AS v FROM d GROUP BY 1) SELECT g.label, count(*) AS num_items, count(DISTINCT vec_id % 50) AS unique_authors, round(least(1, count(*) / 12), 6) AS coverage, round(any_value(dis), 6) AS disagreement, round(any_value(v)[1], 6) AS first_dim, round(any_value(v)[64], 6) AS last_dim FROM g JOIN embeddings e ON g.label = e.label GROUP BY 1")
def ag09_text_pooling(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))
    pooled = A.pool_vectors(e, ["label"], "vector", 1 + F.sqrt(F.col("vec_id") % 16))
    facts = e.groupBy("label").agg(F.count("*").alias("num_items"), F.countDistinct(F.col("vec_id") % 50).alias("unique_authors"))
    return facts.join(pooled, "label").select("label", "num_items", "unique_authors", r6(F.least(F.lit(1.0), F.col("num_items") / 12), "coverage"), r6(F.col("disagreement"), "disagreement"), r6(F.col("pooled")[0], "first_dim"), r6(F.col("pooled")[63], "last_dim"))


_SOCIAL = "greatest(0, least(1, (6 - tier) / 5.0::DOUBLE)) AS tw, confidence AS conf, (id % 10) / 10 AS imp, (id % 7) / 7 AS nov, sentiment AS ps, (id % 13 - 6) / 6 AS cs, id % 2 = 0 AS soc, id % 500 AS eng, (id % 1000) * 10 AS fol, id % 9 AS com"
_PROFILE = NEWS + f""", g AS (SELECT DISTINCT symbol, ts - ts % {6 * HOUR} + {6 * HOUR} AS ts FROM ticks), ev AS (SELECT symbol, ts, source, {_SOCIAL} FROM news),
m AS (SELECT g.symbol, g.ts, source, tw, conf, imp, nov, ps, cs, soc, eng, fol, com, tw * conf AS ew, greatest(-1, least(1, 0.5 * (ps + cs))) AS s, (g.ts - e.ts) / 3.6e9 AS age FROM g JOIN ev e ON g.symbol = e.symbol AND e.ts > g.ts - {DAY} AND e.ts <= g.ts WHERE tw * conf > 0),
src AS (SELECT symbol, ts, source, sum(ew) AS mass, sum(ew * s) AS s1 FROM m GROUP BY 1, 2, 3),
sa AS (SELECT symbol, ts, count(*) AS k, -sum(mass / tot * ln(mass / tot)) AS ent, sum(mass * (s1 / mass - mean) ** 2) / any_value(tot) AS var FROM (SELECT *, sum(mass) OVER w AS tot, sum(s1) OVER w / sum(mass) OVER w AS mean FROM src WINDOW w AS (PARTITION BY symbol, ts)) GROUP BY 1, 2),
t AS (SELECT symbol, ts, count(*) AS n, sum(ew) AS mass, sum(ew * exp(-age / 12)) AS decayed, avg(tw) AS tier, avg(conf) AS conf, sum(ew) FILTER (WHERE age <= 1) AS y, sum(ew) FILTER (WHERE age > 1 AND age <= 6) AS mi, sum(ew) FILTER (WHERE age > 6) AS o, sum(ew * s) / sum(ew) AS mean, sum(ew * s * s) / sum(ew) AS sq, sum(ew * abs(s)) / sum(ew) AS sabs, sum(ew * imp) / sum(ew) AS imp, sum(ew * nov * conf) / sum(ew) AS nov, count(*) FILTER (WHERE soc) AS sn, coalesce(sum(ew) FILTER (WHERE soc), 0) AS sm, sum(ew * ps) FILTER (WHERE soc) AS ps, sum(ew * cs) FILTER (WHERE soc) AS cs, sum(ew * ln(1 + eng)) FILTER (WHERE soc) AS eng, sum(ew * ln(1 + fol)) FILTER (WHERE soc) AS fol, sum(com) FILTER (WHERE soc) AS com FROM m GROUP BY 1, 2),
prof AS (SELECT g.symbol, g.ts, coalesce(decayed / mass, 0) AS event_decay, coalesce(tier, 0) AS source_tier_weight, coalesce(conf, 0) AS source_confidence, coalesce(ps / sm, 0) AS social_post_sentiment, coalesce(cs / sm, 0) AS social_comment_sentiment, coalesce(tanh(eng / sm / 6), 0) AS social_engagement_norm, coalesce(tanh(fol / sm / 14), 0) AS social_influence_norm, coalesce(sn / n, 0) AS social_event_ratio, coalesce(tanh(sm), 0) AS social_buzz, coalesce(tanh(y), 0) AS event_velocity_1h, coalesce(tanh((coalesce(y, 0) + coalesce(mi, 0)) / 6), 0) AS event_velocity_6h, coalesce(least(1, sqrt(greatest(0, sq - mean * mean))), 0) AS event_disagreement, CASE WHEN k >= 2 THEN ent / ln(k) ELSE 0 END AS source_diversity, coalesce(1 - least(1, sqrt(greatest(0, var))), 0) AS cross_source_consensus, coalesce(cs / sm - ps / sm, 0) AS comment_skew, coalesce(y / mass, 0) AS event_lag_bucket_0_1h, coalesce(mi / mass, 0) AS event_lag_bucket_1_6h, coalesce(o / mass, 0) AS event_lag_bucket_6_24h, coalesce(least(1, n / 32), 0) AS event_density, coalesce(least(1, sabs), 0) AS sentiment_abs, coalesce(tanh(com / greatest(1, sn * 20)), 0) AS social_comment_rate, coalesce(imp, 0) AS event_importance_mean, coalesce(nov, 0) AS novelty_confidence_blend FROM g LEFT JOIN t ON g.symbol = t.symbol AND g.ts = t.ts LEFT JOIN sa ON g.symbol = sa.symbol AND g.ts = sa.ts)"""
_PROFILE_NAMES = ("event_decay", "source_tier_weight", "source_confidence", "social_post_sentiment", "social_comment_sentiment", "social_engagement_norm", "social_influence_norm", "social_event_ratio", "social_buzz", "event_velocity_1h", "event_velocity_6h", "event_disagreement", "source_diversity", "cross_source_consensus", "comment_skew", "event_lag_bucket_0_1h", "event_lag_bucket_1_6h", "event_lag_bucket_6_24h", "event_density", "sentiment_abs", "social_comment_rate", "event_importance_mean", "novelty_confidence_blend")


def event_profile_at(spark, sf):
    grid = ticks(spark, sf).select("symbol", (F.col("ts") - F.pmod("ts", F.lit(6 * HOUR)) + 6 * HOUR).alias("ts")).distinct()
    i = F.col("id")
    events = news(spark, sf).select("symbol", "ts", "source", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (6 - F.col("tier")) / 5)).alias("tier_weight"), "confidence", F.col("confidence").alias("raw_confidence"), (i % 10 / 10).alias("importance"), (i % 7 / 7).alias("novelty"), F.col("sentiment").alias("post_sentiment"), ((i % 13 - 6) / 6).alias("comment_sentiment"), (i % 2 == 0).alias("is_social"), (i % 500).alias("engagement"), (i % 1000 * 10).alias("followers"), (i % 9).alias("comments"))
    return grid, A.event_profile(grid, events, DAY, step=HOUR)


@query(f"WITH {_PROFILE} SELECT symbol, ts, " + ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in _PROFILE_NAMES) + " FROM prof")
def ag10_event_profile(spark, sf):
    return event_profile_at(spark, sf)[1].select("symbol", "ts", *((F.round(c, 9) + 0.0).alias(c) for c in _PROFILE_NAMES))


_SOCIAL_NAMES = tuple(c for c in _PROFILE_NAMES if c in ("social_post_sentiment", "social_comment_sentiment", "social_engagement_norm", "social_influence_norm", "social_event_ratio", "social_buzz", "event_velocity_1h", "event_velocity_6h", "comment_skew", "event_density", "sentiment_abs", "social_comment_rate"))
_BUCKETS = f", bk AS (SELECT symbol, ts - ts % 300000000 + 300000000 AS ts, count(*) AS items, count(*) FILTER (WHERE id % 3 = 0) AS posts, count(*) FILTER (WHERE id % 3 <> 0) AS comments, sum(id % 500) AS engagement, count(DISTINCT user_id) AS authors, avg((id % 21 - 10) / 10) AS post, avg((id % 13 - 6) / 6) AS comment FROM ticks GROUP BY 1, ticks.ts - ticks.ts % 300000000), j AS (SELECT g.symbol, g.ts, bk.* EXCLUDE (symbol, ts), g.ts - bk.ts <= {HOUR} AS young, row_number() OVER (PARTITION BY g.symbol, g.ts ORDER BY bk.ts DESC) AS turn FROM g JOIN bk ON g.symbol = bk.symbol AND bk.ts BETWEEN g.ts - {6 * HOUR} AND g.ts), st AS (SELECT symbol, ts, count(*) AS r, sum(items) AS items, sum(posts) AS posts, sum(comments) AS comments, sum(engagement) AS eng, sum(authors) AS aut, sum(CASE WHEN young THEN items ELSE 0 END) AS hour, sum(items * post) / sum(items) AS post, sum(items * comment) / sum(items) AS comment FROM j WHERE turn <= 256 GROUP BY 1, 2), so AS (SELECT symbol, ts, post AS social_post_sentiment, comment AS social_comment_sentiment, tanh(ln(1 + eng / items) / 3) AS social_engagement_norm, tanh(ln(1 + aut / r) / 2) AS social_influence_norm, least(1, items / 72) AS social_event_ratio, tanh(ln(1 + items) / 4) AS social_buzz, tanh(hour / 12) AS event_velocity_1h, tanh(items / 72) AS event_velocity_6h, comment - post AS comment_skew, least(1, items / 72) AS event_density, least(1, abs(0.5 * (post + comment))) AS sentiment_abs, comments / greatest(1, posts) AS social_comment_rate FROM st)"


@query(f"WITH {_PROFILE}{_BUCKETS} SELECT p.symbol, p.ts, " + ", ".join(f"round(CASE WHEN so.{c} IS NULL THEN p.{c} WHEN abs(p.{c}) <= 1e-12 THEN so.{c} ELSE 0.65 * p.{c} + 0.35 * so.{c} END, 9) + 0.0 AS {c}" for c in _SOCIAL_NAMES) + " FROM prof p LEFT JOIN so ON p.symbol = so.symbol AND p.ts = so.ts")
def ag11_social_blend(spark, sf):
    grid, profile = event_profile_at(spark, sf)
    t, i = ticks(spark, sf), F.col("id")
    bucket = (F.col("ts") - F.pmod("ts", F.lit(300_000_000)) + 300_000_000).alias("bucket")
    facts = (F.count("*").alias("items"), F.count_if(i % 3 == 0).alias("posts"), F.count_if(i % 3 != 0).alias("comments"), F.sum(i % 500).alias("engagement"), F.countDistinct("user_id").alias("authors"), F.avg((i % 21 - 10) / 10).alias("post_sentiment"), F.avg((i % 13 - 6) / 6).alias("comment_sentiment"))
    buckets = t.groupBy("symbol", bucket).agg(*facts).withColumnRenamed("bucket", "ts")
    blended = A.blend_profiles(profile, A.social_profile(grid, buckets, 6 * HOUR))
    return blended.select("symbol", "ts", *((F.round(c, 9) + 0.0).alias(c) for c in _SOCIAL_NAMES))


@query(f"WITH {BARS}, g AS (SELECT symbol, ts FROM bars) SELECT g.symbol, g.ts, " + ", ".join(f"(SELECT count(*) FROM ticks t WHERE t.symbol = g.symbol AND t.ts BETWEEN g.ts - {h * HOUR} AND g.ts) AS n_{h}h, round((SELECT avg(price) FROM ticks t WHERE t.symbol = g.symbol AND t.ts BETWEEN g.ts - {h * HOUR} AND g.ts), 6) AS mean_{h}h" for h in (1, 6)) + " FROM g")
def ag12_rolling_events(spark, sf):
    e = A.rolling_events(bars(spark, sf).select("symbol", "ts"), ticks(spark, sf), {"1h": HOUR, "6h": 6 * HOUR}, "price")
    return e.select("symbol", "ts", "n_1h", r6(F.col("mean_1h"), "mean_1h"), "n_6h", r6(F.col("mean_6h"), "mean_6h"))


@query(f"WITH {FILLS}, s AS (SELECT order_id, sum(qty) AS qty, sum(CASE WHEN status <> 'rejected' THEN qty ELSE 0 END) AS filled, sum(CASE WHEN status <> 'rejected' THEN qty * price ELSE 0 END) AS notional, sum(CASE WHEN status <> 'rejected' THEN fee ELSE 0 END) AS fees FROM fills GROUP BY 1) SELECT order_id, filled, round(notional, 4) AS notional, round(notional / nullif(filled, 0), 9) AS vwap, round(fees, 4) AS fees, CASE WHEN filled <= 0 THEN 'submitted' WHEN filled < qty THEN 'partial' ELSE 'filled' END AS status FROM s")
def ag13_fill_rollup(spark, sf):
    return A.rollup_fills(fills(spark, sf)).withColumns({"notional": F.round("notional", 4), "vwap": F.round("vwap", 9), "fees": F.round("fees", 4)})


_SLIP = "(price - est_price) / est_price * 1e4 * CASE WHEN side = 'buy' THEN 1 ELSE -1 END"


def _slip():
    return (F.col("price") - F.col("est_price")) / F.col("est_price") * 1e4 * F.when(F.col("side") == "buy", 1).otherwise(-1)


@query(f"WITH {FILLS} SELECT round(quantile_cont({_SLIP}, 0.5), 6) AS slip_p50, round(quantile_cont({_SLIP}, 0.9), 6) AS slip_p90, round(count(*) FILTER (WHERE status = 'rejected') / count(*), 6) AS reject_rate, round(quantile_cont((ts - ordered) / 1e6, 0.5), 6) AS latency_p50, max(ts) AS last_fill FROM fills")
def ag14_execution_stats(spark, sf):
    # The join is made once; each quantile reads its own column.
    f = written(fills(spark, sf).select(_slip().alias("slip"), ((F.col("ts") - F.col("ordered")) / 1e6).alias("latency"), "status", "ts"))
    slip = quantiles(f, [], "slip", {"slip_p50": 0.5, "slip_p90": 0.9}, stored=True)
    latency = quantiles(f, [], "latency", {"latency_p50": 0.5}, stored=True)
    rest = f.agg(r6(F.count_if(F.col("status") == "rejected") / F.count("*"), "reject_rate"), F.max("ts").alias("last_fill"))
    # Three single rows.
    return slip.crossJoin(latency).crossJoin(rest).select(*(r6(F.col(c), c) for c in ("slip_p50", "slip_p90", "latency_p50")), "reject_rate", "last_fill")


@query(f"WITH {FILLS} SELECT target, round(sum(CASE WHEN side = 'buy' THEN qty * price ELSE -qty * price END), 2) AS notional, round(sum(fee), 2) AS cost, count(*) AS orders, count(*) FILTER (WHERE status = 'rejected') AS rejects FROM fills GROUP BY ROLLUP (target)")
def ag15_attribution(spark, sf):
    signed = F.col("qty") * F.col("price") * F.when(F.col("side") == "buy", 1).otherwise(-1)
    return fills(spark, sf).rollup("target").agg(F.round(F.sum(signed), 2).alias("notional"), F.round(F.sum("fee"), 2).alias("cost"), F.count("*").alias("orders"), F.count_if(F.col("status") == "rejected").alias("rejects"))


@query(f"WITH {FILLS} SELECT target, round(sum({_SLIP} * qty * price) / sum(qty * price), 6) AS realised_bps, round(sum(fee) / sum(qty * price) * 1e4, 6) AS fee_bps, round(sum(greatest({_SLIP}, 0) * qty * price) / sum(qty * price), 6) AS adverse_bps FROM fills WHERE status <> 'rejected' GROUP BY 1")
def ag16_realised(spark, sf):
    n = F.col("qty") * F.col("price")
    return fills(spark, sf).where("status <> 'rejected'").groupBy("target").agg(r6(A.weighted(_slip(), n), "realised_bps"), r6(F.sum("fee") / F.sum(n) * 1e4, "fee_bps"), r6(A.weighted(F.greatest(_slip(), F.lit(0.0)), n), "adverse_bps"))


#: A run of every week with its result per symbol as JSON; odd weeks have only a total, which is split equally.
_RUNS = BARS + f", wk AS (SELECT ts // {7 * DAY} AS week, symbol, round(sum(close - open), 4) AS pnl FROM bars GROUP BY 1, 2), runs AS (SELECT week, list(symbol ORDER BY symbol) AS targets, sum(pnl) AS total, CASE WHEN week % 2 = 0 THEN map_from_entries(list((symbol, pnl))) END AS per_target FROM wk GROUP BY 1)"


def _runs(spark, sf):
    wk = bars(spark, sf).groupBy(F.floor(F.col("ts") / (7 * DAY)).alias("week"), "symbol").agg(F.round(F.sum(F.col("close") - F.col("open")), 4).alias("pnl"))
    per = F.to_json(F.map_from_entries(F.collect_list(F.struct("symbol", "pnl"))))
    return wk.groupBy("week").agg(F.array_sort(F.collect_list("symbol")).alias("targets"), F.sum("pnl").alias("total"), F.when(F.col("week") % 2 == 0, per).alias("metrics"))


@query(f"WITH {_RUNS}, t AS (SELECT week, unnest(targets) AS target, total, len(targets) AS n, per_target FROM runs) SELECT target, round(sum(coalesce(per_target[target], total / n)), 4) AS pnl FROM t GROUP BY 1")
def ag17_run_pnl(spark, sf):
    per = F.from_json("metrics", "map<string, double>")
    t = _runs(spark, sf).select("total", F.size("targets").alias("n"), per.alias("per"), F.explode("targets").alias("target"))
    return t.groupBy("target").agg(F.round(F.sum(F.coalesce(F.try_element_at("per", F.col("target")), F.col("total") / F.col("n"))), 4).alias("pnl"))


@query(f"WITH {FILLS}, e AS (SELECT target, sum(qty * (est_price - price / 1000)) AS net, sum(qty * price / 1000) AS gross, sum(CASE WHEN est_price < price / 1000 THEN qty * (price / 1000 - est_price) ELSE 0 END) AS loss FROM fills GROUP BY 1) SELECT target, round(net, 2) AS net, round(gross, 2) AS gross, round(least(5, greatest(0, loss / nullif(gross, 0))), 6) AS loss_ratio FROM e")
def ag18_edge_window(spark, sf):
    edge = F.col("est_price") - F.col("price") / 1000
    e = fills(spark, sf).groupBy("target").agg(F.sum(F.col("qty") * edge).alias("net"), F.sum(F.col("qty") * F.col("price") / 1000).alias("gross"), F.sum(F.when(edge < 0, -F.col("qty") * edge).otherwise(0.0)).alias("loss"))
    return e.select("target", F.round("net", 2).alias("net"), F.round("gross", 2).alias("gross"), r6(F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.col("loss") / F.nullif("gross", F.lit(0.0)))), "loss_ratio"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS horizon, event_type AS target, user_id % 3 AS strategy, count(*) AS n, round(sum(value), 4) AS pnl FROM events GROUP BY 1, 2, 3")
def ag19_pnl_buckets(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy((F.col("p.k") % 4).alias("horizon"), F.col("event_type").alias("target"), (F.col("user_id") % 3).alias("strategy")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("pnl"))


_EDGES = (0, 0.4, 0.55, 0.7, 0.85, 1.0)


@query(f"WITH {PREDICTIONS}, b AS (SELECT *, CASE WHEN p_up < 0.4 THEN 0 WHEN p_up < 0.55 THEN 1 WHEN p_up < 0.7 THEN 2 WHEN p_up < 0.85 THEN 3 ELSE 4 END AS bucket FROM predictions) SELECT bucket, count(*) AS n, round(avg(abs(mu)), 6) AS score, count(*) FILTER (WHERE symbol = 'click') AS click, count(*) FILTER (WHERE symbol = 'view') AS view FROM b GROUP BY 1")
def ag20_confidence_buckets(spark, sf):
    bucket = F.when(F.col("p_up") < _EDGES[1], 0).when(F.col("p_up") < _EDGES[2], 1).when(F.col("p_up") < _EDGES[3], 2).when(F.col("p_up") < _EDGES[4], 3).otherwise(4)
    return predictions(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg(F.abs("mu")), "score"), *(F.count_if(F.col("symbol") == s).alias(s) for s in ("click", "view")))


_CUT = _T0 + 15 * DAY


@query(f"WITH {PREDICTIONS} SELECT symbol, count(*) FILTER (WHERE ts >= {_CUT}) AS n_now, count(*) FILTER (WHERE ts < {_CUT}) AS n_ref, round(avg(mu) FILTER (WHERE ts >= {_CUT}) - avg(mu) FILTER (WHERE ts < {_CUT}), 6) AS mean_shift, round(stddev_pop(mu) FILTER (WHERE ts >= {_CUT}) - stddev_pop(mu) FILTER (WHERE ts < {_CUT}), 6) AS std_shift FROM predictions GROUP BY 1")
def ag21_prediction_shift(spark, sf):
    now = F.col("ts") >= _CUT
    a, b = F.when(now, F.col("mu")), F.when(~now, F.col("mu"))
    return predictions(spark, sf).groupBy("symbol").agg(F.count(a).alias("n_now"), F.count(b).alias("n_ref"), r6(F.avg(a) - F.avg(b), "mean_shift"), r6(F.stddev_pop(a) - F.stddev_pop(b), "std_shift"))


@query("SELECT source, count(*) AS total, sum(quality)::BIGINT AS approved, round(sum(quality) / count(*), 6) AS precision, round(sum(toxic) / count(*), 6) AS toxic_rate FROM labels JOIN documents USING (doc_id) GROUP BY 1 ORDER BY total DESC, source LIMIT 50")
def ag22_review_stats(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("total"), F.sum("quality").alias("approved"), r6(F.sum("quality") / F.count("*"), "precision"), r6(F.sum("toxic") / F.count("*"), "toxic_rate")).orderBy(F.desc("total"), "source").limit(50)


@query(f"WITH {PREDICTIONS}, p AS (SELECT symbol, CASE WHEN mu > 0 THEN 'trend' ELSE 'revert' END AS strategy, sign(mu) * y AS pnl, ts FROM predictions), t AS (SELECT pnl, row_number() OVER (ORDER BY pnl, ts, symbol) AS rn, count(*) OVER () AS n FROM p), tail AS (SELECT round(avg(pnl), 6) AS tail_mean FROM t WHERE rn <= greatest(1, round(n * 0.01))) SELECT symbol, strategy, count(*) AS n, round(avg(pnl), 6) AS mean, any_value(tail_mean) AS tail_mean FROM p, tail GROUP BY GROUPING SETS ((symbol), (strategy), ())")
def ag23_run_summary(spark, sf):
    p = predictions(spark, sf).select("symbol", F.when(F.col("mu") > 0, "trend").otherwise("revert").alias("strategy"), (F.signum("mu") * F.col("y")).alias("pnl"), "ts")
    # The worst hundredth by ranks of a distributed sort; the number of rows is one more single-row sum of the plan.
    size = p.agg(F.greatest(F.lit(1), F.round(F.count("*") * 0.01)).alias("k"))
    tail = ranked(p, "pnl", "ts", "symbol").crossJoin(F.broadcast(size)).where("rank <= k").agg(F.round(F.avg("pnl"), 6).alias("tail_mean"))
    sets = p.groupingSets([["symbol"], ["strategy"], []], "symbol", "strategy").agg(F.count("*").alias("n"), r6(F.avg("pnl"), "mean"))
    return sets.crossJoin(F.broadcast(tail))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source")
def ag24_source_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


_PROPOSED = """w AS (SELECT c_custkey // 12 AS rebalance, c_custkey AS target, c_acctbal / 20000 AS w0, c_mktsegment AS sector, CASE WHEN c_nationkey % 2 = 0 THEN 'growth' ELSE 'value' END AS style, c_custkey // 12 % 10 / 40.0::DOUBLE AS dd FROM customer),
a AS (SELECT *, CASE WHEN dd >= 0.08 THEN greatest(0.01, 0.2 * greatest(0.25, 1 - 0.75 * least(1, greatest(0, (dd - 0.08) / 0.12)))) ELSE 0.2 END AS cap FROM w), b AS (SELECT *, abs(w0) > cap AS over, CASE WHEN abs(w0) > cap THEN sign(w0) * cap ELSE w0 END AS w1 FROM a),
g AS (SELECT *, sum(abs(w1)) OVER (PARTITION BY rebalance) AS ge FROM b), h AS (SELECT *, CASE WHEN ge > 1 THEN w1 / ge ELSE w1 END AS w2 FROM g), s AS (SELECT *, sum(abs(w2)) OVER (PARTITION BY rebalance, sector) AS se FROM h), t AS (SELECT *, CASE WHEN se > 0.45 THEN w2 * 0.45 / se ELSE w2 END AS w3 FROM s),
u AS (SELECT *, sum(abs(w3)) OVER (PARTITION BY rebalance, style) AS ye FROM t), v AS (SELECT *, CASE WHEN ye > 0.55 THEN w3 * 0.55 / ye ELSE w3 END AS w4, CASE WHEN target % 3 <> 0 THEN w0 / 2 ELSE 0 END AS cur FROM u), x AS (SELECT *, dd >= 0.1 AND abs(w4) > abs(cur) + 1e-9 AS blocked FROM v), y AS (SELECT *, CASE WHEN blocked THEN cur ELSE w4 END AS weight FROM x),
r AS (SELECT rebalance, sum(abs(weight)) AS gross, sum(abs(weight - cur)) AS turnover, any_value(dd) AS dd, string_agg(DISTINCT 'single_weight_exceeded:' || target, ',') FILTER (WHERE over) AS v1, count(*) FILTER (WHERE ge > 1) > 0 AS v2, list_sort(list_distinct(list_concat(list_concat(list_concat(list('single_weight_exceeded:' || target) FILTER (WHERE over), list('gross_exposure_exceeded') FILTER (WHERE ge > 1)), list_concat(list('sector_exposure_exceeded:' || sector) FILTER (WHERE se > 0.45), list('style_exposure_exceeded:' || style) FILTER (WHERE ye > 0.55))), list('drawdown_near_limit_reduce_only') FILTER (WHERE blocked)))) AS told FROM y GROUP BY 1)"""


@query(f"WITH {_PROPOSED} SELECT y.rebalance, target, round(weight, 6) + 0.0 AS weight, round(gross, 4) AS gross, round(turnover, 4) AS turnover, concat_ws(',', nullif(array_to_string(told, ','), ''), CASE WHEN turnover > 0.35 THEN 'turnover_exceeded' END, CASE WHEN r.dd > 0.2 THEN 'drawdown_exceeded' END) AS violations FROM y JOIN r ON y.rebalance = r.rebalance")
def ag25_exposure(spark, sf):
    """Twelve customers are a portfolio, whose balances are the weights that it wants."""
    c = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 12).alias("rebalance"), F.col("c_custkey").alias("target"), (F.col("c_acctbal") / 20000).alias("weight"), F.col("c_mktsegment").alias("sector"), F.when(F.col("c_nationkey") % 2 == 0, "growth").otherwise("value").alias("style"))
    current = c.where("target % 3 <> 0").select("rebalance", "target", (F.col("weight") / 2).alias("weight"))
    states = c.select("rebalance").distinct().withColumn("drawdown", F.col("rebalance") % 10 / 40)
    weights, whole = Z.exposure_checks(c, current, states)
    # Balances in cents make sums that lie halfway between two results, so halves are decided on the product, as in SQL.
    near = lambda c, n: (F.round(F.col(c) * 10.0**n) / 10.0**n + 0.0).alias(c)
    told = whole.select("rebalance", near("gross", 4), near("turnover", 4), F.array_join("violations", ",").alias("violations"))
    return weights.join(told, "rebalance").select("rebalance", "target", near("weight", 6), "gross", "turnover", "violations")


@query(f"""WITH {PREDICTIONS}, sg AS (SELECT ts AS as_of, symbol AS target, h AS horizon, CASE WHEN symbol IN ('click', 'view') THEN 'trend' WHEN symbol = 'error' THEN 'event' ELSE 'mean_reversion' END AS bucket, CASE WHEN mu > 0.05 THEN 1 WHEN mu < -0.05 THEN -1 END AS side, mu * k AS score, p_up AS conf, CASE WHEN length(symbol) % 2 = 0 THEN 0.5 ELSE 1 END AS factor FROM predictions, (VALUES ('1h', 1.0), ('4h', 0.5)) t(h, k)),
c AS (SELECT as_of, target, horizon, bucket, side * abs(score) * greatest(0, least(1, conf)) * factor AS v FROM sg WHERE side IS NOT NULL), p AS (SELECT *, sum(v) OVER (PARTITION BY as_of, target) AS raw, abs(v) / sum(abs(v)) OVER (PARTITION BY as_of, target) AS share FROM c),
t AS (SELECT as_of, target, any_value(raw) AS raw FROM p GROUP BY 1, 2), g AS (SELECT *, sum(abs(raw)) OVER (PARTITION BY as_of) AS gross FROM t), w AS (SELECT as_of, target, raw, sign(raw) * least(abs(raw) / gross * 0.5, 0.3) AS w FROM g WHERE gross > 1e-12),
e AS (SELECT p.as_of, p.target, abs(w) * share AS e, unnest([bucket || ':' || horizon, bucket]) AS key FROM p JOIN w ON p.as_of = w.as_of AND p.target = w.target), k AS (SELECT as_of, key, sum(e) AS held, 0.5 * CASE split_part(key, ':', 1) WHEN 'trend' THEN 0.55 WHEN 'event' THEN 0.70 ELSE 0.45 END AS lim FROM e GROUP BY 1, 2),
f AS (SELECT as_of, target, product(sc) AS sc FROM (SELECT DISTINCT e.as_of, e.target, e.key, CASE WHEN held > lim THEN lim / held ELSE 1 END AS sc FROM e JOIN k ON e.as_of = k.as_of AND e.key = k.key) GROUP BY 1, 2), o AS (SELECT w.as_of, w.target, raw, w * sc AS w, sum(abs(w * sc)) OVER (PARTITION BY w.as_of) AS after FROM w JOIN f ON w.as_of = f.as_of AND w.target = f.target)
SELECT as_of, target, round(raw, 6) + 0.0 AS raw, round(CASE WHEN after > 0.5 THEN w * 0.5 / after ELSE w END, 6) + 0.0 AS weight FROM o""")
def ag26_allocation(spark, sf):
    p = predictions(spark, sf)
    bucket = F.when(F.col("symbol").isin("click", "view"), "trend").when(F.col("symbol") == "error", "event").otherwise("mean_reversion")
    action = F.when(F.col("mu") > 0.05, "buy").when(F.col("mu") < -0.05, "sell").otherwise("hold")
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(k).alias("k")) for h, k in (("1h", 1.0), ("4h", 0.5)))))
    signals = p.withColumn("x", each).select(F.col("ts").alias("at"), F.col("symbol").alias("target"), F.col("x.h").alias("horizon"), bucket.alias("bucket"), action.alias("action"), (F.col("mu") * F.col("x.k")).alias("score"), F.col("p_up").alias("confidence"))
    factors = p.select(F.col("symbol").alias("target")).distinct().withColumn("factor", F.when(F.length("target") % 2 == 0, 0.5).otherwise(1.0))
    return Z.allocate(signals, factors, 0.5, single=0.3).select(F.col("at").alias("as_of"), "target", (F.round("raw", 6) + 0.0).alias("raw"), (F.round("weight", 6) + 0.0).alias("weight"))


_LE = (5, 10, 25, 50, 100, 250, 1e9)


@query("WITH h AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le AND value > coalesce(lo, -1)) AS n FROM events, (SELECT le, lag(le) OVER (ORDER BY le) AS lo FROM (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in _LE) + ") t(le)) GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY le) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM h) SELECT event_type, min(le) AS quantile, min(le) <= 100 AS slo_met FROM c WHERE cum >= 0.95 * total GROUP BY 1")
def ag27_histogram_quantile(spark, sf):
    le = F.lit(float(_LE[-1]))
    for x in reversed(_LE[:-1]):
        le = F.when(F.col("value") <= x, float(x)).otherwise(le)
    h = table(spark, sf, "events").groupBy("event_type", le.alias("le")).agg(F.count("*").alias("n"))
    return A.histogram_quantile(h, ["event_type"], 0.95).withColumn("slo_met", F.col("quantile") <= 100)


@query(f"WITH {TICKS} SELECT 'events' AS name, count(*) FILTER (WHERE ts >= {_CUT}) AS recent, count(DISTINCT user_id) AS users FROM ticks UNION ALL SELECT 'orders', count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01'), count(DISTINCT o_custkey) FROM orders")
def ag28_table_probe(spark, sf):
    o = table(spark, sf, "orders")
    a = ticks(spark, sf).agg(F.lit("events").alias("name"), F.count_if(F.col("ts") >= _CUT).alias("recent"), F.countDistinct("user_id").alias("users"))
    return a.union(o.agg(F.lit("orders"), F.count_if(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")), F.countDistinct("o_custkey")))


@query(f"WITH {BARS} SELECT symbol, ts, close AS level, round(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts), 6) AS change FROM bars")
def ag29_level_and_change(spark, sf):
    return bars(spark, sf).select("symbol", "ts", F.col("close").alias("level"), r6(F.col("close") - F.lag("close").over(R.by()), "change"))


@query(f"WITH {TICKS} SELECT symbol, ts // 60000000 AS minute, round(avg(price), 6) AS value FROM ticks GROUP BY 1, 2")
def ag30_mean_of_duplicates(spark, sf):
    return ticks(spark, sf).groupBy("symbol", F.floor(F.col("ts") / 60_000_000).alias("minute")).agg(r6(F.avg("price"), "value"))


@query(f"WITH {TICKS}, r AS (SELECT user_id, price, size, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ticks), w AS (SELECT *, exp(-i / greatest(1, n / 3)) AS w FROM r) SELECT user_id, round(sum(price * w) / sum(w), 6) AS price, round(sum(size * w) / sum(w), 6) AS size FROM w GROUP BY 1")
def ag31_recency_context(spark, sf):
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    i, n = F.row_number().over(last) - 1, F.count("*").over(Window.partitionBy("user_id"))
    w = ticks(spark, sf).select("user_id", "price", "size", F.exp(-i / F.greatest(F.lit(1.0), n / 3)).alias("w"))
    return w.groupBy("user_id").agg(r6(A.weighted("price", "w"), "price"), r6(A.weighted("size", "w"), "size"))


@query(f"WITH {PREDICTIONS}, w AS (SELECT symbol, avg(mu / greatest(sigma, 0.01)) AS alpha, least(2.5, avg(sigma) / 1.2) AS vol FROM predictions GROUP BY 1) SELECT p.symbol, ts, CASE WHEN mu > 0 AND sigma < 1.2 THEN 'increase' WHEN mu < 0 THEN 'reduce' ELSE 'hold' END AS action, round(alpha, 6) AS alpha, round(alpha * 0.8, 6) AS expected_return, round(vol, 6) AS expected_volatility FROM predictions p JOIN w ON p.symbol = w.symbol")
def ag32_portfolio_score(spark, sf):
    """Predictions as positions, with the deviation as their risk and a budget of 1.2."""
    positions = predictions(spark, sf).select("symbol", "ts", F.col("mu").alias("score"), F.col("sigma").alias("risk"))
    whole, each = portfolio_score(positions, ["symbol"], 1.2)
    return each.join(whole, "symbol").select("symbol", "ts", "action", *(r6(F.col(c), c) for c in ("alpha", "expected_return", "expected_volatility")))


@query("WITH " + TICKS + ", t(tf, width) AS (VALUES ('1h', " + str(HOUR) + "), ('4h', " + str(4 * HOUR) + ")) SELECT tf, count(DISTINCT symbol) AS symbols, min(b) AS first_ts, max(b) AS last_ts, count(*) AS bars FROM (SELECT DISTINCT tf, symbol, ts - ts % width AS b FROM ticks, t) GROUP BY 1")
def ag33_inventory(spark, sf):
    both = bars(spark, sf).withColumn("tf", F.lit("1h")).union(bars(spark, sf, 4 * HOUR).withColumn("tf", F.lit("4h")))
    return both.groupBy("tf").agg(F.countDistinct("symbol").alias("symbols"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("bars"))

"""Data quality, readiness and leakage audits. Each audit is one pass over a union of its modalities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import readiness as Q
from ..operators import rolling as R
from ..operators.assemble import Feature, contract_hash
from ..operators.order import quantiles
from ..sources.fixtures import BARS, DAY, DAYS, HOUR, NEWS, TICKS, bars, days, news, table, ticks
from .registry import query

def r6(c, name, n=6):
    return F.round(c, n).alias(name)


#: The span of the ticks by hours, and every modality within it.
_MODES = NEWS + f", rng AS (SELECT min(ts) - min(ts) % {HOUR} AS a, max(ts) - max(ts) % {HOUR} AS z, (max(ts) // {HOUR} - min(ts) // {HOUR} + 1) AS n FROM ticks), m0 AS (SELECT symbol, 'price' AS modality, ts FROM ticks UNION ALL SELECT symbol, 'event', ts FROM news WHERE confidence > 0.5 UNION ALL SELECT symbol, 'flow', ts FROM ticks WHERE size > 50), m AS (SELECT m0.* FROM m0, rng WHERE ts >= a AND ts < z + {HOUR}), cov AS (SELECT symbol, modality, count(DISTINCT ts // {HOUR}) / (SELECT n FROM rng) AS c, min(ts) AS first_ts, max(ts) AS last_ts FROM m GROUP BY 1, 2)"


def _span(spark, sf):
    return Q.span(ticks(spark, sf), HOUR)


def _modes(spark, sf):
    t = ticks(spark, sf)
    return Q.tagged({"price": t, "event": news(spark, sf).where("confidence > 0.5"), "flow": t.where("size > 50")})


def _inside(spark, sf):
    """Rows of all modalities within the span, with its start, end and expected."""
    return _modes(spark, sf).crossJoin(F.broadcast(_span(spark, sf))).where(F.col("ts").between(F.col("start"), F.col("end") + HOUR - 1))


def _cov(spark, sf):
    return Q.coverage(_modes(spark, sf), _span(spark, sf), HOUR).withColumnRenamed("coverage", "c")


_LOOKBACK, _AHEAD = 12, 4
_WINDOWS = f"hb AS (SELECT DISTINCT symbol, ts - ts % {HOUR} AS b FROM ticks), hw AS (SELECT t.symbol, t.b, (SELECT count(*) FROM hb x WHERE x.symbol = t.symbol AND x.b BETWEEN t.b - {(_LOOKBACK - 1) * HOUR} AND t.b + {_AHEAD * HOUR}) AS held FROM hb t), lw AS (SELECT symbol, count(*) AS label_rows, count(*) FILTER (WHERE held = {_LOOKBACK + _AHEAD}) AS viable FROM hw GROUP BY 1)"
_READY = _MODES + f", {_WINDOWS}, p AS (SELECT symbol, coalesce(max(c) FILTER (WHERE modality = 'price'), 0) AS price, coalesce(max(c) FILTER (WHERE modality = 'event'), 0) AS event, coalesce(max(c) FILTER (WHERE modality = 'flow'), 0) AS flow FROM cov GROUP BY 1), ready AS (SELECT p.*, label_rows, viable, CASE WHEN price < 0.9 OR label_rows < {_LOOKBACK + _AHEAD + 8} OR viable = 0 THEN 'BLOCKED' WHEN event < 0.7 OR flow < 0.7 THEN 'DEGRADED' ELSE 'READY' END AS status, concat_ws(',', CASE WHEN price < 0.9 THEN 'price_coverage' END, CASE WHEN label_rows < {_LOOKBACK + _AHEAD + 8} THEN 'label_window_insufficient' END, CASE WHEN viable = 0 THEN 'no_whole_label_window' END, CASE WHEN event < 0.7 THEN 'event_coverage' END, CASE WHEN flow < 0.7 THEN 'flow_coverage' END) AS reasons FROM p JOIN lw USING (symbol))"


def _readiness(spark, sf):
    windows = Q.label_windows(ticks(spark, sf), HOUR, _LOOKBACK, _AHEAD)
    covered = Q.coverage(_modes(spark, sf), _span(spark, sf), HOUR)
    return Q.readiness(covered, windows, {"price": 0.9}, {"event": 0.7, "flow": 0.7}, _LOOKBACK, _AHEAD).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {_READY} SELECT symbol, round(price, 6) AS price, round(event, 6) AS event, round(flow, 6) AS flow, label_rows, viable, status, reasons FROM ready")
def dq01_symbol_readiness(spark, sf):
    return _readiness(spark, sf).select("symbol", *(r6(F.col(c), c) for c in ("price", "event", "flow")), "label_rows", "viable", "status", "reasons")


@query(f"WITH {BARS}, v AS (SELECT symbol, [CASE WHEN symbol < 'd' THEN 0 ELSE close END, volume - volume, 0, 0, 0, 0, 0, 0, 0, NULL] AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars), e AS (SELECT symbol, unnest(v) AS x FROM v WHERE rn <= 64) SELECT symbol, count(x) AS entries, count(*) FILTER (WHERE x = 0) AS zeros, count(*) FILTER (WHERE x = 0) >= 0.98 * count(x) AND count(x) >= 500 AS anomaly FROM e GROUP BY 1")
def dq02_zero_fill(spark, sf):
    zero = F.lit(0.0)
    values = F.array(F.when(F.col("symbol") < "d", 0.0).otherwise(F.col("close")), F.col("volume") - F.col("volume"), *[zero] * 8)
    return Q.zero_filled(bars(spark, sf).select("symbol", "ts", values.alias("values"), F.array(*[F.lit(0)] * 9, F.lit(1)).alias("mask")))


@query(f"WITH {_MODES}, w AS (SELECT modality, count(DISTINCT CASE WHEN ts >= z - {7 * DAY} THEN ts // {HOUR} END) / {7 * 24 + 1} AS production, count(DISTINCT ts // {HOUR}) / any_value(n) AS research FROM m, rng GROUP BY 1), g AS (SELECT 1 AS k, string_agg(modality, ',' ORDER BY modality) FILTER (WHERE production < 0.95 OR research < 0.95) AS missing FROM w) SELECT modality, round(production, 6) AS production, round(research, 6) AS research, production >= 0.95 AND research >= 0.95 AS gate, coalesce(missing, '') AS missing_kinds FROM w, g")
def dq03_required_data(spark, sf):
    hour, recent = F.floor(F.col("ts") / HOUR), F.col("ts") >= F.col("end") - 7 * DAY
    w = _inside(spark, sf).groupBy("modality").agg((F.countDistinct(F.when(recent, hour)) / (7 * 24 + 1)).alias("production"), (F.countDistinct(hour) / F.first("expected")).alias("research"))
    w = w.withColumn("gate", (F.col("production") >= 0.95) & (F.col("research") >= 0.95))
    # One row for each kind of data, so the list is as short as the kinds are few.
    lacking = w.agg(F.array_join(F.array_sort(F.collect_list(F.when(~F.col("gate"), F.col("modality")))), ",").alias("missing_kinds"))
    return w.crossJoin(F.broadcast(lacking)).select("modality", r6(F.col("production"), "production"), r6(F.col("research"), "research"), "gate", "missing_kinds")


@query(f"WITH {_MODES}, b AS (SELECT DISTINCT symbol, ts // {HOUR} AS b FROM m WHERE modality = 'price'), g AS (SELECT symbol, b, lead(b) OVER (PARTITION BY symbol ORDER BY b) AS nx FROM b), l AS (SELECT symbol, quantile_cont((available - occurred) / 1e6, 0.9) AS p90 FROM news GROUP BY 1) SELECT cov.symbol, round(c, 6) AS coverage, (SELECT count(*) FROM g WHERE g.symbol = cov.symbol AND nx - b > 1) AS gaps, round(p90, 6) AS latency_p90, c >= 0.93 AS complete FROM cov JOIN l ON cov.symbol = l.symbol WHERE modality = 'price'")
def dq04_full_history(spark, sf):
    cov = _cov(spark, sf).where("modality = 'price'").select("symbol", "c")
    hours = _inside(spark, sf).where("modality = 'price'").select("symbol", F.floor(F.col("ts") / HOUR).alias("b")).distinct()
    gaps = hours.withColumn("wide", F.lead("b").over(R.by(order="b")) - F.col("b") > 1).groupBy("symbol").agg(F.count_if("wide").alias("gaps"))
    lag = quantiles(news(spark, sf), ["symbol"], (F.col("available") - F.col("occurred")) / 1e6, {"latency_p90": 0.9}).withColumn("latency_p90", F.round("latency_p90", 6))
    return cov.join(gaps, "symbol").join(lag, "symbol").select("symbol", r6(F.col("c"), "coverage"), "gaps", "latency_p90", (F.col("c") >= 0.93).alias("complete"))


@query(f"WITH {DAYS} SELECT symbol, count(*) AS n, count(*) >= greatest(200, 0.7 * 800) AS complete FROM days GROUP BY 1")
def dq05_lookback(spark, sf):
    return days(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), (F.count("*") >= max(200, 0.7 * 800)).alias("complete"))


@query(f"WITH {NEWS} SELECT symbol, count(*) FILTER (WHERE available > occurred + 50000000) AS late, count(*) FILTER (WHERE published > available) AS leaks, round(count(*) FILTER (WHERE abs(published - occurred) <= 1000000) / count(*), 6) AS match_rate FROM news GROUP BY 1")
def dq06_asof_leakage(spark, sf):
    return news(spark, sf).groupBy("symbol").agg(F.count_if(F.col("available") > F.col("occurred") + 50_000_000).alias("late"), F.count_if(F.col("published") > F.col("available")).alias("leaks"), r6(F.count_if(F.abs(F.col("published") - F.col("occurred")) <= 1_000_000) / F.count("*"), "match_rate"))


_HASH = contract_hash([Feature("ret_1"), Feature("vol_12")])
_ROWS = BARS + f", fr AS (SELECT symbol, CASE WHEN trades % 17 = 0 THEN NULL ELSE ts END AS ts, CASE WHEN trades % 13 = 0 THEN [close] WHEN trades % 11 = 0 THEN [0, 0] ELSE [close, volume] END AS v, [trades % 5 = 0, trades % 3 = 0] AS m, CASE WHEN trades % 7 = 0 THEN 'other' WHEN trades % 19 = 0 THEN NULL ELSE '{_HASH}' END AS h, trades % 4 / 4 AS syn FROM bars)"


def _feature_rows(spark, sf):
    """Bars as feature rows, some of which break the contract."""
    t, zero = F.col("trades"), F.lit(0.0)
    values = F.when(t % 13 == 0, F.array("close")).when(t % 11 == 0, F.array(zero, zero)).otherwise(F.array("close", "volume"))
    kept = F.when(t % 7 == 0, "other").when(t % 19 != 0, _HASH)
    return bars(spark, sf).select("symbol", F.when(t % 17 != 0, F.col("ts")).alias("ts"), values.alias("values"), F.array((t % 5 == 0).cast("int"), (t % 3 == 0).cast("int")).alias("mask"), kept.alias("schema_hash"), (t % 4 / 4).alias("synthetic_ratio"))


@query(f"WITH {_ROWS} SELECT symbol, count(*) AS n, count(*) FILTER (WHERE len(v) <> 2) AS dim_mismatch, count(*) FILTER (WHERE ts IS NULL) AS null_time, count(*) FILTER (WHERE h IS DISTINCT FROM '{_HASH}') AS hash_mismatch, count(*) FILTER (WHERE len(list_filter(v, lambda x: x <> 0)) = 0) AS zero_vector FROM fr GROUP BY 1")
def dq07_contract_audit(spark, sf):
    return Q.contract_audit(_feature_rows(spark, sf), 2, _HASH, ["symbol"])


@query(f"WITH {_ROWS}, r AS (SELECT symbol, avg((m[1]::INT + m[2]::INT) / 2) AS missing, avg(syn) AS synthetic FROM fr GROUP BY 1) SELECT symbol, round(missing, 6) AS missing_ratio, round(synthetic, 6) AS synthetic_ratio, missing <= 0.6 AND synthetic <= 0.5 AS passed FROM r")
def dq08_missing_ratio(spark, sf):
    return Q.cache_gate(_feature_rows(spark, sf), ["symbol"]).withColumns({c: F.round(c, 6) for c in ("missing_ratio", "synthetic_ratio")})


@query("SELECT event_type AS run_type, count(*) AS runs, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 95) AS violating, count(*) FILTER (WHERE value < 1) AS fallback, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 95) = 0 AS passed FROM events GROUP BY 1")
def dq09_run_leakage(spark, sf):
    bad = F.count_if(F.col("p.k") > 95)
    return table(spark, sf, "events").withColumn("p", F.from_json("props", "k bigint")).groupBy(F.col("event_type").alias("run_type")).agg(F.count("*").alias("runs"), bad.alias("violating"), F.count_if(F.col("value") < 1).alias("fallback"), (bad == 0).alias("passed"))


@query(f"WITH {_READY}, b AS (SELECT DISTINCT symbol, ts // {HOUR} AS b FROM m WHERE modality = 'price'), g AS (SELECT symbol, b, lead(b) OVER (PARTITION BY symbol ORDER BY b) AS nx FROM b) SELECT symbol, 'backfill_gap' AS task, (b + 1) * {HOUR} AS from_ts, (nx - 1) * {HOUR} AS to_ts FROM g WHERE nx - b > 1 UNION ALL SELECT symbol, 'raise_coverage:' || reasons, a, z FROM ready, rng WHERE status <> 'READY'")
def dq10_remediation(spark, sf):
    hours = _inside(spark, sf).where("modality = 'price'").select("symbol", F.floor(F.col("ts") / HOUR).alias("b")).distinct().withColumn("nx", F.lead("b").over(R.by(order="b")))
    gaps = hours.where("nx - b > 1").select("symbol", F.lit("backfill_gap").alias("task"), ((F.col("b") + 1) * HOUR).alias("from_ts"), ((F.col("nx") - 1) * HOUR).alias("to_ts"))
    low = _readiness(spark, sf).where("status <> 'READY'")
    return gaps.union(low.crossJoin(F.broadcast(_span(spark, sf))).select("symbol", F.concat(F.lit("raise_coverage:"), "reasons"), "start", "end"))


@query(f"WITH {BARS}, r AS (SELECT symbol, ts, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) SELECT a.symbol, round(abs(a.close - b.close), 6) AS close_diff, round(abs(a.volume - b.volume), 6) AS volume_diff, a.ts - b.ts AS age FROM r a JOIN r b ON a.symbol = b.symbol AND a.rn = 1 AND b.rn = 2")
def dq11_lineage(spark, sf):
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    last = bars(spark, sf).withColumn("rn", rn).where("rn <= 2").groupBy("symbol").agg(*(F.max(F.when(F.col("rn") == k, F.struct("ts", "close", "volume"))).alias(n) for k, n in ((1, "a"), (2, "b"))))
    return last.where("b IS NOT NULL").select("symbol", r6(F.abs(F.col("a.close") - F.col("b.close")), "close_diff"), r6(F.abs(F.col("a.volume") - F.col("b.volume")), "volume_diff"), (F.col("a.ts") - F.col("b.ts")).alias("age"))


@query(f"WITH {NEWS} SELECT id, round(exp(-(available - occurred) / 3.6e9), 6) AS freshness, (id % 5) / 4.0::DOUBLE AS entity_coverage, round(0.3 * confidence + 0.25 * greatest(0, least(1, (6 - tier) / 5)) + 0.25 * exp(-(available - occurred) / 3.6e9) + 0.2 * (id % 5) / 4, 6) AS quality FROM news")
def dq12_event_audit(spark, sf):
    from ..functions.expr import quality_score

    fresh, cover = F.exp(-(F.col("available") - F.col("occurred")) / 3.6e9), (F.col("id") % 5) / 4.0
    return news(spark, sf).select("id", r6(fresh, "freshness"), cover.alias("entity_coverage"), r6(quality_score(F.col("confidence"), F.col("tier"), fresh, cover), "quality"))

"""Signals, intents, caps, allocation, readiness and word lists: rows worked out by hand, and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import expr as E
from tidegrid.operators import readiness as Q
from tidegrid.operators import sizing as Z
from tidegrid.operators.assemble import filled, positions
from tidegrid.operators.evaluate import correlation_penalty, portfolio_score

HOUR = 3_600_000_000
FINE = "fresh boolean, recon_ok boolean, margin_ratio double, free_margin double, reject_rate double, slippage_p90 double, realised_vol double"


def test_horizon_signal(spark):
    rows = [("1h", 0.01, 0.001, 0.02, -0.01, 0.02, 0.9), ("1h", 0.05, 0.001, 0.02, None, None, 0.9), ("1h", 0.05, 0.001, 0.02, None, None, 0.5), ("7d", -0.05, 0.001, 0.0, None, 0.1, 0.48), ("9y", 0.0, 0.0, 0.0, 0.0, 0.0, 0.9)]
    got = Z.horizon_signal(spark.createDataFrame(rows, "horizon string, expected double, cost double, vol double, p10 double, p90 double, confidence double")).collect()
    # Edge 0.009, risk max(0.02, 0.03): score 0.3; band 0.2 * (1 + min(3, 0.03 / 0.0091)) = 0.8.
    assert (round(got[0].edge, 9), got[0].risk, round(got[0].score, 9), round(got[0].band, 9), got[0].action) == (0.009, 0.03, 0.3, 0.8, "hold")
    assert round(got[1].score, 6) == 2.45 and round(got[1].band, 6) == round(0.2 * (1 + 0.02 / 0.0491), 6) and got[1].action == "buy"
    assert got[2].action == "hold" and got[3].action == "sell" and got[3].risk == 1e-4
    assert got[4].action == "hold" and got[4].score == 0.0


def intent(spark, mu, sigma, cost, account=(True, True, 5.0, 8000.0, 0.0, 0.0, 0.0), held=()):
    p = spark.createDataFrame([("m", "BTC", 100, mu, sigma, cost)], "account string, symbol string, ts long, mu map<string, double>, sigma map<string, double>, cost map<string, double>")
    a = spark.createDataFrame([("m", 50, *account)], f"account string, ts long, {FINE}")
    h = spark.createDataFrame(list(held), "account string, ts long, symbol string, qty double")
    return Z.position_intent(p, a, h).first()


def test_intent_is_monotonic(spark):
    base = intent(spark, {"1h": 0.20}, {"1h": 0.5}, {"1h": 0.001})
    assert base.target == pytest.approx((0.2 - 0.001) / 0.5) and base.action == "buy" and not base.reduce_only
    assert abs(intent(spark, {"1h": 0.20}, {"1h": 0.9}, {"1h": 0.001}).target) < abs(base.target)
    assert abs(intent(spark, {"1h": 0.20}, {"1h": 0.5}, {"1h": 0.06}).target) < abs(base.target)
    yellow = intent(spark, {"1h": 0.20}, {"1h": 0.5}, {"1h": 0.001}, (True, True, 1.2, 8000.0, 0.0, 20.0, 0.09))
    assert yellow.target == pytest.approx(base.target * 0.35) and yellow.band == pytest.approx(0.03) and yellow.regime == "yellow" and yellow.reasons == ["slippage_p90_high", "margin_ratio_yellow", "vol_spike"]
    red = intent(spark, {"1h": 0.20}, {"1h": 0.5}, {"1h": 0.001}, (False, True, 1.0, 10.0, 0.9, 99.0, 1.0))
    assert red.reduce_only and red.target == base.target and red.reasons == ["account_state_stale", "margin_ratio_red", "free_margin_low", "reject_rate_red"]


def test_intent_by_hand(spark):
    # (0.4 * (0.1 - 0.01) / 0.3 + 0.2 * 0.3 / 0.6) / 0.6 = (0.12 + 0.1) / 0.6.
    r = intent(spark, {"1h": 0.1, "1d": 0.3, "3d": 9.0}, {"1h": 0.3, "1d": 0.6}, {"1h": 0.01}, held=[("m", 50, "BTC", 0.35), ("m", 40, "BTC", 9.0), ("m", 50, "ETH", 1.0)])
    assert r.score == pytest.approx(0.22 / 0.6) and r.uncertainty == pytest.approx(0.45) and r.current == 0.35
    assert r.action == "hold" and r.qty == 0.0 and r.delta == pytest.approx(0.22 / 0.6 - 0.35)
    # A snapshot without the symbol means no position, whatever an older one says.
    assert intent(spark, {"1h": 0.1}, {"1h": 0.3}, {}, held=[("m", 40, "BTC", 9.0)]).current == 0.0
    p = spark.createDataFrame([("m", "B", 10, None, None, None)], "account string, symbol string, ts long, mu map<string, double>, sigma map<string, double>, cost map<string, double>")
    none = Z.position_intent(p, spark.createDataFrame([], f"account string, ts long, {FINE}"), spark.createDataFrame([], "account string, ts long, symbol string, qty double")).first()
    assert (none.target, none.action, none.regime, none.reduce_only) == (0.0, "hold", "red", True)


def test_strategy_bucket(spark):
    rows = [("liquid", 0.2, 0.6, 0.0, 0.0, 0.0), ("liquid", 0.0, 0.7, 0.001, 0.002, -1.1), ("vc", 0.9, 0.9, 0.5, 0.5, 0.0), ("liquid", 0.9, 0.9, 0.5, 0.5, 1.2), ("liquid", 0.0, 0.7, None, None, None)]
    df = spark.createDataFrame(rows, "t string, s double, c double, r1 double, r12 double, z double")
    assert [r.b for r in df.select(Z.strategy_bucket(*(F.col(c) for c in ("t", "s", "c", "r1", "r12", "z"))).alias("b")).collect()] == ["trend", "mean_reversion", "event", "event", "mean_reversion"]


def test_exposure_by_hand(spark):
    wanted = [(1, "a", 0.5, "x", "g"), (1, "b", -0.1, "x", "g"), (1, "c", 0.1, "y", "v"), (2, "a", 0.1, "x", "g"), (3, "a", 0.2, "x", "g")]
    p = spark.createDataFrame(wanted, "rebalance int, target string, weight double, sector string, style string")
    now = spark.createDataFrame([(1, "d", 0.1), (2, "a", 0.05)], "rebalance int, target string, weight double")
    weights, whole = Z.exposure_checks(p, now, spark.createDataFrame([(1, 0.0), (2, 0.25), (3, 0.09)], "rebalance int, drawdown double"))
    got = {(r.rebalance, r.target): round(r.weight, 9) for r in weights.collect()}
    told = {r.rebalance: r for r in whole.collect()}
    assert (got[1, "a"], got[1, "b"], got[1, "c"]) == (0.2, -0.1, 0.1) and told[1].violations == ["single_weight_exceeded:a", "turnover_exceeded"]
    assert round(told[1].turnover, 9) == 0.5 and round(told[1].gross, 9) == 0.4
    # Beyond the limit the cap is a quarter, 0.05, and no weight may grow.
    assert got[2, "a"] == 0.05 and told[2].violations == ["single_weight_exceeded:a", "drawdown_exceeded"]
    assert got[3, "a"] == round(0.2 * (1 - 0.75 * 0.01 / 0.12), 9)


def test_allocation_by_hand(spark):
    rows = [(1, "A", "1h", "trend", "buy", 1.0, 0.5), (1, "A", "4h", "event", "sell", -0.5, 0.4), (1, "B", "1h", " Trend ", "SELL", 2.0, 2.0), (1, "C", "1h", None, "hold", 9.0, 1.0), (2, "A", "1h", "trend", "hold", 1.0, 1.0)]
    s = spark.createDataFrame(rows, "at int, target string, horizon string, bucket string, action string, score double, confidence double")
    got = {(r["at"], r.target): (round(r.raw, 9), round(r.weight, 9)) for r in Z.allocate(s, spark.createDataFrame([("B", 0.5)], "target string, factor double"), 1.0, single=0.6).collect()}
    # A: 0.5 - 0.2, B: -2 * 1 * 0.5; shares 0.3 / 1.3 and 1 / 1.3, the latter capped. Trend holds 0.6 + 5/7 * 0.3 / 1.3 of 0.55.
    a, held = 0.3 / 1.3, 0.6 + 0.5 / 0.7 * 0.3 / 1.3
    one = 0.55 / held
    # Both the bucket and the bucket with its horizon hold that much, so both scale.
    assert got == {(1, "A"): (0.3, round(a * one * one, 9)), (1, "B"): (-1.0, round(-0.6 * one * one, 9))}


def test_momentum_needs_enough_bars(spark):
    bars = spark.range(20).select(F.lit("a").alias("symbol"), F.col("id").alias("ts"), (100 + F.col("id")).cast("double").alias("close"), F.lit(10.0).alias("volume"))
    assert Z.momentum(bars, 10, 9, 5.0, 3.0).count() == 0
    got = Z.momentum(bars, 10, 8, 5.0, 3.0).first()
    # 19 returns, of which those from 10 to 17 are traded; they fall all the time, so the momentum is below its mean.
    assert got.samples == 8 and got.hit_rate == 0.0 and got.turnover > 0


def test_correlation_and_portfolio(spark):
    r = random.Random(1)
    base = [r.gauss(0, 1) for _ in range(20)]
    rows = [(s, t, v * k) for t, v in enumerate(base) for s, k in (("a", 1.0), ("b", -2.0))] + [("c", t, r.gauss(0, 1)) for t in range(20)] + [("d", t, v) for t, v in enumerate(base[:15])] + [("e", t, 0.0) for t in range(20)] + [("f", 1, None)]
    got = {x.symbol: x for x in correlation_penalty(spark.createDataFrame(rows, "symbol string, ts long, ret double")).collect()}
    assert got["a"].factor == got["b"].factor == 0.5 and got["c"].factor == 1.0
    assert got["d"].pairs == 0 and got["d"].factor == 1.0 and got["e"].strongest is None and "f" not in got
    whole, each = portfolio_score(spark.createDataFrame([("p", "x", 0.2, 0.1), ("p", "y", -0.1, 0.001), ("p", "z", 0.3, 0.5)], "k string, target string, score double, risk double"), ["k"], 0.2)
    w = whole.first()
    assert w.alpha == pytest.approx((2 - 10 + 0.6) / 3) and w.expected_return == pytest.approx(0.8 * w.alpha) and w.expected_volatility == pytest.approx(0.601 / 3 / 0.2)
    assert [x.action for x in each.orderBy("target").collect()] == ["increase", "reduce", "hold"]


def test_label_windows_by_brute_force(spark):
    r = random.Random(2)
    rows = [(s, t * 10 + r.randrange(10)) for s, p in (("a", 0.9), ("b", 0.5), ("c", 1.0)) for t in range(-20, 80) if r.random() < p] + [("a", None), (None, 5)]
    got = {x.symbol: x for x in Q.label_windows(spark.createDataFrame(rows, "symbol string, ts long").repartition(3), 10, 6, 3).collect()}
    for s in "abc":
        there = {t // 10 * 10 for k, t in rows if k == s and t is not None}
        viable = sorted(t for t in there if all(t + k * 10 in there for k in range(-5, 4)))
        assert (got[s].rows, got[s].viable) == (len(there), len(viable))
        assert (got[s].first_label, got[s].last_label) == ((viable[0], viable[-1]) if viable else (None, None))


def test_readiness_on_tables_of_ones_own(spark):
    prices = spark.createDataFrame([(s, t * HOUR) for s in ("full", "thin") for t in range(0, 100, 1 if s == "full" else 3)], "symbol string, ts long")
    news = spark.createDataFrame([("full", 5 * HOUR)], "symbol string, ts long")
    within = Q.span(prices, HOUR)
    ready = Q.readiness(Q.coverage(Q.tagged({"price": prices, "news": news}), within, HOUR), Q.label_windows(prices, HOUR, 8, 4), {"price": 0.9}, {"news": 0.5}, 8, 4)
    got = {x.symbol: x for x in ready.collect()}
    assert within.first().expected == 100 and got["full"].price == 1.0
    assert (got["full"].status, got["full"].reasons) == ("DEGRADED", ["news_coverage"])
    assert (got["thin"].status, got["thin"].reasons) == ("BLOCKED", ["price_coverage", "no_whole_label_window", "news_coverage"])


def test_feature_row_audits(spark):
    rows = [("a", 1, [0.0, 0.0], [0, 1], "h", 0.2), ("a", None, [1.0], [0, 0], None, None), ("a", 3, None, None, "x", 0.4)]
    df = spark.createDataFrame(rows, "symbol string, ts long, values array<double>, mask array<int>, schema_hash string, synthetic_ratio double")
    got = Q.contract_audit(df, 2, "h", ["symbol"]).first()
    assert (got.n, got.dim_mismatch, got.null_time, got.hash_mismatch, got.zero_vector) == (3, 2, 1, 2, 1)
    assert Q.zero_filled(df, least=1).first().anomaly is False
    assert Q.zero_filled(df.where("ts = 1"), least=1).first().anomaly and not Q.zero_filled(df.where("ts = 1")).first().anomaly
    gate = Q.cache_gate(df.where("mask IS NOT NULL"), ["symbol"]).first()
    assert (gate.missing_ratio, gate.synthetic_ratio, gate.passed) == (0.25, 0.1, True)


def test_keywords_hide_no_other(spark):
    words = ("bull", "bullish", "ban", "bank", "solan", "lana", "利好", "fed", "federal reserve")
    texts = ["BULLISH", "bullbank", "solana", "sola", "利好 Federal Reserve", "", None, "xbanx ban"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: set(r.w) for r in df.select("k", E.keywords(F.col("t"), words).alias("w")).collect()}
    assert got == {k: {w for w in words if w in (t or "").lower()} for k, t in enumerate(texts)}


def test_words_and_traces(spark):
    def one(*columns, **values):
        row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
        return tuple(row.select(*columns).first())

    t = F.col("t")
    assert one(E.tickers(t), t="the Bitcoin and ETH, BTC with SOLANA; THE NEWS FROM XYZ AB CD EF") == (["BTC", "ETH", "SOL", "NEWS", "XYZ"],)
    assert one(E.mentions(t), t="$BTC ETHx aBCd BTC") == (["BTC", "ETH", "BC"],)
    assert one(E.language_hint(t), t="café 1") == ("en",) and one(E.language_hint(t), t="é 1") == ("other",) and one(E.language_hint(t), t="abc 利") == ("zh",)
    found = E.keywords(t, [*E.IMPORT_POSITIVE, *E.IMPORT_NEGATIVE, *E.REGULATORY, *E.MACRO, *(w for ws in E.ENTITY_KEYWORDS.values() for w in ws)])
    # "bullish" is "bull" as well: two against one.
    assert one(F.round(E.keyword_sentiment(found), 6), t="Bullish, but a hack") == (round(1 / 3, 6),)
    assert one(E.entity_map(found), *E.event_class(found), t="Trump speaks of Chainlink; banned") == (["LINK"], "regulatory", "macro", True)
    assert one(E.entity_map(found), t="xyz") == (["US_MACRO"],)
    assert one(*E.execution_trace(F.lit("SELL"), F.col("e"), F.col("p")), e=100.0, p=99.5) == pytest.approx((50.0, 47.0))
    assert one(*E.execution_trace(F.lit("buy"), F.col("e"), F.col("p")), e=0.0, p=99.5) == (0.0, 0.0)
    prior = lambda p, tier: one(E.latency_prior(F.lit(p), F.lit(tier), F.lit("S "), F.lit("t"), F.lit(None).cast("string"), F.lit("o")))[0]
    import hashlib

    place = int(hashlib.sha1(b"rss:sec_x|s|t||o").hexdigest()[:12], 16) / (16**12 - 1)
    assert prior(" RSS:sec_x", 3) == pytest.approx(2 + 16 * place + 7.0)
    assert 25 <= prior("google_news_rss", 1) <= 110 and 10 <= prior("google_news_rss2", 0) <= 45


def test_fills_fold_like_the_plain_loop(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), k, float(r.choice([-3, -2, -1, 1, 2, 3])), r.uniform(1, 9)) for k in range(300)] + [("a", 301, None, 1.0), ("z", 302, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, ts int, qty double, price double").repartition(5)
    want = {}
    for k, _, q, p in rows:
        if q is not None:
            want[k] = (*filled(*want.get(k, (0.0, 0.0, 0.0))[:3], q, p), p)
    got = {x.k: (x.qty, x.avg_cost, x.realised, x.unrealised) for x in positions(df, ["k"], ["ts"]).collect()}
    assert set(got) == set(want)
    for k, (q, c, z, last) in want.items():
        assert got[k] == pytest.approx((q, c, z, (last - c) * q))
    assert positions(df.limit(0), ["k"], ["ts"]).count() == 0

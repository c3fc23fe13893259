"""Folds, regressions, merged views, profiles, verdicts and chains on small rows, by hand or by brute force."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import aggregate as A
from tidegrid.operators import align
from tidegrid.operators import assemble as S
from tidegrid.operators import evaluate as E
from tidegrid.operators import rolling as R
from tidegrid.sources import io
from tidegrid.streaming import streams

HOUR = 3_600_000_000


@pytest.mark.parametrize("n, train, test, purge, step", [(100, 40, 10, 5, 10), (61, 30, 20, 10, 7), (20, 30, 5, 0, 5), (55, 30, 20, 5, 100)])
def test_row_folds(spark, n, train, test, purge, step):
    df = spark.createDataFrame([("a", i) for i in range(n)] + [("b", 0)], "symbol string, ts long")
    want, k = set(), 0
    while k * step + train + purge + test <= n:
        want |= {(k, "train", i) for i in range(k * step, k * step + train)} | {(k, "test", i) for i in range(k * step + train + purge, k * step + train + purge + test)}
        k += 1
    got = [(r.fold, r.split, r.ts) for r in S.row_folds(df, train, test, purge, step).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_ridge_is_numpys(spark):
    r = np.random.default_rng(1)
    x, keys = r.standard_normal((60, 3)), [i % 2 for i in range(60)]
    y = x @ [1.0, -2.0, 0.5] + r.standard_normal(60) * 0.1
    df = spark.createDataFrame([(k, *map(float, v), float(t)) for k, v, t in zip(keys, x, y)], "k int, a double, b double, c double, y double")
    for row in S.ridge(df, ["k"], ["a", "b", "c"], "y", l2=2.0).collect():
        own = np.array(keys) == row.k
        assert row.weights == pytest.approx(np.linalg.solve(x[own].T @ x[own] + 2 * np.eye(3), x[own].T @ y[own]).tolist())


def test_merged_views_have_three_cases(spark):
    rows = spark.createDataFrame([("a", t, [1.0, 9.0, 9.0], [0, 0, 0]) for t in (5, 10, 40)], "symbol string, ts long, values array<float>, mask array<tinyint>")
    text = spark.createDataFrame([("a", 8, [3.0, 4.0])], "symbol string, ts long, block array<double>")
    got = {r.ts: r for r in S.merge_views(rows, text, 1, 2, max_age=5).collect()}
    assert [got[t].text_case for t in (5, 10, 40)] == ["none", "fresh", "stale"]
    assert [got[t].values for t in (5, 10, 40)] == [[1, 0, 0], [1, 3, 4], [1, 0, 0]] and [got[t].mask for t in (5, 10, 40)] == [[0, 1, 1], [0, 0, 0], [0, 1, 1]]
    assert (got[5].text_lag_sec, got[40].text_lag_sec) == (None, pytest.approx(32e-6))


def test_gates_raise(spark):
    df = spark.createDataFrame([([1, 2],), ([1],), (None,)], "v array<int>")
    assert S.check_dims(df, "v", 2, most=0.7) == {"n": 3, "mismatched": 2, "ratio": pytest.approx(2 / 3)}
    with pytest.raises(ValueError):
        S.check_dims(df, "v", 2, most=0.5)
    rows, context = spark.createDataFrame([("a", 1), ("a", 2)], "symbol string, ts long"), spark.createDataFrame([("a", 1)], "symbol string, ts long")
    align.check_context(context, rows)
    with pytest.raises(ValueError):
        align.check_context(rows, context)


def test_event_profile_by_hand(spark):
    names = "symbol string, ts long, source string, tier_weight double, confidence double, raw_confidence double, importance double, novelty double, post_sentiment double, comment_sentiment double, is_social boolean, engagement double, followers double, comments int"
    now = 100 * HOUR
    rows = [
        ("a", now, "x", 1.0, 0.5, 0.5, 0.4, 0.2, 1.0, 0.0, True, 10.0, 100.0, 3), ("a", now - 6 * HOUR, "y", 0.5, 1.0, 1.0, 2.0, 0.5, -1.0, -1.0, False, 0.0, 0.0, 0), ("a", now - 7 * HOUR, "y", 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, True, 0.0, 0.0, 0),
        ("a", now - 24 * HOUR, "z", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, True, 1.0, 1.0, 1), ("a", now + 1, "z", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, True, 1.0, 1.0, 1), ("a", now - 1, "z", 1.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, True, 1.0, 1.0, 1),
    ]
    grid = spark.createDataFrame([("a", now), ("b", now)], "symbol string, ts long")
    got = {r.symbol: r for r in A.event_profile(grid, spark.createDataFrame(rows, names), 24 * HOUR).collect()}
    assert set(got["b"][2:]) == {0.0}
    a, mass = got["a"], 2.0
    assert a.event_decay == pytest.approx((0.5 + 0.5 * math.exp(-0.5) + math.exp(-7 / 12)) / mass)
    assert (a.event_lag_bucket_0_1h, a.event_lag_bucket_1_6h, a.event_lag_bucket_6_24h) == pytest.approx((0.25, 0.25, 0.5))
    assert a.source_diversity == pytest.approx(-(0.25 * math.log(0.25) + 0.75 * math.log(0.75)) / math.log(2))
    s, w = np.array([0.5, -1.0, 0.0]), np.array([0.5, 0.5, 1.0])
    assert a.event_disagreement == pytest.approx(math.sqrt(np.average((s - np.average(s, weights=w)) ** 2, weights=w)))
    m, k = np.array([0.5, -0.5 / 1.5]), np.array([0.5, 1.5])
    assert a.cross_source_consensus == pytest.approx(1 - math.sqrt(np.average((m - np.average(m, weights=k)) ** 2, weights=k)))
    assert a.social_post_sentiment == pytest.approx(0.5 / 1.5) and a.social_event_ratio == pytest.approx(2 / 3) and a.social_comment_rate == pytest.approx(math.tanh(3 / 40))
    assert a.social_engagement_norm == pytest.approx(math.tanh(0.5 * math.log(11) / 1.5 / 6)) and a.event_importance_mean == pytest.approx((0.2 + 0.5) / 2) and a.novelty_confidence_blend == pytest.approx((0.5 * 0.2 * 0.5 + 0.25) / 2)


def test_social_profile_takes_the_newest_buckets(spark):
    rows = [("a", t * HOUR, 2, 1, 1, 10, 1, 0.5, -0.5) for t in range(1, 8)] + [("a", 8 * HOUR, 4, 0, 4, 0, 3, 2.0, 0.0)]
    buckets = spark.createDataFrame(rows, "symbol string, ts long, items int, posts int, comments int, engagement int, authors int, post_sentiment double, comment_sentiment double")
    grid = spark.createDataFrame([("a", 8 * HOUR), ("a", 0)], "symbol string, ts long")
    (r,) = A.social_profile(grid, buckets, 6 * HOUR, cap=3).collect()
    assert r.social_post_sentiment == pytest.approx((4 * 1.0 + 4 * 0.5) / 8) and r.social_event_ratio == pytest.approx(8 / 72) and r.social_comment_rate == pytest.approx(3.0)
    assert r.event_velocity_1h == pytest.approx(math.tanh(6 / 12)) and r.social_influence_norm == pytest.approx(math.tanh(math.log1p(5 / 3) / 2))
    base = spark.createDataFrame([("a", 8 * HOUR, 0.0, 1.0), ("a", 0, 0.5, 1.0)], "symbol string, ts long, social_post_sentiment double, other double")
    mixed = {x.ts: x for x in A.blend_profiles(base, A.social_profile(grid, buckets, 6 * HOUR, cap=3)).collect()}
    assert mixed[8 * HOUR].social_post_sentiment == pytest.approx(0.75) and mixed[0].social_post_sentiment == 0.5 and mixed[0].other == 1.0


def test_stats_pack_is_numpys(spark):
    r = random.Random(3)
    values = [None] + [r.gauss(0, 1) for _ in range(30)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "symbol string, ts long, x double")
    rows = R.with_stats(df, "x", (5, 12)).orderBy("ts").collect()
    known = np.array(values[1:])
    for i, row in enumerate(rows):
        for n in (5, 12):
            seg = known[max(0, i + 1 - n) : i + 1]
            e = [seg[0]]
            for v in seg[1:]:
                e.append(2 / (n + 1) * v + (1 - 2 / (n + 1)) * e[-1])
            ac = np.corrcoef(seg[:-1], seg[1:])[0, 1] if len(seg) > 2 else 0.0
            want = {"mean": seg.mean(), "std": seg.std(), "min": seg.min(), "max": seg.max(), "last": seg[-1], "zscore": (seg[-1] - seg.mean()) / max(seg.std(), 1e-9), "ewm_mean": e[-1], "ewm_std": np.std(e), "autocorr1": ac, "quantile_10": np.quantile(seg, 0.1), "quantile_90": np.quantile(seg, 0.9)}
            assert {k: row[f"{k}_{n}"] for k in want} == pytest.approx(want, abs=1e-7)


def test_regime_features_mask_what_is_missing(spark):
    df = spark.createDataFrame([("a", 1, 0.1, None, 5.0), ("a", 2, None, 2.0, 3.0), ("a", 3, 0.3, 2.0, 9.0)], "symbol string, ts long, ret_1 double, orderbook_spread_bps double, open_interest double")
    x = R.regime_features(df).orderBy("ts").collect()
    assert x[1].regime[10] == -2.0 and x[1].regime[11] == pytest.approx(2.0 * 3.0 * (1 + np.std([0.1, 0.0])))
    assert [r.regime_mask[3] for r in x] == [1, 0, 0] and [r.regime_mask[2] for r in x] == [0, 1, 0] and [r.regime_mask[11] for r in x] == [1, 1, 0] and x[0].regime_mask[4] == 1
    assert x[2].regime[2] == pytest.approx(float(np.mean(((np.array([0.1, 0, 0.3]) - 0.4 / 3) / np.std([0.1, 0, 0.3])) ** 3)))


def test_metric_pack_by_hand(spark):
    rows = [("a", 1, 0.01, 0.01, 0.5, 1.0, 0.9, 0.0, 1.0), ("a", 2, -0.02, -0.02, 2.0, 1.0, 0.6, 0.0, 1.0), ("a", 3, 0.03, 0.03, 0.0, 1.0, 0.5, 0.0, 1.0), ("a", 4, 0.01, 0.011, -0.1, 1.0, 0.4, 0.0, 1.0)]
    m = E.metric_pack(spark.createDataFrame(rows, "k string, ts long, y_raw double, y_net double, mu double, sigma double, p_up double, q_low double, q_high double"), ["k"]).first()
    pos, y = np.array([0.5, 1.0, 0.0, -0.1]), np.array([0.01, -0.02, 0.03, 0.01])
    turn = np.abs(np.diff(pos, prepend=0))
    pnl = pos * y - turn * (5 + 4.8 + 2 * (1 + 0.3 * turn.mean()) * (1 + 0.5 * np.abs(y).mean())) / 1e4
    curve = np.cumprod(1 + pnl)
    assert (m.n, m.turnover, m.sharpe, m.avg_holding) == pytest.approx((4, turn.mean(), pnl.mean() / pnl.std(), 1.5))
    assert m.max_drawdown == pytest.approx(abs((curve / np.maximum.accumulate(curve) - 1).min()))
    assert m.spearman_ic == pytest.approx(np.corrcoef([3, 4, 2, 1], [2, 1, 4, 3])[0, 1]) and m.coverage == 0.75 and m.hit_rate == 0.25


def test_verdicts(spark):
    r = random.Random(2)
    value = "symbol string, value double, is_new boolean"
    same = [("a", r.gauss(0, 1), i % 2 == 0) for i in range(4000)] + [("b", r.gauss(3.0 * (i % 2), 1), i % 2 == 1) for i in range(4000)]
    scores = spark.createDataFrame(same, value)
    hits = spark.createDataFrame([("a", 1.0, True), ("a", 0.9, False), ("b", 1.0, True)], value)
    none = spark.createDataFrame([], value)
    got = {x.symbol: x for x in E.drift_verdict(scores, scores.withColumn("name", F.lit("f")), hits, none, none, ["symbol"]).collect()}
    assert (got["a"].action, got["b"].action) == ("keep", "rollback_check")
    assert got["a"].label_stability_delta == pytest.approx(0.1) and got["b"].label_stability_delta == 1.0 and got["a"].reject_rate_delta == 0.0


def test_agreement_and_chain(spark):
    reviews = spark.createDataFrame([(1, "x", "ok", 1), (1, "x", "bad", 2), (1, "y", "ok", 1), (2, "x", "ok", 1), (2, "y", "bad", 1), (2, "z", None, 1), (None, "x", "ok", 1), (3, "x", "ok", 1)], "event int, reviewer string, verdict string, ts int")
    assert {(x.a, x.b): (x.pairs, x.agreed) for x in E.reviewer_agreement(reviews).collect()} == {("x", "y"): (2, 1), ("x", "z"): (1, 0), ("y", "z"): (1, 0)}
    frame = lambda *rows: spark.createDataFrame(list(rows), "decision int, ts long, ref int")
    (one,) = E.audit_chain({"decision": frame((1, 5, 1)), "order": frame((1, 5, 7), (1, 9, 8)), "fill": frame((1, 7, 3), (None, 1, 1))}).collect()
    assert [(x.kind, x.ref) for x in one.chain] == [("decision", "1"), ("order", "7"), ("fill", "3"), ("order", "8")] and one.steps == 4


def test_new_events_and_entities(spark):
    batch, there = spark.createDataFrame([("p", 2, 1), ("p", 1, 2), ("q", 1, 3)], "fp string, ts int, id int"), spark.createDataFrame([("q",)], "fp string")
    assert [(r.fp, r.id) for r in io.new_events(batch, there, "fp", ("ts", "id")).collect()] == [("p", 2)]
    entities, links = io.entity_links(spark.createDataFrame([(1, "lang", "en"), (1, "lang", "en"), (4, "lang", "en"), (2, "lang", None)], "doc int, kind string, name string"), "doc")
    assert [tuple(r) for r in entities.collect()] == [("lang", "en", 1, 4)] and links.count() == 2


def test_late_rows_are_dropped(spark):
    start = datetime(2024, 5, 1, tzinfo=timezone.utc)
    schema = "symbol string, ts timestamp, id long, price double, size long"
    folder = io.scratch(spark)
    for rows in ([("a", 0, 1), ("a", 200, 2)], [("b", 201, 6)], [("a", 5, 3), ("a", 190, 4)], [("a", 400, 5)]):
        spark.createDataFrame([(s, start + timedelta(minutes=m), i, float(i), 1) for s, m, i in rows], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = streams.file_stream(spark, folder, spark.createDataFrame([], schema).schema)
    got = streams.last_update(streams.run(streams.bars_stream(stream, "1 hour", "30 minutes"), "update"), "symbol", "window")
    # Rows are late by the watermark before the last batch, which stood at minute 170 when minute 5 came; minute 190 was still in time.
    assert sorted((r.open, r.close, r.volume) for r in got.where("symbol = 'a'").collect()) == [(1.0, 1.0, 1), (4.0, 2.0, 2), (5.0, 5.0, 1)]


def test_sql_functions_are_the_column_ones(spark):
    from tidegrid.functions import expr as X
    from tidegrid.functions.registered import register

    register(spark)
    rows = [(1.0, 0.03, 0.4, 0.2, 9.0, -0.0002, 1000.0), (24.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0), (5.0, 0.5, -1.0, 1.5, 90.0, 0.01, 5e4)]
    df = spark.createDataFrame(rows, "h double, vol double, liquidity double, turnover double, spread_bps double, funding double, notional double")
    c = [F.col(n) for n in ("h", "vol", "liquidity", "spread_bps", "funding")]
    costs = X.cost_breakdown(c[1], c[2], F.col("turnover"), c[0], c[3], c[4], F.col("notional"))["total"]
    got = df.select(F.expr("cost_bps(h, vol, liquidity, turnover, spread_bps, funding, notional)"), costs, F.expr("turnover_estimate(h, vol, liquidity, spread_bps, funding)"), X.turnover_estimate(*c), F.expr("quality_score(vol, h, liquidity, turnover)"), X.quality_score(c[1], c[0], c[2], F.col("turnover")))
    for r in got.collect():
        assert (r[0], r[2], r[4]) == pytest.approx((r[1], r[3], r[5]))


def test_encoder_hook(spark):
    from tidegrid.operators.encode import encode_texts

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "abcd")], "id int, t string").coalesce(1)
    got = {r.id: r.v for r in encode_texts(df, "t", "v", lambda texts: [[len(t), len(texts)] for t in texts], size=2).collect()}
    assert got == {1: [2, 2], 2: None, 3: [0, 2], 4: [4, 1]}

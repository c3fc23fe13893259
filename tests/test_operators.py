"""Invariants on small hand-made rows: no look-ahead, purged splits, masks, ties, nulls and empty tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import expr as E
from tidegrid.operators import assemble as S
from tidegrid.operators import rolling as R
from tidegrid.operators.aggregate import hysteresis
from tidegrid.operators.align import asof_join, range_join
from tidegrid.sources import io

HOUR = 3_600_000_000


def test_asof_never_looks_ahead(spark):
    random.seed(1)
    left = [(i, random.choice("ab"), random.randrange(200)) for i in range(150)]
    right = [(random.choice("abc"), random.randrange(200), i, float(i)) for i in range(80)]
    l = spark.createDataFrame(left, "id int, k string, ts long")
    r = spark.createDataFrame(right, "k string, ts long, id int, v double")
    got = {x.id: (x.v, x.missing) for x in asof_join(l, r, ["k"], {"v": "v"}).collect()}
    for i, k, ts in left:
        known = [(t, n, v) for kk, t, n, v in right if kk == k and t <= ts]
        assert got[i] == ((max(known)[2], 0) if known else (None, 1))


def test_asof_age_ties_and_empty(spark):
    l = spark.createDataFrame([(1, "a", 100)], "id int, k string, ts long")
    r = spark.createDataFrame([("a", 90, 2, 2.0), ("a", 90, 10, 3.0)], "k string, ts long, id int, v double")
    assert asof_join(l, r, ["k"], {"v": "v"}).first().v == 3.0
    assert asof_join(l, r, ["k"], {"v": "v"}, max_age=5).first().missing == 1
    assert asof_join(l, r.limit(0), ["k"], {"v": "v"}).first().missing == 1
    assert asof_join(l.limit(0), r, ["k"], {"v": "v"}).count() == 0


def test_range_join_against_all_pairs(spark):
    random.seed(2)
    a = [("x", random.randrange(-50, 300), i) for i in range(60)]
    b = [("x", random.randrange(-50, 300), i) for i in range(60)]
    l, r = spark.createDataFrame(a, "k string, ts long, i int"), spark.createDataFrame(b, "k string, right_ts long, j int")
    got = {(x.i, x.j) for x in range_join(l, r, ["k"], -7, 20).collect()}
    assert got == {(i, j) for _, t, i in a for _, u, j in b if -7 <= u - t <= 20}
    assert range_join(l, r, ["k"], 5000, 6000, how="left").count() == 60


def test_range_join_left_keeps_each_row(spark):
    l = spark.createDataFrame([("x", 10, None), ("x", 10, None), ("x", 10, "p"), (None, 10, "q"), ("x", None, "r"), ("y", 10, "s"), ("x", 11, "t")], "k string, ts long, note string")
    r = spark.createDataFrame([("x", 11, 1), ("x", 12, 2), (None, 10, 3), ("x", None, 4)], "k string, right_ts long, j int")
    got = sorted(((x.k, x.ts, x.note, x.right_ts, x.j) for x in range_join(l, r, ["k"], 0, 1, how="left").collect()), key=repr)
    want = [("x", 10, None, 11, 1)] * 2 + [("x", 10, "p", 11, 1), (None, 10, "q", None, None), ("x", None, "r", None, None), ("y", 10, "s", None, None), ("x", 11, "t", 11, 1), ("x", 11, "t", 12, 2)]
    assert got == sorted(want, key=repr)
    assert range_join(l, r, ["k"], 0, 1).count() == 5
    assert range_join(l, r, ["k"], 1, 1, how="left").where("j IS NOT NULL").count() == 4


def test_asof_null_keys_clashing_names_and_no_keys(spark):
    l = spark.createDataFrame([(1, None, 100, 5.0), (2, "a", 100, 5.0), (3, "a", None, 5.0)], "id int, k string, ts long, v double")
    r = spark.createDataFrame([(None, 90, 1, 1.0), ("a", 95, 2, 2.0), ("a", None, 3, 3.0)], "k string, ts long, id int, v double")
    out = asof_join(l, r, ["k"], {"v": "v"})
    assert sorted(out.columns) == ["id", "k", "missing", "right_ts", "ts", "v"]
    assert {x.id: (x.v, x.missing) for x in out.collect()} == {1: (None, 1), 2: (2.0, 0), 3: (None, 1)}
    random.seed(3)
    left = [(i, random.randrange(-300, 600)) for i in range(200)]
    right = [(random.randrange(-300, 600), i) for i in range(60)]
    got = asof_join(spark.createDataFrame(left, "id int, ts long"), spark.createDataFrame(right, "ts long, n int"), [], {"n": "n"}, tie="n", max_age=20)
    for x in got.collect():
        known = [(t, n) for t, n in right if x.ts - 20 <= t <= x.ts]
        assert (x.n, x.right_ts, x.missing) == ((max(known)[1], max(known)[0], 0) if known else (None, None, 1))
    with pytest.raises(ValueError):
        asof_join(l, r, [], {"v": "v"})


def test_costs_and_scores_by_hand(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    d = F.lit
    # 0.35 / 2 * (1 + 0.8 * 1) * (1 + 0.5 * 0.5) * (1 + 0.25 * 1) * (1 + 0.1 * 3)
    assert value(E.turnover_estimate(d(4.0), d(-0.02), d(0.5), d(8.0), d(0.5))) == pytest.approx(0.35 / 2 * 1.8 * 1.25 * 1.25 * 1.3)
    assert value(E.turnover_estimate(d(1e9), d(0.0), d(1.0), d(0.0), d(0.0))) == 0.01
    costs = {k: value(c) for k, c in E.cost_breakdown(d(0.04), d(0.5), d(0.2), d(24), d(10.0), d(-0.0001), d(1000.0)).items()}
    assert costs == pytest.approx({"fee": 12.0, "slippage": 4 * 2.4 * 1.3, "impact": 2 * 2.4 * 1.06 * 1.02, "funding": 24.0, "infra": 1.88 / 7.2 * 24 / 1000 * 1e4, "total": 12 + 4 * 2.4 * 1.3 + 4.8 * 1.06 * 1.02 + 24 + 1.88 / 7.2 * 240})
    assert value(E.cost_breakdown(d(0.0), d(1.0), d(0.0), d(2), d(0.0), d(0.0), d(0.0))["total"]) == pytest.approx(10.0)
    assert value(E.simple_cost(d(-3.0), d(0.5), d(4))) == pytest.approx((5 + 3 + 2 + 4 + 0.5) * 1.6 / 1e4)
    assert value(E.signal_score({"ret_12": d(1.0), "vol_48": d(-2.0)})) == pytest.approx(0.5 + 0.35 * 0.6 - 0.02)
    assert value(E.position_size(d(0.019), d(1.0), d(0.0), d(False))) == 0
    assert value(E.position_size(d(-0.10), d(0.5), d(100.0), d(True))) == pytest.approx(0.05 * 0.7615941559557649 * 0.7 * 0.988 * 0.65)
    assert [value(E.influence_tier(d(n))) for n in (999, 1_000, 10_000, 100_000, 1_000_000)] == ["nano", "micro", "mid", "macro", "mega"]
    book = {k: value(c) for k, c in E.proxy_book(d(100.0), d(102.0), d(100.0), d(101.0), d(200.0)).items()}
    assert book["imbalance"] == pytest.approx(0.7615941559557649) and book["bid_sz"] == pytest.approx(10 * 1.7615941559557649)
    assert book["spread_bps"] == pytest.approx(1.5 + 2800 * 0.00995033085316808 + 8 / 5.308267697401205)
    assert value(E.startup_vector(d("MNA "), d(2.0), d(0.5), d(None).cast("double"), d(0.25))) == pytest.approx([0.7, 0.8, 0.5, 0.0, 0.25])
    assert value(E.startup_targets(d("product"), d(0.5), d(0.5), d(0.5))["multiple"]) == pytest.approx(0.8 + 0.8 + 0.2 + 0.15 + 0.1)


def test_sentiment_by_hand(spark):
    rows = {"strong gain": 1.0, "not a strong gain": 0.0, "very weak": -1.0, "slightly strong but loss": (0.7 - 1) / 1.7, "strong \U0001f4c9": 0.4 / 1.6, "gain!!": 1.0, "loss, weak, gain!": -1 / 3 * 1.03, "strong /s": 0.5, "isn't a record": -1.0, "": 0.0, "\U0001f680": 1.0, "words alone": 0.0}
    df = spark.createDataFrame([(t,) for t in rows] + [(None,)], "t string").select("t", E.lexicon_sentiment(F.col("t")).alias("s"))
    got = {r.t: r.s for r in df.collect()}
    assert got.pop(None) == 0.0 and got == pytest.approx(rows)


def test_purge_gap():
    day = 24 * HOUR
    folds = S.walk_forward(0, 40 * day, 10 * day, 3 * day, 3 * day, day, 3 * day)
    by = {(f, s): (a, b) for f, s, a, b in folds}
    assert by
    for f in {x[0] for x in folds}:
        assert by[f, "val"][0] - by[f, "train"][1] >= day and by[f, "test"][0] - by[f, "val"][1] >= day


def test_hysteresis(spark):
    ranked = spark.createDataFrame([(s, k + 1) for k, s in enumerate("DAEBFC")], "symbol string, rank int")
    rows = hysteresis(ranked, list("ABC"), 3, 4).orderBy("place").collect()
    assert [(r.symbol, r.kept) for r in rows] == [("A", True), ("B", True), ("D", False)]


def test_contract(spark):
    features = (S.Feature("a", required=True), S.Feature("b", impute="median"), S.Feature("c", impute="ffill"), S.Feature("z"))
    df = spark.createDataFrame([("s", 1, 1.0, 4.0, 7.0), ("s", 2, None, None, None), ("s", 3, 2.0, 8.0, 9.0)], "symbol string, ts long, a double, b double, c double")
    got = {r.ts: (list(r["values"]), list(r["mask"])) for r in S.align(df, features).collect()}
    assert got[2] == ([0.0, 6.0, 7.0, 0.0], [1, 1, 1, 1]) and got[3] == ([2.0, 8.0, 9.0, 0.0], [0, 0, 0, 1])
    with pytest.raises(ValueError):
        S.align(df.withColumn("other", F.lit(1)), features)
    with pytest.raises(ValueError):
        S.align(df.drop("a"), features)
    assert S.contract_hash(features) == S.contract_hash(features[::-1])


def test_prefix_sums_equal_frames(spark):
    df = spark.createDataFrame([("s", i, float(i * i % 17)) for i in range(50)], "symbol string, ts long, x double")
    both = R.prefix_mean(df, "x", 12, "fast").withColumn("slow", F.avg("x").over(R.rows(12)))
    assert both.where("abs(fast - slow) > 1e-9").isEmpty()


def test_sentiment(spark):
    texts = ["very bullish and strong \U0001f680", "not bullish", "bullish", "bullish /s", None, ""]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", E.lexicon_sentiment(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got[0] > 0.2 and got[1] < 0 and abs(got[3]) < abs(got[2]) and got[4:] == [0.0, 0.0]


def test_cost_is_one_definition(spark):
    parts = E.cost_breakdown(F.lit(0.02), F.lit(0.8), F.lit(0.5), F.lit(4))
    row = spark.range(1).select(*(c.alias(n) for n, c in parts.items())).first()
    assert row.total == pytest.approx(row.fee + row.slippage + row.impact + row.funding + row.infra)


def test_positions_flip_resets_basis(spark):
    fills = spark.createDataFrame([("k", 1, 10.0, 100.0), ("k", 2, -15.0, 110.0), ("k", 3, 5.0, 90.0)], "k string, ts int, qty double, price double")
    r = S.positions(fills, ["k"], ["ts"]).first()
    assert (r.qty, r.avg_cost, r.realised) == (0.0, 0.0, 200.0)


def test_grid_fill_is_causal(spark):
    p = spark.createDataFrame([("s", 1000, 1, 1.0), ("s", 1000, 2, 2.0), ("s", 2500, 3, 3.0)], "symbol string, ts long, id int, value double")
    assert [(r.ts, r.value) for r in R.fill_grid(p, 4000, 1000).orderBy("ts").collect()] == [(1000, 2.0), (2000, 2.0), (3000, 3.0), (4000, 3.0)]
    assert [(r.ts, r.value) for r in R.fill_grid(p, 3000, 1000, parity=True).orderBy("ts").collect()] == [(0, 2.0), (1000, 2.0), (2000, 3.0), (3000, 3.0)]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 3), (3, "d", 4)], "k int, v string, seq int")
    assert {r.k: r.v for r in io.upsert(old, new, ["k"], "seq").collect()} == {1: "a", 2: "c", 3: "d"}
    assert {r.k: r.v for r in io.insert_ignore(old, new, ["k"]).collect()} == {1: "a", 2: "b", 3: "d"}


def test_equity_guards_total_loss(spark):
    df = spark.createDataFrame([("s", 1, 0.5), ("s", 2, -1.0), ("s", 3, 0.5)], "symbol string, ts int, ret double")
    assert [r.equity for r in R.equity(df).orderBy("ts").collect()] == pytest.approx([1.5, 0.0, 0.0])

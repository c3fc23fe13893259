"""Trailing sums and direction counts against every pair; wider bars against bars of trades; upserts."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators.bars import fan_out, roll_up, to_bars
from tidegrid.operators.trailing import Trailing, direction_counts, trailing_sums
from tidegrid.sources import io

HOUR = 3_600_000_000


def test_trailing_sums(spark):
    r = random.Random(1)
    events = [(r.choice("ab"), r.randrange(-40, 200), r.choice([1.0, 1e9, -2.5, None])) for _ in range(150)] + [(None, 5, 1.0), ("a", None, 1.0)]
    grid = [(r.choice("abc"), r.randrange(-60, 260)) for _ in range(80)] + [("a", 10), ("a", 10), (None, 5), ("b", None)]
    e, g = spark.createDataFrame(events, "symbol string, ts long, v double").repartition(3), spark.createDataFrame(grid, "symbol string, ts long")
    for width in (1, 7, 50, 1000):
        spans = [Trailing(width, {"open_n": F.lit(1), "open_v": F.col("v")}, {"fade": (F.abs("v"), 9.0 if width < 1000 else 90.0)}), Trailing(width, {"closed_n": F.lit(1)}, closed=True)]
        got = {(x.symbol, x.ts): x for x in trailing_sums(g, e, spans).collect()}
        assert set(got) == {x for x in grid if None not in x}
        for (s, t), x in got.items():
            inside = [(u, v) for k, u, v in events if k == s and u is not None and t - width < u <= t]
            assert x.open_n == len(inside)
            assert x.open_v == pytest.approx(sum(v or 0 for _, v in inside), rel=1e-12, abs=1e-9)
            assert x.fade == pytest.approx(sum(abs(v or 0) * math.exp(-(t - u) / (9 if width < 1000 else 90)) for u, v in inside), rel=1e-9)
            assert x.closed_n == sum(k == s and u is not None and t - width <= u <= t for k, u, _ in events)
    assert trailing_sums(g, e.limit(0), spans).agg(F.sum("open_n")).first()[0] == 0 and trailing_sums(g.limit(0), e, spans).count() == 0
    with pytest.raises(ValueError, match="repeat"):
        trailing_sums(g, e, [Trailing(1, {"n": F.lit(1)}), Trailing(2, {"n": F.lit(1)})])
    with pytest.raises(ValueError, match="decay"):
        trailing_sums(g, e, [Trailing(1000, decayed={"f": (F.lit(1), 1.0)})])


def test_trailing_sums_make_no_pairs(spark):
    g = spark.range(400).select(F.lit("a").alias("symbol"), F.col("id").alias("ts"))
    e = g.withColumn("v", F.lit(1.0))
    for width in (10, 300):
        plan = trailing_sums(g, e, [Trailing(width, {"n": F.col("v")})])
        assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
        assert plan.agg(F.sum("n")).first()[0] == sum(min(k + 1, width) for k in range(400))


@pytest.mark.parametrize(("low", "high"), [(1, 24), (0, 0), (-5, 5), (3, 400)])
def test_direction_counts(spark, low, high):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.randrange(300), r.choice([100.0, 101.0, 99.0, 102.0, 98.5, 100.99999999999999, -3.0])) for _ in range(500)] + [("a", 7, 0.0), ("a", 8, None), (None, 9, 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts long, close double").repartition(3)
    kept = [x for x in rows if None not in x and x[2] > 0]
    want = sorted((s, t, p, sum(q / p - 1 > 0.01 for q in ahead), sum(q / p - 1 < -0.01 for q in ahead), sum(abs(q / p - 1) <= 0.01 for q in ahead)) for s, t, p in kept for ahead in ([q for k, u, q in kept if k == s and t + low <= u <= t + high],))
    assert sorted(tuple(x) for x in direction_counts(df, low, high, 0.01).collect()) == want


def ticks(spark, n=400):
    r = random.Random(3)
    return spark.createDataFrame([(r.choice("ab"), r.randrange(4 * 24 * HOUR), k, r.uniform(1, 9), k % 5) for k in range(n)], "symbol string, ts long, id long, price double, size long")


def test_wider_bars_are_merged(spark):
    widths = {"1h": HOUR, "4h": 4 * HOUR, "1d": 24 * HOUR}
    t = ticks(spark)
    got = roll_up(to_bars(t, HOUR), widths, HOUR)
    for name, width in widths.items():
        columns = ["symbol", "ts", "open", "high", "low", "close", "volume", "trades"]
        assert sorted(map(tuple, got.where(F.col("tf") == name).select(columns).collect())) == sorted(map(tuple, to_bars(t, width).select(columns).collect()))
    with pytest.raises(ValueError, match="can't be made"):
        roll_up(to_bars(t, HOUR), {"90m": 3 * HOUR // 2}, HOUR)


def test_context_is_known_at_its_time(spark):
    bars = spark.createDataFrame([("a", k * HOUR, 1.0, 1.0, 1.0, float(k + 1), 2.0, 1) for k in range(6)], "symbol string, ts long, open double, high double, low double, close double, volume double, trades long")
    widths = {"1h": HOUR, "4h": 4 * HOUR}
    grid = spark.createDataFrame([("a", HOUR - 1), ("a", 5 * HOUR), ("b", HOUR)], "symbol string, ts long")
    got = {(x.symbol, x.as_of): x for x in fan_out(grid, roll_up(bars, widths, HOUR), widths).collect()}
    assert got["a", HOUR - 1].context["1h"].missing == 1 and got["b", HOUR].context["4h"].close is None
    one, four = got["a", 5 * HOUR].context["1h"], got["a", 5 * HOUR].context["4h"]
    assert (one.close, one.ret_1, one.lag_sec, one.bar_ts) == (5.0, 0.25, 0.0, 5 * HOUR)
    assert (four.close, four.ret_1, four.volume, four.lag_sec) == (4.0, None, 8.0, 3600.0)
    assert got["a", 5 * HOUR].coverage["4h"].lag_sec == 3600.0


def test_upsert_partitions(spark):
    path = io.scratch(spark)
    put = lambda *rows: io.upsert_partitions(spark.createDataFrame(list(rows), "k long, v string, day long"), path, ["k"], "day")
    content = lambda: sorted((r.k, r.v) for r in spark.read.schema("k long, v string, day long").parquet(path).collect())
    put((1, "a", 0), (2, "b", 0), (3, "c", 1))
    for _ in range(2):
        put((2, "B", 0), (4, "d", 2), (4, "e", 2))
        assert content() == [(1, "a"), (2, "B"), (3, "c"), (4, "e")]

"""Ranks, quantiles and scans in chunks against the plain forms."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import rolling as R
from tidegrid.operators.align import asof_join
from tidegrid.operators.order import quantiles, ranked, sketched


def test_ranked(spark):
    r = random.Random(1)
    rows = [(k, r.choice([1.0, 2.0, None, -5.0, r.random()]), 9) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, v double, rank int").repartition(7)
    got = {x.id: x["rank"] for x in ranked(df, F.desc("v"), "id").collect()}
    assert got == {k: n + 1 for n, (k, *_) in enumerate(sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])))}
    assert ranked(df.limit(0), "v", "id").count() == 0 and ranked(df.limit(1), "v", "id").first()["rank"] == 1


@pytest.mark.parametrize(("few", "ranges"), [(100_000, 1024), (5, 4), (1, 2)])
def test_quantiles(spark, few, ranges):
    r = random.Random(2)
    rows = [("a", r.gauss(0, 1)) for _ in range(300)] + [("b", float(r.choice([1, 2, 2, 2, 7]))) for _ in range(200)] + [("c", 3.0)] * 50 + [("d", None), ("d", float("nan")), ("e", -1e300), ("e", 1e300), ("e", 0.0), ("f", 4.0)]
    rows += [("g", 10.0 ** r.uniform(-9, 9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    qs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {x.k: x for x in quantiles(df, ["k"], "v", qs, few, ranges).collect()}
    assert set(got) == set("abcdefg") and got["d"].p50 is None
    for k in "abcefg":
        held = [v for kk, v in rows if kk == k]
        for name, q in qs.items():
            assert got[k][name] == pytest.approx(float(np.quantile(held, q)), rel=1e-12), (k, name)
    whole = quantiles(df.where("k IN ('a', 'b')"), [], "v", {"m": 0.5}, few, ranges).collect()
    assert [x.m for x in whole] == [pytest.approx(float(np.quantile([v for k, v in rows if k in "ab"], 0.5)), rel=1e-12)]
    assert [x.m for x in quantiles(df.limit(0), [], "v", {"m": 0.5}).collect()] == [None]
    assert quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_sketched(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.hash("id").cast("double").alias("v"))
    exact = {x.k: x.p for x in quantiles(df, ["k"], "v", {"p": 0.9}).collect()}
    for x in sketched(df, ["k"], "v", {"p": 0.9}, 0.01).collect():
        assert abs(df.where((F.col("k") == x.k) & (F.col("v") <= x.p)).count() / 10_000 - 0.9) <= 0.011 and exact[x.k]


def test_asof_in_chunks(spark):
    r = random.Random(3)
    left = [(k, r.choice(["hot", "hot", "hot", "b", None]), r.randrange(-50, 400)) for k in range(300)]
    right = [(r.choice(["hot", "c", None]), r.randrange(-50, 400) if k % 3 else 17, k, float(k) if k % 5 else None) for k in range(60)]
    l, q = spark.createDataFrame(left, "id int, k string, ts long"), spark.createDataFrame(right, "k string, ts long, id int, v double")
    said = lambda **more: sorted((tuple(x) for x in asof_join(l, q, ["k"], {"v": "v"}, **more).collect()), key=repr)
    for chunk in (1, 10, 100, 10_000):
        assert said(chunk=chunk) == said() and said(chunk=chunk, max_age=20) == said(max_age=20)
    assert said(chunk=10, max_age=20) and asof_join(l, q.limit(0), ["k"], {"v": "v"}, chunk=10).where("missing = 0").count() == 0


def test_scans_in_chunks(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "b", None]), t, t % 7, r.choice([0.1, -0.2, 0.05]) if t != 180 else -1.0, r.random()) for t in range(-20, 200)]
    df = spark.createDataFrame(rows, "symbol string, ts long, id long, ret double, v double")
    near = lambda x, n: sorted((tuple(round(y, 9) if isinstance(y, float) else y for y in row) for row in x.select("symbol", "ts", *n).collect()), key=repr)
    for chunk in (1, 13, 1000):
        for initial in (False, True):
            assert near(R.equity(df, include_initial=initial, chunk=chunk), ["equity", "drawdown"]) == near(R.equity(df, include_initial=initial), ["equity", "drawdown"])
        before = df.withColumn("prev_v", F.lag("v").over(R.by()))
        assert near(R.previous(df, "v", chunk), ["prev_v"]) == near(before, ["prev_v"])
        known = df.where("symbol IS NOT NULL")
        for parity in (False, True):
            assert near(R.fill_grid(known, 230, 4, "v", parity, chunk=chunk), ["v"]) == near(R.fill_grid(known, 230, 4, "v", parity), ["v"])


def test_one_hot_symbol_takes_many_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("symbol"), F.col("id").alias("ts"), F.col("id"), F.lit(0.001).alias("ret"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = lambda out: len(out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(out.columns[-1])).collect())
        # The frames end by (symbol, chunk), so all of four partitions have rows.
        assert tasks(R.previous(df, "ret", 10)) == 4 and tasks(df.withColumn("prev", F.lag("ret").over(R.by()))) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

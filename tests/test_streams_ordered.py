"""Stateful streams: silent sources, late and unordered rows, and sources without rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators.assemble import positions
from tidegrid.sources import io
from tidegrid.streaming import streams as S

SECOND = 1_000_000
#: A watermark begins at the epoch, so rows of that time would be late.
BASE = 1_700_000_000 * SECOND
EVENTS = "source string, ts timestamp, id long"


def stream(spark, df, parts=3, arrival="ts", closing=None):
    folder = io.scratch(spark)
    S.split_files(df, folder, parts, arrival)
    shown = df.select(*(c for c in df.columns if not c.startswith("__")))
    if closing is not None:
        S.close_files(shown, folder, closing)
    return S.file_stream(spark, folder, shown.schema)


def test_a_silent_source_raises_its_alert(spark):
    at = {"a": [0, 100, 701, 1302, 9000], "b": [0, 600, 1200, 1800], "late": [5000]}
    rows = [(s, t * SECOND, k) for s, times in at.items() for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, "source string, ts long, id long").withColumn("ts", F.timestamp_micros("ts"))
    with S.rocksdb(spark):
        got = S.run(S.freshness_alerts(stream(spark, df, closing=100_000 * SECOND), late="10 minutes")).where("source IS NOT NULL")
    want = {("a", 100), ("a", 701), ("a", 1302), ("a", 9000), ("b", 1800), ("late", 5000)}
    assert sorted((r.source, r.last_at // SECOND, (r.alert_at - r.last_at) // SECOND) for r in got.collect()) == sorted((s, t, 600) for s, t in want)


def test_unordered_fills_give_the_result_of_the_batch(spark):
    r = random.Random(1)
    rows = [(r.randrange(4), BASE + k * 60 * SECOND, k, float(r.choice([-2, -1, 1, 3])), r.uniform(1, 9), k * 60 + r.randrange(7200)) for k in range(400)]
    df = spark.createDataFrame(rows, "user_id long, ts long, id long, qty double, price double, __arrival long")
    batch = {x.user_id: x for x in positions(df, ["user_id"], ["ts", "id"]).collect()}
    timed = df.withColumn("ts", F.timestamp_micros("ts"))
    with S.rocksdb(spark):
        found = S.last_update(S.run(S.positions_stream(stream(spark, timed, 6, "__arrival", closing=BASE + 400 * 60 * SECOND + 86_400 * SECOND), "3 hours"), "update"), "user_id")
        got = {x.user_id: x for x in found.where("user_id IS NOT NULL").collect()}
    assert set(got) == set(batch)
    for u, b in batch.items():
        assert (got[u].qty, got[u].avg_cost, got[u].realised, got[u].unrealised) == pytest.approx((b.qty, b.avg_cost, b.realised, b.unrealised))


def test_sources_without_rows(spark):
    empty = spark.createDataFrame([], EVENTS)
    ticks = spark.createDataFrame([], "symbol string, ts timestamp, id long, user_id long, price double, size long, sentiment double, rejected int, lag double, fingerprint string, qty double")
    with S.rocksdb(spark):
        assert S.run(S.freshness_alerts(stream(spark, empty))).count() == 0
    for make in (S.bars_stream, S.sliding_counts, S.sessions, S.lag_alerts, S.dedup_stream):
        assert S.run(make(stream(spark, ticks))).count() == 0

"""What the findings of round 3 showed, on small rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from tidegrid.operators.trailing import Trailing, trailing_sums
from tidegrid.plans.registry import QUERIES, SQL

START = datetime(2025, 3, 1, tzinfo=timezone.utc)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events_of(spark, tmp_path, rows):
    """A folder with an events table of (id, minutes after START, user, type, value, size)."""
    made = [(k, START + timedelta(minutes=t), u, s, p, f'{{"k": {z}}}') for k, t, u, s, p, z in rows]
    spark.createDataFrame(made, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def by_sql(name, folder):
    duck = duckdb.connect()
    duck.sql("SET timezone = 'UTC'")
    duck.sql(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{folder}/events.parquet/*.parquet'")
    return duck.sql(SQL[name]).fetchall()


def test_f1_prices_of_zero_and_rows_of_one_time(spark, tmp_path):
    prices = {1: (0.0, 5.0), 2: (5.0, 0.0), 3: (0.0, 0.0), 4: (2.0, 4.0)}
    rows = [(10 * u + k, k, u, "click", p, 1) for u, two in prices.items() for k, p in enumerate(two)]
    rows += [(45, 1, 4, "click", 8.0, 1), *((100 + u, 9, u, "purchase", 1.0, 1) for u in (1, 2, 3, 4, 5))]
    folder = events_of(spark, tmp_path, rows)
    got = {r.id: (str(r.ret_1), r.lag_sec) for r in QUERIES["jn06_asof_previous"](spark, folder).collect()}
    assert got == {101: ("inf", 480.0), 102: ("-inf", 480.0), 103: ("nan", 480.0), 104: ("1.386294", 480.0), 105: ("None", None)}
    assert got == {k: (str(v), lag) for k, v, lag in by_sql("jn06_asof_previous", folder)}


def test_f3_a_sum_halfway_between_two_results(spark, tmp_path):
    balances = [(14, -648.77, "M"), (0, 8077.34, "B"), (10, 4565.9, "F"), (6, 2592.97, "F"), (4, -874.27, "F"), (17, -611.39, "F"), (13, 7718.85, "H"), (15, 4386.76, "A"), (17, 646.95, "B"), (24, 2943.56, "H"), (20, 818.36, "F"), (15, 241.7, "A")]
    rows = [(16_188 + k, *b) for k, b in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").createOrReplaceTempView("f3")
    for k, order in enumerate(("c_custkey", "c_custkey DESC", "c_acctbal", "c_acctbal DESC", "hash(c_custkey)")):
        folder = f"{tmp_path}/{k}"
        spark.sql(f"SELECT * FROM f3 ORDER BY {order}").coalesce(1).write.parquet(f"{folder}/customer.parquet")
        assert {(r.gross, r.turnover) for r in QUERIES["ag25_exposure"](spark, folder).collect()} == {(0.2298, 0.2757)}


def test_f5_whole_texts_have_hints(spark, tmp_path):
    texts = {1: "利好", 6: "é", 11: "abc", 16: "12", 5: "abc", 7: "abc", 8: "9", 9: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.hint for r in QUERIES["sc03_language_hint"](spark, str(tmp_path)).collect()}
    assert got == {1: "zh", 6: "other", 11: "en", 16: "other", 5: "zh", 7: "en", 8: "other", 9: "other"}


def test_f4_quantiles_of_a_full_hour_are_exact(spark, tmp_path):
    lags = list(range(60_000))
    random.Random(4).shuffle(lags)
    folder = events_of(spark, tmp_path, [(k, k / 1200, k % 7, "a", 1.0, z) for k, z in enumerate(lags)])
    assert [(r.p50, r.p95) for r in QUERIES["st05_lag_alerts"](spark, folder).collect()] == [(29_999.0, 56_999.0)]


def test_f2_pairs_are_counted_with_null_and_nan_prices(spark, tmp_path):
    r = random.Random(2)
    prices = [None, float("nan"), -1.0, *map(float, range(6))]
    rows = [(k, r.randrange(600), 1, r.choice("ab"), r.choice(prices), 1) for k in range(3000)]
    folder = events_of(spark, tmp_path, rows)
    assert sorted(tuple(x) for x in QUERIES["st09_interval_join"](spark, folder).collect()) == sorted(by_sql("st09_interval_join", folder))


def reads_of_lines(spark, name):
    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")


def test_f12_f13_order_lines_are_read_once(spark):
    assert reads_of_lines(spark, "jn20_audit_chain") == 1
    # The join is written before, and the query reads that.
    assert reads_of_lines(spark, "ev13_parity") == 0 and reads_of_lines(spark, "ev14_parity_gap") == 1


def test_f9_sums_by_step_are_those_of_all_events(spark):
    r = random.Random(9)
    events = spark.createDataFrame([(r.choice("ab"), r.randrange(200), float(r.randrange(9))) for _ in range(500)], "symbol string, ts long, v double")
    grid = spark.createDataFrame([(s, t) for s in "ab" for t in range(0, 260, 20)], "symbol string, ts long")
    spans = [Trailing(40, {"open": F.col("v")}, {"fading": (F.col("v"), 30.0)}), Trailing(20, {"shut": F.col("v")}, closed=True)]
    rows = lambda step: [tuple(x) for x in trailing_sums(grid, events, spans, step=step).orderBy("symbol", "ts").collect()]
    for a, b in zip(rows(None), rows(10), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])
    with pytest.raises(Exception, match="multiple"):
        trailing_sums(grid.selectExpr("symbol", "ts + 3 AS ts"), events, spans, step=10).collect()


def test_f15_fills_are_joined_once(spark):
    found = QUERIES["ag14_execution_stats"](spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in x or "orders" in x for x in found.inputFiles())

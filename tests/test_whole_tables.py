"""Queries over a small events table of their own, none of whose rows may be left out."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from tidegrid.plans.registry import QUERIES

HOUR = 3_600_000_000
START = datetime(2025, 3, 1, 0, 20, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with events of February to April 2025, and the rows (id, ts, user_id, symbol, price)."""
    folder = tmp_path_factory.mktemp("sf")
    r = random.Random(5)
    rows = [(k, START + timedelta(minutes=r.randrange(50 * 24 * 60), microseconds=k), r.randrange(6), r.choice("ab"), float(r.randrange(90))) for k in range(400)]
    df = spark.createDataFrame([(*x, '{"k": 1}') for x in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.write.parquet(f"{folder}/events.parquet")
    return str(folder), [(k, int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)), u, s, p) for k, t, u, s, p in rows]


def test_interval_join_takes_all_pairs(spark, events):
    folder, rows = events
    pairs, hits = Counter(), Counter()
    for _, t, _, s, p in rows:
        for _, u, _, z, q in rows:
            if s == z and t + HOUR <= u < t + 2 * HOUR:
                pairs[s] += 1
                hits[s] += q > p
    assert {r.symbol: (r.pairs, r.hits) for r in QUERIES["st09_interval_join"](spark, folder).collect()} == {s: (pairs[s], hits[s]) for s in pairs}


def test_sessions_are_all_closed(spark, events):
    folder, rows = events
    by, want = defaultdict(list), {}
    for _, t, u, _, _ in rows:
        by[u].append(t)
    for u, times in by.items():
        sizes, last = [], None
        for t in sorted(times):
            if last is None or t - last >= 2 * HOUR:
                sizes.append(0)
            sizes[-1] += 1
            last = t
        want[u] = (len(sizes), max(sizes))
    assert {r.user_id: (r.sessions, r.longest) for r in QUERIES["st04_sessions"](spark, folder).collect()} == want


def test_gaps_and_fill_cover_all_ticks(spark, events):
    folder, rows = events
    first, last = min(r[1] for r in rows) // HOUR, max(r[1] for r in rows) // HOUR
    seen = defaultdict(set)
    for _, t, u, s, _ in rows:
        seen[s, u].add(t // HOUR)
    missing = {(s, u, h) for (s, u), hours in seen.items() for h in range(first, last + 1) if h not in hours}
    got = QUERIES["wn13_gaps"](spark, folder).collect()
    found = [(r.symbol, r.user_id, h) for r in got for h in range(r.gap_start // HOUR, r.gap_end // HOUR + 1)]
    assert len(found) == len(set(found)) == sum(r.missing for r in got) and set(found) == missing
    end = -(-max(r[1] for r in rows) // HOUR)
    want = {}
    for s in "ab":
        own = sorted((t, k, p) for k, t, _, z, p in rows if z == s)
        for h in range(-(-own[0][0] // HOUR), end + 1):
            want[s, h * HOUR] = max(x for x in own if x[0] <= h * HOUR)[2]
    assert {(r.symbol, r.ts): r.value for r in QUERIES["wn14_forward_fill"](spark, folder).collect()} == want


@pytest.fixture(scope="module")
def traded(spark, tmp_path_factory):
    """A folder with lines, orders and parts, and the fills (target, qty, price, fee, est, side, status, day)."""
    folder = tmp_path_factory.mktemp("sf")
    r = random.Random(6)
    rows = [(k, 1, k % 30, k % 7, float(r.randrange(1, 9)), float(r.randrange(100, 900)), 0.01 * r.randrange(5), r.choice("OF"), r.choice("FPO"), r.randrange(60)) for k in range(300)]
    at = lambda d: START + timedelta(days=d)
    spark.createDataFrame([(k, n, s, p, q, x, tax, side, at(d)) for k, n, s, p, q, x, tax, side, _, d in rows], "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_tax double, l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(x[0], x[8], at(x[9]), 1) for x in rows], "o_orderkey long, o_orderstatus string, o_orderdate timestamp, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, 90.0 + 7 * k) for k in range(7)], "p_partkey long, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return str(folder), [(s, q, x / q, tax * x, 90.0 + 7 * p, "buy" if side == "O" else "sell", status != "O", d) for _, _, s, p, q, x, tax, side, status, d in rows]


def test_parity_gap_has_every_target_and_cost(spark, traded):
    folder, rows = traded
    by = defaultdict(list)
    for x in rows:
        by[x[0]].append(x)
    got = {r.target: r for r in QUERIES["ev14_parity_gap"](spark, folder).collect()}
    assert set(got) == {t for t, own in by.items() if any(x[6] for x in own)} and len(got) > 20
    for t, r in got.items():
        done = [x for x in by[t] if x[6]]
        b, p = sum(x[4] for x in by[t]) / len(by[t]), sum(x[2] for x in done) / len(done)
        assert (r.orders, r.gap) == (len(done), pytest.approx(p - b, abs=1e-4))
        assert r.relative_deviation == pytest.approx(abs(p - b) / max(b, p), abs=1e-6)
        total, fee, slip, impact = sum(x[1] * x[4] for x in done), 0, 0, 0
        for _, q, price, paid, est, side, _, _ in done:
            f, s = paid / (q * est), max(0, (price - est if side == "buy" else est - price) / est)
            fee, slip, impact = fee + f * q * est, slip + s * q * est, impact + max(0, 8.5e-4 - f - s) * q * est
        want = (5e-4 - fee / total, 2.1e-4 - slip / total, 1.4e-4 - impact / total)
        assert (r.fee_delta, r.slippage_delta, r.impact_delta, r.total_delta) == pytest.approx((*want, sum(want)), abs=2e-6)


def test_parity_has_windows(spark, traded):
    folder, rows = traded
    got = {r.window_days: r for r in QUERIES["ev13_parity"](spark, folder).collect()}
    assert set(got) == {7, 30, None}
    last = max(x[7] for x in rows)
    for days, r in got.items():
        inside = [x for x in rows if days is None or last - x[7] < days]
        back, paper, matched = [0, 0], [0, 0], 0
        for t in {x[0] for x in inside}:
            own = [x for x in inside if x[0] == t]
            done = [x for x in own if x[6]]
            if done:
                matched += 1
                for sums, some, c in ((back, own, 4), (paper, done, 2)):
                    n = sum(x[1] * x[c] for x in some)
                    sums[0] += n * sum(x[c] for x in some) / len(some)
                    sums[1] += n
        assert r.matched == matched
        assert (r.backtest, r.paper) == pytest.approx((back[0] / back[1], paper[0] / paper[1]), abs=1e-3)

"""The panel store: built in pieces it equals one build, and what isn't published isn't there."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.sources import panel as P
from tidegrid.sources.io import scratch

HOUR = 3_600_000_000
NAMES = ["ret_1", "vol_12", "funding_rate"]
SCHEMA = "symbol string, ts long, values array<float>, mask array<tinyint>, close double, note string"


def series(n=240, symbols=("AAA", "007"), shift=0.0, start=0):
    r = random.Random(5)
    return [(s, (start + k) * HOUR, [r.uniform(-1, 1) + shift, r.random(), r.gauss(0, 1)], [0, int(k % 17 == 0), 0], 100.0 + k, "x") for s in symbols for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def store(spark, path=None, **more):
    return P.PanelStore(spark, path or scratch(spark), NAMES, **{"lookback": 32, "horizons": {"1h": 1, "4h": 4}} | more)


def content(s):
    return sorted((r.symbol, r.ts, r.close, *r["values"], *r["mask"], *(round(x, 9) for x in r.regime), *r.regime_mask) for r in s.read().collect())


@pytest.mark.parametrize("cuts", [[(0, 150), (120, 239)], [(100, 239), (0, 110)], [(0, 239), (60, 90)], [(0, 60), (61, 140), (141, 239), (130, 150)]])
def test_pieces_equal_one_build(spark, cuts):
    rows = series()
    whole, pieces = store(spark), store(spark)
    whole.build(frame(spark, rows), 0, 239 * HOUR)
    for a, b in cuts:
        told = pieces.build(frame(spark, rows), a * HOUR, b * HOUR)
    assert content(pieces) == content(whole) and len(content(whole)) == 480
    assert told["version"] == len(cuts) and told["rows"] == 480 and told["touched"] < told["partitions"] == 20
    assert {r.symbol for r in pieces.report().collect()} == {"AAA", "007"}


def test_only_touched_partitions_are_written(spark):
    s = store(spark)
    s.build(frame(spark, series()), 0, 239 * HOUR)
    before = {(r.symbol, r.day): r.build for r in s.partitions().collect()}
    s.build(frame(spark, [r for r in series(shift=9.0) if r[0] == "AAA"]), 24 * HOUR, 30 * HOUR)
    after = {(r.symbol, r.day): r.build for r in s.partitions().collect()}
    # The day itself and the 96 rows after it, that is four days more.
    assert {k for k in after if after[k] != before[k]} == {("AAA", d) for d in (1, 2, 3, 4, 5)}
    new = {r.ts // HOUR: r["values"][0] for r in s.read(0, 40 * HOUR, ["AAA"]).collect()}
    assert min(new[k] for k in range(24, 31)) > 7 and max(v for k, v in new.items() if not 24 <= k <= 30) < 2 and sorted(new) == list(range(41))
    assert s.dead_builds() == []


def test_what_is_not_published_is_not_there(spark, monkeypatch):
    s = store(spark)
    assert s.manifest() is None and s.read().count() == 0 and s.report().count() == 0
    s.build(frame(spark, series(100)), 0, 99 * HOUR)
    seen = content(s)

    def die(told):
        raise RuntimeError("killed")

    monkeypatch.setattr(s, "_publish", die)
    with pytest.raises(RuntimeError):
        s.build(frame(spark, series(shift=1.0)), 0, 239 * HOUR)
    monkeypatch.undo()
    assert content(s) == seen and s.manifest()["version"] == 1 and len(s.dead_builds()) == 1
    # Two builds at once: the second one to publish fails.
    other = store(spark, s.path)
    old = s.manifest()
    monkeypatch.setattr(other, "manifest", lambda: old)
    s.build(frame(spark, series()), 90 * HOUR, 239 * HOUR)
    with pytest.raises(P.PanelError, match="published version 2"):
        other.build(frame(spark, series()), 90 * HOUR, 239 * HOUR)
    assert s.manifest()["version"] == 2 and s.read().count() == 480


def test_gates(spark):
    s = store(spark)
    with pytest.raises(P.PanelError, match="36 rows or fewer"):
        s.build(frame(spark, series(36)), 0, 99 * HOUR)
    with pytest.raises(P.PanelError, match="without rows"):
        s.build(frame(spark, series(50)), 0, 99 * HOUR, symbols=["AAA", "BBB"])
    with pytest.raises(P.PanelError, match="another width"):
        s.build(frame(spark, [("A", k * HOUR, [1.0], [0, 0, 0], 1.0, "") for k in range(50)]), 0, 99 * HOUR)
    with pytest.raises(P.PanelError, match="no row"):
        s.build(frame(spark, [("A", k * HOUR, [1.0, 1.0, 1.0], [0, 0, 0], price, "") for k, price in enumerate([0.0, -1.0, None])]), 0, 99 * HOUR)
    assert s.manifest() is None
    s.build(frame(spark, series(37) + series(37) + [(None, 5, [1.0] * 3, [0] * 3, 1.0, ""), ("AAA", None, [1.0] * 3, [0] * 3, 1.0, "")]), 0, 99 * HOUR)
    assert s.read().count() == 74
    assert s.build(frame(spark, series(50)), 0, 36 * HOUR, symbols=["AAA", "007"], reuse=True)["version"] == 1
    assert s.build(frame(spark, series(50)), 0, 49 * HOUR, symbols=["AAA", "007"], reuse=True)["version"] == 2
    with pytest.raises(P.PanelError, match="contract"):
        store(spark, s.path, lookback=33).manifest()
    with pytest.raises(P.PanelError, match="names of the context"):
        store(spark, s.path, require_context=True)
    with pytest.raises(P.PanelError, match="no names of the context"):
        store(spark, s.path, context=["1h_ret"], require_context=True).manifest()
    with pytest.raises(P.PanelError, match="ahead"):
        store(spark, horizons={"now": 0})


def test_samples(spark):
    s = store(spark, context=["1h_ret", "1h_lag"], require_context=True)
    rows = frame(spark, series(60)).withColumns({"context": F.array(F.lit(0.5), F.lit(1.0)).cast("array<float>"), "context_mask": F.array(F.lit(0), F.lit(1)).cast("array<tinyint>")})
    s.build(rows, 0, 59 * HOUR)
    got = s.samples().where("symbol = '007'").collect()
    assert sorted(r.t_idx for r in got) == list(range(31, 56)) and all(r.label_ts == r.ts + 4 * HOUR for r in got)
    assert s.read().first()["context_mask"] == [0, 1]

"""Clustering, filter audit and decontamination on hard cases, against brute force; the registered queries against SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import queries as Q
from tidegrid.llm.clustering import Lists, cluster_vectors
from tidegrid.llm.decontamination import decontaminate, words_of
from tidegrid.llm.filter_audit import copies, filter_audit

sys.path.insert(0, str(Path(__file__).parents[1]))
SF = "/root/testdata/sf0.001"


def brute_clusters(rows, k, rounds, width, scale):
    """Exact integers, one vector and one centroid at a time."""
    kept = [(i, [math.floor(scale * np.float64(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(by[n]) for x in zip(*by[n])] if n in by else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, m, d in found if m == n) for n in range(k)}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in found), key=repr)


def test_lists():
    r = np.random.default_rng(1)
    for low, high in ((-3, 3), (-1000, 1000)):
        for k, width in ((1, 1), (5, 1), (8, 3), (40, 6)):
            x, c = r.integers(low, high, (300, width)), r.integers(low, high, (k, width))
            c[k // 2 :] = c[: k - k // 2]
            number, distance = Lists(c).nearest(x)
            exact = ((x[:, None] - c) ** 2).sum(2)
            assert (number == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_clusters(spark):
    r = random.Random(2)
    rows = [(i, [r.choice((-1.5, -0.001, 0.0, 0.3, 2.0)) for _ in range(4)]) for i in range(60)]
    rows += [(60, None), (61, []), (62, [1.0, 2.0, 3.0]), (63, [1.0, None, 2.0, 3.0]), (64, [1.0, math.nan, 2.0, 3.0]), (65, [math.inf, 1.0, 1.0, 1.0]), (None, [0.5, 0.5, 0.5, 0.5]), (7, rows[7][1]), (7, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k in (1, 5):
        got = cluster_vectors(df, k=k, rounds=3, width=4)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((tuple(x) for x in got.collect()), key=repr) == brute_clusters(rows, k, 3, 4, 1024)
    few = df.where("vec_id < 3")
    assert sorted((tuple(x) for x in cluster_vectors(few, rounds=2, width=4).collect()), key=repr) == brute_clusters(rows[:3], 8, 2, 4, 1024)
    assert cluster_vectors(df.limit(0)).count() == 0 and cluster_vectors(df, width=9).count() == 0
    with pytest.raises(Exception, match="no squared distance in 64 bits"):
        cluster_vectors(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>"), width=1).count()


def brute_audit(rows, labels):
    parts = {}
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)}
        parts.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, *[any(x[k] == 1 for x in labels if x[0] == i and i is not None) for k in (1, 2)]))
    out = []
    for part, docs in parts.items():
        first = {o: [sum(o[s] in f and not f & set(o[:s]) for f, *_ in docs) for s in range(5)] for o in permutations("ABCDE")}
        for o in first:
            for s, own in enumerate(o):
                now = [(f, g, t) for f, g, t in docs if not f & set(o[:s])]
                gone = [x for x in now if own in x[0]]
                out.append((part, "".join(o), s + 1, len(now) - len(gone), len(gone), sum(own in f for f, *_ in docs) - len(gone), sum(f == {own} for f, *_ in docs), sum(g for _, g, _ in gone), sum(t for *_, t in gone), sum(n[p.index(own)] for p, n in first.items())))
    return sorted(out)


def test_audit(spark):
    r = random.Random(3)
    say = lambda n, some: " ".join(f"w{r.randrange(some)}" for _ in range(n))
    long = say(120, 100_000)
    rows = [(1, long, "en"), (2, long, "de"), (2, long, "de"), (3, long + " ", "en"), (4, None, None), (5, "", ""), (6, " \t\n", "en"), (None, long, "en"), (None, long, None), (7, say(150, 20), "en"), (8, say(99, 10_000).upper(), "en"), (9, "#" + say(100, 10_000), "de"), (9, say(100, 100_000), "de"), (10, say(40_000, 10**9), "fr"), (11, "É" * 9 + "A", "fr"), (12, "word word " * 60, "fr"), (0, "#" + say(5, 9), "fr"), (13, "", "fr")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (7, None, 1), (8, 1, 1), (None, 1, 1), (99, 1, 1), (9, 1, 0)]
    docs = spark.createDataFrame([(*x, 0, 1) for x in rows], "doc_id long, text string, lang string, bits int, n int").repartition(3)
    told = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, lang string")
    got = sorted(tuple(x) for x in filter_audit(docs, told).collect())
    assert got == brute_audit(rows, labels) and len(got) == 600 * 4
    assert filter_audit(docs.limit(0), told).count() == 0
    assert sorted(tuple(x) for x in filter_audit(docs, told.limit(0)).collect()) == brute_audit(rows, [])
    assert sorted(x.doc_id for x in copies(docs.fillna("", "text")).collect()) == [2, 2, 5, 13]


def brute_leaks(docs, items, window):
    cut = [(i or "", w[k : k + window]) for i, t in items for w in (words_of((t or "").encode()),) if w for k in range(max(1, len(w) - window + 1))]
    out = []
    for i, t in docs:
        w = words_of((t or "").encode())
        hit, found = set(), set()
        for item, s in cut:
            for k in range(len(w) - len(s) + 1):
                if w[k : k + len(s)] == s:
                    hit.update(range(k, k + len(s)))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def test_leaks(spark):
    r = random.Random(4)
    say = lambda n, some=6: " ".join(r.choice("abcdefgh"[:some]) for _ in range(n))
    items = [("i1", "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), ("i2", "alpha beta"), ("i3", "ALPHA"), ("i4", ""), ("i5", None), (None, "eins zwei drei"), ("i1", "another text of that id"), ("i6", say(14)), ("i7", say(7, 2)), ("i8", "Straße über größe"), ("i9", "eta theta iota kappa lambda mu nu xi omicron pi rho"), ("i9b", "eta theta iota kappa lambda mu nu xi omicron pi rho")]
    passage = "alpha, beta-gamma (delta) EPSILON zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    docs = [(1, passage), (2, "before " + passage + " after " + passage), (3, None), (4, ""), (5, " . , "), (6, "x " * 30_000 + passage), (7, say(3000)), (8, say(500, 2)), (9, "die straße über größe, STRASSE ÜBER"), (9, "alpha"), (None, "Another text OF that id"), (None, None), (10, "eins zwei"), (11, "eins\x00zwei_drei vier"), (12, "q" * 50_000), (12, "q" * 50_000)]
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, row long, window string").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, shingle long")
    for window, shingle in ((10, 5), (4, 3), (3, 5)):
        got = decontaminate(d, b, window, shingle)
        assert sorted((tuple(x) for x in got.collect()), key=repr) == brute_leaks(docs, items, window)
    assert decontaminate(d.limit(0), b).count() == 0
    none = decontaminate(d, b.limit(0)).agg(F.count("*").alias("n"), F.sum("n_hit").alias("hit")).first()
    assert (none.n, none.hit) == (len(docs), 0)


@pytest.mark.parametrize("name", ["op11_clustering", "op12_filter_audit", "op13_decontamination"])
def test_registered(spark, name):
    from test_queries import rows

    c = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "benchmark"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), c.sql(Q.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)

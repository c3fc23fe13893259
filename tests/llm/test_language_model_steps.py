"""The language model's steps: words are split, counted and looked up in Arrow, and each is read once."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import gru_lm

ODD = [b"", None, b"  A b\tc\n\x0bd \x0c\re ", b" \n", "É x Y".encode(), b"a\x1cb\xc2\x85c", b"\xff\xfe bad \xc3", b"x", b"\x00 \x00a", b"\xc2\xa0a\xe2\x80\x83B", b"one one ONE"]


def test_words_symbols_and_ends():
    raw = pa.array(ODD, pa.binary())
    column = pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())
    for some, odd in ((column, ODD), (column.slice(2, 5), ODD[2:7]), (column.slice(0, 2), ODD[:2])):
        want = [(x or b"").lower().split() for x in odd]
        words, sizes = gru_lm.words_of(some)
        assert (words.to_pylist(), sizes.tolist()) == (sum(want, []), [len(x) for x in want])
        assert gru_lm.tail_classes(words).tolist() == [gru_lm.tail_class(x) for x in sum(want, [])]
        ids, starts = gru_lm.Symbols([gru_lm.END, b"one", b"x"]).of([some])
        head = {b"one": 1, b"x": 2}
        assert ids.tolist() == [k for ws in want for k in [*(head.get(w, gru_lm.HEAD + gru_lm.tail_class(w)) for w in ws), 0]]
        assert starts.tolist() == [int(k == 0) for ws in want for k in range(len(ws) + 1)]


def test_streams_end_with_the_text_that_fills_them():
    rng = np.random.default_rng(2)
    texts = ["x" * int(n) if n else None for n in rng.integers(0, 40, 300)]
    want, kept, size = [], [], 0
    for x in texts:
        kept.append(x)
        size += len(x or "")
        if size > 100:
            want.append(kept)
            kept, size = [], 0
    columns = [pa.array(texts[a:b], pa.string()) for a, b in ((0, 7), (7, 7), (7, 190), (190, 300))]
    got = [[x for piece in some for x in piece.to_pylist()] for some in gru_lm._streams(iter(columns), 100)]
    assert got == want + [kept] * bool(kept)


def test_words_are_totalled_by_one_sort(spark, monkeypatch):
    texts = ["a b b", "b c", None, "", "A d\nd", "c c"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    plans, keep = [], gru_lm.checkpointed
    monkeypatch.setattr(gru_lm, "checkpointed", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or keep(d))
    monkeypatch.setattr(gru_lm, "_HELD", 1)
    rows = gru_lm.word_counts(df, F.col("doc_id") != 4, 3).collect()
    assert not any("Join" in p for p in plans) and all(p.count("Exchange") == 1 for p in plans)
    words = [[w.encode() for w in (x or "").lower().split()] + [gru_lm.END] for x in texts]
    total = Counter(w for k, ws in enumerate(words) if k != 4 for w in ws)
    assert {(bytes(r.word), r.n) for r in rows} == {(w, total[w]) for ws in words for w in ws}
    assert Counter(bytes(r.word) for r in rows if r.first) == Counter({w for ws in words for w in ws})


@pytest.mark.parametrize("size", [0.3, 30])
def test_class_probabilities_of_many_words(size):
    """More words than are worked out at once; with large weights the greatest term is taken off first."""
    rng = np.random.default_rng(3)
    model = gru_lm.Gru.new(np.arange(1100, 1100 - gru_lm.HEAD, -1.0), np.ones(gru_lm.TAILS))
    for k in ("v", "w"):
        model.p[k][:] = rng.standard_normal(model.p[k].shape) * size
    n, groups = 3 * gru_lm._SOME + 7, gru_lm.HEAD // gru_lm.MEMBERS
    h, y = rng.uniform(-1, 1, (n, gru_lm.STATE)).astype(np.float32), rng.integers(0, gru_lm.HEAD + gru_lm.TAILS, n)
    p = {k: x.astype(np.float64) for k, x in model.p.items()}

    def log_softmax(e):
        e = e - e.max(1, keepdims=True)
        return e - np.log(np.exp(e).sum(1, keepdims=True))

    each, group = np.arange(n), np.where(y < gru_lm.HEAD, y // gru_lm.MEMBERS, y - gru_lm.HEAD + groups)
    want = log_softmax(h @ p["v"].T + p["vb"])[each, group]
    for k in np.flatnonzero(y < gru_lm.HEAD):
        g, m = divmod(y[k], gru_lm.MEMBERS)
        want[k] += log_softmax((p["w"][g] @ h[k] + p["wb"][g])[None])[0, m]
    assert model.log_p(h, y) == pytest.approx(want, rel=1e-4, abs=1e-3)

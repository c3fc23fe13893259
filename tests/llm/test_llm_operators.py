"""The ten operators on a small table of hard cases, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm import bpe, gru_lm, language_id, near_dedup, pii, quality, shards, suffix_dedup
from tidegrid.llm.common import remainder
from tidegrid.llm.exact_dedup import exact_dedup
from tidegrid.llm.graph import connected_components
from tidegrid.llm.packing import SEGMENTS, pack_documents, pack_examples

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "words", "and", "some", "more"]) for _ in range(n))


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def check_pieces(rows, want, capacity, segments):
    """Every id in one piece, sequences gapless and within their limits; returns padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_seq[r.sequence_id].append(r)
    total = Counter()
    for doc_id, ids in want:
        total[doc_id, len(ids)] += 1
    for doc_id, ids in want:
        pieces = sorted(by_doc[doc_id, len(ids)], key=lambda r: r.start)
        copies = total[doc_id, len(ids)]
        assert sum(r.length for r in pieces) == len(ids) * copies
        for r in pieces:
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length]
    pad = 0
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        at = 0
        for r in seq:
            assert r.offset == at
            at += r.length
        assert at <= capacity and len(seq) <= segments
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad


def test_packing(docs):
    t = tokenizer(WORD_BPE)
    want = [(d, t.encode(x, add_special_tokens=False).ids + [2]) for d, x in texts(docs)]
    rows = pack_documents(docs, WORD_BPE, capacity=256, loss=250, segments=8, pool=8).collect()
    check_pieces(rows, want, 256, 8)
    per = Counter()
    for r in rows:
        per[r.sequence_id] += r.loss_tokens
    assert max(per.values()) <= 250
    assert check_pieces(pack_documents(docs, WORD_BPE).collect(), want, 4096, 512) == 0
    assert pack_documents(docs.limit(0), WORD_BPE).count() == 0


def test_packing_of_many_tiny_texts_leaves_no_padding(spark):
    t = tokenizer(WORD_BPE)
    rows = [(i, "word" * (i % 2)) for i in range(700)] + [(700 + i, prose(i, 900)) for i in range(3)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), WORD_BPE).collect()
    per = Counter(r.sequence_id for r in got)
    assert max(per.values()) == SEGMENTS  # the limit binds
    assert check_pieces(got, [(i, t.encode(x, add_special_tokens=False).ids + [2]) for i, x in rows], 4096, SEGMENTS) == 0


def test_packing_words_that_are_no_words(docs, spark):
    odd = ["<|startoftext|>x <|endoftext|>", "don't I'LL", "Áb ́", "x\x1cy\x1fz", "Σας ΣΑΣ İ", "日本語 ２", "a b c", "...,,,!!", "Ünï.", "\x85"]
    t = tokenizer(WORD_BPE)
    rows = pack_documents(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), WORD_BPE).collect()
    check_pieces(rows, [(i, t.encode(x, add_special_tokens=False).ids + [2]) for i, x in enumerate(odd)], 4096, 512)


def test_packing_instructions(spark):
    r = random.Random(1)
    rows = [(i, [r.randrange(99) for _ in range(r.randrange(1, 60))]) for i in range(80)] + [(99, None), (98, [])]
    df = spark.createDataFrame([(i, ids, None if ids is None or i % 5 == 0 else [k % 3 == 0 for k in range(len(ids))]) for i, ids in rows], "doc_id long, ids array<int>, bears_loss array<boolean>")
    got = pack_examples(df, capacity=64, segments=4, loss=30).collect()
    check_pieces(got, [(i, ids) for i, ids in rows if ids], 64, 4)
    per = Counter()
    for x in got:
        per[x.sequence_id] += x.loss_tokens
    assert max(per.values()) <= 30


def test_language_model(docs):
    learn = remainder("doc_id", 7) != 2
    rows = {(r.doc_id, r.n_tokens): r for r in gru_lm.score_texts(docs, learn).collect()}
    words = [(d, x.encode().lower().split() + [b"\n"]) for d, x in texts(docs)]
    counts = Counter(w for d, ws in words if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in words:
        r = rows[d, len(ws)]
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert (r.n_known, r.train_tokens) == (sum(counts[w] > 0 for w in ws), n)
        assert -1e6 < r.score < 0
    assert gru_lm.score_texts(docs.limit(0), learn).count() == 0


def test_language_model_gradient_and_lanes():
    rng = np.random.default_rng(0)
    g = gru_lm.Gru(gru_lm.Gru.new(np.arange(1100, 1100 - gru_lm.HEAD, -1.0), np.ones(gru_lm.TAILS)).flat.astype(np.float64))
    n = gru_lm.HEAD + gru_lm.TAILS
    x, y, keep, h = rng.integers(0, n, (5, 4)), rng.integers(0, n, (5, 4)), (rng.random((5, 4)) > 0.3).astype(float), rng.standard_normal((4, gru_lm.STATE))
    _, grad, _ = g.gradient(x, y, keep, h)
    for j in np.argsort(-np.abs(grad))[:: len(grad) // 40][:12]:
        held = g.flat[j]
        sides = []
        for e in (1e-2, -1e-2):
            g.flat[j] = held + e
            sides.append(g.gradient(x, y, keep, h)[0])
        g.flat[j] = held
        assert (sides[0] - sides[1]) / 2e-2 == pytest.approx(grad[j], abs=1e-3)
    sizes = rng.integers(1, 70, 30)
    y, ends = rng.integers(0, n, sizes.sum()).astype(np.int32), np.cumsum(sizes)
    model = gru_lm.Gru(g.flat.astype(np.float32))
    alone = [gru_lm.score_documents(model, y[e - s : e], np.array([s]))[0] for e, s in zip(ends, sizes)]
    assert gru_lm.score_documents(model, y, sizes, 7) == pytest.approx(alone, abs=1e-3)
    # Probabilities of all symbols after one state sum to one.
    one = np.repeat(rng.standard_normal((1, gru_lm.STATE)).astype(np.float32), n, 0)
    assert np.exp(model.log_p(one, np.arange(n))).sum() == pytest.approx(1, abs=1e-3)


def test_language_model_beats_unigrams_on_order(spark):
    rows = [(i, " ".join(("red", "fish", "swims")[k % 3] for k in range(60))) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = gru_lm.score_texts(df, F.col("doc_id") % 5 != 0).where("doc_id % 5 = 0").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]


def test_language_model_has_weights_for_a_thousand_words(spark):
    words = [f"w{k}" for k in range(1000)]
    df = spark.createDataFrame([(k, " ".join(words[k * 10 :] + words[: k * 10])) for k in range(20)], "doc_id long, text string")
    counts = gru_lm.word_counts(df, F.lit(True), 1)
    model = gru_lm.fit_language_model(df, F.lit(True), counts, rounds=1)
    assert {w.encode() for w in words} <= set(model.head)
    assert gru_lm.TAILS >= 32 and gru_lm.STATE >= 16


def test_bpe(docs, spark):
    t = tokenizer(BYTE_BPE)
    r = random.Random(2)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "日本", "\x1c", " ", "'s", "'re", "123", "!", "😀", "<|endoftext|>", "<|endo", "aaaa", "\r\n", "\x85", "²", "_"]
    fuzz = [(1000 + i, "".join(r.choice(bits) for _ in range(r.randrange(40)))) for i in range(400)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(fuzz, "doc_id long, text string"))
    got = bpe.bpe_decode(bpe.bpe_encode(df, BYTE_BPE), BYTE_BPE).collect()
    pairs = Counter((x.doc_id, tuple(x.ids), x.decoded) for x in got)
    want = Counter()
    for d, x in texts(df):
        ids = t.encode(x, add_special_tokens=False).ids
        want[d, tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
    assert pairs == want
    assert Counter((x.doc_id, tuple(x.ids), x.decoded) for x in bpe.bpe_round_trip(df, BYTE_BPE).collect()) == want
    assert bpe.bpe_round_trip(df.limit(0), BYTE_BPE).count() == 0
    odd = bpe.bpe_decode(spark.createDataFrame([(1, [10**6]), (2, None), (3, [255 - 188])], "doc_id long, ids array<int>"), BYTE_BPE)
    assert {x.doc_id: x.decoded for x in odd.collect()}.keys() == {1, 2, 3}


def brute_components(rows, k, percent):
    sets = {}
    for d, x in rows:
        w = x.encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("k, s", [(3, 0.85), (5, 0.8)])
def test_near_dedup(docs, spark, k, s):
    r = random.Random(3)
    base = " ".join(str(r.randrange(1000)) for _ in range(120)).split()
    chain = []
    for i in range(40):  # a chain and a star of near copies: few of them are similar to each other directly
        words = list(base)
        for _ in range(1 + i % 7):
            words[r.randrange(len(words))] = f"w{r.randrange(9999)}"
        chain.append((500 + i, " ".join(words)))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(chain, "doc_id long, text string"))
    want = brute_components(texts(df), k, round(100 * s))
    got = near_dedup.near_duplicates(df, k, s).collect()
    assert len(got) == df.count()
    for x in got:
        assert (x.n_shingles, x.component_id, x.kept) == (*want[x.doc_id], want[x.doc_id][1] == x.doc_id)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_min_max_is_unbiased():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.concatenate([a[:700], np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))])
    m = near_dedup.MinMax(0.5)
    same = [np.mean(x[0] == x[1]) for x in m.extremes([a, b])]
    assert np.mean(same) == pytest.approx(700 / 1100, abs=0.06)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 1), (8, 1), (13, 1), (14, 1), (20, 1), (21, 1), (9, 0), (None, 1), (11, None)], "doc_id long, quality int")
    got = quality.judge_quality(docs, labels).collect()
    assert len(got) == docs.count()
    text = dict(texts(docs))
    for r in got:
        w = re.findall("[^\x20\x09-\x0d]+", text[r.doc_id])
        n = Counter(zip(w, w[1:], w[2:]))
        again = {i + j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text[r.doc_id].split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text[r.doc_id])), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert all(r.kept for r in got if r.doc_id in (1, 20, 21))
    assert quality.judge_quality(docs.limit(0), labels.limit(0)).count() == 0


def test_forest_finds_what_is_unlike():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (600, 5)), rng.normal(0, 1, (60, 5)) + [9, 0, 0, 0, 0]]).astype(np.float32)
    good = np.arange(660) < 600
    f = quality.IsolationForest.grow(x, good)
    limit = quality.calibrate(f.score(x), good)
    assert (f.score(x[600:]) > limit).mean() > 0.9 and (f.score(x[:600]) > limit).mean() < 0.01
    assert quality.calibrate(np.ones(3), np.ones(3, bool)) == 1.0


def test_pii(docs, spark):
    t = "x 1.2.3.4 y 300.1.1.1 z +49 30 1234567 q a.b@c.de. 4111-1111-1111-1111, 4111111111111112 @ a@b @@c.d@e.f"
    got = [(k, t[a:b]) for a, b, k in pii.base_spans(t)]
    assert got == [("ip", "1.2.3.4"), ("phone", "+49 30 1234567"), ("email", "a.b@c.de"), ("card", "4111-1111-1111-1111"), ("email", "c.d@e.f")]
    r = random.Random(4)
    for _ in range(3000):
        s = "".join(r.choice("ab@.-+ é1") for _ in range(r.randrange(25)))
        assert [m.span() for m in pii.PATTERNS["email"].finditer(s)] == [m.span() for m in pii._emails(s)]
    tagger = pii.fit_tagger(docs)
    rows = {x.doc_id: x for x in pii.find_pii(docs, tagger).select("doc_id", "text", "pii").collect()}
    assert {s.kind for s in rows[11].pii.base} == set(pii.KINDS) and "<EMAIL>" in rows[11].pii.masked
    assert rows[5].pii.masked is None and rows[6].pii.spans == [] and rows[1].pii.masked == rows[1].text
    assert pii.fit_tagger(docs.limit(0)) is None
    assert pii.find_pii(docs.limit(0), None).count() == 0


def test_tagger_learns_spans_and_its_gradient_is_right():
    rng = np.random.default_rng(0)
    t = pii.Tagger({k: v.astype(np.float64) for k, v in pii.Tagger.new().p.items()})
    x, tags, mask = rng.integers(0, 128, (3, 9)), rng.integers(0, 5, (3, 9)), np.ones((3, 9), bool)
    mask[1, 6:], tags[1, 6:] = False, 0
    _, g = t.gradient(x, tags, mask)
    for k in t.p:
        i = (x[0, 0], 2) if k == "embed" else tuple(0 for _ in t.p[k].shape)
        held, sides = t.p[k][i], []
        for e in (1e-4, -1e-4):
            t.p[k][i] = held + e
            sides.append(t.gradient(x, tags, mask)[0])
        t.p[k][i] = held
        assert (sides[0] - sides[1]) / 2e-4 == pytest.approx(float(g[k][i]), abs=1e-4)
    r = random.Random(1)
    make = lambda: f"some words here jo{r.randrange(99)}@mail{r.randrange(9)}.example.com and then 10.{r.randrange(255)}.0.{r.randrange(255)} with more words"
    tagger = pii.Tagger.new()
    tagger.train(*pii.training_set([make() for _ in range(150)]), passes=10)
    held_out = [make() for _ in range(30)]
    hits = sum(len(set(m) & set(pii.base_spans(s))) for m, s in zip(pii.model_spans(tagger, held_out), held_out))
    assert hits >= 50


def test_tagger_adds_secrets_and_disguised_data():
    r = random.Random(4)
    hexed = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    make = lambda: f"some words here jo{r.randrange(99)}@mail{r.randrange(9)}.example.com and then 10.{r.randrange(255)}.0.{r.randrange(255)} with token = \"{hexed()}\" or +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)} in it and the year 20{r.randrange(10, 30)}"
    tagger = pii.Tagger.new()
    tagger.train(*pii.training_set([make() for _ in range(200)]), passes=8)
    rng, wanted, hit = np.random.default_rng(1), 0, 0
    for _ in range(30):
        text, spans = pii.disguised(make(), rng)
        got = pii.find_spans(tagger, [text])[0][1]
        wanted += len(spans)
        hit += len(set(got) & set(spans))
    assert hit >= 0.8 * wanted
    # Clean text with numbers stays clean, and added spans never touch base ones.
    assert pii.find_spans(tagger, ["the year 2021 and version 2.0 of 17 words, some of them here"])[0] == ([], [])


def test_tagger_is_fitted_on_stretches_of_each_kind(docs, spark):
    assert pii.fit_tagger(docs) is not None
    assert pii.fit_tagger(docs.where("doc_id = 12")) is None and pii.fit_tagger(docs.limit(0)) is None


def test_shards(docs, tmp_path):
    pieces = pack_documents(docs, WORD_BPE, capacity=128)
    rows = shards.sequences(pieces, 128, 2)
    folder = f"file://{tmp_path}/out"
    got = shards.write_shards(rows, folder, key=7, per_shard=16).collect()
    n = len(got)
    assert sorted(r.slot for r in got) == list(range(n))
    want = {r.sequence_id: np.frombuffer(r.ids, "<u2").tolist() for r in rows.collect()}
    by_slot = {r.slot: r.sequence_id for r in got}
    for start in (0, 5, 17, n - 1):
        read = [x.tolist() for x in shards.read_from(folder, start, 256, 16)]
        assert read == [want[by_slot[s]] for s in range(start, n)]
    with pytest.raises(ValueError):
        next(shards.read_from(folder, 0, 128))
    assert {r.sequence_id: (r.n_tokens, r.doc_ids, r.ids) for r in shards.packed_sequences(docs, WORD_BPE, capacity=128).collect()} == {r.sequence_id: (r.n_tokens, r.doc_ids, r.ids) for r in rows.collect()}
    assert shards.write_shards(rows.limit(0), f"file://{tmp_path}/none").count() == 0
    assert list(shards.read_from(f"file://{tmp_path}/none", 0)) == []
    for size in (1, 2, 3, 100, 1025):
        assert sorted(shards.feistel(np.arange(size), size, 3).tolist()) == list(range(size))


def test_one_common_line_between_different_neighbours(spark):
    """A very common string with many continuations: its rank is shared, its pairs are not."""
    r = random.Random(8)
    line = "".join(r.choice("abcdefgh ") for _ in range(120))
    other = lambda n: "".join(r.choice("ijklmnop ") for _ in range(n))
    rows = [(k, other(90 + k) + line + other(150) + line + other(40)) for k in range(60)]
    rows += [(100, other(300) + line + other(300)), (101, "x" * 50 + rows[3][1][40:280]), (102, other(30) + rows[5][1][10:260] + other(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter(x.encode()[i : i + 200] for _, x in rows for i in range(len(x) - 199))
    for row in suffix_dedup.remove_repeats(df).collect():
        raw = dict(rows)[row.doc_id].encode()
        gone = {j for i in range(len(raw) - 199) if counts[raw[i : i + 200]] > 1 for j in range(i, i + 200)}
        assert row.n_removed == len(gone)


def test_repeated_passages(docs, spark):
    r = random.Random(6)
    letters = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    shared = letters(260)
    more = [(700, letters(150) + shared + letters(90)), (701, letters(33) + shared + letters(400)), (702, shared[:199] + letters(300)), (703, letters(70) * 6), (704, shared[30:235] + letters(10)), (705, "z" * 199), (706, "q" * 201)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    raws = [(d, x.encode()) for d, x in texts(df)]
    counts = Counter(raw[i : i + 200] for _, raw in raws for i in range(len(raw) - 199))
    want = Counter()
    for d, raw in raws:
        covered = np.zeros(len(raw), bool)
        for i in range(len(raw) - 199):
            if counts[raw[i : i + 200]] > 1:
                covered[i : i + 200] = True
        left = np.frombuffer(raw, np.uint8)[~covered].tobytes()
        spans = int((np.diff(covered.astype(int), prepend=0) == 1).sum())
        want[d, len(raw), int(covered.sum()), spans, hashlib.sha256(left).hexdigest()] += 1
    got = suffix_dedup.remove_repeats(df).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_exact_dedup(docs, spark):
    df = docs.repartition(20)  # more leaves than one round merges
    groups = defaultdict(list)
    for d, x in texts(df):
        groups[re.sub("[\x20\x09-\x0d]", "", x)].append((-len(x), d))
    got = exact_dedup(df).collect()
    assert len(got) == df.count()
    text = dict(texts(df))
    for r in got:
        bare = re.sub("[\x20\x09-\x0d]", "", text[r.doc_id])
        keep = min(groups[bare])[1]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(groups[bare]), keep == r.doc_id, hashlib.sha256(bare.encode()).hexdigest())
    assert exact_dedup(docs.limit(0)).count() == 0


def test_small_share_of_a_long_text_stays():
    words = {k: [f"{k * 2}{c}{d}" for c in "xyz" for d in "pqr"] for k in "abc"}
    counts = np.array([np.bincount(language_id.trigrams(" ".join(w * 50)), minlength=language_id.BUCKETS) for w in words.values()]) + language_id.ALPHA
    model = language_id.LanguageModel(list(words), np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))
    text = " ".join((words["a"] * 110 + words["b"])[:1000] * 20)
    best, share, langs = language_id.infer(model, text)
    assert best == "a" and share < 0.995 and langs == ["a", "b"]


def test_language_id(docs):
    model = language_id.fit_languages(docs)
    assert model.langs == ["de", "en"]
    rows = {r.doc_id: r.language for r in language_id.identify(docs, model).select("doc_id", "language").collect()}
    assert rows[1].lang_pred == "en" and rows[12].lang_pred == "de" and rows[5].lang_pred == rows[6].lang_pred == rows[7].lang_pred == rows[10].lang_pred == "und"
    assert all(0 <= x.score <= 1 for x in rows.values())
    english, german = (" ".join(dict(texts(docs))[d] for d in ids) for ids in ((20, 21, 22), (40, 41, 42, 43, 44, 45)))
    best, share, langs = language_id.infer(model, english[: len(german)] + " " + german)
    assert set(langs) == {"de", "en"} and 0.3 < share < 0.8
    none = language_id.fit_languages(docs.limit(0))
    assert language_id.infer(none, "text") == ("und", 0.0, [])

"""The registered queries on the whole smallest tables, against brute force by the plainest means."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_llm_operators import brute_components, tokenizer

from tidegrid.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    """doc_id, text, lang of all documents."""
    return duckdb.sql(f"SELECT doc_id, coalesce(text, ''), lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


def test_op1(spark, table):
    t = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: t.encode(x, add_special_tokens=False).ids + [2] for d, x, _ in table}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in Q.op1_packing(spark, SF).collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[d]))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_op2(spark, table):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in table}
    said = {d: [w.lower() for w in words(x)] + [b"\n"] for d, x, _ in table}
    counts = Counter(w for d, ws in said.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = Q.op2_lm_scoring(spark, SF).collect()
    assert len(rows) == len(table)
    for r in rows:
        ws = said[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert math.isfinite(r.score) and r.score < 0
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_op3(spark, table):
    t = tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, x, _ in table:
        ids = t.encode(x, add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op3_bpe(spark, SF).collect()} == want


def test_op4(spark, table):
    want = brute_components([(d, x) for d, x, _ in table], 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q.op4_minhash(spark, SF).collect()} == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_op5(spark, table):
    rows = {r.doc_id: r for r in Q.op5_quality_rules(spark, SF).collect()}
    assert len(rows) == len(table)
    for d, x, _ in table:
        ws = [w.decode() for w in words(x)]
        threes = Counter(zip(ws, ws[1:], ws[2:]))
        repeated = {j for i in range(len(ws) - 2) if threes[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines, seen, dup = x.split("\n"), set(), 0
        for line in lines:
            if words(line):
                dup += line in seen
                seen.add(line)
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(repeated))
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def plain_spans(text):
    found = []
    for k, (kind, pattern) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and luhn) or (kind == "phone" and 9 <= len(digits) <= 15):
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}", kind))
    return sorted(found)


def test_op6(spark, table):
    added = secrets = named = 0
    for r in Q.op6_pii(spark, SF).collect():
        text = dict((d, x) for d, x, _ in table)[r.doc_id]
        base = plain_spans(text)
        kinds = Counter(s[3] for s in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(s[2] for s in base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(s[2] for s in base) <= set(spans) and r.n_spans == len(spans)
        added += len(spans) - len(base)
        secret = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r"token = \"([0-9a-f]{40})\"", text)}
        named += len(secret)
        secrets += len(secret & set(spans))
    assert secrets >= 0.8 * named and added >= secrets


def test_op7(spark, table):
    rows = Q.op7_token_shards(spark, SF).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    t = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter({d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x, _ in table})
    assert sum(r.n_tokens for r in rows) == sum(want.values()) and {d for r in rows for d in r.doc_ids} == set(want)


def test_op8(spark, table):
    counts = Counter(x.encode()[i : i + 200] for _, x, _ in table for i in range(len(x.encode()) - 199))
    rows = {r.doc_id: r for r in Q.op8_suffix_dedup(spark, SF).collect()}
    assert len(rows) == len(table)
    for d, x, _ in table:
        raw = x.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 199):
            if counts[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(b and not a for a, b in pairwise([False, *gone.tolist()]))
        assert (rows[d].n_bytes, rows[d].n_removed, rows[d].n_spans, rows[d].kept_sha256) == (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_op10(spark, table):
    truth = {d: (lang, bool(re.search(r"[^\W\d_]", x))) for d, x, lang in table}
    right = judged = 0
    for r in Q.op10_language_id(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        lang, letters = truth[r.doc_id]
        if not letters:
            assert r.lang_pred == "und"
        elif r.held_out and lang:
            judged += 1
            right += r.lang_pred == lang
    assert judged >= 20 and right >= 0.95 * judged

"""Texts of one run of characters, and rows without an id, through every operator: linear, whole and in time."""

from __future__ import annotations

import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import bpe, decontamination, exact_dedup, filter_audit, gru_lm, language_id, near_dedup, packing, pii, quality, suffix_dedup
from tidegrid.llm.common import remainder

DIGITS, LETTERS = 1_000_000, 200_000


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    r = random.Random(1)
    prose = " ".join(r.choice(["the", "of", "und", "mail", "der"]) for _ in range(300))
    rows = [(1, "".join(r.choice("0123456789") for _ in range(DIGITS)), "en"), (2, "".join(r.choice("etaoinshrdlu") for _ in range(LETTERS)), "en"), (3, prose, "en"), (None, prose, "de"), (None, None, None), (5, prose + ' token = "' + "0a1b2c3d" * 100 + '"', "de")]
    path = str(tmp_path_factory.mktemp("runs") / "d")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")}).write.parquet(path)
    return spark.read.parquet(path)


def operators(docs):
    spark = docs.sparkSession
    labels = spark.createDataFrame([(3, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    items = docs.where("doc_id = 3").select(F.lit("i").alias("item_id"), "text")
    words, byte = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
    yield "packing", lambda: packing.pack_documents(docs, words)
    yield "lm", lambda: gru_lm.score_texts(docs, remainder("doc_id", 7) != 2)
    yield "bpe", lambda: bpe.bpe_round_trip(docs, byte)
    yield "near", lambda: near_dedup.near_duplicates(docs)
    yield "quality", lambda: quality.judge_quality(docs, labels)
    yield "pii", lambda: pii.find_pii(docs, pii.fit_tagger(docs))
    yield "suffix", lambda: suffix_dedup.remove_repeats(docs)
    yield "exact", lambda: exact_dedup.exact_dedup(docs)
    yield "language", lambda: language_id.identify(docs, language_id.fit_languages(docs))
    yield "audit", lambda: filter_audit.filter_audit(docs, labels)
    yield "leaks", lambda: decontamination.decontaminate(docs, items)


def test_every_operator_ends(runs):
    for name, make in operators(runs):
        began = time.time()
        rows = make().count()
        assert rows >= (6 if name != "audit" else 1800), name
        assert time.time() - began < 150, name


def test_rows_without_an_id_stay(runs):
    for name, make in operators(runs):
        if name not in ("audit", "packing"):
            assert make().where("doc_id IS NULL").count() == 2, name


def test_base_spans_are_linear():
    for text in ("7" * 1_000_000, "1." * 300_000, "1.2." * 200_000, "@" * 500_000, "a" * 1_000_000, "+1 " * 200_000, "0" * 6000 + "1.2.3.4"):
        began = time.time()
        pii.base_spans(text)
        assert time.time() - began < 10, text[:8]
    assert pii.base_spans("x" + "0" * 6000 + "1.2.3.255.9") == [(1, 6010, "ip")]
    assert [s for s in pii.base_spans("1.2.3.256 1.2.3.4.5.6.7.8")] == [(10, 17, "ip"), (18, 25, "ip")]


def test_secrets_are_whole_and_once():
    text = "x" * 20 + "0a1b2c3d" * 500 + "y" * 20
    assert pii.trimmed(text, 300, 330, "secret") == (0, len(text))
    assert pii.runs_of(0, 5000)[0][2] == 0 and pii.runs_of(0, 5000)[-1][3] == 5000
    counted = [k for a, b, s, e in pii.runs_of(7, 9000) for k in range(s, e)]
    assert counted == list(range(7, 9000))


def test_long_pieces_encode_alone_like_together():
    vocab = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(2)
    pieces = [bytes(r.choice(b"etaoin0123= ") for _ in range(n)) for n in (1, 2, 7, 300, 1500)] + [b"a" * 700, b"\xff\x00" * 50]
    for piece in pieces:
        assert vocab._encode_long(piece).tolist() == vocab._encode([piece])[0].tolist()

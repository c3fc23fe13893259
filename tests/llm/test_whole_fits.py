"""What the findings of round 3 showed of the training-data operators, on small rows."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm import bpe, packing, quality


def test_f6_the_forest_and_its_limit_come_from_all_labelled_rows(spark):
    n, width = 22_000, len(quality.RATES)
    rates = F.array(*(((F.xxhash64("id", F.lit(k)) % 1000) / 1000 + F.when(F.col("id") % 10 == 0, k % 3).otherwise(0)).cast("float") for k in range(width)))
    counted = spark.range(0, n, 1, 5).select(F.col("id").alias("doc_id"), rates.alias("rates"))
    forest = quality.fit_forest(counted, counted.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("quality")))
    rows = counted.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3).toPandas()
    x, good, held = np.stack(rows["rates"].to_numpy()).astype(np.float32), rows["doc_id"].to_numpy() % 10 != 0, rows["held"].to_numpy()
    whole = quality.IsolationForest.grow(x[~held], good[~held])
    assert (forest.feature == whole.feature).all() and (forest.cut == whole.cut).all() and (forest.path == whole.path).all()
    scores = whole.score(x[held])
    assert forest.limit == quality.calibrate((np.ceil(scores * quality.LIMITS) - 0.5) / quality.LIMITS, good[held]) < 1
    assert (scores > forest.limit)[~good[held]].mean() > 0.9 and (scores > forest.limit)[good[held]].mean() < 0.01


def test_op1_op7_each_distinct_word_of_a_slice_is_looked_up_once():
    r = random.Random(5)
    parts = ["One", "one.", "ONE,", "Été", "été", "Straße", "x1", "a\x1cb", "ÿ×÷", " ", "<|endoftext|>", "it's", "é" * 12, "é" * 13, "w" * 24, "w" * 25 + ".", ".,", "中", "\x0b", " ", "\n", "ý"]
    texts = [None, "", " \t", *("".join(r.choice(parts) + r.choice(["", " ", "  "]) for _ in range(r.randrange(1, 30))) for _ in range(500))]
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, seen = packing.WordCoder(path, 1000), []
    lookup = coder.runs.lookup
    coder.runs.lookup = lambda words, times: seen.append(words) or lookup(words, times)
    n, ids = coder.batch(pa.array(texts))
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert len(seen) == 1 and len(seen[0]) == len(set(seen[0])) and "one" in seen[0]


def test_words_are_told_apart_by_all_their_keys():
    keys = [np.array(k, np.uint64) for k in ([5, 7, 5, 7], [1, 0, 1, 0], [0, 0, 0, 1])]
    order, new = packing._equal_words(keys)
    groups = sorted(tuple(sorted(x.tolist())) for x in np.split(order, new[1:]))
    assert groups == [(0, 2), (1,), (3,)]


def test_op3_a_word_is_encoded_once_whatever_stands_behind_it(monkeypatch):
    path, seen = public_tokenizers.path("byte_bpe_50k.json"), []
    encode = bpe.Vocabulary.encode
    monkeypatch.setattr(bpe.Vocabulary, "encode", lambda self, pieces: seen.extend(pieces) or encode(self, pieces))
    coder = bpe.coder.__wrapped__(path)
    texts = ["a word", "a word.", "word, word) don't. <|endoftext|>word!", " ?! x. ,"]
    got = [coder.batch([x])[1].tolist() for x in texts]
    assert got == [Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids for x in texts]
    assert len(seen) == len(set(seen)) and b" word" in seen

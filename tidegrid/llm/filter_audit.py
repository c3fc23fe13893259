"""How filters interact: what each removes in every order, and what it alone would have caught.

Five filters judge a document: A to D by its own text, E by the table, as a copy of a smaller doc_id. E is an existential
self-join: a left semi join on hash, exact text and smaller doc_id. The texts that it compares are only those whose hash
several ids have, and of each such text the right side holds its smallest doc_id alone, so that a group of copies meets
one row. The failing ids of E are joined by union with those of the other filters, and all that is left of a document is
its combination of failures, a number of five bits. Every order of the filters is then answered from at most 32 counts
for each part of the table.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: The filters, each with its bit.
FILTERS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
#: A: words at least; B: percent of words that are distinct, at least; C: percent of characters that are capitals, at most; D: characters that fail.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"


def own_failures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column bits, the failures of A to D of a text that isn't null."""
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    with_words = docs.withColumn("bits", words)
    n = F.size("bits")
    fails: dict[str, Column] = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct("bits")) < LEAST_DISTINCT * n,
        "C": 100 * F.regexp_count(F.col(text), F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        "D": F.col(text).rlike(SYMBOLS),
    }
    return with_words.withColumn("bits", sum((F.when(fail, FILTERS[f]).otherwise(0) for f, fail in fails.items()), F.lit(0)))


def copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose text a smaller doc_id has as well, with all their columns and hash.

    Rows without a doc_id are neither smaller nor larger than any. Rows of one doc_id aren't copies of each other.
    """
    named = docs.withColumn("hash", F.xxhash64(text))
    ids = named.groupBy("hash").agg(F.min(doc_id).alias("low"), F.max(doc_id).alias("high"))
    shared = checkpointed(ids.where("low < high").select("hash"))
    suspects = checkpointed(named.join(shared, "hash", "left_semi"))
    # One row of each text: the existence of a smaller doc_id is that of the smallest one.
    first = checkpointed(suspects.groupBy("hash", text).agg(F.min(doc_id).alias("first_id"))).alias("b")
    a = suspects.alias("a")
    smaller = (F.col("a.hash") == F.col("b.hash")) & (F.col(f"a.{text}") == F.col(f"b.{text}")) & (F.col("b.first_id") < F.col(f"a.{doc_id}"))
    return a.join(first, smaller, "left_semi")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, docs, good, toxic: how many documents of each part (lang) fail exactly the filters in bits."""
    texts = docs.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    marked = own_failures(texts).select("doc_id", "part", "bits", F.lit(1).alias("n"))
    e = own_failures(copies(texts)).select("doc_id", "part", "bits")
    # A document that fails E as well leaves its combination for the one with E's bit: sums need no second meeting of its rows.
    failures = marked.union(e.select("doc_id", "part", "bits", F.lit(-1))).union(e.select("doc_id", "part", F.col("bits") + FILTERS["E"], F.lit(1)))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = failures.join(known, "doc_id", "left")
    return told.groupBy("part", "bits").agg(F.sum("n").alias("docs"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))


def _steps() -> str:
    """Every step of every order: the order, the step's number, the bit of its filter and those of the filters before it."""
    return json.dumps([{"filter_order": "".join(o), "step": k + 1, "own": FILTERS[o[k]], "before": sum(FILTERS[x] for x in o[:k])} for o in permutations(FILTERS) for k in range(len(o))])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part is a lang; null and empty lang are one part. Null texts count as empty, which fail A, and E as any other text
    does; very long ones are read whole. Repeated rows count each; those of one doc_id don't make each other fail E; rows without a
    doc_id never fail E and have no label. Labels that repeat count once, as 1 if any is. Counts are long, zeros
    included; an empty table has no parts. Extra columns are not read.
    """
    counts = combinations(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "docs", "good", "toxic")).alias("c"))
    every = parts.select("part", "c", F.explode(F.from_json(F.lit(_steps()), "array<struct<filter_order: string, step: int, own: int, before: int>>")).alias("s"))

    def total(which: str, value: str) -> Column:
        return F.expr(f"aggregate(filter(c, x -> {which}), 0L, (total, x) -> total + {value})")

    removed = "x.bits & s.own > 0 AND x.bits & s.before = 0"
    return every.select(
        "part",
        "s.filter_order",
        "s.step",
        total("x.bits & (s.own | s.before) = 0", "x.docs").alias("kept"),
        total(removed, "x.docs").alias("removed"),
        total("x.bits & s.own > 0 AND x.bits & s.before > 0", "x.docs").alias("redundant"),
        total("x.bits = s.own", "x.docs").alias("unique_fails"),
        total(removed, "x.good").alias("good_lost"),
        total(removed, "x.toxic").alias("toxic_lost"),
        # Of the 120 orders each failing filter is the first one as often as any other that fails.
        total("x.bits & s.own > 0", "x.docs * (120 div bit_count(x.bits))").alias("shapley"),
    )

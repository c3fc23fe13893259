"""The corpus pipeline against the operators' own brute-force rules, and the queries' SQL."""

from __future__ import annotations

import random
import re

import duckdb
from test_llm_operators import brute_components

import corpus_pipeline as P
from tidegrid.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, tmp_path):
    kept, at = [], docs
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, at, SF).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
        if 0 < k < 4:
            assert at.columns == list(P.COLUMNS)
            assert at.count() == at.distinct().count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert ids - kept[0] == {5, 6, 7, 10}
    assert kept[0] - kept[1] == {2, 3}
    left = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/1").collect()]
    assert kept[2] == {d for d, (_, component) in brute_components(left, 5, 80).items() if d == component}
    assert kept[2] == kept[3] == kept[4]
    masked = spark.read.parquet(f"{tmp_path}/3").where("doc_id = 11").first()
    assert re.search("<EMAIL>.*<PHONE>.*<IP>.*<CARD>", masked.text) and masked.n_chars == len(masked.text)


def test_empty_table(spark, docs):
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def prose(seed: int, n: int) -> str:
    return " ".join(f"w{x}" for x in random.Random(seed).choices(range(1000), k=n))


def test_rows_without_an_id_or_with_one_of_another_text_stay(spark, tmp_path):
    rows = [(None, prose(k, 60), "en", "s", 0) for k in range(5)] + [(1, prose(7, 60), "en", "s", 0), (1, prose(8, 60), "en", "s", 0), (2, prose(8, 60), "en", "s", 0), (2, prose(8, 60), "en", "s", 0), (None, prose(7, 60), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    for at in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        for stage in (P.drop_exact, P.drop_near):
            got = [(r.doc_id, r.text) for r in stage(spark, at, SF).collect()]
            assert len(got) == 7 and set(got) == {(None, prose(k, 60)) for k in range(5)} | {(1, prose(7, 60)), (1, prose(8, 60))}


def test_no_known_language_drops_only_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "one text", None, "s", 8), (2, "ünd", None, "s", 3), (3, "12 %", None, "s", 4), (4, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in P.language_id(spark, docs, SF).collect()} == {1, 2}


def test_run(spark):
    assert P.run(spark, SF).count() > 0


def test_queries(spark):
    c = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "benchmark"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, query in queries.QUERIES.items():
        got = query(spark, SF).toPandas()
        assert len(got) >= 40
        if name in queries.ORACLE:
            want = c.sql(queries.ORACLE[name]).df()
            names = sorted(want.columns)
            assert sorted(map(tuple, got[names].itertuples(index=False))) == sorted(map(tuple, want[names].itertuples(index=False)))

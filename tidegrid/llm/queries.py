"""One query for each operator, with its production parameters, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .clustering import ROUNDS, WIDTH, cluster_vectors
from .common import bounded_batches, documents, remainder, shared_folder
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .gru_lm import score_texts
from .language_id import fit_languages, language_column
from .near_dedup import near_duplicates
from .packing import pack_documents
from .pii import KINDS, fit_tagger, pii_column, spelled
from .quality import COUNTS, judge_quality
from .shards import packed_sequences, write_shards
from .suffix_dedup import remove_repeats


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 7) == 2
    scored = score_texts(documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    spelled_ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled_ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, similarity=0.85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = documents(spark, sf_dir)
    found = docs.select("doc_id", pii_column(docs, fit_tagger(docs)).alias("pii"))

    def number(kind: str):
        return F.size(F.filter("pii.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(spelled("pii.base"), 256).alias("base_sha256"), spelled("pii.spans").alias("spans"), F.size("pii.spans").cast("long").alias("n_spans"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packed_sequences(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return write_shards(rows, shared_folder(spark, f"token-shards-{uuid.uuid4().hex}"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 4) == 2
    model = fit_languages(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language_column(docs, model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {f.__name__: f for f in (op1_packing, op2_lm_scoring, op3_bpe, op4_minhash, op5_quality_rules, op6_pii, op7_token_shards, op8_suffix_dedup, op9_exact_dedup, op10_language_id, op11_clustering, op12_filter_audit, op13_decontamination)}


def _clustering_sql() -> str:
    """The rounds one after the other, each as tables of assignments and of centroids."""
    rounds = "".join(
        f"""
        a{k} AS MATERIALIZED (SELECT v.vec_id, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN m{k} m USING (i) GROUP BY v.vec_id, m.c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY d, m.c) = 1),
        n{k} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{k} JOIN v USING (vec_id) GROUP BY ALL),
        m{k + 1} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN n IS NULL THEN x ELSE (s - (s % n + n) % n) // n END AS x FROM m{k} m LEFT JOIN n{k} USING (c, i)),"""
        for k in range(ROUNDS)
    )
    return f"""
        WITH sound AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS MATERIALIZED (SELECT vec_id, unnest(range({WIDTH})) AS i, floor(1024 * unnest(embedding)::DOUBLE)::HUGEINT AS x FROM sound),
        seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM sound QUALIFY c < 8),
        m0 AS MATERIALIZED (SELECT c, i, x FROM seeds JOIN v USING (vec_id)),{rounds}
        a{ROUNDS} AS MATERIALIZED (SELECT v.vec_id, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN m{ROUNDS} m USING (i) GROUP BY v.vec_id, m.c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY d, m.c) = 1),
        told AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{ROUNDS} GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{ROUNDS} JOIN told USING (c)"""


ORACLE = {
    "op11_clustering": _clustering_sql(),
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) < doc_id AS copied FROM t),
        f AS (SELECT doc_id, part, {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(copied, false)} AS fails FROM w),
        b AS (SELECT part, fails, count(*) AS docs, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
              FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
        steps AS (SELECT o, step, o[step] AS own, o[1:step - 1] AS before FROM orders, range(1, 6) r(step)),
        flat AS (SELECT part, docs, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda l: CASE l WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS failing FROM b),
        met AS (SELECT part, o, step, own, docs, good, toxic, list_contains(failing, own) AS fails_own, len(list_filter(failing, lambda l: contains(before, l))) > 0 AS gone, len(failing) AS n FROM flat, steps),
        counted AS (SELECT part, o AS filter_order, step, own, coalesce(sum(docs) FILTER (NOT fails_own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(docs) FILTER (fails_own AND NOT gone), 0)::BIGINT AS removed,
              coalesce(sum(docs) FILTER (fails_own AND gone), 0)::BIGINT AS redundant, coalesce(sum(docs) FILTER (fails_own AND n = 1), 0)::BIGINT AS unique_fails,
              coalesce(sum(good) FILTER (fails_own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails_own AND NOT gone), 0)::BIGINT AS toxic_lost FROM met GROUP BY ALL)
        SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted""",
    "op13_decontamination": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        cuts AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS said FROM cuts),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size),
        hits AS MATERIALIZED (SELECT row, k, p.size, item_id FROM (SELECT row, size, k, array_to_string(w[k : k + size - 1], ' ') AS said FROM places) p JOIN windows USING (said)),
        words AS (SELECT row, count(DISTINCT x) AS n FROM (SELECT row, unnest(range(k, k + size)) AS x FROM hits) GROUP BY row),
        named AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row)
        SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (row) LEFT JOIN named USING (row)""",
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY bare ORDER BY length(t) DESC, doc_id)""",
}

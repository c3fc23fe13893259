"""Scans, merges, normalisation, events, sampling and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..sources import io
from ..operators.order import ranked
from ..sources.fixtures import BARS, DAY, DAYS, FILLS, NEWS, TICKS, bars, days, fills, news, table, ticks
from .registry import query

_T0 = 1_704_067_200_000_000


def r6(c, name, n=6):
    return F.round(c, n).alias(name)


@query(f"WITH {BARS} SELECT symbol, ts, close FROM bars WHERE symbol IN ('click', 'view') AND ts BETWEEN {_T0 + DAY} AND {_T0 + 5 * DAY} ORDER BY symbol, ts")
def io01_read_bars(spark, sf):
    return io.read_bars(bars(spark, sf), ["click", "view"], _T0 + DAY, _T0 + 5 * DAY).select("symbol", "ts", "close")


@query(f"WITH {BARS}, p AS (SELECT symbol, ts, close FROM bars WHERE symbol <> 'error' AND volume > 0) SELECT *, 'primary' AS source_used, false AS price_fallback_used FROM p UNION ALL SELECT symbol, ts, open, 'secondary', true FROM bars b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.symbol = b.symbol)")
def io02_fallback(spark, sf):
    b = bars(spark, sf)
    return io.with_fallback(b.where("symbol <> 'error' AND volume > 0").select("symbol", "ts", "close"), b.select("symbol", "ts", F.col("open").alias("close")), "symbol")


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_acctbal END AS balance FROM supplier")
def io03_csv_import(spark, sf):
    path = io.scratch(spark)
    s = table(spark, sf, "supplier")
    text = F.when(F.col("s_suppkey") % 7 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string"))
    rows = s.select("s_suppkey", text.alias("balance"), F.lit(0).alias("seq")).union(s.select("s_suppkey", F.lit("-1"), F.lit(1)))
    rows.write.mode("overwrite").option("header", True).csv(path)
    return io.csv_import(spark, path, ["s_suppkey"], ["balance"], ["seq"]).select("s_suppkey", "balance")


@query(f"WITH {BARS} SELECT count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT symbol) AS symbols FROM bars")
def io04_csv_export(spark, sf):
    return io.csv_export(bars(spark, sf), io.scratch(spark))


@query("SELECT event_id, upper(event_type) AS kind, least(1.0, greatest(0.0, value / 100)) AS confidence, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, CASE WHEN event_type IN ('click', 'view') THEN 'local' ELSE 'global' END AS scope FROM events")
def io05_jsonl_import(spark, sf):
    path = io.scratch(spark)
    e = table(spark, sf, "events")
    e.select("event_id", "event_type", "value", "props").write.mode("overwrite").json(path)
    j = spark.read.schema("event_id long, event_type string, value double, props string").json(path)
    scope = F.when(F.col("event_type").isin("click", "view"), "local").otherwise("global")
    return j.select("event_id", F.upper("event_type").alias("kind"), E.clamp(F.col("value") / 100, 0.0, 1.0).alias("confidence"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"), scope.alias("scope"))


@query("WITH p AS (SELECT conv_id, min(turn) AS t FROM conversations GROUP BY 1) SELECT kind, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT CASE WHEN turn = t THEN 'post' ELSE 'comment' END AS kind, sha256(conv_id || '||' || turn) AS id FROM conversations JOIN p USING (conv_id) UNION ALL SELECT 'placeholder', sha256(conv_id || '||none') FROM conversations GROUP BY conv_id HAVING count(*) = 1) GROUP BY 1")
def io06_split_posts(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    sid = lambda x: F.sha2(F.concat_ws("||", F.col("conv_id").cast("string"), x), 256).alias("id")
    posts = c.select(F.lit("post").alias("kind"), sid(F.col("turns")[0].cast("string")))
    comments = c.select("conv_id", F.explode_outer(F.slice("turns", F.lit(2), F.greatest(F.lit(1), F.size("turns")))).alias("turn"))
    kind = F.when(F.col("turn").isNull(), "placeholder").otherwise("comment")
    rows = posts.unionByName(comments.select(kind.alias("kind"), sid(F.coalesce(F.col("turn").cast("string"), F.lit("none")))))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


_KV = TICKS + ", o AS (SELECT id % 500 AS k, price AS v, id AS seq FROM ticks WHERE id % 2 = 0), n AS (SELECT id % 700 AS k, price AS v, id AS seq FROM ticks WHERE id % 2 = 1)"


def _kv(spark, sf):
    t = ticks(spark, sf)
    side = lambda m, r: t.where(F.col("id") % 2 == r).select((F.col("id") % m).alias("k"), F.col("price").alias("v"), F.col("id").alias("seq"))
    return side(500, 0), side(700, 1)


@query(f"WITH {_KV} SELECT k, v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM (SELECT * FROM o UNION ALL SELECT * FROM n)) WHERE rn = 1")
def io07_upsert(spark, sf):
    return io.upsert(*_kv(spark, sf), ["k"], "seq")


@query(f"WITH {_KV} SELECT count(*) AS n, round(sum(v), 4) AS v FROM (SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o))")
def io08_insert_ignore(spark, sf):
    return io.insert_ignore(*_kv(spark, sf), ["k"]).agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("v"))


@query(f"WITH {BARS} SELECT symbol, ts, close, 'old' AS origin FROM bars WHERE NOT (symbol IN ('click') AND ts >= {_T0 + DAY} AND ts < {_T0 + 9 * DAY}) UNION ALL SELECT symbol, ts, open, 'new' FROM bars WHERE symbol = 'click' AND ts >= {_T0 + DAY} AND ts < {_T0 + 9 * DAY}")
def io09_replace_window(spark, sf):
    b = bars(spark, sf)
    new = b.where((F.col("symbol") == "click") & (F.col("ts") >= _T0 + DAY) & (F.col("ts") < _T0 + 9 * DAY)).select("symbol", "ts", F.col("open").alias("close"), F.lit("new").alias("origin"))
    return io.replace_window(b.select("symbol", "ts", "close", F.lit("old").alias("origin")), new, "symbol", ["click"], _T0 + DAY, _T0 + 9 * DAY)


@query(f"WITH {BARS} SELECT ts // {DAY} AS day, count(*) AS n, round(sum(close), 4) AS close FROM bars GROUP BY 1")
def io10_chunked_build(spark, sf):
    path = io.scratch(spark)
    b = bars(spark, sf).withColumn("day", F.floor(F.col("ts") / DAY))
    io.write_partitions(b, path, "day")
    io.write_partitions(b.where(F.col("day") % 2 == 0), path, "day")  # a range built again replaces only itself
    return spark.read.parquet(path).groupBy(F.col("day").cast("long").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("close"))


@query(f"WITH {_KV} SELECT k, max(seq) AS seq FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1 ORDER BY 1")
def io11_merge_chunks(spark, sf):
    path = io.scratch(spark)
    for k, chunk in enumerate(_kv(spark, sf)):
        chunk.write.mode("overwrite").parquet(f"{path}/chunk={k}")
    return io.latest(spark.read.parquet(path), ["k"], F.desc("seq")).select("k", "seq").orderBy("k")


@query(f"WITH {BARS} SELECT symbol, count(*) AS n, 'v1' AS data_version FROM bars GROUP BY 1")
def io12_snapshot_writer(spark, sf):
    path = io.scratch(spark)
    timed = F.when(F.col("ts").isNull(), F.raise_error(F.lit("a snapshot row has no time")).cast("long")).otherwise(F.col("ts"))
    io.write_partitions(bars(spark, sf).withColumn("ts", timed).withColumn("data_version", F.lit("v1")), path, "symbol")
    return spark.read.parquet(path).groupBy("symbol", "data_version").agg(F.count("*").alias("n"))


_SIGNAL = "CASE WHEN x > 0.001 THEN 'buy' WHEN x < -0.001 THEN 'sell' ELSE 'hold' END"


@query(f"SELECT event_id, {_SIGNAL} AS signal FROM (SELECT event_id, (value - 100) / 100 AS x FROM events)")
def io14_signals(spark, sf):
    raw = table(spark, sf, "events").select(F.to_json(F.struct("event_id", ((F.col("value") - 100) / 100).alias("x"))).alias("m"))
    j = raw.select(F.from_json("m", "event_id long, x double").alias("j")).select("j.*")
    return j.select("event_id", F.when(F.col("x") > 0.001, "buy").when(F.col("x") < -0.001, "sell").otherwise("hold").alias("signal"))


@query("SELECT o_orderkey, epoch_us(date_trunc('second', o_orderdate)) AS ts FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 3")
def pf01_parse_time(spark, sf):
    t, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.unix_seconds(t).cast("string")).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", io.parse_time(text).alias("ts"))


@query(f"WITH {NEWS}, c AS (SELECT id, occurred, CASE WHEN id % 4 = 0 THEN occurred - 5 ELSE published END AS p, CASE WHEN id % 5 = 0 THEN occurred - 9 ELSE available END AS a FROM news) SELECT id, greatest(occurred, p) AS published, greatest(occurred, p, a) AS available, p < occurred OR a < p AS clock_violation, ((greatest(occurred, p, a) - occurred) // 1000)::BIGINT AS source_latency_ms FROM c")
def pf02_repair_clocks(spark, sf):
    n = news(spark, sf)
    broken = n.withColumns({"published": F.when(F.col("id") % 4 == 0, F.col("occurred") - 5).otherwise(F.col("published")), "available": F.when(F.col("id") % 5 == 0, F.col("occurred") - 9).otherwise(F.col("available"))})
    return io.repair_clocks(broken).select("id", "published", "available", "clock_violation", "source_latency_ms")


@query("SELECT p_partkey, upper(p_brand) || ',' || upper(p_type) AS symbols FROM part")
def pf03_symbols(spark, sf):
    raw = F.array(F.concat(F.lit(" $"), F.lower("p_brand")), F.col("p_brand"), F.lit(" "), F.concat(F.lower("p_type"), F.lit(" ")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(io.normalise_symbols(raw), ",").alias("symbols"))


_ALIASES = (("click", "WEB", 1), ("view", "WEB", 2), ("purchase", "SHOP", 1), ("signup", "SHOP", 2))


@query(f"WITH {BARS}, a(symbol, target, p) AS (VALUES " + ", ".join(map(str, _ALIASES)) + ") SELECT target, ts, close, symbol AS origin FROM (SELECT target, ts, close, b.symbol, row_number() OVER (PARTITION BY target, ts ORDER BY p) AS rn FROM bars b JOIN a ON b.symbol = a.symbol) WHERE rn = 1")
def pf04_alias_priority(spark, sf):
    aliases = spark.createDataFrame(_ALIASES, "symbol string, target string, priority int")
    return io.latest(bars(spark, sf).join(aliases, "symbol"), ["target", "ts"], "priority").select("target", "ts", "close", F.col("symbol").alias("origin"))


@query("SELECT p_brand, (contains(lower(p_brand), '1') OR contains(lower(p_brand), '2')) AND p_brand <> 'Brand#12' AS synthetic, count(*) AS n FROM part GROUP BY 1, 2")
def pf05_synthetic_flag(spark, sf):
    low = F.lower("p_brand")
    flag = (F.contains(low, F.lit("1")) | F.contains(low, F.lit("2"))) & (F.col("p_brand") != "Brand#12")
    return table(spark, sf, "part").groupBy("p_brand", flag.alias("synthetic")).agg(F.count("*").alias("n"))


@query("SELECT n_name FROM nation WHERE NOT regexp_matches(n_name, '(AN|IA)') AND NOT regexp_matches(n_name, '(A|Y)$')")
def pf06_symbol_exclusion(spark, sf):
    return table(spark, sf, "nation").where(~F.col("n_name").rlike("(AN|IA)") & ~F.col("n_name").rlike("(A|Y)$")).select("n_name")


@query("SELECT doc_id, coalesce(lang, 'und') AS lang, least(10000, greatest(0, coalesce(n_chars, 0))) AS chars, CASE WHEN source IN ('src0', 'src1') THEN source ELSE 'other' END AS platform FROM documents")
def pf07_payload_defaults(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.least(F.lit(10000), F.greatest(F.lit(0), F.coalesce("n_chars", F.lit(0)))).alias("chars"), F.when(F.col("source").isin("src0", "src1"), F.col("source")).otherwise("other").alias("platform"))


@query(f"WITH {NEWS} SELECT id, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.65 WHEN 4 THEN 0.4 ELSE 0.2 END::DOUBLE AS weight FROM news WHERE confidence >= 0.3 AND tier <= 4")
def pf08_event_filter(spark, sf):
    weights = F.create_map(*[F.lit(x) for x in (1, 1.0, 2, 0.85, 3, 0.65, 4, 0.4, 5, 0.2)])
    return news(spark, sf).where("confidence >= 0.3 AND tier <= 4").select("id", weights[F.col("tier").cast("int")].alias("weight"))


@query("SELECT o_orderpriority AS source, coalesce(nullif(o_orderstatus, 'P'), 'missing') AS regime, count(*) AS runs FROM orders WHERE o_orderpriority NOT LIKE '5%' AND o_totalprice > 1000 GROUP BY 1, 2")
def pf09_run_filter(spark, sf):
    o = table(spark, sf, "orders").where(~F.col("o_orderpriority").like("5%") & (F.col("o_totalprice") > 1000))
    return o.groupBy(F.col("o_orderpriority").alias("source"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("missing")).alias("regime")).agg(F.count("*").alias("runs"))


@query("SELECT count(*) AS seen, count(*) FILTER (WHERE lang NOT IN ('en', 'de')) AS dropped_lang, count(*) FILTER (WHERE lang IN ('en', 'de') AND n_chars < 500) AS dropped_window, count(*) FILTER (WHERE lang IN ('en', 'de') AND n_chars >= 500) AS kept FROM documents")
def pf10_filter_counts(spark, sf):
    lang, window = F.col("lang").isin("en", "de"), F.col("n_chars") >= 500
    return table(spark, sf, "documents").agg(F.count("*").alias("seen"), F.count_if(~lang).alias("dropped_lang"), F.count_if(lang & ~window).alias("dropped_window"), F.count_if(lang & window).alias("kept"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(concat_ws(' ', source, text)), '(src1 |anther|heit)')")
def pf11_relevance(spark, sf):
    return table(spark, sf, "documents").where(F.lower(F.concat_ws(" ", "source", "text")).rlike("(src1 |anther|heit)")).select("doc_id")


@query(f"WITH {BARS} SELECT symbol, ts, close AS v0, volume AS v1, coalesce(close, 0) AS again FROM bars")
def pf12_vector_map(spark, sf):
    keys = F.array(F.lit("close"), F.lit("volume"))
    m = bars(spark, sf).withColumn("m", F.map_from_arrays(keys, F.array("close", "volume")))
    v = F.transform(keys, lambda k: F.col("m")[k])
    return m.select("symbol", "ts", v[0].alias("v0"), v[1].alias("v1"), F.coalesce(F.map_from_arrays(keys, v)["close"], F.lit(0.0)).alias("again"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS kept, 0.0 AS masked, round((abs(embedding[5]::DOUBLE) + abs(embedding[6]::DOUBLE) + abs(embedding[7]::DOUBLE) + abs(embedding[8]::DOUBLE)) / 4, 6) AS strength FROM embeddings WHERE (abs(embedding[5]::DOUBLE) + abs(embedding[6]::DOUBLE) + abs(embedding[7]::DOUBLE) + abs(embedding[8]::DOUBLE)) / 4 >= 0.05")
def pf13_group_mask(spark, sf):
    idx = F.array(F.lit(1), F.lit(2))
    masked = F.transform("embedding", lambda v, i: F.when(F.array_contains(idx, i), F.lit(0.0)).otherwise(v.cast("double")))
    strength = F.aggregate(F.slice("embedding", 5, 4), F.lit(0.0), lambda a, v: a + F.abs(v.cast("double"))) / 4
    return table(spark, sf, "embeddings").select("vec_id", masked[0].alias("kept"), masked[1].alias("masked"), strength.alias("s")).where("s >= 0.05").select("vec_id", "kept", "masked", r6(F.col("s"), "strength"))


@query("WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), d AS (SELECT vec_id, i, CASE WHEN ('0x' || left(sha1('42:' || vec_id || ':' || i), 12))::BIGINT / 281474976710655.0 < 0.1 THEN 0 ELSE x END AS x FROM e) SELECT vec_id, count(*) FILTER (WHERE x = 0) AS dropped, round(sum(x), 5) + 0.0 AS total, round(sum(x * i), 4) + 0.0 AS placed FROM d GROUP BY 1")
def pf14_feature_dropout(spark, sf):
    """A tenth of the values becomes 0, by a hash of seed, row and place: the same ones each time."""
    values = E.dropout(F.col("embedding"), F.col("vec_id"), 0.1, 42)
    rows = table(spark, sf, "embeddings").select("vec_id", values.alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    placed = F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.size(F.filter("v", lambda x: x == 0)).cast("long").alias("dropped"), (F.round(total, 5) + 0.0).alias("total"), (F.round(placed, 4) + 0.0).alias("placed"))


#: Start-up event types that the table's event types stand for.
_STARTUP = {"signup": "funding", "purchase": "mna", "click": "product", "error": "regulatory"}
_STARTED = NEWS + ", e AS (SELECT *, CASE symbol " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STARTUP.items()) + " ELSE '' END AS kind, (id % 10) / 10 AS importance, (id % 7) / 7 AS novelty FROM news), y AS (SELECT *, (kind = 'funding')::INT AS y6, (kind IN ('funding', 'mna'))::INT AS y12, (kind IN ('funding', 'mna', 'product') OR confidence >= 0.8)::INT AS y24 FROM e)"


@query(f"WITH {_STARTED} SELECT id, CASE kind WHEN 'funding' THEN 1.0 WHEN 'mna' THEN 0.7 WHEN 'product' THEN 0.4 WHEN 'regulatory' THEN -0.3 ELSE 0 END::DOUBLE AS type_score, (6 - tier) / 5.0::DOUBLE AS tier_score, confidence, importance, round(novelty, 6) AS novelty, y6::DOUBLE AS y6, y12::DOUBLE AS y12, y24::DOUBLE AS y24, 1.0::DOUBLE - y24 AS y_exit, round(greatest(0.2, least(8, 0.8 + y6 + 1.2 * y12 + 0.8 * y24 + 0.4 * confidence + 0.3 * importance + 0.2 * novelty)), 6) AS multiple FROM y")
def pf15_startup_vector(spark, sf):
    kind = F.lit("")
    for name, stands_for in _STARTUP.items():
        kind = F.when(F.col("symbol") == name, stands_for).otherwise(kind)
    n = news(spark, sf).withColumn("kind", kind).withColumn("importance", F.col("id") % 10 / 10).withColumn("novelty", F.col("id") % 7 / 7)
    said = [F.col(c) for c in ("confidence", "importance", "novelty")]
    rows = n.select("id", E.startup_vector(F.col("kind"), F.col("tier"), *said).alias("v"), *(c.alias(k) for k, c in E.startup_targets(F.col("kind"), *said).items()))
    names = ("type_score", "tier_score", "confidence", "importance", "novelty")
    return rows.select("id", *(F.round(F.col("v")[k], 6).alias(c) for k, c in enumerate(names)), "y6", "y12", "y24", "y_exit", F.round("multiple", 6).alias("multiple"))


@query(f"WITH {DAYS}, b AS (SELECT symbol FROM days GROUP BY 1 HAVING count(*) < 550) SELECT symbol, count(*) AS n FROM days d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = d.symbol) GROUP BY 1")
def pf16_exclude_blocked(spark, sf):
    d = days(spark, sf)
    blocked = d.groupBy("symbol").agg(F.count("*").alias("k")).where("k < 550")
    return d.join(blocked, "symbol", "left_anti").groupBy("symbol").agg(F.count("*").alias("n"))


_DEFAULTS = (("en", 1, 0.9), ("de", 2, 0.8), ("fr", 3, 0.7), ("es", 4, 0.6))


@query("WITH f(lang, tier, confidence) AS (VALUES " + ", ".join(map(str, _DEFAULTS)) + ") SELECT doc_id, tier, confidence::DOUBLE AS confidence, CASE WHEN contains(lower(text), 'heit') THEN 'policy' ELSE 'news' END AS event_type FROM (SELECT doc_id, coalesce(tier, 5) AS tier, coalesce(confidence, 0.5) AS confidence, coalesce(text, '') AS text FROM documents LEFT JOIN f USING (lang))")
def pf17_source_defaults(spark, sf):
    defaults = spark.createDataFrame(_DEFAULTS, "lang string, tier int, confidence double")
    known = table(spark, sf, "documents").join(F.broadcast(defaults), "lang", "left")
    return known.select("doc_id", F.coalesce("tier", F.lit(5)).alias("tier"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.when(F.contains(F.lower("text"), F.lit("heit")), "policy").otherwise("news").alias("event_type"))


# Top k, sampling, sets


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def tk01_top(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


_CAPPED = NEWS + f", d AS (SELECT id, source, ts // {DAY} AS day, confidence FROM news), k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY confidence DESC, id) AS round FROM d WHERE source = 's1'), p AS (SELECT *, row_number() OVER (ORDER BY round, day, id) AS pick FROM k)"


@query(f"WITH {_CAPPED} SELECT id, source FROM p WHERE pick <= (SELECT count(*) * 0.1 FROM d WHERE source <> 's1') UNION ALL SELECT id, source FROM d WHERE source <> 's1'")
def tk02_provider_cap(spark, sf):
    d = news(spark, sf).select("id", "source", F.floor(F.col("ts") / DAY).alias("day"), "confidence")
    others = d.where("source <> 's1'")
    order = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("confidence"), "id"))
    rounds = d.where("source = 's1'").withColumn("round", order)
    # How many rows come before a round and day: sums over rounds and days alone, so no window holds all rows.
    sizes = rounds.groupBy("round", "day").agg(F.count("*").alias("k"))
    before = sizes.withColumn("before", F.sum("k").over(Window.orderBy("round", "day")) - F.col("k"))
    within = F.row_number().over(Window.partitionBy("round", "day").orderBy("id"))
    kept = others.agg((F.count("*") * 0.1).alias("keep"))
    picked = rounds.withColumn("within", within).join(before, ["round", "day"]).crossJoin(F.broadcast(kept)).where(F.col("before") + F.col("within") <= F.col("keep"))
    return picked.select("id", "source").union(others.select("id", "source"))


@query(f"WITH {TICKS}, h AS (SELECT user_id, sum(price) AS heat FROM ticks GROUP BY 1), s AS (SELECT user_id, heat, least(20, round(1000 * heat / sum(heat) OVER ()))::BIGINT AS base, row_number() OVER (ORDER BY heat DESC, user_id) AS rk, count(*) OVER () AS n FROM h), l AS (SELECT *, greatest(0, 1000 - sum(base) OVER ())::BIGINT AS rest FROM s) SELECT user_id, (base + rest // n + CASE WHEN rk <= rest % n THEN 1 ELSE 0 END)::BIGINT AS budget FROM l")
def tk03_budget(spark, sf):
    h = ticks(spark, sf).groupBy("user_id").agg(F.sum("price").alias("heat"))
    total = h.agg(F.sum("heat").alias("total"), F.count("*").alias("n"))
    base = F.least(F.lit(20), F.round(1000 * F.col("heat") / F.col("total"))).cast("long")
    s = h.crossJoin(F.broadcast(total)).withColumn("base", base)
    spent = s.agg(F.greatest(F.lit(0), 1000 - F.sum("base")).alias("rest"))
    placed = ranked(s, F.desc("heat"), "user_id", rank="rk").crossJoin(F.broadcast(spent))
    extra = F.when(F.col("rk") <= F.col("rest") % F.col("n"), 1).otherwise(0)
    return placed.select("user_id", (F.col("base") + F.floor(F.col("rest") / F.col("n")) + extra).cast("long").alias("budget"))


@query(f"WITH {BARS}, r AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), k AS (SELECT unnest(range(20)) AS k) SELECT DISTINCT symbol, ts FROM r JOIN k ON i = floor(k * (n - 1) / 19.0)")
def tk04_uniform_sample(spark, sf):
    w = Window.partitionBy("symbol")
    r = bars(spark, sf).select("symbol", "ts", (F.row_number().over(w.orderBy("ts")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    # Row i is taken if some k has floor(k (n - 1) / 19) = i.
    k = F.ceil(F.col("i") * 19.0 / F.greatest(F.col("n") - 1, F.lit(1)))
    return r.where((k <= 19) & (F.floor(k * (F.col("n") - 1) / 19.0) == F.col("i"))).select("symbol", "ts").distinct()


@query(f"WITH {BARS}, r AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, ts FROM r WHERE (rn - 1) % greatest(1, n // 100) = 0")
def tk05_every_nth(spark, sf):
    w = Window.partitionBy("symbol")
    r = bars(spark, sf).select("symbol", "ts", F.row_number().over(w.orderBy("ts")).alias("rn"), F.count("*").over(w).alias("n"))
    return r.where((F.col("rn") - 1) % F.greatest(F.lit(1), F.floor(F.col("n") / 100)) == 0).select("symbol", "ts")


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS anchor, row_number() OVER w > 2 AS superseded FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)")
def tk06_supersede(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", F.first("o_orderkey").over(w).alias("anchor"), (F.row_number().over(w) > 2).alias("superseded"))


@query(f"WITH {NEWS} SELECT id, confidence FROM news WHERE confidence >= 0.9 ORDER BY ts DESC, id DESC LIMIT 50")
def tk07_quality_sample(spark, sf):
    return news(spark, sf).where("confidence >= 0.9").orderBy(F.desc("ts"), F.desc("id")).limit(50).select("id", "confidence")


@query(f"WITH {FILLS}, g AS (SELECT target, avg(price) AS ret, max(qty) AS dd, count(*) AS n FROM fills GROUP BY 1) SELECT target, round(ret - CASE WHEN dd > 49 THEN 100 ELSE 0 END - CASE WHEN n < 600 THEN 50 ELSE 0 END, 6) AS score FROM g WHERE n > 5 ORDER BY score DESC, target LIMIT 20")
def tk08_grid_rank(spark, sf):
    g = fills(spark, sf).groupBy("target").agg(F.avg("price").alias("ret"), F.max("qty").alias("dd"), F.count("*").alias("n")).where("n > 5")
    score = F.col("ret") - F.when(F.col("dd") > 49, 100).otherwise(0) - F.when(F.col("n") < 600, 50).otherwise(0)
    return g.select("target", r6(score, "score")).orderBy(F.desc("score"), "target").limit(20)


@query(f"WITH {_KV} SELECT k, count(*) AS n FROM (SELECT DISTINCT ON (k, v) k, v FROM (SELECT k, v FROM o UNION ALL SELECT k, v FROM n)) GROUP BY 1")
def so01_union_dedup(spark, sf):
    o, n = _kv(spark, sf)
    return o.unionByName(n.withColumn("extra", F.lit(1)), allowMissingColumns=True).dropDuplicates(["k", "v"]).groupBy("k").agg(F.count("*").alias("n"))


@query(f"WITH {_KV}, a AS (SELECT DISTINCT k FROM o), b AS (SELECT DISTINCT k FROM n) SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS common, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS together, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS added")
def so02_key_sets(spark, sf):
    a, b = (x.select("k") for x in _kv(spark, sf))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(a.intersect(b), "common").crossJoin(n(a.union(b).distinct(), "together")).crossJoin(n(b.subtract(a), "added"))


@query(f"WITH {BARS}, u AS (SELECT symbol, ts, open AS v, 0 AS fresh FROM bars WHERE ts < {_T0 + 20 * DAY} UNION ALL SELECT symbol, ts, close, 1 FROM bars WHERE ts >= {_T0 + 18 * DAY}) SELECT symbol, ts, v FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY fresh DESC) AS rn FROM u) WHERE rn = 1")
def so03_overlap_merge(spark, sf):
    b = bars(spark, sf)
    old = b.where(F.col("ts") < _T0 + 20 * DAY).select("symbol", "ts", F.col("open").alias("v"), F.lit(0).alias("fresh"))
    new = b.where(F.col("ts") >= _T0 + 18 * DAY).select("symbol", "ts", F.col("close").alias("v"), F.lit(1).alias("fresh"))
    return io.upsert(old, new, ["symbol", "ts"], "fresh").drop("fresh")


# Events


_FP = TICKS + f", e AS (SELECT id, ts, user_id, symbol, sha256(symbol || '|' || user_id || '|' || ts // {DAY}) AS fp FROM ticks)"


def _events(spark, sf):
    key = F.concat_ws("|", "symbol", F.col("user_id").cast("string"), F.floor(F.col("ts") / DAY).cast("string"))
    return ticks(spark, sf).withColumn("fp", F.sha2(key, 256))


@query(f"WITH {_FP}, old AS (SELECT DISTINCT fp FROM e WHERE ts < {_T0 + 10 * DAY}), f AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ts, id) AS rn FROM e WHERE ts >= {_T0 + 10 * DAY}) SELECT count(*) AS accepted, count(*) FILTER (WHERE rn = 1 AND old.fp IS NULL) AS inserted, count(*) FILTER (WHERE rn > 1 OR old.fp IS NOT NULL) AS deduplicated FROM f LEFT JOIN old ON f.fp = old.fp")
def en01_event_dedup(spark, sf):
    """The events of the first ten days are there; the others come as a batch."""
    e = _events(spark, sf)
    batch, there = e.where(F.col("ts") >= _T0 + 10 * DAY), e.where(F.col("ts") < _T0 + 10 * DAY)
    new = io.new_events(batch, there, "fp", ("ts", "id"))
    counts = batch.agg(F.count("*").alias("accepted")).crossJoin(new.agg(F.count("*").alias("inserted")))
    return counts.withColumn("deduplicated", F.col("accepted") - F.col("inserted"))


_KINDS2 = "l AS (SELECT DISTINCT doc_id, kind, name FROM (SELECT doc_id, unnest(['source', 'lang']) AS kind, unnest([source, lang]) AS name FROM documents) WHERE name IS NOT NULL)"


@query(f"WITH {_KINDS2}, e AS (SELECT kind, name, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM l GROUP BY 1, 2) SELECT kind, name, first_doc, last_doc, count(*) AS links FROM e JOIN l USING (kind, name) GROUP BY 1, 2, 3, 4")
def en02_entity_links(spark, sf):
    """Entities are upserted by kind and name (the first document stays, the last one moves), links inserted once."""
    entities, links = io.entity_links(table(spark, sf, "documents").select("doc_id", F.explode(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang")).alias("kind", "name")), "doc_id")
    return entities.join(links, ["kind", "name"]).groupBy("kind", "name", "first_doc", "last_doc").agg(F.count("*").alias("links"))


@query("SELECT doc_id, list_contains(['src0', 'src1', 'en'], source)::INT + list_contains(['src0', 'src1', 'en'], lang)::INT AS known FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents)")
def en03_entity_union(spark, sf):
    known = F.array(F.lit("src0"), F.lit("src1"), F.lit("en"))
    merged = F.array_union(F.array("source", "lang"), F.array("lang"))
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(merged, lambda e: F.array_contains(known, e))).alias("known"))


@query(f"WITH {NEWS} SELECT id, round(0.35 + 0.65 * abs(sentiment), 6) AS importance, (available - occurred) / 1e6 AS lag_sec, CASE WHEN abs(sentiment) > 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS coverage FROM news")
def en04_social_event(spark, sf):
    n = news(spark, sf)
    return n.select("id", r6(0.35 + 0.65 * F.abs("sentiment"), "importance"), ((F.col("available") - F.col("occurred")) / 1e6).alias("lag_sec"), F.when(F.abs("sentiment") > 0, 1.0).otherwise(0.5).alias("coverage"))


@query(f"WITH {NEWS} SELECT id % 1000 AS event_id, max(id) AS version, arg_max(sentiment, id) AS sentiment FROM news GROUP BY 1")
def en05_enrichment_upsert(spark, sf):
    n = news(spark, sf).select((F.col("id") % 1000).alias("event_id"), F.col("id").alias("version"), "sentiment")
    return io.upsert(n.where("version % 2 = 0"), n.where("version % 2 = 1"), ["event_id"], "version")


@query(f"WITH {NEWS} SELECT symbol, id, rn FROM (SELECT symbol, id, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, id DESC) AS rn FROM news) WHERE rn <= 10")
def en06_recent_context(spark, sf):
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("id")))
    return news(spark, sf).withColumn("rn", rn).where("rn <= 10").select("symbol", "id", "rn")

"""Scalar functions over texts, events and bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import rolling as R
from ..sources.fixtures import BARS, FILLS, NEWS, PREDICTIONS, TICKS, bars, fills, news, predictions, table, ticks
from .registry import query

_C = lambda *names: (F.col(n) for n in names)


def r6(c, name, n=6):
    return F.round(c, n).alias(name)


def _list(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


#: The generated texts hold no lexicon words: their most frequent words stand in for them, by replacement.
_SPOKEN = "replace(replace(replace(lower({t}), ' the ', ' not gain '), ' und ', ' very weak '), ' que ', ' slightly strong ')"


def _spoken(c):
    for a, b in ((" the ", " not gain "), (" und ", " very weak "), (" que ", " slightly strong ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_D = "d AS (SELECT doc_id, regexp_extract_all(" + _SPOKEN.format(t="coalesce(text, '')") + ", '[a-z'']+|[0-9]+') AS w, coalesce(text, '') AS t FROM documents)"
_NEAR = "(coalesce(w[i-1], '') IN {0} OR coalesce(w[i-2], '') IN {0})"
_SIGN = f"CASE WHEN w[i] IN {_list(E.POSITIVE)} THEN 1.0 WHEN w[i] IN {_list(E.NEGATIVE)} THEN -1.0 ELSE 0.0 END::DOUBLE"
_NEG = "(" + _NEAR.format("('" + "', '".join(w.replace("'", "''") for w in E.NEGATIONS) + "')") + " OR coalesce(w[i-1], '') LIKE '%n''t' OR coalesce(w[i-2], '') LIKE '%n''t')"
_AMP = f"(CASE WHEN {_NEAR.format(_list(E.BOOSTERS))} THEN 1.35 ELSE 1.0 END * CASE WHEN {_NEAR.format(_list(E.DAMPERS))} THEN 0.7 ELSE 1.0 END)::DOUBLE"
_SIGNS = lambda c, xs: "(" + " + ".join(f"contains({c}, '{x}')::INT" for x in xs) + ")"


@query(f"WITH {_D}, u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), v AS (SELECT doc_id, {_SIGN} AS sign, CASE WHEN {_NEG} THEN -1.0 ELSE 1.0 END::DOUBLE AS turned, {_AMP} AS amp FROM u), s AS (SELECT doc_id, sum(sign * turned * amp) AS raw, sum(amp) AS weight FROM v WHERE sign <> 0 GROUP BY 1), e AS (SELECT d.doc_id, t, coalesce(raw, 0) + 0.6::DOUBLE * ({_SIGNS('t', E.HAPPY)} - {_SIGNS('t', E.SAD)}) AS raw, coalesce(weight, 0) + 0.6::DOUBLE * ({_SIGNS('t', E.HAPPY)} + {_SIGNS('t', E.SAD)}) AS weight FROM d LEFT JOIN s ON d.doc_id = s.doc_id) SELECT doc_id, round(CASE WHEN weight > 1e-9 THEN greatest(-1.0, least(1.0, raw / weight * least(1.25, 1 + 0.03 * (length(t) - length(replace(t, '!', '')))) * CASE WHEN {_SIGNS('lower(t)', E.SARCASM)} > 0 THEN 0.5 ELSE 1.0 END)) ELSE 0 END, 6) + 0.0 AS sentiment FROM e")
def sc01_lexicon_sentiment(spark, sf):
    spoken = table(spark, sf, "documents").select("doc_id", _spoken(F.lower("text")).alias("said"))
    return spoken.select("doc_id", (F.round(E.lexicon_sentiment(F.col("said")), 6) + 0.0).alias("sentiment"))


def _said_sql(words):
    return "(" + " + ".join(f"contains(t, '{w}')::INT" for w in words) + ")"


def _any_sql(words):
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


#: Prose of the table with words of the lists in it, so that all of them are met.
_TOLD = "told AS (SELECT doc_id, lower(coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN ' Bitcoin rally, SEC approval' WHEN 1 THEN ' 比特币 暴跌 ban' WHEN 2 THEN ' bearish FOMC, Chainlink 利好' WHEN 3 THEN ' bullish upgrade of Cardano' ELSE '' END) AS t, coalesce(text, '') AS text FROM documents)"


def _told(spark, sf):
    i, text = F.col("doc_id") % 6, F.coalesce("text", F.lit(""))
    more = F.when(i == 0, " Bitcoin rally, SEC approval").when(i == 1, " 比特币 暴跌 ban").when(i == 2, " bearish FOMC, Chainlink 利好").when(i == 3, " bullish upgrade of Cardano").otherwise("")
    return table(spark, sf, "documents").select("doc_id", F.concat(text, more).alias("said"))


_RATIO = "CASE WHEN {p} + {n} > 0 THEN ({p} - {n}) / ({p} + {n}) ELSE 0.0 END"


@query(f"WITH {_TOLD} SELECT doc_id, round({_RATIO.format(p=_said_sql(E.IMPORT_POSITIVE), n=_said_sql(E.IMPORT_NEGATIVE))}, 9) AS imported, round({_RATIO.format(p=_said_sql(E.ENRICH_POSITIVE), n=_said_sql(E.ENRICH_NEGATIVE))}, 9) AS enriched FROM told")
def sc02_keyword_sentiment(spark, sf):
    """Two lexicons, one scan of each text."""
    lists = (E.IMPORT_POSITIVE, E.IMPORT_NEGATIVE, E.ENRICH_POSITIVE, E.ENRICH_NEGATIVE)
    found = _told(spark, sf).select("doc_id", E.keywords(F.col("said"), [w for words in lists for w in words]).alias("found"))
    return found.select("doc_id", F.round(E.keyword_sentiment(F.col("found")), 9).alias("imported"), F.round(E.keyword_sentiment(F.col("found"), *lists[2:]), 9).alias("enriched"))


@query(r"WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '通胀 ' || text WHEN 1 THEN '123 éà ' || text ELSE text END AS text FROM documents) SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'other' END AS hint FROM d")
def sc03_language_hint(spark, sf):
    """Whole texts, some behind Han characters or accents."""
    i = F.col("doc_id") % 5
    text = F.when(i == 0, F.concat(F.lit("通胀 "), "text")).when(i == 1, F.concat(F.lit("123 éà "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", E.language_hint(text).alias("hint"))


_NAMED = "named AS (SELECT p_partkey, p_name || ' ' || p_type || CASE p_partkey % 5 WHEN 0 THEN ' Bitcoin and XBT with ETH' WHEN 1 THEN ' FROM solana THE $DOGE, ETH' WHEN 2 THEN ' AA BB CC DD EE FF AA GG HH II JJ KK LL MM' WHEN 3 THEN ' EthereumClassic SOLANA' ELSE '' END AS t FROM part)"
_MAPPED = "CASE {w} WHEN 'BTC' THEN 'BTC' WHEN 'BITCOIN' THEN 'BTC' WHEN 'XBT' THEN 'BTC' WHEN 'ETH' THEN 'ETH' WHEN 'ETHEREUM' THEN 'ETH' WHEN 'SOL' THEN 'SOL' WHEN 'SOLANA' THEN 'SOL' END"


def _distinct_sql(c, n):
    """The first n different values of a list, in order, as text."""
    return f"array_to_string(list_filter({c}, lambda x, i: list_position({c}, x) = i)[1:{n}], ',')"


@query(rf"WITH {_NAMED}, f AS (SELECT p_partkey, list_filter(list_transform(regexp_extract_all(t, '\b([A-Za-z]{{3,16}})\b', 1), lambda w: {_MAPPED.format(w='upper(w)')}), lambda w: w IS NOT NULL) AS a, list_transform(list_filter(regexp_extract_all(t, '\b([A-Z]{{2,5}})\b', 1), lambda w: w NOT IN ('THE', 'WITH', 'FROM', 'THIS', 'THAT')), lambda w: coalesce({_MAPPED.format(w='w')}, w)) AS b, regexp_extract_all(t, '\$?([A-Z]{{2,10}})', 1) AS m FROM named), g AS (SELECT p_partkey, list_concat(a, b) AS e, m, list_filter(m, lambda w: w IN ('ETH', 'DOGE', 'SOLANA', 'LL')) AS k FROM f) SELECT p_partkey, {_distinct_sql('e', 5)} AS tickers, {_distinct_sql('m', 12)} AS mentions, {_distinct_sql('k', 12)} AS known FROM g")
def sc04_tickers(spark, sf):
    i = F.col("p_partkey") % 5
    more = F.when(i == 0, " Bitcoin and XBT with ETH").when(i == 1, " FROM solana THE $DOGE, ETH").when(i == 2, " AA BB CC DD EE FF AA GG HH II JJ KK LL MM").when(i == 3, " EthereumClassic SOLANA").otherwise("")
    text = F.concat("p_name", F.lit(" "), "p_type", more)
    found = {"tickers": E.tickers(text), "mentions": E.mentions(text), "known": E.mentions(text, ("ETH", "DOGE", "SOLANA", "LL"))}
    return table(spark, sf, "part").select("p_partkey", *(F.array_join(c, ",").alias(n) for n, c in found.items()))


@query(f"WITH {_TOLD} SELECT doc_id, coalesce(nullif(concat_ws(',', " + ", ".join(f"CASE WHEN {_any_sql(ws)} THEN '{k}' END" for k, ws in E.ENTITY_KEYWORDS.items()) + f"), ''), 'US_MACRO') AS entities, CASE WHEN {_any_sql(E.REGULATORY)} THEN 'regulatory' ELSE 'market' END AS event_type, CASE WHEN {_any_sql(E.MACRO)} THEN 'macro' ELSE 'crypto' END AS scope, {_any_sql(E.MACRO)} AS global_impact FROM told")
def sc05_entity_map(spark, sf):
    """Entities, event type and scope from one scan of each text for the words of all lists."""
    words = [w for ws in (*E.ENTITY_KEYWORDS.values(), E.REGULATORY, E.MACRO) for w in ws]
    found = _told(spark, sf).select("doc_id", E.keywords(F.col("said"), words).alias("found"))
    kind, scope, impact = E.event_class(F.col("found"))
    return found.select("doc_id", F.array_join(E.entity_map(F.col("found")), ",").alias("entities"), kind.alias("event_type"), scope.alias("scope"), impact.alias("global_impact"))


@query("SELECT p_partkey, p_name AS title, p_brand AS source FROM part UNION ALL SELECT -p_partkey, p_name, NULL FROM part")
def sc06_split_source(spark, sf):
    p = table(spark, sf, "part")
    titles = p.select("p_partkey", F.concat_ws(" - ", "p_name", "p_brand").alias("t")).union(p.select(-F.col("p_partkey"), "p_name"))
    title, source = E.split_source(F.col("t"))
    return titles.select("p_partkey", title.alias("title"), source.alias("source"))


@query(f"WITH {TICKS} SELECT id, sha256(symbol || '||' || user_id || '||' || ts) AS fingerprint, sha1(id || ':' || user_id) AS fill_key, left(sha256(symbol || ts // 3600000000), 24) AS cluster, left(sha256('e' || id), 32) AS stable_id FROM ticks")
def sc07_fingerprints(spark, sf):
    s = lambda c: F.col(c).cast("string")
    return ticks(spark, sf).select("id", F.sha2(F.concat_ws("||", "symbol", s("user_id"), s("ts")), 256).alias("fingerprint"), F.sha1(F.concat_ws(":", s("id"), s("user_id"))).alias("fill_key"), F.left(F.sha2(F.concat("symbol", F.floor(F.col("ts") / 3600000000).cast("string")), 256), F.lit(24)).alias("cluster"), F.left(F.sha2(F.concat(F.lit("e"), s("id")), 256), F.lit(32)).alias("stable_id"))


_UNIT = "(('0x' || left(sha1({0}), 12))::BIGINT / 281474976710655.0)"


@query("SELECT event_id, round(" + _UNIT.format("event_id::VARCHAR") + ", 9) AS u FROM events")
def sc08_unit_hash(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(E.unit_hash(F.col("event_id").cast("string")), "u", 9))


_PROVIDERS = ("google_news_rss", "gdelt", "rss:sec_filings", "rss:whitehouse", "rss:crypto_media_x", "rss:blog", "Wire ")
_PROVIDER_SQL = "[" + ", ".join(f"'{p}'" for p in _PROVIDERS) + "][1 + id % 7]"


@query(f"WITH {NEWS}, p AS (SELECT id, tier, source, symbol, occurred, lower(trim({_PROVIDER_SQL})) AS p FROM news), r AS (SELECT *, CASE WHEN p = 'google_news_rss' THEN 25 WHEN p = 'gdelt' THEN 18 WHEN p LIKE 'rss:sec%' OR p LIKE 'rss:whitehouse%' THEN 2 WHEN p LIKE 'rss:crypto_media%' THEN 8 WHEN p LIKE 'rss:%' THEN 6 ELSE 10 END AS low, CASE WHEN p = 'google_news_rss' THEN 110 WHEN p = 'gdelt' THEN 70 WHEN p LIKE 'rss:sec%' OR p LIKE 'rss:whitehouse%' THEN 18 WHEN p LIKE 'rss:crypto_media%' THEN 35 WHEN p LIKE 'rss:%' THEN 30 ELSE 45 END AS high FROM p) SELECT id, round(greatest(0.5, low + (high - low) * " + _UNIT.format("p || '|' || source || '|' || symbol || '|' || id || '|' || occurred") + " + 3.5 * greatest(0, tier - 1)), 6) AS minutes FROM r")
def sc09_latency_prior(spark, sf):
    provider = F.element_at(F.array(*map(F.lit, _PROVIDERS)), (F.col("id") % 7 + 1).cast("int"))
    return news(spark, sf).select("id", r6(E.latency_prior(provider, F.col("tier"), F.col("source"), F.col("symbol"), F.col("id"), F.col("occurred")), "minutes"))


_ENG = "(n_chars + 2 * (doc_id % 50) + 1.8 * (doc_id % 7) + 1.6 * (doc_id % 5) + 0.01 * n_chars)"


@query(f"SELECT doc_id, round({_ENG}, 6) AS engagement, CASE WHEN n_chars * 50 >= 1000000 THEN 'mega' WHEN n_chars * 50 >= 100000 THEN 'macro' WHEN n_chars * 50 >= 10000 THEN 'mid' WHEN n_chars * 50 >= 1000 THEN 'micro' ELSE 'nano' END AS influence, round(ln(1 + {_ENG}) + 0.5 * ln(1 + n_chars * 50) + abs(doc_id % 21 - 10) / 10 + 0.4 * (doc_id % 3), 6) AS heat, round(0.45 * least(1, n_chars * 50 / 100000) + 0.45 * least(1, {_ENG} / 5000) + CASE WHEN trim(coalesce(text, '')) <> '' THEN 0.1 ELSE 0 END, 9) AS coverage FROM documents")
def sc10_engagement(spark, sf):
    i, followers = F.col("doc_id"), F.col("n_chars") * 50
    engaged = E.engagement(F.col("n_chars"), i % 50, i % 7, i % 5, F.col("n_chars"))
    return table(spark, sf, "documents").select("doc_id", r6(engaged, "engagement"), E.influence_tier(followers).alias("influence"), r6(E.heat_score(engaged, followers, (i % 21 - 10) / 10, i % 3), "heat"), r6(E.coverage_score(followers, engaged, F.col("text")), "coverage", 9))


@query(f"WITH {NEWS} SELECT id, round(0.3 * confidence + 0.25 * greatest(0, least(1, (6 - tier) / 5)) + 0.25 * exp(-(available - occurred) / 3.6e9) + 0.2 * (id % 3) / 2, 6) AS quality FROM news")
def sc11_quality_score(spark, sf):
    n = news(spark, sf)
    fresh = F.exp(-(F.col("available") - F.col("occurred")) / 3.6e9)
    return n.select("id", r6(E.quality_score(F.col("confidence"), F.col("tier"), fresh, (F.col("id") % 3) / 2), "quality"))


_LIQ = "least(1, volume / 500)"
_HOURS = (1, 4, 24, 168)
_MULT = "CASE h WHEN 4 THEN 1.6 WHEN 24 THEN 2.4 WHEN 168 THEN 3.2 ELSE 1.0 END::DOUBLE"
_TURN = "greatest(0.01, least(3.0, 0.35 / greatest(1, sqrt(h)) * (1 + 0.8 * least(3, vol / 0.02)) * (1 + 0.5 * (1 - greatest(0, least(1, liq)))) * (1 + 0.25 * least(3, spread / 8)) * (1 + 0.1 * least(3, abs(mu / 1000) / 0.0005))))"
_COSTS = PREDICTIONS + f", c0 AS (SELECT symbol, ts, mu, sigma / 100 AS vol, {_LIQ} AS liq, 10.0::DOUBLE AS spread, h FROM predictions, (VALUES (1), (4), (24), (168)) t(h)), c AS (SELECT *, {_TURN} AS turnover FROM c0)"


#: The costs in basis points, in all, and by component.
_PARTS = {"fee": f"5 * {_MULT}", "slippage": f"(3 + 0.1 * spread) * {_MULT} * (1 + 0.6 * (1 - greatest(0, least(1, liq))))", "impact": f"2 * {_MULT} * (1 + 0.3 * turnover) * (1 + 0.5 * vol)", "funding": "abs(mu / 1000) * h * 1e4", "infra": "(1.88 / 7.2 * h / 50000 * 1e4)::DOUBLE"}
_TOTAL = " + ".join(_PARTS.values())


def costed(spark, sf):
    p = predictions(spark, sf).withColumn("h", F.explode(F.array(*map(F.lit, _HOURS)))).withColumn("liq", F.least(F.lit(1.0), F.col("volume") / 500)).withColumn("vol", F.col("sigma") / 100)
    return p.withColumn("turnover", E.turnover_estimate(F.col("h"), F.col("vol"), F.col("liq"), F.lit(10.0), F.col("mu") / 1000))


@query(f"WITH {_COSTS} SELECT symbol, ts, h, round(turnover, 6) AS turnover FROM c")
def sc12_turnover(spark, sf):
    return costed(spark, sf).select("symbol", "ts", "h", r6(F.col("turnover"), "turnover"))


@query(f"WITH {_COSTS}, p AS (SELECT symbol, ts, h, 5 * {_MULT} AS fee, (3 + 0.1 * spread) * {_MULT} * (1 + 0.6 * (1 - greatest(0, least(1, liq)))) AS slippage, 2 * {_MULT} * (1 + 0.3 * turnover) * (1 + 0.5 * vol) AS impact, abs(mu / 1000) * h * 1e4 AS funding, 1.88 / 7.2 * h / 50000 * 1e4 AS infra FROM c) SELECT symbol, ts, h, round(fee, 6) AS fee, round(slippage, 6) AS slippage, round(impact, 6) AS impact, round(funding, 6) AS funding, round(infra::DOUBLE, 6) AS infra, round(fee + slippage + impact + funding + infra, 6) AS total FROM p")
def sc13_cost_breakdown(spark, sf):
    parts = E.cost_breakdown(F.col("vol"), F.col("liq"), F.col("turnover"), F.col("h"), F.lit(10.0), F.col("mu") / 1000, F.lit(50_000.0))
    return costed(spark, sf).select("symbol", "ts", "h", *(r6(c, n) for n, c in parts.items()))


_KBACK = "close / coalesce(lag(close, {k}) OVER (PARTITION BY symbol ORDER BY ts), first_value(close) OVER (PARTITION BY symbol ORDER BY ts)) - 1"
_BOOK = "greatest(-0.95, least(0.95, tanh(2 * (close - open) / greatest(abs(high - low), greatest(close, 1e-6) * 0.0005))))"


@query(f"WITH {BARS}, r AS (SELECT symbol, ts, {_BOOK} AS imbalance, abs({_KBACK.format(k=1)}) / sqrt(greatest(1, volume)) AS impact FROM bars), x AS (SELECT r.*, h FROM r, (VALUES (1), (4), (24), (168)) t(h)) SELECT symbol, ts, h, round((5 + 3 + 2 + 4 * least(1, abs(imbalance)) + 25 * greatest(0, least(0.02, impact))) * {_MULT} / 1e4, 9) AS cost FROM x")
def sc14_simple_cost(spark, sf):
    imbalance = E.proxy_book(*_C("open", "high", "low", "close", "volume"))["imbalance"]
    r = bars(spark, sf).select("symbol", "ts", imbalance.alias("imbalance"), R.volume_impact().alias("impact")).withColumn("h", F.explode(F.array(*map(F.lit, _HOURS))))
    return r.select("symbol", "ts", "h", r6(E.simple_cost(F.col("imbalance"), F.col("impact"), F.col("h")), "cost", 9))


_VOL = "CASE WHEN rn < 3 THEN 0 ELSE stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {k} PRECEDING AND CURRENT ROW) END"


@query(f"WITH {BARS}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars), f AS (SELECT symbol, ts, {', '.join(f'{_KBACK.format(k=k)} AS ret_{k}' for k in (1, 3, 12, 48))}, {', '.join(f'{_VOL.format(k=k - 1)} AS vol_{k}' for k in (12, 48, 96))}, {_BOOK} AS ob, (trades % 7) / 7 AS tier, least(1, trades / 10) AS conf, (trades % 11 - 5) / 5 AS post FROM r) SELECT symbol, ts, round(0.1 * ret_1 + 0.2 * ret_3 + 0.5 * ret_12 + 0.3 * ret_48 + 0.35 * (0.6 * ret_12 + 0.4 * ret_48) + 0.1 * ob + 0.04 * tier + 0.03 * conf + 0.04 * post - 0.01 * (vol_12 + vol_48 + vol_96), 6) AS score FROM f")
def sc15_signal_score(spark, sf):
    """The terms that bars can give: returns, volatilities and imbalance, and source and social ones from the number of trades."""
    n = F.col("trades")
    b = bars(spark, sf).withColumn("ret", R.log_return())
    given = {f"ret_{k}": R.k_return(k) for k in (1, 3, 12, 48)} | {f"vol_{k}": R.realised_vol(k) for k in (12, 48, 96)}
    given |= {"orderbook_imbalance": E.proxy_book(*_C("open", "high", "low", "close", "volume"))["imbalance"], "source_tier_weight": (n % 7) / 7, "source_confidence": F.least(F.lit(1.0), n / 10), "social_post_sentiment": (n % 11 - 5) / 5}
    f = b.select("symbol", "ts", *(c.alias(k) for k, c in given.items()))
    return f.select("symbol", "ts", r6(E.signal_score({k: F.col(k) for k in given}), "score"))


@query("SELECT tf, CASE right(tf, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 END * left(tf, length(tf) - 1)::BIGINT AS seconds, count(*) AS n FROM (SELECT (p_size)::VARCHAR || CASE p_partkey % 5 WHEN 0 THEN 's' WHEN 1 THEN 'm' WHEN 2 THEN 'h' WHEN 3 THEN 'd' ELSE 'x' END AS tf FROM part) WHERE right(tf, 1) <> 'x' GROUP BY 1, 2")
def sc16_timeframes(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, "smhdx")), (F.col("p_partkey") % 5 + 1).cast("int"))
    t = table(spark, sf, "part").select(F.concat(F.col("p_size").cast("string"), unit).alias("tf"))
    return t.withColumn("seconds", E.timeframe_seconds(F.col("tf"))).where("seconds IS NOT NULL").groupBy("tf", "seconds").agg(F.count("*").alias("n"))


@query(f"WITH {BARS}, s AS (SELECT symbol, ts, close, {_BOOK} AS imbalance, greatest(1, volume / 20) AS size, least(35.0, greatest(1.5, 1.5 + abs(ln(greatest(close, 1e-9) / greatest(open, 1e-9))) * 2800 + 8 / greatest(1, ln(2 + volume)))) AS spread_bps FROM bars) SELECT symbol, ts, round(spread_bps, 6) AS spread_bps, round(imbalance, 6) AS imbalance, round(close * (1 - spread_bps / 2e4), 9) AS bid_px, round(close * (1 + spread_bps / 2e4), 9) AS ask_px, round(size * (1 + imbalance), 6) AS bid_sz, round(size * (1 - imbalance), 6) AS ask_sz FROM s")
def sc17_proxy_book(spark, sf):
    book = E.proxy_book(*_C("open", "high", "low", "close", "volume"))
    return bars(spark, sf).select("symbol", "ts", *(r6(c, n, 9 if n.endswith("px") else 6) for n, c in book.items()))


@query(f"WITH {BARS}, m AS (SELECT symbol, ts FROM bars WHERE trades % 3 = 0) SELECT symbol, ts, round((close - open) * volume, 6) AS flow FROM bars b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.symbol = b.symbol AND m.ts = b.ts)")
def sc18_proxy_flow(spark, sf):
    b = bars(spark, sf)
    known = b.where("trades % 3 = 0").select("symbol", "ts")
    return b.join(known, ["symbol", "ts"], "left_anti").select("symbol", "ts", r6((F.col("close") - F.col("open")) * F.col("volume"), "flow"))


@query(f"WITH {PREDICTIONS} SELECT symbol, ts, round(CASE WHEN abs(mu) < 0.02 THEN 0 ELSE 0.05 * tanh((abs(mu) - 0.02) / 0.08) * (0.4 + 0.6 * p_up) * (1 - 1.2 * 10 / 10000) * CASE WHEN sigma > 1 THEN 0.65 ELSE 1 END END, 6) AS size FROM predictions")
def sc19_position_size(spark, sf):
    return predictions(spark, sf).select("symbol", "ts", r6(E.position_size(F.col("mu"), F.col("p_up"), F.lit(10.0), F.col("sigma") > 1), "size"))


@query(f"WITH {FILLS}, s AS (SELECT order_id, line, CASE WHEN est_price > 0 AND price > 0 THEN CASE WHEN side = 'buy' THEN price - est_price ELSE est_price - price END / est_price * 1e4 ELSE 0 END AS slip FROM fills) SELECT order_id, line, round(slip, 4) AS slippage_bps, round(greatest(0, abs(slip) - 3), 4) AS impact_bps FROM s")
def sc20_slippage_trace(spark, sf):
    slip, impact = E.execution_trace(*_C("side", "est_price", "price"))
    return fills(spark, sf).select("order_id", "line", F.round(slip, 4).alias("slippage_bps"), F.round(impact, 4).alias("impact_bps"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS other, json_exists(props, '$.k') AS has_k FROM events")
def sc21_json_access(spark, sf):
    get = lambda k: F.get_json_object("props", f"$.{k}")
    return table(spark, sf, "events").select("event_id", F.coalesce(get("k").cast("long"), F.lit(-1)).alias("k"), F.coalesce(get("missing"), F.lit("none")).alias("other"), get("k").isNotNull().alias("has_k"))


@query(f"WITH {BARS} SELECT symbol, ts, close::VARCHAR IS NOT NULL AS present, round(close, 6) AS v0, round(volume, 6) AS v1, (trades < 2)::INT AS m0, 0 AS m1, 4 AS width FROM bars")
def sc22_flat_vector(spark, sf):
    block = F.struct(F.col("close").cast("double").alias("close"), "volume", (F.col("trades") < 2).cast("int").alias("missing"))
    context = F.create_map(F.lit("1h"), block, F.lit("4h"), F.struct(F.col("volume").alias("close"), F.col("volume"), F.lit(0).alias("missing")))
    tfs = F.array(F.lit("1h"), F.lit("4h"))
    b = bars(spark, sf).withColumn("context", context)
    values = F.flatten(F.transform(tfs, lambda t: F.array(F.col("context")[t]["close"], F.col("context")[t]["volume"])))
    mask = F.flatten(F.transform(tfs, lambda t: F.array(F.col("context")[t]["missing"])))
    return b.select("symbol", "ts", values.alias("v"), mask.alias("m")).select("symbol", "ts", F.col("v").isNotNull().alias("present"), r6(F.col("v")[0], "v0"), r6(F.col("v")[1], "v1"), F.col("m")[0].alias("m0"), F.col("m")[1].alias("m1"), F.size("v").alias("width"))

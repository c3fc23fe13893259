"""Column expressions: text, scores and costs. All of them stay visible to the optimizer."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and signs of the sentiment score.
POSITIVE = ("bull", "bullish", "breakout", "adoption", "growth", "surge", "rally", "beat", "upgrade", "launch", "partnership", "approval", "record", "strong", "gain")
NEGATIVE = ("bear", "bearish", "crash", "drop", "hack", "lawsuit", "fraud", "ban", "downgrade", "delay", "selloff", "outage", "weak", "decline", "loss")
NEGATIONS = ("not", "no", "never", "none", "without", "hardly", "barely", "n't")
BOOSTERS = ("very", "extremely", "massively", "strongly", "super", "highly", "deeply")
DAMPERS = ("slightly", "somewhat", "kinda", "kindof", "kind-of", "mildly", "barely")
HAPPY = ("🚀", "📈", "🟢", "💚", "🔥", "✅")
SAD = ("📉", "🔴", "💥", "❌", "🧨", "⚠️")
SARCASM = ("/s", "yeah right", "as if", "sure buddy")
# Weights of the signal score, by feature.
SIGNAL_WEIGHTS = {
    "ret_1": 0.10, "ret_3": 0.20, "ret_12": 0.50, "ret_48": 0.30, "trend_bias": 0.35, "orderbook_imbalance": 0.10, "funding_rate": 0.08, "onchain_norm": 0.07, "event_decay": 0.05,
    "source_tier_weight": 0.04, "source_confidence": 0.03, "social_post_sentiment": 0.04, "social_comment_sentiment": 0.03, "social_engagement_norm": 0.02, "social_influence_norm": 0.01,
    "social_event_ratio": 0.02, "social_buzz": 0.02, "vol_penalty": -0.01,
}
# Words of the keyword sentiment of imported posts, and of enriched texts.
IMPORT_POSITIVE = ("bull", "bullish", "surge", "rally", "upgrade", "approval")
IMPORT_NEGATIVE = ("bear", "bearish", "crash", "drop", "hack", "lawsuit", "ban")
ENRICH_POSITIVE = ("bull", "bullish", "rally", "surge", "growth", "beat", "approval", "上涨", "利好", "看涨")
ENRICH_NEGATIVE = ("bear", "bearish", "crash", "drop", "hack", "lawsuit", "ban", "下跌", "暴跌", "利空")
# Names that stand for a symbol, capital words that are none, and keywords of symbols.
ALIASES = {"BTC": "BTC", "BITCOIN": "BTC", "XBT": "BTC", "ETH": "ETH", "ETHEREUM": "ETH", "SOL": "SOL", "SOLANA": "SOL"}
NO_TICKERS = ("THE", "WITH", "FROM", "THIS", "THAT")
ENTITY_KEYWORDS = {
    "BTC": ("bitcoin", "btc", "比特币"), "ETH": ("ethereum", "eth", "以太坊"), "SOL": ("solana", "sol", "索拉纳"), "BNB": ("bnb", "binance"), "XRP": ("xrp", "ripple"),
    "ADA": ("ada", "cardano", "艾达"), "DOGE": ("doge", "dogecoin", "狗狗币"), "TRX": ("trx", "tron"), "AVAX": ("avax", "avalanche"), "LINK": ("link", "chainlink"),
}
FALLBACK_ENTITY = "US_MACRO"
# Words that make an event regulatory, and those that make it macroeconomic.
REGULATORY = ("sec", "regulation", "policy", "ban", "law", "enforcement", "监管", "禁令", "执法")
MACRO = ("federal reserve", "fomc", "cpi", "inflation", "interest rate", "unemployment", "trump", "election", "etf", "blackrock", "fidelity", "treasury", "fed", "美联储", "通胀", "利率", "特朗普", "大选", "贝莱德")
# Minutes of delay, from and to, by how a provider's name begins (in this order), and for all others.
OFFICIAL = ("rss:federal_reserve", "rss:sec", "rss:cftc", "rss:whitehouse")
DELAYS = ((("google_news_rss",), 25.0, 110.0), (("gdelt",), 18.0, 70.0), (OFFICIAL, 2.0, 18.0), (("rss:crypto_media",), 8.0, 35.0), (("rss:",), 6.0, 30.0))
OTHER_DELAY = (10.0, 45.0)
# Scores of start-up event types.
STARTUP_SCORES = {"funding": 1.0, "mna": 0.7, "product": 0.4, "regulatory": -0.3}


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b) by IEEE rules, as SQL engines other than Spark have it: a zero divisor and a zero ratio give infinities, and what has no logarithm NaN."""
    a, b = a.cast("double"), b.cast("double")
    nan, far = F.lit(float("nan")), F.lit(float("inf"))
    ratio = F.when(b != 0, a / b).when(b == 0, F.when((a == 0) | F.isnan(a), nan).when(a > 0, far).when(a < 0, -far))
    return F.when(ratio == 0, -far).when(ratio < 0, nan).otherwise(F.log(ratio))


@dataclass(frozen=True)
class CostProfile:
    """Basis points, multipliers by horizon in hours, and sensitivities; the standard profile."""

    fee_bps: float = 5.0
    slippage_bps: float = 3.0
    impact_bps: float = 2.0
    multipliers: tuple = ((1, 1.0), (4, 1.6), (24, 2.4), (168, 3.2))
    liquidity: float = 0.6
    turnover: float = 0.3
    funding: float = 1.0
    infra_usd_per_hour: float = 1.88 / 7.2
    infra_bps_per_hour: float = 0.0


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def _in(c: Column, words) -> Column:
    return c.isin(*words)


def _count_of(text: Column, signs) -> Column:
    """How many of the signs occur in the text."""
    return sum((F.contains(text, F.lit(x)).cast("double") for x in signs), F.lit(0.0))


def lexicon_sentiment(text: Column) -> Column:
    """Weighted mean of signed words in [-1, 1]: turned by a negation within two words, weighted by modifiers there, with emoji at 0.6, raised by ! and halved by sarcasm. Null and empty texts have 0.

    Words are split once, signed ones are found by their places, and only these look at the two words before them.
    """
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    known = F.struct(
        F.regexp_extract_all(low, F.lit("([a-z']+|[0-9]+)"), F.lit(1)).alias("words"), _count_of(text, HAPPY).alias("happy"), _count_of(text, SAD).alias("sad"),
        F.regexp_count(text, F.lit("!")).alias("bangs"), F.when(_count_of(low, SARCASM) > 0, 0.5).otherwise(1.0).alias("irony"),
    )

    def score(k):
        words = k["words"]
        places = F.filter(F.transform(words, lambda w, i: F.when(_in(w, POSITIVE + NEGATIVE), i)), lambda i: i.isNotNull())

        def step(acc, i):
            a, b = F.coalesce(F.get(words, i - 1), F.lit("")), F.coalesce(F.get(words, i - 2), F.lit(""))
            negated = _in(a, NEGATIONS) | _in(b, NEGATIONS) | F.endswith(a, F.lit("n't")) | F.endswith(b, F.lit("n't"))
            amp = F.when(_in(a, BOOSTERS) | _in(b, BOOSTERS), 1.35).otherwise(1.0) * F.when(_in(a, DAMPERS) | _in(b, DAMPERS), 0.7).otherwise(1.0)
            sign = F.when(_in(F.get(words, i), POSITIVE), 1.0).otherwise(-1.0) * F.when(negated, -1.0).otherwise(1.0)
            return F.struct((acc["raw"] + sign * amp).alias("raw"), (acc["weight"] + amp).alias("weight"))

        def finish(acc):
            weight = acc["weight"] + 0.6 * (k["happy"] + k["sad"])
            mean = (acc["raw"] + 0.6 * (k["happy"] - k["sad"])) / weight
            return F.when(weight > 1e-9, clamp(mean * F.least(F.lit(1.25), 1 + 0.03 * k["bangs"]) * k["irony"], -1.0, 1.0)).otherwise(0.0)

        return F.aggregate(places, F.struct(F.lit(0.0).alias("raw"), F.lit(0.0).alias("weight")), step, finish)

    # As the element of a list what is known of a text is worked out once, however often the score names it.
    return F.element_at(F.transform(F.array(known), score), 1)


def keywords(text: Column, words: Sequence[str]) -> Column:
    """The different words that occur anywhere in the lower-cased text, in one scan for all of them.

    At every place the longest word that begins there is found; the words that it begins with are there as well. So no
    word hides another, wherever they overlap. A null text has none.
    """
    longest = sorted(dict.fromkeys(words), key=lambda w: (-len(w), w))
    begins = F.create_map(*(x for w in longest for x in (F.lit(w), F.array(*(F.lit(v) for v in longest if w.startswith(v))))))
    pattern = "(?=(" + "|".join(re.escape(w) for w in longest) + "))"
    hits = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))
    return F.coalesce(F.array_distinct(F.flatten(F.transform(hits, lambda w: F.element_at(begins, w)))), F.array().cast("array<string>"))


def number_of(found: Column, words: Sequence[str]) -> Column:
    """How many of the words are among those found."""
    return F.size(F.array_intersect(found, F.array(*map(F.lit, words))))


def keyword_sentiment(found: Column, positive: Sequence[str] = IMPORT_POSITIVE, negative: Sequence[str] = IMPORT_NEGATIVE) -> Column:
    """(positive words - negative words) / both, of words found by keywords(); 0 without any."""
    p, n = number_of(found, positive), number_of(found, negative)
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)


def language_hint(text: Column) -> Column:
    """zh where a Han character occurs, else en where a letter A-Z or a-z does, else other."""
    return F.when(text.rlike("[\\x{4e00}-\\x{9fff}]"), "zh").when(text.rlike("[A-Za-z]"), "en").otherwise("other")


def _word(pattern: str) -> str:
    """A match that no letter, digit or underscore of any script touches."""
    return rf"(?<![\p{{L}}\p{{N}}_])({pattern})(?![\p{{L}}\p{{N}}_])"


def tickers(text: Column, aliases: Mapping[str, str] = ALIASES, stop: Sequence[str] = NO_TICKERS, cap: int = 5) -> Column:
    """The first `cap` different symbols: first words of 3 to 16 letters that are an alias, in any case, then capital words of 2 to 5 letters that aren't stop words, aliases replaced."""
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    named = F.transform(F.regexp_extract_all(text, F.lit(_word("[A-Za-z]{3,16}")), F.lit(1)), lambda w: F.try_element_at(names, F.upper(w)))
    capital = F.filter(F.regexp_extract_all(text, F.lit(_word("[A-Z]{2,5}")), F.lit(1)), lambda w: ~w.isin(*stop))
    return F.slice(F.array_distinct(F.concat(F.array_compact(named), F.transform(capital, lambda w: F.coalesce(F.try_element_at(names, w), w)))), 1, cap)


def mentions(text: Column, known: Sequence[str] = (), cap: int = 12) -> Column:
    """The first `cap` different runs of 2 to 10 capitals, with or without $; only known ones where any are given."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$?([A-Z]{2,10})"), F.lit(1)))
    return F.slice(F.filter(found, lambda w: w.isin(*known)) if known else found, 1, cap)


def entity_map(found: Column) -> Column:
    """Symbols of which a keyword was found by keywords(), in order; the fallback where there is none."""
    named = F.array_compact(F.array(*(F.when(number_of(found, words) > 0, symbol) for symbol, words in ENTITY_KEYWORDS.items())))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(FALLBACK_ENTITY)))


def event_class(found: Column) -> tuple[Column, Column, Column]:
    """Event type, market scope and whether its impact is global, of words found by keywords()."""
    macro = number_of(found, MACRO) > 0
    return F.when(number_of(found, REGULATORY) > 0, "regulatory").otherwise("market"), F.when(macro, "macro").otherwise("crypto"), macro


def split_source(title: Column) -> tuple[Column, Column]:
    """Title and source at the last ' - '; source null where there is none."""
    has = F.contains(title, F.lit(" - "))
    source = F.substring_index(title, " - ", -1)
    return F.when(has, F.left(title, F.length(title) - F.length(source) - 3)).otherwise(title), F.when(has, source)


def unit_hash(c: Column) -> Column:
    """12 hexadecimal digits of sha1 as a number in [0, 1]."""
    return F.conv(F.substring(F.sha1(c), 1, 12), 16, 10).cast("double") / float(16**12 - 1)


def dropout(values: Column, row: Column, share: float, seed: int) -> Column:
    """values (an array) as doubles, of which about `share` are 0: those whose hash of seed, row and place lies below it."""
    return F.transform(values, lambda v, i: F.when(unit_hash(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), i.cast("string"))) < share, 0.0).otherwise(v.cast("double")))


def latency_prior(provider: Column, tier: Column, source: Column, title: Column, link: Column, occurred: Column) -> Column:
    """Minutes until an event of a provider is known: a place in the provider's range by the hash of what names the event, and 3.5 for every tier below the first; 0.5 at least.

    occurred: the time as text. Provider and source count trimmed and in small letters; nulls as empty.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    p, s = F.lower(F.trim(text(provider))), F.lower(F.trim(text(source)))
    low, high = F.lit(OTHER_DELAY[0]), F.lit(OTHER_DELAY[1])
    for names, a, b in reversed(DELAYS):
        # The first two are whole names, the others beginnings.
        hit = p.isin(*names) if not names[0].startswith("rss:") else F.greatest(*(F.startswith(p, F.lit(n)) for n in names)) if len(names) > 1 else F.startswith(p, F.lit(names[0]))
        low, high = F.when(hit, a).otherwise(low), F.when(hit, b).otherwise(high)
    place = unit_hash(F.concat_ws("|", p, s, text(title), text(link), text(occurred)))
    return F.greatest(F.lit(0.5), low + (high - low) * place + 3.5 * F.greatest(F.lit(0), tier - 1))


def execution_trace(side: Column, est: Column, price: Column, baseline_bps: float = 3.0) -> tuple[Column, Column]:
    """Slippage against the estimate, positive if it is a loss, and impact, its size beyond the baseline; 0 without both prices."""
    known = (est > 0) & (price > 0)
    slip = F.when(known, F.when(F.lower(F.trim(side)) == "buy", price - est).otherwise(est - price) / est * 1e4).otherwise(0.0)
    return slip, F.greatest(F.lit(0.0), F.abs(slip) - baseline_bps)


def engagement(likes: Column, comments: Column, shares: Column, quotes: Column, views: Column) -> Column:
    return likes + 2 * comments + 1.8 * shares + 1.6 * quotes + 0.01 * views


def influence_tier(followers: Column) -> Column:
    """By followers: mega, macro, mid, micro and nano."""
    return F.when(followers >= 1_000_000, "mega").when(followers >= 100_000, "macro").when(followers >= 10_000, "mid").when(followers >= 1_000, "micro").otherwise("nano")


def heat_score(engaged: Column, followers: Column, sentiment: Column, mentions: Column) -> Column:
    """How hot a post is: logarithms of engagement and followers, strength of its sentiment, wanted symbols mentioned."""
    zero = F.lit(0.0)
    return F.log1p(F.greatest(zero, engaged)) + 0.5 * F.log1p(F.greatest(zero, followers)) + F.abs(sentiment) + 0.4 * mentions


def coverage_score(followers: Column, engaged: Column, text: Column) -> Column:
    """In [0, 1]: followers against 100,000, engagement against 5,000, and whether there is a text."""
    return 0.45 * clamp(followers / 100_000, 0.0, 1.0) + 0.45 * clamp(engaged / 5_000, 0.0, 1.0) + F.when(F.coalesce(F.trim(text), F.lit("")) != "", 0.1).otherwise(0.0)


def tier_weight(tier: Column) -> Column:
    return clamp((6 - tier) / 5, 0.0, 1.0)


def quality_score(confidence: Column, tier: Column, freshness: Column, coverage: Column) -> Column:
    return 0.3 * confidence + 0.25 * tier_weight(tier) + 0.25 * freshness + 0.2 * coverage


def liquidity_score(score: Column, depth: Column) -> Column:
    """The given score, or where it isn't positive, one from the book's depth."""
    return clamp(F.when(score > 0, score).otherwise(F.greatest(depth, F.lit(0.0)) / (depth + 1e6)), 0.0, 1.0)


def turnover_estimate(horizon_hours: Column, vol: Column, liquidity: Column, spread_bps: Column, funding: Column, base: float = 0.35, vol_ref: float = 0.02, vol_beta: float = 0.8, liquidity_beta: float = 0.5, spread_ref: float = 8.0, spread_beta: float = 0.25, funding_ref: float = 5e-4, funding_beta: float = 0.1, low: float = 0.01, high: float = 3.0) -> Column:
    """Turnover of a position held for the horizon: falls with its root, rises with volatility, spread and funding (each up to three times its reference) and with poor liquidity."""

    def rises(c: Column, ref: float, beta: float) -> Column:
        return 1 + beta * F.least(F.lit(3.0), F.abs(c) / ref)

    scaled = base / F.greatest(F.lit(1.0), F.sqrt(horizon_hours)) * rises(vol, vol_ref, vol_beta) * (1 + liquidity_beta * (1 - clamp(liquidity, 0.0, 1.0)))
    return clamp(scaled * rises(spread_bps, spread_ref, spread_beta) * rises(funding, funding_ref, funding_beta), low, high)


def horizon_multiplier(horizon_hours: Column, profile: CostProfile = CostProfile()) -> Column:
    """The profile's multiplier of the horizon; that of an hour for horizons it doesn't name."""
    m = F.when(horizon_hours == profile.multipliers[0][0], profile.multipliers[0][1])
    for hours, by in profile.multipliers[1:]:
        m = m.when(horizon_hours == hours, by)
    return m.otherwise(dict(profile.multipliers).get(1, 1.0))


def cost_breakdown(vol: Column, liquidity: Column, turnover: Column, horizon_hours: Column, spread_bps: Column | None = None, funding: Column | None = None, notional: Column | None = None, impact_scale: float = 1.0, profile: CostProfile = CostProfile()) -> dict[str, Column]:
    """Costs in basis points of notional by component, and in all. What isn't given counts as 0; without a notional the infrastructure costs what the profile says for an hour."""
    spread_bps, funding, notional = (F.lit(0.0) if c is None else c for c in (spread_bps, funding, notional))
    m = horizon_multiplier(horizon_hours, profile)
    infra = F.when(notional > 1e-9, profile.infra_usd_per_hour * horizon_hours / notional * 1e4).otherwise(profile.infra_bps_per_hour * horizon_hours)
    parts = {
        "fee": profile.fee_bps * m,
        "slippage": (profile.slippage_bps + 0.1 * spread_bps) * m * (1 + profile.liquidity * (1 - clamp(liquidity, 0.0, 1.0))),
        "impact": profile.impact_bps * m * impact_scale * (1 + profile.turnover * turnover) * (1 + 0.5 * F.greatest(F.lit(0.0), vol)),
        "funding": F.abs(funding) * profile.funding * horizon_hours * 1e4,
        "infra": infra,
    }
    parts = {k: F.greatest(F.lit(0.0), c) for k, c in parts.items()}
    return parts | {"total": sum(parts.values(), F.lit(0.0))}


def simple_cost(imbalance: Column, volume_impact: Column, horizon_hours: Column, imbalance_bps: float = 4.0, profile: CostProfile = CostProfile()) -> Column:
    """Share of notional: fee, slippage and impact (by imbalance of the book and by volume) times the horizon's multiplier."""
    impact = profile.impact_bps + imbalance_bps * F.least(F.lit(1.0), F.abs(imbalance)) + 25.0 * clamp(volume_impact, 0.0, 0.02)
    return (profile.fee_bps + profile.slippage_bps + impact) * horizon_multiplier(horizon_hours, profile) / 1e4


def signal_score(features: dict[str, Column]) -> Column:
    """Weighted sum of features by name; one that isn't given counts as 0. The trend is 0.6 of ret_12 and 0.4 of ret_48, the volatility penalty the sum of vol_12, vol_48 and vol_96 without their signs."""
    get = lambda n: F.coalesce(features[n], F.lit(0.0)) if n in features else F.lit(0.0)
    made = {"trend_bias": 0.6 * get("ret_12") + 0.4 * get("ret_48"), "vol_penalty": F.abs(get("vol_12")) + F.abs(get("vol_48")) + F.abs(get("vol_96"))}
    return sum((w * made.get(n, get(n)) for n, w in SIGNAL_WEIGHTS.items()), F.lit(0.0))


def proxy_book(open_: Column, high: Column, low: Column, close: Column, volume: Column, min_spread: float = 1.5, max_spread: float = 35.0, return_k: float = 2800.0, depth_k: float = 8.0, min_size: float = 1.0, size_div: float = 20.0, imbalance_k: float = 2.0) -> dict[str, Column]:
    """A book that a bar stands for: spread_bps, imbalance, bid_px, ask_px, bid_sz, ask_sz."""
    tiny = F.lit(1e-9)
    volume = F.greatest(F.lit(0.0), F.coalesce(volume, F.lit(0.0)))
    spread = clamp(min_spread + F.abs(F.log(F.greatest(close, tiny) / F.greatest(open_, tiny))) * return_k + depth_k / F.greatest(F.lit(1.0), F.log(2 + volume)), min_spread, max_spread)
    imbalance = clamp(F.tanh(imbalance_k * (close - open_) / F.greatest(F.abs(high - low), F.greatest(close, F.lit(1e-6)) * 0.0005)), -0.95, 0.95)
    size = F.greatest(F.lit(min_size), volume / size_div)
    return {"spread_bps": spread, "imbalance": imbalance, "bid_px": close * (1 - spread / 2e4), "ask_px": close * (1 + spread / 2e4), "bid_sz": size * (1 + imbalance), "ask_sz": size * (1 - imbalance)}


def startup_vector(kind: Column, tier: Column, confidence: Column, importance: Column, novelty: Column) -> Column:
    """Score of the event type, of the source's tier (5 where unknown), confidence, importance and novelty (0 where unknown)."""
    score = F.lit(0.0)
    for name, value in STARTUP_SCORES.items():
        score = F.when(F.lower(F.trim(kind)) == name, value).otherwise(score)
    known = (F.coalesce(c, F.lit(0.0)).cast("double") for c in (confidence, importance, novelty))
    return F.array(score, (6 - F.coalesce(tier, F.lit(5.0))) / 5.0, *known)


def startup_targets(kind: Column, confidence: Column, importance: Column, novelty: Column) -> dict[str, Column]:
    """Labels after 6, 12 and 24 months, exit, and the multiple to learn, from what an event says."""
    confidence, importance, novelty = (F.coalesce(c, F.lit(0.0)) for c in (confidence, importance, novelty))
    kind = F.coalesce(F.lower(F.trim(kind)), F.lit(""))
    y6, y12 = (kind == "funding").cast("double"), kind.isin("funding", "mna").cast("double")
    y24 = ((y12 > 0) | (kind == "product") | (confidence >= 0.8)).cast("double")
    multiple = 0.8 + 1.0 * y6 + 1.2 * y12 + 0.8 * y24 + 0.4 * confidence + 0.3 * importance + 0.2 * novelty
    return {"y6": y6, "y12": y12, "y24": y24, "y_exit": 1 - y24, "multiple": clamp(multiple, 0.2, 8.0)}


def timeframe_seconds(tf: Column) -> Column:
    """'5m', '4h', '1d' as seconds; null for anything else."""
    unit = F.regexp_extract(tf, "^([1-9][0-9]*)([smhd])$", 2)
    n = F.regexp_extract(tf, "^([1-9][0-9]*)([smhd])$", 1).try_cast("bigint")
    return n * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)


def position_size(score: Column, confidence: Column, cost_bps: Column, high_vol: Column, entry: float = 0.02, max_weight: float = 0.05, high_vol_mult: float = 0.65, cost_lambda: float = 1.2) -> Column:
    """Weight of a position: none below the entry score, then saturating, more with confidence, less with cost and in high volatility."""
    over = F.tanh((F.abs(score) - entry) / max(1e-9, 4 * entry))
    cost = F.greatest(F.lit(0.1), 1 - cost_lambda * F.greatest(F.lit(0.0), cost_bps) / 1e4)
    size = max_weight * over * (0.4 + 0.6 * clamp(confidence, 0.0, 1.0)) * cost * F.when(high_vol, high_vol_mult).otherwise(1.0)
    return F.when(F.abs(score) < entry, 0.0).otherwise(F.greatest(F.lit(0.0), size))


def stirling_lgamma(x: Column) -> Column:
    """Log gamma by Stirling's series, shifted up by 6 first; about 1e-9 for x > 0."""
    y = x + 6
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return series - sum((F.log(x + k) for k in range(6)), F.lit(0.0))

"""Feature contract, labels, samples and splits."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import asof_join, asof_wide
from .order import quantiles
from .rolling import by, trailing_row


@dataclass(frozen=True)
class Feature:
    """One value of the vector. impute: zero, or median, or ffill."""

    name: str
    group: str = "price"
    impute: str = "zero"
    required: bool = False


def contract_hash(features: Sequence[Feature]) -> str:
    """Of the features sorted by name, as canonical JSON."""
    rows = [asdict(f) for f in sorted(features, key=lambda f: f.name)]
    return hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def check_columns(columns: Sequence[str], features: Sequence[Feature], keys: Sequence[str]) -> None:
    """Raises on features that are unknown, and on required ones that are missing."""
    names = {f.name for f in features}
    extra = set(columns) - names - set(keys)
    lacking = {f.name for f in features if f.required} - set(columns)
    if extra or lacking:
        raise ValueError(f"unknown features {sorted(extra)}, missing required features {sorted(lacking)}")


def align(df: DataFrame, features: Sequence[Feature], keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """values and mask (1 = missing) in name order, and schema_hash. A feature without a column is missing in every row.

    A median is an exact selection over the table, forward fill one window for all such features; columns stay scalar
    until the last step.
    """
    check_columns(df.columns, features, keys)
    ordered = sorted(features, key=lambda f: f.name)
    there = [f for f in ordered if f.name in df.columns]
    medians = [f.name for f in there if f.impute == "median"]
    if medians:
        for c in medians:
            df = df.crossJoin(F.broadcast(quantiles(df, [], c, {f"__median_{c}": 0.5})))
    last = Window.partitionBy(keys[0]).orderBy(keys[1]).rowsBetween(Window.unboundedPreceding, 0)

    def value(f: Feature) -> Column:
        if f.name not in df.columns:
            return F.lit(0.0)
        c = F.col(f.name).cast("double")
        fill = F.col(f"__median_{f.name}") if f.impute == "median" else F.last(c, ignorenulls=True).over(last) if f.impute == "ffill" else F.lit(0.0)
        return F.coalesce(c, fill, F.lit(0.0))

    mask = [F.col(f.name).isNull().cast("byte") if f.name in df.columns else F.lit(1).cast("byte") for f in ordered]
    return df.select(*keys, F.array(*map(value, ordered)).cast("array<float>").alias("values"), F.array(*mask).alias("mask"), F.lit(contract_hash(features)).alias("schema_hash"))


def merge_block(df: DataFrame, block: str, at: int, width: int, missing: str) -> DataFrame:
    """values and mask with positions at .. at + width - 1 from the array column block; where `missing` is 1 the mask is."""
    inside = lambda i: (i >= at) & (i < at + width)
    new = F.transform("values", lambda v, i: F.when(inside(i), F.coalesce(F.get(F.col(block), i - at).cast("float"), F.lit(0.0).cast("float"))).otherwise(v))
    mask = F.transform("mask", lambda m, i: F.when(inside(i), F.col(missing).cast("byte")).otherwise(m))
    return df.withColumn("values", new).withColumn("mask", mask)


def labels(df: DataFrame, horizons: dict[str, int], cost_bps: Column, price: str = "close") -> DataFrame:
    """One row for each row and horizon with a future price: raw, cost, net, direction, risk."""
    future = [F.struct(F.lit(h).alias("horizon"), F.lead(price, k).over(by()).alias("future")) for h, k in horizons.items()]
    # The filter works on the array, so that it stays above the window.
    known = df.withColumn("__f", F.array(*future)).withColumn("__f", F.filter("__f", lambda x: x["future"].isNotNull()))
    rows = known.select(*df.columns, F.explode("__f").alias("f"))
    raw, cost = F.log(F.col("f.future") / F.col(price)), cost_bps / 1e4
    return rows.select(*df.columns, "f.horizon", raw.alias("raw"), cost.alias("cost"), (raw - F.signum(raw) * cost).alias("net"), F.signum(raw).cast("int").alias("direction"), F.abs(raw).alias("risk"))


def path_labels(df: DataFrame, step: int, price: str = "close") -> DataFrame:
    """Deviation of the returns 2 .. step ahead, and the worst fall below the next price."""
    ahead = lambda a: by().rowsBetween(a, step)
    r = df.withColumn("__r", F.log(F.col(price) / F.lag(price).over(by())))
    first = F.lead(price, 1).over(by())
    return r.withColumn("future_vol", F.stddev_pop("__r").over(ahead(2))).withColumn("future_drawdown", F.min(price).over(ahead(1)) / first - 1).drop("__r")


def sample_index(df: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """Rows that have a full lookback before them and a full horizon after them, with their number t_idx and label_ts, the time of the row `horizon` later."""
    if horizon < 1:
        raise ValueError(f"a label {horizon} rows ahead would be known already")
    rows = df.withColumn("t_idx", F.row_number().over(by()) - 1).withColumn("label_ts", F.lead("ts", horizon).over(by()))
    return rows.where((F.col("t_idx") + 1 >= lookback) & F.col("label_ts").isNotNull())


def leaks(samples: DataFrame) -> DataFrame:
    """Samples whose label doesn't lie ahead of them: repeated times, or a series that isn't in order."""
    return samples.where(F.col("label_ts") <= F.col("ts"))


def walk_forward(start: int, end: int, train: int, val: int, test: int, gap: int, step: int) -> list[tuple]:
    """(fold, split, from, to) of purged folds: a gap before val and before test."""
    out, fold, at = [], 0, start
    while at + train + gap + val + gap + test <= end:
        val_from = at + train + gap
        test_from = val_from + val + gap
        out += [(fold, "train", at, at + train), (fold, "val", val_from, val_from + val), (fold, "test", test_from, test_from + test)]
        fold, at = fold + 1, at + step
    return out


def assign_folds(df: DataFrame, folds: list[tuple], on: str = "ts") -> DataFrame:
    """df once for each fold and split that holds it. The fold table is small: one row for each fold and split."""
    table = df.sparkSession.createDataFrame(folds, "fold int, split string, __from long, __to long")
    return df.join(F.broadcast(table), (F.col(on) >= F.col("__from")) & (F.col(on) < F.col("__to"))).drop("__from", "__to")


def check_dims(df: DataFrame, vector: str, dims: int, most: float = 0.0) -> dict:
    """n, mismatched and ratio of vectors that don't have dims values; raises where the ratio is above `most`."""
    row = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != dims).alias("mismatched")).first()
    ratio = row.mismatched / max(1, row.n)
    if ratio > most:
        raise ValueError(f"{row.mismatched} of {row.n} vectors don't have {dims} values")
    return {"n": row.n, "mismatched": row.mismatched, "ratio": ratio}


def row_folds(df: DataFrame, train: int, test: int, purge: int, step: int | None = None) -> DataFrame:
    """df once for each walk-forward fold and split ("train", "test") that holds it, by row numbers of each symbol: purge rows lie between train and test, folds start step (test) rows apart and are whole."""
    step = step or test
    n = F.count("*").over(Window.partitionBy("symbol"))
    d = df.withColumn("__i", F.row_number().over(by()) - 1).withColumn("__n", n)
    i, last = F.col("__i"), F.floor((F.col("__n") - train - purge - test) / step)

    def folds(split: str, a: int, to: int) -> Column:
        """The folds k for which row i lies in [k * step + a, k * step + to)."""
        low, high = F.greatest(F.lit(0), F.ceil((i - to + 1) / step)).cast("int"), F.least(last, F.floor((i - a) / step)).cast("int")
        found = F.transform(F.sequence(low, F.greatest(low, high)), lambda k: F.struct(k.alias("fold"), F.lit(split).alias("split")))
        return F.when(high >= low, found).otherwise(F.array().cast("array<struct<fold:int,split:string>>"))

    both = F.concat(folds("train", 0, train), folds("test", train + purge, train + purge + test))
    return d.withColumn("__f", F.explode(both)).select(*df.columns, "__f.fold", "__f.split")


def ridge(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, l2: float = 1.0) -> DataFrame:
    """keys and weights (array, in the order of features) of ridge regressions without intercept, one for each key.

    The sums of products are one aggregate over all rows; a key's small system of equations is solved in one task.
    """
    k = len(features)
    pairs = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    sums = df.groupBy(*keys).agg(*pairs, *(F.sum(F.col(a) * F.col(target)).alias(f"t{i}") for i, a in enumerate(features)))
    packed = sums.select(*keys, F.array(*(F.col(f"g{min(i, j)}_{max(i, j)}") + (l2 if i == j else 0.0) for i in range(k) for j in range(k))).alias("g"), F.array(*(f"t{i}" for i in range(k))).alias("t"))

    @F.pandas_udf("array<double>")
    def solve(g: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.solve(np.array(a, float).reshape(k, k), np.array(b, float)) for a, b in zip(g, t)])

    return packed.select(*keys, solve("g", "t").alias("weights"))


def merge_views(rows: DataFrame, text: DataFrame, at: int, width: int, max_age: int | None = None) -> DataFrame:
    """Rows (symbol, ts, values, mask) with the latest text vector (symbol, ts, block) at or before them in positions at .. at + width - 1.

    text_case says what was there: "fresh", "stale" (older than max_age: the block counts as missing), or "none" (the
    block is zeros and missing). text_lag_sec is the age of what was found, whether it counts or not.
    """
    found = asof_join(rows, text, ["symbol"], {"__block": "block"}, tie="ts")
    lag = F.col("ts") - F.col("right_ts")
    case = F.when(F.col("right_ts").isNull(), "none").when(lag > (max_age if max_age is not None else 1 << 62), "stale").otherwise("fresh")
    found = found.withColumn("text_case", case).withColumn("__miss", (F.col("text_case") != "fresh").cast("int")).withColumn("__block", F.when(F.col("text_case") == "fresh", F.col("__block")))
    return merge_block(found, "__block", at, width, "__miss").select(*rows.columns, "text_case", (lag / 1e6).alias("text_lag_sec"))


def with_block(rows: DataFrame, right: DataFrame, name: str, values: dict[str, str], max_age: int | None = None, tie: str = "ts") -> DataFrame:
    """rows with the latest values of another series of the symbol, how old they are (<name>_lag_sec) and whether there are none that are fresh enough (<name>_missing)."""
    found = asof_join(rows, right, ["symbol"], values, tie=tie, max_age=max_age)
    return found.withColumn(f"{name}_lag_sec", (F.col("ts") - F.col("right_ts")) / 1e6).withColumnRenamed("missing", f"{name}_missing").drop("right_ts")


# Metrics of the feature row, in its order, and the features of the event profile, in its order.
MARKET = ("orderbook_imbalance", "funding_rate", "onchain_flow")
DERIVATIVES = ("long_short_ratio_global_accounts", "long_short_ratio_top_accounts", "long_short_ratio_top_positions", "taker_buy_sell_ratio", "basis_rate", "annualized_basis_rate")
PROFILE = (
    "source_tier_weight", "source_confidence", "social_post_sentiment", "social_comment_sentiment", "social_engagement_norm", "social_influence_norm", "social_event_ratio", "social_buzz", "event_velocity_1h", "event_velocity_6h", "event_disagreement",
    "source_diversity", "cross_source_consensus", "comment_skew", "event_lag_bucket_0_1h", "event_lag_bucket_1_6h", "event_lag_bucket_6_24h", "event_density", "sentiment_abs", "social_comment_rate", "event_importance_mean", "novelty_confidence_blend",
)


def feature_row(bars: DataFrame, metrics: DataFrame, profile: DataFrame, history: int = 96) -> DataFrame:
    """symbol, ts and values, the 61 features of the start-up row, of bars (close, volume) with `history` bars before them and a profile at their time.

    metrics: symbol, ts, id, metric, value of MARKET and DERIVATIVES; the latest one counts, 0 and a flag where there is
    none. profile: what event_profile gives, event_decay first. Prices fill 20 places, metrics 9 and their flags 9.
    """
    price = trailing_row(bars, history)
    names = [c for c in price.columns if c not in ("symbol", "ts")]
    d = asof_wide(price, metrics, [*MARKET, *DERIVATIVES], ["symbol"]).join(profile, ["symbol", "ts"])
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    ratio = lambda c: F.tanh(F.log(F.greatest(F.lit(1e-9), v(c))))
    shaped = [v("orderbook_imbalance"), v("funding_rate"), F.tanh(v("onchain_flow") / 1e6), *(ratio(c) for c in DERIVATIVES[:4]), F.tanh(25 * v("basis_rate")), F.tanh(5 * v("annualized_basis_rate"))]
    flags = [F.col(f"{c}_missing").cast("double") for c in (*MARKET, *DERIVATIVES)]
    return d.select("symbol", "ts", F.array(*(v(c) for c in names), *shaped, v("event_decay"), *flags, *(v(c) for c in PROFILE)).alias("values"))


def synthetic_ratio(flags: Sequence[Column]) -> Column:
    """Share of a row's blocks that are synthetic; a block that is missing is none."""
    return sum((F.coalesce(f.cast("double"), F.lit(0.0)) for f in flags), F.lit(0.0)) / len(flags)


def filled(held: float, cost: float, realised: float, qty: float, price: float) -> tuple[float, float, float]:
    """Quantity, average cost and realised result after one more fill (qty signed): a flip begins a new basis."""
    new = held + qty
    if held == 0 or (held > 0) == (qty > 0):
        return new, (cost * abs(held) + price * abs(qty)) / abs(new) if new else 0.0, realised
    closed = min(abs(held), abs(qty)) * (1 if held > 0 else -1)
    return new, 0.0 if new == 0 else price if (new > 0) != (held > 0) else cost, realised + closed * (price - cost)


def positions(fills: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, qty, avg_cost, realised and unrealised (at the last price) of ordered fills (qty signed, price), by average cost.

    Fills are sorted by key and order, and one pass over a sorted partition keeps the state of one key alone: memory is
    bounded by a batch of rows, however long a key's history. Fills without a quantity or a price don't count; a null
    key is a key; a key without any fill that counts isn't there.
    """
    known = fills.dropna(subset=["qty", "price"]).select(*keys, *order, F.col("qty").cast("double").alias("__qty"), F.col("price").cast("double").alias("__price"))
    ordered = known.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "__qty", "__price")
    n, schema = len(keys), [f"{c} {known.schema[c].dataType.simpleString()}" for c in keys]
    names = [*keys, "qty", "avg_cost", "realised", "unrealised"]

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = last = None
        for part in parts:
            done = []
            for *now, qty, price in zip(*(c.to_pylist() for c in part.columns)):
                if now != key:
                    if key is not None:
                        done.append((*key, *state, (last - state[1]) * state[0]))
                    key, state = now, (0.0, 0.0, 0.0)
                state, last = filled(*state, qty, price), price
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, part.schema.field(k).type if k < n else pa.float64()) for k, c in enumerate(zip(*done))], names=names)
            types = part.schema
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], types.field(k).type if k < n else pa.float64()) for k, c in enumerate((*key, *state, (last - state[1]) * state[0]))], names=names)

    return ordered.mapInArrow(fold, ", ".join([*schema, "qty double", "avg_cost double", "realised double", "unrealised double"]))

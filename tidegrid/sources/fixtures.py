"""The driver's tables as logical inputs, in Spark and as SQL of the same names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str | Column) -> Column:
    """Epoch microseconds of a timestamp with or without a zone (then UTC, as the session's)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: symbol, ts, id, user_id, price, size."""
    size = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), micros("ts").alias("ts"), F.col("event_id").alias("id"), "user_id", F.col("value").alias("price"), size.alias("size"))


def bars(spark: SparkSession, sf_dir: str, width: int = HOUR) -> DataFrame:
    from ..operators.bars import to_bars

    return to_bars(ticks(spark, sf_dir), width)


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of suppliers: symbol, ts, close, volume, trades."""
    order = F.struct("l_orderkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), micros("l_shipdate").alias("ts"))
    return rows.agg(F.max_by(F.col("l_extendedprice") / F.col("l_quantity"), order).alias("close"), F.sum("l_quantity").alias("volume"), F.count("*").alias("trades"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fills of their order: order_id, line, target, side, qty, price, fee, est_price, status, ts, parent."""
    lines, orders, part = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "part"))
    status = F.create_map(*[F.lit(x) for x in ("F", "filled", "P", "partially_filled", "O", "rejected")])
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(part, lines["l_partkey"] == part["p_partkey"])
    return joined.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("target"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_tax") * F.col("l_extendedprice")).alias("fee"),
        F.col("p_retailprice").alias("est_price"), status[F.col("o_orderstatus")].alias("status"), micros("l_shipdate").alias("ts"), micros("o_orderdate").alias("ordered"), F.col("o_custkey").alias("account"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with clocks: id, symbol, occurred, published, available, ts (= available), confidence, tier, sentiment, source."""
    t = ticks(spark, sf_dir)
    available = F.col("ts") + F.col("size") * 1_000_000
    return t.select(
        "id", "symbol", F.col("ts").alias("occurred"), (F.col("ts") + F.col("size") * 500_000).alias("published"), available.alias("available"), available.alias("ts"),
        ((F.col("id") % 100) / 100.0).alias("confidence"), (F.col("id") % 5 + 1).cast("long").alias("tier"), ((F.col("id") % 21 - 10) / 10.0).alias("sentiment"), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("source"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From hourly bars: symbol, ts, mu (last return), sigma (deviation of 12 returns), y (next return), p_up."""
    from pyspark.sql import Window

    by = Window.partitionBy("symbol").orderBy("ts")
    r = bars(spark, sf_dir).withColumn("ret", F.log(F.col("close") / F.lag("close").over(by)))
    rows = r.select("symbol", "ts", F.col("ret").alias("mu"), F.stddev_pop("ret").over(by.rowsBetween(-11, 0)).alias("sigma"), F.lead("ret").over(by).alias("y"), "volume")
    return rows.where("mu IS NOT NULL AND y IS NOT NULL AND sigma > 0").withColumn("p_up", 1 / (1 + F.exp(-F.col("mu") / F.col("sigma"))))


TICKS = "ticks AS (SELECT event_type AS symbol, epoch_us(ts) AS ts, event_id AS id, user_id, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events)"
BARS = TICKS + f", bars AS (SELECT symbol, ts - ts % {HOUR} AS ts, first(price ORDER BY ticks.ts, id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ticks.ts, id) AS close, sum(size)::DOUBLE AS volume, count(*) AS trades FROM ticks GROUP BY 1, ticks.ts - ticks.ts % {HOUR})"
DAYS = "days AS (SELECT l_suppkey AS symbol, epoch_us(l_shipdate) AS ts, last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber) AS close, sum(l_quantity) AS volume, count(*) AS trades FROM lineitem GROUP BY 1, 2)"
FILLS = "fills AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS target, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_quantity AS qty, l_extendedprice / l_quantity AS price, l_tax * l_extendedprice AS fee, p_retailprice AS est_price, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'P' THEN 'partially_filled' WHEN 'O' THEN 'rejected' END AS status, epoch_us(l_shipdate) AS ts, epoch_us(o_orderdate) AS ordered, o_custkey AS account FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
NEWS = TICKS + ", news AS (SELECT id, symbol, ts AS occurred, ts + size * 500000 AS published, ts + size * 1000000 AS available, ts + size * 1000000 AS ts, (id % 100) / 100.0::DOUBLE AS confidence, id % 5 + 1 AS tier, (id % 21 - 10) / 10.0::DOUBLE AS sentiment, 's' || (user_id % 7) AS source FROM ticks)"
PREDICTIONS = BARS + ", pr0 AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS ret FROM bars), pr1 AS (SELECT symbol, ts, ret AS mu, stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS sigma, lead(ret) OVER (PARTITION BY symbol ORDER BY ts) AS y, volume FROM pr0), predictions AS (SELECT *, 1 / (1 + exp(-mu / sigma)) AS p_up FROM pr1 WHERE mu IS NOT NULL AND y IS NOT NULL AND sigma > 0)"

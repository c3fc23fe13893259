"""Reading, writing and merging tables. Plain Parquet has no MERGE, so upserts are unions and ranked rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir, or of its own where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/io-{uuid.uuid4().hex}"


def read_bars(df: DataFrame, symbols: Sequence, start: int, end: int) -> DataFrame:
    """Rows of the symbols in [start, end], in order; both conditions reach the scan."""
    return df.where(F.col("symbol").isin(list(symbols)) & F.col("ts").between(start, end)).orderBy("symbol", "ts")


def with_fallback(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Primary rows, and secondary rows of keys that primary lacks; source_used and price_fallback_used tell which."""
    first = primary.withColumn("source_used", F.lit("primary")).withColumn("price_fallback_used", F.lit(False))
    rest = secondary.join(primary.select(key).distinct(), key, "left_anti").select(*primary.columns)
    return first.unionByName(rest.withColumn("source_used", F.lit("secondary")).withColumn("price_fallback_used", F.lit(True)))


def latest(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row for each key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last write wins: of each key the row with the greatest seq."""
    return latest(old.unionByName(new), keys, F.desc(seq))


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First write wins: the old rows, and new rows of new keys."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def replace_window(old: DataFrame, new: DataFrame, key: str, values: Sequence, start: int, end: int) -> DataFrame:
    """Old rows outside (key in values, start <= ts < end), and the new rows."""
    gone = F.col(key).isin(list(values)) & (F.col("ts") >= start) & (F.col("ts") < end)
    return old.where(~gone).unionByName(new)


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replaces exactly the partitions that df holds, so a range can be built again by itself."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_partitions(new: DataFrame, path: str, keys: Sequence[str], *by: str) -> None:
    """Puts new into the table at path, which is partitioned by `by`: of each key the new row stays, others stay as they are.

    Only partitions that new has rows in are read and written, each in one move at the end; doing the same again
    changes nothing. Keys decide the partition, so a row never leaves its own. Of new rows with one key the greatest stays.
    """
    spark, rest = new.sparkSession, [c for c in new.columns if c not in keys]
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    if not there:
        write_partitions(latest(new, keys, *(F.desc(F.to_json(F.struct(c))) for c in rest)).repartition(*by), path, *by)
        return
    one = scratch(spark)
    latest(new, keys, *(F.desc(F.to_json(F.struct(c))) for c in rest)).write.parquet(one)
    fresh = spark.read.schema(new.schema).parquet(one)
    old = spark.read.schema(new.schema).parquet(path).join(fresh.select(*by).distinct(), list(by), "left_semi").join(fresh.select(*keys), list(keys), "left_anti")
    write_partitions(fresh.unionByName(old).repartition(*by), path, *by)


def csv_import(spark: SparkSession, path: str, keys: Sequence[str], numbers: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A CSV with a header: bad numbers become 0, the first row of each key stays."""
    raw = spark.read.option("header", True).csv(path)
    typed = raw.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in numbers})
    return latest(typed, keys, *order)


def csv_export(df: DataFrame, path: str, ts: str = "ts", key: str = "symbol") -> DataFrame:
    """Writes a CSV folder and returns its manifest: rows, first_ts, last_ts, symbols."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.agg(F.count("*").alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.countDistinct(key).alias("symbols"))


def normalise_symbols(c: Column) -> Column:
    """Trimmed, upper-cased, without $, empty ones dropped, each once in order."""
    clean = F.transform(c, lambda s: F.upper(F.replace(F.trim(s), F.lit("$"), F.lit(""))))
    return F.array_distinct(F.filter(clean, lambda s: s != ""))


def parse_time(c: Column) -> Column:
    """Epoch microseconds of ISO text (Z, a space or T; no zone is UTC) or of epoch seconds; null for anything else."""
    text = F.regexp_replace(F.trim(c), "Z$", "+00:00")
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)), (c.try_cast("double") * 1e6).cast("long"))


def repair_clocks(df: DataFrame) -> DataFrame:
    """occurred <= published <= available made true, source_latency_ms, and clock_violation where it wasn't."""
    published = F.greatest("occurred", "published")
    available = F.greatest(published, "available")
    wrong = (F.col("published") < F.col("occurred")) | (F.col("available") < F.col("published"))
    return df.withColumns({"clock_violation": wrong, "published": published, "available": available, "source_latency_ms": ((available - F.col("occurred")) / 1000).cast("long")})


def new_events(batch: DataFrame, there: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key of the batch, without keys that are there already."""
    first = batch.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")
    return first.join(there.select(key), key, "left_anti")


def entity_links(mentions: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Entities (kind, name, first_doc, last_doc) and links (doc, kind, name) of mentions; each link once, null names have none."""
    links = mentions.where("name IS NOT NULL").select(doc, "kind", "name").distinct()
    return links.groupBy("kind", "name").agg(F.min(doc).alias("first_doc"), F.max(doc).alias("last_doc")), links

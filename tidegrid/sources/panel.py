"""A panel of feature rows that grows by ranges: partitioned by symbol and day, published by a manifest.

A build writes the partitions that it touches beside the old ones, under its own number, and never changes a file that is
there. What counts is what the newest manifest lists; the manifest is moved to its name last, so a build that dies
leaves files that nobody reads, and of two builds at once one fails. Columns that are derived from rows before them are worked
out again for the days that a change can reach, so a panel built in pieces equals one built at once.

Rows: symbol, ts (epoch microseconds), values and mask (one each for every feature), close, and context and context_mask
(for every name of the other timeframes). regime and regime_mask are derived.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.assemble import leaks, sample_index
from ..operators.rolling import REGIME_INPUTS, regime_features
from .fixtures import DAY
from .io import scratch

#: Rows before a row that its derived columns are made of, and the fewest rows of a symbol in any case.
REACH, LEAST = 96, 16

_ROW = "ts long, values array<float>, mask array<tinyint>, close double, context array<float>, context_mask array<tinyint>, regime array<double>, regime_mask array<tinyint>"
_DATA = f"{_ROW}, build string, symbol string, day long"
_PARTS = "symbol string, day long, build string, rows long, first_ts long, last_ts long, missing double"
_RAW = ("symbol", "ts", "values", "mask", "close", "context", "context_mask")


class PanelError(ValueError):
    """Why a panel can't be built or opened."""


class PanelStore:
    """The panel below path.

    features: names of the values; horizons: name -> bars ahead; context: names of the values of other timeframes, empty
    where there are none. With require_context a panel without them can't be built or read.
    """

    def __init__(self, spark: SparkSession, path: str, features: Sequence[str], lookback: int, horizons: dict[str, int], context: Sequence[str] = (), require_context: bool = False):
        if not horizons or min(horizons.values()) < 1:
            raise PanelError(f"a horizon must lie ahead: {horizons}")
        if require_context and not context:
            raise PanelError("names of the context are missing")
        self.spark, self.path, self.features, self.context, self.require_context = spark, path.rstrip("/"), list(features), list(context), require_context
        self.lookback, self.horizons = lookback, dict(horizons)
        said = {"features": self.features, "context": self.context, "lookback": lookback, "horizons": self.horizons}
        self.contract = hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    # Small files of the driver, by the file system that Spark uses for the path.
    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict | None:
        """The newest manifest, or None. Raises where it is of another contract, or lacks the context that is required."""
        fs, folder = self._files(f"{self.path}/manifests")
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return None
        found = json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first().value)
        if self.require_context and not found.get("context"):
            raise PanelError("the manifest has no names of the context")
        if found["contract"] != self.contract:
            raise PanelError(f"the panel has contract {found['contract']}, not {self.contract}")
        return found

    def _publish(self, manifest: dict) -> None:
        name = f"{self.path}/manifests/{manifest['version']:08d}.json"
        fs, place = self._files(name)
        _, beside = self._files(f"{name}.{manifest['build']}")
        out = fs.create(beside, False)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()
        if fs.exists(place) or not fs.rename(beside, place):
            fs.delete(beside, False)
            raise PanelError(f"another build has published version {manifest['version']}")

    def partitions(self, manifest: dict | None = None) -> DataFrame:
        """symbol, day, build, rows, first_ts, last_ts, missing (sum of the rows' missing shares) of what counts."""
        manifest = manifest or self.manifest()
        if manifest is None:
            return self.spark.createDataFrame([], _PARTS)
        return self.spark.read.schema(_PARTS).parquet(f"{self.path}/partitions/{manifest['build']}")

    def _rows(self, manifest: dict | None, parts: DataFrame) -> DataFrame:
        """The rows of these partitions, pruned by build, symbol and day."""
        if manifest is None:
            return self.spark.createDataFrame([], _DATA)
        data = self.spark.read.schema(_DATA).parquet(f"{self.path}/data").where(F.col("build").isin(manifest["builds"]))
        return data.join(parts.select("build", "symbol", "day"), ["build", "symbol", "day"], "left_semi")

    def read(self, start: int | None = None, end: int | None = None, symbols: Sequence[str] | None = None) -> DataFrame:
        """symbol, ts and the other columns of all rows that count, or of those in [start, end] and of these symbols."""
        manifest = self.manifest()
        parts = self.partitions(manifest)
        parts = parts if start is None else parts.where(F.col("last_ts") >= start)
        parts = parts if end is None else parts.where(F.col("first_ts") <= end)
        parts = parts if symbols is None else parts.where(F.col("symbol").isin(list(symbols)))
        rows = self._rows(manifest, parts)
        rows = rows if start is None else rows.where(F.col("ts") >= start)
        return (rows if end is None else rows.where(F.col("ts") <= end)).drop("build", "day")

    def report(self) -> DataFrame:
        """symbol, rows, first_ts, last_ts, missing_ratio, days, from the manifest's partitions alone."""
        return self.partitions().groupBy("symbol").agg(F.sum("rows").alias("rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), (F.sum("missing") / F.sum("rows")).alias("missing_ratio"), F.count("*").alias("days"))

    def samples(self) -> DataFrame:
        """symbol, ts, t_idx and label_ts of rows with a whole lookback and a whole future; raises where a label wouldn't lie ahead."""
        found = sample_index(self.read().select("symbol", "ts"), self.lookback, max(self.horizons.values()))
        if not leaks(found).isEmpty():
            raise PanelError("a label doesn't lie ahead of its sample")
        return found

    def _checked(self, rows: DataFrame, start: int, end: int, symbols: Sequence[str] | None) -> DataFrame:
        """Rows of the range with a price, one for each key, written once. Raises on widths that don't fit, and on symbols without rows."""
        if not self.context:
            rows = rows.withColumns({"context": F.array().cast("array<float>"), "context_mask": F.array().cast("array<tinyint>")})
        kept = rows.select(*_RAW).where(F.col("ts").between(start, end) & (F.col("close") > 0) & F.col("symbol").isNotNull())
        one = kept.groupBy("symbol", "ts").agg(F.max(F.struct("close", "values", "mask", "context", "context_mask")).alias("r")).select("symbol", "ts", "r.*")
        place = scratch(self.spark)
        one.select(*_RAW).write.parquet(place)
        fresh = self.spark.read.parquet(place)
        widths = {"values": len(self.features), "mask": len(self.features), "context": len(self.context), "context_mask": len(self.context)}
        wrong = [F.count_if(F.coalesce(F.size(c), F.lit(-1)) != n).alias(c) for c, n in widths.items()]
        found = fresh.agg(F.count("*").alias("n"), *wrong).first().asDict()
        bad = {c: k for c, k in found.items() if c != "n" and k}
        if bad or not found["n"]:
            raise PanelError(f"rows of another width than {widths}: {bad}" if bad else "no row with a price in the range")
        if symbols is not None:
            asked = self.spark.createDataFrame([(s,) for s in symbols], "symbol string")
            lacking = [r.symbol for r in asked.join(fresh.select("symbol").distinct(), "symbol", "left_anti").limit(20).collect()]
            if lacking:
                raise PanelError(f"symbols without rows: {lacking}")
        return fresh

    def _derived(self, rows: DataFrame) -> DataFrame:
        """rows with regime and regime_mask; a feature that is masked is missing, one that the panel hasn't is as well."""
        at = {c: k for k, c in enumerate(self.features) if c in REGIME_INPUTS}
        known = {c: F.when(F.col("mask")[k] == 0, F.col("values")[k]) for c, k in at.items()}
        return regime_features(rows.withColumns(known), keep=[*_RAW[2:], "day"])

    def build(self, rows: DataFrame, start: int, end: int, symbols: Sequence[str] | None = None, reuse: bool = False) -> dict:
        """Puts the rows of [start, end] into the panel and returns the manifest that then counts.

        Of rows with one symbol and ts new ones win; old ones that the new ones lack stay. With reuse nothing is done
        where the panel holds every asked symbol over the whole range already. Rows without a price, a symbol or a time
        don't enter; of repeated rows the greatest stays. A symbol must then have more rows than a lookback and the
        longest horizon, or nothing is published.
        """
        manifest = self.manifest()
        live = self.partitions(manifest)
        if reuse and manifest is not None and symbols is not None:
            whole = live.where(F.col("symbol").isin(list(symbols))).groupBy("symbol").agg(F.min("first_ts").alias("a"), F.max("last_ts").alias("b")).where((F.col("a") <= start) & (F.col("b") >= end))
            if whole.count() == len(set(symbols)):
                return manifest
        day = F.floor(F.col("ts") / DAY).cast("long")
        fresh = self._checked(rows, start, end, symbols).withColumn("day", day)
        spans = fresh.groupBy("symbol").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
        # Days whose rows a change can reach are written again; those before, which it is made of, are only read.
        near = live.join(spans, "symbol")
        total = F.coalesce(F.sum("rows").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        after = near.where("day > last_day").withColumn("between", total).where(F.col("between") < REACH)
        back = F.coalesce(F.sum("rows").over(Window.partitionBy("symbol").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        before = near.where("day < first_day").withColumn("between", back).where(F.col("between") < REACH)
        touched = near.where("day BETWEEN first_day AND last_day").select("symbol", "day", "build").union(after.select("symbol", "day", "build"))
        needed = touched.union(before.select("symbol", "day", "build"))
        old = self._rows(manifest, needed).select(*_RAW, "day").join(fresh.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
        merged = self._derived(fresh.select(*_RAW, "day").unionByName(old))
        new = merged.join(spans.select("symbol", "first_day"), "symbol").where("day >= first_day").drop("first_day")
        build = f"{(manifest or {'version': 0})['version'] + 1:08d}-{uuid.uuid4().hex}"
        new.withColumn("build", F.lit(build)).repartition("symbol", "day").write.mode("append").partitionBy("build", "symbol", "day").parquet(f"{self.path}/data")
        written = self.spark.read.schema(_DATA).parquet(f"{self.path}/data").where(F.col("build") == build)
        share = F.aggregate("mask", F.lit(0.0), lambda s, m: s + m) / max(1, len(self.features))
        added = written.groupBy("symbol", "day", "build").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(share).alias("missing"))
        parts = live.join(added.select("symbol", "day"), ["symbol", "day"], "left_anti").select(*added.columns).union(added)
        parts.write.parquet(f"{self.path}/partitions/{build}")
        parts = self.spark.read.schema(_PARTS).parquet(f"{self.path}/partitions/{build}")
        least = max(self.lookback + max(self.horizons.values()), LEAST)
        short = parts.join(spans, "symbol", "left_semi").groupBy("symbol").agg(F.sum("rows").alias("rows")).where(F.col("rows") <= least).limit(20).collect()
        if short:
            raise PanelError(f"symbols with {least} rows or fewer: {[(r.symbol, r.rows) for r in short]}")
        sums = parts.agg(F.sum("rows").alias("rows"), F.countDistinct("symbol").alias("symbols"), F.count("*").alias("partitions"), F.collect_set("build").alias("builds"), F.count_if(F.col("build") == build).alias("touched")).first()
        told = {"version": (manifest or {"version": 0})["version"] + 1, "build": build, "contract": self.contract, "features": self.features, "context": self.context, "lookback": self.lookback, "horizons": self.horizons}
        told |= {"mode": "rebuild" if manifest is None else "append_from_overlap", "start": start, "end": end, "rows": sums.rows, "symbols": sums.symbols, "partitions": sums.partitions, "touched": sums.touched, "builds": sorted(sums.builds)}
        self._publish(told)
        return told

    def dead_builds(self) -> list[str]:
        """Builds below path that no partition of the newest manifest needs; their folders can go once no reader of an older manifest is left."""
        fs, folder = self._files(f"{self.path}/data")
        there = {f.getPath().getName().removeprefix("build=") for f in fs.listStatus(folder) if f.isDirectory()} if fs.exists(folder) else set()
        return sorted(there - set((self.manifest() or {"builds": []})["builds"]))

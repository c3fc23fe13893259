"""Streaming forms: transformations of an event stream (symbol, ts timestamp, id, user_id, price, size) and a runner."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.assemble import filled
from ..sources.io import scratch


def file_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """The files of a folder, oldest first, per_trigger files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def split_files(df: DataFrame, folder: str, parts: int, arrival: Column | str = "ts") -> None:
    """df in `parts` files, ranges of arrival, so that a stream over the folder sees time pass.

    Ranges are written beside each other, a task for each; the files then get times in the order of the ranges, as a
    stream reads the oldest file first. Columns are those of df without arrival, if that is one whose name begins with __.
    """
    rest = [c for c in df.columns if not c.startswith("__")]
    df.repartitionByRange(parts, arrival).select(*rest).write.mode("append").parquet(folder)
    _in_order(df.sparkSession, folder)


def _in_order(spark: SparkSession, folder: str) -> None:
    """Files that have no time of their own yet get one after all others, in the order of their names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(((f.getPath().getName(), f.getModificationTime(), f.getPath()) for f in fs.listStatus(p) if f.getPath().getName().startswith("part-")), key=lambda x: x[0])
    at = max((t for _, t, _ in files if t < _OLD), default=_OLD // 2)
    for _, t, path in files:
        if t >= _OLD:
            at += 10_000
            fs.setTimes(path, at, -1)


#: Files of a stream get times before this one (2001), by which they are told from new ones.
_OLD = 1_000_000_000_000


def close_files(df: DataFrame, folder: str, at: int) -> None:
    """Two more files with a row each, null but for ts, at `at` and after: the first moves the watermark, the second has it applied."""
    spark = df.sparkSession
    for k in range(2):
        row = spark.range(1).select(*(F.timestamp_micros(F.lit(at + k * 1_000_000)).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if not f.name.startswith("__")))
        row.coalesce(1).write.mode("append").parquet(folder)
        _in_order(spark, folder)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is there now, through a file sink, or through the memory of a batch function for other modes."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession)
    writer = stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{out}/data").outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/data")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/__part={number}")

    writer.outputMode(mode).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").drop("__part")


def last_update(updates: DataFrame, *keys: str) -> DataFrame:
    """The final state from the rows of update mode."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r")).select(*keys, "r.*").drop("__batch")


def clean_ticks(raw: DataFrame) -> DataFrame:
    """Upper-cased symbols; rows whose price isn't a positive number are skipped."""
    price = F.col("price").cast("string").try_cast("double")
    return raw.withColumn("price", price).where("price > 0").withColumn("symbol", F.upper("symbol"))


def bars_stream(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars; rows later than the watermark are dropped by the engine and counted in its metrics."""
    order = F.struct("ts", "id")
    rows = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width))
    return rows.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))


def dedup_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first event of each fingerprint within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])


def sliding_counts(events: DataFrame, size: str = "6 hours", step: str = "1 hour", late: str = "1 hour", value: str = "sentiment") -> DataFrame:
    """Events and their mean sentiment by symbol and sliding window."""
    return events.withWatermark("ts", late).groupBy("symbol", F.window("ts", size, step)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


#: Seconds of the 95th percentile of ingest lag, and without any event, from which an alert is due.
LAG_LIMIT, SILENCE = 120.0, 600


def lag_alerts(events: DataFrame, limit: float = LAG_LIMIT) -> DataFrame:
    """Quantiles of ingest lag (seconds) by window, and whether the 95th passes the limit."""
    # Exact: the state has a count for each different lag of a window.
    q = [F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY lag)").alias(name) for name, share in (("p50", 0.5), ("p95", 0.95))]
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour")).agg(*q).select("window", "p50", "p95", (F.col("p95") > limit).alias("alert"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful Python needs, for as long as the block lasts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Keys are dealt out to this many groups, each of which has its state in one place.
PARTS = 256


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class Ordered(StatefulProcessor):
    """Takes the rows of its keys in the order of key, time and id, however they come.

    Rows wait, batches of them as one value of a list, until the watermark has passed them, as then no earlier one can
    follow; an event-time timer at the oldest waiting row wakes the group. So what a group holds is bounded by the
    watermark's delay, and calls of the state store go with groups and batches, not with keys and rows. schema: columns
    of the rows, key, at (epoch microseconds) and id first. Rows with a null key move the watermark and are left out.
    """

    schema = pa.schema([("key", pa.string()), ("at", pa.int64()), ("id", pa.int64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.due = handle.getValueState("due", "ms long")
        self.state = handle.getValueState("state", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One part after the other goes into the list, so a batch of a group is never in memory whole.
        for part in rows:
            part = part[part["there"]]
            if len(part):
                self.waiting.appendValue((_packed(pa.Table.from_pandas(part[self.schema.names], self.schema, preserve_index=False)),))
                self._wake(int(part["at"].min()))
        yield from ()

    def _wake(self, at: int) -> None:
        ms = at // 1000 + 1
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or ms < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = [_unpacked(r[0]) for r in self.waiting.get()]
        held = pa.concat_tables(held) if held else self.schema.empty_table()
        self.waiting.clear()
        self.due.clear()
        final = held["at"].to_numpy() <= until
        later = held.filter(pa.array(~final))
        if later.num_rows:
            self.waiting.appendValue((_packed(later),))
            self._wake(int(later["at"].to_numpy().min()))
        found = self.take(held.filter(pa.array(final)).sort_by([("key", "ascending"), ("at", "ascending"), ("id", "ascending")]), until)
        if found is not None and len(found):
            yield found

    def take(self, rows: pa.Table, until: int) -> pd.DataFrame | None:
        """The output of rows that are final, in order; until is the watermark."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _grouped(events: DataFrame, key: str, late: str, *more: Column):
    """Rows for an Ordered, by group of keys."""
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("part")
    # What is null only in rows that move the watermark gets a value, so that whole numbers stay whole.
    zero = F.lit("" if dict(events.dtypes)[key] == "string" else 0)
    rows = events.withWatermark("ts", late).select(part, "ts", F.col(key).isNotNull().alias("there"), F.coalesce(F.col(key), zero).alias("key"), F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("at"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), *more)
    return rows.groupBy("part")


class Silence(Ordered):
    """For each key the times at which nothing had come for `limit` seconds. A timer of the silence itself fires without an event."""

    known = pa.schema([("key", pa.string()), ("last", pa.int64()), ("told", pa.bool_())])

    def __init__(self, limit: int):
        self.limit = limit * 1_000_000

    def take(self, rows: pa.Table, until: int) -> pd.DataFrame | None:
        before = _unpacked(self.state.get()[0]) if self.state.exists() else self.known.empty_table()
        state = {k: (at, told) for k, at, told in zip(*(before[c].to_pylist() for c in self.known.names))}
        keys, times, found = rows["key"].to_pandas().to_numpy(object), rows["at"].to_numpy(), []
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            last, told = state.get(keys[a], (None, False))
            at = times[a:b] if last is None else np.append(last, times[a:b])
            quiet = np.flatnonzero(np.diff(at) > self.limit)
            found += [(keys[a], int(at[q])) for q in quiet if q or not (told and last is not None)]
            newest = int(at.max())
            state[keys[a]] = newest, told and newest == last
        for k, (last, told) in state.items():
            if not told and until - last > self.limit:
                found.append((k, last))
                state[k] = last, True
        if not state:
            return None
        self.state.update((_packed(pa.table([pa.array(list(state)), pa.array([x for x, _ in state.values()], pa.int64()), pa.array([x for _, x in state.values()], pa.bool_())], schema=self.known)),))
        due = [last + self.limit + 1000 for last, told in state.values() if not told]
        if due:
            self._wake(min(due))
        return pd.DataFrame({"source": [k for k, _ in found], "last_at": [at for _, at in found], "alert_at": [at + self.limit for _, at in found]})


def freshness_alerts(events: DataFrame, limit: int = SILENCE, late: str = "1 hour") -> DataFrame:
    """source, last_at, alert_at (epoch microseconds) of every time at which a source (source, ts, id) had been silent for more than limit seconds."""
    return _grouped(events, "source", late).transformWithStateInPandas(Silence(limit), "source string, last_at long, alert_at long", "Append", "EventTime")


def reject_rates(orders: DataFrame, size: str = "6 hours", step: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """Share of rejected orders by sliding window."""
    return orders.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.avg("rejected").alias("rate"), F.count("*").alias("n"))


def alerts(rates: DataFrame, share: float) -> DataFrame:
    """Windows whose final rate is above the share. Rates of an open window can still fall, so this follows their last update."""
    return rates.where(F.col("rate") > share)


class Position(Ordered):
    """Running quantity, average cost, realised and unrealised result and losing streak of each key."""

    schema = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("id", pa.int64()), ("qty", pa.float64()), ("price", pa.float64())])
    known = pa.schema([("key", pa.int64()), *((c, pa.float64()) for c in ("qty", "avg_cost", "realised", "last")), ("streak", pa.int64())])

    def take(self, rows: pa.Table, until: int) -> pd.DataFrame | None:
        if not rows.num_rows:
            return None
        before = _unpacked(self.state.get()[0]) if self.state.exists() else self.known.empty_table()
        state = {k: tuple(s) for k, *s in zip(*(before[c].to_pylist() for c in self.known.names))}
        new, now = {}, None
        for key, size, price in zip(*(rows[c].to_pylist() for c in ("key", "qty", "price"))):
            if key != now:
                if now is not None:
                    new[now] = qty, cost, realised, last, streak
                now = key
                qty, cost, realised, last, streak = state.get(key, (0.0, 0.0, 0.0, None, 0))
            streak = streak + 1 if last is not None and price < last else 0
            (qty, cost, realised), last = filled(qty, cost, realised, size, price), price
        new[now] = qty, cost, realised, last, streak
        state.update(new)
        packed = lambda d: [pa.array(c, f.type) for c, f in zip(zip(*((k, *s) for k, s in d.items())), self.known)]
        self.state.update((_packed(pa.table(packed(state), schema=self.known)),))
        out = pa.table(packed(new), schema=self.known).to_pandas()
        out["unrealised"] = (out["last"] - out["avg_cost"]) * out["qty"]
        return out.rename(columns={"key": "user_id"})[["user_id", "qty", "avg_cost", "realised", "unrealised", "streak"]]


def positions_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The position of each user after every step of the watermark, from fills (user_id, ts, id, qty signed, price) that may come out of order by `late`."""
    rows = _grouped(events, "user_id", late, F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"))
    return rows.transformWithStateInPandas(Position(), "user_id long, qty double, avg_cost double, realised double, unrealised double, streak long", "Update", "EventTime")


def enrich_stream(events: DataFrame, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each micro-batch joined with the latest snapshot by `join`, an as-of join with a static table."""
    spark, out = events.sparkSession, scratch(events.sparkSession)

    def one(batch: DataFrame, number: int) -> None:
        join(batch).write.mode("overwrite").parquet(f"{out}/data/part={number}")

    events.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(one).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").drop("part")


def interval_join(predictions: DataFrame, prices: DataFrame) -> DataFrame:
    """Predictions with the prices of their symbol one to two hours later; both sides have watermarks, so state is bounded."""
    p = predictions.withWatermark("ts", "1 hour").alias("p")
    q = prices.withWatermark("later", "1 hour").alias("q")
    return p.join(q, F.expr("p.symbol = q.symbol2 AND q.later >= p.ts + INTERVAL 1 HOUR AND q.later < p.ts + INTERVAL 2 HOURS"))


def _count_above(ranks: np.ndarray, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
    """For each asked range how many of ranks[low:high] are greater than `than`, both at least 0: bit by bit, by prefix counts of a stable partition."""
    found, low, high = np.zeros(len(than), np.int64), low.astype(np.int64), high.astype(np.int64)
    for bit in range(int(max(ranks.max(initial=0), than.max(initial=0))).bit_length() - 1, -1, -1):
        ones = (ranks >> bit) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - ones)))
        low0, high0 = zeros[low], zeros[high]
        low1, high1 = zeros[-1] + low - low0, zeros[-1] + high - high0
        up = ((than >> bit) & 1) == 1
        found += np.where(up, 0, high1 - low1)
        low, high = np.where(up, low1, low0), np.where(up, high1, high0)
        ranks = np.concatenate((ranks[ones == 0], ranks[ones == 1]))
    return found


_HOUR = 3_600_000_000
_COUNTS = pa.schema([("symbol", pa.string()), ("start", pa.int64()), ("pairs", pa.int64()), ("hits", pa.int64())])


def _meet(start: int, at: np.ndarray, price: np.ndarray, known: np.ndarray) -> tuple[int, int]:
    """Pairs of a row of the hour that begins at start with rows one to two hours later, and those whose later price is greater."""
    order = np.argsort(at, kind="stable")
    at, price, known = at[order], price[order], known[order]
    rank = np.unique(price, return_inverse=True)[1].astype(np.int64)
    first = at < start + _HOUR
    asks = at[first]
    pairs = int((np.searchsorted(at, asks + 2 * _HOUR, side="left") - np.searchsorted(at, asks + _HOUR, side="left")).sum())
    # A null price takes part in pairs and is never greater or less.
    asks, than, times = at[first & known], rank[first & known], at[known]
    low, high = np.searchsorted(times, asks + _HOUR, side="left"), np.searchsorted(times, asks + 2 * _HOUR, side="left")
    return pairs, int(_count_above(rank[known], low, high, than).sum())


def interval_counts(prices: DataFrame, late: str = "1 hour") -> DataFrame:
    """symbol, start, pairs and hits: interval_join of prices (symbol, ts, price) with themselves, counted by the hour of the earlier row.

    An hour's rows and those up to two hours behind it are a window's state, which the watermark bounds; they are counted in
    their order, so pairs are never made and the work is n log n in a window's rows. Null symbols and times match nothing.
    """
    rows = prices.where("symbol IS NOT NULL").withWatermark("ts", late).groupBy("symbol", F.window("ts", "3 hours", "1 hour"))
    held = rows.agg(F.collect_list(F.struct(F.unix_micros("ts").alias("at"), F.col("price").cast("double").alias("price"))).alias("held"))
    held = held.select("symbol", F.unix_micros("window.start").alias("start"), F.col("held.at").alias("at"), F.col("held.price").alias("price"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for k in range(part.num_rows):
                start, at, price = part.column(1)[k].as_py(), part.column(2)[k].values, part.column(3)[k].values
                found.append(_meet(start, at.to_numpy(zero_copy_only=False), price.fill_null(0.0).to_numpy(zero_copy_only=False), price.is_valid().to_numpy(zero_copy_only=False)))
            pairs, hits = ([x[j] for x in found] for j in (0, 1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pairs, pa.int64()), pa.array(hits, pa.int64())], schema=_COUNTS)

    return held.mapInArrow(count, "symbol string, start long, pairs long, hits long")

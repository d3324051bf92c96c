"""Event streams: replays of stored events, deduplicated sinks, windows and keyed state with timers.

A row is late, and left out, if a stream has seen one that is newer by more than its
delay in an earlier micro-batch. Stored files may come in any order of time; ``Replay``
measures how far they are apart and allows for it, so that no stored row is late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, TimestampType
from pyspark.sql.window import Window

from driftline.operators.state import VersionedSet, VersionedTable, merge
from driftline.session import scratch_path

#: The state store that keyed state with timers needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """A stream over Parquet files whose time column can carry a watermark. A path to a single file must be a pattern."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


class Replay:
    """Stored events as a stream that is drained to its end, with the result of an ordered one.

    ``delay`` is ``slack`` seconds and the disorder of the files: how much older a row can
    be than one in a file that the stream may have read before. Files come by their time
    of modification; of those with the same one any may come first. Bounded disorder
    keeps the state bounded, sorted files add nothing to it.

    A watermark that trails by the disorder leaves the last windows open. Once all
    files are read, a row of nulls at a later time moves it to where that of an ordered stream
    would be, ``slack`` before the newest event (or ``beyond`` it, where every row has to be
    decided). Rows without a time take no part in the measure.
    """

    def __init__(self, spark: SparkSession, path: str, time: str = "ts", slack: int = 3600, beyond: int | None = None):
        self.spark, self.time, self.slack = spark, time, slack
        stored = spark.read.parquet(path)
        files = stored.groupBy("_metadata.file_path", "_metadata.file_modification_time").agg(F.min(time).alias("low"), F.max(time).alias("high"))
        times = files.groupBy("file_modification_time").agg(F.count(F.lit(1)).alias("files"), F.min("low").alias("low"), F.max("high").alias("high"))
        earlier = Window.orderBy("file_modification_time").rowsBetween(Window.unboundedPreceding, -1)  # a row per time at which files were written
        before = F.greatest(F.max("high").over(earlier), F.when(F.col("files") > 1, F.col("high")))
        seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
        far = times.withColumn("apart", seconds(before) - seconds(F.col("low"))).agg(F.max("apart").alias("apart"), F.max(seconds(F.col("high"))).alias("end")).first()
        self.disorder = int(max(0.0, far.apart or 0.0)) + (1 if far.apart and far.apart > 0 else 0)
        self.delay = f"{slack + self.disorder} seconds"
        self._ends = None if far.end is None else far.end + self.disorder + (0 if beyond is None else slack + beyond)
        self._marked = self.disorder > 0 or beyond is not None
        self._markers = scratch_path(spark, "markers")
        self.schema = StructType([StructField(f.name, TimestampType() if f.name == time else f.dataType) for f in stored.schema])
        spark.createDataFrame([], self.schema).write.parquet(self._markers)
        self.events = event_stream(spark, path, time)

    def stream(self) -> DataFrame:
        """The events and, at the end, the row of nulls."""
        if not self._marked:
            return self.events
        markers = self.spark.readStream.schema(self.schema).parquet(self._markers)
        return self.events.unionByName(markers.withColumn(self.time, F.col(self.time).cast("timestamp")))

    def drained(self, stream: DataFrame, name: str) -> DataFrame:
        """Run a stream that was made from this one over all there is, close what is to be closed, and read what it wrote."""
        path = scratch_path(self.spark, name)
        rows = drained(stream, name, path=path)
        if self._marked and self._ends is not None:
            end = F.timestamp_micros(F.lit(int(self._ends * 1_000_000)))
            marker = self.spark.range(1).select(*[(end if f.name == self.time else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.schema])
            marker.write.mode("append").parquet(self._markers)
            rows = drained(stream, name, path=path)
        return rows


def unique_events(stream: DataFrame, key: str = "dedupe_key", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first event of each key; keys are forgotten once ``delay`` has passed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, time: str = "ts", length: str = "1 hour", delay: str = "1 hour", by: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    g = stream.withWatermark(time, delay).groupBy(F.window(time, length), *by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("largest")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "largest")


def sliding(stream: DataFrame, time: str = "ts", length: str = "6 hours", step: str = "1 hour", delay: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    g = stream.withWatermark(time, delay).groupBy(F.window(time, length, step), *by)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    g = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), key)
    return g.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def signups_then_purchases(stream: DataFrame, time: str = "ts", within: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """A stream joined with itself: purchases of a user within a day of a sign-up."""
    left = stream.where(F.col("event_type") == "signup").select(F.col("user_id").alias("s_user"), F.col("event_id").alias("signup_id"), F.col(time).alias("s_ts")).withWatermark("s_ts", delay)
    right = stream.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("p_user"), F.col("event_id").alias("purchase_id"), F.col(time).alias("p_ts")).withWatermark("p_ts", delay)
    on = (F.col("s_user") == F.col("p_user")) & (F.col("p_ts") >= F.col("s_ts")) & (F.col("p_ts") <= F.col("s_ts") + F.expr(f"INTERVAL {within}"))
    return left.join(right, on).select(F.col("s_user").alias("user_id"), "signup_id", "purchase_id")


class _Ordered(StatefulProcessor):
    """Rows of a key, decided in order of time once the watermark has passed them.

    Rows wait in a list; a timer fires when the watermark has passed the first of those that came
    together, decides all that it has passed by then, and is set again for the first of the rest: calls and timers of a key
    don't grow with its rows. Of a key only the rows within the delay and what ``decided`` remembers are held.
    """

    def __init__(self, waiting: str):
        self.waiting = waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.list = handle.getListState("waiting", self.waiting)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        some, first = [], None
        for row in rows:
            if self.counts(row):
                some.append(self.wait(row))
                first = some[-1][0] if first is None else min(first, some[-1][0])
                if len(some) == 1024:
                    self.list.appendList(some)
                    some = []
        if some:
            self.list.appendList(some)
        if first is not None:
            self.alarm(first)
        return iter(())

    def alarm(self, at: int) -> None:
        self.handle.registerTimer(self.due(at) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        waiting = sorted(self.list.get()) if self.list.exists() else []
        out = self.decided(key, waiting, passed)
        left = [w for w in waiting if self.due(w[0]) >= passed]
        if left:
            if len(left) < len(waiting):
                self.list.put(left)
            self.alarm(left[0][0])
        elif waiting:
            self.list.clear()
        return iter(out)

    def close(self) -> None:
        pass


class _Limit(_Ordered):
    def __init__(self, limit: int, span: int, time: str, tie: str):
        super().__init__("at long, id long")
        self.limit, self.span, self.time, self.tie = limit, span, time, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("memory", "begun long, n long")

    def counts(self, row: Row) -> bool:
        return row[self.time] is not None and row[self.tie] is not None

    def wait(self, row: Row) -> tuple:
        return (row[self.time], row[self.tie])

    def due(self, at: int) -> int:
        return at

    def decided(self, key: tuple, waiting: list[tuple], passed: int) -> list[Row]:
        known = self.kept.exists()
        begun, n = self.kept.get() if known else (None, 0)
        out = []
        for at, tie in waiting:
            if at >= passed:
                break
            if begun is None or at >= begun + self.span:
                begun, n = at, 0
            n += 1
            out.append(Row(key=key[0], id=tie, allowed=n <= self.limit))
        if begun is not None and begun + self.span >= passed:
            self.kept.update((begun, n))
            self.handle.registerTimer((begun + self.span) // 1000 + 1)
        elif known:
            self.kept.clear()  # the window is over: the key is forgotten
        return out


def limited(stream: DataFrame, key: str, limit: int, seconds: int, time: str = "ts", tie: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """The key, ``tie`` and ``allowed`` of each request: a window opens at a key's first request, which alone sets its end.

    Requests of one key are decided by time, then ``tie``, as soon as the watermark
    has passed them, whatever their order of arrival; a key is forgotten once its window is over.
    Rows without a time or ``tie`` aren't requests.
    """
    rows = stream.withWatermark(time, delay).select(F.col(key).alias("key"), F.col(tie).cast("long").alias("id"), F.unix_micros(time).alias("at"), F.col(time))
    made = rows.groupBy("key").transformWithState(_Limit(limit, seconds * 1_000_000, "at", "id"), f"key {rows.schema['key'].dataType.simpleString()}, id long, allowed boolean", "Append", "EventTime")
    return made.select(F.col("key").alias(key), F.col("id").alias(tie), "allowed")


class _Stale(_Ordered):
    """Starts wait for their deadline; an end waits as long, by when no start before it is open."""

    def __init__(self, span: int, starts: str, ends: str):
        super().__init__("at long, id long, ends boolean")
        self.span, self.starts, self.ends = span, starts, ends

    def counts(self, row: Row) -> bool:
        return row["at"] is not None and row["id"] is not None and row["kind"] in (self.starts, self.ends)

    def wait(self, row: Row) -> tuple:
        return (row["at"], row["id"], row["kind"] == self.ends)

    def due(self, at: int) -> int:
        return at + self.span

    def decided(self, key: tuple, waiting: list[tuple], passed: int) -> list[Row]:
        out, following = [], None
        for at, i, ends in reversed(waiting):  # the next end at or after each start
            if ends:
                following = at
            elif at + self.span < passed and not (following is not None and following <= at + self.span):
                out.append(Row(key=key[0], id=i, at=at, deadline=at + self.span))
        return out


def stale_runs(stream: DataFrame, key: str, kind: str, starts: str, ends: str, seconds: int, time: str = "ts", tie: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Starts that no end of the same key has followed within ``seconds``: the key, ``tie``, ``started`` and ``deadline``.

    Nothing has to arrive for a row to come out: a timer is set for the first deadline
    of a key, and a start is forgotten once its own is over. An end at the very time of a start ends it.
    """
    rows = stream.withWatermark(time, delay).select(F.col(key).alias("key"), F.col(tie).cast("long").alias("id"), F.col(kind).alias("kind"), F.unix_micros(time).alias("at"), F.col(time))
    made = rows.groupBy("key").transformWithState(_Stale(seconds * 1_000_000, starts, ends), f"key {rows.schema['key'].dataType.simpleString()}, id long, at long, deadline long", "Append", "EventTime")
    return made.select(F.col("key").alias(key), F.col("id").alias(tie), F.timestamp_micros("at").alias("started"), F.timestamp_micros("deadline").alias("deadline"))


def upsert_sink(table: VersionedTable, keys: list[str], **rules) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge a batch into the newest version that the batch doesn't have yet.

    The version is the number of the batch, so that a batch that is run again
    writes the same version from the same one before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        before = [v for v in table.versions() if v < batch_id]
        state = table.read(before[-1]) if before else batch.limit(0)
        table.write(merge(state, batch, keys, **rules), batch_id)

    return write


def tick(tables: VersionedSet, phases: dict[str, Callable[[DataFrame, DataFrame | None], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a phase for each table makes its next state of the batch and its last state (None at first); all become visible by one commit."""

    def write(batch: DataFrame, batch_id: int) -> None:
        tables.commit(batch_id, {name: phase(batch, tables.read(name, before=batch_id)) for name, phase in phases.items()})

    return write


BATCH, PREFIX = "__batch", "__prefix"


class KeyedLog:
    """An append-only log of rows with distinct keys, whatever their age.

    Batch ``n`` owns the folders ``__batch=n/__prefix=..``, of which there is one for each first ``digits`` hexadecimal
    digits of the key's hash. A batch looks for its keys only under the prefixes that it
    has itself, and a batch that is run again replaces what it wrote, so that it changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "dedupe_key", digits: int = 2):
        self.table, self.key, self.digits = VersionedTable(spark, path, BATCH), key, digits

    def _prefix(self) -> Column:
        return F.substring(F.sha2(F.col(self.key).cast("string"), 256), 1, self.digits)

    def earlier(self, batch_id: int, prefixes: list[str]) -> DataFrame | None:
        """The rows of batches before this one under some prefixes; None if there is no such batch."""
        before = [v for v in self.table.versions() if v < batch_id]
        if not before:
            return None
        return self._read(before).where(F.col(PREFIX).isin(prefixes))

    def _read(self, batches: list[int]) -> DataFrame:
        spark, paths = self.table.spark, [f"{self.table.path}/{BATCH}={n}" for n in batches]
        files = spark.read.option("basePath", self.table.path).parquet(*paths).drop(BATCH, PREFIX).schema
        schema = StructType([*files, StructField(BATCH, IntegerType()), StructField(PREFIX, StringType())])
        return spark.read.option("basePath", self.table.path).schema(schema).parquet(*paths).drop(BATCH)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Add the rows whose key the log doesn't hold yet; of equal keys in a batch the first by all columns. Rows without a key are left out."""
        columns = batch.columns
        keyed = batch.where(F.col(self.key).isNotNull()).withColumn(PREFIX, self._prefix())
        place = F.row_number().over(Window.partitionBy(PREFIX, self.key).orderBy(*[c for c in columns if c != self.key] or [F.lit(0)]))
        fresh = keyed.withColumn("__place", place).where("__place = 1").drop("__place")
        prefixes = [r[PREFIX] for r in keyed.select(PREFIX).distinct().collect()]  # 16 ** digits at most
        if not prefixes:
            return
        log = self.earlier(batch_id, prefixes)
        if log is not None:
            fresh = fresh.join(log.select(PREFIX, self.key), [PREFIX, self.key], "left_anti")
        fresh.select(*columns, PREFIX).write.mode("overwrite").partitionBy(PREFIX).parquet(f"{self.table.path}/{BATCH}={batch_id}")

    def read(self) -> DataFrame | None:
        versions = self.table.versions()
        if not versions:
            return None
        return self._read(versions).drop(PREFIX)


def drained(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream over all that is there now, into Parquet, and read that. A ``path`` that was drained into before is gone on with."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    store = "spark.sql.streaming.stateStore.providerClass"
    usual = spark.conf.get(store, None)
    spark.conf.set(store, ROCKS)  # read when the stream starts
    try:
        writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint")
        writer.format("parquet").option("path", path).start().awaitTermination()
    finally:
        spark.conf.unset(store) if usual is None else spark.conf.set(store, usual)
    return spark.read.schema(stream.schema).parquet(path)


def drained_each(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None]) -> None:
    path = scratch_path(stream.sparkSession, name)
    stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").start().awaitTermination()


def ntz(rows: DataFrame, *columns: str) -> DataFrame:
    """Times as they are stored: UTC without a zone."""
    return rows.withColumns({c: _utc(F.col(c)) for c in columns})


def _utc(c: Column) -> Column:
    return c.cast("timestamp_ntz")

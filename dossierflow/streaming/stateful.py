"""Keyed state over streams: stuck files by timers, newest versions of files, late events.

The keyed operators use Spark's ``transformWithState``, which needs the RocksDB state store
(``session_for_state`` gives a session with it). State is one small row for each key; rows of
a key are read as an iterator, never held together.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_for_state(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the settings of
    ``spark`` itself stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    return own


def start(rows: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write what each micro-batch gives under its ``batch_id``, where a replayed batch replaces
    itself. Without ``every`` (a processing-time interval) the query ends with the input."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    writer = rows.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


STUCK = "file_id string, last_event string, idle_since timestamp, n_events bigint, n_late bigint, stuck boolean"
# times cross to Python as microseconds
_STUCK = STUCK.replace("timestamp", "bigint")


class _Stuck(StatefulProcessor):
    """One row of state a file: its newest event, how many there were, whether it was reported."""

    def __init__(self, gap_seconds: int, terminal: list[str], by_event_time: bool):
        self.gap, self.terminal, self.by_event_time = gap_seconds * 1000, set(terminal), by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState(
            "last", "at bigint, seq bigint, event_type string, n bigint, late bigint, reported boolean"
        )

    def _row(self, key, state, stuck: bool) -> Row:
        at, _, kind, n, late, _ = state
        return Row(file_id=key[0], last_event=kind, idle_since=at, n_events=n, n_late=late, stuck=stuck)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = tuple(self.last.get()) if self.last.exists() else None
        at, seq, kind, n, late, reported = before or (None, None, None, 0, 0, False)
        for r in rows:
            if r.event_type is None:  # a tick, which only lets time pass
                continue
            n += 1
            late += before is not None and r.at < before[0]
            if at is None or (r.at, r.seq) > (at, seq):
                at, seq, kind = r.at, r.seq, r.event_type
        if at is None or (before and before[3] == n):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kind not in self.terminal:
            begin = at // 1000 if self.by_event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(begin + self.gap)
        state = (at, seq, kind, n, late, False)
        self.last.update(state)
        if reported:
            yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = (*tuple(self.last.get())[:5], True)
        self.last.update(state)
        yield self._row(key, state, True)

    def close(self) -> None:
        pass


def stuck_by_timers(events: DataFrame, gap_seconds: int, terminal: list[str], by_event_time: bool = False) -> DataFrame:
    """Files without a final event for ``gap_seconds``: a row when the timer of a file fires
    (``stuck``), and one when it goes on after that (not ``stuck``).

    ``events``: file_id, event_time, seq, event_type. By processing time a timer fires in the first
    micro-batch after it is due, whether or not any event comes, so a stream that falls silent as
    a whole reports its files; no event is dropped, and ``n_late`` counts those that are older than
    the newest of the micro-batches before. By event time timers follow the watermark of
    ``events`` instead; events without a type are ticks that move it."""
    reports = (
        events.select("file_id", "event_time", F.unix_micros("event_time").alias("at"), "seq", "event_type").groupBy("file_id")
        .transformWithState(
            statefulProcessor=_Stuck(gap_seconds, terminal, by_event_time), outputStructType=_STUCK, outputMode="Update",
            timeMode="EventTime" if by_event_time else "ProcessingTime",
        )
    )
    return reports.withColumn("idle_since", F.timestamp_micros("idle_since"))


def latest_report(reports: DataFrame) -> DataFrame:
    """The last report of each file over all micro-batches; files that went on are left out."""
    last = F.max_by(F.struct("last_event", "idle_since", "n_events", "n_late", "stuck"), F.col("batch_id"))
    return reports.groupBy("file_id").agg(last.alias("r")).select("file_id", "r.*").where("stuck").drop("stuck")


_VERSIONS = "path string, at bigint, length bigint, replaces bigint"


class _Newest(StatefulProcessor):
    """One row of state a path: the modification time of its newest version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.newest.get()[0] if self.newest.exists() else None
        best = None
        for r in rows:
            if (before is None or r.at > before) and (best is None or r.at > best.at):
                best = r
        if best is not None:
            self.newest.update((best.at,))
            yield Row(path=key[0], at=best.at, length=best.length, replaces=before)

    def close(self) -> None:
        pass


def newest_versions(files: DataFrame) -> DataFrame:
    """Of a stream of files (path, modificationTime, length, ...) the versions that are newer than
    all seen before, with the version that each replaces. Contents stay out of the state: they are
    fetched by path and modification time. Versions that arrive after a newer one give no row, and
    nothing depends on a watermark."""
    versions = (
        files.select("path", F.unix_micros("modificationTime").alias("at"), "length").groupBy("path")
        .transformWithState(statefulProcessor=_Newest(), outputStructType=_VERSIONS, outputMode="Update", timeMode="None")
    )
    return versions.select(
        "path", F.timestamp_micros("at").alias("modificationTime"), "length", F.timestamp_micros("replaces").alias("replaces")
    )


def current_versions(versions: DataFrame) -> DataFrame:
    """One row for each path from all that ``newest_versions`` has written."""
    last = F.max_by(F.struct("length", "replaces"), F.col("modificationTime"))
    rows = versions.groupBy("path").agg(F.max("modificationTime").alias("modificationTime"), last.alias("v"))
    return rows.select("path", "modificationTime", "v.length", "v.replaces")


def contents_of(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows of ``files`` whose version is current."""
    return files.join(versions.select("path", "modificationTime"), ["path", "modificationTime"], "left_semi")


def split_late(events: DataFrame, time: str, width: str, lateness: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Split a stream into rows that are counted and rows that come too late, and keep both.

    A row is late if its window had closed before its micro-batch: the window's end lies at or
    before the newest time of all earlier micro-batches less ``lateness``. Each micro-batch writes
    ``counted``, ``late`` and its own newest time below its batch_id; the state is what those of
    smaller numbers have written, so a replayed batch splits its rows as before. Rows without a
    time are late."""

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        times = spark.read.schema("newest timestamp, batch_id bigint")
        spark.createDataFrame([], "newest timestamp").write.mode("append").parquet(f"{folder}/newest/batch_id=-1")
        # one row for each micro-batch
        newest = times.parquet(f"{folder}/newest").where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        # a window of a null would drop its row
        timed = F.coalesce(F.col(time), F.timestamp_micros(F.lit(0)))
        rows = batch.withColumn("_window", F.window(timed, width))
        some = lambda c: F.when(F.col(time).isNotNull(), F.col(f"_window.{c}"))
        rows = rows.withColumns({"window_start": some("start"), "_end": some("end")}).drop("_window")
        closed = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        late = F.col("_end").isNull() | F.coalesce(F.col("_end") <= closed, F.lit(False))
        rows = rows.withColumn("kind", F.when(late, F.lit("late")).otherwise(F.lit("counted"))).drop("_end")
        rows.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/rows/batch_id={batch_id}")
        batch.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{folder}/newest/batch_id={batch_id}")

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Counted, late and all rows by key, from what ``split_late`` has written."""
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "counted").alias("counted"), F.count_if(F.col("kind") == "late").alias("late"),
        F.count(F.lit(1)).alias("n"),
    )

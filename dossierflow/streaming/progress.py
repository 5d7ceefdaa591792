"""Live counts, progress per window and stuck files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def live_counts(events: DataFrame, key: str) -> DataFrame:
    """Running count per key."""
    return events.groupBy(key).agg(F.count("*").alias("n"))


def window_progress(events: DataFrame, time: str, key: str, width: str = "1 day",
                    lateness: str | None = None) -> DataFrame:
    """Events per tumbling window and key. Windows stay open, at one row of state for each window
    and key, so late events count; with ``lateness`` a window closes and later events don't."""
    return (
        (events.withWatermark(time, lateness) if lateness else events)
        .groupBy(F.window(time, width).alias("window"), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), key, "n")
    )


def start_snapshots(counts: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write what each micro-batch changed (``update``) or everything (``complete``)
    under its ``batch_id``; a replayed batch replaces itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return (
        counts.writeStream.outputMode(mode).foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_of_updates(snapshots: DataFrame, *keys: str, value: str = "n") -> DataFrame:
    """Newest value per key over all micro-batches."""
    return snapshots.groupBy(*keys).agg(F.max_by(value, "batch_id").alias(value))


def stuck_by_gap(events: DataFrame, now: Column, gap_seconds: int, terminal: list[str]) -> DataFrame:
    """Files whose last event is not a final one and lies ``gap_seconds`` or more back.
    ``events``: file_id, event_time, seq, event_type."""
    last = events.groupBy("file_id").agg(
        F.max("event_time").alias("last_time"),
        F.max_by("event_type", F.struct("event_time", "seq")).alias("last_event"),
    )
    age = F.unix_seconds(now) - F.unix_seconds("last_time")
    return last.filter(~F.col("last_event").isin(terminal) & (age >= gap_seconds)).withColumn("idle_seconds", age)


def stuck_sessions(events: DataFrame, gap: str, terminal: list[str], lateness: str = "10 minutes") -> DataFrame:
    """The streaming form: a file's events form sessions that end after ``gap`` without
    an event; a session that ends on a non-final event is a stuck file. In a session with
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` a file with very many
    events is merged in each task before the shuffle. Events later than ``lateness`` are dropped;
    ``stateful.stuck_by_timers`` by processing time drops none and needs no newer event."""
    return (
        events.withWatermark("event_time", lateness)
        .groupBy(F.session_window("event_time", gap).alias("session"), "file_id")
        .agg(F.max_by("event_type", F.struct("event_time", "seq")).alias("last_event"))
        .filter(~F.col("last_event").isin(terminal))
        .select("file_id", "last_event", F.col("session.start").alias("started"), F.col("session.end").alias("idle_since"))
    )

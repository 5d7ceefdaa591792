"""Log lines of runs and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.functions.paths import log_file_path
from dossierflow.schemas import STAGE_LABELS, STAGES

LOGGER = "dossierflow.runs"


def format_line(time: Column, name: Column, level: Column, message: Column) -> Column:
    """``time - name - level - message`` with milliseconds after a comma."""
    return F.concat_ws(" - ", F.date_format(time, "yyyy-MM-dd HH:mm:ss,SSS"), name, level, message)


def _run_entries() -> Column:
    """(level, message) of one run, in order; stages that were not reached are silent."""
    tag = F.concat(F.lit("[RUN "), F.col("file_id"), F.lit("] "))

    def entry(level: str, message: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.concat(tag, message).alias("message"))

    entries = [entry("INFO", F.concat(F.lit("Starting "), F.coalesce("filename", F.lit(""))))]
    for i, stage in enumerate(STAGES):
        text = F.lit(f"Stage {i + 1}: {STAGE_LABELS[stage]}")
        entries.append(F.when(F.col("stages_completed") > i, entry("INFO", text)))
    entries.append(
        F.when(F.col("status") == "failed", entry("ERROR", F.concat(F.lit("Failed: "), F.col("error"))))
        .otherwise(entry("INFO", F.lit("Completed")))
    )
    return F.array_compact(F.array(*entries))


def run_logs(wide: DataFrame, started: Column, base: str) -> DataFrame:
    """One row per run: the path of its log file and its lines. A run's log is a handful
    of lines made from its own row, so nothing is grouped."""
    lines = F.transform(
        _run_entries(), lambda e: format_line(F.col("started_at"), F.lit(LOGGER), e["level"], e["message"])
    )
    return wide.withColumn("started_at", started).select(
        "file_id",
        F.date_format("started_at", "yyyy-MM-dd").alias("log_date"),
        log_file_path(F.lit(base), F.col("started_at"), F.col("file_id")).alias("log_file_path"),
        lines.alias("lines"),
    )


def log_lines(logs: DataFrame) -> DataFrame:
    return logs.select("file_id", "log_date", "log_file_path", F.posexplode("lines").alias("seq", "line"))


def log_file_content(logs: DataFrame) -> DataFrame:
    """Content of each run's file: its lines, each ended by a newline."""
    return logs.select(
        "file_id", "log_file_path", F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("content")
    )


def write_logs(logs: DataFrame, folder: str, batch: str) -> None:
    """Log lines below one folder per date and batch of runs. A batch that is written again
    replaces itself; other runs of the day stay."""
    (
        log_lines(logs)
        .select("log_date", F.lit(batch).alias("batch"), "log_file_path", "seq", "line")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_date", "batch").parquet(folder)
    )

"""Dashboard queries: the status table, links, results and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.functions.paths import LINK, document_link, log_link, percent_encode
from dossierflow.functions.replies import clean_control, is_json, repair_json, salvage_items
from dossierflow.plans.status import newest
from dossierflow.schemas import PII_ITEM, ddl


def status_label(status: Column, stage: Column) -> Column:
    where = F.when(F.coalesce(stage, F.lit("")) != "", F.concat(F.lit(" ("), stage, F.lit(")"))).otherwise(F.lit(""))
    return (
        F.when(status == "completed", F.lit("Pass"))
        .when(status == "failed", F.concat(F.lit("Fail"), where))
        .when(status == "processing", F.concat(F.lit("Processing ("), F.coalesce(stage, F.lit("")), F.lit(")")))
        .otherwise(F.coalesce(F.nullif(status, F.lit("")), F.lit("-")))
    )


def actions(status: Column, volume_path: Column) -> Column:
    """What can be done with a file: results to view, or a rerun where its bytes landed."""
    landed = F.coalesce(volume_path, F.lit("")) != ""
    return (
        F.when(status == "completed", F.array(F.lit("View")))
        .when((status == "failed") & landed, F.array(F.lit("Resume"), F.lit("Reprocess"), F.lit("Delete")))
        .when(status == "failed", F.array(F.lit("Delete")))
        .otherwise(F.array(F.lit("-")))
    )


def action_links(status: Column, file_id: Column, filename: Column, volume_path: Column, stage: Column) -> Column:
    """Query strings of the actions, in the same order."""
    name = F.concat(F.lit("&filename="), percent_encode(F.coalesce(filename, F.lit(""))))
    path = F.concat(F.lit("&volume_path="), percent_encode(F.coalesce(volume_path, F.lit(""))))
    failed = F.concat(F.lit("&failed_stage="), percent_encode(F.coalesce(stage, F.lit(""))))
    links = {
        "View": F.concat(F.lit("?view_results="), file_id, name),
        "Resume": F.concat(F.lit("?resume="), file_id, name, path, failed),
        "Reprocess": F.concat(F.lit("?reprocess="), file_id, name, path),
        "Delete": F.concat(F.lit("?delete="), file_id),
    }

    def link(action: Column) -> Column:
        chosen = F.lit("-")
        for label, target in links.items():
            chosen = F.when(action == label, target).otherwise(chosen)
        return chosen

    return F.transform(actions(status, volume_path), link)


def trace_list(trace_ids: Column) -> Column:
    """Trace ids of a file, newest first, blanks left out."""
    trimmed = F.transform(F.split(F.coalesce(trace_ids, F.lit("")), ","), lambda t: F.btrim(t))
    return F.reverse(F.filter(trimmed, lambda t: t != ""))


def trace_labels(trace_ids: Column) -> Column:
    """Display of the list: one id bare, several as Latest and Prev, none as N/A."""
    ids = trace_list(trace_ids)
    labelled = F.transform(
        ids, lambda t, i: F.concat(F.when(i == 0, F.lit("Latest: ")).otherwise(F.lit("Prev: ")), t)
    )
    return F.when(F.size(ids) == 0, F.array(F.lit("N/A"))).when(F.size(ids) == 1, ids).otherwise(labelled)


def shown_time(value: Column, is_text: bool = False) -> Column:
    """yyyy-MM-dd HH:mm:ss, '-' if there is none."""
    text = F.replace(F.left(value, F.lit(19)), F.lit("T"), F.lit(" ")) if is_text else F.date_format(
        value, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("-"))


def with_links(status: DataFrame, host: str, workspace: str, logs_path: str, template: str = LINK) -> DataFrame:
    """Adds file_url and log_url."""
    return status.withColumns(
        {
            "file_url": document_link(F.col("volume_path"), F.col("filename"), host, workspace, template),
            "log_url": log_link(F.col("log_file_path"), F.col("created_at"), F.col("file_id"), logs_path, host, workspace, template),
        }
    )


def status_table(status: DataFrame, limit: int = 20, host: str = "https://workspace.example.com",
                 workspace: str = "0", logs_path: str = "/Volumes/catalog/schema/volume/logs") -> DataFrame:
    """The newest files as the dashboard shows them. The limit comes first, so only the
    shown rows are formatted."""
    shown = with_links(newest(status, limit), host, workspace, logs_path)
    return shown.select(
        "file_id", "filename", "file_url",
        trace_labels(F.col("trace_id")).alias("traces"),
        F.when(F.col("log_url").isNotNull(), F.col("log_url")).otherwise(F.lit("-")).alias("log"),
        F.coalesce(F.nullif("primary_category", F.lit("")), F.lit("-")).alias("category"),
        # a count that was never written shows as empty, not as 0
        F.col("entities_count").alias("entities"),
        F.col("pii_items_masked").alias("pii_masked"),
        status_label(F.col("status"), F.col("current_stage")).alias("status"),
        shown_time(F.col("created_at")).alias("created"),
        shown_time(F.col("updated_at")).alias("updated"),
        actions(F.col("status"), F.col("volume_path")).alias("actions"),
        action_links(F.col("status"), F.col("file_id"), F.col("filename"), F.col("volume_path"),
                     F.col("current_stage")).alias("action_links"),
    )


def read_deidentify(results: DataFrame, stored: str = "deidentify_result") -> DataFrame:
    """Adds how the stored JSON could be read (json, repaired, salvaged, unreadable),
    its PII items and the count to show: the stored one, else the number of items."""
    item = f"array<{ddl(PII_ITEM)}>"
    schema = f"struct<deidentification:struct<pii_items:{item}>,pii_items_masked:int>"
    df = results.withColumn("_json", repair_json(F.col(stored)))
    df = df.withColumn("_read", F.from_json("_json", schema)).withColumn(
        "_salvaged", F.when(F.col("_json").isNull(), salvage_items(F.col(stored)))
    )
    items = F.coalesce("_read.deidentification.pii_items", "_salvaged")
    how = (
        F.when(F.col("_json").isNull() & F.col("_salvaged").isNotNull(), F.lit("salvaged"))
        .when(F.col("_json").isNull(), F.lit("unreadable"))
        .when(is_json(clean_control(F.col(stored))), F.lit("json"))
        .otherwise(F.lit("repaired"))
    )
    return df.withColumns(
        {
            "read_as": how,
            "pii_items": items,
            "pii_shown": F.coalesce("_read.pii_items_masked", F.when(items.isNotNull(), F.size(items)), F.lit(0)),
        }
    ).drop("_json", "_read", "_salvaged")


def pii_items_table(results: DataFrame, stored: str = "deidentify_result") -> DataFrame:
    """One row per PII item, missing parts as ''."""
    rows = read_deidentify(results, stored).select("file_id", "pii_shown", F.posexplode("pii_items").alias("pos", "item"))
    shown = [F.coalesce(f"item.{n}", F.lit("")).alias(alias) for n, alias in (
        ("type", "type"), ("value", "original_value"), ("strategy", "strategy"), ("replacement", "replacement"))]
    return rows.select("file_id", "pii_shown", "pos", *shown)


def run_history(runs: DataFrame) -> DataFrame:
    """Runs newest first with short ids. Needs run_id, filename, status, seconds, timestamp (text)."""
    return runs.orderBy(F.desc("timestamp"), F.asc("run_id")).select(
        F.concat(F.left("run_id", F.lit(8)), F.lit("...")).alias("run"),
        "filename",
        F.initcap("status").alias("status"),
        F.format_string("%.2fs", F.col("seconds")).alias("duration"),
        F.left("timestamp", F.lit(19)).alias("timestamp"),
    )


def upload_list(files: DataFrame) -> DataFrame:
    """Name and size in MB of the files to upload."""
    return files.select("filename", F.round(F.col("size_bytes") / F.lit(1048576.0), 2).alias("size_mb"))


def batch_outcomes(wide: DataFrame) -> DataFrame:
    """Files per outcome of a batch."""
    return wide.groupBy("status").agg(
        F.count("*").alias("files"), F.sum("entities_count").alias("entities"),
        F.sum("pii_items_masked").alias("pii_items"),
    )

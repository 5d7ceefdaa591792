"""Resume and reprocess: which stages run again, on what cached results, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.functions.replies import is_json
from dossierflow.plans.runs import run_stages
from dossierflow.plans.status import changes
from dossierflow.schemas import CATEGORIZATION, EXTRACTION, PARSE, RESUMABLE_STAGES, ddl
from dossierflow.settings import Settings

NO_PATH = "no volume path, neither given nor recorded"


def requested_index(failed_stage: Column) -> Column:
    """Position of the stage to start from; anything but a known stage starts at parse."""
    order = F.array(*[F.lit(s) for s in RESUMABLE_STAGES])
    found = F.array_position(order, F.lower(F.coalesce(failed_stage, F.lit("")))).cast("int")
    return F.greatest(found - 1, F.lit(0))


def stage_at(index: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in RESUMABLE_STAGES]), index)


def trace_history(is_resume: Column, existing: Column, new: Column) -> Column:
    """A resume appends its trace to the file's history, a fresh run replaces it."""
    append = is_resume & (F.coalesce(existing, F.lit("")) != "") & new.isNotNull()
    return F.when(append, F.concat_ws(",", existing, new)).otherwise(new)


def backfill(requests: DataFrame, status: DataFrame) -> DataFrame:
    """Requests with the volume path from the status table where theirs is empty, and
    an error where there is none at all; the existing trace ids come along."""
    known = status.select(
        "file_id", F.col("volume_path").alias("_known_path"), F.col("trace_id").alias("existing_trace_id")
    )
    path = F.coalesce(F.nullif("volume_path", F.lit("")), F.nullif("_known_path", F.lit("")))
    return (
        requests.join(known, "file_id", "left")
        .withColumn("volume_path", path)
        .withColumn("error", F.when(F.col("volume_path").isNull(), F.lit(NO_PATH)))
        .drop("_known_path")
    )


def with_cache(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Adds the cached result of every stage before the requested one, and the index to
    really start from: the first stage whose cached result is missing or unreadable."""
    stored = {
        "cached_parse": ("parse_result", PARSE, 0),
        "cached_categorization": ("categorize_result", CATEGORIZATION, 1),
        "cached_extraction": ("extract_result", EXTRACTION, 2),
    }
    nested = {"cached_categorization": "categorization", "cached_extraction": "extraction"}
    df = requests.join(results.select("file_id", *[c for c, _, _ in stored.values()]), "file_id", "left")
    for name, (column, data_type, index) in stored.items():
        key = nested.get(name)
        schema = ddl(data_type) if key is None else f"struct<{key}:{ddl(data_type)}>"
        wanted = (F.col("requested_index") > index) & is_json(F.col(column))
        value = F.from_json(column, schema)
        value = value if key is None else value[key]
        usable = value["pages"].isNotNull() if key is None else value.isNotNull()
        df = df.withColumn(name, F.when(wanted & usable, value))
    first_missing = (
        F.when(F.col("cached_parse").isNull(), 0)
        .when(F.col("cached_categorization").isNull(), 1)
        .when(F.col("cached_extraction").isNull(), 2)
        .otherwise(3)
    )
    df = df.withColumn("start_index", F.least("requested_index", first_missing))
    keep = {n: F.when(F.col("start_index") > i, F.col(n)) for n, (_, _, i) in stored.items()}
    return df.withColumns(keep).drop(*[c for c, _, _ in stored.values()])


def plan(requests: DataFrame, status: DataFrame, results: DataFrame) -> DataFrame:
    """Everything a rerun needs. ``requests``: file_id, volume_path, filename,
    failed_stage, trace_id (of the new run)."""
    df = backfill(requests, status).withColumn("requested_index", requested_index(F.col("failed_stage")))
    df = df.withColumn("is_resume", F.col("requested_index") > 0).withColumn(
        "trace_ids", trace_history(F.col("is_resume"), F.col("existing_trace_id"), F.col("trace_id"))
    )
    return with_cache(df, results).withColumn("start_stage", stage_at(F.col("start_index")))


def reset_changes(planned: DataFrame, now: Column) -> DataFrame:
    """Status updates that open a rerun: kept stages stay completed, the others are set
    to NULL, and so are the old end time and error."""
    kept = {
        f"stage_{s}_status": F.when(F.col("start_index") > i, F.lit("completed"))
        for i, s in enumerate(RESUMABLE_STAGES)
    }
    update = changes(
        {"status": F.lit("processing"), "current_stage": F.col("start_stage"), "trace_id": F.col("trace_ids"), **kept}
    )
    cleared = F.create_map(
        F.lit("end_time"), F.lit(None).cast("string"), F.lit("error_message"), F.lit(None).cast("string")
    )
    return planned.filter(F.col("error").isNull()).select(
        "file_id", now.alias("event_time"), F.lit(0).cast("long").alias("seq"),
        F.map_concat(update, cleared).alias("changes"),
    )


def run(planned: DataFrame, landed: DataFrame, settings: Settings) -> DataFrame:
    """Wide rows of the rerun. ``landed`` (content, and file_id or volume_path) is joined once,
    and only contents of files that parse again go on; fresh and cached results end up in
    the same columns."""
    again = (F.col("start_index") == 0) & F.col("error").isNull()
    if "file_id" in landed.columns:
        df = planned.join(landed.select("file_id", "content"), "file_id", "left")
        df = df.withColumn("content", F.when(again, F.col("content")))
    else:
        # files that need no content get a key of their own, so that they don't meet in one task
        wanted = F.when(again, F.col("volume_path")).otherwise(F.concat(F.lit("\u0000"), "file_id"))
        content = landed.select(F.col("volume_path").alias("_path"), "content")
        df = planned.withColumn("_wanted", wanted)
        df = df.join(content, F.col("_wanted") == F.col("_path"), "left").drop("_wanted", "_path")
    return run_stages(df.drop("failed_stage"), settings)

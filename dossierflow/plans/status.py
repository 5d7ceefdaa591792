"""Processing status: an append-only log of partial updates, folded into one row per file.

A partial update is a map from column to value. Columns that are absent keep their
value; a column that is present with NULL is set to NULL. Files have no in-place update
or delete, so changes are appended and deletions are anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.schemas import STAGES, STATUS_SCHEMA

# Columns that an update skips when their value is NULL or empty; all others are
# written as given, NULL included.
SKIP_WHEN_EMPTY = ["status", "current_stage", "volume_path", "trace_id", "experiment_id", "run_id", "error_message"]
COLUMNS = [f.name for f in STATUS_SCHEMA.fields]


def changes(values: dict[str, Column]) -> Column:
    """Map of one partial update, without the columns that are skipped when empty."""
    pairs = [c for name, value in values.items() for c in (F.lit(name), value.cast("string"))]
    skipped = F.array(*[F.lit(c) for c in SKIP_WHEN_EMPTY])
    return F.map_filter(
        F.create_map(*pairs),
        lambda k, v: ~(F.array_contains(skipped, k) & (F.coalesce(v, F.lit("")) == "")),
    )


def inserted(filename: Column, volume_path: Column, now: Column) -> Column:
    """First record of a file: pending, at ingest, with three equal times."""
    return F.create_map(
        F.lit("filename"), filename, F.lit("volume_path"), volume_path,
        F.lit("status"), F.lit("pending"), F.lit("current_stage"), F.lit("ingest"),
        F.lit("start_time"), now.cast("string"), F.lit("created_at"), now.cast("string"),
    )


def completed(category: Column, entities: Column, pii_items: Column, now: Column) -> Column:
    """Everything done; the category is skipped when empty, counts when NULL."""
    done = {"status": F.lit("completed"), "current_stage": F.lit("deidentify"), "end_time": now}
    done |= {f"stage_{s}_status": F.lit("completed") for s in STAGES}
    done |= {"primary_category": category, "entities_count": entities, "pii_items_masked": pii_items}
    return F.map_filter(
        changes(done),
        lambda k, v: ~(k.isin("primary_category", "entities_count", "pii_items_masked")
                       & (F.coalesce(v, F.lit("")) == "")),
    )


def failed(error: Column, stage: Column, now: Column) -> Column:
    """Failed, with the message and, if the stage is known, its own status."""
    base = changes({"status": F.lit("failed"), "error_message": error, "end_time": now, "current_stage": stage})
    own = F.when(
        F.coalesce(stage, F.lit("")) != "",
        F.create_map(F.concat(F.lit("stage_"), stage, F.lit("_status")), F.lit("failed")),
    ).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(base, own)


def fold(events: DataFrame) -> DataFrame:
    """Current status per file: per column the value of the latest event that names it.

    One shuffle of one partly folded row per file and task, whatever the number of
    events of a file, and the result does not depend on arrival order.
    """
    order = "struct(event_time, seq)"
    kept = [
        F.expr(f"max_by(changes['{c}'], {order}) FILTER (WHERE map_contains_key(changes, '{c}'))").alias(c)
        for c in COLUMNS
        if c not in ("file_id", "updated_at")
    ]
    folded = (
        events.filter(F.size("changes") > 0)
        .groupBy("file_id")
        .agg(*kept, F.max("event_time").alias("updated_at"))
    )
    return folded.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in STATUS_SCHEMA.fields]
    )


def compact(events: DataFrame) -> DataFrame:
    """A shorter log with the same fold: of each file and column only the latest entry. New
    events are appended to it, late ones too, and it is compacted again; a file costs at most
    one row for each column, however long its history."""
    latest = F.struct("event_time", "seq")
    entries = events.select("file_id", "event_time", "seq", F.explode("changes").alias("name", "value"))
    kept = entries.groupBy("file_id", "name").agg(
        F.max(latest).alias("at"), F.max_by(F.struct("value"), latest).alias("entry")
    )
    return (
        kept.groupBy("file_id", F.col("at.event_time").alias("event_time"), F.col("at.seq").alias("seq"))
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "entry.value"))).alias("changes"))
    )


def initial_events(files: DataFrame, now: Column) -> DataFrame:
    """Records for a whole batch of files before any work starts: inserted as pending,
    then set to processing. Needs file_id and filename; ids come from ``new_file_ids``
    or from the source."""
    steps = F.array(
        inserted(F.col("filename"), F.lit(None).cast("string"), now), changes({"status": F.lit("processing")})
    )
    rows = files.select("file_id", F.posexplode(steps).alias("pos", "changes"))
    return rows.select("file_id", now.alias("event_time"), F.col("pos").cast("long").alias("seq"), "changes")


def new_file_ids(files: DataFrame, *identity: str) -> DataFrame:
    """Adds a file_id that is a digest of the identifying columns: a task that is run
    again gives the same id, which a random one would not."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity])
    return files.withColumn("file_id", F.sha2(text, 256))


def events_of_runs(wide: DataFrame, now: Column) -> DataFrame:
    """The update log that finished runs leave behind, all at one time, in order of
    ``seq``: insert, processing, one update per finished stage, final state. A rerun (a row
    with cached results) leaves no insert; ids of trace, experiment and run and the log's path
    are written if the rows carry them."""
    ran = {
        "ingest": F.col("volume_path").isNotNull() & ~F.col("failed_stage").eqNullSafe("ingest"),
        "parse": F.col("parse").isNotNull() & ~F.col("failed_stage").eqNullSafe("parse"),
        "categorize": F.col("categorization").isNotNull() & ~F.col("failed_stage").eqNullSafe("categorize"),
        "extract": F.col("extraction").isNotNull() & ~F.col("failed_stage").eqNullSafe("extract"),
    }
    null_map = F.lit(None).cast("map<string,string>")
    first = inserted(F.col("filename"), F.lit(None).cast("string"), now)
    opened = {"status": F.lit("processing")}
    if "cached_parse" in wide.columns:
        # a rerun has its record: times of the first run stay, the old outcome is cleared
        first = null_map
        cleared = F.create_map(
            F.lit("error_message"), F.lit(None).cast("string"), F.lit("end_time"), F.lit(None).cast("string")
        )
    else:
        cleared = F.create_map().cast("map<string,string>")
    opened |= {c: F.col(c) for c in ("trace_id", "experiment_id", "run_id", "log_file_path") if c in wide.columns}
    steps = [first, F.map_concat(changes(opened), cleared)]
    for i, stage in enumerate(STAGES[:-1]):
        values = {"current_stage": F.lit(STAGES[i + 1]), f"stage_{stage}_status": F.lit("completed")}
        if stage == "ingest":
            values |= {"status": F.lit("processing"), "volume_path": F.col("volume_path")}
        if stage == "categorize":
            values["primary_category"] = F.col("primary_category")
        steps.append(F.when(ran[stage], changes(values)).otherwise(null_map))
    steps.append(
        F.when(
            F.col("status") == "completed",
            completed(F.col("primary_category"), F.col("entities_count"), F.col("pii_items_masked"), now),
        ).otherwise(failed(F.col("error"), F.col("failed_stage"), now))
    )
    return (
        wide.select("file_id", F.posexplode(F.array(*steps)).alias("pos", "changes"))
        .filter(F.col("changes").isNotNull())
        .select("file_id", now.alias("event_time"), F.col("pos").cast("long").alias("seq"), "changes")
    )


def lookup(status: DataFrame, file_id: str) -> DataFrame:
    return status.filter(F.col("file_id") == file_id)


def newest(status: DataFrame, limit: int = 100) -> DataFrame:
    """Newest files first, rows without a creation time ahead of all; ties by id."""
    return status.orderBy(F.desc_nulls_first("created_at"), F.asc("file_id")).limit(limit)


def processing_status(status: DataFrame, file_id: str | None = None, limit: int = 100) -> DataFrame:
    """One file's record, or the newest ones."""
    return newest(status, limit) if file_id is None else lookup(status, file_id)


def delete_records(status: DataFrame, ids: DataFrame) -> DataFrame:
    """Status without the given files; their results rows stay."""
    return status.join(ids.select("file_id"), "file_id", "left_anti")


def deletion_report(status: DataFrame, ids: DataFrame) -> DataFrame:
    """Per requested id whether there was a record to delete."""
    known = status.select("file_id", F.lit(True).alias("_known"))
    return ids.select("file_id").join(known, "file_id", "left").select(
        "file_id",
        F.coalesce("_known", F.lit(False)).alias("deleted"),
        F.when(F.col("_known").isNull(), F.lit("no record of this file")).alias("error"),
    )


def _stuck(status: DataFrame, limit: int | None) -> tuple[DataFrame, Column]:
    """Files still processing, and the message they are failed with."""
    swept = status if limit is None else newest(status, limit)
    stage = F.coalesce(F.col("current_stage"), F.lit("unknown"))
    message = F.concat(F.lit("The run was cut off by a restart during stage "), stage)
    return swept.filter("status = 'processing'"), message


def reset_stuck(status: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Files that are still processing, as they look after being marked failed. The whole
    table is swept; ``limit`` looks at the newest files only, if asked to."""
    stuck, message = _stuck(status, limit)
    own = {
        f"stage_{s}_status": F.when(F.col("current_stage") == s, F.lit("failed")).otherwise(F.col(f"stage_{s}_status"))
        for s in STAGES
    }
    return stuck.withColumns(
        {"error_message": message, "end_time": now, "updated_at": now, **own, "status": F.lit("failed")}
    )


def reset_stuck_events(status: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """The same sweep as updates to append to the log."""
    stuck, message = _stuck(status, limit)
    return stuck.select(
        "file_id", now.alias("event_time"), F.lit(0).cast("long").alias("seq"),
        failed(message, F.col("current_stage"), now).alias("changes"),
    )


def stage_counts(status: DataFrame) -> DataFrame:
    """Files being processed per stage, empty stages included, and in total; the total
    also counts files at a stage of another name."""
    stage = F.lower("current_stage")
    counters = [F.count_if(stage == s).alias(s) for s in STAGES]
    counts = status.filter("status = 'processing'").agg(*counters, F.count("*").alias("total"))
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"), F.col(name).alias("n"))
        for i, name in enumerate([*STAGES, "total"])
    ]
    return counts.select(F.inline(F.array(*rows)))

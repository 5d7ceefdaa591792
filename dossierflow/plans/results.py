"""The results table: one JSON column per stage and document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.functions.redaction import mask_entities
from dossierflow.schemas import RESULTS_SCHEMA, RESUMABLE_STAGES

COLUMNS = [f.name for f in RESULTS_SCHEMA.fields]


def skeleton(ingested: DataFrame, now: Column) -> DataFrame:
    """Rows as they are right after ingest: ids and path, no stage result yet. Needs
    file_id, trace_id, experiment_id and volume_path."""
    empty = [F.lit(None).cast("string").alias(f"{s}_result") for s in RESUMABLE_STAGES]
    return ingested.select(
        "file_id", "trace_id", "experiment_id", F.col("volume_path").alias("source_volume_path"),
        *empty, now.alias("created_at"), now.alias("updated_at"),
    )


def from_stage_updates(updates: DataFrame) -> DataFrame:
    """Latest JSON per document and stage from long rows (file_id, stage_name,
    result_json, updated_at); unknown stage names are left out."""
    latest = [
        F.expr(f"max_by(result_json, updated_at) FILTER (WHERE stage_name = '{s}')").alias(f"{s}_result")
        for s in RESUMABLE_STAGES
    ]
    return (
        updates.filter(F.col("stage_name").isin(RESUMABLE_STAGES))
        .groupBy("file_id")
        .agg(*latest, F.max("updated_at").alias("updated_at"))
    )


def fold(rows: DataFrame, *within: str) -> DataFrame:
    """One row per file from all rows that runs and reruns appended: of each stage the newest
    result there is, the first creation and the last update. A rerun that fails early leaves
    the later stages' earlier results in place. Columns ``within`` are the same in all rows of a
    file and stay; rows that are dealt out by them are not shuffled again."""
    kept = [c for c in COLUMNS if c not in ("file_id", "created_at", "updated_at")]
    newest = [F.expr(f"max_by({c}, updated_at) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in kept]
    folded = rows.groupBy(*within, "file_id").agg(
        *newest, F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")
    )
    return folded.select(*COLUMNS, *within)


def _inner(json: str, tail: str) -> Column:
    """Keys of a stored stage without its braces and without the given keys at its end."""
    return F.regexp_replace(F.regexp_replace(json, rf"{tail}\}}$", ""), r"^\{", "")


def expanded(results: DataFrame) -> DataFrame:
    """Stored results as a view in which every stage repeats the keys of those before it."""
    time, model = r',"timestamp":"[^"]*"', r'(?:,"model_used":"(?:[^"\\]|\\.)*")?'
    parse = _inner("parse_result", time)
    categorize = _inner("categorize_result", model + time)

    def whole(name: str, *before: Column) -> Column:
        return F.when(F.col(name).isNotNull(), F.concat(
            F.lit("{"), F.concat_ws(",", *before, _inner(name, "")), F.lit("}"))).alias(name)

    made = {
        "categorize_result": whole("categorize_result", parse),
        "extract_result": whole("extract_result", parse, categorize),
        "deidentify_result": whole("deidentify_result", parse, categorize),
    }
    return results.select(*[made.get(c, F.col(c)) for c in results.columns])


def from_wide(wide: DataFrame, now: Column) -> DataFrame:
    """Results rows straight from finished runs, without a shuffle.

    Every stage's JSON holds its own keys, so that a document's text is stored once;
    ``expanded`` shows the form that repeats earlier stages. The extract result keeps the
    entity values as found; only the deidentify result holds the masked ones.
    """
    parse = [F.col(f"parse.{n}").alias(n) for n in ("status", "volume_path", "document_text", "pages", "image_output_path")]
    model = [F.col("model_used"), now.cast("string").alias("timestamp")]
    categorize = [F.col("categorization")]
    counts = [F.col("entities_count"), F.col("entities_count").alias("entities_extracted")]
    extract = [F.col("extraction"), *counts]
    masked = F.struct(
        mask_entities(F.col("extraction.entities")).alias("entities"),
        F.col("extraction.raw_response").alias("raw_response"),
    ).alias("extraction")
    deidentify = [masked, *counts, F.col("deidentification"), F.col("pii_items_masked"), F.col("final_output")]
    json = {
        "parse_result": ("parse", parse + model[1:]),
        "categorize_result": ("categorization", categorize + model),
        "extract_result": ("extraction", extract + model),
        "deidentify_result": ("deidentification", deidentify + model),
    }
    null = F.lit(None).cast("string")
    trace = F.col("trace_id") if "trace_id" in wide.columns else null
    experiment = F.col("experiment_id") if "experiment_id" in wide.columns else null
    return wide.filter(F.col("volume_path").isNotNull()).select(
        "file_id",
        trace.alias("trace_id"),
        experiment.alias("experiment_id"),
        F.col("volume_path").alias("source_volume_path"),
        *[F.when(F.col(present).isNotNull(), F.to_json(F.struct(*fields))).alias(name)
          for name, (present, fields) in json.items()],
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def lookup(results: DataFrame, file_id: str) -> DataFrame:
    return results.filter(F.col("file_id") == file_id).select(*COLUMNS)


def for_files(files: DataFrame, results: DataFrame) -> DataFrame:
    """Results of many files at once; files without a row say so."""
    found = results.withColumn("_found", F.lit(True))
    return (
        files.select("file_id").join(found, "file_id", "left")
        .withColumn("lookup_error", F.when(F.col("_found").isNull(), F.lit("no result is stored for this file")))
        .drop("_found")
    )


def orphans(results: DataFrame, status: DataFrame) -> DataFrame:
    """Results whose status row was deleted."""
    return results.join(status.select("file_id"), "file_id", "left_anti")

"""Traces as rows: one root span and one span per reached stage for every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.functions.prompts import preview
from dossierflow.functions.text import text_sample
from dossierflow.operators.extract import first_items
from dossierflow.schemas import RESUMABLE_STAGES, SPAN_KINDS, STAGES
from dossierflow.settings import Settings

VERSION = "2.0"
PARSER = "rules"


def _map(values: dict[str, Column]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[c for k, v in values.items() for c in (F.lit(k), v.cast("string"))])


def _span(name: str, kind: str, parent: str | None, position: int, attributes, inputs, outputs) -> Column:
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(name).alias("name"),
        F.lit(kind).alias("kind"),
        F.lit(parent).cast("string").alias("parent"),
        attributes.alias("attributes"),
        inputs.alias("inputs"),
        outputs.alias("outputs"),
    )


def _replay_note() -> dict[str, Column]:
    return {"is_cached_replay": F.lit("true"), "note": F.lit("Replayed from previous run")}


def _when_failed(stage: str, good: Column) -> Column:
    """A failed stage's outputs are its error."""
    return F.when(F.col("failed_stage") == stage, _map({"error": F.col("error")})).otherwise(good)


def spans(wide: DataFrame, settings: Settings) -> DataFrame:
    """Long form of the runs: file_id, position, name, kind, parent and three maps.

    Stages that were not reached have no span; stages taken from an earlier run have a
    short one marked ``is_cached_replay``.
    """
    resumed = "cached_parse" in wide.columns
    root = "reprocess_file_pipeline" if resumed else "process_file_pipeline"
    c = F.col
    failed = c("status") == "failed"
    text = c("parse.document_text")

    attributes = {"pipeline_version": F.lit(VERSION), "pipeline_id": c("file_id"), "filename": c("filename")}
    inputs = {"filename": c("filename")}
    if resumed:
        extra = {"volume_path": c("volume_path"), "file_id": c("file_id"), "is_reprocess": F.lit("true"),
                 "resume_from_stage": c("start_stage")}
        if "existing_trace_id" in wide.columns:
            extra["previous_trace_ids"] = F.coalesce(c("existing_trace_id"), F.lit(""))
        attributes |= extra
        inputs |= extra
    else:
        attributes |= {"file_size_bytes": c("file_size_bytes")}
        inputs |= {"file_size_bytes": c("file_size_bytes"), "pipeline_id": c("file_id")}
    if "log_file_path" in wide.columns:
        attributes["log_file_path"] = c("log_file_path")
    failure = _map({
        "pipeline_status": F.lit("failed"),
        "failed_at_stage": c("failed_stage"),
        "stages_completed": c("stages_completed"),
        "error_message": F.left(c("error"), F.lit(500)),
    })
    root_attributes = F.when(failed, F.map_concat(_map(attributes), failure)).otherwise(_map(attributes))
    root_outputs = F.when(
        failed,
        _map({"status": F.lit("failed"), "failed_at_stage": c("failed_stage"),
              "stages_completed": c("stages_completed"), "error": c("error")}),
    ).otherwise(
        _map({"status": c("status"), "stages_completed": c("stages_completed"),
              "primary_category": c("primary_category"), "entities_count": c("entities_count"),
              "pii_items_masked": c("pii_items_masked")})
    )
    rows = [_span(root, "CHAIN", None, 0, root_attributes, _map(inputs), root_outputs)]
    order = RESUMABLE_STAGES if resumed else STAGES
    for stage in order:
        name, kind = SPAN_KINDS[stage]
        position = STAGES.index(stage) + 1
        attrs, ins, outs = _stage_maps(stage, settings, text, wide.columns)
        span = _span(name, kind, root, position, _map(attrs), _map(ins), _when_failed(stage, _map(outs)))
        reached = F.col("stages_completed") > order.index(stage)
        if resumed:
            cached = c("start_index") > order.index(stage)
            replay = _span(
                name, kind, root, position,
                _map({"stage": F.lit(stage), "is_cached_replay": F.lit("true"), "original_file_id": c("file_id"),
                      **_replay_outputs(stage, text)}),
                _map({**_replay_inputs(stage, text), **_replay_note()}),
                _map({"status": F.lit("success"), **_replay_outputs(stage, text), "is_cached_replay": F.lit("true")}),
            )
            span = F.when(cached, replay).otherwise(span)
        rows.append(F.when(reached, span))
    return wide.select("file_id", F.explode(F.array_compact(F.array(*rows))).alias("span")).select("file_id", "span.*")


def _stage_maps(stage: str, settings: Settings, text: Column, columns: list[str]):
    c = F.col
    if stage == "ingest":
        where = {"filename": c("filename"), "catalog": F.lit(settings.catalog), "schema": F.lit(settings.schema),
                 "volume_name": F.lit(settings.volume), "file_size_bytes": c("file_size_bytes")}
        outs = {"status": c("ingest.status"), "volume_path": c("ingest.volume_path"),
                "safe_filename": c("ingest.safe_filename"), "size_bytes": c("ingest.size_bytes"),
                "file_hash_sha256": c("ingest.file_hash_sha256")}
        return {"stage": F.lit(stage), **where}, {**where, "overwrite": F.lit("true")}, outs
    if stage == "parse":
        attrs = {"stage": F.lit(stage), "parser": F.lit(PARSER), "volume_path": c("volume_path")}
        outs = {"status": c("parse.status"), "text_length": F.length(text), "text_sample": text_sample(text),
                "image_output_path": c("parse.image_output_path"), "pages_count": F.size("parse.pages")}
        return attrs, {"volume_path": c("volume_path"), "parser": F.lit(PARSER)}, outs
    attrs = {"stage": F.lit(stage), "model": F.lit(settings.model)}
    if f"{stage}_reply" in columns:
        attrs |= {k: c(f"{stage}_reply.{k}") for k in
                  ("request_id", "prompt_tokens", "completion_tokens", "total_tokens", "finish_reason")}
    ins = {"prompt_template": preview(F.lit(settings.prompts[stage]), 200), "model": F.lit(settings.model),
           "document_text_length": F.coalesce(F.length(text), F.lit(0))}
    if stage == "categorize":
        outs = {k: c(f"categorization.{k}") for k in
                ("primary_category", "primary_confidence", "primary_justification",
                 "secondary_category", "secondary_confidence")}
    elif stage == "extract":
        outs = {"entities_count": c("entities_count"),
                "entities": F.to_json(first_items(c("extraction.entities")))}
    else:
        outs = {"pii_items_masked": c("pii_items_masked"),
                "pii_items": F.to_json(first_items(c("deidentification.pii_items")))}
    return attrs, ins, outs


def _replay_inputs(stage: str, text: Column) -> dict[str, Column]:
    if stage == "parse":
        return {"volume_path": F.col("volume_path")}
    return {"document_text_length": F.coalesce(F.length(text), F.lit(0))}


def _replay_outputs(stage: str, text: Column) -> dict[str, Column]:
    if stage == "parse":
        return {"text_length": F.coalesce(F.length(text), F.lit(0)), "pages_count": F.size("parse.pages")}
    if stage == "categorize":
        return {"primary_category": F.coalesce("primary_category", F.lit("")),
                "confidence": F.coalesce("categorization.primary_confidence", F.lit(0.0))}
    if stage == "extract":
        return {"entities_count": F.col("entities_count")}
    return {}


def failed_runs(span_rows: DataFrame) -> DataFrame:
    """Failed runs per stage, found by span attribute."""
    failed = span_rows.filter("parent IS NULL").filter(F.col("attributes")["pipeline_status"] == "failed")
    return failed.groupBy(F.col("attributes")["failed_at_stage"].alias("failed_at_stage")).agg(
        F.count("*").alias("runs")
    )

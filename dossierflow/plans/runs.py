"""All five stages over a table of documents, as one lazy plan without a shuffle.

Each document carries its own error: a stage is computed only where no earlier stage
failed, and nothing raises, so a bad document never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.functions.prompts import or_default, render_prompt, text_windows
from dossierflow.functions.redaction import mask_entities
from dossierflow.functions.replies import (
    categorization_error,
    categorization_from,
    list_error,
    list_reply,
    parse_reply,
    strip_fence,
)
from dossierflow.functions.text import join_pages
from dossierflow.operators.categorize import with_categorization, with_categorization_from
from dossierflow.operators.extract import item_count
from dossierflow.operators.ingest import ingest_error, ingest_struct, is_supported
from dossierflow.operators.parse import native_text, parse_error, parse_struct, parsed_error, parsed_text
from dossierflow.operators.rules import SharedMatches, entities_of, lines_sql, pii_items_of
from dossierflow.operators.scoring import ModelOptions, one_reply, reply_list_column
from dossierflow.schemas import (
    CATEGORIZATION,
    DEIDENTIFICATION,
    EXTRACTION,
    PARSE,
    REPLY,
    RESUMABLE_STAGES,
    STAGE_LABELS,
    STAGES,
    UNKNOWN_CATEGORY,
    ddl,
)
from dossierflow.settings import Settings

MODEL_STAGES = ("categorize", "extract", "deidentify")


def _null(data_type) -> Column:
    return F.lit(None).cast(ddl(data_type))


def _fail(df: DataFrame, stage: str, message: Column, settings: Settings, ran: Column) -> DataFrame:
    """Record the stage's failure in ``error`` and ``failed_stage`` unless one is there."""
    forced = (settings.force_fail_stage or "").lower() == stage
    text = F.concat(F.lit(f"{STAGE_LABELS[stage]} failed: "), message)
    if forced:
        # the forced failure comes after the stage's work and before its own outcome is read
        text = F.when(ran, F.lit(f"forced to fail at {stage}"))
    elif stage in MODEL_STAGES and settings.hide_stage_errors:
        text = F.lit(None).cast("string")
    return df.withColumns(
        {
            "failed_stage": F.coalesce("failed_stage", F.when(text.isNotNull() & F.col("error").isNull(), F.lit(stage))),
            "error": F.coalesce(F.col("error"), text),
        }
    )


def _due(stage: str) -> Column:
    """Whether a row runs this stage now: nothing failed yet and no cached result is used."""
    return F.col("error").isNull() & (F.col("start_index") <= RESUMABLE_STAGES.index(stage))


def _ingest(docs: DataFrame, settings: Settings) -> DataFrame:
    df = docs.withColumns(
        {
            "start_index": F.lit(0),
            "ingest": ingest_struct(
                F.col("filename"), F.col("content"),
                F.lit(settings.catalog), F.lit(settings.schema), F.lit(settings.volume),
            ),
            "error": F.lit(None).cast("string"),
            "failed_stage": F.lit(None).cast("string"),
        }
    )
    message = ingest_error(F.col("filename"), F.col("content"))
    if settings.enforce_file_limits:
        allowed = is_supported(F.col("filename"), F.octet_length("content"), settings.max_file_bytes)
        message = F.coalesce(message, F.when(~allowed, F.lit("file type or size is not supported")))
    df = _fail(df, "ingest", message, settings, F.lit(True))
    return df.withColumn("volume_path", F.col("ingest.volume_path"))


def _parse(df: DataFrame, settings: Settings, resumed: bool) -> DataFrame:
    due = _due("parse")
    if "payload" in df.columns:
        df = df.withColumn("_parsed", F.when(due, F.try_parse_json("payload")))
        reported = F.when(F.col("_parsed").isNull(), F.lit("payload is not JSON")).otherwise(
            parsed_error(F.col("_parsed")))
        df = df.withColumn("_text", F.when(due, F.coalesce(parsed_text(F.col("_parsed")), F.lit(""))))
    else:
        reported = None
        df = df.withColumn("_text", F.when(due, native_text(F.col("filename"), F.col("content"))))
    df = df.withColumn("_message", F.when(due, parse_error(F.col("volume_path"), F.col("_text"), reported)))
    fresh = F.when(due & F.col("_message").isNull(), parse_struct(F.col("volume_path"), F.col("_text")))
    if resumed:
        fresh = F.when(F.col("start_index") > 0, F.col("cached_parse")).otherwise(fresh)
    df = df.withColumn("parse", F.coalesce(fresh.cast(ddl(PARSE)), _null(PARSE)))
    return _fail(df, "parse", F.col("_message"), settings, due).drop("_message", "_text", "_parsed")


def _scored(df: DataFrame, stage: str, settings: Settings, key: str | None) -> DataFrame:
    """Adds the stage's reply, its result over all windows of the text, and what was wrong."""
    template = F.lit(settings.prompts[stage])
    if f"{stage}_prompt" in df.columns:
        template = or_default(F.col(f"{stage}_prompt"), template)
    windows = text_windows(F.col("_joined"), settings.prompt_chars, settings.prompt_overlap)
    prompts = F.when(_due(stage), F.transform(windows, lambda w: render_prompt(template, w)))
    options = ModelOptions(settings.model, settings.temperature, settings.max_tokens)
    df = df.withColumn("_prompts", prompts)
    df = df.withColumn("_replies", reply_list_column(F.col("_prompts"), settings.scorers[stage], options))
    body = (lambda text: strip_fence(text)) if settings.strip_reply_fences else (lambda text: text)
    df = df.withColumn(
        "_read",
        F.transform("_replies", lambda r: F.struct(
            r["error"].alias("error"), body(r["reply"]).alias("reply"), parse_reply(body(r["reply"])).alias("value"))),
    )
    df = df.withColumn(f"{stage}_reply", one_reply(F.col("_replies")))
    shape = categorization_error if key is None else lambda value: list_error(value, key)
    errors = F.transform("_read", lambda x: F.coalesce(x["error"], shape(x["value"])))
    df = df.withColumn("_error", F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0)))
    if key is None:
        # the surest window decides, the earlier one if two are as sure
        found = F.transform("_read", lambda x: categorization_from(x["value"], x["reply"]).cast(ddl(CATEGORIZATION)))
        sure = lambda c: F.coalesce(c["primary_confidence"], F.lit(-1.0))
        known = lambda c: c["primary_category"] != UNKNOWN_CATEGORY
        rank = lambda c: F.coalesce(known(c).cast("int"), F.lit(0)) + sure(c)
        result = F.aggregate(
            F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), F.get(found, F.lit(0)),
            lambda best, c: F.when(rank(c) > rank(best), c).otherwise(best),
        )
    else:
        found = F.transform("_read", lambda x: list_reply(x["value"], x["reply"], key))
        raw = F.filter(F.transform(found, lambda x: x["raw_response"]), lambda r: r.isNotNull())
        items = F.flatten(F.transform(found, lambda x: x[key]))
        # overlapping windows name some items twice; one window's own repeats stay
        items = F.when(F.size(found) > 1, F.array_distinct(items)).otherwise(items)
        result = F.struct(items.alias(key), F.when(F.size(raw) > 0, F.array_join(raw, "\n")).alias("raw_response"))
    return df.withColumn("_result", result).drop("_prompts", "_replies", "_read")


def _with_matches(df: DataFrame, settings: Settings) -> tuple[DataFrame, SharedMatches]:
    """Adds the matches that extract and deidentify build their items from."""
    shared = SharedMatches(settings.entity_rules, settings.pii_rules)
    texts = {
        "_extract_text": F.when(_due("extract"), F.col("_joined")),
        "_deidentify_text": F.when(_due("deidentify"), F.col("_joined")),
    }
    lines = {"_extract_lines": F.expr(lines_sql("_extract_text")), "_deidentify_lines": F.expr(lines_sql("_deidentify_text"))}
    found = shared.columns(("_extract_text", "_extract_lines"), ("_deidentify_text", "_deidentify_lines"))
    return df.withColumns(texts).withColumns(lines).withColumns(found).drop(*texts, *lines), shared


def _model_stage(df: DataFrame, stage: str, settings: Settings, resumed: bool, searched: dict) -> DataFrame:
    out, data_type, key = {
        "categorize": ("categorization", CATEGORIZATION, None),
        "extract": ("extraction", EXTRACTION, "entities"),
        "deidentify": ("deidentification", DEIDENTIFICATION, "pii_items"),
    }[stage]
    due = _due(stage)
    if stage in settings.scorers:
        df = _scored(df, stage, settings, key)
        message, result = F.when(due, F.col("_error")), F.col("_result")
    else:
        df = df.withColumn(f"{stage}_reply", _null(REPLY))
        message = F.lit(None).cast("string")
        df = df.withColumn("_scan", F.when(due, F.col("_joined")))
        if stage == "categorize":
            if isinstance(settings.lexicon, DataFrame):
                df = with_categorization_from(df, settings.lexicon, "file_id", "_scan", "_native")
            else:
                df = with_categorization(df, settings.lexicon, text="_scan", out="_native")
            result = F.col("_native")
        elif stage == "extract":
            result = F.struct(entities_of("_scan", settings.entity_rules, **searched), F.lit(None).cast("string"))
        else:
            result = F.struct(pii_items_of("_scan", settings.pii_rules, **searched), F.lit(None).cast("string"))
    df = df.withColumn("_message", message)
    fresh = F.when(due & F.col("_message").isNull(), result.cast(ddl(data_type)))
    if resumed and stage != "deidentify":
        fresh = F.when(F.col("start_index") > RESUMABLE_STAGES.index(stage), F.col(f"cached_{out}")).otherwise(fresh)
    df = df.withColumn(out, F.coalesce(fresh, _null(data_type)))
    return _fail(df, stage, F.col("_message"), settings, due).drop("_message", "_native", "_error", "_result", "_scan")


def run_stages(docs: DataFrame, settings: Settings) -> DataFrame:
    """One wide row per document with every stage's result, outcome and counts.

    ``docs`` has file_id, filename and content (bytes); with ``payload`` (JSON text of
    an external parser) the text comes from there. Plans made by ``resume.plan`` carry
    start_index, volume_path and cached_* columns as well and skip what is cached.
    """
    resumed = "cached_parse" in docs.columns
    if resumed:
        df = docs.withColumn("failed_stage", F.lit(None).cast("string"))
        if "error" not in docs.columns:
            df = df.withColumn("error", F.lit(None).cast("string"))
    else:
        df = _ingest(docs, settings)
    df = df.withColumn("file_size_bytes", F.octet_length("content").cast("long"))
    df = _parse(df, settings, resumed)
    df = df.withColumn("_joined", join_pages(F.col("parse.pages")))
    searched, found = {}, []
    for stage in MODEL_STAGES:
        if stage == "extract" and not {"extract", "deidentify"} & set(settings.scorers):
            df, shared = _with_matches(df, settings)
            searched, found = {"search": shared.sql}, list(shared.names.values())
        df = _model_stage(df, stage, settings, resumed, searched)
    return _outcome(df, settings, resumed).drop("_joined", "content", "payload", *found)


def _outcome(df: DataFrame, settings: Settings, resumed: bool) -> DataFrame:
    order = RESUMABLE_STAGES if resumed else STAGES
    failed = F.col("error").isNotNull()
    done = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("failed_stage")).cast("int")
    return df.withColumns(
        {
            "masked_entities": F.when(F.col("deidentification").isNotNull(), mask_entities(F.col("extraction.entities"))),
            "primary_category": F.col("categorization.primary_category"),
            "entities_count": item_count(F.col("extraction.entities")),
            "pii_items_masked": item_count(F.col("deidentification.pii_items")),
            "model_used": F.when(F.col("parse").isNotNull(), F.lit(settings.model)),
            "final_output": F.col("deidentification").isNotNull(),
            "status": F.when(failed, F.lit("failed")).otherwise(F.lit("completed")),
            # a failed stage counts as reached
            "stages_completed": F.when(failed, F.coalesce(done, F.lit(0))).otherwise(F.lit(len(order))),
        }
    )


def failures(wide: DataFrame) -> DataFrame:
    """Failure records: where and why, with the error text cut to a span attribute's length."""
    return wide.filter("status = 'failed'").select(
        "file_id", "filename", "failed_stage", "stages_completed", "error",
        F.left("error", F.lit(500)).alias("error_attribute"),
    )


def summary(wide: DataFrame) -> DataFrame:
    """Completion records, with seconds if the rows carry start_time and end_time."""
    seconds = []
    if {"start_time", "end_time"} <= set(wide.columns):
        seconds = [duration_seconds(F.col("start_time"), F.col("end_time")).alias("total_time_seconds")]
    return wide.select(
        "file_id", "filename", "status", "stages_completed",
        F.when(F.col("status") == "completed", F.col("primary_category")).alias("primary_category"),
        "entities_count", "pii_items_masked", *seconds,
    )


def usage_rows(wide: DataFrame) -> DataFrame:
    """One row per document and model stage that was scored, for ``scoring.token_usage``."""
    calls = [F.struct(F.lit(s).alias("stage"), F.col(f"{s}_reply").alias("r")) for s in MODEL_STAGES]
    rows = wide.select("file_id", F.inline(F.array(*calls)))
    return rows.filter("r.model IS NOT NULL OR r.error IS NOT NULL").select("file_id", "stage", "r.*")


def duration_seconds(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1000000.0)

"""Stage 2: document text from payloads that are already parsed, html, markdown or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.functions.paths import file_extension, image_output_path, is_volume_path
from dossierflow.functions.text import PAGE_BREAK, decode_utf8, html_to_text, markdown_to_text, single_page

NO_TEXT = "No document text extracted"
NO_PARSER = "No parser for this file type"


def parsed_elements(parsed: Column) -> Column:
    """Element texts of a parsed variant; elements without castable content are NULL."""
    elements = F.try_variant_get(parsed, "$.document.elements", "array<variant>")
    return F.transform(elements, lambda e: F.try_variant_get(e, "$.content", "string"))


def parsed_text(parsed: Column) -> Column:
    """Element texts joined by a blank line, NULL elements left out."""
    return F.concat_ws(PAGE_BREAK, parsed_elements(parsed))


def parsed_error(parsed: Column) -> Column:
    return F.try_variant_get(parsed, "$.error_status", "string")


def parse_reason(is_json: Column, status: Column, text: Column) -> Column:
    """Why a payload gives no document, NULL if it gives one."""
    return (
        F.when(~is_json, F.lit("payload is not JSON"))
        .when(status.isNotNull(), F.concat(F.lit("parser reported: "), status))
        .when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(NO_TEXT))
    )


def parse_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``document_text`` and ``parse_error``. Documents the parser refused, and
    documents without text, stay in the table with their reason."""
    return (
        df.withColumn("_parsed", F.try_parse_json(payload))
        .withColumn("_status", parsed_error(F.col("_parsed")))
        .withColumn("_text", parsed_text(F.col("_parsed")))
        .withColumn("parse_error", parse_reason(F.col("_parsed").isNotNull(), F.col("_status"), F.col("_text")))
        .withColumn("document_text", F.when(F.col("parse_error").isNull(), F.col("_text")))
        .drop("_parsed", "_status", "_text")
    )


def native_text(filename: Column, content: Column) -> Column:
    """Text of html, markdown and text files; NULL for types that need a payload."""
    extension = file_extension(filename)
    text = decode_utf8(content)
    return (
        F.when(extension.isin(".html", ".htm"), html_to_text(text))
        .when(extension == ".md", markdown_to_text(text))
        .when(~extension.isin(".pdf", ".docx"), text)
    )


def parse_error(volume_path: Column, text: Column, reported: Column | None = None) -> Column:
    """First reason why stage 2 fails, NULL if it succeeds."""
    reported = F.lit(None).cast("string") if reported is None else reported
    return (
        F.when(~is_volume_path(volume_path),
               F.concat(F.lit("Invalid volume path format: "), F.coalesce(volume_path, F.lit(""))))
        .when(reported.isNotNull(), reported)
        .when(text.isNull(), F.lit(NO_PARSER))
        .when(F.length(text) == 0, F.lit(NO_TEXT))
    )


def parse_struct(volume_path: Column, text: Column) -> Column:
    return F.struct(
        F.lit("success").alias("status"),
        volume_path.alias("volume_path"),
        text.alias("document_text"),
        single_page(text).alias("pages"),
        image_output_path(volume_path).alias("image_output_path"),
    )

"""Declared schemas and the fixed domains every stage shares."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Stage names in order, span names and kinds, the document
# taxonomy, entity types, PII types and redaction strategies.
# ---------------------------------------------------------------------------
STAGES = ["ingest", "parse", "categorize", "extract", "deidentify"]
RESUMABLE_STAGES = ["parse", "categorize", "extract", "deidentify"]
STAGE_LABELS = {
    "ingest": "Ingest",
    "parse": "Parse",
    "categorize": "Categorize",
    "extract": "Extract",
    "deidentify": "De-identify",
}
SPAN_KINDS = {
    "ingest": ("stage_1_ingest", "CHAIN"),
    "parse": ("stage_2_parse", "PARSER"),
    "categorize": ("stage_3_categorize", "LLM"),
    "extract": ("stage_4_extract", "RETRIEVER"),
    "deidentify": ("stage_5_deidentify", "LLM"),
}
CATEGORIES = [
    "Loan Application",
    "Financial Statement",
    "Investment Document",
    "Credit Report",
    "Banking Statement",
    "Tax Document",
    "Insurance Policy",
    "Compliance Document",
    "Contract Agreement",
]
UNKNOWN_CATEGORY = "Unknown"
ENTITY_TYPES = [
    "person",
    "organization",
    "account_number",
    "ssn_tax_id",
    "amount",
    "date",
    "address",
    "email",
    "phone",
    "credit_score",
    "property",
]
PII_TYPES = [
    "person",
    "ssn",
    "tax_id",
    "account_number",
    "routing_number",
    "drivers_license",
    "email",
    "phone",
    "address",
    "date_of_birth",
    "salary_income",
    "credit_score",
    "financial_account_details",
]
MASKED_ENTITY_TYPES = ["person", "organization", "email"]
STRATEGIES = ["REDACT", "MASK", "GENERALIZE"]
REDACTED = "[REDACTED]"
SUPPORTED_EXTENSIONS = [".pdf", ".docx", ".txt", ".html", ".md"]
PROMPT_TEXT_CHARS = 5000
REPLY_EXCERPT_CHARS = 200


def _fields(names: str, data_type: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, data_type) for name in names.split()]


# ---------------------------------------------------------------------------
# Columns of the status and results tables.
# ---------------------------------------------------------------------------
STATUS_SCHEMA = T.StructType(
    [
        T.StructField("file_id", T.StringType(), False),
        T.StructField("filename", T.StringType()),
        T.StructField("volume_path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("current_stage", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("experiment_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("log_file_path", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("stage_ingest_status", T.StringType()),
        T.StructField("stage_parse_status", T.StringType()),
        T.StructField("stage_categorize_status", T.StringType()),
        T.StructField("stage_extract_status", T.StringType()),
        T.StructField("stage_deidentify_status", T.StringType()),
        T.StructField("primary_category", T.StringType()),
        T.StructField("entities_count", T.IntegerType()),
        T.StructField("pii_items_masked", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

RESULTS_SCHEMA = T.StructType(
    [
        T.StructField("file_id", T.StringType(), False),
        T.StructField("trace_id", T.StringType()),
        T.StructField("experiment_id", T.StringType()),
        T.StructField("source_volume_path", T.StringType()),
        T.StructField("parse_result", T.StringType()),
        T.StructField("categorize_result", T.StringType()),
        T.StructField("extract_result", T.StringType()),
        T.StructField("deidentify_result", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# One row per partial update: only the keys present in ``changes`` are written,
# a NULL value writes NULL.
STATUS_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("file_id", T.StringType(), False),
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("changes", T.MapType(T.StringType(), T.StringType()), False),
    ]
)

PAGE = T.StructType(_fields("text", T.StringType()) + _fields("page_id", T.IntegerType()))
PARSE = T.StructType(
    _fields("status volume_path document_text", T.StringType())
    + [T.StructField("pages", T.ArrayType(PAGE))]
    + _fields("image_output_path", T.StringType())
)
CATEGORIZATION = T.StructType(
    [
        T.StructField("primary_category", T.StringType()),
        T.StructField("primary_confidence", T.DoubleType()),
        T.StructField("primary_justification", T.StringType()),
        T.StructField("secondary_category", T.StringType()),
        T.StructField("secondary_confidence", T.DoubleType()),
        T.StructField("secondary_justification", T.StringType()),
    ]
)
ENTITY = T.StructType(
    _fields("type value", T.StringType()) + _fields("confidence", T.DoubleType())
)
MASKED_ENTITY = T.StructType(ENTITY.fields + _fields("masked", T.BooleanType()))
PII_ITEM = T.StructType(_fields("type value strategy replacement", T.StringType()))
EXTRACTION = T.StructType(
    [T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("raw_response", T.StringType())]
)
DEIDENTIFICATION = T.StructType(
    [T.StructField("pii_items", T.ArrayType(PII_ITEM)), T.StructField("raw_response", T.StringType())]
)
REPLY = T.StructType(
    _fields("reply model request_id finish_reason error", T.StringType())
    + _fields("prompt_tokens completion_tokens total_tokens", T.LongType())
)


def ddl(data_type: T.DataType) -> str:
    """DDL text of a type, for ``from_json`` and typed NULLs."""
    return data_type.simpleString()

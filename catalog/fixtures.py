"""Inputs derived from the given tables. Expressions that Spark and the check SQL read
alike are written once; the rest exists in both forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.registry import table, view
from dossierflow.functions.paths import safe_filename
from dossierflow.operators.rules import Lexicon
from dossierflow.plans import status as st
from dossierflow.settings import Settings

# --- uploads: every document as an upload of several file types, names that collide ---
UPLOAD_NAME = (
    "source || ' ' || lang || ' (' || CAST(doc_id % 50 AS string) || ').' || "
    "CASE doc_id % 6 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'html' "
    "WHEN 3 THEN 'PDF' WHEN 4 THEN 'csv' ELSE 'docx' END"
)
SAFE_SQL = (
    "regexp_replace(regexp_replace(replace(filename, ' ', '_'), '[.][^.]*$', ''), '[^A-Za-z0-9_-]', '_', 'g')"
    " || regexp_extract(filename, '[.][^.]*$')"
)
PATH_PREFIX = "CASE WHEN doc_id % 17 = 0 THEN '/tmp/' ELSE '/Volumes/main/' END || lang || '/' || source || '/'"

view("names", f"SELECT doc_id, text, lang, source, {UPLOAD_NAME} AS filename FROM documents")
view(
    "uploads",
    f"SELECT *, {SAFE_SQL} AS safe_filename, {PATH_PREFIX} || {SAFE_SQL} AS volume_path FROM names",
    ("names",),
)


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    named = docs.withColumn("filename", F.expr(UPLOAD_NAME))
    return named.withColumn("safe_filename", safe_filename(F.col("filename"))).withColumn(
        "volume_path", F.concat(F.expr(PATH_PREFIX), "safe_filename")
    )


# --- documents to run: txt, every 11th a pdf nobody can read, every 23rd without content ---
RUN_NAME = (
    "source || ' ' || lang || ' (' || CAST(doc_id % 50 AS string) || ')' || "
    "CASE WHEN doc_id % 11 = 0 THEN '.pdf' ELSE '.txt' END"
)
RUN_SETTINGS = dict(catalog="main", schema="docs", volume="inbox")
view(
    "run_docs",
    f"""SELECT 'd' || doc_id AS file_id, doc_id, {RUN_NAME} AS filename,
        CASE WHEN doc_id % 23 <> 0 THEN text END AS content FROM documents""",
)
view(
    "runs",
    """SELECT *, CASE WHEN content IS NULL THEN 'ingest' WHEN doc_id % 11 = 0 THEN 'parse' END AS failed_stage,
        CASE WHEN content IS NULL THEN 'Ingest failed: file has no content'
             WHEN doc_id % 11 = 0 THEN 'Parse failed: No parser for this file type' END AS error FROM run_docs""",
    ("run_docs",),
)


def run_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("file_id"),
        F.expr(RUN_NAME).alias("filename"),
        F.expr("CASE WHEN doc_id % 23 <> 0 THEN CAST(text AS binary) END").alias("content"),
    )


def run_settings(**changes) -> Settings:
    return Settings(**RUN_SETTINGS, lexicon=COMMON_WORDS, **changes)


# --- account statements: labelled financial texts from orders and their customers ---
_C = "o_custkey"
_O = "o_orderkey"


def _pad(number: str, width: int) -> str:
    return f"lpad(CAST({number} AS string), {width}, '0')"


def _line(text: str, when: str | None = None) -> str:
    return f"CASE WHEN {when} THEN {text} || chr(10) ELSE '' END" if when else f"{text} || chr(10)"


STATEMENT_TEXT = " || ".join(
    [
        _line("'ACCOUNT STATEMENT ' || o_orderpriority"),
        _line(f"'Account Holder: Alex ' || chr(CAST(65 + {_C} % 26 AS int)) || '. ' "
              "|| substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2))"),
        _line(f"'Account Number: ****-****-' || {_pad(_C + ' % 10000', 4)}"),
        _line(f"'Routing Number: ' || {_pad(_C + ' * 7919 % 1000000000', 9)}", f"{_O} % 2 = 0"),
        _line("'Statement Date: ' || substr(CAST(o_orderdate AS string), 1, 10)"),
        _line(f"'SSN: ***-**-' || {_pad(_O + ' % 10000', 4)}", f"{_O} % 3 = 0"),
        _line(f"'SSN: ' || {_pad(_O + ' % 900', 3)} || '-45-' || {_pad(_C + ' % 10000', 4)}", f"{_O} % 3 = 1"),
        _line(f"'Tax ID: 45-' || {_pad(_O, 7)}", f"{_O} % 5 = 0"),
        _line("'Beginning Balance: $' || CAST(CAST(floor(c_acctbal) AS bigint) AS string) || '.00'", "c_acctbal > 0"),
        _line("'Ending Balance ('|| substr(CAST(o_orderdate AS string), 6, 5) || '): $' "
              "|| CAST(CAST(floor(o_totalprice) AS bigint) AS string) || '.50'"),
        _line(f"'Fees: $1,2' || {_pad(_C + ' % 100', 2)} || '.25, interest rate ' || CAST({_C} % 20 AS string) || '.5%'"),
        _line(f"'Credit Score: ' || CAST(300 + {_C} % 550 AS string)", f"{_O} % 4 = 0"),
        _line(f"'Annual Income: $' || CAST(20000 + {_C} * 13 % 90000 AS string)", f"{_O} % 4 = 1"),
        _line(f"'Date of Birth: 19' || {_pad('50 + ' + _C + ' % 50', 2)} || '-04-15'", f"{_O} % 6 = 0"),
        _line(f"'Driver''s License: D' || {_pad(_C, 8)}", f"{_O} % 7 = 0"),
        _line(f"'Address: ' || CAST({_C} % 900 + 1 AS string) || ' Oak Avenue, Denver, CO 8' || {_pad(_C + ' % 10000', 4)}"),
        _line(f"'Property Address: ' || CAST({_O} % 900 + 1 AS string) || ' Elm Street, Austin, TX 7' || {_pad(_O + ' % 10000', 4)}",
              "o_orderstatus = 'F'"),
        _line(f"'Email: user' || CAST({_C} AS string) || '@mail.example.com'"),
        _line(f"'Phone: (303) 555-' || {_pad(_O + ' % 10000', 4)} || ' or 1-800-555-0199'"),
        _line(f"'Lender: Prairie ' || chr(CAST(65 + {_C} % 26 AS int)) || '. Savings'", f"{_O} % 8 = 0"),
        _line("'Serviced by First Plains Bank'", f"{_O} % 9 = 0"),
    ]
)
view(
    "statements",
    f"""SELECT o_orderkey AS doc_id, {STATEMENT_TEXT} AS text
        FROM orders JOIN customer ON o_custkey = c_custkey""",
)


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """The orders are dealt out while they are narrow; the texts are made where they are used."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice"
    ).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.select(F.col("o_orderkey").alias("doc_id"), F.expr(STATEMENT_TEXT).alias("text"))


# --- lexicon of words that the generated prose really holds ---
COMMON_WORDS = Lexicon(
    tuple(
        (category, term, weight)
        for category, weight, words in (
            ("Articles", 1.0, "the of and"),
            ("Verbs", 1.5, "to is be"),
            ("Pronouns", 2.0, "it was for"),
            ("Relations", 2.5, "with this are"),
        )
        for term in words.split()
    )
)


def lexicon_values(lexicon: Lexicon) -> str:
    return ", ".join(f"('{c}', '{t}', {w})" for c, t, w in lexicon.terms)


view("lexicon", f"SELECT * FROM (VALUES {lexicon_values(COMMON_WORDS)}) AS v(category, term, weight)")

# --- payloads of an external parser ---
view(
    "payloads",
    """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN [] ELSE
            list_append(list_append(list_transform(string_split(text, chr(10)),
                lambda line: json_object('content', line)), json_object('content', NULL)),
                json_object('id', 1, 'content', 7)) END AS elements,
        CASE WHEN doc_id % 11 = 0 THEN 'E' || doc_id END AS error_status FROM documents""",
)


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    texts = F.transform(F.split("text", "\n"), lambda t: F.to_json(F.struct(t.alias("content"))))
    elements = F.concat(texts, F.array(F.lit('{"content":null}'), F.lit('{"id":1,"content":7}')))
    elements = F.when(F.col("doc_id") % 13 == 0, F.array().cast("array<string>")).otherwise(elements)
    error = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit('"E'), F.col("doc_id"), F.lit('"'))).otherwise(F.lit("null"))
    return docs.select(
        "doc_id",
        F.concat(F.lit('{"document":{"elements":['), F.array_join(elements, ","), F.lit(']},"error_status":'), error,
                 F.lit("}")).alias("payload"),
    )


# --- model replies: one shape per doc_id % 7 ---
GOOD_REPLY = (
    """'{"primary_category": "Tax Document", "primary_confidence": 0.' || CAST(doc_id % 90 + 10 AS string) || """
    """', "primary_justification": "j' || CAST(doc_id AS string) || '", "secondary_category": "Loan Application", """
    """"secondary_confidence": 0.05, "entities": [{"type": "person", "value": "P' || CAST(doc_id AS string) || '", "confidence": 0.9}, """
    """{"type": "email", "value": "e' || CAST(doc_id AS string) || '@example.com", "confidence": 0.8}' || """
    """CASE WHEN doc_id % 2 = 0 THEN ', {"type": "amount", "value": "$5"}' ELSE '' END || """
    """'], "pii_items": [{"type": "email", "value": "e' || CAST(doc_id AS string) || '@example.com", """
    """"strategy": "REDACT", "replacement": "[REDACTED]"}]}'"""
)
REPLY = (
    f"CASE doc_id % 7 WHEN 0 THEN {GOOD_REPLY} "
    f"WHEN 1 THEN '```json' || chr(10) || {GOOD_REPLY} || chr(10) || '```' "
    f"WHEN 2 THEN substr({GOOD_REPLY}, 1, 100) "
    "WHEN 3 THEN '[1, 2]' "
    """WHEN 4 THEN '{"entities": [{"type": "person", "value": "Q"}], "note": "none"}' """
    """WHEN 5 THEN '{"primary_category": "Credit Report", "entities": null, "pii_items": null}' """
    "ELSE 'Here is what was found. ' || text END"
)
view("replies", f"SELECT doc_id, doc_id % 7 AS shape, {REPLY} AS reply FROM documents")


def replies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr(REPLY).alias("reply"))


# --- status updates from events ---
CATEGORY = "'C' || CAST(event_id % 4 AS string)"
FAILED_STAGE = "CASE event_id % 4 WHEN 0 THEN 'parse' WHEN 1 THEN 'categorize' WHEN 2 THEN 'extract' ELSE 'deidentify' END"
_EVENTS = "SELECT 'f' || user_id AS file_id, ts, event_id, event_type FROM events"
view("ev", _EVENTS)
view(
    "updates",
    f"""SELECT file_id, ts, event_id, unnest(cols) AS col, unnest(vals) AS val FROM (
        SELECT file_id, ts, event_id,
          list_concat(CASE event_type
            WHEN 'click' THEN ['status', 'current_stage', 'stage_parse_status']
            WHEN 'view' THEN ['status', 'current_stage', 'stage_categorize_status', 'primary_category']
            WHEN 'signup' THEN ['status', 'current_stage', 'stage_extract_status']
            WHEN 'purchase' THEN ['status', 'current_stage', 'end_time', 'stage_ingest_status', 'stage_parse_status',
               'stage_categorize_status', 'stage_extract_status', 'stage_deidentify_status', 'primary_category',
               'entities_count', 'pii_items_masked']
            ELSE ['status', 'current_stage', 'end_time', 'error_message', 'stage_' || {FAILED_STAGE} || '_status'] END,
            CASE WHEN event_id % 10 = 0 THEN ['stage_deidentify_status'] ELSE [] END) AS cols,
          list_concat(CASE event_type
            WHEN 'click' THEN ['processing', 'categorize', 'completed']
            WHEN 'view' THEN ['processing', 'extract', 'completed', {CATEGORY}]
            WHEN 'signup' THEN ['processing', 'deidentify', 'completed']
            WHEN 'purchase' THEN ['completed', 'deidentify', ts::varchar, 'completed', 'completed', 'completed',
               'completed', 'completed', {CATEGORY}, (event_id % 10)::varchar, (event_id % 3)::varchar]
            ELSE ['failed', {FAILED_STAGE}, ts::varchar, 'boom ' || event_id, 'failed'] END,
            CASE WHEN event_id % 10 = 0 THEN [NULL] ELSE [] END) AS vals
        FROM ev WHERE NOT (event_id % 10 = 0 AND (event_type = 'purchase'
            OR (event_type = 'error' AND event_id % 4 = 3)))
        UNION ALL
        SELECT file_id, ts, event_id,
          CASE event_type WHEN 'purchase' THEN ['status', 'current_stage', 'end_time', 'stage_ingest_status',
               'stage_parse_status', 'stage_categorize_status', 'stage_extract_status', 'stage_deidentify_status',
               'primary_category', 'entities_count', 'pii_items_masked']
            ELSE ['status', 'current_stage', 'end_time', 'error_message', 'stage_deidentify_status'] END,
          CASE event_type WHEN 'purchase' THEN ['completed', 'deidentify', ts::varchar, 'completed', 'completed',
               'completed', 'completed', NULL, {CATEGORY}, (event_id % 10)::varchar, (event_id % 3)::varchar]
            ELSE ['failed', {FAILED_STAGE}, ts::varchar, 'boom ' || event_id, NULL] END
        FROM ev WHERE event_id % 10 = 0 AND (event_type = 'purchase' OR (event_type = 'error' AND event_id % 4 = 3)))""",
    ("ev",),
)


def _latest(column: str) -> str:
    return f"arg_max_null(val, (ts, event_id)) FILTER (WHERE col = '{column}') AS {column}"


view(
    "status",
    f"""SELECT file_id, 'file ' || file_id || '.txt' AS filename,
        CASE WHEN CAST(substr(file_id, 2) AS bigint) % 5 = 0 THEN NULL ELSE '/Volumes/main/docs/inbox/' || file_id || '.txt' END AS volume_path,
        {_latest('status')}, {_latest('current_stage')}, {_latest('end_time')}, {_latest('error_message')},
        {', '.join(_latest(f'stage_{s}_status') for s in ('ingest', 'parse', 'categorize', 'extract', 'deidentify'))},
        {_latest('primary_category')}, CAST({_latest('entities_count').replace(' AS entities_count', '')} AS int) AS entities_count,
        CAST({_latest('pii_items_masked').replace(' AS pii_items_masked', '')} AS int) AS pii_items_masked,
        'tr' || file_id || CASE WHEN CAST(substr(file_id, 2) AS bigint) % 3 = 0 THEN ', ,tr2' || file_id ELSE '' END AS trace_id,
        min(ts) AS created_at, max(ts) AS updated_at
        FROM updates GROUP BY file_id""",
    ("updates",),
)


def stage_events(spark: SparkSession, sf: str) -> DataFrame:
    """The update log: one insert per file at its first event, then one update per event."""
    ev = table(spark, sf, "events").select(
        F.concat(F.lit("f"), F.col("user_id")).alias("file_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("event_id").alias("seq"), "event_id", "event_type",
    )
    category, stage = F.expr(CATEGORY), F.expr(FAILED_STAGE)
    done = F.lit("completed")

    def step(next_stage: str, finished: str, **more):
        return st.changes({"status": F.lit("processing"), "current_stage": F.lit(next_stage),
                           f"stage_{finished}_status": done, **more})

    update = (
        F.when(F.col("event_type") == "click", step("categorize", "parse"))
        .when(F.col("event_type") == "view", step("extract", "categorize", primary_category=category))
        .when(F.col("event_type") == "signup", step("deidentify", "extract"))
        .when(F.col("event_type") == "purchase",
              st.completed(category, F.col("event_id") % 10, F.col("event_id") % 3, F.col("event_time")))
        .otherwise(st.failed(F.concat(F.lit("boom "), F.col("event_id")), stage, F.col("event_time")))
    )
    reset = F.create_map(F.lit("stage_deidentify_status"), F.lit(None).cast("string"))
    # an explicit NULL in the same update replaces the value the update would have set
    update = F.when(
        F.col("event_id") % 10 == 0,
        F.map_concat(F.map_filter(update, lambda k, v: k != "stage_deidentify_status"), reset),
    ).otherwise(update)
    updates = ev.select("file_id", "event_time", "seq", update.alias("changes"))
    number = F.substring("file_id", 2, 20).cast("bigint")
    path = F.when(number % 5 != 0, F.concat(F.lit("/Volumes/main/docs/inbox/"), F.col("file_id"), F.lit(".txt")))
    trace = F.concat(F.lit("tr"), F.col("file_id"),
                     F.when(number % 3 == 0, F.concat(F.lit(", ,tr2"), F.col("file_id"))).otherwise(F.lit("")))
    first = ev.groupBy("file_id").agg(F.min("event_time").alias("event_time"))
    inserts = first.select(
        "file_id", "event_time", F.lit(-1).cast("long").alias("seq"),
        F.map_concat(
            st.inserted(F.concat(F.lit("file "), F.col("file_id"), F.lit(".txt")), path, F.col("event_time")),
            F.create_map(F.lit("trace_id"), trace),
        ).alias("changes"),
    )
    return updates.unionByName(inserts)


def status(spark: SparkSession, sf: str) -> DataFrame:
    return st.fold(stage_events(spark, sf))

"""Prompts, scoring, replies."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query, table
from dossierflow.functions import prompts, replies as rp
from dossierflow.operators.scoring import distinct_scores, one_reply, reply_list_column, stub_scorer, token_usage
from dossierflow.plans.runs import MODEL_STAGES, run_stages, usage_rows
from dossierflow.settings import Settings
from dossierflow.sources.folders import work_folder

TEMPLATE = 'Read this:\n{document_text}\nAnswer {{"ok": true}}'


# windows of the whole text in the check SQL: 5,000 characters, of which 500 are shared with the next
_WINDOWS = """SELECT doc_id, text, i, substr(coalesce(text, ''), CAST(i * 4500 + 1 AS bigint), 5000) AS w FROM (
    SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(coalesce(text, '')) - 500) / 4500.0), 1) AS bigint))) AS i FROM documents)"""


@query(
    "render_prompt",
    f"""SELECT doc_id, CAST(i AS int) AS part, md5(CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id || ': ' || w
    ELSE 'Read this:' || chr(10) || w || chr(10) || 'Answer {{"ok": true}}' END) AS prompt_md5,
    CASE WHEN doc_id % 2 = 0 THEN 'big' ELSE 'rules' END AS model FROM ({_WINDOWS})""",
)
def render_prompt(spark, sf):
    """A prompt for each window of every text. Own templates for a third of the documents, an
    empty or missing one otherwise."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("T"), "doc_id", F.lit(": {document_text}"))).when(
        F.col("doc_id") % 3 == 1, F.lit(""))
    template = prompts.or_default(own, TEMPLATE)
    model = prompts.or_default(F.when(F.col("doc_id") % 2 == 0, F.lit("big")), "rules")
    windows = docs.select("doc_id", template.alias("template"), model.alias("model"),
                          F.posexplode(prompts.text_windows(F.col("text"))).alias("part", "w"))
    return windows.select("doc_id", "part", F.md5(prompts.render_prompt(F.col("template"), F.col("w"))).alias("prompt_md5"), "model")


@query("prompt_preview",
       "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def prompt_preview(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", prompts.preview(F.col("text"), 200).alias("preview"))


# pieces between white space, as the stub counts tokens: all characters that Python splits at
_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TOKENS = f"len(regexp_extract_all(w, '[^{_SPACE}]+'))"


def _template_tokens(template: str) -> int:
    """Tokens of a prompt beside those of its text, which stands between white space."""
    return len(template.replace("{document_text}", " ").split())


@query(
    "score_stub",
    f"""SELECT doc_id, 'stub' AS model, 'stop' AS finish_reason, CAST(sum({_TOKENS} + {_template_tokens(TEMPLATE)}) AS bigint) AS prompt_tokens,
    CAST(sum({_TOKENS} + {_template_tokens(TEMPLATE) + 6}) AS bigint) AS total_tokens FROM ({_WINDOWS}) GROUP BY doc_id""",
)
def score_stub(spark, sf):
    """All windows of every text, unaltered; one reply for each document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    asked = F.transform(prompts.text_windows(F.col("text")), lambda w: prompts.render_prompt(F.lit(TEMPLATE), w))
    scored = docs.select("doc_id", reply_list_column(asked, stub_scorer).alias("replies")).select(
        "doc_id", one_reply(F.col("replies")).alias("r"))
    return scored.select("doc_id", "r.model", "r.finish_reason", "r.prompt_tokens", "r.total_tokens")


def _mail_scorer(asked, options):
    """Answers with the mail addresses that stand after white space in a prompt."""
    import json
    import re

    from dossierflow.operators.scoring import Reply

    found = [re.findall(r"\s([a-z]+\.[0-9]+@mail[0-9]\.example\.com)", p) for p in asked]
    return [Reply(json.dumps({"entities": [{"type": "email", "value": m} for m in f]}), "mail") for f in found]


@query(
    "scored_windows",
    r"""SELECT doc_id, count(DISTINCT m) AS mails, md5(coalesce(string_agg(DISTINCT m, ',' ORDER BY m), '')) AS mails_md5 FROM (
    SELECT doc_id, unnest(CASE WHEN len(f) = 0 THEN [NULL] ELSE f END) AS m FROM (
    SELECT doc_id, regexp_extract_all(text, '\s([a-z]+\.[0-9]+@mail[0-9]\.example\.com)', 1) AS f FROM documents)) GROUP BY doc_id""",
)
def scored_windows(spark, sf):
    """A whole run with a model: it sees every part of every text."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("file_id"), F.lit("a.txt").alias("filename"),
        F.col("text").cast("binary").alias("content"))
    wide = run_stages(docs, Settings(scorers={"extract": _mail_scorer}, prompts={"extract": "|{document_text}|"}))
    mails = F.array_sort(F.array_distinct(F.transform("extraction.entities", lambda e: e["value"])))
    return wide.select(
        F.col("file_id").cast("long").alias("doc_id"), F.size(mails).cast("long").alias("mails"),
        F.md5(F.array_join(mails, ",")).alias("mails_md5"))


def _usage_sql(where: str = "") -> str:
    """Usage of the three model stages over all windows of all texts."""
    of_stage = [
        f"""SELECT '{stage}' AS stage, {_template_tokens(prompts.default_prompt(stage))} AS around""" for stage in MODEL_STAGES
    ]
    return f"""SELECT stage, 'stub' AS model, count(*) AS calls, CAST(sum(tokens) AS bigint) AS prompt_tokens,
    CAST(6 * sum(windows) AS bigint) AS completion_tokens, CAST(sum(tokens + 6 * windows) AS bigint) AS total_tokens
    FROM (SELECT doc_id, stage, count(*) AS windows, sum({_TOKENS} + around) AS tokens FROM ({_WINDOWS}),
    ({' UNION ALL '.join(of_stage)}) {where} GROUP BY doc_id, stage) GROUP BY stage"""


@query("token_usage", _usage_sql())
def token_usage_query(spark, sf):
    """Usage of each model stage: every window of every text, with the stage's own prompt."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    calls = []
    for stage in MODEL_STAGES:
        asked = F.transform(prompts.text_windows(F.col("text")), lambda w: prompts.render_prompt(F.lit(prompts.default_prompt(stage)), w))
        scored = docs.select(reply_list_column(asked, stub_scorer).alias("replies"))
        calls.append(scored.select(F.lit(stage).alias("stage"), one_reply(F.col("replies")).alias("r")).select("stage", "r.*"))
    usage = token_usage(calls[0].unionByName(calls[1]).unionByName(calls[2]))
    return usage.select("stage", "model", "calls", "prompt_tokens", "completion_tokens", "total_tokens")


@query(
    "reply_fallback",
    """SELECT doc_id,
    CASE shape WHEN 0 THEN 'Tax Document' WHEN 5 THEN 'Credit Report' ELSE 'Unknown' END AS primary_category,
    CASE shape WHEN 0 THEN CAST('0.' || (doc_id % 90 + 10) AS double) WHEN 5 THEN NULL ELSE 0.0 END AS primary_confidence,
    CASE shape WHEN 0 THEN 'j' || doc_id WHEN 5 THEN NULL ELSE left(reply, 200) END AS primary_justification,
    CASE shape WHEN 0 THEN 2 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END WHEN 5 THEN 0 ELSE 0 END AS entities_count,
    CASE WHEN shape IN (1, 2, 6) THEN reply END AS raw_response,
    CASE shape WHEN 0 THEN 1 ELSE 0 END AS pii_count
    FROM replies WHERE shape NOT IN (3, 4)""",
    ("replies",),
)
def reply_fallback(spark, sf):
    df = fx.replies(spark, sf).withColumn("v", rp.parse_reply(F.col("reply")))
    value, reply = F.col("v"), F.col("reply")
    df = df.filter(rp.categorization_error(value).isNull())
    df = df.select(
        "doc_id",
        rp.categorization_from(value, reply).alias("c"),
        rp.list_reply(value, reply, "entities").alias("e"),
        rp.list_reply(value, reply, "pii_items").alias("p"),
    )
    return df.select(
        "doc_id", "c.primary_category", "c.primary_confidence", "c.primary_justification",
        F.size("e.entities").alias("entities_count"), "e.raw_response", F.size("p.pii_items").alias("pii_count"),
    )


@query(
    "reply_shape_errors",
    """SELECT doc_id,
    CASE shape WHEN 3 THEN 'reply is not a JSON object' WHEN 4 THEN 'reply has no primary_category' END AS categorize_error,
    CASE shape WHEN 3 THEN 'reply is not a JSON object' WHEN 5 THEN 'entities is not a list' END AS extract_error,
    CASE shape WHEN 3 THEN 'reply is not a JSON object' WHEN 5 THEN 'pii_items is not a list' END AS deidentify_error
    FROM replies""",
    ("replies",),
)
def reply_shape_errors(spark, sf):
    df = fx.replies(spark, sf).withColumn("v", rp.parse_reply(F.col("reply")))
    return df.select(
        "doc_id",
        rp.categorization_error(F.col("v")).alias("categorize_error"),
        rp.list_error(F.col("v"), "entities").alias("extract_error"),
        rp.list_error(F.col("v"), "pii_items").alias("deidentify_error"),
    )


@query(
    "reply_entities",
    """SELECT doc_id, 0 AS pos, 'person' AS type, 'P' || doc_id AS value, 0.9 ::double AS confidence FROM replies WHERE shape = 0
    UNION ALL SELECT doc_id, 1, 'email', 'e' || doc_id || '@example.com', 0.8 FROM replies WHERE shape = 0
    UNION ALL SELECT doc_id, 2, 'amount', '$5', NULL FROM replies WHERE shape = 0 AND doc_id % 2 = 0
    UNION ALL SELECT doc_id, 0, 'person', 'Q', NULL FROM replies WHERE shape = 4""",
    ("replies",),
)
def reply_entities(spark, sf):
    df = fx.replies(spark, sf).withColumn("v", rp.parse_reply(F.col("reply")))
    rows = df.select("doc_id", F.posexplode(rp.entities_from(F.col("v"))).alias("pos", "e"))
    return rows.select("doc_id", "pos", "e.type", "e.value", "e.confidence")


@query(
    "reply_fenced",
    "SELECT doc_id, 'Tax Document' AS primary_category FROM replies WHERE shape IN (0, 1)",
    ("replies",),
)
def reply_fenced(spark, sf):
    """Fenced replies read with the opt-in fence strip."""
    df = fx.replies(spark, sf).withColumn("v", rp.parse_reply(rp.strip_fence(F.col("reply"))))
    found = df.select("doc_id", F.try_variant_get("v", "$.primary_category", "string").alias("primary_category"))
    return found.filter("primary_category = 'Tax Document'")


@query("run_usage", _usage_sql("WHERE length(trim(text)) > 0"))
def run_usage(spark, sf):
    """Tokens of each model stage over whole runs."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("file_id"), F.lit("a.txt").alias("filename"),
        F.col("text").cast("binary").alias("content"))
    wide = run_stages(docs, Settings(scorers={s: stub_scorer for s in MODEL_STAGES}))
    return token_usage(usage_rows(wide)).select(
        "stage", "model", "calls", "prompt_tokens", "completion_tokens", "total_tokens")


@query(
    "scored_once",
    f"""SELECT count(*) AS prompts, count(DISTINCT w) AS calls, CAST(sum({_TOKENS} + {_template_tokens(TEMPLATE)}) AS bigint) AS prompt_tokens,
    (SELECT CAST(sum({_TOKENS} + {_template_tokens(TEMPLATE)}) AS bigint) FROM (SELECT DISTINCT w FROM ({_WINDOWS}))) AS paid_tokens FROM ({_WINDOWS})""",
)
def scored_once(spark, sf):
    """Windows of all texts, equal ones scored once: each prompt has its reply, few were asked for."""
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(prompts.text_windows(F.col("text"))).alias("part", "w"))
    asked = docs.select("doc_id", "part", prompts.render_prompt(F.lit(TEMPLATE), F.col("w")).alias("prompt"))
    replies = distinct_scores(asked, "prompt", stub_scorer, folder=work_folder(spark, "scored-once"))
    return replies.agg(
        F.count("r.reply").alias("prompts"), F.count_if("asked").alias("calls"), F.sum("r.prompt_tokens").alias("prompt_tokens"),
        F.sum(F.when(F.col("asked"), F.col("r.prompt_tokens"))).alias("paid_tokens"))


def _poisoned(asked, options):
    """Fails as a whole if one prompt of a batch is bad."""
    if any("@mail3." in p for p in asked):
        raise ValueError("bad prompt")
    return stub_scorer(asked, options)


@query(
    "run_poisoned_batch",
    """SELECT doc_id, CASE WHEN text IS NULL THEN 'ingest' WHEN contains(text, '@mail3.') THEN 'extract' END AS failed_stage,
    CASE WHEN contains(text, '@mail3.') THEN 'bad prompt' END AS reason FROM documents WHERE text IS NULL OR length(trim(text)) > 0""",
)
def run_poisoned_batch(spark, sf):
    """Whole runs with a model whose batches fail on some prompts: only their documents fail."""
    docs = table(spark, sf, "documents").filter("text IS NULL OR length(trim(text)) > 0").select(
        F.col("doc_id").cast("string").alias("file_id"), F.lit("a.txt").alias("filename"), F.col("text").cast("binary").alias("content"))
    wide = run_stages(docs, Settings(scorers={"extract": _poisoned}, prompts={"extract": "|{document_text}|"}))
    reason = F.when(F.col("failed_stage") == "extract", F.regexp_extract("error", "bad prompt", 0))
    return wide.select(F.col("file_id").cast("long").alias("doc_id"), "failed_stage", reason.alias("reason"))

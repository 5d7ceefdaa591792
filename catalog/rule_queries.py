"""Categorize, extract and de-identify by rules."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query, table, view
from dossierflow.functions.redaction import mask_entities
from dossierflow.operators import categorize, deidentify, extract, phrases
from dossierflow.operators.rules import DEFAULT_LEXICON, ENTITY_RULES, PII_RULES, Lexicon
from dossierflow.plans.runs import run_stages
from dossierflow.settings import Settings

# --- the rules once more, in the check engine's pattern language: (type, pattern, group, confidence or strategy) ---
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_DATE = rf"\b(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|(?:{_MONTHS}) [0-9]{{1,2}}, [0-9]{{4}})\b"
_MONEY = r"-?\$(?:[0-9]{1,3}(?:,[0-9]{3}){1,6}|[0-9]{1,18})(?:\.[0-9]{2})?"
_EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
_PHONE = r"(?:\+1[ .-]?|\b1[ .-])?(?:\([0-9]{3}\) ?|\b[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}\b"
_SSN = r"(?:\b[0-9]{3}|\*{3}|\bX{3})-(?:[0-9]{2}|\*{2}|X{2})-[0-9]{4}\b"
_EIN = r"\b[0-9]{2}-[0-9]{7}\b"
_CAP = "[A-Z][A-Za-z''.-]{0,30}"
_PERSON = f"(?:Account Holder|Primary Borrower|Co-Borrower|Borrower|Name|Insured|Primary|Contingent|Advisor): ({_CAP}(?: {_CAP}){{1,3}})"
_ACCOUNT = r"(?:Account|Card|Loan|Policy|Member) (?:Number|No\.|ID):? ?([0-9A-Z*]{1,12}(?:[ -][0-9A-Z*]{1,12}){0,6})\b"
_ADDRESS = (
    r"\b[0-9]{1,6} (?:[A-Z][A-Za-z.]{0,20} ){1,4}(?:Street|Avenue|Road|Drive|Lane|Boulevard|Way|Court|Plaza)\b"
    r"(?:, [A-Z][A-Za-z]{0,20}(?: [A-Z][A-Za-z]{0,20}){0,2})?(?:, [A-Z]{2} [0-9]{5})?"
)
_SCORE = r"(?:Credit Score|FICO Score|FICO): ?([0-9]{3})\b"
ENTITY_SQL = [
    ("person", _PERSON, 1, 0.85),
    ("organization", f"(?:Bank|Lender|Employer|Issuer|Company|Institution|Insurer): ({_CAP}(?: {_CAP}){{0,5}})", 1, 0.8),
    ("organization", r"\b([A-Z][A-Za-z&]{1,30}(?: [A-Z][A-Za-z&]{1,30}){0,4} (?:Bank|Inc\.|LLC|Corporation|Insurance Company|Credit Union))", 1, 0.7),
    ("account_number", _ACCOUNT, 1, 0.95),
    ("ssn_tax_id", _SSN, 0, 0.98),
    ("ssn_tax_id", _EIN, 0, 0.9),
    ("amount", _MONEY, 0, 0.95),
    ("amount", r"\b[0-9]{1,3}(?:\.[0-9]{1,4})?%", 0, 0.8),
    ("date", _DATE, 0, 0.95),
    ("address", _ADDRESS, 0, 0.85),
    ("email", _EMAIL, 0, 0.99),
    ("phone", _PHONE, 0, 0.95),
    ("credit_score", _SCORE, 1, 0.9),
    ("property", r"(?:Property Address|Property|Collateral): ([^\r\n]+)", 1, 0.85),
]
_BALANCE = (
    r"(?:Beginning Balance|Ending Balance|Previous Balance|New Balance|Current Balance|Balance)[^$\r\n]{0,20}"
    rf"({_MONEY})"
)
PII_SQL = [
    ("person", _PERSON, 1, "REDACT"),
    ("ssn", _SSN, 0, "MASK"),
    ("tax_id", _EIN, 0, "MASK"),
    ("account_number", _ACCOUNT, 1, "MASK"),
    ("routing_number", r"(?:Routing Number|ABA Number|ABA): ?([0-9]{9})\b", 1, "MASK"),
    ("drivers_license", r"(?:Driver''s License|Driver License): ?([A-Z0-9]{5,20})\b", 1, "REDACT"),
    ("email", _EMAIL, 0, "REDACT"),
    ("phone", _PHONE, 0, "MASK"),
    ("address", _ADDRESS, 0, "GENERALIZE"),
    ("date_of_birth", rf"(?:Date of Birth|DOB): ?({_DATE})", 1, "GENERALIZE"),
    ("salary_income", rf"(?:Annual Income|Monthly Income|Salary|Compensation): ?({_MONEY})", 1, "GENERALIZE"),
    ("credit_score", _SCORE, 1, "REDACT"),
    ("financial_account_details", _BALANCE, 1, "GENERALIZE"),
]


def found_sql(rules, source: str, extra: str) -> str:
    """One row per rule and match; ``rule`` and ``hit`` give the order."""
    parts = [
        f"SELECT doc_id, {i} AS rule, generate_subscripts(v, 1) AS hit, '{t}' AS type, unnest(v) AS value, {x!r} AS {extra} "
        f"FROM (SELECT doc_id, regexp_extract_all(text, '{p}', {g}) AS v FROM {source})"
        for i, (t, p, g, x) in enumerate(rules)
    ]
    return " UNION ALL ".join(parts)


view("doc_entities", found_sql(ENTITY_SQL, "documents", "confidence"))
view("st_entities", found_sql(ENTITY_SQL, "statements", "confidence"), ("statements",))
view("doc_pii_found", found_sql(PII_SQL, "documents", "strategy"))
view("st_pii_found", found_sql(PII_SQL, "statements", "strategy"), ("statements",))
REPLACEMENT_SQL = """CASE
    WHEN strategy = 'MASK' AND length(value) > 4 THEN
        regexp_replace(left(value, length(value) - 4), '[A-Za-z0-9]', '*', 'g') || right(value, 4)
    WHEN strategy = 'MASK' THEN regexp_replace(value, '[A-Za-z0-9]', '*', 'g')
    WHEN strategy = 'GENERALIZE' AND type = 'date_of_birth' THEN regexp_extract(value, '[0-9]{4}')
    WHEN strategy = 'GENERALIZE' AND type IN ('salary_income', 'financial_account_details') THEN
        '$1' || repeat('0', CAST(length(regexp_replace(regexp_extract(value, '[0-9][0-9,]*'), ',', '', 'g')) - 1 AS int)) || '+'
    WHEN strategy = 'GENERALIZE' AND type = 'address' AND contains(value, ',') THEN trim(string_split(value, ',')[-1])
    ELSE '[REDACTED]' END"""
for _v in ("doc", "st"):
    view(f"{_v}_pii", f"SELECT *, {REPLACEMENT_SQL} AS replacement FROM {_v}_pii_found", (f"{_v}_pii_found",))
_POS = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rule, hit) - 1 AS int) AS pos"


_WORD = r"[\p{L}\p{N}]+(?:-\p{N}+)*"


def categorize_sql(source: str, lexicon: str) -> str:
    return f"""SELECT d.doc_id, coalesce(a.category, 'Unknown') AS primary_category,
    coalesce(round(a.score / a.total, 4), 0.0) AS primary_confidence, coalesce(a.terms, '') AS primary_justification,
    coalesce(b.category, 'Unknown') AS secondary_category, coalesce(round(b.score / b.total, 4), 0.0) AS secondary_confidence,
    coalesce(b.terms, '') AS secondary_justification
    FROM {source} d LEFT JOIN (SELECT * FROM ({_ranked(source, lexicon)}) WHERE rn = 1) a USING (doc_id)
    LEFT JOIN (SELECT * FROM ({_ranked(source, lexicon)}) WHERE rn = 2) b USING (doc_id)"""


def _ranked(source: str, lexicon: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) AS rn,
    sum(score) OVER (PARTITION BY doc_id) AS total FROM (
    SELECT doc_id, category, CAST(sum(weight) AS double) AS score, string_agg(DISTINCT term, ', ' ORDER BY term) AS terms
    FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM {source}) JOIN {lexicon} USING (term)
    GROUP BY doc_id, category)"""


view("finance_lexicon", f"SELECT * FROM (VALUES {fx.lexicon_values(DEFAULT_LEXICON)}) AS v(category, term, weight)")


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query("categorize", categorize_sql("documents", "lexicon"), ("lexicon",))
def categorize_query(spark, sf):
    docs = _documents(spark, sf)
    return categorize.with_categorization(docs, fx.COMMON_WORDS).select("doc_id", "categorization.*")


@query("categorize_statements", categorize_sql("statements", "finance_lexicon"), ("statements", "finance_lexicon"))
def categorize_statements(spark, sf):
    return categorize.with_categorization(fx.statements(spark, sf), DEFAULT_LEXICON).select("doc_id", "categorization.*")


BENCH_LEXICON = f"""SELECT DISTINCT 'I' || (item_id % 7) AS category, term, 1.0 + item_id % 3 AS weight FROM (
    SELECT item_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM benchmark)"""
view("bench_lexicon", f"SELECT category, term, CAST(max(weight) AS double) AS weight FROM ({BENCH_LEXICON}) GROUP BY ALL")


@query("categorize_by_join", categorize_sql("documents", "bench_lexicon"), ("bench_lexicon",))
def categorize_by_join(spark, sf):
    """A lexicon table of any size: here the words of the benchmark texts."""
    return categorize.categorize_by_join(_documents(spark, sf), _bench_lexicon(spark, sf))


def _bench_lexicon(spark, sf):
    words = table(spark, sf, "benchmark").select("item_id", F.explode(categorize.words_of(F.col("text"))).alias("term"))
    return words.groupBy(F.concat(F.lit("I"), F.col("item_id") % 7).alias("category"), "term").agg(
        F.max(F.lit(1.0) + F.col("item_id") % 3).alias("weight"))


@query(
    "run_lexicon_table",
    f"""SELECT file_id, CASE WHEN failed_stage IS NULL THEN primary_category END AS primary_category,
    CASE WHEN failed_stage IS NULL THEN primary_confidence END AS primary_confidence, failed_stage
    FROM runs JOIN ({categorize_sql('documents', 'bench_lexicon')}) USING (doc_id)""",
    ("runs", "bench_lexicon"),
)
def run_lexicon_table(spark, sf):
    """Whole runs whose lexicon is a table of any size."""
    wide = run_stages(fx.run_docs(spark, sf), Settings(**fx.RUN_SETTINGS, lexicon=_bench_lexicon(spark, sf)))
    return wide.select("file_id", "categorization.primary_category", "categorization.primary_confidence", "failed_stage")


@query(
    "categorize_unknown",
    f"""SELECT doc_id, 'Unknown' AS primary_category, 0.0::double AS primary_confidence FROM documents
    WHERE NOT list_has_any(regexp_extract_all(lower(text), '{_WORD}'), (SELECT list(term) FROM lexicon))""",
    ("lexicon",),
)
def categorize_unknown(spark, sf):
    docs = categorize.with_categorization(_documents(spark, sf), fx.COMMON_WORDS)
    out = docs.select("doc_id", "categorization.primary_category", "categorization.primary_confidence")
    return out.filter("primary_category = 'Unknown'")


# terms of one to four words, some inside others, one with parts that the text splits by marks
PHRASES = Lexicon(tuple(
    (category, term, weight) for category, weight, terms in (
        ("Holders", 1.5, ("account", "account holder", "holder")),
        ("Numbers", 1.0, ("account number", "routing number", "tax id", "number")),
        ("Balances", 2.0, ("beginning balance", "ending balance", "balance")),
        ("Places", 1.25, ("Oak Avenue Denver CO", "avenue", "elm street", "Property Address")),
    ) for term in terms))
view("phrase_lexicon", "SELECT category, lower(term) AS term, weight, len(string_split(term, ' ')) AS n "
                       f"FROM (VALUES {fx.lexicon_values(PHRASES)}) AS v(category, term, weight)")
_PHRASE_HITS = f"""SELECT doc_id, spot, n, term FROM (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS spot, w
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM statements), (SELECT DISTINCT n FROM phrase_lexicon))
    JOIN (SELECT DISTINCT term, n AS size FROM phrase_lexicon) ON size = n AND term = array_to_string(w[spot:spot + n - 1], ' ')"""
view("phrase_hits", f"""SELECT h.* FROM ({_PHRASE_HITS}) h WHERE NOT EXISTS (SELECT 1 FROM ({_PHRASE_HITS}) o
    WHERE o.doc_id = h.doc_id AND o.spot <= h.spot AND o.spot + o.n >= h.spot + h.n AND o.n > h.n)""", ("statements", "phrase_lexicon"))
view("phrase_ranked", """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) AS rn,
    sum(score) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, category, CAST(sum(weight) AS double) AS score,
    string_agg(DISTINCT term, ', ' ORDER BY term) AS terms FROM phrase_hits JOIN phrase_lexicon USING (term) GROUP BY doc_id, category)""",
     ("phrase_hits",))
_PHRASES_SQL = """SELECT d.doc_id, coalesce(a.category, 'Unknown') AS primary_category,
    coalesce(round(a.score / a.total, 4), 0.0) AS primary_confidence, coalesce(a.terms, '') AS primary_justification,
    coalesce(b.category, 'Unknown') AS secondary_category, coalesce(round(b.score / b.total, 4), 0.0) AS secondary_confidence,
    coalesce(b.terms, '') AS secondary_justification FROM statements d
    LEFT JOIN (SELECT * FROM phrase_ranked WHERE rn = 1) a USING (doc_id) LEFT JOIN (SELECT * FROM phrase_ranked WHERE rn = 2) b USING (doc_id)"""


@query("categorize_phrases", _PHRASES_SQL, ("phrase_ranked",))
def categorize_phrases(spark, sf):
    """Terms of several words, from a lexicon table joined on positions."""
    rows = [(c, t, float(w)) for c, t, w in PHRASES.terms]
    lexicon = spark.createDataFrame(rows, "category string, term string, weight double")
    return phrases.categorize_phrases(fx.statements(spark, sf), lexicon)


@query("categorize_phrases_in_plan", _PHRASES_SQL, ("phrase_ranked",))
def categorize_phrases_in_plan(spark, sf):
    """The same terms, looked up row by row."""
    return phrases.categorize_phrases_in_plan(fx.statements(spark, sf), PHRASES)


def _entities(df):
    return extract.entities_long(extract.with_entities(df)).filter("pos IS NOT NULL")


@query("extract_entities", f"SELECT doc_id, {_POS}, type, value, CAST(confidence AS double) AS confidence FROM doc_entities",
       ("doc_entities",))
def extract_entities(spark, sf):
    return _entities(_documents(spark, sf))


@query("extract_statements", f"SELECT doc_id, {_POS}, type, value, CAST(confidence AS double) AS confidence FROM st_entities",
       ("st_entities",))
def extract_statements(spark, sf):
    return _entities(fx.statements(spark, sf))


def _one_type(entity_type: str, source: str):
    """One entity type on its own: only its rules run."""
    rules = [r for r in ENTITY_SQL if r[0] == entity_type]
    sql = f"SELECT doc_id, value, count(*) AS n FROM ({found_sql(rules, source, 'confidence')}) GROUP BY doc_id, value"

    @query(f"extract_{entity_type}", sql, ("statements",) if source == "statements" else ())
    def run(spark, sf):
        docs = fx.statements(spark, sf) if source == "statements" else _documents(spark, sf)
        found = extract.with_entities(docs, extract.rules_for(ENTITY_RULES, entity_type))
        return extract.entities_long(found).filter("pos IS NOT NULL").groupBy("doc_id", "value").agg(F.count("*").alias("n"))


for _type, _source in (
    ("email", "documents"), ("phone", "documents"), ("person", "statements"), ("organization", "statements"),
    ("account_number", "statements"), ("ssn_tax_id", "statements"), ("amount", "statements"), ("date", "statements"),
    ("address", "statements"), ("credit_score", "statements"), ("property", "statements"),
):
    _one_type(_type, _source)


@query("entities_count",
       "SELECT d.doc_id, count(e.doc_id) AS entities_count FROM documents d LEFT JOIN doc_entities e USING (doc_id) GROUP BY d.doc_id",
       ("doc_entities",))
def entities_count(spark, sf):
    docs = extract.with_entities(_documents(spark, sf))
    return docs.select("doc_id", extract.item_count(F.col("entities")).cast("long").alias("entities_count"))


@query("entities_preview",
       f"SELECT doc_id, pos, type, value FROM (SELECT *, {_POS} FROM st_entities) WHERE pos < 5", ("st_entities",))
def entities_preview(spark, sf):
    docs = extract.with_entities(fx.statements(spark, sf))
    first = docs.withColumn("entities", extract.first_items(F.col("entities")))
    return extract.entities_long(first).filter("pos IS NOT NULL").select("doc_id", "pos", "type", "value")


@query("entities_long",
       f"SELECT d.doc_id, e.pos, e.type, e.value FROM documents d LEFT JOIN (SELECT *, {_POS} FROM doc_entities) e USING (doc_id)",
       ("doc_entities",))
def entities_long(spark, sf):
    docs = extract.with_entities(_documents(spark, sf))
    return extract.entities_long(docs).select("doc_id", "pos", "type", "value")


def _pii(df, out="pii_items"):
    rows = extract.item_rows(deidentify.with_pii_items(df), F.col(out))
    return rows.select("doc_id", "pos", "i.type", "i.value", "i.strategy", "i.replacement")


@query("detect_pii", f"SELECT doc_id, {_POS}, type, value, strategy, replacement FROM doc_pii", ("doc_pii",))
def detect_pii(spark, sf):
    return _pii(_documents(spark, sf))


@query("pii_strategies", f"SELECT doc_id, {_POS}, type, value, strategy, replacement FROM st_pii", ("st_pii",))
def pii_strategies(spark, sf):
    return _pii(fx.statements(spark, sf))


@query("pii_count",
       "SELECT d.doc_id, count(e.doc_id) AS pii_items_masked FROM statements d LEFT JOIN st_pii_found e USING (doc_id) GROUP BY d.doc_id",
       ("statements", "st_pii_found"))
def pii_count(spark, sf):
    docs = deidentify.with_pii_items(fx.statements(spark, sf))
    return docs.select("doc_id", extract.item_count(F.col("pii_items")).cast("long").alias("pii_items_masked"))


@query("pii_preview", f"SELECT doc_id, pos, type, value FROM (SELECT *, {_POS} FROM st_pii) WHERE pos < 5", ("st_pii",))
def pii_preview(spark, sf):
    docs = deidentify.with_pii_items(fx.statements(spark, sf))
    rows = extract.item_rows(docs, extract.first_items(F.col("pii_items")))
    return rows.select("doc_id", "pos", "i.type", "i.value")


@query(
    "mask_entities",
    f"""SELECT doc_id, {_POS}, type, CASE WHEN type IN ('person', 'organization', 'email') THEN '[REDACTED]' ELSE value END AS value,
    CASE WHEN type IN ('person', 'organization', 'email') THEN 'true' END AS masked FROM st_entities""",
    ("st_entities",),
)
def mask_entities_query(spark, sf):
    docs = extract.with_entities(fx.statements(spark, sf))
    rows = extract.item_rows(docs, mask_entities(F.col("entities")))
    return rows.select("doc_id", "pos", "i.type", "i.value", F.col("i.masked").cast("string").alias("masked"))


_ALNUM = r"'[\p{L}\p{N}]'"


def _replaced_sql(source: str, pii: str) -> str:
    """Whole values replaced: all places of all values as rows, those that cut a word left out, of
    those that overlap the first and longest taken, and the text put together around them."""
    return f"""SELECT d.doc_id, md5(coalesce(r.t, d.text)) AS safe_md5 FROM {source} d LEFT JOIN (
    WITH v AS (SELECT doc_id, value, min(replacement) AS replacement FROM {pii} WHERE length(value) > 0 GROUP BY ALL),
    parts AS (SELECT doc_id, text, value, replacement, string_split(text, value) AS p FROM v JOIN {source} USING (doc_id)),
    places AS (SELECT doc_id, text, value, replacement, length(value) AS n,
        unnest(list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) AS bigint) + (i - 1) * length(value) + 1)) AS spot
        FROM parts),
    whole AS (SELECT *, spot + n AS stop FROM places WHERE
        NOT (regexp_matches(left(value, 1), {_ALNUM}) AND spot > 1 AND regexp_matches(substr(text, spot - 1, 1), {_ALNUM}))
        AND NOT (regexp_matches(right(value, 1), {_ALNUM}) AND regexp_matches(substr(text, spot + n, 1), {_ALNUM}))),
    free AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM whole o WHERE o.doc_id = w.doc_id
        AND o.spot < w.stop AND w.spot < o.stop AND (o.spot < w.spot OR (o.spot = w.spot AND o.n > w.n)))),
    ordered AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY spot), 1) AS begin FROM free)
    SELECT doc_id, string_agg(substr(text, begin, spot - begin) || replacement, '' ORDER BY spot)
        || substr(any_value(text), max(stop)) AS t FROM ordered GROUP BY doc_id) r USING (doc_id)"""


def _safe_text(df):
    docs = deidentify.with_safe_text(deidentify.with_pii_items(df, PII_RULES))
    return docs.select("doc_id", F.md5("safe_text").alias("safe_md5"))


@query("deidentify_text", _replaced_sql("documents", "doc_pii"), ("doc_pii",))
def deidentify_text(spark, sf):
    return _safe_text(_documents(spark, sf))


@query("deidentify_statements", _replaced_sql("statements", "st_pii"), ("statements", "st_pii"))
def deidentify_statements(spark, sf):
    return _safe_text(fx.statements(spark, sf))

"""Stage 2 and text measures."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query, table, view
from dossierflow.functions import prompts, text as tx
from dossierflow.operators import ingest, parse
from dossierflow.plans.runs import run_stages
from dossierflow.settings import Settings
from dossierflow.sources import payloads
from dossierflow.sources.folders import work_folder

# what the payload's elements amount to as text
PAYLOAD_TEXT = """array_to_string(list_filter(list_transform(elements, lambda e: json_extract_string(e, '$.content')),
    lambda t: t IS NOT NULL), chr(10) || chr(10))"""
view("parsed", f"SELECT doc_id, error_status, {PAYLOAD_TEXT} AS t FROM payloads", ("payloads",))


@query("parse_elements",
       "SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS bigint) AS text_length FROM parsed", ("parsed",))
def parse_elements(spark, sf):
    parsed = fx.payloads(spark, sf).withColumn("v", F.try_parse_json("payload"))
    out = parsed.withColumn("t", parse.parsed_text(F.col("v")))
    return out.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("text_length"))


@query("parse_ok",
       "SELECT doc_id, md5(t) AS text_md5 FROM parsed WHERE error_status IS NULL AND length(t) > 0", ("parsed",))
def parse_ok(spark, sf):
    out = parse.parse_payloads(fx.payloads(spark, sf))
    return out.filter("parse_error IS NULL").select("doc_id", F.md5("document_text").alias("text_md5"))


@query(
    "parse_rejects",
    """SELECT doc_id, CASE WHEN error_status IS NOT NULL THEN 'parser reported: ' || error_status
    ELSE 'No document text extracted' END AS parse_error FROM parsed WHERE error_status IS NOT NULL OR length(t) = 0""",
    ("parsed",),
)
def parse_rejects(spark, sf):
    out = parse.parse_payloads(fx.payloads(spark, sf))
    return out.filter("parse_error IS NOT NULL").select("doc_id", "parse_error")


@query(
    "parse_shredded",
    """SELECT doc_id, CASE WHEN error_status IS NULL AND length(t) > 0 THEN md5(t) END AS text_md5,
    CASE WHEN error_status IS NOT NULL THEN 'parser reported: ' || error_status WHEN length(t) = 0 THEN 'No document text extracted' END AS parse_error
    FROM parsed""",
    ("parsed",),
)
def parse_shredded(spark, sf):
    """Payloads written with typed columns beside the variant, parsed from these columns alone."""
    folder = work_folder(spark, "payloads")
    payloads.write(fx.payloads(spark, sf), folder)
    out = payloads.parse_shredded(payloads.read(spark, folder))
    return out.select("doc_id", F.md5("document_text").alias("text_md5"), "parse_error")


HTML_SQL = r"regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<(script|style)[^>]*>.*?</(?:script|style)[^>]*>', ' ', 'gis'), '<[^>]*>', ' ', 'g')"
HTML_SQL = (
    f"replace(replace(replace(replace(replace(replace({HTML_SQL}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), "
    """'&quot;', '"'), '&#39;', ''''), '&amp;', '&')"""
)
HTML_SQL = rf"trim(regexp_replace({HTML_SQL}, '[ \t\r\n]+', ' ', 'g'), ' ')"


@query("parse_html",
       f"SELECT page_id, {HTML_SQL} AS document_text FROM pages")
def parse_html(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return pages.select("page_id", tx.html_to_text(F.col("html")).alias("document_text"))


@query(
    "run_html",
    f"""SELECT page_id, CASE WHEN t = '' THEN 'failed' ELSE 'completed' END AS status, md5(nullif(t, '')) AS text_md5
    FROM (SELECT page_id, {HTML_SQL} AS t FROM pages)""",
)
def run_html(spark, sf):
    """Whole runs over pages."""
    pages = table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("file_id"), F.lit("page.html").alias("filename"),
        F.col("html").cast("binary").alias("content"))
    wide = run_stages(pages, Settings())
    return wide.select(F.col("file_id").cast("long").alias("page_id"), "status", F.md5("parse.document_text").alias("text_md5"))


@query(
    "run_payload",
    """SELECT doc_id, CASE WHEN error_status IS NULL AND length(t) > 0 THEN 'completed' ELSE 'failed' END AS status,
    CASE WHEN error_status IS NULL AND length(t) > 0 THEN md5(t) END AS text_md5 FROM parsed""",
    ("parsed",),
)
def run_payload(spark, sf):
    """Whole runs over the replies of an external parser."""
    docs = fx.payloads(spark, sf).select(
        "doc_id", F.col("doc_id").cast("string").alias("file_id"), F.lit("a.pdf").alias("filename"),
        F.col("payload").cast("binary").alias("content"), "payload")
    wide = run_stages(docs, Settings())
    return wide.select("doc_id", "status", F.md5("parse.document_text").alias("text_md5"))


MARKDOWN = (
    "'# ' || source || chr(10) || '- **' || lang || '** see [notes](http://example.com/' || CAST(doc_id AS string) || ')' "
    "|| chr(10) || '```text' || chr(10) || text || chr(10) || '```' || chr(10) || '> `end` *kept*'"
)


_MD = rf"({MARKDOWN})"
for _pattern, _with in (
    (r"(?m)^[ \t]*```[^\n]*$", ""),
    (r"(?m)^[ \t]{0,3}(?:#{1,6}|>|[*+-])[ \t]+", ""),
    (r"!?\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1"),
    (r"\*\*|__|`", ""),
):
    _MD = f"regexp_replace({_MD}, '{_pattern}', '{_with}', 'g')"


@query("parse_markdown", f"SELECT doc_id, md5({_MD}) AS text_md5, CAST(length({_MD}) AS bigint) AS text_length FROM documents")
def parse_markdown(spark, sf):
    """Markdown made of every document."""
    docs = table(spark, sf, "documents").select("doc_id", tx.markdown_to_text(F.expr(MARKDOWN)).alias("t"))
    return docs.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("text_length"))


@query("parse_pages",
       "SELECT doc_id, CAST(1 AS bigint) AS pages_count, CAST(0 AS bigint) AS page_id, md5(text) AS page_md5 FROM documents")
def parse_pages(spark, sf):
    docs = table(spark, sf, "documents").withColumn("pages", tx.single_page(F.col("text")))
    page = F.get("pages", F.lit(0))
    return docs.select(
        "doc_id", F.size("pages").cast("long").alias("pages_count"), page["page_id"].cast("long").alias("page_id"),
        F.md5(page["text"]).alias("page_md5"),
    )


@query(
    "join_pages",
    """SELECT doc_id, md5(CASE WHEN doc_id % 29 = 0 THEN '' ELSE array_to_string(list_transform(string_split(text, chr(10)),
    lambda p: CASE WHEN length(p) % 7 = 0 THEN '' ELSE p END), chr(10) || chr(10)) END) AS text_md5 FROM documents""",
)
def join_pages(spark, sf):
    """Every line of a document as a page; some pages have no text, some documents no pages."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pages = F.transform(
        F.split("text", "\n"), lambda t, i: F.struct(F.when(F.length(t) % 7 != 0, t).alias("text"), i.alias("page_id"))
    )
    docs = docs.withColumn("pages", F.when(F.col("doc_id") % 29 != 0, pages))
    return docs.select("doc_id", F.md5(tx.join_pages(F.col("pages"))).alias("text_md5"))


@query(
    "text_sample",
    """SELECT doc_id, CAST(length(text) AS bigint) AS text_length,
    CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS text_sample FROM documents""",
)
def text_sample(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.length("text").cast("long").alias("text_length"),
                       tx.text_sample(F.col("text")).alias("text_sample"))


@query("parse_first_per_path",
       "SELECT volume_path, min(doc_id) AS doc_id, md5(arg_min(text, doc_id)) AS text_md5 FROM uploads GROUP BY volume_path",
       ("uploads",))
def parse_first_per_path(spark, sf):
    rows = fx.uploads(spark, sf).select("volume_path", "doc_id", "text")
    return ingest.first_per_path(rows, "volume_path", "doc_id").select(
        "volume_path", "doc_id", F.md5("text").alias("text_md5"))


@query("truncate_text",
       "SELECT doc_id, md5(left(text, 5000)) AS text_md5, CAST(least(length(text), 5000) AS bigint) AS prompt_chars FROM documents")
def truncate_text(spark, sf):
    """What a prompt carries of a text: the bound is the model stage's own."""
    docs = table(spark, sf, "documents").withColumn("t", prompts.truncate_text(F.col("text")))
    return docs.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("prompt_chars"))

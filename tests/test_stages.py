import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from dossierflow.operators import categorize, deidentify, extract, ingest, parse, rules, scoring
from dossierflow.plans import results, runs, spans, status as st
from dossierflow.schemas import ENTITY_TYPES, PII_TYPES, STRATEGIES
from dossierflow.settings import Settings
from samples import SAMPLES


@pytest.fixture(scope="module")
def sample_docs(spark):
    rows = [(name, name, bytearray(text.encode())) for name, text, *_ in SAMPLES]
    return spark.createDataFrame(rows, "file_id string, filename string, content binary")


@pytest.fixture(scope="module")
def sample_runs(sample_docs):
    return {r.file_id: r for r in runs.run_stages(sample_docs, Settings()).collect()}


@pytest.mark.parametrize("sample", SAMPLES, ids=[s[0] for s in SAMPLES])
def test_business_samples(sample_runs, sample):
    name, _, category, entities, pii = sample
    row = sample_runs[name]
    assert row.status == "completed" and row.error is None and row.stages_completed == 5
    assert row.primary_category == category
    assert [(e.type, e.value) for e in row.extraction.entities] == entities
    assert [(i.type, i.value, i.replacement) for i in row.deidentification.pii_items] == pii
    assert row.entities_count == len(entities) and row.pii_items_masked == len(pii)
    masked = {e.value for e in row.masked_entities if e.type in ("person", "organization", "email")}
    assert masked <= {"[REDACTED]"}


def test_domains_are_covered():
    assert {r.type for r in rules.ENTITY_RULES} == set(ENTITY_TYPES)
    assert {r.type for r in rules.PII_RULES} == set(PII_TYPES)
    assert {r.strategy for r in rules.PII_RULES} == set(STRATEGIES)


def test_safe_text_holds_no_redacted_value(spark):
    docs = spark.createDataFrame([(n, t) for n, t, *_ in SAMPLES], "doc_id string, text string")
    for row in deidentify.with_safe_text(deidentify.with_pii_items(docs)).collect():
        for item in row.pii_items:
            if item.replacement != item.value:
                assert item.value not in row.safe_text


def test_rules_against_python_regex(spark):
    """Every rule's matches equal the plain search without its shortcuts."""
    rng = random.Random(7)
    lines = [line for _, text, *_ in SAMPLES for line in text.splitlines()]
    noise = ["a@b.c", "x" * 80 + "@d.ee", "12-1234567", "123-45-67890", "(303)555-0101", "+1 (415) 555-0100é", "$1,23", "-$5.00",
             "FICO: 800", "1/2/24", "Name: é", "9 A Way", "50%", "DOB: 2001-02-03", "ABA: 123456789", "é 12-7654321"]
    texts = ["\n".join(rng.choices(lines + noise, k=12)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for rule in (*rules.ENTITY_RULES, *rules.PII_RULES):
        found = docs.select("doc_id", F.expr(rules.matches_sql("text", rule)).alias("m")).orderBy("doc_id").collect()
        for row in found:
            plain = [m.group(rule.group) for m in re.finditer(rule.pattern, texts[row.doc_id])]
            assert list(row.m) == plain, (rule.type, texts[row.doc_id])


def test_whole_text_is_searched(spark):
    text = "word " * 20000 + "late@example.com and SSN 123-45-6789"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    row = deidentify.with_pii_items(extract.with_entities(docs)).first()
    assert ("email", "late@example.com") in [(e.type, e.value) for e in row.entities]
    assert ("ssn", "123-45-6789") in [(e.type, e.value) for e in row.pii_items]


def test_long_run_of_letters_is_quick(spark):
    docs = spark.createDataFrame([(1, "a" * 1_000_000 + "@")], "doc_id int, text string")
    assert extract.with_entities(docs).first().entities == []


def half_up(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def brute_categories(text, lexicon):
    words = re.findall("[a-z]+", text.lower())
    scores, terms = {}, {}
    for category, term, weight in lexicon.terms:
        n = words.count(term)
        if n:
            scores[category] = scores.get(category, 0.0) + n * weight
            terms.setdefault(category, set()).add(term)
    ranked = sorted(scores, key=lambda c: (-scores[c], c))
    total = sum(scores.values())
    out = []
    for c in (ranked + [None, None])[:2]:
        out += [c or "Unknown", half_up(scores[c] / total) if c else 0.0, ", ".join(sorted(terms[c])) if c else ""]
    return tuple(out)


def test_categorize_both_ways_against_brute_force(spark, sf):
    lexicon = rules.Lexicon((("B", "the", 1.0), ("A", "of", 1.0), ("A", "la", 2.0), ("C", "der", 1.5), ("C", "the", 0.5)))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: brute_categories(r.text, lexicon) for r in docs.collect()}
    inline = categorize.with_categorization(docs, lexicon).select("doc_id", "categorization.*")
    table = spark.createDataFrame(list(lexicon.terms), "category string, term string, weight double")
    joined = categorize.categorize_by_join(docs, table)
    for got in (inline, joined):
        assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = categorize.categorize_by_join(docs, table)
        assert "Broadcast" not in large._jdf.queryExecution().executedPlan().toString()
        assert {r[0]: tuple(r[1:]) for r in large.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_and_many_terms_in_both_forms(spark):
    """A term listed three times counts once; a lexicon of 5,000 terms is no limit, in a run either."""
    repeated = (("A", "apple", 1.0), ("A", "Apple", 1.0), ("A", "apple", 1.0), ("B", "pear", 2.0))
    many = (*repeated, *(("C", f"w{i}", 1.0) for i in range(5000)), ("D", "401k", 5.0), ("D", "w-2", 5.0), ("D", "été", 5.0))
    docs = spark.createDataFrame([(1, "Apple pear"), (2, "w17 w18 pear apple"), (3, "form W-2"), (4, "ÉTÉ"), (5, "401k")], "doc_id long, text string")
    for terms, want in ((repeated, ["B", "B", "Unknown", "Unknown", "Unknown"]), (many, ["B", "B", "D", "D", "D"])):
        table = spark.createDataFrame(list(terms), "category string, term string, weight double")
        inline = categorize.with_categorization(docs, rules.Lexicon(terms)).select("doc_id", "categorization.*")
        joined = categorize.categorize_by_join(docs, table)
        rows = [sorted(map(tuple, df.collect())) for df in (inline, joined)]
        assert rows[0] == rows[1] and [r[1] for r in rows[0]] == want
        files = docs.select(F.col("doc_id").cast("string").alias("file_id"), F.lit("a.txt").alias("filename"), F.col("text").cast("binary").alias("content"))
        for lexicon in (rules.Lexicon(terms), table):
            wide = runs.run_stages(files, Settings(lexicon=lexicon))
            assert [r.primary_category for r in wide.orderBy("file_id").collect()] == want


def test_empty_lexicon_is_refused(spark):
    with pytest.raises(ValueError):
        categorize.with_categorization(spark.createDataFrame([("x",)], "text string"), rules.Lexicon())


def test_landing(spark):
    rows = [(f"/p/{i % 3}", i, f"n{i}", f"c{i}") for i in range(10)]
    up = spark.createDataFrame(rows, "volume_path string, seq int, name string, text string")
    got = {r.volume_path: (r.seq, r.name, r.uploads) for r in ingest.manifest(up.drop("text"), "seq").collect()}
    assert got == {"/p/0": (9, "n9", 4), "/p/1": (7, "n7", 3), "/p/2": (8, "n8", 3)}
    assert {r.text for r in ingest.latest_content(up, "seq").collect()} == {"c9", "c7", "c8"}
    assert {r.text for r in ingest.first_per_path(up, "volume_path", "seq").collect()} == {"c0", "c1", "c2"}
    existing = spark.createDataFrame([("/p/1",)], "volume_path string")
    got = {r.volume_path: (r.seq, r.refused) for r in ingest.new_only(up.drop("text"), existing, "seq").collect()}
    assert got == {"/p/0": (0, 3), "/p/2": (2, 2)}


def test_parse_variant_elements(spark):
    payload = '{"document":{"elements":[{"content":"a"},{"content":null},{"id":1},{"content":7},{"content":"b"},5]},"error_status":null}'
    rows = [payload, '{"document":{"elements":[]}}', '{"error_status":[1]}', '{"error_status":"x"}', "junk", None]
    df = parse.parse_payloads(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, payload string")).orderBy("i").collect()
    assert df[0].document_text == "a\n\n7\n\nb" and df[0].parse_error is None
    assert [r.parse_error for r in df[1:]] == [
        parse.NO_TEXT, "parser reported: [1]", "parser reported: x", "payload is not JSON", "payload is not JSON"]


def docs_of(spark, rows):
    return spark.createDataFrame([(f, n, c if c is None else bytearray(c)) for f, n, c in rows], "file_id string, filename string, content binary")


def test_bad_documents_fail_alone(spark):
    rows = [("ok", "a.txt", b"some text"), ("empty", "b.txt", b""), ("null", "c.txt", None), ("noname", "", b"x"),
            ("pdf", "d.pdf", b"%PDF"), ("bytes", "e.txt", b"\xff\xfe\x00abc"), ("html", "f.html", b"<p>hi <b>you</b></p>"),
            ("tags", "g.html", b"<p></p>"), ("md", "h.md", b"# T"), ("none", None, b"x")]
    got = {r.file_id: r for r in runs.run_stages(docs_of(spark, rows), Settings()).collect()}
    assert {k: (r.status, r.failed_stage, r.stages_completed) for k, r in got.items()} == {
        "ok": ("completed", None, 5), "empty": ("failed", "parse", 2), "null": ("failed", "ingest", 1),
        "noname": ("failed", "ingest", 1), "pdf": ("failed", "parse", 2), "bytes": ("completed", None, 5),
        "html": ("completed", None, 5), "tags": ("failed", "parse", 2), "md": ("completed", None, 5),
        "none": ("failed", "ingest", 1)}
    assert got["html"].parse.document_text == "hi you" and got["md"].parse.document_text == "T"
    assert got["ok"].primary_category == "Unknown" and got["ok"].entities_count == 0
    assert got["pdf"].extraction is None and got["pdf"].primary_category is None


def test_file_limits_are_opt_in(spark):
    rows = [("a", "a.exe", b"text"), ("b", "b.TXT", b"text"), ("c", "c.txt", b"long text")]
    got = {r.file_id: r.error for r in runs.run_stages(docs_of(spark, rows), Settings(enforce_file_limits=True, max_file_bytes=5)).collect()}
    assert got == {"a": "Ingest failed: file type or size is not supported", "b": None, "c": "Ingest failed: file type or size is not supported"}
    assert {r.error for r in runs.run_stages(docs_of(spark, rows), Settings()).collect()} == {None}


@pytest.mark.parametrize("stage,done", [("ingest", 1), ("parse", 2), ("CATEGORIZE", 3), ("extract", 4), ("Deidentify", 5)])
def test_forced_failure(spark, stage, done):
    rows = [("a", "a.txt", b"text"), ("b", "b.txt", None)]
    got = {r.file_id: r for r in runs.run_stages(docs_of(spark, rows), Settings(force_fail_stage=stage)).collect()}
    assert got["a"].error == f"forced to fail at {stage.lower()}"
    assert (got["a"].failed_stage, got["a"].stages_completed) == (stage.lower(), done)
    assert got["b"].failed_stage == "ingest"
    records = runs.failures(runs.run_stages(docs_of(spark, rows), Settings(force_fail_stage=stage))).collect()
    assert len(records) == 2


def scorer_for(stage):
    """Answers by a word in the document; fails on 'poison'."""
    good = {
        "categorize": '{"primary_category": "Tax Document", "primary_confidence": 0.9}',
        "extract": '{"entities": [{"type": "person", "value": "Ann"}]}',
        "deidentify": '{"pii_items": [{"type": "ssn", "value": "1", "strategy": "MASK", "replacement": "*"}]}',
    }[stage]

    def score(prompts, options):
        assert (options.model, options.temperature, options.max_tokens) == ("m1", 0.0, 5000)
        out = []
        for p in prompts:
            if "poison" in p:
                raise RuntimeError("bad document")
            text = "not json" if "prose" in p else "[1]" if "list" in p else good
            out.append(scoring.Reply(text, "m1", f"r{len(p)}", 10, 5))
        return out

    return score


MODEL_STAGES = ("categorize", "extract", "deidentify")


def test_injected_scorers(spark):
    rows = [("good", "a.txt", b"fine"), ("prose", "b.txt", b"prose"), ("list", "c.txt", b"list"), ("poison", "d.txt", b"poison")]
    settings = Settings(model="m1", scorers={s: scorer_for(s) for s in MODEL_STAGES},
                        prompts={s: "Do: {document_text}" for s in MODEL_STAGES})
    got = {r.file_id: r for r in runs.run_stages(docs_of(spark, rows), settings).collect()}
    assert got["good"].status == "completed" and got["good"].primary_category == "Tax Document"
    assert got["good"].entities_count == 1 and got["good"].masked_entities[0].value == "[REDACTED]"
    assert got["good"].categorize_reply.total_tokens == 15
    assert got["prose"].status == "completed" and got["prose"].primary_category == "Unknown"
    assert got["prose"].extraction.raw_response == "not json" and got["prose"].entities_count == 0
    assert (got["list"].failed_stage, got["list"].error) == ("categorize", "Categorize failed: reply is not a JSON object")
    assert (got["poison"].failed_stage, got["poison"].error) == ("categorize", "Categorize failed: bad document")
    assert got["poison"].extract_reply.reply is None

    hidden = Settings(model="m1", scorers=settings.scorers, prompts=settings.prompts, hide_stage_errors=True)
    got = {r.file_id: r for r in runs.run_stages(docs_of(spark, rows), hidden).collect()}
    assert {r.status for r in got.values()} == {"completed"}
    assert (got["list"].primary_category, got["list"].entities_count, got["list"].pii_items_masked) == (None, 0, 0)


def test_usage_totals(spark):
    rows = [("extract", "m", 1, 2, 3, "stop"), ("extract", "m", 3, 4, 7, "length"), ("categorize", "m", 5, 5, 10, "stop")]
    df = spark.createDataFrame(rows, "stage string, model string, prompt_tokens long, completion_tokens long, total_tokens long, finish_reason string")
    got = {r.stage: (r.calls, r.prompt_tokens, r.total_tokens, r.avg_total_tokens, r.cut_off) for r in scoring.token_usage(df).collect()}
    assert got == {"extract": (2, 4, 10, 5.0, 1), "categorize": (1, 5, 10, 10.0, 0)}


def test_results_keep_the_unmasked_extract_result(spark, sample_docs):
    import json

    wide = runs.run_stages(sample_docs, Settings())
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    stored = results.from_wide(wide, now)
    row = results.expanded(stored).filter("file_id = 'bank.txt'").first()
    parsed, cat, ext, dei = (json.loads(row[f"{s}_result"]) for s in ("parse", "categorize", "extract", "deidentify"))
    assert parsed["pages"] == [{"text": parsed["document_text"], "page_id": 0}]
    assert set(parsed) - {"timestamp"} < set(cat) < set(ext) < set(dei)
    assert ext["extraction"]["entities"][0] == {"type": "person", "value": "Tomas Field", "confidence": 0.85}
    assert dei["extraction"]["entities"][0] == {"type": "person", "value": "[REDACTED]", "confidence": 0.85, "masked": True}
    assert "masked" not in dei["extraction"]["entities"][2]
    assert dei["final_output"] is True and dei["pii_items_masked"] == 9
    small = stored.filter("file_id = 'bank.txt'").first()
    assert "document_text" not in json.loads(small.categorize_result)


def test_status_from_runs(spark):
    rows = [("ok", "a.txt", b"the text"), ("pdf", "d.pdf", b"%PDF"), ("null", "c.txt", None)]
    log = st.events_of_runs(runs.run_stages(docs_of(spark, rows), Settings()), F.lit("2024-01-01 10:00:00").cast("timestamp"))
    got = {r.file_id: r for r in st.fold(log).collect()}
    ok, pdf, null = got["ok"], got["pdf"], got["null"]
    assert (ok.status, ok.current_stage, ok.stage_deidentify_status, ok.entities_count, ok.pii_items_masked) == ("completed", "deidentify", "completed", 0, 0)
    assert ok.created_at == ok.updated_at == ok.start_time == ok.end_time
    assert (pdf.status, pdf.current_stage, pdf.stage_ingest_status, pdf.stage_parse_status, pdf.entities_count) == ("failed", "parse", "completed", "failed", None)
    assert (null.status, null.current_stage, null.stage_ingest_status, null.volume_path) == ("failed", "ingest", "failed", None)


def test_spans(spark):
    settings = Settings()
    rows = [("ok", "a.txt", b"the text"), ("pdf", "d.pdf", b"%PDF")]
    got = spans.spans(runs.run_stages(docs_of(spark, rows), settings), settings).collect()
    names = lambda f: [(r.position, r.name, r.parent) for r in sorted(got, key=lambda r: r.position) if r.file_id == f]
    root = "process_file_pipeline"
    assert names("ok") == [(0, root, None), (1, "stage_1_ingest", root), (2, "stage_2_parse", root), (3, "stage_3_categorize", root),
                           (4, "stage_4_extract", root), (5, "stage_5_deidentify", root)]
    assert [n[1] for n in names("pdf")] == [root, "stage_1_ingest", "stage_2_parse"]
    failed = next(r for r in got if r.file_id == "pdf" and r.position == 0)
    assert failed.attributes["failed_at_stage"] == "parse" and failed.attributes["stages_completed"] == "2"
    assert next(r for r in got if r.file_id == "pdf" and r.position == 2).outputs == {"error": "Parse failed: No parser for this file type"}


def test_settings_from_environment():
    settings = Settings.from_env({"DOSSIERFLOW_EXTRACT_PROMPT": "E {document_text}", "DOSSIERFLOW_MODEL": "m", "DOSSIERFLOW_MAX_FILE_MB": "2",
                                  "DOSSIERFLOW_FORCE_FAIL_STAGE": "parse"}, catalog="c9")
    assert settings.prompts["extract"] == "E {document_text}" and "{document_text}" in settings.prompts["categorize"]
    assert (settings.model, settings.max_file_bytes, settings.force_fail_stage, settings.catalog) == ("m", 2 * 1024 * 1024, "parse", "c9")

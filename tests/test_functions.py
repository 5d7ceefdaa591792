import os.path
import re
import urllib.parse

from hypothesis import HealthCheck, given, settings, strategies as hs
from pyspark.sql import functions as F

from dossierflow.functions import paths, prompts, redaction, replies, text
from dossierflow.plans import views


def evaluate(spark, values, build, ddl="x string"):
    """Column function over single values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {ddl}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def plain_safe_name(name):
    stem, ext = os.path.splitext(name.replace(" ", "_"))
    return re.sub(r"[^\w\-]", "_", stem) + ext


def test_safe_filename_edges(spark):
    names = ["a b (1).pdf", ".bashrc", "x.tar.gz", "Résumé é.md", "noext", "..a.b", "a.", "...", "", "d.x/b.txt", "d.x/b",
             "dir/.rc", "a\nb.txt", "²½Ⅷ٣.txt", "a‿b́.txt", "a.b c", "中文 名.pdf", "a..", "."]
    assert evaluate(spark, names, paths.safe_filename) == [plain_safe_name(n) for n in names]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.text(alphabet=hs.characters(blacklist_categories=("Cs", "Cn"), blacklist_characters="\x00"), max_size=12), min_size=50, max_size=200))
def test_safe_filename_agrees_with_plain_python(spark, names):
    got = evaluate(spark, names, paths.safe_filename)
    # scripts newer than the JVM's character tables are left out
    known = [(n, g) for n, g in zip(names, got) if all(ord(c) < 0x10000 for c in n)]
    for name, value in known:
        assert value == plain_safe_name(name), name


def test_safe_filename_twice_is_once(spark):
    once = evaluate(spark, ["a b (1).pdf", "..a.b", "é ü.x"], paths.safe_filename)
    assert evaluate(spark, once, paths.safe_filename) == once


def test_volume_parts(spark):
    values = ["/Volumes/c/s/v/f.txt", "/Volumes/c/s/v", "Volumes/c/s/v/", "/Volumes/c/s", "/tmp/x", "", None]
    parts = evaluate(spark, values, paths.volume_parts)
    assert [p and (p.catalog, p.schema, p.volume_name, p.full_path) for p in parts] == [
        ("c", "s", "v", "/Volumes/c/s/v/f.txt"), ("c", "s", "v", "/Volumes/c/s/v"), ("c", "s", "v", "Volumes/c/s/v/"),
        None, None, None, None]
    assert evaluate(spark, values[:1], paths.image_output_path) == ["/Volumes/c/s/v/parsed_images/"]


def test_percent_encode(spark):
    names = ["a b+c/d~e*f.txt", "é%&?=#.md", "plain-_.txt", "(x)'!.pdf"]
    assert evaluate(spark, names, paths.percent_encode) == [urllib.parse.quote(n) for n in names]


def test_links(spark):
    link = lambda c: paths.document_link(c, F.lit("name.txt"), "https://h", "7")
    assert evaluate(spark, ["/Volumes/c/s/v/f.txt", "/Volumes/c/s/v", "/tmp", None], link) == [
        "https://h/files/c/s/v/f.txt?workspace=7",
        "https://h/files/c/s/v/name.txt?workspace=7", None, None]
    own = lambda c: paths.document_link(c, F.lit("n"), "h", "7", "{host}#{inner}@{volume}{other}")
    assert evaluate(spark, ["/Volumes/c/s/v/f.txt"], own) == ["h#f.txt@v{other}"]
    log = lambda c: paths.log_link(c, F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit("id1"), "/Volumes/a/b/c/logs", "https://h", "7")
    assert evaluate(spark, ["/Volumes/c/s/v/x/y.log", "", "/tmp/x"], log) == [
        "https://h/files/c/s/v/x/y.log?workspace=7",
        "https://h/files/a/b/c/logs/2024-01-02/id1.log?workspace=7", None]


def test_html_to_text(spark):
    html = ("<html><head><STYLE type='x'>p{}</STYLE><script>var a='</p>';</script></head><!-- no\nno -->"
            "<body><p>A &amp;lt; B</p>\n<p>C&nbsp;&lt;D&gt; &quot;e&quot; it&#39;s</p></body></html>")
    assert evaluate(spark, [html], text.html_to_text) == ['A &lt; B C <D> "e" it\'s']


def test_markdown_to_text(spark):
    md = "# Title\n- **bold** [link](http://x/y) ![pic](p.png)\n```py\ncode\n```\n> quote\n"
    assert evaluate(spark, [md], text.markdown_to_text) == ["Title\nbold link pic\n\ncode\n\nquote\n"]


def test_join_pages(spark):
    pages = [[("a", 0), (None, 1), ("b", 2)], [], None]
    assert evaluate(spark, pages, text.join_pages, "x array<struct<text:string,page_id:int>>") == ["a\n\n\n\nb", "", ""]


def test_render_prompt_leaves_the_text_alone(spark):
    template = 'X {{"k": 1}} {document_text} {document_text} end'
    values = ["braces {{}} {document_text}", "", None]
    got = evaluate(spark, values, lambda c: prompts.render_prompt(F.lit(template), c))
    assert got == [template.format(document_text=v or "") for v in values]


def test_render_prompt_counts_code_points(spark):
    value = "é😀" * 4000
    assert evaluate(spark, [value], lambda c: prompts.render_prompt(F.lit("{document_text}"), c, 5000)) == [value[:5000]]
    assert evaluate(spark, [value], lambda c: prompts.render_prompt(F.lit("{document_text}"), c)) == [value]


def test_default_prompts_render(spark):
    for stage in ("categorize", "extract", "deidentify"):
        template = prompts.default_prompt(stage)
        assert evaluate(spark, ["doc"], lambda c: prompts.render_prompt(F.lit(template), c)) == [template.format(document_text="doc")]


def test_preview(spark):
    assert evaluate(spark, ["a" * 201, "a" * 200, None], lambda c: prompts.preview(c, 200)) == ["a" * 200 + "...", "a" * 200, None]


JSON_CASES = [
    ('{"a":1}', True), ('{"a":1} x', False), ('{"a":1}]', False), ("[1]]", False), ('{"a":1},[2]', False), ("1, 2", False),
    ("", False), ("  ", False), ("null", True), ('"s"', True), ('```json\n{"a":1}\n```', False), ('{"a":', False),
    ("prose", False), ("3", True), ("[1,2]", True), ('{"a":1}\n', True), (None, False), ('{"a":1}{"b":2}', False),
    ('{"a":1},"end-of-reply-5b0e7c52"', False),
]


def test_is_json(spark):
    assert evaluate(spark, [c for c, _ in JSON_CASES], lambda c: F.coalesce(replies.is_json(c), F.lit(False))) == [e for _, e in JSON_CASES]


def test_reply_shapes(spark):
    cases = ['{"entities": null}', '{"entities": [{"type":"a","value":1},3]}', "{}", '{"entities": "x"}', "[1]", "null", "bad"]
    error = lambda c: replies.list_error(replies.parse_reply(c), "entities")
    assert evaluate(spark, cases, error) == ["entities is not a list", None, None, "entities is not a list",
                                             "reply is not a JSON object", "reply is not a JSON object", None]
    items = evaluate(spark, cases, lambda c: replies.list_reply(replies.parse_reply(c), c, "entities"))
    assert [(len(i.entities), i.raw_response) for i in items] == [
        (0, None), (2, None), (0, None), (0, None), (0, None), (0, None), (0, "bad")]
    assert items[1].entities[0].value == "1"


def test_fence(spark):
    assert evaluate(spark, ['```json\n{"a":1}\n```', '{"a":1}'], replies.strip_fence) == ['{"a":1}\n', '{"a":1}']


def test_repair_and_salvage(spark):
    cases = ['{"a": "x\ny"}', "{'a': None, 'b': [True, False]}", "nothing", '{"a": 1']
    assert evaluate(spark, cases, replies.repair_json) == ['{"a": "x y"}', '{"a": null, "b": [true, false]}', None, None]
    cases = ['zz "pii_items": [{"type":"t","value":"v"}] zz', 'zz "pii_items": [{"type":"t","value":"[v]"}]', "none", '"pii_items": []']
    got = evaluate(spark, cases, replies.salvage_items)
    assert [g and [(i.type, i.value, i.strategy) for i in g] for g in got] == [[("t", "v", None)], None, None, []]


def test_mask_entities_keeps_others_without_flag(spark):
    df = spark.sql("SELECT array(named_struct('type','person','value','A','confidence',0.5D), named_struct('type','date','value','B','confidence',0.5D),"
                   " named_struct('type','Person','value','C','confidence',0.5D), named_struct('type',CAST(NULL AS string),'value','D','confidence',0.5D)) AS e")
    once = df.select(redaction.mask_entities(F.col("e")).alias("e"))
    got = [(e.type, e.value, e.masked) for e in once.first().e]
    assert got == [("person", "[REDACTED]", True), ("date", "B", None), ("Person", "C", None), (None, "D", None)]
    twice = once.select(redaction.mask_entities(F.col("e")).alias("e")).first().e
    assert [(e.type, e.value, e.masked) for e in twice] == got


def test_strategies(spark):
    def of(kind, strategy):
        return lambda c: F.expr(redaction.replacement_sql(kind, strategy, "x"))

    assert evaluate(spark, ["123-45-6789", "123", "1234"], of("ssn", "MASK")) == ["***-**-6789", "***", "****"]
    assert evaluate(spark, ["May 1, 1980", "soon"], of("date_of_birth", "GENERALIZE")) == ["1980", "[REDACTED]"]
    assert evaluate(spark, ["$2,458.92", "$7", "-"], of("salary_income", "GENERALIZE")) == ["$1000+", "$1+", "[REDACTED]"]
    assert evaluate(spark, ["1 A Street, X, CO 80202", "1 A Street"], of("address", "GENERALIZE")) == ["CO 80202", "[REDACTED]"]
    assert evaluate(spark, ["x"], of("email", "REDACT")) == ["[REDACTED]"]


def test_replacements_longest_first(spark):
    df = spark.sql("SELECT 'ann annabel ann' AS t, array(named_struct('value','ann','replacement','<1>'),"
                   " named_struct('value','annabel','replacement','<2>'), named_struct('value','','replacement','x')) AS i")
    assert df.select(redaction.apply_replacements(F.col("t"), F.col("i"))).first()[0] == "<1> <2> <1>"


def test_replacements_are_whole_values_in_one_pass(spark):
    text = "Credit Score: 555 at desk 5551, 555-1 Balance: $12345.50, Income: $10000. Q\\E(x) 10000"
    items = [("555", "[REDACTED]"), ("$12345.50", "$10000+"), ("$10000", "$10000+"), ("10000", "N"), ("Q\\E(x)", "q"), ("", "no"), ("x", None)]
    df = spark.createDataFrame([(text, items), ("none", []), (None, items)], "t string, i array<struct<value:string,replacement:string>>")
    got = [r[0] for r in df.select(redaction.apply_replacements(F.col("t"), F.col("i"))).collect()]
    assert got == ["Credit Score: [REDACTED] at desk 5551, [REDACTED]-1 Balance: $10000+, Income: $10000+. q N", "none", None]


def test_replaced_places_against_plain_python(spark):
    """Overlapping values, values that overlap themselves, word borders, several replacements."""
    import random
    import re

    def plain(text, items):
        values = {}
        for v, r in sorted(i for i in items if i[0] and i[1] is not None):
            values.setdefault(v, r)
        word = lambda c: bool(re.match(r"[^\W_]", c))
        at, out = 0, ""
        while at < len(text):
            for v in sorted(values, key=len, reverse=True):
                cuts = at > 0 and word(text[at - 1]) and word(v[0])
                end = at + len(v)
                cuts |= end < len(text) and word(text[end]) and word(v[-1])
                if text.startswith(v, at) and not cuts:
                    out, at = out + values[v], end
                    break
            else:
                out, at = out + text[at], at + 1
        return out

    rng = random.Random(1)
    rows = []
    for _ in range(300):
        text = "".join(rng.choice("ab -.é😀") for _ in range(rng.randint(0, 40)))
        cut = lambda: (lambda s: text[s : s + rng.randint(0, 6)])(rng.randint(0, len(text)))
        rows.append((text, [(cut(), rng.choice(["<1>", "", "b a", None])) for _ in range(rng.randint(0, 5))]))
    rows += [("a a a a", [("a a", "X"), ("a", "Y")]), ("xa a a", [("a a", "X")]), ("-.-.-", [("-.-", "X")]), ("", [("a", "b")])]
    df = spark.createDataFrame(rows, "t string, i array<struct<value:string,replacement:string>>").coalesce(1)
    got = [r[0] for r in df.select(redaction.apply_replacements(F.col("t"), F.col("i"))).collect()]
    assert got == [plain(t, i) for t, i in rows]


def test_literals_with_apostrophes(spark):
    rows = ["{'a': \"O'Brien\", 'n': None}", "{'a': 'it''s', 'b': [True, 'x']}", "{'a': 'say \"hi\" now'}", "{'k': 'd\u2019or', 'v': 'O'Neil Co'}"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = [r[0] for r in df.select(replies.repair_json(F.col("s"))).collect()]
    import json

    assert [json.loads(g) if g else g for g in got] == [
        {"a": "O'Brien", "n": None}, {"a": "it''s", "b": [True, "x"]}, {"a": 'say "hi" now'}, {"k": "d\u2019or", "v": "O'Neil Co"}]


def test_malformed_bytes_become_replacement_characters(spark):
    from dossierflow.functions.text import decode_utf8

    df = spark.createDataFrame([(bytes.fromhex("41ff42"),)], "b binary")
    assert df.select(decode_utf8(F.col("b"))).first()[0] == "A\ufffdB"


def test_view_helpers(spark):
    assert evaluate(spark, ["", "a", "a,b", "a, ,b", None], views.trace_list) == [[], ["a"], ["b", "a"], ["b", "a"], []]
    assert evaluate(spark, ["", "a", "a,b,c"], views.trace_labels) == [["N/A"], ["a"], ["Latest: c", "Prev: b", "Prev: a"]]
    assert evaluate(spark, ["2024-01-02T03:04:05.6", "", None], lambda c: views.shown_time(c, True)) == ["2024-01-02 03:04:05", "-", "-"]
    label = lambda c: views.status_label(c, F.lit("parse"))
    assert evaluate(spark, ["completed", "failed", "processing", "pending", "", None], label) == [
        "Pass", "Fail (parse)", "Processing (parse)", "pending", "-", "-"]
    assert evaluate(spark, ["failed"], lambda c: views.status_label(c, F.lit(None).cast("string"))) == ["Fail"]
    assert evaluate(spark, ["completed", "failed", "pending"], lambda c: views.actions(c, F.lit(""))) == [["View"], ["Delete"], ["-"]]

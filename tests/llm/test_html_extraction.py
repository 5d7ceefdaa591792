import math
import random
from collections import defaultdict

import pytest

from dossierflow.llm import html_extraction as hx

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'
    "<nav><ul><li><a href='/x'>Menu</a></li></ul></nav><!-- ad --><div class='ad'>Buy now</div>"
    "<article><header><h1>Title &amp; more</h1></header><p><b>First   para.<br><p>Second&nbsp;\npara &lt;b&gt;.</p>"
    "<form>Name <input></form><div class=\"comments\"><p>Reader says</p></div><aside>Aside</aside>"
    "<ul><li>one</li><li>two</li></ul></article><footer>&copy; foot</footer></body></html>"
)


def test_blocks():
    assert hx.blocks(PAGE) == (["Title & more", "First para.", "Second para <b>.", "one", "two"], True)


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("plain text &amp", ["plain text &"]),
        ("<p>a<p>b", ["a", "b"]),
        ("<p>cut <b", ["cut"]),
        ("<article><p>one</p><p>two &am", ["one", "two &am"]),
        ("<div><p>x < y</p></div>", ["x < y"]),
        ("<script>never ends <p>x", []),
        ("<article>a<script>b</script>c</article>d", ["ac"]),
        ("<div class=\"sidebar\"><div>in</div></div><div class='adapter'>kept</div>", ["kept"]),
        ("<![CDATA[raw <b>]]>", ["raw <b>"]),
    ],
)
def test_odd_pages(page, want):
    assert hx.blocks(page)[0] == want


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 2) for i, u, h in rows],
                                 "page_id long, url string, html string, text string, row_id int").repartition(3)


def test_hosts_repeated_runs_go(spark):
    line = "Sign up for our weekly letter and get ten per cent off everything"
    rows = [
        (i, f"https://h{i % 2}.example.com/{i}?q", f"<div>{line}</div><div>Page {i} has its own text about subject {i * 7}. {line}</div>")
        for i in range(6)
    ]
    rows += [(10, "https://alone.example.org/", f"<div>{line}</div>"), (11, "https://h0.example.com/x", f"<main><p>{line}</p></main>")]
    rows += [(12, None, None), (13, None, ""), (12, None, None)]
    got = {}
    for r in hx.extract(pages_of(spark, rows)).collect():
        got.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    for i in range(6):
        assert got[i][0].text == f"Page {i} has its own text about subject {i * 7}."
    assert got[10][0].text == got[11][0].text == line
    assert [r.text for r in got[12] + got[13]] == ["", "", ""]


def test_equal_pages_are_one(spark):
    page = "<div>" + " ".join(f"w{i}" for i in range(30)) + "</div>"
    got = hx.extract(pages_of(spark, [(1, "http://a/1", page), (2, "http://a/2", page)])).collect()
    assert {r.text for r in got} == {" ".join(f"w{i}" for i in range(30))}
    assert hx.extract(pages_of(spark, []).limit(0)).count() == 0


def test_host():
    assert [hx.host(u) for u in ("https://u@A.b:8/x", "//c.d?x", "nothing", None)] == ["a.b:8", "c.d", "nothing", ""]


@pytest.mark.parametrize(
    "attrs",
    ['id="related-work"', 'id="social-impact"', 'id="search-results"', "id='modal-verbs'", 'id="comments-on-method"',
     'class="layout has-sidebar"', 'class="no-sidebar"', 'class="page with-nav"', 'data-id="ad"', 'title="class=ad"'],
)
def test_noise_is_a_whole_token(attrs):
    assert hx.blocks(f"<article><div {attrs}>kept</div></article>") == (["kept"], True)
    assert hx.blocks(f"<div {attrs}><article>kept</article></div>") == (["kept"], True)


def test_headings_and_articles_in_skipped_elements():
    assert hx.blocks('<article><h2 id="related">Related</h2><p class="x ad">gone</p></article>') == (["Related"], True)
    assert hx.blocks('<form><div class="sidebar">a<main>kept<aside>b</aside></main>c</div></form>') == (["kept"], True)
    assert hx.blocks('<article><div class="related"><p>a</p></div><p class="search">b</p></article>') == (["a", "b"], True)
    assert hx.blocks('<div class="related"><article>teaser</article></div><article>kept</article>') == (["kept"], True)


def brute(pages):
    """Texts by comparing all runs of tokens of a host's distinct pages."""
    read = {i: (hx.host(u), *hx.blocks(h or "")) for i, u, h in pages}
    distinct = defaultdict(set)
    for name, found, marked in read.values():
        distinct[name].add((tuple(found), marked))
    out, k = {}, hx.MIN_TOKENS
    for i, (name, found, marked) in read.items():
        least, share = hx.ARTICLE if marked else hx.OPEN
        least = max(least, math.ceil(share * len(distinct[name])))
        met = defaultdict(int)
        for page, _ in distinct[name]:
            tokens = " ".join(page).split(" ")
            for run in {tuple(tokens[p : p + k]) for p in range(len(tokens) - k + 1)}:
                met[run] += 1
        tokens = " ".join(found).split(" ")
        places = [p for p in range(len(tokens) - k + 1) if met[tuple(tokens[p : p + k])] >= least]
        out[i] = "\n".join(hx._unique(found, places))
    return out


def test_repeated_runs_by_brute_force(spark):
    rng = random.Random(7)
    lines = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(4, 25))) for _ in range(12)]
    pages = []
    for i in range(120):
        tag = rng.choice(["article", "div"])
        parts = [" ".join(rng.choice("klmnopqrst") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        for j, line in enumerate(lines):
            if rng.random() < (j + 1) / 14:
                parts.insert(rng.randint(0, len(parts)), line)
        pages.append((i, f"http://h{min(i % 7, 3)}.example/{i}", f"<{tag}><p>{'</p><p>'.join(parts)}</p></{tag}>"))
    pages += [(200 + i, "http://h3.example/copy", pages[3][2]) for i in range(150)]  # copies count once
    want = brute(pages)
    got = {r.page_id: r.text for r in hx.extract(pages_of(spark, pages)).collect()}
    assert got == want
    assert sum(want[i] != "\n".join(hx.blocks(h)[0]) for i, _, h in pages[:120]) > 60


def test_articles_keep_quotes_and_lose_adverts(spark):
    advert = "Buy our premium plan today and save half of the price for a year"
    quote = "we hold these truths to be self-evident, that all men are created equal"
    own = lambda i: " ".join(f"word{i}x{j}" for j in range(20))
    rows = [
        (i, f"https://news.example.com/{i}", f"<article><p>{own(i)}</p><p>{advert}</p>" + f"<p>{quote}</p>" * (i < 2) + "</article>")
        for i in range(8)
    ]
    rows += [(20 + i, f"https://wiki.example.com/{i}", f"<div>{own(i)}</div>" + f"<div>{quote}</div>" * (i < 2)) for i in range(8)]
    got = {r.page_id: r.text for r in hx.extract(pages_of(spark, rows)).collect()}
    for i in range(8):
        kept = own(i) + f"\n{quote}" * (i < 2)
        assert got[i] == got[20 + i] == kept


def test_pages_without_a_mark(spark):
    """Accuracy where only repetition tells: all of the articles stays, the host's notices go."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(9, 16)))
    notices = {h: [sentence() for _ in range(4)] for h in range(3)}
    rows, want = [], {}
    for i in range(90):
        body = [sentence() for _ in range(6)]
        first, *others = rng.sample(notices[i % 3], 3)
        rows.append((i, f"http://h{i % 3}.example/{i}", "".join(f"<div>{x}</div>" for x in [first, *body, *others])))
        want[i] = "\n".join(body)
    got = {r.page_id: r.text for r in hx.extract(pages_of(spark, rows)).collect()}
    assert got == want


def test_a_very_long_page(spark):
    text = " ".join(f"t{i % 99991}" for i in range(200_000))
    assert [r.n_chars for r in hx.extract(pages_of(spark, [(1, None, f"<p>{text}")])).collect()] == [len(text)]

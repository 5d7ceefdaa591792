"""Main text of web pages: structure first, then passages that a host's pages repeat.

A page is read into blocks of text. Elements that are never main text (navigation, headers
and footers of the page, sidebars, forms, scripts, styles, notices, adverts, reader comments;
by element or by whole tokens of class, id and role; the id of a heading is not read) are
skipped, but for an article inside them when the page has no other. If the page marks its article
(``article``, ``main``), the blocks inside are read, else all blocks.

What is left of all pages, marked or not, goes through a suffix array for each host. A page's
blocks are one stream of tokens; its suffixes are sorted by host and their first ``MIN_TOKENS``
tokens, over ranges of all hosts together, and neighbours are compared: a run of neighbours that
share these tokens is a passage of as many distinct pages. A longer passage is a chain of suffixes
that start at places in a row, so nothing is lost by comparing no further. A passage is boilerplate
if enough of the host's pages have it: ``OPEN`` on pages that mark no article, ``ARTICLE`` inside a
marked article, which phrases that articles quote from each other don't reach. Tokens that
boilerplate covers go, unique runs stay.

Suffixes that can't be boilerplate are left out before they are sorted: equal passages have equal
anchors (``recurrence``), and anchors on too few pages of a host are known from a count that is
combined before its shuffle. The others are in a bitmap of at most 2 ** ``BITMAP`` bits. It can let
further suffixes through, which then are sorted in vain, but holds back none. The last key of the sort is the page, so
that a passage on a third of all pages is dealt out to many tasks; their counts are added up.

A null page is empty, its text an empty string; an empty table gives no rows; equal pages of a host
(of equal text, an article marked in both or in neither) count as one page; other columns are ignored. A null url is a host of its own. Long pages are read whole.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierflow.llm.batches import column, slices
from dossierflow.llm.hashing import Prefix, Words, mix
from dossierflow.llm.recurrence import find_runs
from dossierflow.llm.store import keep

#: length in tokens from which a passage that a host repeats is boilerplate, and of the grams it is anchored by
MIN_TOKENS, GRAM = 8, 3
#: a passage is boilerplate on so many distinct pages of a host, and on this share of them (in an article no fewer)
OPEN, ARTICLE = (3, 0.1), (5, 0.5)
#: log2 of the bits of the bitmap of anchors, at most (16 MB)
BITMAP = 27
#: bits of an anchor's key that tell the host
_HOST_BITS = 24
#: parts into which the rows of a host or passage are dealt for a join
_SALTS = 16

_SKIP = {
    "head", "script", "style", "noscript", "template", "nav", "aside", "form", "button", "select", "textarea",
    "iframe", "object", "svg", "canvas", "menu", "dialog", "audio", "video", "map",
}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}
_MAIN = {"article", "main"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = {
    "html", "body", "p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl",
    "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure",
    "figcaption", "header", "footer", "address", "details", "summary", "hr", "center", "fieldset", "head", "nav", "aside", "form", "menu",
    "dialog",
}
# whole tokens of class, id or role that mark what is not main text; other attributes are not read
_NOISE = re.compile(
    r"""ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|"""
    r"""popup|modal|newsletter|subscribe|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-header|"""
    r"""comments?|comment-(?:list|form|section|area|body|thread|\d+)|disqus_thread|replies|respond|pagination|contentinfo""",
    re.IGNORECASE,
)
# the same outside of an article only: inside they can be parts of it
_AROUND = re.compile(r"widget|share|sharing|social|related|recommended|search|complementary", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|[^\s"'>/=]+""")
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _noisy(name: str, attrs: str, inside: bool) -> bool:
    read = ("class", "role") if name in _HEADING else ("class", "id", "role")
    return any(
        _NOISE.fullmatch(token) or (not inside and _AROUND.fullmatch(token))
        for m in _ATTRIBUTE.finditer(attrs)
        if m[1] and m[1].lower() in read
        for token in (m[2] or m[3] or m[4] or "").split()
    )


_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)"""
    r"""|</[^>]*(?:>|\Z)""",
    re.DOTALL,
)
_SPACE = re.compile(r"\s+")


def blocks(page: str) -> tuple[list[str], bool]:
    """Blocks of main text in page order, and whether the page marks where its article is."""
    stack: list[tuple[str, bool, int]] = []  # element, skipped, in the article
    # outside and inside of an article, and in one that stands in what is skipped
    found: tuple[list[str], list[str], list[str]] = ([], [], [])
    text: list[str] = []
    skipped, main, marked = False, 0, {0}
    at = 0

    def flush() -> None:
        if text:
            block = _SPACE.sub(" ", "".join(text)).strip()
            if block:
                found[main].append(block)
            text.clear()

    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at and not skipped:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"] and not skipped:
            text.append(m["cdata"])
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name == "br" or (name == "wbr"):
            if not skipped and name == "br":
                text.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if m["end"]:
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
                skipped, main = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            continue
        if name in _VOID or m["attrs"].rstrip().endswith("/"):
            continue
        if name == "p":  # a paragraph ends the one before, with what is open inside it
            opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _BLOCK), None)
            if opened is not None and stack[opened][0] == "p":
                del stack[opened:]
                skipped, main = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        noise = name in _SKIP or (
            name not in ("html", "body", "article", "main") and bool(m["attrs"]) and _noisy(name, m["attrs"], main > 0)
        )
        # headers and footers of the article itself can hold its title
        noise |= name == "footer" or (name == "header" and not main)
        if name in _MAIN and not main:
            main, skipped = (2, False) if skipped else (1, False)
            marked.add(main)
        skipped = skipped or noise
        stack.append((name, skipped, main))
    if at < len(page) and not skipped:
        rest = page[at:]
        text.append(html.unescape(rest.split("<", 1)[0] if re.match(r"<[a-zA-Z/!]", rest) else rest))
    flush()
    # an article around which all is skipped is the page's only if there is no other
    return found[1 if 1 in marked else max(marked)], len(marked) > 1


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].lower().rsplit("@", 1)[-1] if m else (url or "")


def _digest(*parts: str, size: int = 16) -> bytes:
    return hashlib.blake2b("\n".join(parts).encode("utf-8", "replace"), digest_size=size).digest()


def _parsed(pages: DataFrame) -> DataFrame:
    """row_id, page_id, url, host, its number, text (blocks on lines), marked, digest of these three."""
    schema = T.StructType([
        *[T.StructField(c, pages.schema[c].dataType) for c in ("page_id", "url")],
        T.StructField("row_id", T.LongType()),
        T.StructField("host", T.StringType()),
        T.StructField("host_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("marked", T.BooleanType()),
        T.StructField("page", T.BinaryType()),
    ])

    def run(batches):
        for b in batches:
            found = [blocks(h) if h else ([], True) for h in column(b, "html").to_pylist()]
            texts = ["\n".join(x) for x, _ in found]
            hosts = [host(u) for u in column(b, "url").to_pylist()]
            numbers = [int.from_bytes(_digest(h, size=8), "little") >> 64 - _HOST_BITS for h in hosts]
            yield pa.RecordBatch.from_arrays(
                [
                    column(b, "page_id"),
                    column(b, "url"),
                    column(b, "row_id"),
                    pa.array(hosts, pa.string()),
                    pa.array(numbers, pa.int64()),
                    pa.array(texts, pa.string()),
                    pa.array([y for _, y in found], pa.bool_()),
                    pa.array([_digest(str(y), h, t) for h, t, (_, y) in zip(hosts, texts, found)], pa.binary()),
                ],
                names=[f.name for f in schema],
            )

    rows = pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("row_id"))
    return rows.mapInArrow(run, schema)


def _anchored(b: pa.RecordBatch):
    """For slices of a batch: first row, bytes, words, and of each run of windows its row, place, length and key."""
    ids = column(b, "host_id").to_numpy()
    for lo, _, data, offsets in slices(column(b, "text")):
        words = Words(data, offsets)
        row, at, n, value, _, _ = find_runs(Prefix(words.hashes), words.first, MIN_TOKENS, GRAM)
        key = (mix(value) >> np.uint64(_HOST_BITS)).astype(np.int64) | (ids[lo + row] << (64 - _HOST_BITS))
        yield lo, data, words, row, at, n, key


def _anchors(pages: DataFrame) -> DataFrame:
    """key of each anchor of a page, once."""

    def run(batches):
        for b in batches:
            for _, _, _, row, _, _, key in _anchored(b):
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[new])], names=["key"])

    return pages.select("host_id", "text").mapInArrow(run, "key long")


def _bitmap(keys: DataFrame) -> tuple[int, bytes]:
    """log2 of its bits, and a bitmap of the keys, by the top bits of their hash."""
    log = min(BITMAP, max(15, (16 * keys.count()).bit_length()))
    place = F.shiftrightunsigned(F.col("place"), 64 - log) + 1
    hashed = keys.mapInArrow(
        lambda batches: (
            pa.RecordBatch.from_arrays([pa.array(mix(column(b, "key").to_numpy().view(np.uint64)).view(np.int64))], names=["place"])
            for b in batches
        ),
        "place long",
    )
    parts = hashed.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = bytearray((1 << log) // 8)
    for r in parts.collect():  # at most 4,096 rows of 4 kB
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.bits
    return log, bytes(out)


def _suffixes(pages: DataFrame, log: int, bitmap: bytes) -> DataFrame:
    """host, suffix (its first tokens), page, marked, places of it there: suffixes whose anchor is in the bitmap."""
    held = pages.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        known = np.frombuffer(held.value, np.uint8)
        for b in batches:
            about = [column(b, c) for c in ("host", "page", "marked")]
            for lo, data, words, row, at, n, key in _anchored(b):
                place = (mix(key.view(np.uint64)) >> np.uint64(64 - log)).astype(np.int64)
                some = np.flatnonzero(known[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                raw = data.tobytes()
                found: dict[tuple[int, bytes], list[int]] = {}
                for r, p, k in zip(row[some].tolist(), at[some].tolist(), n[some].tolist()):
                    first = int(words.first[r])
                    for q in range(p, p + k):
                        text = raw[words.starts[first + q] : words.ends[first + q + MIN_TOKENS - 1]]
                        found.setdefault((r, text.replace(b"\n", b" ")), []).append(q)
                if found:
                    rows = pa.array([lo + r for r, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[x.take(rows) for x in about],
                            pa.array([t for _, t in found], pa.binary()), pa.array(list(found.values()), pa.list_(pa.int32())),
                        ],
                        names=["host", "page", "marked", "suffix", "places"],
                    )

    return pages.select("host", "host_id", "text", "page", "marked").mapInArrow(
        run, "host string, page binary, marked boolean, suffix binary, places array<int>"
    )


def passages(suffixes: DataFrame) -> DataFrame:
    """host, suffix, pages: passages of sorted suffixes (one row for each page), with their numbers of pages."""

    def run(batches):
        last, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            names, heads = column(b, "host"), column(b, "suffix")
            new = np.ones(b.num_rows, bool)  # shares less than MIN_TOKENS tokens with the suffix before
            new[1:] = pc.or_(pc.not_equal(names[1:], names[:-1]), pc.not_equal(heads[1:], heads[:-1])).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, b.num_rows))
            found = list(zip(names.take(pa.array(start)).to_pylist(), heads.take(pa.array(start)).to_pylist(), length.tolist()))
            if last == found[0][:2]:
                found[0] = (*last, found[0][2] + n)
            elif last:
                found.insert(0, (*last, n))
            *done, (h, x, n) = found
            last = (h, x)
            yield _passages(done)
        if last:
            yield _passages([(*last, n)])

    order = ["host", "suffix", "page"]
    runs = (
        suffixes.select(order).repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(run, "host string, suffix binary, pages long")
    )
    return runs.groupBy("host", "suffix").agg(F.sum("pages").alias("pages"))  # those over the end of a range


def _passages(found: list[tuple[str, bytes, int]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names=["host", "suffix", "pages"]
    )


def _dealt(rows: DataFrame, few: DataFrame, on: list[str], by: str) -> DataFrame:
    """Join with one row for each key, a key's rows dealt out by the hash of a column."""
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(_SALTS)).cast("int"))
    return dealt.join(copies, [*on, "salt"]).drop("salt")


def _least(rule: tuple[int, float]) -> Column:
    return F.greatest(F.lit(rule[0]), F.ceil(F.col("n") * rule[1])).cast("long")


def boilerplate(parsed: DataFrame) -> DataFrame:
    """page, places: where suffixes of boilerplate start on the pages that have some."""
    several = parsed.groupBy("page").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    more = parsed.select("page", "row_id").join(several, "page").where("row_id <> first").select("row_id")
    pages = parsed.join(keep(more, "copies"), "row_id", "left_anti")
    hosts = keep(
        pages.groupBy("host", "host_id").agg(F.count(F.lit(1)).alias("n"), F.every("marked").alias("articles"))
        .select("host", "host_id", "articles", _least(OPEN).alias("open"), _least(ARTICLE).alias("article")),
        "hosts",
    )
    # where all pages mark their article, nothing below its threshold can go
    hosts = hosts.withColumn("least", F.when(F.col("articles"), F.col("article")).otherwise(F.col("open")))
    least = hosts.groupBy("host_id").agg(F.min("least").alias("least"))
    often = _anchors(pages).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OPEN[0])
    often = often.withColumn("host_id", F.shiftrightunsigned("key", 64 - _HOST_BITS))
    keys = keep(_dealt(often, least, ["host_id"], "key").where("n >= least").select("key"), "anchors")
    suffixes = keep(_suffixes(pages, *_bitmap(keys)), "suffixes")
    known = _dealt(passages(suffixes), hosts.drop("host_id"), ["host"], "suffix").where("pages >= least")
    common = keep(known.select("host", "suffix", (F.col("pages") >= F.col("article")).alias("anywhere")), "passages")
    met = _dealt(suffixes, common, ["host", "suffix"], "page").where("anywhere or not marked")
    places = met.select("page", F.explode("places").alias("place")).groupBy("page")
    return keep(places.agg(F.collect_list("place").alias("places")), "places")


def _unique(blocks_: list[str], places: list[int]) -> list[str]:
    """Blocks without the tokens covered by passages that start at ``places``.

    A passage that goes over the end of a block takes whole blocks only, so that it does not
    take the first words of what follows it on several pages.
    """
    covered: set[int] = set()
    for p in places:
        covered.update(range(p, p + MIN_TOKENS))
    starts, out, at = set(places), [], 0
    for b in blocks_:
        tokens = b.split(" ")
        end = at + len(tokens)
        if not covered.issuperset(range(at, end)):
            inside: set[int] = set()
            for p in range(at, end - MIN_TOKENS + 1):
                if p in starts:
                    inside.update(range(p, p + MIN_TOKENS))
            left = [t for i, t in enumerate(tokens, at) if i not in inside]
            if left:
                out.append(" ".join(left))
        at = end
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    parsed = keep(_parsed(pages), "pages")
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            texts, places = column(b, "text"), column(b, "places")
            if places.null_count < b.num_rows:
                texts = texts.to_pylist()
                for i in np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    texts[i] = "\n".join(_unique(texts[i].split("\n"), places[i].as_py()))
                texts = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [column(b, "page_id"), column(b, "url"), texts.cast(pa.string())], names=[f.name for f in schema]
            )

    met = parsed.join(boilerplate(parsed), "page", "left").select("page_id", "url", "text", "places")
    return met.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))

"""Bytes and markup to plain text, page joins and text measures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dossierflow.functions.prompts import preview

PAGE_BREAK = "\n\n"


def decode_utf8(content: Column) -> Column:
    """Bytes as text; malformed sequences become replacement characters instead of
    failing the whole job."""
    return F.make_valid_utf8(content.cast("string"))


def html_to_text(html: Column) -> Column:
    """Visible text: comments, scripts, styles and tags dropped, entities decoded,
    white space collapsed."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(
        text, r"(?s)<([sS][cC][rR][iI][pP][tT]|[sS][tT][yY][lL][eE])[^>]*>.*?</(?:[sS][cC][rR][iI][pP][tT]|[sS][tT][yY][lL][eE])[^>]*>", " "
    )
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def markdown_to_text(markdown: Column) -> Column:
    """Text without heading, list, quote, emphasis, code and link markers."""
    text = F.regexp_replace(markdown, r"(?md)^[ \t]*```[^\n]*$", "")
    text = F.regexp_replace(text, r"(?md)^[ \t]{0,3}(?:#{1,6}|>|[*+-])[ \t]+", "")
    text = F.regexp_replace(text, r"!?\[([^\[\]\n]*)\]\([^()\n]*\)", "$1")
    return F.regexp_replace(text, r"\*\*|__|`", "")


def single_page(text: Column) -> Column:
    """A parsed document is one page with id 0."""
    return F.array(F.struct(text.alias("text"), F.lit(0).alias("page_id")))


def join_pages(pages: Column) -> Column:
    """Page texts joined by a blank line; a missing text counts as empty, missing pages too."""
    return F.coalesce(
        F.array_join(F.transform(pages, lambda p: F.coalesce(p["text"], F.lit(""))), PAGE_BREAK), F.lit("")
    )


def text_sample(text: Column) -> Column:
    return preview(text, 500)

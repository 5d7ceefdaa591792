"""Prompt templates and rendering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dossierflow.schemas import (
    CATEGORIES,
    CATEGORIZATION,
    ENTITY_TYPES,
    PII_TYPES,
    PROMPT_TEXT_CHARS,
    STRATEGIES,
)

# Template syntax: {document_text} is the slot, doubled braces are literal braces.
SLOT = "{document_text}"


def _bullets(names: list[str]) -> str:
    return "\n".join(f"- {name}" for name in names)


def default_prompt(stage: str) -> str:
    """Built-in template of a model stage."""
    if stage == "categorize":
        keys = ", ".join(f'"{f.name}"' for f in CATEGORIZATION.fields)
        return (
            "Choose the best and the second-best category for this document.\n\n"
            f"Categories:\n{_bullets(CATEGORIES)}\n\nDocument:\n{SLOT}\n\n"
            f"Answer with one JSON object with the keys {keys}, like {{{{...}}}}.\n"
        )
    if stage == "extract":
        return (
            "List every entity of these types that the document mentions.\n\n"
            f"Types:\n{_bullets(ENTITY_TYPES)}\n\nDocument:\n{SLOT}\n\n"
            'Answer with JSON: {{"entities": [{{"type": "", "value": "", "confidence": 0.0}}]}}\n'
        )
    if stage == "deidentify":
        return (
            "List every piece of personal or sensitive financial data in the document and how to "
            f"hide it ({', '.join(STRATEGIES)}).\n\nTypes:\n{_bullets(PII_TYPES)}\n\n"
            f"Document:\n{SLOT}\n\n"
            'Answer with JSON: {{"pii_items": '
            '[{{"type": "", "value": "", "strategy": "", "replacement": ""}}]}}\n'
        )
    raise ValueError(f"no prompt for stage {stage!r}")


def truncate_text(text: Column, limit: int = PROMPT_TEXT_CHARS) -> Column:
    """The part of a text a prompt carries: its first ``limit`` code points."""
    return F.left(text, F.lit(limit))


def text_windows(text: Column, size: int = PROMPT_TEXT_CHARS, overlap: int = 500) -> Column:
    """The whole text as overlapping pieces of at most ``size`` code points, at least one; what
    is no longer than ``overlap`` lies whole in some piece. A NULL text is one empty piece."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap
    whole = F.coalesce(text, F.lit(""))
    last = F.greatest(F.ceil((F.length(whole) - F.lit(overlap)) / F.lit(step)), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(whole, i * step + 1, F.lit(size)))


def or_default(value: Column, default: Column | str) -> Column:
    """``value``, or the default where it is NULL or empty."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def render_prompt(template: Column, text: Column, limit: int | None = None) -> Column:
    """Fill the slot with the whole text, or with its first ``limit`` code points if asked to. Braces
    are unescaped piecewise around the slot, so that the inserted text is left exactly as it is."""
    part = text if limit is None else truncate_text(text, limit)
    pieces = F.transform(
        F.split(template, r"\{document_text\}"),
        lambda p: F.replace(F.replace(p, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")),
    )
    return F.call_function("array_join", pieces, F.coalesce(part, F.lit("")))


def preview(text: Column, limit: int) -> Column:
    """First ``limit`` characters, with an ellipsis if anything was left out."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)

"""Model replies: strict JSON reading, fallbacks, shape errors, repair and salvage."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dossierflow.schemas import (
    CATEGORIZATION,
    PII_ITEM,
    REPLY_EXCERPT_CHARS,
    UNKNOWN_CATEGORY,
    ddl,
)

# A JSON parser that stops after the first value would accept trailing text. The
# reply is therefore read as the first item of a list whose second item is this mark.
_MARK = "end-of-reply-5b0e7c52"


def strip_fence(reply: Column) -> Column:
    """Body of a reply that is one fenced block, other replies as they are."""
    body = F.regexp_extract(reply, r"(?s)^[ \t\r\n]*```[A-Za-z]*[ \t]*\r?\n(.*?)```[ \t\r\n]*$", 1)
    return F.when(body != "", body).otherwise(reply)


def wrap_reply(reply: Column) -> Column:
    """Variant list [reply, mark]; NULL if the reply is not JSON."""
    return F.try_parse_json(F.concat(F.lit("["), reply, F.lit(f',"{_MARK}"]')))


def reply_value(wrapped: Column) -> Column:
    """The reply's variant, NULL unless the whole reply is exactly one JSON value."""
    exact = (F.try_variant_get(wrapped, "$[1]", "string") == _MARK) & F.try_variant_get(
        wrapped, "$[2]", "variant"
    ).isNull()
    return F.when(exact, F.try_variant_get(wrapped, "$[0]", "variant"))


def parse_reply(reply: Column) -> Column:
    return reply_value(wrap_reply(reply))


def is_json(reply: Column) -> Column:
    return parse_reply(reply).isNotNull()


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(_kind(value).startswith("OBJECT"), F.lit(False))


def _is_array(value: Column) -> Column:
    return F.coalesce(_kind(value).startswith("ARRAY"), F.lit(False))


def excerpt(reply: Column) -> Column:
    return F.left(reply, F.lit(REPLY_EXCERPT_CHARS))


def categorization_from(value: Column, reply: Column) -> Column:
    """The six classification fields, or the Unknown fallback for text that is not JSON."""
    read = F.struct(
        *[
            F.try_variant_get(value, f"$.{f.name}", f.dataType.simpleString()).alias(f.name)
            for f in CATEGORIZATION.fields
        ]
    )
    fallback = F.struct(
        F.lit(UNKNOWN_CATEGORY).alias("primary_category"),
        F.lit(0.0).alias("primary_confidence"),
        excerpt(reply).alias("primary_justification"),
        F.lit(UNKNOWN_CATEGORY).alias("secondary_category"),
        F.lit(0.0).alias("secondary_confidence"),
        F.lit("Failed to parse response").alias("secondary_justification"),
    )
    return F.when(value.isNotNull(), read).otherwise(fallback)


def categorization_error(value: Column) -> Column:
    """Why a JSON reply cannot be a classification; NULL if it can."""
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(~is_object(value), F.lit("reply is not a JSON object"))
        .when(F.try_variant_get(value, "$.primary_category", "variant").isNull(),
              F.lit("reply has no primary_category"))
    )


def _items(value: Column, key: str, fields: dict[str, str]) -> Column:
    items = F.try_variant_get(value, f"$.{key}", "array<variant>")
    return F.transform(
        items,
        lambda item: F.struct(*[F.try_variant_get(item, f"$.{n}", t).alias(n) for n, t in fields.items()]),
    )


def entities_from(value: Column) -> Column:
    fields = {"type": "string", "value": "string", "confidence": "double"}
    return F.coalesce(_items(value, "entities", fields), F.array().cast(_array_ddl(fields)))


def pii_items_from(value: Column) -> Column:
    fields = {f.name: "string" for f in PII_ITEM.fields}
    return F.coalesce(_items(value, "pii_items", fields), F.array().cast(_array_ddl(fields)))


def _array_ddl(fields: dict[str, str]) -> str:
    return "array<struct<" + ",".join(f"{n}:{t}" for n, t in fields.items()) + ">>"


def list_reply(value: Column, reply: Column, key: str) -> Column:
    """struct(items, raw_response): a bad reply yields no items and is kept as it is."""
    items = entities_from(value) if key == "entities" else pii_items_from(value)
    return F.struct(
        items.alias(key), F.when(value.isNull(), reply).alias("raw_response")
    )


def list_error(value: Column, key: str) -> Column:
    """Why a JSON reply cannot hold the list ``key``; an absent key is an empty list."""
    found = F.try_variant_get(value, f"$.{key}", "variant")
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(~is_object(value), F.lit("reply is not a JSON object"))
        .when(found.isNotNull() & ~_is_array(found), F.lit(f"{key} is not a list"))
    )


def clean_control(stored: Column) -> Column:
    """Control characters to blanks."""
    return F.regexp_replace(stored, r"[\x00-\x1f\x7f-\x9f]", " ")


def _requoted(text: Column) -> Column:
    """A literal in single quotes as JSON. Quotes that delimit stand next to a bracket, colon
    or comma; a quote between two letters belongs to the string, and so does what a string
    in double quotes holds."""
    edge = r"(?<=[\[{:,])([ ]*)'|'(?=[ ]*[\]}:,])"
    marked = F.regexp_replace(text, edge, "$1\u0001")
    marked = F.replace(F.replace(marked, F.lit('"'), F.lit('\\"')), F.lit("\u0001"), F.lit('"'))
    # strings that were in double quotes already keep them
    return F.regexp_replace(marked, r"(?<=[\[{:,])([ ]*)\\\"|\\\"(?=[ ]*[\]}:,])", '$1"')


def repair_json(stored: Column) -> Column:
    """Stored JSON text that reads as one value, NULL if no attempt does. Attempts:
    without control characters; then as a literal with single quotes."""
    cleaned = clean_control(stored)
    requoted = _requoted(cleaned)
    for word, wanted in (("None", "null"), ("True", "true"), ("False", "false")):
        requoted = F.regexp_replace(requoted, rf"([:\[,] ?){word}(?= ?[,\]}}])", f"$1{wanted}")
    return F.when(is_json(cleaned), cleaned).when(is_json(requoted), requoted)


def salvage_items(stored: Column) -> Column:
    """The pii_items list cut out of text that is not JSON as a whole. The cut ends
    at the first closing bracket, so a value holding one makes the salvage fail."""
    body = F.regexp_extract(stored, r'(?s)"pii_items"[ \t\r\n]*:[ \t\r\n]*\[(.*?)\]', 1)
    found = F.regexp_like(stored, F.lit(r'(?s)"pii_items"[ \t\r\n]*:[ \t\r\n]*\[.*?\]'))
    text = F.concat(F.lit("["), body, F.lit("]"))
    return F.when(found & is_json(text), F.from_json(text, f"array<{ddl(PII_ITEM)}>"))

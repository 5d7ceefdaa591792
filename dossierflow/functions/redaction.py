"""Masking of entities, replacement strategies and text rewriting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dossierflow.schemas import MASKED_ENTITY_TYPES, REDACTED


def mask_entities(entities: Column) -> Column:
    """Names and e-mail addresses lose their value and gain ``masked = true``; other
    entities keep theirs, with ``masked`` NULL."""

    def one(e: Column) -> Column:
        hide = F.coalesce(e["type"].isin(MASKED_ENTITY_TYPES), F.lit(False))
        return F.struct(
            e["type"].alias("type"),
            F.when(hide, F.lit(REDACTED)).otherwise(e["value"]).alias("value"),
            e["confidence"].alias("confidence"),
            F.when(hide, F.lit(True)).alias("masked"),
        )

    return F.transform(entities, one)


def _mask_tail(v: str) -> str:
    """Letters and digits before the last four characters become '*'; short values
    are hidden in full."""
    starred = f"regexp_replace(left({v}, greatest(length({v}) - 4, 0)), '[A-Za-z0-9]', '*')"
    return (
        f"CASE WHEN length({v}) > 4 THEN concat({starred}, right({v}, 4)) "
        f"ELSE regexp_replace({v}, '[A-Za-z0-9]', '*') END"
    )


def _generalize(pii_type: str, v: str) -> str:
    """A coarser value: year of a date, order of magnitude of an amount, last part of
    an address."""
    if pii_type == "date_of_birth":
        return f"coalesce(nullif(regexp_extract({v}, '[0-9]{{4}}', 0), ''), '{REDACTED}')"
    if pii_type in ("salary_income", "financial_account_details"):
        digits = f"length(regexp_replace(regexp_extract({v}, '[0-9][0-9,]*', 0), ',', ''))"
        return f"CASE WHEN {digits} > 0 THEN concat('$', rpad('1', {digits}, '0'), '+') ELSE '{REDACTED}' END"
    if pii_type == "address":
        return f"CASE WHEN contains({v}, ',') THEN trim(element_at(split({v}, ','), -1)) ELSE '{REDACTED}' END"
    return f"'{REDACTED}'"


def replacement_sql(pii_type: str, strategy: str, value: str) -> str:
    """SQL of what replaces ``value`` (itself SQL) under a strategy."""
    if strategy == "MASK":
        return _mask_tail(value)
    if strategy == "GENERALIZE":
        return _generalize(pii_type, value)
    return f"'{REDACTED}'"


_WORD = r"[\p{L}\p{N}]"
_SPAN = "struct<start:int,size:int,replacement:string>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _whole(text: Column, value: Column, at: Column) -> Column:
    """Whether ``value`` stands at ``at`` (from 1) without cutting a word."""
    before = F.left(value, F.lit(1)).rlike(_WORD) & (at > 1) & F.substring(text, at - 1, F.lit(1)).rlike(_WORD)
    after = F.right(value, F.lit(1)).rlike(_WORD) & F.substring(text, at + F.length(value), F.lit(1)).rlike(_WORD)
    return ~before & ~after


def _in_front(value: Column) -> Column:
    """Pattern that matches nothing, in front of each whole ``value``."""
    body = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    before = F.when(F.left(value, F.lit(1)).rlike(_WORD), F.lit(f"(?<!{_WORD})")).otherwise(F.lit(""))
    after = F.when(F.right(value, F.lit(1)).rlike(_WORD), F.lit(f"(?!{_WORD})")).otherwise(F.lit(""))
    return F.concat(before, F.lit("(?="), body, after, F.lit(")"))


def _span(at: Column, item: Column) -> Column:
    return F.struct(
        at.alias("start"), (-F.length(item["value"])).alias("size"), item["replacement"].alias("replacement")
    )


def value_spans(text: Column, items: Column) -> Column:
    """Where the values of ``items`` stand in ``text``: structs (start from 1, negative size,
    replacement) in the order of start, the longest first.

    Each distinct value is searched as plain bytes. Only one that stands in several places is
    searched by a pattern, which finds places that overlap as well.
    """
    none = F.array().cast(f"array<{_SPAN}>")
    usable = F.filter(items, lambda i: (F.length(i["value"]) > 0) & i["replacement"].isNotNull())
    values = F.array_distinct(
        F.transform(usable, lambda i: F.struct(i["value"].alias("value"), i["replacement"].alias("replacement")))
    )

    def often(v: Column) -> Column:
        # a character in front, as a split drops a first piece that is empty
        pieces = F.split(F.concat(F.lit("\0"), text), _in_front(v["value"]), F.lit(-1))

        def spans(sizes: Column) -> Column:
            start = lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, n: a + n)
            found = F.transform(F.sequence(F.lit(1), F.size(sizes) - 1), lambda k: _span(start(k), v))
            return F.when(F.size(sizes) > 1, found).otherwise(none)

        return _let(F.transform(pieces, F.length), spans)

    def each(v: Column) -> Column:
        def from_first(at: Column) -> Column:
            once = F.when(_whole(text, v["value"], at), F.array(_span(at, v))).otherwise(none)
            alone = F.call_function("locate", v["value"], text, at + 1) == 0
            return F.when(at == 0, none).when(alone, once).otherwise(often(v))

        return _let(F.call_function("locate", v["value"], text), from_first)

    return F.array_sort(F.flatten(F.transform(values, each)))


def settled_spans(spans: Column) -> Column:
    """Of sorted spans those that a reader from the left replaces: none overlaps one before it."""
    start = F.struct(F.lit(1).alias("stop"), F.array().cast(f"array<{_SPAN}>").alias("kept"))

    def step(state: Column, s: Column) -> Column:
        further = F.struct(
            (s["start"] - s["size"]).alias("stop"), F.array_append(state["kept"], s).alias("kept")
        )
        return F.when(s["start"] < state["stop"], state).otherwise(further)

    return F.aggregate(spans, start, step, lambda state: state["kept"])


def rewritten(text: Column, spans: Column) -> Column:
    """``text`` with each of the settled ``spans`` replaced."""
    stop = lambda s: s["start"] - s["size"]

    def part(s: Column, k: Column) -> Column:
        begin = F.when(k == 0, F.lit(1)).otherwise(stop(F.get(spans, k - 1)))
        return F.concat(_let(begin, lambda b: F.substring(text, b, s["start"] - b)), s["replacement"])

    rest = F.call_function("substring", text, stop(F.element_at(spans, -1)))
    changed = F.concat(F.array_join(F.transform(spans, part), ""), rest)
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, changed).otherwise(text)


def apply_replacements(text: Column, items: Column) -> Column:
    """Text with every whole occurrence of an item's value replaced.

    Places are found and settled as positions before the text is put together once, so what
    was replaced is not read again. Where values overlap the first and longest wins; a value
    with several replacements gets the first of them in alphabetical order.
    """
    row = F.struct(text.alias("text"), items.alias("items"))
    return _let(row, lambda r: _let(
        settled_spans(value_spans(r["text"], r["items"])), lambda spans: rewritten(r["text"], spans)
    ))

"""Stage 4: typed entities by rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.operators.rules import ENTITY_RULES, Rule, entities_of


def with_entities(df: DataFrame, rules: Iterable[Rule] = ENTITY_RULES, text: str = "text", out: str = "entities") -> DataFrame:
    """Adds array<struct<type, value, confidence>>: one pass over each text for all rules."""
    return df.withColumn(out, entities_of(text, rules))


def rules_for(rules: Iterable[Rule], *types: str) -> tuple[Rule, ...]:
    return tuple(r for r in rules if r.type in types)


def item_count(items: Column) -> Column:
    """Number of items, 0 for a missing list."""
    return F.when(items.isNull(), F.lit(0)).otherwise(F.size(items))


def first_items(items: Column, n: int = 5) -> Column:
    """The items a trace keeps."""
    return F.slice(items, 1, n)


def item_rows(df: DataFrame, items: Column, key: str = "doc_id") -> DataFrame:
    """One row (key, pos, i) per item. An inner posexplode would be given a filter on the list's size,
    which makes Spark compute the list twice; so missing lists get a row that is dropped."""
    return df.select(key, F.posexplode_outer(items).alias("pos", "i")).filter("pos IS NOT NULL")


def entities_long(df: DataFrame, key: str = "doc_id", entities: str = "entities") -> DataFrame:
    """One row per entity; documents without entities keep one row of NULLs."""
    return df.select(key, F.posexplode_outer(entities).alias("pos", "entity")).select(
        key, "pos", "entity.type", "entity.value", "entity.confidence"
    )

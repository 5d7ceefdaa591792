"""Stage 5: personal data, masked entities, rewritten text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from dossierflow.functions.redaction import apply_replacements
from dossierflow.operators.rules import PII_RULES, PiiRule, pii_items_of


def with_pii_items(df: DataFrame, rules: Iterable[PiiRule] = PII_RULES, text: str = "text", out: str = "pii_items") -> DataFrame:
    """Adds array<struct<type, value, strategy, replacement>>."""
    return df.withColumn(out, pii_items_of(text, rules))


def with_safe_text(df: DataFrame, text: str = "text", items: str = "pii_items", out: str = "safe_text") -> DataFrame:
    """Adds the text with every detected value replaced (an extra: results keep the raw text)."""
    return df.withColumn(out, apply_replacements(F.col(text), F.col(items)))

"""Parser payloads stored as a variant with typed columns split off.

What the stages read of a payload (texts of its elements, the parser's error) is taken out of the
variant once, when the payload is written, into columns of their own types; the variant itself is
kept beside them for everything else. A reader of the typed columns scans only these: no JSON is
parsed again and the variant is not read. Payloads that are not JSON have a NULL variant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierflow.functions.text import PAGE_BREAK
from dossierflow.operators.parse import parse_reason, parsed_elements, parsed_error

#: typed columns and what of a variant they hold
TYPED: dict[str, Callable[[Column], Column]] = {"elements": parsed_elements, "error_status": parsed_error}
VARIANT = "document"


def shredded(df: DataFrame, payload: str = "payload", typed: dict[str, Callable[[Column], Column]] = TYPED) -> DataFrame:
    """``df`` with its JSON text ``payload`` replaced by the variant and its typed columns."""
    parsed = df.withColumn(VARIANT, F.try_parse_json(payload)).drop(payload)
    return parsed.withColumns({name: of(F.col(VARIANT)) for name, of in typed.items()} | {"is_json": F.col(VARIANT).isNotNull()})


def write(df: DataFrame, folder: str, payload: str = "payload") -> None:
    """Add payloads to the table in ``folder``."""
    shredded(df, payload).write.mode("append").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def parse_shredded(rows: DataFrame) -> DataFrame:
    """Adds ``document_text`` and ``parse_error`` as ``parse_payloads`` does, from the typed columns alone."""
    text = F.concat_ws(PAGE_BREAK, "elements")
    reason = parse_reason(F.col("is_json"), F.col("error_status"), text)
    return rows.withColumn("parse_error", reason).withColumn("document_text", F.when(F.col("parse_error").isNull(), text))


def at_path(rows: DataFrame, path: str, data_type: str, out: str) -> DataFrame:
    """Adds what stands at any other path, read from the variant."""
    return rows.withColumn(out, F.try_variant_get(F.col(VARIANT), path, data_type))

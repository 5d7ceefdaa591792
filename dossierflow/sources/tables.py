"""Creating, appending to and reading the status log, status and results tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from dossierflow.plans.status import fold
from dossierflow.schemas import RESULTS_SCHEMA, STATUS_EVENT_SCHEMA, STATUS_SCHEMA

SCHEMAS = {"status": STATUS_SCHEMA, "results": RESULTS_SCHEMA, "status_events": STATUS_EVENT_SCHEMA}


def columns_ddl(schema: T.StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


def ensure_table(spark: SparkSession, name: str, kind: str, location: str | None = None) -> None:
    """Create schema and table if they are missing; ``kind`` picks the declared schema."""
    if "." in name:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name.rsplit('.', 1)[0]}")
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns_ddl(SCHEMAS[kind])}) USING parquet{where}")


def append(rows: DataFrame, name: str, kind: str) -> None:
    """Append rows in the declared column order."""
    schema = SCHEMAS[kind]
    rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("append").insertInto(name)


def current_status(spark: SparkSession, events_table: str) -> DataFrame:
    """Status per file from its update log."""
    return fold(spark.table(events_table))

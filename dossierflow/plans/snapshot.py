"""Status as a bucketed snapshot that new events are merged into.

A snapshot has one row for each file and, for each status column, the entry that counts: its
value with the time and number of the event that set it. Two snapshots of the same files
therefore merge column by column, in any order, and events that arrive late lose against later
ones as they do when a whole log is folded.

The table is bucketed and sorted by file_id. A merge reads it where it lies: only the new
events, folded to one row a file in each task, move to its buckets. Look-ups read one bucket,
lists of newest files and counts read no log at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierflow.schemas import STATUS_SCHEMA

BUCKETS = 64
#: status columns that events set
NAMES = [f.name for f in STATUS_SCHEMA.fields if f.name not in ("file_id", "updated_at")]
_ENTRY = "struct<event_time:timestamp,seq:bigint,value:string>"


def entries(events: DataFrame) -> DataFrame:
    """file_id, one entry for each status column (null: never set) and updated_at."""

    def latest(name: str) -> Column:
        return F.expr(
            f"max(struct(event_time, seq, changes['{name}'] AS value)) FILTER (WHERE map_contains_key(changes, '{name}'))"
        ).cast(_ENTRY).alias(name)

    return (
        events.filter(F.size("changes") > 0).groupBy("file_id")
        .agg(*[latest(n) for n in NAMES], F.max("event_time").alias("updated_at"))
    )


def merged(snapshot: DataFrame, events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The snapshot with new events merged in; its own rows stay in their buckets."""
    new = entries(events).repartition(buckets, "file_id")
    old, new = snapshot.alias("old"), new.alias("new")

    def later(name: str) -> Column:
        # greatest() skips nulls; entries are ordered by time, then by number
        return F.greatest(F.col(f"old.{name}"), F.col(f"new.{name}")).alias(name)

    joined = old.join(new.hint("merge"), F.col("old.file_id") == F.col("new.file_id"), "full_outer")
    return joined.select(
        F.coalesce("old.file_id", "new.file_id").alias("file_id"), *[later(n) for n in [*NAMES, "updated_at"]]
    )


def status_of(snapshot: DataFrame) -> DataFrame:
    """One status row for each file of a snapshot."""
    values = {f.name: F.col(f"{f.name}.value").try_cast(f.dataType) for f in STATUS_SCHEMA.fields if f.name in NAMES}
    return snapshot.select(*[values.get(f.name, F.col(f.name)).alias(f.name) for f in STATUS_SCHEMA.fields])


class SnapshotTable:
    """A snapshot kept as a table. Each merge writes the next version beside the current one and
    then names it current, so a merge that fails leaves the table as it was and can be run again."""

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = BUCKETS):
        self.spark, self.name, self.folder, self.buckets = spark, name, folder.rstrip("/"), buckets

    def _table(self, version: int) -> str:
        return f"{self.name}_v{version}"

    def version(self) -> int:
        """Number of the current version, 0 before the first merge."""
        done = self.spark.catalog.listTables(pattern=f"{self.name}_current_v*")
        return max((int(t.name.rsplit("_v", 1)[1]) for t in done), default=0)

    def read(self) -> DataFrame:
        version = self.version()
        if not version:
            columns = ", ".join(f"{n} {_ENTRY}" for n in NAMES)
            return self.spark.createDataFrame([], f"file_id string, {columns}, updated_at timestamp")
        return self.spark.table(self._table(version))

    def merge(self, events: DataFrame) -> int:
        """Merge events of a log (file_id, event_time, seq, changes); gives the new version's number."""
        version = self.version()
        rows = merged(self.read(), events, self.buckets) if version else entries(events).repartition(self.buckets, "file_id")
        table = self._table(version + 1)
        # what a merge that failed half-way has left
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        (
            rows.write.bucketBy(self.buckets, "file_id").sortBy("file_id").format("parquet")
            .mode("overwrite").option("path", f"{self.folder}/v{version + 1}").saveAsTable(table)
        )
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name}_current_v{version + 1} AS SELECT * FROM {table}")
        if version:
            self.spark.sql(f"DROP VIEW IF EXISTS {self.name}_current_v{version}")
        return version + 1

    def status(self) -> DataFrame:
        return status_of(self.read())

"""Documents processed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dossierflow.plans.runs import run_stages
from dossierflow.settings import Settings
from dossierflow.sources.files import BINARY_SCHEMA, _named


def arriving_files(spark: SparkSession, folder: str, glob: str | None = None, max_files: int = 1000,
                   max_age: str = "36500d") -> DataFrame:
    """New files of a folder. The source remembers which file, by path and modification time,
    it has read; late and overwritten files are read like any other, so the newest version
    of a path is the one of its latest ``modificationTime``. The source would ignore files that
    are older than the newest one by ``max_age``: copied files are, so by default none is."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("maxFilesPerTrigger", max_files)
    reader = reader.option("maxFileAge", max_age)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _named(reader.load(folder)).withColumn("file_id", F.sha2("path", 256))


def write_once(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch to its own ``batch_id`` folder, overwriting it: a batch
    that is replayed after a failure replaces itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def process_arrivals(files: DataFrame, settings: Settings, folder: str, checkpoint: str,
                     available_now: bool = True) -> StreamingQuery:
    """The same stages as a batch run, over a stream of (file_id, filename, content)."""
    return write_once(run_stages(files, settings), folder, checkpoint, available_now)

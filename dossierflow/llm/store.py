"""Written tables between the jobs of one operator.

``keep`` cuts lineage: the rows are written once to the shared folder that the session
names in ``spark.checkpoint.dir`` and read back, so that a lost executor costs a reread
and later jobs see the same rows, row ids and partition numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossierflow.sources.folders import work_folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh shared folder and return what was written."""
    spark: SparkSession = df.sparkSession
    path = work_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

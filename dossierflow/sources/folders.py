"""Shared work folders for written tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared checkpoint folder. Only a local-mode
    session without that setting falls back to a temporary folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="dossierflow-")
    return f"{base.rstrip('/')}/dossierflow/{name}-{uuid.uuid4().hex}"

"""A folder for managed tables of a session that names none: beside the shared checkpoints, local only where those are unset."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane_"))
        at = spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/corvane_store/{uuid.uuid4().hex}"

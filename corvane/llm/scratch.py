"""Tables written on the way: in the shared folder that the session names, never on one machine's disk."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and the master is local (tests on one machine) a new one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane_"))
            held = spark.sparkContext.getCheckpointDir()
        at = held
    return at.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    out = f"{root(spark)}/corvane/{uuid.uuid4().hex}/{name}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(out)
    return out


def keep(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written once as Parquet in the shared folder and read back, which cuts its lineage there."""
    spark, at = df.sparkSession, path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Deletes this application's tables; call it once their results are written elsewhere."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for at in _made.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(conf).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable for the Python workers, wherever they start (once per application)."""
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    out = os.path.join(tempfile.mkdtemp(prefix="corvane_zip_"), "corvane_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(out)
    sc._corvane_shipped = True

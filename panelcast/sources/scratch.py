"""A folder that all executors share, for staged tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; on a local master under a temporary folder where it is unset."""
    app, d = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="panelcast-"))
    return f"{d.rstrip('/')}/panelcast-{app}-panels"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder."""
    return f"{_root(spark)}/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, where several branches would compute it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has staged: once its results are read or written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

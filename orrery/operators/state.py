"""Writes a state of an iteration into the folder that the cluster shares, and reads it again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only on one machine, as in tests, is one set where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if path is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/orrery-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str = "state", path: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: a cut in the lineage that survives lost executors."""
    path = path or fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.orrery_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialized frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.orrery_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

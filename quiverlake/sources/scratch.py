"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _remove(spark: SparkSession, path: str) -> None:
    """Takes the application's tables away when the driver ends; where Spark has gone before, they stay."""
    from .files import remove

    if spark.sparkContext._jsc is not None:
        remove(spark, path)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, gone when the driver ends. Where that is unset, one on this machine in local mode, as in tests; on a cluster an error."""
    own = getattr(spark.sparkContext, "_quiver_scratch", None)
    if own is None:
        top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not top:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="quiver-")
        own = spark.sparkContext._quiver_scratch = f"{top.rstrip('/')}/quiver-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str = "part") -> DataFrame:
    """df, written there and read again: lineage ends there, and a lost executor costs nothing that is done."""
    path = f"{shared_dir(df.sparkSession)}/{tag}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""The folder that the driver and all executors share, and tables that are written there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; a temporary one only in local mode, where it is set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rillstone-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rillstone-{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again; ``by``: a column whose values get a folder each."""
    path = fresh_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Tables and files between jobs, in the folder that a cluster's executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str = "stream") -> str:
    """A new folder where the cluster's spark.checkpoint.dir is; a local run without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
    return f"{base or tempfile.mkdtemp(prefix=f'spark-{name}-')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df written as a Parquet table there, in a folder for each value of `by`, and read back: computed once, whatever
    executors are lost later."""
    path = shared_folder(df.sparkSession, "table")
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

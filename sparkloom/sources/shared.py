"""Tables that later plans read again: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session without that setting uses its warehouse folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/sparkloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own, so that its lineage ends there and lost executors cost no earlier work."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it that uri names: a mounted path, HDFS or an object store; s3a and s3n are names of s3."""
    store, path = pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))
    return store, path.rstrip("/") or "/"

"""Cutting lineage in loops: tables in the shared folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset and there is no cluster, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spliceframe-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df computed once, as a table of the shared folder that goes when the session ends.

    Unlike checkpoint(), which computes twice and keeps the size that was estimated for the whole plan (in a loop of joins
    the product of all earlier rounds' sizes), what is read back has the size of its files.
    That is far below its size in memory, so joins with it are merge joins unless the caller broadcasts it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return merged(spark.read.schema(df.schema).parquet(path))


def merged(df: DataFrame) -> DataFrame:
    """df, which joins won't broadcast on Spark's estimate of its size: that is the size of compressed files, and doesn't
    grow where rows are exploded. A table of hundreds of MB then passes for one of less than 10, and goes to the driver."""
    return df.hint("merge")

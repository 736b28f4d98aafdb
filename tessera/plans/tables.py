"""Cutting the lineage of what an iterative plan reads again and again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Only where driver and executors are one machine may it be a temporary one (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def settled(df: DataFrame) -> DataFrame:
    """df as files in the shared folder: later jobs read those, also after executors are lost. (A checkpoint computes it twice.)"""
    path = f"{checkpoint_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def drop_settled(df: DataFrame) -> None:
    """Removes the files of a settled table that nothing will read again."""
    spark, where = df.sparkSession, getattr(df, "_settled", None)
    if where is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""What the operators of this package share: table access, tables in the shared folder, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where they are one machine may it be a temporary one (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes the files of a table that nothing will read again."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.Table | None], schema, most: int = 2000) -> DataFrame:
    """f on slices of at most ``most`` rows, so that a worker holds few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                out = f(batch.slice(at, most))
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out.to_batches()

    return df.mapInArrow(run, schema)


SMALL_SHARE = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes from fewer files than there are cores and has less than SMALL_SHARE bytes for each.

    Only then can a file of one row group leave cores idle, and only then does it cost little to deal its rows out anew.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > cores * SMALL_SHARE:
        return df  # before its files are listed
    if not 0 < len(df.inputFiles()) < cores:
        return df
    return df.repartition(cores)


def gathered(df: DataFrame) -> DataFrame:
    """df in two tasks for each core at most, if it has less than SMALL_SHARE bytes for each core: rows in many small files
    would else be as many tasks, each with a file and processes of its own. Nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > cores * SMALL_SHARE:
        return df
    return df.coalesce(2 * cores)


def replace_rows(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], most: int = 500) -> DataFrame:
    """f on slices of all columns; it gives rows with the same columns."""
    return map_arrow(df, f, df.schema, most)


def remainder(column: str, by: int):
    """crc32 of the id written as text, modulo ``by``: the folds of the labelled rows."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(by))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, out_fold: int, most: int, most_chars: int) -> list[tuple[str | None, int]]:
    """At most ``most`` labelled rows outside the held-out fold, by the order of a hash, and of these in the same order no more
    than have ``most_chars`` characters together; the ids, so bounded, are broadcast.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != out_fold))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # An id with several rows still gives one.
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    out, left = [], most_chars
    for x in got.where("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "y").toLocalIterator():
        left -= len(x.text)
        if left < 0:
            break
        out.append((x.text, x.y))
    return sorted(out)

"""A corpus that grows: new files of notes are quantized, and their words added to the counts, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.quantize import Grid
from ..operators import corpus
from ..operators.notes import notes


def count_words(spark: SparkSession, source: str, schema: str, vocab: DataFrame, out: str, checkpoint: str, grid: Grid = Grid()) -> StreamingQuery:  # noqa: B008
    """Raw notes that arrive as Parquet in ``source`` -> counts of their words in ``out``, a folder for each batch.

    A file's notes arrive together. Batches are written under their number, so one that is run again after a failure
    replaces itself: counts are exact. Files with a token that the dictionary hasn't are left out.
    """

    def add(batch: DataFrame, number: int) -> None:
        words = corpus.words_of(corpus.known(corpus.with_indices(notes(batch, grid), vocab)))
        corpus.counted(words).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("word").agg(F.sum("n").alias("n"))


def note_rate(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Notes and distinct files a window of event time, from a stream or a table with ``ts``; rows later than ``late`` are dropped by a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if events.isStreaming else timed
    return marked.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n_notes"), F.approx_count_distinct("user_id").alias("n_files")).select(F.col("w.start").alias("start"), "n_notes", "n_files")

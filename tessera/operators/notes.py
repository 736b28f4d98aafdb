"""From raw notes to quantized, chunked notes, and to tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import quantize as Q
from ..functions.quantize import CATEGORIES, FIELDS, Grid


def quantize(raw: DataFrame, grid: Grid) -> DataFrame:
    """(file_id, ord, t, d, p, i, v)."""
    return raw.select(
        "file_id",
        "ord",
        Q.onset_steps(F.col("start_sec"), grid).alias("t"),
        Q.duration_steps(F.col("end_sec") - F.col("start_sec"), grid).alias("d"),
        F.col("pitch").alias("p"),
        Q.instrument(F.col("program"), F.col("is_drum")).alias("i"),
        Q.velocity_bin(F.col("velocity"), grid).alias("v"),
    )


def chunked(q: DataFrame, grid: Grid) -> DataFrame:
    """(file_id, chunk_idx, pos, ord, t, d, p, i, v): 100-second chunks that begin at 0; empty ones have no index.

    All windows are over one file, so they share one shuffle by it.
    """
    steps = F.lit(grid.chunk_steps)
    file = Window.partitionBy("file_id")
    in_chunk = Window.partitionBy("file_id", "raw_chunk")
    out = q.withColumn("raw_chunk", F.floor(F.col("t") / steps)).select(
        "file_id",
        (F.dense_rank().over(file.orderBy("raw_chunk")) - 1).cast("long").alias("chunk_idx"),
        (F.row_number().over(in_chunk.orderBy("t", "p", "i", "ord")) - 1).cast("long").alias("pos"),
        "ord",
        (F.col("t") - F.min("t").over(in_chunk)).alias("t"),
        "d",
        "p",
        "i",
        "v",
    )
    return out


def notes(raw: DataFrame, grid: Grid = Grid()) -> DataFrame:  # noqa: B008
    return chunked(quantize(raw, grid), grid)


def token_columns() -> list:
    """The five tokens of a note, one column each, named by field."""
    return [Q.token(c, F.col(f)).alias(f"{f}_token") for c, f in zip(CATEGORIES, FIELDS, strict=True)]


def tokens(n: DataFrame) -> DataFrame:
    """(token, category) of every field of every note."""
    pairs = F.array(*[F.struct(Q.token(c, F.col(f)).alias("token"), F.lit(c).alias("category")) for c, f in zip(CATEGORIES, FIELDS, strict=True)])
    return n.select(F.inline(pairs))


def inverse(n: DataFrame, grid: Grid) -> DataFrame:
    """Notes in seconds again: start, end, pitch and velocity in their ranges, program and drums apart."""
    return n.select(
        "file_id",
        "chunk_idx",
        "pos",
        (F.col("t") * F.lit(grid.onset_ms / 1000.0)).alias("start_sec"),
        (F.col("t") * F.lit(grid.onset_ms / 1000.0) + F.col("d") * F.lit(grid.dur_ms / 1000.0)).alias("end_sec"),
        F.greatest(F.lit(0).cast("long"), F.least(F.lit(127).cast("long"), F.col("p"))).alias("pitch"),
        F.when(F.col("i") == Q.DRUMS, 0).otherwise(F.least(F.col("i"), F.lit(127).cast("long"))).cast("long").alias("program"),
        (F.col("i") == Q.DRUMS).alias("is_drum"),
        Q.velocity_of(F.col("v"), grid).alias("velocity"),
    )


def trimmed(raw: DataFrame, most_sec: float) -> DataFrame:
    """Notes that begin before most_sec, ended there at the latest."""
    return raw.where(F.col("start_sec") < most_sec).withColumn("end_sec", F.least("end_sec", F.lit(most_sec)))

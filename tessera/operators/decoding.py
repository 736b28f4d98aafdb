"""From encoded words back to notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantize import CATEGORIES, FIELDS, value_of
from .merges import encoded, symbols, unmerged


def notes_of(words: DataFrame, vocab: DataFrame, merges: list[tuple[str, str, str]]) -> DataFrame:
    """(file_id, chunk_idx, pos, t, d, p, i, v) of encoded words. Words of other than five symbols, or with a symbol that the
    dictionary doesn't have or that isn't of the place's category, are no notes and left out.

    Each place is looked up by itself, so no row is exploded and grouped again.
    """
    out = unmerged(words, merges).withColumn("s", symbols(F.col("base"))).where(F.size("s") == 5)
    for k, (c, f) in enumerate(zip(CATEGORIES, FIELDS, strict=True)):
        side = vocab.where(F.col("category") == c).select(F.lpad(F.col("idx").cast("string"), 6, "0").alias("_sym"), value_of(F.col("token")).alias(f))
        out = out.join(F.broadcast(side), F.col("s")[k] == F.col("_sym")).drop("_sym")
    return out.select("file_id", "chunk_idx", "pos", *FIELDS)


def encoded_notes(words: DataFrame, merges: list[tuple[str, str, str]]) -> DataFrame:
    """words with ``enc``. Each note is encoded: for a corpus of few distinct words, encode those and join."""
    return encoded(words, merges)

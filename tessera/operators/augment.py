"""Augmented corpora: files in several passes, each with its own choice of controls, as sequences and as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantize import Grid
from .anticipation import CHUNK, RATES, by_own_spans, draw, drawn, modes, sampled_spans, sequence
from .corpus import INDICES, private_character_of, with_indices

PASS = (*CHUNK, "k")


def epoch(files: DataFrame, share: float, number: int = 0) -> DataFrame:
    """(file_id, k) for one epoch: with probability ``share`` a pass from 1 to 9, else 0, which has no controls."""
    f, e = F.col("file_id"), F.lit(number)
    taken = draw(10_000, f, e, salt=11) < round(share * 10_000)
    return files.select("file_id").distinct().withColumn("k", F.when(taken, 1 + draw(9, f, e, salt=12)).otherwise(F.lit(0).cast("long")))


def all_passes(files: DataFrame, passes: int) -> DataFrame:
    """(file_id, k): every file in every pass."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(passes - 1).cast("long")))
    return files.select("file_id").distinct().withColumn("k", each)


def controls(n: DataFrame, tasks: DataFrame, grid: Grid) -> DataFrame:
    """Notes of each task (file_id, k) with ``k`` and ``is_control``, by the mode that each chunk has in that pass.

    The modes are drawn for each chunk, from the instruments of its own. All is keyed by file, so one shuffle serves.
    """
    each = n.join(tasks, "file_id")
    instruments = each.groupBy(*PASS).agg(F.array_sort(F.collect_set("i")).alias("all"))
    chosen = modes(instruments, CHUNK)
    spans = sampled_spans(each.join(chosen.where("mode = 'span'").select(*PASS), list(PASS)), grid, uniform=drawn(*PASS, salt=13), by=PASS)
    out = by_own_spans(each, spans, PASS).withColumnRenamed("is_control", "in_span").join(chosen, list(PASS))
    random = draw(10_000, F.col("file_id"), F.col("ord"), F.col("k"), salt=14) < F.col("rate") * (10_000 // RATES)
    own = F.array_contains(F.split("subset", ","), F.col("i").cast("string"))
    test = F.when(F.col("mode") == "random", random).when(F.col("mode") == "instrument", own).when(F.col("mode") == "span", F.col("in_span")).otherwise(F.lit(False))
    return out.withColumn("is_control", test).drop("in_span", "mode", "rate", "subset")


def augmented(n: DataFrame, tasks: DataFrame, grid: Grid = Grid()) -> DataFrame:  # noqa: B008
    """(file_id, chunk_idx, k, seq, kind, t, d, p, i, v): the sequence of each chunk in each of its passes."""
    return sequence(controls(n, tasks, grid), grid, PASS)


def sequence_lines(seq: DataFrame, vocab: DataFrame) -> DataFrame:
    """(file_id, chunk_idx, k, text): a word for each slot, rests and separators by name, controls by characters of their own.

    A chunk with a token that the dictionary hasn't has no line.
    """
    size = vocab.agg(F.count("*").alias("b"))  # one row
    indexed = with_indices(seq, vocab).join(F.broadcast(size))
    is_note = F.col("kind").isin("EVENT", "CONTROL")
    shift = F.when(F.col("kind") == "CONTROL", F.col("b")).otherwise(0)
    word: Column = F.when(is_note, F.concat(*[private_character_of(F.col(c) + shift) for c in INDICES])).otherwise(F.concat(F.lit("["), F.col("kind"), F.lit("]")))
    each = indexed.select(*PASS, "seq", word.alias("word"))
    whole = each.groupBy(*PASS).agg(F.count_if(F.col("word").isNull()).alias("unknown"), F.array_sort(F.collect_list(F.struct("seq", "word"))).alias("x"))
    return whole.where("unknown = 0").select(*PASS, F.array_join(F.transform("x", lambda s: s["word"]), " ").alias("text"))


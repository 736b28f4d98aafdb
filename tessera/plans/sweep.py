"""Compression over grids of quantization, each factor's coarser grids derived from its finest one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import quantize as Q
from ..operators.corpus import INDICES, counted_notes, fine_grid, numbered, summed, words_of
from ..operators.merges import evaluate, train
from ..operators.notes import notes
from .tables import settled

# Factor -> (field, values from the finest on).
FACTORS = {"onset": ("t", (1, 2, 5, 10, 20)), "duration": ("d", (1, 2, 5, 10, 20)), "velocity": ("v", (128, 64, 32, 16, 8))}


def by_factor(of) -> Column:
    """of(factor, field, values), an expression, for each factor."""
    out = None
    for factor, (field, values) in FACTORS.items():
        out = (F.when if out is None else out.when)(F.col("factor") == factor, of(factor, field, values))
    return out


def finest_notes(raw: DataFrame) -> DataFrame:
    """(factor, t, d, p, i, v): the notes on each factor's finest grid."""
    parts = [notes(raw, fine_grid(field, values[0])).select(F.lit(factor).alias("factor"), *Q.FIELDS) for factor, (field, values) in FACTORS.items()]
    return reduce(DataFrame.unionByName, parts)


def grid_indices(finest: DataFrame) -> DataFrame:
    """(factor, field, value, of): for each value of a field on the finest grid, its index in the dictionary of each grid.

    Coarser dictionaries are made from the finest one, which is small; the corpus is read for that one only.
    """
    distinct = finest.select("factor", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in Q.FIELDS]))).distinct()

    def tokens(factor: str, field: str, values: tuple[int, ...]) -> Column:
        own = None
        for c, f in zip(Q.CATEGORIES, Q.FIELDS, strict=True):
            grids = [Q.token(c, Q.coarser(f, F.col("value"), values[0], v) if f == field and v != values[0] else F.col("value")) for v in values]
            own = (F.when if own is None else own.when)(F.col("field") == f, F.array(*grids))
        return own

    each = distinct.select("factor", "field", "value", F.posexplode(by_factor(tokens)).alias("grid", "token"))
    places = numbered(each.select("factor", "grid", "token").distinct(), "factor", "grid")
    of = F.transform(F.array_sort(F.collect_list(F.struct("grid", "idx"))), lambda x: x["idx"])
    return each.join(places, ["factor", "grid", "token"]).groupBy("factor", "field", "value").agg(of.alias("of"))


def sweep_words(raw: DataFrame, standalone: bool = False) -> DataFrame:
    """(grp, word, n) with grp = factor|value. A factor's distinct notes on its finest grid are counted first, and coarsened from there.

    Notes that coincide on a coarser grid have the other four fields the same: rows are dealt out by these once for all grids.
    """
    finest = settled(counted_notes(finest_notes(raw), "factor"))
    of = settled(grid_indices(finest))
    return reduce(DataFrame.unionByName, [_words_of_factor(finest, of, factor, standalone) for factor in FACTORS])


def _words_of_factor(finest: DataFrame, of: DataFrame, factor: str, standalone: bool) -> DataFrame:
    field, values = FACTORS[factor]
    others = [f for f in Q.FIELDS if f != field]

    def places(f: str) -> DataFrame:  # bounded by the characters for tokens, which is checked
        return F.broadcast(of.where((F.col("factor") == factor) & (F.col("field") == f)).select(F.col("value").alias(f), F.col("of").alias(f"{f}_of")))

    own = finest.where(F.col("factor") == factor).repartition(*others).join(places(field), field)
    out = own.select(*others, "n", F.posexplode(f"{field}_of").alias("grid", f"{field}_idx")).groupBy(*others, "grid", f"{field}_idx").agg(F.sum("n").alias("n"))
    for f in others:
        out = out.join(places(f), f).withColumn(f"{f}_idx", F.get(f"{f}_of", F.col("grid"))).drop(f"{f}_of")
    names = F.array(*[F.lit(f"{factor}|{v:03d}") for v in values])
    words = words_of(out.select(F.get(names, F.col("grid")).alias("grp"), "n", *INDICES), standalone).select("grp", "word", "n")
    return summed(words, "grp") if standalone else words


def sweep(raw: DataFrame, k: int, standalone: bool = False) -> DataFrame:
    """(factor, sweep_value, merges, original_tokens, bpe_tokens, reduction_ratio, compression_factor): all grids in the same jobs."""
    words = settled(sweep_words(raw, standalone))
    out = evaluate(words, train(words, k), [k])
    name, value = (F.split_part("grp", F.lit("|"), F.lit(j)) for j in (1, 2))
    return out.select(name.alias("factor"), value.cast("long").alias("sweep_value"), "merges", "original_tokens", "bpe_tokens", "reduction_ratio", "compression_factor")


def against(baseline: DataFrame, constrained: DataFrame) -> DataFrame:
    """(factor, sweep_value, baseline, constrained): compression factors of two sweeps side by side, null where one has no such grid."""
    side = lambda df, name: df.where("compression_factor is not null and not isnan(compression_factor)").select("factor", "sweep_value", F.col("compression_factor").alias(name))
    return side(baseline, "baseline").join(side(constrained, "constrained"), ["factor", "sweep_value"], "full")


def leverage(results: DataFrame) -> DataFrame:
    """(factor, leverage, at_finest, at_coarsest). For velocity the finest grid is the largest value."""
    by = F.when(F.col("factor") == "velocity", -F.col("sweep_value")).otherwise(F.col("sweep_value"))
    y = F.col("compression_factor")
    return results.where(y.isNotNull()).groupBy("factor").agg((F.max(y) - F.min(y)).alias("leverage"), F.min_by(y, by).alias("at_finest"), F.max_by(y, by).alias("at_coarsest"))


def knee(results: DataFrame) -> DataFrame:
    """(factor, knee): the value farthest from the line between a factor's ends, the first if several; from three values on."""
    x, y = F.col("sweep_value").cast("double"), F.col("compression_factor")
    w = Window.partitionBy("factor").orderBy("sweep_value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = results.where(y.isNotNull()).select("factor", "sweep_value", x.alias("x"), y.alias("y"), F.first(x).over(w).alias("x0"), F.first(y).over(w).alias("y0"), F.last(x).over(w).alias("x1"), F.last(y).over(w).alias("y1"), F.count("*").over(w).alias("n"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    norm = F.sqrt(dx * dx + dy * dy)
    away = F.abs(dy * (F.col("x") - F.col("x0")) - dx * (F.col("y") - F.col("y0"))) / norm
    found = ends.where((F.col("n") >= 3) & (norm > 0)).withColumn("away", away)
    return found.groupBy("factor").agg(F.max_by("sweep_value", F.struct("away", -F.col("sweep_value"))).alias("knee"))

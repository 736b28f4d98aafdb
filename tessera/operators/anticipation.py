"""Events and controls: which notes become controls, rests in gaps, and both streams in one sequence.

Draws are hashes of keys, so they can be had again; the same arithmetic hash can be written in SQL anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantize import Grid

CHUNK = ("file_id", "chunk_idx")
RATES = 10  # a rate r makes a note a control with probability r / 10
SPAN_RATE = 0.05  # spans begin after gaps of mean 1 / SPAN_RATE steps


def draw(below: int, *keys: Column, salt: int = 0) -> Column:
    """A whole number from 0 to below - 1: a fixed function of the keys."""
    h = F.lit(salt * 7_919 + 12_345).cast("long")
    for k in keys:
        h = F.pmod(h * F.lit(31_337) + k.cast("long") * F.lit(104_729), F.lit(1_000_003).cast("long"))
    return F.pmod(F.pmod(h * F.lit(48_271), F.lit(2_147_483_647).cast("long")), F.lit(below).cast("long"))


def by_rate(n: DataFrame, rate: int, salt: int = 0) -> DataFrame:
    """n with is_control, drawn for each note."""
    return n.withColumn("is_control", draw(10_000, F.col("file_id"), F.col("ord"), salt=salt) < rate * 10_000 // RATES)


def by_instruments(n: DataFrame, instruments: list[int]) -> DataFrame:
    return n.withColumn("is_control", F.col("i").isin(*instruments))


def by_spans(n: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """Onset in any span, both ends included; spans in steps, the same for each chunk."""
    inside = F.lit(False)
    for a, b in spans:
        inside |= F.col("t").between(a, b)
    return n.withColumn("is_control", inside)


def by_own_spans(n: DataFrame, spans: DataFrame, by: tuple[str, ...] = CHUNK) -> DataFrame:
    """Onset in a span of the own chunk: spans are (file_id, chunk_idx, spans array<struct<a,b>>), one row for each chunk."""
    out = n.join(spans, list(by), "left")
    return out.withColumn("is_control", F.coalesce(F.exists("spans", lambda s: F.col("t").between(s["a"], s["b"])), F.lit(False))).drop("spans")


Uniform = Callable[[Column], Column]  # of a note's place, a number between 0 and 1


def hashed(seed: int) -> Uniform:
    return lambda pos: (F.pmod(F.xxhash64(F.lit(seed), F.col("file_id"), F.col("chunk_idx"), pos), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def drawn(*keys: str, salt: int) -> Uniform:
    """By the arithmetic hash, which SQL can write."""
    return lambda pos: (draw(1_000_000, *map(F.col, keys), pos, salt=salt) + F.lit(0.5)) / F.lit(1e6)


def sampled_spans(n: DataFrame, grid: Grid, seed: int = 0, uniform: Uniform | None = None, by: tuple[str, ...] = CHUNK) -> DataFrame:
    """Spans for each chunk: outside, wait a drawn gap; at the first note after it open a span of the lead's length; repeat.

    A fold over the chunk's notes in order. A span that opens stands, whether or not a note ends it. Spans don't overlap and a
    chunk is 20 of them long, so the state stays small.
    """
    lead, uniform = F.lit(grid.lead_steps).cast("long"), uniform or hashed(seed)
    steps = F.aggregate(
        F.array_sort(F.collect_list(F.struct("pos", "t"))),
        F.struct(F.lit(True).alias("inside"), F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("next"), F.array().cast("array<struct<a:long,b:long>>").alias("spans")),
        lambda s, x: _after(s, x, lead, uniform(x["pos"])),
        lambda s: s["spans"],
    )
    return n.groupBy(*by).agg(steps.alias("spans"))


def _after(s: Column, x: Column, lead: Column, u: Column) -> Column:
    gap = F.floor(-F.ln(u) / F.lit(SPAN_RATE))
    closes = s["inside"] & (x["t"] >= s["end"])
    nxt = F.when(closes, x["t"] + gap).otherwise(s["next"])
    opens = (~s["inside"] | closes) & (x["t"] >= nxt)
    return F.struct(
        F.when(opens, True).when(closes, False).otherwise(s["inside"]).alias("inside"),
        F.when(opens, x["t"] + lead).otherwise(s["end"]).alias("end"),
        nxt.alias("next"),
        F.when(opens, F.concat(s["spans"], F.array(F.struct(x["t"].alias("a"), (x["t"] + lead).alias("b"))))).otherwise(s["spans"]).alias("spans"),
    )


NOTE = ["t", "d", "p", "i", "v"]


def padded(n: DataFrame, grid: Grid, by: tuple[str, ...] = CHUNK) -> DataFrame:
    """The events with rests in gaps: (file_id, chunk_idx, time, rest_no, pos, kind, t, d, p, i, v), rests after their event.

    A gap from prev to t has rests at prev + k * density while these stay before t; the last gap ends at the chunk's last
    note, control or not.
    """
    density = grid.rest_steps
    chunk = Window.partitionBy(*by)
    with_end = n.withColumn("end_t", F.max("t").over(chunk)).withColumn("first_event", F.min(F.when(~F.col("is_control"), F.col("pos"))).over(chunk))
    events = with_end.where(~F.col("is_control")).withColumn("nxt", F.lead("t").over(chunk.orderBy("pos")))
    # What stands before the first event of a chunk, or fills a chunk without any, hangs on a start at time 0.
    start = with_end.groupBy(*by).agg(F.max("end_t").alias("end_t"), F.min(F.when(~F.col("is_control"), F.col("t"))).alias("nxt"))
    none = [F.lit(None).cast("long").alias(c) for c in NOTE]
    base = events.select(*by, F.col("t").alias("time"), "pos", F.lit("EVENT").alias("kind"), *NOTE, F.coalesce("nxt", "end_t").alias("until")).unionByName(
        start.select(*by, F.lit(0).cast("long").alias("time"), F.lit(-1).cast("long").alias("pos"), F.lit("START").alias("kind"), *none, F.coalesce("nxt", "end_t").alias("until"))
    )
    rests = F.greatest(F.lit(0).cast("long"), F.floor((F.col("until") - F.col("time") - 1) / density))
    each = base.withColumn("rest_no", F.explode(F.sequence(F.lit(0).cast("long"), rests)))
    is_rest = F.col("rest_no") > 0
    return each.where(is_rest | (F.col("kind") != "START")).select(
        *by, (F.col("time") + F.col("rest_no") * density).alias("time"), "pos", "rest_no", F.when(is_rest, "REST").otherwise(F.col("kind")).alias("kind"), *[F.when(~is_rest, F.col(c)).alias(c) for c in NOTE]
    )


def sequence(n: DataFrame, grid: Grid, by: tuple[str, ...] = CHUNK) -> DataFrame:
    """(file_id, chunk_idx, seq, kind, t, d, p, i, v): a separator, then events and rests with each control put ``lead`` ahead.

    A control with onset c stands before the first slot whose predecessor is at c - lead or later, else behind all. With the
    predecessor's time as a slot's key and c - lead as a control's, that is the least slot number from the control's key on:
    one window over the chunk, a range from the current row on. Keys don't decrease along slots.
    """
    chunk = Window.partitionBy(*by)
    in_order = chunk.orderBy("pos", "rest_no")
    slots = padded(n, grid, by)
    slots = slots.withColumn("slot", F.row_number().over(in_order).cast("long")).withColumn("key", F.coalesce(F.lag("time").over(in_order), F.lit(0).cast("long")))
    controls = n.where("is_control").select(*by, F.lit(None).cast("long").alias("slot"), (F.col("t") - grid.lead_steps).alias("key"), F.lit("CONTROL").alias("kind"), F.col("pos").alias("ordinal"), *NOTE)
    both = slots.select(*by, "slot", "key", "kind", F.lit(0).cast("long").alias("ordinal"), *NOTE).unionByName(controls)
    ahead = F.min("slot").over(chunk.orderBy("key").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    placed = both.withColumn("at", F.when(F.col("kind") == "CONTROL", F.coalesce(ahead, F.lit(2**62))).otherwise(F.col("slot")))
    separators = n.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("at"), F.lit("SEPARATOR").alias("kind"), F.lit(0).cast("long").alias("ordinal"), *[F.lit(None).cast("long").alias(c) for c in NOTE])
    all_ = placed.select(*by, "at", "kind", "ordinal", *NOTE).unionByName(separators)
    number = F.row_number().over(chunk.orderBy("at", F.when(F.col("kind") == "CONTROL", 0).otherwise(1), "ordinal"))
    return all_.select(*by, (number - 1).cast("long").alias("seq"), "kind", *NOTE)


def schedule(n: DataFrame, passes: int = 10, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """(file_id, k, mode, rate, subset): how each file (or chunk, by its keys) is augmented in each pass.

    k % 10: 0 none, 1 spans, 2 to 5 a drawn rate, 6 to 9 a drawn part of its instruments (none, if there is but one).
    """
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(passes - 1).cast("long")))
    return modes(n.groupBy(*by).agg(F.array_sort(F.collect_set("i")).alias("all")).withColumn("k", k), by)


def modes(each: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(keys, k, mode, rate, subset) for rows of (keys, k, all: the instruments)."""
    m, f, k = F.col("k") % 10, [F.col(c) for c in by], F.col("k")
    size = F.size("all")
    mode = F.when(m == 0, "none").when(m == 1, "span").when(m < 6, "random").when(size > 1, "instrument").otherwise("none")
    count = F.when(size > 1, 1 + F.pmod(draw(1_000_000, *f, k, salt=2), (size - 1).cast("long")))
    drawn = F.array_sort(F.transform("all", lambda i: F.struct(draw(1_000_000, *f, k, i, salt=3).alias("h"), i.alias("i"))))
    subset = F.array_join(F.array_sort(F.transform(F.slice(drawn, F.lit(1), F.coalesce(count, F.lit(1)).cast("int")), lambda x: x["i"])), ",")
    return each.select(*by, "k", mode.alias("mode"), F.when(mode == "random", 1 + draw(RATES - 1, *f, k, salt=1)).alias("rate"), F.when(mode == "instrument", subset).alias("subset"))


def gap(u: float) -> int:
    """The drawn gap that sampled_spans uses, for tests."""
    return math.floor(-math.log(u) / SPAN_RATE)

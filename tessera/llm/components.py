"""Connected components of a graph given by its links, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: The least neighbour of each node comes from partial minima and is a table before it is joined: the join then is one of two
#: plain shuffles, of which Spark splits the partition that holds a hub.
LEAST = "least-neighbours"


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours instead."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")), LEAST)
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Here v < u: u and its smaller neighbours are linked to the least of these."""
    least = written(e.groupBy("u").agg(F.min("v").alias("m")), LEAST)
    return e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v): each node of ``links`` (columns a, b) that isn't the least of its component, with that least node."""
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = written(ends.where("u <> v").distinct(), "links")
    state = _digest(e)
    while state[0]:
        large = written(_large_star(e).distinct(), "links")
        star = written(_small_star(large).distinct(), "links")
        drop_written(large)
        drop_written(e)
        e, before, state = star, state, _digest(star)
        if state == before:
            break
    return e

"""Tables seen as notes: (file_id, ord, start_sec, end_sec, pitch, program, is_drum, velocity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The program that stands for each type of event; any other type is a drum.
PROGRAMS = {"click": 0, "purchase": 24, "signup": 40, "view": 56}


def number_at_k(props: Column) -> Column:
    """The number at k. An object of nothing but k and a plain number, as nearly all are, needs no parser of JSON."""
    number = props.substr(F.lit(7), F.length(props) - 7).try_cast("long")
    plain = F.concat(F.lit('{"k": '), number.cast("string"), F.lit("}")) == props
    return F.when(plain, number).otherwise(F.get_json_object(props, "$.k").cast("long"))


def notes_from_events(events: DataFrame) -> DataFrame:
    """A user's events, an hour as a second from the first one on; microseconds are subtracted before they are divided."""
    program = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in PROGRAMS.items()], F.lit(0))
    raw = events.select(  # numbers only from here on, as these rows are dealt out and sorted
        F.col("user_id").alias("file_id"),
        F.col("event_id").alias("ord"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        (F.col("value") / F.lit(50.0)).alias("length"),
        (F.col("event_id") % 128).cast("long").alias("pitch"),
        program.cast("long").alias("program"),
        (~F.col("event_type").isin(*PROGRAMS)).alias("is_drum"),
        (1 + number_at_k(F.col("props")) % 127).alias("velocity"),
    )
    since = F.col("us") - F.min("us").over(Window.partitionBy("file_id"))
    timed = raw.select("*", (since / F.lit(3.6e9)).alias("start_sec"))
    return timed.select("file_id", "ord", "start_sec", (F.col("start_sec") + F.col("length")).alias("end_sec"), "pitch", "program", "is_drum", "velocity")


def notes_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """A supplier's lines, a day as a second."""
    w = Window.partitionBy("l_suppkey")
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    raw = lineitem.select("*", ((us - F.min(us).over(w)) / F.lit(86.4e9)).alias("start_sec"), F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).alias("ord"))
    return raw.select(
        F.col("l_suppkey").alias("file_id"),
        F.col("ord").cast("long").alias("ord"),
        "start_sec",
        (F.col("start_sec") + F.col("l_quantity") / F.lit(10.0)).alias("end_sec"),
        (F.col("l_partkey") % 128).cast("long").alias("pitch"),
        F.col("l_linenumber").cast("long").alias("program"),
        (F.col("l_returnflag") == "R").alias("is_drum"),
        (1 + F.floor("l_extendedprice") % 127).alias("velocity"),
    )


def words_from_text(rows: DataFrame, column: str = "text") -> DataFrame:
    """(word, n): words between ASCII blanks and line ends, counted."""
    w = rows.select(F.explode(F.split(column, r"[ \n\r\t]+")).alias("word")).where("word <> ''")
    return w.groupBy("word").agg(F.count("*").alias("n"))

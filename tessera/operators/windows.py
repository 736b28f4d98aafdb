"""Fixed windows over sequences of ids, and how files are dealt to workers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantize import CATEGORIES, FIELDS
from .anticipation import draw
from .corpus import INDICES, symbol, with_indices
from .merges import count_symbols, encoded, symbols

CHUNK = ("file_id", "chunk_idx")


def id_stream(words: DataFrame) -> DataFrame:
    """(file_id, chunk_idx, at, sym): the symbols of each file's words in order, numbered through the file.

    words: (file_id, chunk_idx, pos, enc). Files are numbered by themselves; a file is a bounded group.
    """
    each = words.select("file_id", "chunk_idx", "pos", F.posexplode(symbols(F.col("enc"))).alias("j", "sym"))
    order = Window.partitionBy("file_id").orderBy("chunk_idx", "pos", "j")
    return each.select("file_id", "chunk_idx", (F.row_number().over(order) - 1).cast("long").alias("at"), "sym")


def packed_windows(stream: DataFrame, size: int, marked: list[str]) -> DataFrame:
    """(file_id, win, n_marked, first_sym, last_sym) of the full windows of ``size`` ids."""
    each = stream.withColumn("win", F.floor(F.col("at") / size))
    out = each.groupBy("file_id", "win").agg(F.count("*").alias("n"), F.count_if(F.col("sym").isin(*marked)).alias("n_marked"), F.min_by("sym", "at").alias("first_sym"), F.max_by("sym", "at").alias("last_sym"))
    return out.where(F.col("n") == size).drop("n")


def packing(words: DataFrame, size: int) -> DataFrame:
    """One row: tokens and notes in all, and in full windows, as five tokens a note and as encoded.

    words: (file_id, n_tokens) with a row for each note.
    """
    files = words.groupBy("file_id").agg((F.count("*") * 5).alias("plain"), F.count("*").alias("notes"), F.sum("n_tokens").alias("bpe"))
    full = lambda c: F.floor(F.col(c) / size) * size
    return files.agg(
        F.count("*").alias("n_files"),
        F.sum("plain").alias("plain_tokens"),
        F.sum("bpe").alias("bpe_tokens"),
        F.sum(full("plain")).alias("plain_packed"),
        F.sum(full("bpe")).alias("bpe_packed"),
        F.sum(F.floor(full("plain") / 5)).alias("plain_notes_packed"),
        F.sum(F.floor(full("bpe") * F.col("notes") / F.greatest(F.lit(1).cast("long"), F.col("bpe")))).alias("bpe_notes_packed"),
        F.sum(F.floor(F.col("bpe") / size)).alias("n_windows"),
    )


def slot_tokens(seq: DataFrame, vocab: DataFrame, merges: list[tuple[str, str, str]]) -> DataFrame:
    """(file_id, chunk_idx, seq, is_note, is_control, n_tokens) of each slot; rests and separators are one token.

    Controls are merged as events are, since a doubled vocabulary has every merge for them again. A chunk with a token that the
    dictionary hasn't has no slots.
    """
    note = F.col("kind").isin("EVENT", "CONTROL")
    each = with_indices(seq, vocab).withColumn("word", F.when(note, F.concat(*[symbol(F.col(c)) for c in INDICES])))
    unknown = F.max((note & F.col("word").isNull()).cast("int")).over(Window.partitionBy(*CHUNK))
    kept = each.withColumn("_unknown", unknown).where("_unknown = 0").select(*CHUNK, "seq", note.alias("is_note"), (F.col("kind") == "CONTROL").alias("is_control"), F.coalesce("word", F.lit("[000000]")).alias("word"))
    return encoded(kept, merges).select(*CHUNK, "seq", "is_note", "is_control", F.when(F.col("is_note"), count_symbols(F.col("enc"))).otherwise(1).cast("long").alias("n_tokens"))


def comparison(n: DataFrame, slots: DataFrame, size: int) -> DataFrame:
    """One row: tokens of notes as five each and of slots as encoded, those of controls, what of them fills windows, and how many
    windows hold a control. Files without slots are left out.

    Places of slots in a file are running sums, and a control's windows the range that it stands in; ranges follow each other,
    so those not counted before are counted by the last window so far. One shuffle by file serves; a file is a bounded group.
    """
    file = Window.partitionBy("file_id")
    so_far = file.orderBy("chunk_idx", "seq").rowsBetween(Window.unboundedPreceding, 0)
    before = file.orderBy("chunk_idx", "seq").rowsBetween(Window.unboundedPreceding, -1)
    each = slots.withColumn("end", F.sum("n_tokens").over(so_far)).withColumn("full", F.floor(F.sum("n_tokens").over(file) / size))
    each = each.withColumn("first", F.floor((F.col("end") - F.col("n_tokens")) / size)).withColumn("last", F.when(F.col("is_control"), F.least(F.floor((F.col("end") - 1) / size), F.col("full") - 1)))
    each = each.withColumn("seen", F.coalesce(F.max("last").over(before), F.lit(-1).cast("long")))
    new = F.greatest(F.lit(0).cast("long"), F.col("last") - F.greatest("first", F.col("seen") + 1) + 1)
    of_slots = each.groupBy("file_id").agg(
        F.sum("n_tokens").alias("bpe"),
        F.coalesce(F.sum(F.when(F.col("is_control"), F.col("n_tokens"))), F.lit(0).cast("long")).alias("ctrl"),
        F.count_if("is_note").alias("words"),
        F.coalesce(F.sum(F.when(F.col("is_control"), new)), F.lit(0).cast("long")).alias("anticipates"),
    )
    files = of_slots.join(n.groupBy("file_id").agg((F.count("*") * 5).alias("plain")), "file_id")
    full = lambda c: F.floor(F.col(c) / size) * size
    sums = files.agg(
        F.count("*").alias("n_files"),
        F.sum("plain").alias("plain_tokens"),
        F.sum("bpe").alias("bpe_tokens"),
        F.sum("ctrl").alias("ctrl_tokens"),
        F.sum(full("plain")).alias("plain_packed"),
        F.sum(full("bpe")).alias("bpe_packed"),
        F.sum(F.floor(full("plain") / 5)).alias("plain_notes_packed"),
        F.sum(F.floor(full("bpe") * F.col("words") / F.greatest(F.lit(1).cast("long"), F.col("bpe")))).alias("bpe_words_packed"),
        F.sum(F.floor(F.col("bpe") / size)).alias("n_windows"),
        F.sum("anticipates").alias("n_anticipate"),
    )
    ratio = lambda x, y: F.col(x) / F.greatest(F.lit(1).cast("long"), F.col(y))
    return sums.select("*", ratio("plain_tokens", "bpe_tokens").alias("compression"), ratio("n_anticipate", "n_windows").alias("anticipate_fraction"), ratio("ctrl_tokens", "bpe_tokens").alias("ctrl_fraction"))


def training_windows(sequence_ids: DataFrame, size: int) -> DataFrame:
    """(file_id, chunk_idx, anticipates, ids): the first window of each chunk that fills one, its prefix put before, its last id dropped.

    sequence_ids: (file_id, chunk_idx, seq, j, id, is_control).
    """
    number = F.row_number().over(Window.partitionBy(*CHUNK).orderBy("seq", "j"))
    first = sequence_ids.withColumn("at", number).where(F.col("at") <= size)
    whole = first.groupBy(*CHUNK).agg(F.count("*").alias("n"), F.max("is_control").alias("anticipates"), F.array_sort(F.collect_list(F.struct("at", "id"))).alias("x")).where(F.col("n") == size)
    prefix = F.when(F.col("anticipates"), "[ANTICIPATE]").otherwise("[AUTOREGRESS]")
    return whole.select(*CHUNK, "anticipates", F.concat_ws(" ", prefix, F.array_join(F.transform(F.slice("x", 1, size - 1), lambda v: v["id"]), " ")).alias("ids"))


def sequence_ids(seq: DataFrame, vocab: DataFrame) -> DataFrame:
    """(file_id, chunk_idx, seq, j, id, is_control): each slot as its ids; controls behind the dictionary, sentinels by name."""
    size = vocab.agg(F.count("*").alias("b"))
    parts = F.array(*[F.concat(F.lit(f"<{c}-"), F.col(f).cast("string"), F.lit(">")) for c, f in zip(CATEGORIES, FIELDS, strict=True)])
    single = F.array(F.concat(F.lit("["), F.col("kind"), F.lit("]")))
    each = seq.select(*CHUNK, "seq", (F.col("kind") == "CONTROL").alias("is_control"), F.posexplode(F.when(F.col("kind").isin("EVENT", "CONTROL"), parts).otherwise(single)).alias("j", "token"))
    out = each.join(F.broadcast(vocab.select("token", "idx")), "token", "left").join(F.broadcast(size))
    return out.select(*CHUNK, "seq", "j", "is_control", F.when(F.col("idx").isNull(), F.col("token")).otherwise((F.col("idx") + F.when(F.col("is_control"), F.col("b")).otherwise(0)).cast("string")).alias("id"))


def shards(files: DataFrame, ranks: int, workers: int, seed: int = 0) -> DataFrame:
    """(file_id, place, rank, worker): files in a drawn order, every ranks-th to a rank, of these every workers-th to a worker.

    The order is global, so its numbers come from a sort by ranges and the sizes of these, not from one task.
    """
    keyed = files.select("file_id").distinct().withColumn("h", draw(1_000_000_007, F.col("file_id"), salt=seed + 5))
    bucket = F.floor(F.col("h") / (1_000_000_007 // 1024 + 1))
    sizes = keyed.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))  # at most 1024 rows
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = keyed.withColumn("b", bucket).withColumn("own", F.row_number().over(Window.partitionBy("b").orderBy("h", "file_id")) - 1).join(F.broadcast(before), "b")
    place = (F.col("before") + F.col("own")).cast("long")
    return numbered.select("file_id", place.alias("place")).select("file_id", "place", (F.col("place") % ranks).alias("rank"), (F.floor(F.col("place") / ranks) % workers).alias("worker"))

"""What the tokens of a trained vocabulary are made of, and how often they stand."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantize import category_of
from .merges import symbols

SPECIALS = ("[UNK]", "[PAD]", "[BOS]", "[EOS]")


def expansions(merges: list[tuple[str, str, str]]) -> dict[str, list[str]]:
    """Base symbols of each merged one."""
    out: dict[str, list[str]] = {}
    for left, right, new in merges:
        out[new] = out.get(left, [left]) + out.get(right, [right])
    return out


def _rows(spark: SparkSession, rows: list[tuple], schema: dict[str, pa.DataType]) -> DataFrame:
    """Rows of the driver, as many as a vocabulary has, without a Python worker that gives them back."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema)))


def token_table(vocab: DataFrame, merges: list[tuple[str, str, str]]) -> DataFrame:
    """(sym, size, original_tokens, categories) of base and merged tokens. Both sides are as small as a vocabulary."""
    spark = vocab.sparkSession
    base = vocab.select(F.lpad(F.col("idx").cast("string"), 6, "0").alias("sym"), "token", category_of(F.col("token")).alias("category"))
    rows = [(new, j, s) for new, parts in expansions(merges).items() for j, s in enumerate(parts)]
    merged = _rows(spark, rows, {"made": pa.string(), "j": pa.int32(), "sym": pa.string()}).join(F.broadcast(base), "sym").groupBy("made").agg(F.array_sort(F.collect_list(F.struct("j", "token", "category"))).alias("x"))
    wide = merged.select(F.col("made").alias("sym"), F.size("x").cast("long").alias("size"), F.array_join(F.transform("x", lambda v: v["token"]), " ").alias("original_tokens"), F.array_join(F.array_sort(F.transform("x", lambda v: v["category"])), "+").alias("categories"))
    return base.select("sym", F.lit(1).cast("long").alias("size"), F.col("token").alias("original_tokens"), F.col("category").alias("categories")).unionByName(wide)


def frequencies(encoded: DataFrame) -> DataFrame:
    """(sym, n) over the corpus, from distinct words (enc, n)."""
    return encoded.select("n", F.explode(symbols(F.col("enc"))).alias("sym")).groupBy("sym").agg(F.sum("n").alias("n"))


def frequency_table(spark: SparkSession, standing: dict[str, int]) -> DataFrame:
    """The same, as training has counted them."""
    return _rows(spark, list(standing.items()), {"sym": pa.string(), "n": pa.int64()})


def with_frequency(tokens: DataFrame, freq: DataFrame) -> DataFrame:
    return tokens.join(freq, "sym", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def percentage(n: Column, total: Column) -> Column:
    return F.format_string("%.4f", n / total * 100)


def token_frequency(tokens: DataFrame, freq: DataFrame) -> DataFrame:
    """Tokens that the corpus has: (original_tokens, corpus_count, percentage, token_length)."""
    total = freq.agg(F.sum("n").alias("total"))
    return freq.join(tokens, "sym").join(F.broadcast(total)).select("original_tokens", F.col("n").alias("corpus_count"), percentage(F.col("n"), F.col("total")).alias("percentage"), F.col("size").alias("token_length"))


def merged_categories(tokens: DataFrame, freq: DataFrame) -> DataFrame:
    """(category, merged_vocab_count, corpus_weighted_count): each base token inside a merged one counts."""
    each = with_frequency(tokens.where("size > 1"), freq).select("n", F.explode(F.split("categories", r"\+")).alias("category"))
    return each.groupBy("category").agg(F.count("*").alias("merged_vocab_count"), F.sum("n").alias("corpus_weighted_count"))


def component_analysis(tokens: DataFrame, freq: DataFrame) -> DataFrame:
    """(size, categories, vocab_count, vocab_proportion, corpus_count, top): merged tokens by size and sorted categories."""
    each = with_frequency(tokens.where("size > 1"), freq).groupBy("size", "categories").agg(F.count("*").alias("vocab_count"), F.sum("n").alias("corpus_count"))
    by_size = Window.partitionBy("size")
    return each.select("size", "categories", "vocab_count", F.bround(F.col("vocab_count") / F.sum("vocab_count").over(by_size), 4).alias("vocab_proportion"), "corpus_count", F.row_number().over(by_size.orderBy(F.desc("corpus_count"), "categories")).cast("long").alias("top"))


def length_histogram(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(F.col("size").alias("token_length")).agg(F.count("*").alias("vocab_count"))


def summary(tokens: DataFrame, freq: DataFrame) -> DataFrame:
    """One row: (vocab_size with special tokens, total_bpe_tokens, num_merged_tokens, average_bpe_token_length, most_common)."""
    common = freq.orderBy(F.desc("n"), "sym").limit(50).join(tokens, "sym").orderBy(F.desc("n"), "sym").limit(10)
    listed = common.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "sym", "original_tokens", "n"))), lambda x: F.concat_ws("=", x["original_tokens"], x["n"].cast("string"))), "; ").alias("most_common"))
    sizes = tokens.agg((F.count("*") + len(SPECIALS)).alias("vocab_size"), F.count_if(F.col("size") > 1).alias("num_merged_tokens"), F.bround(F.avg("size"), 4).alias("average_bpe_token_length"))
    return sizes.join(F.broadcast(freq.agg(F.sum("n").alias("total_bpe_tokens")))).join(F.broadcast(listed))


def stacked(per_size: dict[int, DataFrame]) -> DataFrame:
    """Component tables of several vocabularies on top of each other, with the number of merges."""
    out = None
    for k, df in sorted(per_size.items()):
        df = df.select(F.lit(k).cast("long").alias("merges"), "*")
        out = df if out is None else out.unionByName(df)
    return out

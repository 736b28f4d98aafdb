"""Corpora, tokenizers and results as files, and tables kept under the parameters that made them."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantize import Grid, private_character
from ..operators.analysis import SPECIALS, expansions

# Corpora: a line for each chunk.


def write_corpus(lines: DataFrame, path: str) -> None:
    """The texts of (file_id, chunk_idx, text), in the order of files and chunks."""
    lines.where("text <> ''").orderBy("file_id", "chunk_idx").select("text").write.mode("overwrite").text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").withColumnRenamed("value", "text")


# Tables by parameters.


def key_of(params: dict) -> str:
    return hashlib.sha1(json.dumps(params, sort_keys=True).encode()).hexdigest()


def store(df: DataFrame, root: str, params: dict) -> DataFrame:
    """df as Parquet under a name made of its parameters; _SUCCESS marks it complete."""
    path = f"{root}/{key_of(params)}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def stored(spark: SparkSession, root: str, params: dict) -> DataFrame | None:
    """The complete table for these parameters, if there is one."""
    path = f"{root}/{key_of(params)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return spark.read.parquet(path) if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done) else None


# Tokenizers.


def tokenizer_json(tokens: list[str], merges: list[tuple[str, str, str]]) -> str:
    """The JSON of a tokenizer over private-use characters, ASCII only. tokens: base tokens in order."""
    char = {f"{k:06d}": private_character(k) for k in range(len(tokens))}
    whole = {m: "".join(char[s] for s in parts) for m, parts in expansions(merges).items()} | char
    vocab = {t: k for k, t in enumerate(SPECIALS)}
    for s in [*sorted(char), *[m for _, _, m in merges]]:
        vocab.setdefault(whole[s], len(vocab))
    added = [{"id": k, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for k, t in enumerate(SPECIALS)]
    model = {"type": "BPE", "dropout": None, "unk_token": "[UNK]", "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": vocab, "merges": [[whole[a], whole[b]] for a, b, _ in merges]}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": model})


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, token) and (rank, left, right) of a tokenizer file; its merges may be pairs or strings with a blank."""
    whole = spark.read.text(path, wholetext=True)
    model = whole.select(F.from_json("value", "model struct<vocab: map<string, long>, merges: array<string>>").alias("x")).select("x.model.*")
    vocab = model.select(F.explode("vocab").alias("token", "id")).select("id", "token")
    pair = F.when(F.col("m").startswith('["'), F.from_json("m", "array<string>")).otherwise(F.split("m", " ", 2))
    merges = model.select(F.posexplode("merges").alias("rank", "m")).select(F.col("rank").cast("long").alias("rank"), pair[0].alias("left"), pair[1].alias("right"))
    return vocab, merges


def tokenizers_in(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(vocabulary size from the name, path) of the tokenizer files of a folder, by size."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.regexp_extract("path", r"vocab(\d+)", 1).alias("n")).where("n <> ''")
    return sorted((int(r.n), r.path) for r in found.collect())


def ladder(base: int, specials: int = len(SPECIALS), merges: int | None = None, sizes: list[int] | None = None) -> list[int]:
    """Vocabulary sizes to train: one by its merges, or those asked for, or base and special tokens with 256 merges and on by doubling."""
    least = base + specials
    wanted = [least + merges] if merges is not None else sizes or [least + 256 * 2**k for k in range(9)]
    return sorted({s for s in wanted if s >= least})


# Results.


def config_path(root: str, factor: str, grid: Grid) -> str:
    return f"{root}/{factor}/{grid.name}"


def parsed_config(path) -> list:
    """Columns of the grid that a path names."""
    number = r"([0-9.]+)"
    names = {"onset_ms": rf"onset-{number}ms", "dur_ms": rf"duration-{number}ms", "vel_bins": rf"velocity-{number}bin"}
    return [F.nullif(F.regexp_extract(path, p, 1), F.lit("")).cast("double").alias(k) for k, p in names.items()]


def write_results(results: DataFrame, path: str) -> None:
    """By vocabulary size, as JSON and, without the fields that only bookkeeping needs, as CSV."""
    ordered = results.orderBy("merges")
    ordered.write.mode("overwrite").json(f"{path}/json")
    ordered.drop("status", "requested_vocab_size").write.mode("overwrite").csv(f"{path}/csv", header=True)


def read_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON results below root with the grid that their path names; without rows that have no compression factor."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    at = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(at, r"/([^/]+)/onset-", 1).alias("factor"), *parsed_config(at)).where("compression_factor is not null and not isnan(compression_factor)")


def write_components(components: DataFrame, path: str) -> None:
    components.write.mode("overwrite").partitionBy("size").csv(path, header=True)


def read_components(spark: SparkSession, root: str) -> DataFrame:
    """Component tables below root: (vocab_label, size, categories, vocab_count, corpus_count), keys from the path."""
    rows = spark.read.schema("categories string, vocab_count long, vocab_proportion double, corpus_count long, top long").option("recursiveFileLookup", True).csv(root, header=True)
    at = F.col("_metadata.file_path")
    out = rows.select(F.regexp_extract(at, r"vocab(\d+)", 1).cast("long").alias("vocab_size"), F.regexp_extract(at, r"size=?(\d+)", 1).cast("long").alias("size"), "categories", "vocab_count", "corpus_count")
    return out.orderBy("vocab_size", "size", F.desc("corpus_count"), "categories")


def patched(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """entries with vocab_proportion of (size, total) anew, 0 where there is no total; and whether that changed anything."""
    new = F.coalesce(F.bround(F.col("vocab_count") / F.col("total"), 4), F.lit(0.0))
    return entries.join(F.broadcast(totals), "size", "left").withColumn("changed", ~new.eqNullSafe(F.col("vocab_proportion"))).withColumn("vocab_proportion", new).drop("total")


def axis_labels(sizes: DataFrame) -> DataFrame:
    """sizes with ``label``: thousands, with a decimal where whole ones would be the same for several."""
    from pyspark.sql.window import Window

    short = F.concat(F.round(F.col("vocab_size") / 1000, 0).cast("int").cast("string"), F.lit("k"))
    several = F.count("*").over(Window.partitionBy(short)) > 1
    return sizes.withColumn("label", F.when(several, F.concat(F.format_string("%.1f", F.col("vocab_size") / 1000), F.lit("k"))).otherwise(short))


def vocabulary_label(path: str) -> str | None:
    m = re.search(r"vocab(\d+)", path)
    return m[1] if m else None

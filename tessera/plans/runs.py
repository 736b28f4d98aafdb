"""Whole runs in one call: train a ladder of vocabularies, double them, analyse them, compare encodings.

A run leaves its files in one folder and goes on where an earlier one of the same folder stopped: what is complete there is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantize import Grid
from ..operators import analysis, corpus, doubling, merges, windows
from ..sources import artifacts, files
from .tables import settled

Rule = tuple[str, str, str]


def _tokenizer(out: str, size: int) -> str:
    return f"{out}/tokenizers/vocab{size}"


def _words(n: DataFrame, vocab: DataFrame, standalone: bool) -> DataFrame:
    return corpus.words_of(corpus.known(corpus.with_indices(n, vocab)), standalone)


def _dictionary(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/vocabulary")


def _tokens(vocab: DataFrame) -> list[str]:
    return [r.token for r in vocab.orderBy("idx").collect()]  # bounded by the private-use characters


def rules_of(spark: SparkSession, out: str) -> list[Rule]:
    """The merges that a run trained, a row for each."""
    return [(r.l, r.r, r.made) for r in spark.read.parquet(f"{out}/merges").orderBy("rank").collect()]


def train(n: DataFrame, out: str, sizes: list[int] | None = None, k: int | None = None, grid: Grid = Grid(), standalone: bool = False, limit: int | None = None) -> dict[int, str]:  # noqa: B008
    """Vocabulary sizes and their tokenizer files, from notes ``n``; dictionary, corpus, merges and configuration beside them.

    All sizes are cut from one training, that of the largest. A folder that holds a dictionary, corpus and enough merges isn't
    read from notes again, so a run over other notes, or on another grid, takes another folder. Where fewer pairs are left than
    a size asks for, its file has those that there are.
    """
    spark = n.sparkSession
    if not artifacts.exists(spark, f"{out}/vocabulary"):
        corpus.vocabulary(n).write.mode("overwrite").parquet(f"{out}/vocabulary")
    vocab = _dictionary(spark, out)
    if artifacts.corpus_state(spark, out) is None:
        artifacts.write_dictionary(vocab, f"{out}/dictionary")
        text = corpus.lines(_words(n, vocab, standalone)).withColumn("text", corpus.private_use_words(F.col("text")))
        artifacts.write_corpus_with_state(text, out, "", n.select("file_id").distinct().count())
    tokens = _tokens(vocab)
    ladder = files.ladder(len(tokens), merges=k, sizes=sizes)
    if not ladder:
        raise ValueError("every size asked for is below that of the dictionary and the special tokens")
    least = len(tokens) + len(analysis.SPECIALS)
    rules = rules_of(spark, out) if artifacts.exists(spark, f"{out}/merges") else []
    asked = artifacts.read_json(spark, f"{out}/trained") or {"merges": -1}
    if asked["merges"] < ladder[-1] - least:
        if not artifacts.exists(spark, f"{out}/words"):
            corpus.counted(_words(n, vocab, standalone)).write.mode("overwrite").parquet(f"{out}/words")
        rules = merges.train_one(spark.read.parquet(f"{out}/words"), ladder[-1] - least)
        spark.createDataFrame([(j, *x) for j, x in enumerate(rules)], "rank long, l string, r string, made string").coalesce(1).write.mode("overwrite").parquet(f"{out}/merges")
        artifacts.write_json(spark, {"merges": ladder[-1] - least}, f"{out}/trained")
    for size in ladder:
        if not artifacts.exists(spark, _tokenizer(out, size)):
            files.write_text(spark, files.tokenizer_json(tokens, rules[: size - least]), _tokenizer(out, size))
    state = artifacts.corpus_state(spark, out)
    config = artifacts.train_config(len(tokens), len(analysis.SPECIALS), ladder, state["files_processed"], state["num_files_cached"], limit, grid.onset_ms, grid.dur_ms, grid.vel_bins, standalone)
    artifacts.write_json(spark, config, f"{out}/train_config")
    return {size: _tokenizer(out, size) for size in ladder}


def double(spark: SparkSession, out: str) -> dict[int, str]:
    """For each vocabulary size of a run the file of its doubled tokenizer; the dictionary gets the controls' characters."""
    vocab = _dictionary(spark, out)
    artifacts.write_dictionary(vocab, f"{out}/dictionary", doubled=True)
    tokens, made = _tokens(vocab), {}
    for size, path in files.tokenizers_in(spark, f"{out}/tokenizers"):
        made[size] = f"{out}/doubled/of_vocab{size}"
        if not artifacts.exists(spark, made[size]):
            files.write_text(spark, doubling.doubled_json(spark.read.text(path, wholetext=True).first().value, tokens), made[size])
    return made


def analyse(spark: SparkSession, out: str) -> DataFrame:
    """(merges, size, categories, vocab_count, vocab_proportion, corpus_count, top) of all vocabularies of a run, stacked; CSV and a
    summary for each of them. Those that have a summary are kept as they are.
    """
    vocab, rules, words = _dictionary(spark, out), rules_of(spark, out), spark.read.parquet(f"{out}/words")
    least = vocab.count() + len(analysis.SPECIALS)
    per_size = {}
    for size, _ in files.tokenizers_in(spark, f"{out}/tokenizers"):
        own = rules[: size - least]
        if not own:
            continue
        tokens = analysis.token_table(vocab, own)
        freq = settled(analysis.frequencies(merges.encoded(words, own)))  # as small as a vocabulary
        if not artifacts.exists(spark, f"{out}/analysis/vocab{size}/summary"):
            artifacts.write_analysis(tokens, freq, f"{out}/analysis/vocab{size}")
        per_size[size - least] = analysis.component_analysis(tokens, freq)
    return analysis.stacked(per_size)


def compare(n: DataFrame, seq: DataFrame, vocab: DataFrame, rules: list[Rule], size: int) -> DataFrame:
    """One row: notes as five tokens each against their sequences with controls and merges, in all and in full windows."""
    return windows.comparison(n, windows.slot_tokens(seq, vocab, rules), size)

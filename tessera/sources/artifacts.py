"""What a run leaves behind for later ones: dictionaries, lists of files, corpora with their state, configurations, checkpoints
of evaluations, analyses, windows of ids. Small things are JSON or CSV, large ones Parquet or text; all are written by Spark, so
any store that it reaches will do, and what is half written is not taken for complete.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analysis import component_analysis, length_histogram, merged_categories, summary, token_frequency
from ..operators.lines import control_characters, event_characters
from .files import key_of, read_corpus, store, stored, write_corpus, write_text

# Names in the files.
PLAIN, PLAIN_BACK, CONTROL, CONTROL_BACK = "base_token_to_char", "char_to_base_token", "base_token_to_ctrl_char", "ctrl_char_to_base_token"


def exists(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The object in a small file that write_json wrote, if that is complete."""
    return json.loads(spark.read.text(path, wholetext=True).first().value) if exists(spark, path) else None


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    write_text(spark, json.dumps(value, ensure_ascii=True), path)


# Dictionaries.


def write_dictionary(vocab: DataFrame, path: str, fingerprint: str = "", doubled: bool = False) -> None:
    """Tokens with their characters both ways, ASCII only; with ``doubled`` those of controls, too."""
    own = event_characters(vocab)
    data = {"fingerprint": fingerprint, PLAIN: own, PLAIN_BACK: {c: t for t, c in own.items()}}
    if doubled:
        ctrl = control_characters(own)
        data |= {CONTROL: ctrl, CONTROL_BACK: {c: t for t, c in ctrl.items()}}
    write_json(vocab.sparkSession, data, path)


def is_doubled(spark: SparkSession, path: str) -> bool:
    return CONTROL in (read_json(spark, path) or {})


def read_dictionary(spark: SparkSession, path: str, fingerprint: str | None = None, doubled: bool = False) -> DataFrame | None:
    """(token, ch, idx, is_ctrl); None where there is no file or it has another fingerprint than the one asked for.

    With ``doubled`` the file must have controls; without, they are left out.
    """
    data = read_json(spark, path)
    if data is None or fingerprint is not None and data.get("fingerprint") != fingerprint:
        return None
    if doubled and CONTROL not in data:
        raise KeyError(f"{path} has no controls")
    rows = [(t, c, k, False) for k, (t, c) in enumerate(sorted(data[PLAIN].items()))]
    if doubled:
        rows += [(t, c, len(rows) + k, True) for k, (t, c) in enumerate(sorted(data[CONTROL].items()))]
    return spark.createDataFrame(rows, "token string, ch string, idx long, is_ctrl boolean")


# Lists of files.


def write_file_list(files: DataFrame, path: str, limit: int | None = None) -> None:
    """The paths (column ``path``) with the limit that they were listed under."""
    files.select("path").orderBy("path").write.mode("overwrite").text(f"{path}/files")
    write_json(files.sparkSession, {"num_files": files.count(), "limit_files": limit}, f"{path}/meta")


def read_file_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame | None:
    """The paths, if they were listed under the same limit."""
    meta = read_json(spark, f"{path}/meta")
    if meta is None or meta.get("limit_files") != limit or not exists(spark, f"{path}/files"):
        return None
    return spark.read.text(f"{path}/files").select(F.trim("value").alias("path")).where("path <> ''")


# Corpora with their state.


def write_corpus_with_state(lines: DataFrame, path: str, fingerprint: str, n_files: int) -> None:
    """The lines, then a note that they are complete. Tasks that fail are run again by Spark; a job that fails leaves no such note."""
    write_corpus(lines, f"{path}/corpus")
    n = read_corpus(lines.sparkSession, f"{path}/corpus").count()
    state = {"fingerprint": fingerprint, "status": "complete", "files_processed": n_files, "num_files_scanned": n_files, "num_files_cached": n}
    write_json(lines.sparkSession, state, f"{path}/meta")


def corpus_state(spark: SparkSession, path: str) -> dict | None:
    return read_json(spark, f"{path}/meta")


def read_complete_corpus(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame | None:
    """The lines of a complete corpus, whatever its fingerprint or only with the one given; their number is in its state."""
    state = corpus_state(spark, path)
    if state is None or state.get("status") != "complete" or fingerprint is not None and state.get("fingerprint") != fingerprint:
        return None
    return read_corpus(spark, f"{path}/corpus")


def train_config(base: int, specials: int, sizes: list[int], n_files: int, n_lines: int, limit: int | None, onset_ms: float, dur_ms: float, vel_bins: int, standalone: bool = False, augment: bool = False) -> dict:
    """What a training was run with, under the names of the file."""
    return {
        "base_alphabet_size": base, "num_special_tokens": specials, "vocab_sizes": sizes, "num_files": n_files, "num_corpus_strings": n_lines,
        "limit_files": limit, "onset_ms": onset_ms, "dur_ms": dur_ms, "vel_bins": vel_bins, "onset_standalone": standalone, "augment": augment,
    }


# Evaluations that go on where one stopped.


def _evaluation(source: str, n_lines: int, **more: object) -> dict:
    return {"what": "evaluation", "source_type": source, "source_len": n_lines, **more}


def keep_results(results: DataFrame, root: str, source: str, n_lines: int) -> None:
    """Each size's row (column ``merges``) under the corpus that it was measured on."""
    for k in [r.merges for r in results.select("merges").distinct().collect()]:
        store(results.where(F.col("merges") == k), root, _evaluation(source, n_lines, merges=k))


def kept_results(spark: SparkSession, root: str, source: str, n_lines: int, ladder: list[int]) -> tuple[DataFrame | None, list[int]]:
    """Results of this ladder that are there for the same corpus, and the sizes that are still to be measured."""
    found = {k: stored(spark, root, _evaluation(source, n_lines, merges=k)) for k in ladder}
    out = None
    for df in found.values():
        out = out if df is None else df if out is None else out.unionByName(df)
    return out, [k for k, df in found.items() if df is None]


def joined_results(done: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """Kept and new results as one table, by size."""
    both = [df for df in (done, new) if df is not None]
    return (both[0] if len(both) == 1 else both[0].unionByName(both[1])).orderBy("merges")


# Analyses.


def write_analysis(tokens: DataFrame, freq: DataFrame, path: str) -> None:
    """Token frequencies, categories, components by size and lengths as CSV, most frequent first, and a summary as JSON."""
    csv = lambda df, name: df.coalesce(1).write.mode("overwrite").csv(f"{path}/{name}", header=True)
    csv(token_frequency(tokens, freq).orderBy(F.desc("corpus_count"), "original_tokens"), "token_frequency")
    csv(merged_categories(tokens, freq).orderBy(F.desc("corpus_weighted_count"), "category"), "merged_token_category_counts")
    components = component_analysis(tokens, freq)
    for r in components.select("size").distinct().collect():
        own = components.where(F.col("size") == r.size).orderBy(F.desc("corpus_count"), "categories")
        csv(own.select("categories", "vocab_count", "corpus_count"), f"component_analysis_size{r.size}")
    csv(length_histogram(tokens).orderBy("token_length"), "token_length_distribution")
    whole = summary(tokens, freq).first().asDict()
    top = components.where("top <= 10").orderBy("size", "top").collect()
    whole["component_analysis"] = {str(r.size): [x.asDict() for x in top if x.size == r.size] for r in top}
    write_json(tokens.sparkSession, whole, f"{path}/summary")


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(original_tokens, corpus_count) of a CSV of token frequencies."""
    schema = "original_tokens string, corpus_count long, percentage string, token_length long"
    return spark.read.schema(schema).csv(path, header=True).select("original_tokens", "corpus_count")


def frequencies_by_text(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(sym, n): frequencies found by what a token is made of; tokens that the CSV hasn't are left out."""
    return tokens.join(counts, "original_tokens").select("sym", F.col("corpus_count").alias("n"))


# Ids of a larger model, and windows of them.


def extended_ids(vocab: DataFrame, model: DataFrame) -> DataFrame:
    """(id, token, new_id): a model's vocabulary (id, token) goes on with ours in the order of ids; tokens that it has keep its ids.

    The order is global over a vocabulary, which is small.
    """
    from pyspark.sql.window import Window

    size = model.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("size"))
    each = vocab.select("id", "token").join(model.select("token", F.col("id").alias("_known")), "token", "left")
    place = F.sum(F.col("_known").isNull().cast("long")).over(Window.orderBy("id")) - 1
    return each.withColumn("_place", place).join(F.broadcast(size)).select("id", "token", F.coalesce("_known", F.col("size") + F.col("_place")).cast("long").alias("new_id"))


def with_new_ids(stream: DataFrame, ids: DataFrame) -> DataFrame:
    """A stream of ids (column ``id``) in those of the larger model; the table of ids is as small as a vocabulary."""
    return stream.join(F.broadcast(ids.select("id", "new_id")), "id").drop("id").withColumnRenamed("new_id", "id")


def write_windows(windows: DataFrame, path: str, params: dict) -> str:
    """Windows (column ``ids``, an array) for a trainer, under their parameters."""
    store(windows, path, params)
    return f"{path}/{key_of(params)}"


def read_windows(spark: SparkSession, path: str, params: dict, size: int | None = None) -> DataFrame | None:
    """The windows for these parameters, if complete; with ``size`` only those of that length."""
    found = stored(spark, path, params)
    return found if found is None or size is None else found.where(F.size("ids") == size)

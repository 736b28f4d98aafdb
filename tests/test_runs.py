"""Whole runs: what they leave, that they go on where they stopped, and the comparison of encodings against plain loops."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.functions.quantize import Grid
from tessera.operators import anticipation, corpus, merges, windows
from tessera.operators import notes as N
from tessera.plans import runs
from tessera.sources import artifacts, files
from tessera.sources.notes import notes_from_events

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def notes(spark):
    return N.notes(notes_from_events(spark.read.parquet(f"{SMALL}/events.parquet")), Grid(vel_bins=8))


def text_of(spark, path):
    return spark.read.text(path, wholetext=True).first().value


def test_a_run_goes_on_where_it_stopped(spark, notes, tmp_path):
    out = f"file://{tmp_path}"
    least = corpus.vocabulary(notes).count() + 4
    first = runs.train(notes, out, sizes=[least + 4, 3], limit=7)
    assert list(first) == [least + 4] and len(runs.rules_of(spark, out)) == 4
    before = text_of(spark, first[least + 4])
    both = runs.train(notes.limit(0), out, sizes=[least + 4, least + 9])  # no note is read any more
    rules = runs.rules_of(spark, out)
    assert list(both) == [least + 4, least + 9] and len(rules) == 9 and text_of(spark, both[least + 4]) == before
    words = corpus.counted(corpus.words_of(corpus.with_indices(notes, corpus.vocabulary(notes))))
    assert rules == merges.train_one(words, 9)
    assert Tokenizer.from_str(text_of(spark, both[least + 9])).get_vocab_size() == least + 9
    config = artifacts.read_json(spark, f"{out}/train_config")
    assert config["vocab_sizes"] == [least + 4, least + 9] and config["num_files"] == notes.select("file_id").distinct().count()
    assert artifacts.read_complete_corpus(spark, out).count() == config["num_corpus_strings"]
    with pytest.raises(ValueError):
        runs.train(notes, out, sizes=[3])

    doubled = runs.double(spark, out)
    assert set(doubled) == set(both) and artifacts.is_doubled(spark, f"{out}/dictionary")
    own = Tokenizer.from_str(text_of(spark, doubled[least + 9]))
    assert own.get_vocab_size() == 2 * (least - 4 + 9) + 4 + 4
    assert runs.double(spark, out) == doubled

    stacked = runs.analyse(spark, out)
    sums = {r.merges: r.n for r in stacked.groupBy("merges").agg(F.sum("vocab_count").alias("n")).collect()}
    assert sums == {4: 4, 9: 9}
    summary = artifacts.read_json(spark, f"{out}/analysis/vocab{least + 9}/summary")
    assert summary["vocab_size"] == least + 9 and summary["num_merged_tokens"] == 9
    assert [n for n, _ in files.tokenizers_in(spark, f"{out}/tokenizers")] == [least + 4, least + 9]


@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
def test_comparison_like_loops(spark, notes, size):
    vocab = corpus.vocabulary(notes)
    rules = merges.train_one(corpus.counted(corpus.words_of(corpus.with_indices(notes, vocab))), 6)
    seq = anticipation.sequence(anticipation.by_rate(notes, 3), Grid(vel_bins=8))
    slots = windows.slot_tokens(seq, vocab, rules)
    got = windows.comparison(notes, slots, size).first()
    streams = {}
    for r in slots.orderBy("file_id", "chunk_idx", "seq").collect():
        streams.setdefault(r.file_id, []).append(r)
    want = dict.fromkeys(("n_files", "plain_tokens", "bpe_tokens", "ctrl_tokens", "n_windows", "n_anticipate", "bpe_words_packed"), 0)
    plain = {r.file_id: 5 * r["count"] for r in notes.groupBy("file_id").count().collect()}
    for f, rows in streams.items():
        ids = [r.is_control for r in rows for _ in range(r.n_tokens)]
        full = [ids[a : a + size] for a in range(0, len(ids) - size + 1, size)]
        want["n_files"] += 1
        want["plain_tokens"] += plain[f]
        want["bpe_tokens"] += len(ids)
        want["ctrl_tokens"] += sum(ids)
        want["n_windows"] += len(full)
        want["n_anticipate"] += sum(any(w) for w in full)
        want["bpe_words_packed"] += len(full) * size * sum(r.is_note for r in rows) // max(1, len(ids))
    assert {k: got[k] for k in want} == want


def test_comparison_leaves_out_unknown_chunks(spark, notes):
    """A chunk with a token that the dictionary hasn't goes as a whole, a file without any other chunk, too."""
    vocab = corpus.vocabulary(notes.where("file_id % 2 = 0"))
    seq = anticipation.sequence(anticipation.by_rate(notes, 3), Grid(vel_bins=8))
    slots = windows.slot_tokens(seq, vocab, [])
    known = {(r.file_id, r.chunk_idx) for r in corpus.known(corpus.with_indices(notes, vocab), "chunk").select("file_id", "chunk_idx").distinct().collect()}
    assert {(r.file_id, r.chunk_idx) for r in slots.select("file_id", "chunk_idx").distinct().collect()} == known
    got = windows.comparison(notes, slots, 16).first()
    assert got.n_files == len({f for f, _ in known}) and got.bpe_tokens == slots.agg(F.sum("n_tokens")).first()[0]
    none = windows.comparison(notes.limit(0), slots.limit(0), 16).first()
    assert none.n_files == 0 and none.compression is None

"""MIDI files, corpora, results, and the growing corpus."""

import struct

from pyspark.sql import functions as F

from tessera.functions.quantize import Grid
from tessera.operators import corpus
from tessera.operators import notes as N
from tessera.sources import files, midi
from tessera.sources.notes import notes_from_events
from tessera.streaming import corpus as growing

SMALL = "/root/testdata/sf0.001"

NOTES = [(0.0, 0.5, 60, 0, False, 100), (0.5, 1.25, 64, 0, False, 90), (0.25, 0.75, 36, 0, True, 127), (1.0, 2.0, 50, 40, False, 1)]


def test_midi_there_and_back():
    assert sorted(midi.parse(midi.render(NOTES))) == sorted(NOTES)


def test_midi_details():
    # Running status, a note-on of velocity 0 as an end, a change of tempo after one quarter note, an open note at the end.
    track = bytes([0, 0xFF, 0x51, 3]) + (1_000_000).to_bytes(3, "big") + bytes([0, 0xC1, 5, 0, 0x91, 60, 80, 96, 62, 70, 0, 60, 0]) + bytes([0, 0xFF, 0x51, 3]) + (500_000).to_bytes(3, "big") + bytes([0x60, 0x91, 62, 0, 0, 65, 1, 0, 0xFF, 0x2F, 0])
    data = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", len(track)) + track
    assert midi.parse(data) == [(0.0, 1.0, 60, 5, False, 80), (1.0, 1.5, 62, 5, False, 70)]


def test_midi_folder(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.MID").write_bytes(midi.render(NOTES))
    (tmp_path / "a.midi").write_bytes(midi.render(NOTES[:1]))
    (tmp_path / "bad.mid").write_bytes(b"MThd junk")
    (tmp_path / "no.txt").write_bytes(midi.render(NOTES))
    got = midi.read_midi(spark, str(tmp_path))
    assert {r.file_id.rsplit("/", 1)[1]: r["count"] for r in got.groupBy("file_id").count().collect()} == {"a.midi": 1, "x.MID": 4}
    assert midi.read_midi(spark, str(tmp_path), limit=1).count() == 1
    assert N.notes(got).count() == 5
    content = midi.to_midi(got).collect()
    assert sorted(len(midi.parse(bytes(r.content))) for r in content) == [1, 4]


def test_corpus_files(spark, tmp_path):
    n = N.notes(notes_from_events(spark.read.parquet(f"{SMALL}/events.parquet")))
    lines = corpus.lines(corpus.words_of(corpus.with_indices(n, corpus.vocabulary(n))))
    files.write_corpus(lines.unionByName(spark.createDataFrame([(0, 0, "")], lines.schema)), f"{tmp_path}/c")
    assert files.read_corpus(spark, f"{tmp_path}/c").count() == lines.count()


def test_tables_by_parameters(spark, tmp_path):
    df = spark.range(3)
    assert files.stored(spark, str(tmp_path), {"a": 1}) is None
    files.store(df, str(tmp_path), {"a": 1, "b": 2})
    assert files.stored(spark, str(tmp_path), {"b": 2, "a": 1}).count() == 3
    assert files.stored(spark, str(tmp_path), {"a": 1, "b": 3}) is None


def test_results(spark, tmp_path):
    grid = Grid(onset_ms=20.0)
    rows = spark.createDataFrame([(4, 1.5, "complete"), (2, float("nan"), "complete")], "merges long, compression_factor double, status string")
    files.write_results(rows, files.config_path(str(tmp_path), "onset", grid))
    got = files.read_results(spark, str(tmp_path), "merges long, compression_factor double").collect()
    assert [(r.merges, r.factor, r.onset_ms, r.dur_ms, r.vel_bins) for r in got] == [(4, "onset", 20.0, 10.0, 128.0)]


def test_components(spark, tmp_path):
    c = spark.createDataFrame([(2, "a+b", 3, 0.75, 10, 1), (2, "b+c", 1, 0.25, 20, 2)], "size long, categories string, vocab_count long, vocab_proportion double, corpus_count long, top long")
    files.write_components(c, f"{tmp_path}/vocab123")
    got = files.read_components(spark, str(tmp_path)).collect()
    assert [(r.vocab_size, r.size, r.categories) for r in got] == [(123, 2, "b+c"), (123, 2, "a+b")]
    out = files.patched(c, spark.createDataFrame([(2, 8)], "size long, total long")).orderBy("categories").collect()
    assert [(r.vocab_proportion, r.changed) for r in out] == [(0.375, True), (0.125, True)]


def test_labels(spark):
    got = {r.vocab_size: r.label for r in files.axis_labels(spark.createDataFrame([(11_644,), (11_900,), (76_924,)], "vocab_size long")).collect()}
    assert got == {11_644: "11.6k", 11_900: "11.9k", 76_924: "77k"}
    assert files.vocabulary_label("x/vocab44156/y.json") == "44156"


def test_growing_corpus(spark, tmp_path):
    raw = notes_from_events(spark.read.parquet(f"{SMALL}/events.parquet"))
    n = N.notes(raw)
    vocab = corpus.vocabulary(n)
    whole = {r.word: r.n for r in corpus.counted(corpus.words_of(corpus.with_indices(n, vocab))).collect()}
    for part in (0, 1):
        raw.where(F.col("file_id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        growing.count_words(spark, f"{tmp_path}/in", raw.schema.simpleString()[7:-1].replace(":", " "), vocab, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert {r.word: r.n for r in growing.total_counts(spark, f"{tmp_path}/out").collect()} == whole


def test_note_rate(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    assert sum(r.n_notes for r in growing.note_rate(events).collect()) == events.count()

"""Vocabularies of real sizes against the library, stored corpora, doubled tokenizers and what runs leave behind."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_merges import counted, library
from tokenizers import Tokenizer

from tessera import catalogue
from tessera.functions.quantize import private_character
from tessera.operators import analysis, augment, corpus, doubling, lines, merges
from tessera.operators import notes as N
from tessera.plans import sweep as S
from tessera.sources import artifacts, files
from tessera.sources.notes import notes_from_events

SMALL = "/root/testdata/sf0.001"


def many_words(n, symbols, seed=1):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "".join(f"[{int(symbols * rng.random() ** 2):06d}]" for _ in range(rng.randint(1, 9)))
        out[w] = out.get(w, 0) + rng.randint(1, 50)
    return out


@pytest.fixture(scope="module")
def large():
    """Some ten thousand words, 8,192 merges of them, and their characters."""
    words = many_words(12_000, 200)
    rules = merges.merges_of(list(words), list(words.values()), 8192)
    return words, rules


def characters(word):
    return "".join(private_character(int(x)) for x in word[1:-1].split("]["))


def test_8192_merges_like_the_library(large):
    words, rules = large
    assert len(rules) == 8192
    plain = [(characters(w), n) for w, n in words.items()]
    model = json.loads(library(plain, 8192, sorted({c for w, _ in plain for c in w})).to_str())["model"]["merges"]
    spelled = analysis.expansions(rules)
    text = lambda s: "".join(private_character(int(x)) for x in spelled.get(s, [s]))
    mine = [[text(a), text(b)] for a, b, _ in rules]
    whole = ["".join(x) for x in mine]
    # The library doesn't make a token twice; up to the first that would be, both agree.
    seen, same = set(), len(whole)
    for k, w in enumerate(whole):
        if w in seen:
            same = k
            break
        seen.add(w)
    assert same > 500 and mine[:same] == model[:same]


def test_8192_merges_encode_like_the_library(spark, large):
    words, rules = large
    t = Tokenizer.from_str(files.tokenizer_json([f"<{k:06d}>" for k in range(200)], rules[:500]))
    df = counted(spark, sorted(words.items())).repartition(5)
    got = {r.word: r.enc for r in merges.encoded(df, rules[:500]).collect()}
    assert all(len(t.encode(characters(w)).ids) == e.count("[") for w, e in got.items())
    enc = merges.encoded(df, rules)
    assert enc.where(F.col("enc") != F.col("word")).count() > 9000
    assert merges.unmerged(enc, rules).where("base <> word").count() == 0
    assert enc.columns == ["word", "n", "enc"]


def one_by_one(word, rules):
    """Each merge in turn."""
    s = word
    for a, b, m in rules:
        s = s.replace(f"[{a}][{b}]", f"[{m}]")
    return s


def test_ladder_in_one_pass_like_one_merge_after_the_other(spark, large):
    words = dict(sorted(large[0].items())[:300]) | {"[000001]" * 41: 3, "[000007]": 1}
    rules = large[1]
    sizes = [0, 1, 300, 1000, 1024, 8192]
    df = counted(spark, sorted(words.items())).withColumn("grp", F.lit("x")).repartition(3)
    got = {r.merges: r.bpe_tokens for r in merges.evaluate(df, {"x": rules}, sizes).collect()}
    assert got == {k: sum(n * one_by_one(w, rules[:k]).count("[") for w, n in words.items()) for k in sizes}
    enc = {r.word: r.enc for r in merges.encoded(df, rules).collect()}
    assert enc == {w: one_by_one(w, rules) for w in words}


def test_the_plan_does_not_grow_with_the_merges(spark, large):
    df = counted(spark, [("[000001][000002]", 1)])
    size = lambda k: len(merges.encoded(df, large[1][:k])._jdf.queryExecution().toString())
    assert abs(size(8192) - size(8)) < 100
    assert merges.encoded(df, []).first().enc == "[000001][000002]"
    assert merges.encoded(df.limit(0), large[1]).count() == 0


def test_groups_are_trained_apart(spark):
    a, b = many_words(200, 20, 2), many_words(50, 5, 3)
    rows = [("a", w, n) for w, n in a.items()] + [("b", w, n) for w, n in b.items()] + [("one", "[000001]", 5)]
    df = spark.createDataFrame(rows, "grp string, word string, n long")
    want = {g: merges.merges_of(list(x), list(x.values()), 12) for g, x in (("a", a), ("b", b))}
    assert merges.train(df, 12) == want
    assert merges.train(df, 4, most=100) == {g: m[:4] for g, m in want.items()}  # a by the jobs over all words


def test_too_large_a_dictionary_is_an_error(spark):
    tokens = spark.range(corpus.MOST_TOKENS + 1).select(F.concat(F.lit("<time-"), "id", F.lit(">")).alias("token"))
    with pytest.raises(Exception, match="private-use"):
        corpus.numbered(tokens).agg(F.max("idx")).collect()
    assert corpus.numbered(tokens.limit(10)).agg(F.max("idx")).first()[0] == 9


@pytest.fixture(scope="module")
def small(spark):
    n = N.notes(notes_from_events(spark.read.parquet(f"{SMALL}/events.parquet")))
    return n, corpus.vocabulary(n).cache()


def test_stored_lines(spark, small):
    n, vocab = small
    text = corpus.lines(corpus.words_of(corpus.with_indices(n, vocab))).withColumn("text", corpus.private_use_words(F.col("text")))
    first = text.orderBy("file_id", "chunk_idx").first().text
    apart = text.withColumn("text", lines.onsets_apart(F.col("text"))).orderBy("file_id", "chunk_idx").first().text
    assert apart == " ".join(x for w in first.split() for x in (w[0], w[1:]))
    assert text.agg(F.sum(lines.original_length(F.col("text")))).first()[0] == 5 * n.count()
    assert {r.word: r.n for r in lines.words_of_lines(text).collect()} == Counter(w for r in text.collect() for w in r.text.split())
    assert [r.word for r in lines.words_of_lines(spark.createDataFrame([("[REST] ab,c d",)], "text string")).orderBy("word").collect()] == [",", "REST", "[", "]", "ab", "c", "d"]


def test_decoding_of_lines(spark):
    vocab = spark.createDataFrame([("<pitch-5>", "pitch", 0), ("<time-3>", "time", 1)], "token string, category string, idx long")
    e, c = [private_character(k) for k in (0, 1)], [private_character(k) for k in (2, 3)]
    text = f"[SEPARATOR] {e[1]}{e[0]}  {c[1]}{e[0]} [REST] {e[0]}z"
    rows = spark.createDataFrame([(1, 0, text), (2, 0, None), (3, 0, "")], "file_id long, chunk_idx long, text string")
    got = [(r.pos, r.is_control, r.tokens) for r in lines.notes_of_lines(rows, vocab, strip_controls=False).orderBy("pos").collect()]
    assert got == [(0, False, ["<time-3>", "<pitch-5>"]), (1, True, ["<time-3>", "<pitch-5>"]), (2, False, ["<pitch-5>", "<UNK:0x7a>"])]
    assert [r.pos for r in lines.notes_of_lines(rows, vocab).orderBy("pos").collect()] == [0, 2]
    names = spark.createDataFrame([("<pitch-5>", True), ("<pitch-5>", False)], "t string, c boolean").select(lines.display_name(F.col("t"), F.col("c")).alias("x")).collect()
    assert [r.x for r in names] == ["ctrl_pitch-5", "<pitch-5>"]


def test_dictionaries_with_no_room_for_controls(spark, tmp_path):
    n = corpus.MOST_TOKENS // 2 + 64
    vocab = corpus.numbered(spark.range(n).select(F.concat(F.lit("<time-"), "id", F.lit(">")).alias("token")))
    places = {r.token: r.idx for r in vocab.where("token in ('<time-0>', '<time-29>', '<time-60000>')").collect()}
    own = [private_character(places[f"<time-{k}>"]) for k in (0, 29, 60000)]
    rows = spark.createDataFrame([(1, 0, " ".join(own))], "file_id long, chunk_idx long, text string")
    coarse, new = lines.coarsened_lines(rows, vocab, "t", 1, 20)
    of = {r.token: private_character(r.idx) for r in new.where("token in ('<time-0>', '<time-1>', '<time-3000>')").collect()}
    assert coarse.first().text == " ".join(of[f"<time-{k}>"] for k in (0, 1, 3000))
    assert [r.tokens for r in lines.notes_of_lines(rows, vocab).orderBy("pos").collect()] == [["<time-0>"], ["<time-29>"], ["<time-60000>"]]
    artifacts.write_dictionary(vocab, f"{tmp_path}/d")
    assert artifacts.read_dictionary(spark, f"{tmp_path}/d").count() == n
    with pytest.raises(ValueError, match="private-use"):
        artifacts.write_dictionary(vocab, f"{tmp_path}/e", doubled=True)


def test_doubled_tokenizer_file(spark, small):
    n, vocab = small
    words = corpus.counted(corpus.words_of(corpus.with_indices(n, vocab)))
    rules = merges.train_one(words, 60)
    tokens = [r.token for r in vocab.orderBy("idx").collect()]
    once = files.tokenizer_json(tokens, rules)
    text = doubling.doubled_json(once, tokens)
    assert text.isascii() and len(json.loads(text)["model"]["vocab"]) == 2 * len(json.loads(once)["model"]["vocab"])
    both, one = Tokenizer.from_str(text), Tokenizer.from_str(once)
    for w in [x for x in words.orderBy(F.desc("n"), "word").limit(40).select(corpus.private_use(F.col("word")).alias("x")).collect()]:
        ctrl = w.x.translate({ord(private_character(k)): private_character(len(tokens) + k) for k in range(len(tokens))})
        assert len(both.encode(w.x).ids) == len(one.encode(w.x).ids) == len(both.encode(ctrl).ids)
    assert both.encode("[REST] [ANTICIPATE]").tokens == ["[REST]", "[ANTICIPATE]"]
    assert {x["content"] for x in json.loads(text)["added_tokens"]} == set(doubling.SENTINELS)
    old = json.loads(once)
    old["model"]["merges"] = [" ".join(m) for m in old["model"]["merges"]]
    assert json.loads(doubling.doubled_json(json.dumps(old), tokens))["model"]["vocab"] == json.loads(text)["model"]["vocab"]


def test_passes_keep_all_notes(spark, small):
    n, vocab = small
    tasks = augment.all_passes(n, 10)
    seq = augment.augmented(n, tasks).cache()
    kinds = {(r.k, r.kind): r["count"] for r in seq.groupBy("k", "kind").count().collect()}
    whole = n.count()
    assert all(kinds.get((k, "EVENT"), 0) + kinds.get((k, "CONTROL"), 0) == whole for k in range(10))
    assert (0, "CONTROL") not in kinds and all(kinds[k, "CONTROL"] > 0 for k in range(1, 10))
    text = augment.sequence_lines(seq.where("k in (0, 2)"), vocab)
    decoded = lines.notes_of_lines(text, vocab, strip_controls=False)
    assert decoded.count() == 2 * whole and decoded.where("is_control").count() == kinds[2, "CONTROL"]
    less = vocab.where("token <> '<instrument-128>'")
    assert 0 < augment.sequence_lines(seq.where("k = 0"), less).count() < text.where("k = 0").count()


def test_epochs(spark):
    files_ = spark.range(4000).withColumnRenamed("id", "file_id")
    got = augment.epoch(files_, 0.6, 1).groupBy("k").count().collect()
    share = {r.k: r["count"] / 4000 for r in got}
    assert set(share) == set(range(10)) and abs(share[0] - 0.4) < 0.05 and all(abs(share[k] - 0.6 / 9) < 0.03 for k in range(1, 10))
    assert augment.epoch(files_, 0.0).where("k > 0").count() == 0
    assert augment.epoch(files_, 0.6, 1).join(augment.epoch(files_, 0.6, 2).withColumnRenamed("k", "k2"), "file_id").where("k <> k2").count() > 1000


def test_dictionary_files(spark, small, tmp_path):
    _, vocab = small
    artifacts.write_dictionary(vocab, f"{tmp_path}/d", "f1", doubled=True)
    artifacts.write_dictionary(vocab, f"{tmp_path}/p", "f1")
    assert artifacts.is_doubled(spark, f"{tmp_path}/d") and not artifacts.is_doubled(spark, f"{tmp_path}/p") and not artifacts.is_doubled(spark, f"{tmp_path}/none")
    both = artifacts.read_dictionary(spark, f"{tmp_path}/d", doubled=True)
    b = vocab.count()
    assert both.count() == 2 * b and both.where("not is_ctrl").join(vocab.select("token", F.col("idx").alias("x")), "token").where("x <> idx").count() == 0
    assert both.where("is_ctrl").orderBy("idx").first().ch == private_character(b)
    assert artifacts.read_dictionary(spark, f"{tmp_path}/p", "f1").count() == b
    assert artifacts.read_dictionary(spark, f"{tmp_path}/p", "f2") is None and artifacts.read_dictionary(spark, f"{tmp_path}/none") is None
    with pytest.raises(KeyError):
        artifacts.read_dictionary(spark, f"{tmp_path}/p", doubled=True)


def test_lists_and_states(spark, tmp_path):
    paths = spark.createDataFrame([("b.mid",), ("a.mid",)], "path string")
    artifacts.write_file_list(paths, f"{tmp_path}/l", 5)
    assert [r.path for r in artifacts.read_file_list(spark, f"{tmp_path}/l", 5).collect()] == ["a.mid", "b.mid"]
    assert artifacts.read_file_list(spark, f"{tmp_path}/l") is None and artifacts.read_file_list(spark, f"{tmp_path}/m", 5) is None
    rows = spark.createDataFrame([(1, 0, "a b"), (0, 0, "c"), (2, 0, "")], "file_id long, chunk_idx long, text string")
    artifacts.write_corpus_with_state(rows, f"{tmp_path}/c", "f", 3)
    assert artifacts.corpus_state(spark, f"{tmp_path}/c")["num_files_cached"] == 2
    assert artifacts.read_complete_corpus(spark, f"{tmp_path}/c").count() == artifacts.read_complete_corpus(spark, f"{tmp_path}/c", "f").count() == 2
    assert artifacts.read_complete_corpus(spark, f"{tmp_path}/c", "g") is None and artifacts.read_complete_corpus(spark, f"{tmp_path}/x") is None
    config = artifacts.train_config(10, 4, [14, 270], 3, 2, None, 10.0, 10.0, 128)
    artifacts.write_json(spark, config, f"{tmp_path}/config")
    assert artifacts.read_json(spark, f"{tmp_path}/config") == config


def test_evaluations_go_on(spark, tmp_path):
    rows = spark.createDataFrame([(256, 2.0), (0, 1.0)], "merges long, compression_factor double")
    artifacts.keep_results(rows, str(tmp_path), "corpus", 7)
    done, todo = artifacts.kept_results(spark, str(tmp_path), "corpus", 7, [0, 256, 512])
    assert todo == [512] and done.count() == 2
    assert artifacts.kept_results(spark, str(tmp_path), "corpus", 8, [0])[1] == [0] == artifacts.kept_results(spark, str(tmp_path), "midi", 7, [0])[1]
    new = spark.createDataFrame([(512, 3.0)], rows.schema)
    assert [r.merges for r in artifacts.joined_results(done, new).collect()] == [0, 256, 512]
    assert artifacts.joined_results(None, new).count() == 1


def test_analysis_files(spark, small, tmp_path):
    n, vocab = small
    words = corpus.counted(corpus.words_of(corpus.with_indices(n, vocab)))
    rules = merges.train_one(words, 50)
    tokens, freq = analysis.token_table(vocab, rules), analysis.frequencies(merges.encoded(words, rules))
    artifacts.write_analysis(tokens, freq, str(tmp_path))
    counts = artifacts.read_frequencies(spark, f"{tmp_path}/token_frequency")
    order = [r.corpus_count for r in counts.collect()]
    assert order == sorted(order, reverse=True)
    again = artifacts.frequencies_by_text(tokens, counts)
    same = analysis.component_analysis(tokens, again).exceptAll(analysis.component_analysis(tokens, freq))
    assert same.count() == 0
    whole = artifacts.read_json(spark, f"{tmp_path}/summary")
    assert whole["num_merged_tokens"] == 50 and whole["component_analysis"]
    sizes = {int(s) for s in whole["component_analysis"]}
    assert all((tmp_path / f"component_analysis_size{s}").is_dir() for s in sizes)
    assert spark.read.csv(f"{tmp_path}/token_length_distribution", header=True).count() == 1 + len(sizes)


def test_ids_of_a_larger_model(spark, tmp_path):
    model = spark.createDataFrame([(0, "a"), (1, "[PAD]")], "id long, token string")
    ours = spark.createDataFrame([(0, "[UNK]"), (1, "[PAD]"), (2, "x"), (3, "y")], "id long, token string")
    ids = artifacts.extended_ids(ours, model)
    assert {r.token: r.new_id for r in ids.collect()} == {"[UNK]": 2, "[PAD]": 1, "x": 3, "y": 4}
    stream = spark.createDataFrame([(1, 3), (0, 2)], "at long, id long")
    assert [(r.at, r.id) for r in artifacts.with_new_ids(stream, ids).orderBy("at").collect()] == [(0, 3), (1, 4)]
    windows = spark.createDataFrame([([1, 2],), ([1],)], "ids array<int>")
    artifacts.write_windows(windows, str(tmp_path), {"size": 2})
    assert artifacts.read_windows(spark, str(tmp_path), {"size": 2}, 2).count() == 1
    assert artifacts.read_windows(spark, str(tmp_path), {"size": 3}) is None


def test_sweeps_side_by_side(spark):
    a = spark.createDataFrame([("onset", 1, 2.0), ("onset", 2, None), ("velocity", 8, 3.0)], "factor string, sweep_value long, compression_factor double")
    b = spark.createDataFrame([("onset", 1, 1.5), ("onset", 2, 1.6)], a.schema)
    got = sorted((tuple(r) for r in S.against(a, b).collect()), key=str)
    assert got == [("onset", 1, 2.0, 1.5), ("onset", 2, None, 1.6), ("velocity", 8, 3.0, None)]


def test_sweep_words_like_each_grid_by_itself(spark):
    raw = notes_from_events(spark.read.parquet(f"{SMALL}/events.parquet"))
    got = {(r.grp, r.word): r.n for r in S.sweep_words(raw).collect()}
    for grp, field, fine, coarse in (("onset|001", "t", 1, 1), ("onset|020", "t", 1, 20), ("duration|005", "d", 1, 5), ("velocity|032", "v", 128, 32)):
        n = corpus.coarsened(N.notes(raw, corpus.fine_grid(field, fine)), field, fine, coarse)
        want = {r.word: r.n for r in corpus.counted(corpus.words_of(corpus.with_indices(n, corpus.vocabulary(n)))).collect()}
        assert {w: k for (g, w), k in got.items() if g == grp} == want, grp


def test_counted_notes_give_the_words_of_all_notes(spark, small, monkeypatch):
    n, vocab = small
    for standalone in (False, True):
        want = {r.word: r.n for r in corpus.counted(corpus.words_of(corpus.with_indices(n, vocab), standalone)).collect()}
        twice = []
        monkeypatch.setattr(catalogue, "notes", lambda s, d: twice.append(1) or N.notes(notes_from_events(s.read.parquet(f"{d}/events.parquet"))))
        words, own = catalogue.note_words(spark, SMALL, standalone)
        got = [(r.word, r.n) for r in words.select("word", "n").collect()]
        assert len(got) == len(want) and dict(got) == want and own.exceptAll(vocab.select(own.columns)).count() == 0
        plan = words._jdf.queryExecution().toString()
        assert len(twice) == 1 and "Window" not in plan
    # Two notes that are the same in different files are one row.
    same = spark.createDataFrame([(f, 1, 2, 3, 4, 5) for f in (1, 2)], "file_id long, t long, d long, p long, i long, v long")
    assert [tuple(r) for r in corpus.counted_notes(same).collect()] == [(1, 2, 3, 4, 5, 2)]


def test_sweep_counts_notes_before_it_coarsens_them(spark, monkeypatch):
    raw = notes_from_events(spark.read.parquet(f"{SMALL}/events.parquet"))
    twice, kept, settled = raw.unionByName(raw.withColumn("file_id", F.col("file_id") + 1_000_000)), [], S.settled
    monkeypatch.setattr(S, "settled", lambda df: kept.append(settled(df)) or kept[-1])
    one, two = ({(r.grp, r.word): r.n for r in S.sweep_words(x, standalone=True).collect()} for x in (raw, twice))
    assert two == {k: 2 * n for k, n in one.items()}
    assert kept[0].count() == kept[2].count()  # copies of a note are one row from there on
    n = corpus.coarsened(N.notes(raw, corpus.fine_grid("d", 1)), "d", 1, 10)
    want = {r.word: r.n for r in corpus.counted(corpus.words_of(corpus.with_indices(n, corpus.vocabulary(n)), True)).collect()}
    assert {w: k for (g, w), k in one.items() if g == "duration|010"} == want


def test_training_counts_what_stands_after_all_merges(spark, monkeypatch):
    words = many_words(700, 30, seed=4) | {"[000001]" * 7: 3, "[000099]": 2}
    df = counted(spark, sorted(words.items()))
    with monkeypatch.context() as m:
        m.setattr(merges, "best_pairs", lambda *_: pytest.fail("a round for each merge"))
        alone = merges.trained_one(df, 300)
        together = merges.trained_one(df, 300, most=5)
    assert alone == together and alone[0] == merges.merges_of(list(words), list(words.values()), 300)
    want = {r.sym: r.n for r in analysis.frequencies(merges.encoded(df, alone[0])).collect()}
    assert alone[1] == want == {r.sym: r.n for r in analysis.frequency_table(spark, alone[1]).collect()}
    assert merges.trained_one(df.limit(0), 5) == ([], None) and merges.trained_one(df.where("word = '[000099]'"), 5) == ([], {"000099": 2})
    monkeypatch.setattr(merges, "LOCAL_SYMBOLS", 1)
    assert merges.trained_one(df, 3) == (alone[0][:3], None)


def test_a_summary_encodes_no_trained_word_again(spark, monkeypatch):
    want = catalogue.vocab_summary_full(spark, SMALL).collect()
    with monkeypatch.context() as m:
        m.setattr(merges, "encoded", lambda *_: pytest.fail("encoded anew"))
        assert catalogue.vocab_summary_full(spark, SMALL).collect() == want
    monkeypatch.setattr(merges, "trained_one", lambda words, k: (merges.train_one(words, k), None))
    monkeypatch.setattr(merges, "train_one", lambda words, k: merges.train(words.withColumn("grp", F.lit("all")), k)["all"])
    assert catalogue.vocab_summary_full(spark, SMALL).collect() == want

"""Training and encoding against a sequential model and the tokenizers library."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import Whitespace
from tokenizers.trainers import BpeTrainer

from tessera.operators import analysis, decoding, doubling, merges, together
from tessera.operators.corpus import private_use
from tessera.plans import sweep as S
from tessera.sources import files


def counted(spark, words):
    return spark.createDataFrame(words, "word string, n long")


def library(words, k, alphabet):
    t = Tokenizer(BPE(unk_token="[UNK]"))
    t.pre_tokenizer = Whitespace()
    t.train_from_iterator([w for w, n in words for _ in range(n)], BpeTrainer(vocab_size=len(alphabet) + k + 4, special_tokens=list(analysis.SPECIALS), initial_alphabet=alphabet, show_progress=False))
    return t


def test_overlapping_places_merge_from_the_left(spark):
    got = counted(spark, [("[000001][000001][000001]", 1)]).select(merges.applied(F.col("word"), [("000001", "000001", "M00000")]).alias("w")).first().w
    assert got == "[M00000][000001]"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=7), st.integers(1, 5)), min_size=1, max_size=12, unique_by=lambda x: tuple(x[0])))
def test_local_training_like_the_library(words):
    chars = "abcd"
    plain = [("".join(chars[s - 1] for s in w), n) for w, n in words]
    got = merges.merges_of(["".join(f"[{s:06d}]" for s in w) for w, _ in words], [n for _, n in words], 6)
    spelled = analysis.expansions(got)
    text = lambda s: "".join(chars[int(x) - 1] for x in spelled.get(s, [s]))
    model = json.loads(library(plain, 6, list(chars)).to_str())["model"]["merges"]
    # The library doesn't make a token twice; up to the first that would be, both agree.
    mine = [[text(a), text(b)] for a, b, _ in got]
    whole = ["".join(x) for x in mine]
    same = next((k for k in range(len(whole)) if whole[k] in whole[:k]), len(whole))
    assert mine[:same] == model[:same]


def test_distributed_training_like_that_in_one_place(spark):
    rng = random.Random(5)
    words = {"".join(f"[{rng.randint(1, 5):06d}]" for _ in range(rng.randint(1, 6))): rng.randint(1, 9) for _ in range(60)}
    df = counted(spark, sorted(words.items()))
    k = 20
    assert merges.train_one(df, k) == merges.train_one(df, k, most=5)


@pytest.mark.parametrize("often", [9, 1_000_000])
def test_large_groups_are_trained_together_without_a_job_for_each_merge(spark, monkeypatch, often):
    rng = random.Random(often)
    words = {"".join(f"[{rng.randint(1, 9):06d}]" for _ in range(rng.randint(1, 9))): rng.randint(1, 9) for _ in range(400)}
    words |= {"[000001][000002]": often, "[000003]" * 9: 2}  # seldom pairs are below the first floor where one is very frequent
    df = counted(spark, sorted(words.items()))
    one_by_one = lambda *_: pytest.fail("a job for each merge")
    with monkeypatch.context() as m:
        m.setattr(merges, "train_distributed", one_by_one)
        for k in (300, 5000):
            assert merges.train_one(df, k, most=5) == merges.merges_of(list(words), list(words.values()), k)


def test_a_group_too_large_for_all_tasks(spark, monkeypatch):
    rng = random.Random(6)
    words = {"".join(f"[{rng.randint(1, 5):06d}]" for _ in range(rng.randint(2, 6))): rng.randint(1, 9) for _ in range(60)}
    monkeypatch.setattr(merges, "LOCAL_SYMBOLS", 1)
    assert merges.train_one(counted(spark, sorted(words.items())), 19) == merges.merges_of(list(words), list(words.values()), 19)


def test_exported_tokenizer_encodes_like_ours(spark, tmp_path):
    rng = random.Random(7)
    tokens = sorted(f"<x-{i}>" for i in range(12))
    words = {"".join(f"[{rng.randrange(12):06d}]" for _ in range(5)): rng.randint(1, 9) for _ in range(40)}
    df = counted(spark, sorted(words.items()))
    rules = merges.train_one(df, 15)
    text = files.tokenizer_json(tokens, rules)
    assert text.isascii()
    t = Tokenizer.from_str(text)
    rows = merges.encoded(df, rules).select(private_use(F.col("word")).alias("chars"), merges.count_symbols(F.col("enc")).alias("n")).collect()
    assert [len(t.encode(r.chars).ids) for r in rows] == [r.n for r in rows]
    files.write_text(spark, text, f"{tmp_path}/tok")
    vocab, pairs = files.read_tokenizer(spark, f"{tmp_path}/tok")
    assert vocab.count() == t.get_vocab_size() and pairs.count() == len(rules)
    old = json.loads(text)
    old["model"]["merges"] = [" ".join(m) for m in old["model"]["merges"]]
    files.write_text(spark, json.dumps(old), f"{tmp_path}/old")
    assert files.read_tokenizer(spark, f"{tmp_path}/old")[1].orderBy("rank").collect() == pairs.orderBy("rank").collect()


def test_doubling(spark):
    vocab = spark.createDataFrame([("<time-0>", "time", 0), ("<time-1>", "time", 1), ("<time-2>", "time", 2)], "token string, category string, idx long")
    ids = doubling.ids(vocab, [("000000", "000001", "M00000")]).orderBy("id").collect()
    assert [r.id for r in ids] == list(range(16))
    assert [r.kind for r in ids] == ["special"] * 4 + ["base"] * 3 + ["merged"] + ["ctrl_base"] * 3 + ["ctrl_merged"] + ["sentinel"] * 4
    rules = doubling.merge_rules([("000000", "000001", "M00000")], spark).orderBy("rank").collect()
    assert [(r.left, r.is_ctrl) for r in rules] == [("000000", False), ("ctrl:000000", True)]


def test_words_that_are_no_notes_are_left_out(spark):
    vocab = spark.createDataFrame([("<duration-1>", "duration", 0), ("<instrument-0>", "instrument", 1), ("<pitch-5>", "pitch", 2), ("<time-3>", "time", 3), ("<velocity-9>", "velocity", 4)], "token string, category string, idx long")
    good = "[000003][000000][000002][000001][000004]"
    rows = [(1, 0, 0, good), (1, 0, 1, "[000003]"), (1, 0, 2, "[000000][000003][000002][000001][000004]"), (1, 0, 3, good.replace("4]", "9]"))]
    words = spark.createDataFrame(rows, "file_id long, chunk_idx long, pos long, enc string")
    assert [tuple(r) for r in decoding.notes_of(words, vocab, []).collect()] == [(1, 0, 0, 3, 1, 5, 0, 9)]


def test_properties_of_the_ladder(spark):
    rng = random.Random(2)
    words = {"".join(f"[{rng.randint(1, 3):06d}]" for _ in range(rng.randint(2, 6))): rng.randint(1, 9) for _ in range(30)}
    df = counted(spark, sorted(words.items())).withColumn("grp", F.lit("all"))
    rows = merges.evaluate(df, merges.train(df, 6), [0, 2, 4, 6]).orderBy("merges").collect()
    assert rows[0].compression_factor == 1
    assert [r.compression_factor for r in rows] == sorted(r.compression_factor for r in rows)
    assert all(abs(r.reduction_ratio * r.compression_factor - 1) < 1e-12 for r in rows)


def test_knee_and_leverage(spark):
    rows = [("onset", 0, 0.0), ("onset", 1, 0.0), ("onset", 2, 1.0), ("velocity", 8, 2.0), ("velocity", 128, 1.5), ("flat", 1, 1.0), ("flat", 2, 1.0)]
    df = spark.createDataFrame(rows, "factor string, sweep_value long, compression_factor double")
    assert [tuple(r) for r in S.knee(df).collect()] == [("onset", 1)]
    got = {r.factor: (r.leverage, r.at_finest, r.at_coarsest) for r in S.leverage(df).collect()}
    assert got["velocity"] == (0.5, 1.5, 2.0) and got["onset"] == (1.0, 0.0, 1.0)


@pytest.mark.parametrize(("kw", "want"), [({"merges": 10}, [24]), ({"sizes": [5, 30, 20, 20]}, [20, 30]), ({}, [14 + 256 * 2**k for k in range(9)])])
def test_vocabulary_sizes(kw, want):
    assert files.ladder(10, **kw) == want


def test_several_merges_are_named_at_once():
    rng = random.Random(3)
    for large, k in ((together.LARGE, 3000), (0, 300)):
        n_words = 10 * k
        sizes = np.array([rng.randint(0, 8) for _ in range(n_words)])
        s = np.array([int(60 * rng.random() ** 2) for _ in range(sizes.sum())], np.int64)
        n = np.array([rng.randint(1, 9) for _ in range(n_words)])
        cut = int(sizes[: n_words // 2].sum())
        shares = [together.Share(s[:cut].astype(np.int32), sizes[: n_words // 2], n[: n_words // 2]), together.Share(s[cut:].astype(np.int32), sizes[n_words // 2 :], n[n_words // 2 :])]
        counts, got, rounds = together.Counts(together.summed([x.begin() for x in shares]), 1), [], 0
        while len(got) < k and (keys := counts.best(min(k - len(got), together.AT_ONCE))):
            counts.change(together.summed([x.merge_all(keys, together.MADE + len(got)) for x in shares]))
            got += [divmod(q, together.WIDE) for q in keys]
            rounds += 1
        assert got == merges.best_pairs(s, sizes, n, k) and rounds < k / 2, large

"""op3, op9, op10 and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import bpe, decontaminate, pii, quality, queries, topk, toxicity
from test_dedup import plain_components

SMALL = "/root/testdata/sf0.001"

MIDDLE = "/root/testdata/sf0.01"


def fold_of(i, n):
    return zlib.crc32(str(i).encode()) % n


def labels_of(spark, rows):
    return spark.createDataFrame([(i, q, x, "t", 1) for i, q, x in rows], "doc_id long, quality int, toxic int, text string, y int")


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, docs.select("doc_id", "text").join(labels, "doc_id").collect()


def test_folding():
    for x in ("idiot", "IDIOT", "1d10t", "іdіоt", "ïdïöt", "ｉｄｉｏｔ", "!d!0t"):
        assert toxicity.fold(toxicity.cleaned(x)) == toxicity.fold("idiot"), x
    assert len(toxicity.fold("ﬁß日İ")) == 4


def test_matches_and_exceptions():
    of = toxicity.learn([])
    found = lambda t: [t[a:b].lower() for a, b, _ in of.places(t)]
    assert found("You idiot, what a cl0wn") == ["idiot", "cl0wn"]
    assert found("clown fish in the trash can near a trash heap") == ["trash"]
    assert found("nonidiot xtrash") == [] and found("idiot###") == ["idiot"]
    assert of.score("a fine day") < toxicity.THRESHOLD <= of.score("you idiot")
    assert of.score(None) == of.score("")


def test_toxicity_held_out(spark, labelled):
    docs, labels, rows = labelled
    got = {r.doc_id: r for r in toxicity.toxicity(docs, toxicity.toxicity_model(docs, labels)).collect()}
    assert len(got) == docs.count()
    out = [r for r in rows if fold_of(r.doc_id, 4) == 2]
    assert all(got[r.doc_id].held_out for r in out) and sum(x.held_out for x in got.values()) == sum(fold_of(i, 4) == 2 for i in got)
    right = np.mean([got[r.doc_id].predicted == r.toxic for r in out])
    assert right >= 0.93
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())


def test_toxicity_learns_from_its_folds_only(spark, make):
    docs = make([(i, "some words here") for i in range(50)])
    a = toxicity.toxicity_model(docs, labels_of(spark, [(i, 1, 0) for i in range(50)]))
    b = toxicity.toxicity_model(docs, labels_of(spark, [(i, 1, int(fold_of(i, 4) == 2)) for i in range(50)]))
    assert (a.weights, a.curve) == (b.weights, b.curve)


def test_toxicity_of_odd_rows(spark, make, texts):
    docs = make(texts + [(800, "such an idiot"), (801, None)])
    labels = labels_of(spark, [(1, 1, 1), (3, None, None), (None, 1, 1), (99_999, 0, 1), (4, 0, 0), (4, 1, 1)])
    model = toxicity.toxicity_model(docs, labels)
    got = toxicity.toxicity(docs, model)
    assert got.count() == len(texts) + 2 and got.where("held_out is null or score is null").count() == 0
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema == docs.schema and kept.where("doc_id = 800").count() == 0 and kept.count() == len(texts) + 1
    assert toxicity.toxicity(make([]), toxicity.toxicity_model(make([]), labels_of(spark, []))).count() == 0


def test_learned_words_beat_chance():
    rng = random.Random(1)
    words = [f"word{k}" for k in range(200)]
    rows = [(" ".join(rng.choice(words) for _ in range(30)) + (" badword" if y else ""), y) for y in [1] * 30 + [0] * 200]
    of = toxicity.learn(rows)
    assert of.score("a badword b") >= 0.3 > of.score("a goodword b") and of.score("b4dw0rd") >= 0.3


def test_quality_held_out(spark, labelled):
    docs, labels, rows = labelled
    got = {r.doc_id: r for r in quality.quality(docs, quality.quality_model(docs, labels)).collect()}
    assert len(got) == docs.count()
    out = [r for r in rows if fold_of(r.doc_id, 5) == 0]
    assert all(got[r.doc_id].held_out for r in out)
    assert np.mean([got[r.doc_id].predicted == r.quality for r in out]) >= 0.93


def test_quality_of_odd_rows(spark, make, texts):
    docs = make(texts)
    none = quality.quality_model(docs, labels_of(spark, []))
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5}
    assert quality.quality(make([]), none).count() == 0


@pytest.fixture(scope="module")
def net(labelled):
    return quality.learn([(r.text, r.quality) for r in labelled[2][:150]])


def test_network_in_blocks_like_in_one_piece(net):
    rng = np.random.default_rng(2)
    for n in (1, 5, 127, 128, 129, 256, 300, 1000):
        t = bytes(rng.integers(32, 127, n).astype(np.uint8))
        data = np.frombuffer(t + b"\0" * (quality.WIDTH - 1), np.uint8)
        emb = net.w["embed"][data]
        conv = np.maximum(sum(emb[j : j + n] @ net.w["filters"].reshape(quality.WIDTH, quality.EMBEDDED, -1)[j] for j in range(quality.WIDTH)) + net.w["bias"], 0)
        starts = range(0, max(1, -(-n // quality.BLOCK) - 1) * quality.BLOCK, quality.BLOCK)
        parts = [conv[a : a + quality.CHUNK] for a in starts]
        want = [net.head(p.max(0)[None], p.mean(0)[None])[0] for p in parts]
        got, sizes = net.chunk_scores([b"x" * 700, t, b""])
        assert sizes[1] == len(want)
        np.testing.assert_allclose(got[sizes[0] : sizes[0] + sizes[1]], want, rtol=2e-3, atol=2e-3)


def test_network_covers_long_texts(net):
    good, bad = b"plain words of a text, and so on. " * 8000, b"%%% &&& *** $$$ " * 200
    scores, sizes = net.chunk_scores([good + bad, good])
    assert sizes[0] > sizes[1] > 1024 and len(scores) == sizes.sum()
    whole = net.scores([good + bad, good, b"", b"\xff\x00"])
    assert ((whole >= 0) & (whole <= 1)).all()


def embeddings_of(spark, rows):
    return spark.createDataFrame([(i, e, 0, 1, 2) for i, e in rows], "vec_id long, embedding array<float>, label int, shard int, id long").repartition(3)


def plain_top(rows, k=5, every=50):
    fine = [(i, np.floor(256 * np.array([float(np.float32(x)) for x in e]))) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
    out = set()
    for q, e in fine:
        if q % every == 0:
            best = sorted((-dot(e, f), i) for i, f in fine if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return sorted(out)


def got_top(df, **kw):
    return sorted(map(tuple, topk.top_k(df, **kw).select("query_id", "rank", "vec_id", "score").collect()))


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(0, 0.3, 8).tolist()) for k in range(400)]
    rows += [(400 + k, [0.5] * 8) for k in range(300)]  # ties
    rows += [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8), (1200, []), (1250, [1.0, 2.0]), (-50, [-1.0] * 8)]
    assert got_top(embeddings_of(spark, rows)) == plain_top(rows)
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    assert got_top(embeddings_of(spark, rows)) == plain_top(rows)


def test_top_k_of_few(spark):
    assert got_top(embeddings_of(spark, [])) == []
    assert got_top(embeddings_of(spark, [(50, [1.0])])) == []
    assert got_top(embeddings_of(spark, [(50, [1.0]), (1, [2.0]), (2, [2.0])])) == [(50, 1, 1, 131072), (50, 2, 2, 131072)]
    big = [(0, [1e6, 1.0]), (1, [1e6, 2.0]), (2, [1e6, 3.0])]
    assert got_top(embeddings_of(spark, big)) == plain_top(big)
    with pytest.raises(Exception, match="fit a long"):
        got_top(embeddings_of(spark, [(0, [3e7]), (1, [3e7])]))


def test_top_k_like_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    want = sorted(c.execute(f"select query_id, rank, vec_id, score from ({queries.OP9_SQL})").fetchall())
    assert got_top(spark.read.parquet(f"{SMALL}/embeddings.parquet")) == want


@pytest.mark.parametrize("shard_rows", [topk.SHARD_ROWS, 20])
def test_top_k_of_repeated_rows_like_sql(spark, monkeypatch, shard_rows):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(0, 0.3, 4).tolist()) for k in range(120)]
    rows += [(201, [2.0] * 4)] * 3 + [(202, [3.0] * 4)] * 5  # candidates
    rows += [rows[0], rows[50], rows[50], (100, [1.0, -1.0, 0.5, 0.0]), (300, [1.0] * 4)] + [(350, [-1.0] * 4)] * 7  # queries
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    c = duckdb.connect()
    c.execute("create table embeddings (vec_id bigint, embedding float[])")
    c.executemany("insert into embeddings values (?, ?)", rows)
    want = sorted(c.execute(f"select query_id, rank, vec_id, score from ({queries.OP9_SQL})").fetchall())
    assert got_top(embeddings_of(spark, rows)) == want


def test_pipeline_like_a_plain_model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, items = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    model = toxicity.toxicity_model(docs, labels)
    rows = [(i, t) for i, t in rows if model.score(t) < toxicity.THRESHOLD]
    stay = {i for i, _, c in plain_components(rows) if i == c}
    rows = [(i, t) for i, t in rows if i in stay]
    block = decontaminate.Items([(r.item_id, r.text) for r in items])

    def clean(t):
        h, _ = decontaminate.words(t.encode())
        return not list(block.overlaps(h, np.array([0, len(h)])))

    rows = [(i, t) for i, t in rows if clean(t)]
    of, enc = pii.Surrogates(queries.PII_KEY), bpe.encoder(queries.word_tokenizer())
    want = sorted((i, tuple(enc.encode(pii.replaced(t, pii.found(t), of)))) for i, t in rows)
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want and 0 < len(got) < docs.count()


def test_every_stage_takes_odd_rows(spark, make, texts, tmp_path):
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (texts, []):
            out = stage(spark, make(rows), str(tmp_path))
            assert out.columns == make(rows).columns, name
            assert out.count() <= len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, make(texts), str(tmp_path)).count() == len(texts)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "bpe"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    rows = out.collect()
    if name not in ("op7_decontaminate", "op9_topk"):
        source = "pages" if name == "op5_html" else "documents"
        assert len(rows) == spark.read.parquet(f"{SMALL}/{source}.parquet").count()
    assert rows

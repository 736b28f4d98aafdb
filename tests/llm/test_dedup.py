"""op1 and op4 against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import simhash, suffixes
from tessera.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(parts))


def plain_components(rows):
    fps = sorted({plain_fingerprint(t) for _, t in rows})
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, t in rows:
        r = find(plain_fingerprint(t))
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{plain_fingerprint(t):016x}", least.get(find(plain_fingerprint(t)))) for i, t in rows), key=str)


def test_simhash(make, texts):
    got = sorted((tuple(r) for r in simhash.near_duplicates(make(texts)).collect()), key=str)
    assert got == plain_components(texts)


def test_simhash_of_nothing(make):
    assert simhash.near_duplicates(make([])).count() == 0
    assert simhash.representatives(make([])).count() == 0


def test_spark_hash_is_the_contracts(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("the of est"))).first()[0]
    assert h % 2**64 == xxhash.xxh64_intdigest(b"the of est", 42)


@pytest.mark.parametrize("buckets", [1, 7])
def test_links_keep_all_near_pairs_connected(spark, buckets, monkeypatch):
    rng = random.Random(buckets)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    fps = {b for b in base} | {b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (1, 2, 3, 3, 4, 5)}
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    if buckets > 1:
        monkeypatch.setattr(simhash, "BUCKET", len(fps) * 600 // buckets)
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)).distinct().collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in got)
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        root[find(r.a)] = find(r.b)
    near = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) % 2**64).bit_count() <= 3]
    assert near and all(find(a) == find(b) for a, b in near)


def test_components_of_a_chain_a_star_and_a_ring(spark):
    chain = [(k, k + 1) for k in range(1, 40)]
    star = [(100, k) for k in range(101, 160)]
    ring = [(200 + k, 200 + (k + 1) % 30) for k in range(30)]
    got = {r.u: r.v for r in components(spark.createDataFrame([*chain, *star, *ring, (7, 7)], "a long, b long")).collect()}
    assert got == {k: 1 for k in range(2, 41)} | {k: 100 for k in range(101, 160)} | {k: 200 for k in range(201, 230)}


def test_one_row_of_each_group_stays(make, texts):
    docs = make(texts)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    stay = {i for i, _, c in plain_components(texts) if i is not None and i == c}
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(stay)
    assert sum(r.doc_id is None for r in rows) == 2


def plain_removal(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in sorted((x for x in data if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    out = []
    for i, t in data:
        gone = np.zeros(len(t) + 1, bool)
        if i is not None:
            for k in range(len(t) - 49):
                if first[t[k : k + 50]] < i:
                    gone[k : k + 50] = True
        rest = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def removed(docs):
    out = suffixes.remove_repeats(docs)
    cols = [F.expr("aggregate(removed, 0L, (n, x) -> n + x.end - x.start)"), F.size("removed"), F.sha2("kept", 256)]
    return sorted((tuple(r) for r in out.select("doc_id", "n_bytes", *cols).collect()), key=str)


def test_repeats(make, texts):
    short = [(i, t if t is None or len(t) < 20_000 else t[:20_000]) for i, t in texts]
    assert removed(make(short)) == plain_removal(short)
    assert removed(make([])) == []


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_pasted_parts(make, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(suffixes, "BUCKET", 500)
    monkeypatch.setattr(suffixes, "DOCS", 20)
    pool = ["".join(rng.choice("ab cdé") for _ in range(rng.randint(0, 200))) for _ in range(15)] + ["xyz" * 60, "q" * 150, "é" * 80]
    rows = [(rng.randint(-50, 120), "".join(rng.choice(pool)[rng.randint(0, 40) :][: rng.randint(0, 160)] for _ in range(rng.randint(0, 5)))) for _ in range(150)]
    assert removed(make(rows)) == plain_removal(rows)


def test_repeats_around_frequent_anchors(make, monkeypatch):
    rng = random.Random(8)
    line = "this line of more than fifty bytes stands in very many documents."
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(0, 30))) + "\n" + line * rng.randint(0, 2) + "\n" + str(rng.random())) for k in range(150)]
    rows += [(150 + k, "De " * rng.randint(10, 90)) for k in range(20)]
    want = plain_removal(rows)
    docs = make(rows)
    assert removed(docs) == want
    monkeypatch.setattr(suffixes, "FREQUENT", 20)
    monkeypatch.setattr(suffixes, "SAMPLED", 2)
    monkeypatch.setattr(suffixes, "DOCS", 20)
    own = docs.select("doc_id", "text")
    often = suffixes.frequent(own, len(rows), 10**6)
    assert 0 < len(often)
    assert removed(docs) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=50, max_size=140), min_size=1, max_size=6))
def test_classes_of_suffixes(parts):
    t = np.concatenate([np.append(np.frombuffer(p.encode(), np.uint8) + 1, 0).astype(np.uint8) for p in parts])
    of, place = suffixes.classes(t)
    data = t.tobytes()
    starts = [k for k in range(len(data) - 49) if 0 not in data[k : k + 50]]
    groups = {}
    for k in starts:
        groups.setdefault(data[k : k + 50], set()).add(int(of[place[k]]))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_columns_survive_packing():
    rng = np.random.default_rng(1)
    for n in (1, 500):
        cols = {"doc": rng.integers(-5, 5, n), "mark": rng.integers(0, 3, n), "anchor": rng.integers(0, 2**63, n).astype(np.uint64), "same": rng.integers(0, 2**63, n).astype(np.uint64), "at": rng.integers(0, 2**31, n), "count": rng.integers(0, 200, n)}
        got, extra = suffixes.unpacked([suffixes.packed(cols, b"rest")] * 2, suffixes.SEGMENT)
        assert all((got[k].astype(object) == np.concatenate([v, v]).astype(object)).all() for k, v in cols.items()) and extra == [b"rest"] * 2

"""Literal cases of quantization, chunking, rests and sequences; sets against a sequential model."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import quantize as Q
from tessera.functions.quantize import Grid
from tessera.operators import anticipation as A
from tessera.operators import corpus, merges, windows
from tessera.operators import notes as N
from tessera.sources.notes import notes_from_events, number_at_k

SMALL = "/root/testdata/sf0.001"
FIVE = ["t", "d", "p", "i", "v"]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(("x", "y"), [(0.5, 0), (1.5, 2), (2.5, 2), (3.5, 4)])
def test_half_even(spark, x, y):
    assert one(spark, Q.half_even(F.lit(x))) == y


@pytest.mark.parametrize(("sec", "steps"), [(0.0, 1), (0.004, 1), (12.0, 1000)])
def test_duration(spark, sec, steps):
    assert one(spark, Q.duration_steps(F.lit(sec), Grid())) == steps


@pytest.mark.parametrize(("v", "b"), [(1, 0), (64, 16), (127, 31)])
def test_velocity(spark, v, b):
    assert one(spark, Q.velocity_bin(F.lit(v).cast("long"), Grid(vel_bins=32))) == b


def test_names_and_steps():
    assert Grid().name == "onset-10ms_duration-10ms_velocity-128bin"
    assert Grid(onset_ms=0.5).name.startswith("onset-0.5ms")
    assert (Grid().chunk_steps, Grid().lead_steps, Grid().rest_steps, Grid().max_duration) == (10_000, 500, 100, 1000)


def test_categories(spark):
    rows = spark.createDataFrame([("<time-10>",), ("ctrl_pitch-3",), ("ctrl_x",), ("zzz",)], "tok string").select(Q.category_of(F.col("tok")).alias("c"), Q.value_of(F.col("tok")).alias("v")).collect()
    assert [r.c for r in rows] == ["time", "ctrl_pitch", "ctrl_unknown", "unknown"]
    assert [r.v for r in rows] == [10, None, None, None]


def quantized(spark, rows):
    return spark.createDataFrame([(f, o, t, 1, p, i, 64) for f, o, t, p, i in rows], "file_id long, ord long, t long, d long, p long, i long, v long")


def test_chunks_begin_at_zero_and_ties_keep_the_order(spark):
    q = quantized(spark, [(1, 0, 9999, 5, 0), (1, 1, 10_000, 6, 0), (1, 2, 500, 9, 0), (1, 3, 700, 9, 0), (1, 4, 700, 9, 0), (1, 5, 700, 2, 0), (1, 6, 30_500, 1, 1)])
    got = [tuple(r) for r in N.chunked(q, Grid()).orderBy("chunk_idx", "pos").select("chunk_idx", "pos", "ord", "t").collect()]
    assert got == [(0, 0, 2, 0), (0, 1, 5, 200), (0, 2, 3, 200), (0, 3, 4, 200), (0, 4, 0, 9499), (1, 0, 1, 0), (2, 0, 6, 0)]


def test_vocabulary_follows_code_points(spark):
    n = quantized(spark, [(1, 0, 10, 1, 0), (1, 1, 2, 1, 0)])
    tokens = [r.token for r in corpus.vocabulary(n).orderBy("idx").collect()]
    assert tokens == sorted(tokens) and tokens.index("<time-10>") < tokens.index("<time-2>")


def test_private_use(spark):
    words = spark.createDataFrame([("[000000][006399][006400][071935][071936][137471]",)], "word string")
    got = words.select(corpus.private_use(F.col("word")).alias("x")).first().x
    assert got == "".join(Q.private_character(i) for i in (0, 6399, 6400, 71_935, 71_936, 137_471))
    assert [hex(ord(c)) for c in got] == ["0xe000", "0xf8ff", "0xf0000", "0xfffff", "0x100000", "0x10ffff"]
    with pytest.raises(ValueError):
        Q.private_character(137_472)


def modelled(chunk, grid):
    """Rests and controls one after another, as a player would meet them."""
    r, lead = grid.rest_steps, grid.lead_steps
    slots, before = [], 0
    for n in [x for x in chunk if not x[-1]]:
        while n[0] > before + r:
            before += r
            slots.append((before, "REST", None))
        slots.append((n[0], "EVENT", n[2]))
        before = n[0]
    while chunk[-1][0] > before + r:
        before += r
        slots.append((before, "REST", None))
    out, wait, clock = [("SEPARATOR", None)], [x for x in chunk if x[-1]], 0
    for time, kind, pitch in slots:
        while wait and clock >= wait[0][0] - lead:
            out.append(("CONTROL", wait.pop(0)[2]))
        clock = time
        out.append((kind, pitch))
    return out + [("CONTROL", x[2]) for x in wait]


def test_sequences_like_the_sequential_model(spark):
    rng, rows, chunks = random.Random(3), [], {}
    for f in range(80):
        times = sorted(rng.choice([0, rng.randrange(3000)]) for _ in range(rng.randint(1, 14)))
        share = rng.choice([0.0, 0.3, 0.7, 1.0])
        chunk = [(t, 1, k, 0, 1, rng.random() < share) for k, t in enumerate(times)]
        chunks[f] = chunk
        rows += [(f, 0, k, k, *x) for k, x in enumerate(chunk)]
    n = spark.createDataFrame(rows, "file_id long, chunk_idx long, pos long, ord long, t long, d long, p long, i long, v long, is_control boolean")
    got = {}
    for r in A.sequence(n, Grid()).orderBy("file_id", "seq").collect():
        got.setdefault(r.file_id, []).append((r.kind, r.p))
    assert got == {f: modelled(c, Grid()) for f, c in chunks.items()}


class Sparse(Grid):
    """With a rest every 10 seconds only."""

    rest_steps = 1000


def simple(spark, events, controls):
    rows = sorted([(t, False) for t in events] + [(t, True) for t in controls])
    n = spark.createDataFrame([(1, 0, k, k, t, 1, k, 0, 1, c) for k, (t, c) in enumerate(rows)], "file_id long, chunk_idx long, pos long, ord long, t long, d long, p long, i long, v long, is_control boolean")
    return [(r.kind, r.t) for r in A.sequence(n, Sparse()).orderBy("seq").collect() if r.kind != "REST"][1:], n


def test_rests_fill_gaps(spark):
    _, n = simple(spark, [0, 100, 301], [])
    assert [r.time for r in A.padded(n, Grid()).where("kind = 'REST'").orderBy("time").collect()] == [200, 300]


def test_controls_stand_ahead(spark):
    assert simple(spark, [0, 600], [1000])[0] == [("EVENT", 0), ("EVENT", 600), ("CONTROL", 1000)]
    assert simple(spark, [0, 600], [500])[0] == [("CONTROL", 500), ("EVENT", 0), ("EVENT", 600)]


def test_spans_fold_like_a_loop(spark):
    grid, rng = Grid(), random.Random(1)
    rows = [(f, 0, k, t) for f in range(10) for k, t in enumerate(sorted(rng.randrange(4000) for _ in range(30)))]
    n = spark.createDataFrame(rows, "file_id long, chunk_idx long, pos long, t long")
    u = n.withColumn("u", (F.pmod(F.xxhash64(F.lit(0), "file_id", "chunk_idx", "pos"), F.lit(1 << 52)) + 0.5) / float(1 << 52)).orderBy("file_id", "pos").collect()
    want = {}
    for f in range(10):
        inside, end, nxt, spans = True, 0, 0, []
        for r in (x for x in u if x.file_id == f):
            if inside and r.t >= end:
                inside, nxt = False, r.t + A.gap(r.u)
            if not inside and r.t >= nxt:
                inside, end = True, r.t + grid.lead_steps
                spans.append((r.t, end))
        want[f] = spans
    got = {r.file_id: [(s.a, s.b) for s in r.spans] for r in A.sampled_spans(n, grid).collect()}
    assert got == want and any(want.values())


def test_shards_are_dealt_evenly(spark):
    rows = windows.shards(spark.range(103).withColumnRenamed("id", "file_id"), 4, 2).collect()
    assert sorted(r.place for r in rows) == list(range(103))
    assert {(r["rank"], r.worker) for r in rows} == {(a, b) for a in range(4) for b in range(2)}


def test_inverse_of_quantization(spark):
    q = quantized(spark, [(1, 0, 120, 60, 128)]).withColumn("chunk_idx", F.lit(0)).withColumn("pos", F.lit(0))
    r = N.inverse(q, Grid()).first()
    assert (r.start_sec, r.end_sec, r.pitch, r.program, r.is_drum, r.velocity) == (1.2, 1.21, 60, 0, True, 64)


def test_empty_notes(spark):
    n = N.chunked(quantized(spark, []), Grid())
    assert corpus.vocabulary(n).count() == 0
    assert A.sequence(A.by_rate(n, 3), Grid()).count() == 0
    assert merges.train_one(spark.createDataFrame([], "word string, n long"), 3) == []


def test_numbers_at_k_like_the_parser_of_json(spark):
    odd = ["76", "0", "-5", "-0", "007", "+5", " 5", "5 ", '"5"', "5}", "null", '5, "j": 1', "9223372036854775807", "", "-"]
    rows = [(f'{{"k": {x}}}',) for x in odd] + [('{"k":5}',), ('{"j": 1, "k": 9}',), ('x"k": 5}',), ("{}",), ("",), (None,)]
    df = spark.createDataFrame(rows, "props string")
    got = df.select(number_at_k(F.col("props")).alias("a"), F.get_json_object("props", "$.k").cast("long").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and [r.a for r in got[:3]] == [76, 0, -5]


def test_events_are_numbers_where_they_are_sorted(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    below = notes_from_events(events)._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1]
    assert "props" not in below.split("Project", 1)[0] and below.index("Project") < below.index("get_json_object")

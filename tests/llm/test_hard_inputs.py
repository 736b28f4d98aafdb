"""What went wrong once: bytes that stand for ends, repetitive texts, malformed markup, several texts of an id."""

import random
import time

import pyarrow as pa
import pytest
from test_dedup import plain_removal, removed
from test_text import plain_overlap

from tessera.llm import common, components, decontaminate, html_text, simhash, suffixes, toxicity

# op4.


def test_repeats_of_any_bytes(make, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(suffixes, "BUCKET", 500)
    for low in (0, 0, 1):
        some = "".join(map(chr, range(low, 128)))
        pool = ["".join(rng.choice(some) for _ in range(120)) for _ in range(6)] + ["\0" * 90, "\x7f" * 70, "a\0b\0" * 30]
        rows = []
        for k in range(80):
            parts = [rng.choice(pool) for _ in range(rng.randint(1, 4))]
            # A NUL instead of one byte, so that strings are equal up to it and differ behind.
            rows.append((k, "".join(x[: (p := rng.randrange(len(x)))] + rng.choice("\0\x01b") + x[p + 1 :] if rng.random() < 0.6 else x for x in parts)))
        assert removed(make(rows)) == plain_removal(rows)


# op5.


def plain_main_lines(rows):
    """Window by window, with lists and loops only."""
    plain = [x.plain for x in rows]
    if not any(plain):
        plain = [len(x.text) for x in rows]
    hints = [x.hints + (any(y.inside for y in rows) and not x.inside) for x in rows]
    mass = {}
    for n, h in zip(plain, hints, strict=True):
        mass[h] = mass.get(h, 0) + n * html_text.HINT**h
    level = min(h for h in mass if mass[h] == max(mass.values()))
    weight = [n if h <= level else 0 for n, h in zip(plain, hints, strict=True)]
    if not any(weight):
        return []
    article = any(x.inside and w for x, w in zip(rows, weight, strict=True))
    threshold = 0 if article else html_text.RISE * sum(w * w for w in weight) / sum(weight)
    out, begun = [], None
    for k in range(len(rows) + 1):
        high = k < len(rows) and sum(weight[k : k + html_text.WINDOW]) > threshold
        if high and begun is None:
            begun = k
        if not high and begun is not None:
            inner = list(range(begun, k))
            while inner and not (weight[inner[0]] > threshold / html_text.WINDOW or weight[inner[0]] and rows[inner[0]].heading):
                inner.pop(0)
            while inner and not weight[inner[-1]]:
                inner.pop()
            out += [j for j in inner if hints[j] <= level]
            begun = None
    return out


def random_page(rng):
    word = lambda: rng.choice(["News", "text of some words", "Home", "a line that is rather long and goes on for a while, as sentences do", "x"])
    out = []
    for _ in range(rng.randint(1, 25)):
        t = " ".join(word() for _ in range(rng.choice([1, 1, 2, 12])))
        out.append(rng.choice([f"<p>{t}", f"<p>{t}</p>", f"<div class=ad>{t}</div>", f"<li><a href=x>{t}</a></li>", f"<h2>{t}</h2>", f"<p>{t} <a href=y>{word()}</a></p>", f"<form>{t}</form>", f"<article><p>{t}</article>", f"<span class=menu>{t}</span>"]))
    return "".join(out)


def test_windows_like_loops():
    rng = random.Random(4)
    decided = 0
    for _ in range(1500):
        rows = html_text.lines(random_page(rng))
        got = html_text.main_lines(rows)
        assert got == plain_main_lines(rows)
        if got:  # what hints alone would give
            level = max(rows[k].hints for k in got)
            decided += len(got) < sum(x.hints <= level and (not any(y.inside for y in rows) or x.inside) for x in rows)
    assert decided > 200


LONG = "Words of a paragraph that is long enough to be one. " * 12


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<form><p>{LONG}<p>{LONG}</form>", [LONG, LONG]),
        (f'<div class="left-side"><article><p>{LONG}</p></article></div><div class=footer>Imprint</div>', [LONG]),
        (f"<ul><li>Home<li>News<li>Sports</ul><h2>Title</h2><p>{LONG}<p>{LONG}<p>Contact", ["Title", LONG, LONG]),
        (f"<ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>Sport</a><li><a href=4>More</a></ul><p>{LONG}", [LONG]),
        (f"<p>{LONG}<div class=ad>buy</div><div class=ad>buy</div><div class=ad>buy</div><div class=ad>buy</div><p>A closing paragraph, not long at all.", [LONG, "A closing paragraph, not long at all."]),
        (f"<article><h1><a href=x>Title</a></h1><p>{LONG}<p>Bye.<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></article>", ["Title", LONG, "Bye."]),
        (f"<p>{LONG}<p><a href=x>A link that stands alone</a><p>{LONG}", [LONG, "A link that stands alone", LONG]),
        ("<a href=x>only links</a>", ["only links"]),
        (f"<article><p>Text <span class=ad>buy now</span> goes on.<p>{LONG}</article>", ["Text", "goes on.", LONG]),
        (f"<div class=comments><p>{LONG}<p>{LONG}</div><article><p>{LONG[:100]}</article>", [LONG[:100]]),
    ],
)
def test_main_text_of_hinted_and_unmarked_pages(page, text):
    assert html_text.main_text(page).split("\n") == [x.strip() for x in text]


def test_malformed_markup_costs_no_more():
    began = time.perf_counter()
    for page in ("<a " + '"' * 10_000, "<a " * 20_000, '<p x="' * 20_000, "<!" * 50_000, "<script " + "\"'" * 20_000, "<" * 100_000, "<b>" * 5_000 + "</i>" * 5_000, "&" * 100_000):
        html_text.main_text(page + "<p>text")
    assert time.perf_counter() - began < 5
    assert html_text.main_text('<p x="y>one</p><p>two</p>').endswith("one\ntwo")


# op3 and op7.


def test_exceptions_like_every_pair():
    rng = random.Random(3)
    of = toxicity.Lexicon({"aa": 1.0, "bb": 1.0, "ab ba": 1.0}, {"aa bb": 1, "bb aa bb": 1, "ab": 1})
    for _ in range(300):
        t = " ".join(rng.choice(["aa", "bb", "ab", "ba", "aab"]) for _ in range(rng.randint(0, 12)))
        places = of.places(t)
        alone = toxicity.Lexicon(of.weights)
        spared = [(k, k + len(p)) for p in of.harmless for k in range(len(t)) if t.startswith(p, k) and not (k and t[k - 1].isalnum()) and not t[k + len(p) : k + len(p) + 1].isalnum()]
        assert places == [(s, e, w) for s, e, w in alone.places(t) if not any(a <= s and e <= b for a, b in spared)]


def test_repetitive_texts_cost_no_more():
    of = toxicity.learn([])
    began = time.perf_counter()
    assert len(of.places("stupid trash can " * 50_000)) == 50_000
    items = decontaminate.Items([(1, "the " * 200), (2, "a b " * 100)])
    got = decontaminate.overlaps_of(items, pa.array(["the " * 100_000, "a b " * 50_000, "the cat " * 50_000]))
    assert got == [(0, 0, 200, 0, 199), (1, 1, 200, 0, 199)]
    assert time.perf_counter() - began < 8


@pytest.mark.parametrize(("many", "at_once"), [(0, 7), (40, 100), (50_000, 1_000_000)])
def test_overlaps_like_brute_force(monkeypatch, many, at_once):
    rng = random.Random(many)
    monkeypatch.setattr(decontaminate, "MANY", many)
    monkeypatch.setattr(decontaminate, "AT_ONCE", at_once)
    for _ in range(40):
        words = [f"w{k}" for k in range(rng.choice([1, 2, 3, 30]))]
        items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(8, 30)))) for k in range(4)]
        docs = []
        for _ in range(5):
            w = [rng.choice(words) for _ in range(rng.randint(0, 50))]
            at = rng.randint(0, len(w))
            w[at:at] = [x if rng.random() > 0.15 else "zz" for x in rng.choice(items)[1].split()]
            docs.append(" ".join(w))
        got = {(d, i) for d, i, *_ in decontaminate.overlaps_of(decontaminate.Items(items), pa.array(docs))}
        # Seeds find every pair with at most a fifth replaced; what they find is an overlap.
        want = {(d, i) for d, t in enumerate(docs) for i, (_, x) in enumerate(items) if plain_overlap(t, x)}
        assert got <= want
        assert got == want or len(words) < 30


# op1.


def test_rows_of_one_id(make):
    a, b, c = ("one text of some words here", "quite another text that has other words", "a third text with nothing in common at all")
    rows = [(5, a), (20, a), (20, b), (20, c), (20, c), (30, b), (7, None), (7, "")]
    kept = [simhash.representatives(make(rows, parts)).select("doc_id", "text").collect() for parts in (1, 4, 7)]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1])) == sorted(map(str, kept[2]))
    texts = {r.doc_id: r.text for r in kept[0]}
    assert set(texts) == {5, 7, 20} and texts[5] == a and texts[20] in (b, c)  # not a, a copy of 5's


def test_hubs_are_joined_as_tables(spark):
    links = spark.createDataFrame([(1, k) for k in range(2, 3000)] + [(k, k + 1) for k in range(5000, 5020)], "a long, b long")
    got = {r.u: r.v for r in components.components(links).collect()}
    assert got == {k: 1 for k in range(2, 3000)} | {k: 5000 for k in range(5001, 5021)}


def test_a_shared_folder_is_needed_off_one_machine(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Elsewhere:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Elsewhere())
    assert common.shared_dir(spark)


def test_samples_are_bounded_by_characters(spark, make):
    docs = make([(k, "x" * 100) for k in range(1, 50)])
    labels = spark.createDataFrame([(k, 1) for k in range(1, 50)], "doc_id long, toxic int")
    assert len(common.labelled_sample(docs, labels, "toxic", 1, 5, 30, 10**6)) == 30
    assert len(common.labelled_sample(docs, labels, "toxic", 1, 5, 30, 1050)) == 10

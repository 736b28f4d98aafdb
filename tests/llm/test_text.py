"""op2, op5, op6, op7 and op8 against libraries, brute force, SQL and literal cases."""

import itertools
import random
import re
import textwrap

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, decontaminate, html_text, licenses, pii
from tessera.llm.queries import word_tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_tokenizer())


ODD = ["Hello world's it'll <|endoftext|> x<|startoftext|>y", "ΑΣ ΣΑΣ İstanbul ǅ ﬁ é ² Ⅷ ٣ 한국어", "a\x1cb\x1dc\x85d e​", "<|endoftext", "<|endoftext|><|endoftext|>", "thethethethe" * 20, "''s 'sx I'M YOU'LL", "é"]


def test_bpe_like_the_library(make, texts, library):
    rows = texts + [(1000 + k, t) for k, t in enumerate(ODD)]
    got = {(r.doc_id, tuple(r.ids), r.decoded) for r in bpe.bpe_encode_decode(make(rows), word_tokenizer()).collect()}
    want = {(i, tuple(ids), library.decode(list(ids), skip_special_tokens=False)) for i, t in rows for ids in [library.encode(t or "", add_special_tokens=False).ids]}
    assert got == want
    assert bpe.bpe_encode_decode(make([]), word_tokenizer()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("aehinorst 'sltdm!?.12"), st.sampled_from("ΣσßİДж日本🎉́")), max_size=60))
def test_bpe_of_any_text(text):
    t = Tokenizer.from_file(word_tokenizer()) if not hasattr(test_bpe_of_any_text, "t") else test_bpe_of_any_text.t
    test_bpe_of_any_text.t = t
    of = bpe.encoder(word_tokenizer())
    ids = t.encode(text, add_special_tokens=False).ids
    assert of.encode(text) == ids
    assert of.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_bpe_of_many_small_files(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(500).repartition(9 * cores).selectExpr("id as doc_id", "concat('word ', id) as text")
    got = bpe.bpe_encode_decode(rows, word_tokenizer())
    assert got.rdd.getNumPartitions() <= 2 * cores and got.select("doc_id").distinct().count() == got.count() == 500


def test_bpe_keeps_few_words(monkeypatch, library):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 3)
    of = bpe.Encoder(open(word_tokenizer(), encoding="utf-8").read())
    for t in ("one two three four", "five six seven", "one nine ten eleven"):
        assert of.encode(t) == library.encode(t, add_special_tokens=False).ids


PAGES = [
    ("", ""),
    (None, ""),
    ("no markup at all", "no markup at all"),
    ("<p>a<p>b <b>c</b>d", "a\nb cd"),
    ("<header><h1>Site</h1></header><main><header><h1>T</h1></header><p>x &amp; y&nbsp;z</p><form><p>q</p></form></main><footer>f", "T\nx & y z"),
    ("<nav><ul><li>m</ul></nav><div class='ad'>buy</div><article><h1>Head</h1><p><b>One.<br><p>Two\n  three</p><div class='ad box'>buy</div><p>Four</article><div id=comments><p>nice</p></div>", "Head\nOne.\nTwo three\nFour"),
    ("<script>var x='<p>no</p>'</script><style>p{}</style><p>yes</p><!-- no", "yes"),
    ('<p title="a>b">q</p><p>5 < 6 and "x</p>', 'q\n5 < 6 and "x'),
    ("<article><p>main</p><section class=comments><article><p>reader</p></article></section></article>", "main"),
    ("<div class=cookie-notice>We use cookies</div><div><p>" + "text " * 50 + "</p></div><div class=sidebar><p>links</p></div>", ("text " * 50).strip()),
    ("<<>><p>&#x41;&bogus;</p></div></p>", "A&bogus;"),
]
OPEN_PAGES = [
    ('<body><p class="notice">Note<p>First <article><p>Article text<p>More</article></body>', "Article text\nMore"),
    ('<div><p class="notice">Note</div><div><p>One<p>Two</div>', "One\nTwo"),
    ('<p class=notice>Note<div>Text</div>', "Text"),
    ('<ul><li class=ad>buy<li>one <b>item<li>two</ul>', "one item\ntwo"),
    ('<ul><li class=ad>buy<ul><li>buy more</ul>and more<li>two</ul>', "two"),
    ('<ul><li>one<li class=ad>buy</ul><p>after', "one\nafter"),
    ('<dl><dt class=ad>buy<dd>text<dt>term<dd class=ad>sell</dl>after', "text\nterm\nafter"),
    ('<table><tr class=ad><td>buy<td>sell<tr><td>one<td class=ad>x<td>two</table><p>after', "one\ntwo\nafter"),
    ('<table><tr><td class=ad>buy<table><tr><td>in<td>ner</table>sell<tbody><tr><td>row</table>', "row"),
    ('<div><table class=ad><tr><td>buy</div><td>sell</table>text</div>', "text"),
    ("<html><head><meta charset=x><body><p>text</html>", "text"),
    ('<article><p class=notice>Note</article><article><p>Text</article>', "Text"),
]


@pytest.mark.parametrize(("page", "text"), OPEN_PAGES)
def test_main_text_where_end_tags_are_left_out(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    got = html_text.main_text(page)
    assert got == text or page and page.startswith("<<>>") and got.endswith("A&bogus;")


def test_pages(spark):
    rows = [(k, f"http://x/{k}", p, "clash", k) for k, (p, _) in enumerate(PAGES)] + [(None, None, "<p>" + "long " * 100_000, None, 0), (1, None, PAGES[5][0], None, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long").repartition(3)
    got = html_text.extract(df).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == 5 * 100_000 - 1
    assert html_text.extract(df.limit(0)).count() == 0


KEY = b"k"
PRIVATE = "Mrs Anna Schmidt wrote to anna.09@mail.example.com; Schmidt's card 4111 1111 1111 1111, phone +1 (640) 555-0953 or +1 640 555 0953, host 129.45.227.94, ssn 123-45-6789, token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8aa\"."


def test_what_is_found():
    kinds = [k for *_, k in pii.found(PRIVATE)]
    assert kinds == ["name", "name", "email", "name", "card", "phone", "phone", "ip", "ssn", "secret"]
    for clean in ("4417744280351546", "1.2.3", "300.1.2.3", "version 1.2.3.4.5", "no one @ home", "CC BY-NC 4.0", "2024-01-30", "12345678", "onstthanreaninghethsandsoonandon"):
        assert pii.found(clean) == [], clean


def test_surrogates_keep_type_and_coreference():
    of = pii.Surrogates(KEY)
    got = pii.replaced(PRIVATE, pii.found(PRIVATE), of)
    assert [k for *_, k in pii.found(got)] == [k for *_, k in pii.found(PRIVATE)]
    new = [got[s:e] for s, e, _ in pii.found(got)]
    old = [PRIVATE[s:e] for s, e, _ in pii.found(PRIVATE)]
    assert all(a != b for a, b in zip(old, new, strict=True)) and [len(x) for x in new[:5]] == [len(x) for x in old[:5]]
    assert new[1] == new[3] and new[0][-1] == "a"
    assert re.sub(r"\D", "", new[5]) == re.sub(r"\D", "", new[6])
    assert of.of("name", "Анна")[-1] == "а" and not of.of("name", "Анна").isascii()
    assert of.of("email", "A.b@X.org").lower() == of.of("email", "a.B@x.org").lower()
    assert pii.Surrogates(b"other").of("ssn", "123-45-6789") != of.of("ssn", "123-45-6789")


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Señora María del Carmen García López spoke; García agreed", ["María", "Carmen", "García", "López", "García"]),
        ("Mrs Anna van der Berg, and Berg again", ["Anna", "Berg", "Berg"]),
        ("Dr. J. Smith and Smith", ["J", "Smith", "Smith"]),
        ("Mr J.R.R. Tolkien", ["J", "R", "R", "Tolkien"]),
        ("Mr. O'Brien and O’Brien", ["O'Brien", "O’Brien"]),
        ("Mr Smith's dog", ["Smith"]),
        ("Herr von Goethe", ["Goethe"]),
        ("Herr Dr. Müller", ["Müller"]),
        ("Mme d'Artagnan", ["Artagnan"]),
        ("Mr Smith went to Paris. The end", ["Smith"]),
        ("Господин Иванов пришёл в Москву", ["Иванов"]),
    ],
)
def test_whole_names_behind_titles(text, names):
    spans = pii.found(text)
    assert [text[s:e] for s, e, _ in spans] == names
    got = pii.replaced(text, spans, pii.Surrogates(KEY))
    assert not any(re.search(rf"(?<!\w){n}(?!\w)", got) for n in names)


@pytest.mark.parametrize(
    "same",
    [
        ("+44 20 7946 0958", "+442079460958", "+44 (20) 7946-0958"),
        ("+1 (974) 555-3436", "+1 974 5553436", "+19745553436", "(974) 555-3436", "974-555-3436"),
        ("+353 1 234 5678", "+35312345678"),
    ],
)
def test_phones_in_any_format_are_one(same):
    of = pii.Surrogates(KEY)
    assert all([k for *_, k in pii.found(x)] == ["phone"] and pii.found(x)[0][:2] == (0, len(x)) for x in same)
    digits = [re.sub(r"\D", "", of.of("phone", x)) for x in same]
    assert len({d[-10:] for d in digits}) == 1 and digits[0][-10:] != re.sub(r"\D", "", same[0])[-10:]
    assert re.sub(r"\d", "", of.of("phone", same[0])) == re.sub(r"\d", "", same[0])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(2, 4), min_size=1, max_size=5))
def test_permutations_have_no_fixed_point(bases):
    of, n = pii.Surrogates(KEY), int(np.prod(bases))
    seen = set()
    for x in range(n):
        digits = []
        for b in reversed(bases):
            x, v = divmod(x, b)
            digits.append((v, b))
        digits = digits[::-1]
        image = tuple(of.permuted("x", digits))
        assert image != tuple(v for v, _ in digits)
        seen.add(image)
    assert len(seen) == n


def test_surrogates_over_documents(make, texts, spark):
    rng = random.Random(3)
    rows = texts + [(2000 + k, f"call +1 ({rng.randint(200, 999)}) 555-{k:04d} or a{k}.b@mail{k % 7}.example.com from {k % 250}.1.{k % 9}.7 x") for k in range(300)] + [(3000, PRIVATE), (3000, PRIVATE), (None, PRIVATE)]
    docs = make(rows)
    out = pii.surrogates(docs, KEY)
    assert out.count() == len(rows)
    assert out.where("doc_id = 1").first().text is None
    listed = pii.entities(docs, KEY)
    assert listed.where("entity = surrogate").count() == 0
    assert pii.collisions(listed).count() == 0
    assert listed.select("entity").distinct().count() == listed.select("surrogate").distinct().count()
    kept = pii.with_surrogates(docs, KEY)
    assert kept.schema == docs.schema and kept.count() == len(rows)
    assert kept.where("n_chars <> length(text)").count() == 0
    same = {t for _, t in texts if t is not None}
    assert {r.text for r in kept.where("doc_id < 100").collect() if r.text is not None} <= same
    assert pii.surrogates(make([]), KEY).count() == pii.entities(make([]), KEY).count() == 0


def plain_words(text):
    return re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode())


def plain_overlap(doc, item):
    """Every way to lay the item on the document."""
    d, q = [[w.lower() for w in plain_words(x)] for x in (doc, item)]
    if len(q) < decontaminate.LEAST:
        return False
    w = min(decontaminate.WINDOW, len(q))
    for at in range(-len(q), len(d)):
        same = [0 <= at + k < len(d) and d[at + k] == q[k] for k in range(len(q))]
        if sum(same) >= 0.8 * len(q) or any(sum(same[k : k + w]) >= 0.8 * w for k in range(len(q) - w + 1)):
            return True
    return False


def benchmark_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, doc_id long, word string")


def test_decontamination(make, texts, spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(8, 40)))) for k in range(20)] + [(20, None), (21, ""), (22, "too short"), (3, "a second text of item three with enough words in it")]
    rows = list(texts)
    for k, (_, t) in enumerate(items[:20]):
        w = t.split()
        some = rng.sample(range(len(w)), len(w) // 5)
        replaced = " ".join("zz" if j in some else x for j, x in enumerate(w))
        rows += [(500 + k, "before " * 30 + replaced.upper() + "! after"), (600 + k, " ".join(w[: len(w) // 2])), (700 + k, " ".join(rng.choice(words) for _ in range(200)))]
    docs = make(rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(docs, benchmark_of(spark, items)).collect()}
    want = {(i, j) for i, t in rows for j, x in items if plain_overlap(t, x)}
    assert got == want and {i for i, _ in got} >= set(range(500, 520))
    kept = decontaminate.without_contaminated(docs, benchmark_of(spark, items))
    assert kept.schema == docs.schema
    bad = {i for i, _ in want}
    assert sorted((str(r.doc_id) for r in kept.select("doc_id").collect())) == sorted(str(i) for i, _ in rows if i not in bad)


@pytest.mark.parametrize("n", range(decontaminate.LEAST, 26))
def test_masks_miss_no_way_to_replace_a_fifth(n):
    places = np.array(list(itertools.combinations(range(n), int(0.2 * n + 1e-9))))
    clear = np.ones((len(places), n), bool)
    np.put_along_axis(clear, places, False, 1)
    seen = np.zeros(len(clear), bool)
    for mask in decontaminate.MASKS:
        for at in range(n - mask[-1]):
            seen |= clear[:, [at + m for m in mask]].all(1)
    assert seen.all()


def test_a_large_benchmark_is_taken_in_blocks(make, spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(20))) for k in range(12)]
    docs = make([(k, t) for k, t in items])
    whole = sorted(map(tuple, decontaminate.decontaminate(docs, benchmark_of(spark, items)).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    assert len(decontaminate.blocks(benchmark_of(spark, items))) > 3
    assert sorted(map(tuple, decontaminate.decontaminate(docs, benchmark_of(spark, items)).collect())) == whole
    assert decontaminate.without_contaminated(docs, benchmark_of(spark, items)).count() == 0


def test_items_without_an_id(make, spark):
    passage = "nine words that stand in one item only here"
    items = benchmark_of(spark, [(None, passage), (None, "another text of nine words that is not there")])
    docs = make([(1, f"before {passage} after"), (2, "something else altogether")])
    assert [tuple(r)[:4] for r in decontaminate.decontaminate(docs, items).collect()] == [(1, None, 9, 9)]
    assert [r.doc_id for r in decontaminate.without_contaminated(docs, items).collect()] == [2]


def test_decontamination_of_nothing(make, spark, texts):
    none = benchmark_of(spark, [])
    assert decontaminate.decontaminate(make(texts), none).count() == 0
    assert decontaminate.without_contaminated(make(texts), none).count() == len(texts)
    assert decontaminate.decontaminate(make([]), benchmark_of(spark, [(1, "a b c d e f g h i")])).count() == 0


LICENSED = ["All rights reserved. All RIGHTS reserved!", "Licensed under CC BY-NC 4.0.", "cc by cc by", "GNU General Public License", "general public\nlicense", "released under the terms of the mit license", "the mit license\nreleased under", "This software is provided as is, without warranty of any kind, express or implied.", "İ All rİghts reserved", "This wor\u212a is licensed under the GNU General Public License, version 3", "ccby cc-by", "Ärights All rights reservedÄ"]


def test_licenses_like_sql(make, texts):
    rows = texts + [(900 + k, t) for k, t in enumerate(LICENSED)] + [(900, LICENSED[0])]
    docs = make(rows)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in licenses.scan(docs).select(names).collect()), key=str)
    documents = docs.select("doc_id", "text").toPandas()
    documents["text"] = documents["text"].astype(object).where(documents["text"].notna(), None)
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    c = duckdb.connect()
    c.register("documents", documents)
    want = c.execute(f"select {', '.join(names)} from ({licenses.oracle_sql()})").fetchall()
    assert got == sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in want), key=str)
    assert licenses.scan(make([])).count() == 0


def test_license_rows(make):
    got = {r.doc_id: r for r in licenses.scan(make(list(enumerate(LICENSED)))).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].score) == (2, 0, 3, "reserved", 1.0)
    assert got[2].n_base == 2 and got[4].base_labels == "gpl" and got[5].labels == "mit" and got[6].labels == ""
    assert got[1].labels == "cc-by,cc-by-nc-4.0" and got[7].labels == "no-warranty" and 0.9 <= got[7].score <= 1


def hard_wrapped(notice, width, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(notice.capitalize(), width))


def test_licenses_over_lines(make):
    rows = [(label, f"Some text.\n\n{hard_wrapped(x, width, mark)}.\nMore text") for label, x in licenses.NOTICES.items() for width, mark in ((30, ""), (45, " * "), (14, "# "), (30, "REM "))]
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
    of this software and associated documentation files (the "Software"), to deal"""
    bsd = """Redistribution and use in source and binary forms, with or without
    modification, are permitted provided that the following conditions are met:"""
    gpl = """This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by"""
    rows += [("mit-notice", mit), ("bsd", bsd), ("gpl-notice", gpl), ("mit-notice", mit.replace("charge", "cost")), ("gpl-notice", gpl.replace("terms", "rules").replace("modify", "change"))]
    rows += [("", mit.replace("charge", "cost").replace("person", "one")), ("", "the mit license\nreleased under"), ("", "released under\n" + "far away " * 3 + "the mit license")]
    got = {r.doc_id: r for r in licenses.scan(make([(k, t) for k, (_, t) in enumerate(rows)])).collect()}
    for k, (label, t) in enumerate(rows):
        assert label in got[k].labels.split(",") if label else got[k].labels == "", t
        assert (got[k].score >= licenses.CONTAINED) == bool(label), t
    assert got[len(rows) - 5].score == 18 / 19


def test_licenses_run_in_the_jvm_only(make, texts):
    plan = licenses.scan(make(texts))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_texts_are_read_in_the_jvm_too(make, texts):
    docs = make(texts).select(F.col("doc_id").alias("id"), F.col("text").alias("low"))
    read = licenses.read_once(docs)
    assert not re.search("Python|Pandas|Arrow", read._jdf.queryExecution().toString()) and "low" not in read.columns


def test_license_rows_of_no_id_and_one_text(make):
    rows = [(None, "released under the MIT license")] * 3 + [(1, "released under the MIT license"), (None, None)]
    got = sorted(((r.doc_id, r.labels) for r in licenses.scan(make(rows)).collect()), key=str)
    assert got == [(1, "mit"), (None, ""), (None, "mit"), (None, "mit"), (None, "mit")]


def test_permuted_words_of_a_benchmark_are_no_hit():
    h, _ = decontaminate.words(b"Alpha beta, GAMMA")
    same, _ = decontaminate.words("alpha beta gamma".encode())
    assert (h == same).all() and len(set(h.tolist())) == 3
    assert F is not None

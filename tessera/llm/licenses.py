"""License scan: phrases by place, and notices by an exact set-similarity join. DataFrame functions only.

A text block is a line. Words are lower-cased runs of ASCII letters, digits and other non-ASCII characters. A notice is found
in a block that holds at least ``CONTAINED`` of the notice's distinct words, in any order and with anything between.
All words of notices are ordered by the number of blocks that hold them, counted over all documents, the rarest first. A
block with c of a notice's n words shares one of the notice's n - c + 1 rarest with it, and one of the block's own
|block| - c + 1 rarest: only these prefixes are joined. Blocks with fewer than c such words are left out (length filter), as
are pairs whose words after the shared one can't make up c (positional filter); the rest is counted exactly.

A notice may also be wrapped over lines: it is found in a text of several lines where as many of its distinct words follow
each other in its order, across the ends of lines, with at most ``BETWEEN`` other words (marks of comments, words that
the notice repeats) between two. The SQL states the blocks of one line only: it has the same rows where no notice is wrapped.

Texts are read once: what a row's phrases, wrapped notices and blocks give goes to a table without texts in the shared folder,
and words are counted, prefixes joined and results put together from that. Whole texts are read, with A-Z lowered: lower() does so, and of other characters only the Kelvin sign would become a letter of
ASCII alone; it is made another one first. A null text counts as empty: no words, no labels, score 0.
A null id keeps its row, and repeated rows are rows of their own: the join is by a number that each row has in the table. The score is 1 with
a phrase, else the largest share of a notice's words found, if that reaches the threshold, else 0.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, written

CONTAINED = 0.9  # notices that differ in one of seven words must not stand for each other
BETWEEN = 4
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases and notices with the label of each.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "mit": "released under the mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "no-warranty": "the software is provided as is without warranty of any kind express or implied",
    "proprietary": "confidential and proprietary unauthorized copying of this file via any medium is strictly prohibited",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def least_common(n: int) -> int:
    """Of a notice with n distinct words, how many a block must hold."""
    return math.ceil(CONTAINED * n - 1e-9)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, NOT_WORDS, " "))


def count_words(normal_text: Column) -> Column:
    return F.when(normal_text == "", 0).otherwise(F.length(normal_text) - F.length(F.replace(normal_text, F.lit(" "), F.lit(""))) + 1).cast("long")


def in_order(words: list[str], missing: int) -> str:
    """A pattern for words in this order, each behind a blank, at most so many of them missing."""

    def rest(k: int, missing: int, between: str) -> str:
        if k == len(words):
            return "(?= )"
        own = f"{between} {words[k]}{rest(k + 1, missing, between or f'(?: [^ ]++){{0,{BETWEEN}}}?')}"
        return f"(?:{own}|{rest(k + 1, missing - 1, between)})" if missing else own

    return rest(0, missing, "")


def wrapped_notices(norm: Column, present: Column, n_lines: Column) -> Column:
    """Array of (label, share) of the notices whose words stand in order anywhere in a text of several lines.

    present: the words of notices that the text has; a notice with too few of them there needs no pattern.
    """
    found = []
    for label, notice in NOTICES.items():
        words = list(dict.fromkeys(notice.split()))
        n, need = len(words), least_common(len(words))
        here = (n_lines > 1) & (F.size(F.array_intersect(present, F.array(*map(F.lit, words)))) >= need)
        share = reduce(lambda x, m: x.when(F.concat(F.lit(" "), norm, F.lit(" ")).rlike(in_order(words, m)), F.lit((n - m) / n)), range(n - need + 1), F)  # noqa: B023
        found.append(F.when(here & share.isNotNull(), F.struct(F.lit(label).alias("label"), share.alias("share"))))
    return F.array_compact(F.array(*found))


def read_once(docs: DataFrame) -> DataFrame:
    """k (a number of the row), id, n_words, n_base, first_word, last_word, base, wrapped, blocks for docs of (id, low).

    blocks: of each line with enough of them, the distinct words that any notice has.
    """
    vocabulary = F.array(*map(F.lit, sorted({w for n in NOTICES.values() for w in n.split()})))
    fewest = min(least_common(len(set(n.split()))) for n in NOTICES.values())
    out = docs.withColumn("lines", F.transform(F.split("low", "\n"), normal))
    out = out.withColumn("held", F.transform("lines", lambda x: F.array_intersect(F.split(x, " "), vocabulary)))
    out = out.withColumn("norm", F.array_join(F.filter("lines", lambda x: x != ""), " "))
    out = out.withColumn("n_words", count_words(F.col("norm"))).withColumn("present", F.array_distinct(F.flatten("held")))
    # Every word with a blank of its own on either side: places are then plain substrings, and words before are blanks by two.
    wide = F.concat(F.lit(" "), F.replace("norm", F.lit(" "), F.lit("  ")), F.lit(" "))
    some = F.lit(False)
    for p in PHRASES:
        some |= F.contains("norm", F.lit(p))
    out = out.withColumn("wide", F.when(some, wide).otherwise(F.lit("")))

    def words_in(x: Column) -> Column:
        return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2

    counts, firsts, lasts = [], [], []
    for p in PHRASES:
        inside = f" {p.replace(' ', '  ')} "
        w = F.col("wide")
        n = ((F.length(w) - F.length(F.replace(w, F.lit(inside), F.lit("")))) / len(inside)).cast("long")
        counts.append(n)
        firsts.append(F.when(n > 0, words_in(F.substring_index(w, inside, 1)).cast("long")))
        lasts.append(F.when(n > 0, F.col("n_words") - len(p.split()) - words_in(F.substring_index(w, inside, -1)).cast("long")))
    labels = F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for n, label in zip(counts, PHRASES.values(), strict=True)]))
    return out.select(
        F.monotonically_increasing_id().alias("k"),
        "id",
        "n_words",
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_sort(labels).alias("base"),
        wrapped_notices(F.col("norm"), F.col("present"), F.size("lines")).alias("wrapped"),
        F.filter("held", lambda x: F.size(x) >= fewest).alias("blocks"),
    )


def notice_matches(read: DataFrame) -> DataFrame:
    """(k, label, share) for each row and notice found in one of its blocks."""
    spark = read.sparkSession
    found = read.select("k", F.explode("blocks").alias("held"))
    # At most one row for each word of the notices.
    counted = {r.w: r.n for r in found.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    words = sorted({w for n in NOTICES.values() for w in n.split()}, key=lambda w: (counted.get(w, 0), w))
    order = {w: k for k, w in enumerate(words)}
    prefixes = []
    for label, notice in NOTICES.items():
        own = sorted(order[w] for w in set(notice.split()))
        need = least_common(len(own))
        prefixes += [(word, place, label, own, len(own), need) for place, word in enumerate(own[: len(own) - need + 1])]
    names = ("word", "place", "label", "own", "n", "need")
    notices = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, x, strict=True)]) for x in prefixes])))
    fewest = min(x[5] for x in prefixes)
    rank = F.create_map(*[F.lit(x) for w in words for x in (w, order[w])])
    ranked = found.select("k", F.array_sort(F.transform("held", lambda w: rank[w])).alias("ranks"))
    # A block's own prefix, as long as the notice that asks for least needs it.
    probing = ranked.select("k", "ranks", F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - fewest + 1)).alias("at", "word"))
    pairs = (
        probing.join(F.broadcast(notices), "word")  # a fixed table
        .where((F.size("ranks") >= F.col("need")) & (F.least(F.col("n") - F.col("place"), F.size("ranks") - F.col("at")) >= F.col("need")))
        .select("k", "label", (F.size(F.array_intersect("ranks", "own"))).alias("both"), "n", "need")
        .where("both >= need")
    )
    return pairs.groupBy("k", "label").agg(F.max(F.col("both") / F.col("n")).alias("share"))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    docs = spread(documents.select("doc_id", "text"))
    read = written(read_once(docs.select(F.col("doc_id").alias("id"), F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\u0138"))).alias("low"))), "license-blocks")
    found = notice_matches(read).groupBy("k").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    more = F.concat(F.coalesce("more", F.array().cast("array<string>")), F.col("wrapped.label"))
    return read.join(found, "k", "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", more))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.greatest("share", F.array_max("wrapped.share")), F.lit(0.0))).alias("score"),
    )


def oracle_sql() -> str:
    """The same in DuckDB without filters: every line against every notice."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    notices = ", ".join(f"('{label}', {quoted(sorted(set(n.split())))}, {len(set(n.split()))}, {least_common(len(set(n.split())))})" for label, n in NOTICES.items())
    phrases = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in PHRASES.items())
    split = lambda x: f"list_filter(string_split(regexp_replace({x}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"""
with d as (select row_number() over () as k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
w as (select k, doc_id, {split('low')} as ws from d),
notices(label, own, n, need) as (values {notices}),
phrases(label, ps) as (values {phrases}),
places as (
  select k, label, i - 1 as pos from (select k, ws, unnest(range(1, len(ws) + 1)) as i from w where list_has_any(ws, ['license', 'reserved', 'cc'])), phrases
  where ws[i:i + len(ps) - 1] = ps
),
base as (select k, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as base from places group by k),
lines as (select k, list_distinct({split('line')}) as ls from (select k, unnest(string_split(low, chr(10))) as line from d)),
found as (
  select k, list(distinct label) as more, max(shared / n) as share
  from (select k, label, n, need, len(list_intersect(ls, own)) as shared from lines, notices) where shared >= need group by k
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(share, 0)::double end as score
from w left join base using (k) left join found using (k)
"""

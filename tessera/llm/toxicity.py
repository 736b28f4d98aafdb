"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding maps look-alike letters, digits and signs that stand for letters, and accented letters to one plain letter each,
character for character, so that places in the folded text are places in the text. A pattern counts where a word starts
with it (or is it); matches inside an exception phrase don't count. The sum of weights, and that sum by length, go
through a logistic curve. Lexicon, weights, exception phrases and curve are learned from at most ``MOST`` labelled rows
with at most ``MOST_CHARS`` characters,
taken in the order of a hash of the id; beside them stand a few fixed words.

Defined results: a null text counts as empty and gets the score of a text without matches; a null id isn't held out;
repeated rows stay; labels that are null, or of ids without a row, teach nothing; without labels the fixed words decide.
Only the id and the text are read, so other columns and their names don't matter.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_arrow, remainder, replace_rows, spread

MOST, MOST_CHARS = 12_000, 48 << 20
THRESHOLD = 0.3

# Letters of other scripts, digits and signs that look like a Latin letter.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ł": "l", "ø": "o",
    "ß": "s", "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "l",
    "|": "l", "€": "e", "£": "l", "+": "t",
}
# Words that insult in English, and phrases in which some of them don't.
INSULTS = ("clown", "disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
HARMLESS = ("circus clown", "clown fish", "pond scum", "sore loser", "trash bag", "trash can", "trash collection")
SEED_WEIGHT = 4.0
WHOLE = "\t"  # behind a pattern that is a whole word; else it is the start of one

DROPPED = re.compile("[­̀-ͯ​-‏⁠﻿]")
WORD = re.compile(r"[^\W_]+(?:[@$!|€£+][^\W_]+)*")


def _fold_character(c: int) -> str:
    x = chr(c)
    for x in (x, x.lower(), unicodedata.normalize("NFKD", x)[0].lower()):
        if x in LOOK_ALIKE:
            x = LOOK_ALIKE[x]
            break
    else:
        x = x[0]
    return "l" if x == "i" else x  # one letter for i, l, 1, ! and |


class _Folds(dict):
    def __missing__(self, c: int) -> str:
        self[c] = out = _fold_character(c)
        return out


FOLDS = _Folds()


def fold(text: str) -> str:
    return text.translate(FOLDS)


def cleaned(text: str) -> str:
    """Without characters that aren't seen; the automaton and the test for letters both look at this."""
    return text if text.isascii() else DROPPED.sub("", unicodedata.normalize("NFC", text))


@dataclass
class Lexicon:
    weights: dict[str, float]  # folded start of a word, or whole word -> weight
    harmless: dict[str, int] = field(default_factory=dict)  # folded phrases
    curve: tuple[float, float, float] = (-4.0, 3.0, 0.0)
    automaton: object = None

    def __post_init__(self) -> None:
        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            key = p.rstrip(WHOLE)
            start, whole, _ = a.get(key, (None, None, None))
            a.add_word(key, (w, whole, key) if p == key else (start, w, key))
        for p in self.harmless:
            if p not in a:
                a.add_word(p, (None, None, p))
        if len(a):
            a.make_automaton()
        self.automaton = a

    def __reduce__(self):
        return Lexicon, (self.weights, self.harmless, self.curve)

    def places(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches that count; of those that start together, the heaviest."""
        if not len(self.automaton) or not text:
            return []
        found: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for last, (w, whole, key) in self.automaton.iter(fold(text)):
            start, end = last + 1 - len(key), last + 1
            if start and text[start - 1].isalnum():
                continue
            ended = end == len(text) or not text[end].isalnum()
            if ended and key in self.harmless:
                spared.append((start, end))
            if ended and whole is not None:
                w = max(w or 0.0, whole)
            if w is not None and (start not in found or found[start][1] < w):
                found[start] = (end, w)
        # Both in the order of starts: of the phrases that have begun, the one that ends last covers a match or none does.
        out, spared, k, until = [], sorted(spared), 0, 0
        for s, (e, w) in sorted(found.items()):
            while k < len(spared) and spared[k][0] <= s:
                until = max(until, spared[k][1])
                k += 1
            if e > until:
                out.append((s, e, w))
        return out

    def features(self, text: str) -> tuple[float, float]:
        total = sum(w for *_, w in self.places(text))
        words = 1 + len(text) / 6
        return math.log1p(total), math.log1p(100 * total / words)

    def score(self, text: str | None) -> float:
        x, y = self.features(cleaned(text or ""))
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def patterns(text: str) -> set[str]:
    """The text's folded words, each with WHOLE behind it, and their starts, from 4 letters on."""
    words = {fold(m) for m in WORD.findall(text)}
    return {w[:n] for w in words for n in range(4, min(len(w), 16) + 1)} | {w + WHOLE for w in words if 3 < len(w) < 30}


def unlike(texts: list[str]) -> list[str]:
    """One of texts whose words have the same three smallest checksums: copies mustn't count again and again."""
    out = {}
    for t in texts:
        out.setdefault(tuple(sorted({zlib.crc32(w.encode()) for w in WORD.findall(t)})[:3]) or t, t)
    return list(out.values())


def learn(rows: list[tuple[str | None, int]]) -> Lexicon:
    """Patterns that the toxic rows have much more often than the others."""
    seeds = {fold(w): SEED_WEIGHT for w in INSULTS}
    harmless = dict.fromkeys(map(fold, HARMLESS), 1)
    bad = unlike([cleaned(t or "") for t, y in rows if y])
    good = unlike([cleaned(t or "") for t, y in rows if not y])
    if len(bad) < 5 or len(good) < 5:
        return Lexicon(seeds, harmless)
    tally = Counter(p for t in bad for p in patterns(t))
    tally = {p: n for p, n in tally.items() if n >= 4}
    clean: Counter = Counter()
    for t in good:
        clean.update(s for s in patterns(t) if s in tally)
    ratio = len(good) / len(bad)
    # A pattern without meaning has one toxic row for about every ``ratio`` clean ones.
    weights: dict[str, float] = {}
    longer: Counter = Counter()
    for p, n in tally.items():
        longer[p[:-1]] = max(longer[p[:-1]], n)  # a start that nearly always goes on in one way is too short
    for p in sorted(p for p, n in tally.items() if n >= 4 + 5 * (clean[p] + 0.2) / ratio and longer[p] < 0.95 * n):
        w = math.log((tally[p] + 0.5) / (clean[p] + 1) * ratio)
        if all(weights.get(p[:n], -9.0) < w - 0.3 for n in range(4, len(p))):  # else a shorter start says as much
            weights[p] = w
    weights = seeds | weights
    first = Lexicon(weights, harmless)
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for y, texts in ((1, bad), (0, good)):
        for t in texts:
            here = set()
            for s, e, _ in first.places(t):
                line = fold(t[max(0, s - 40) : e + 40])
                words = WORD.findall(line)
                at = len(WORD.findall(fold(t[max(0, s - 40) : s])))
                here |= {" ".join(words[max(0, k) : k + 2]) for k in (at - 1, at)}
            seen[y].update(here)
    harmless |= {p: 1 for p, n in seen[0].items() if n >= 3 and not seen[1][p] and " " in p}
    out = Lexicon(weights, harmless)
    x = np.array([(1.0, *out.features(t)) for t in bad + good])
    y = np.array([1.0] * len(bad) + [0.0] * len(good))
    b = np.zeros(3)
    for _ in range(30):  # Newton steps for a logistic curve with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x.T * (p * (1 - p))) @ x + 0.5 * np.eye(3)
        b = b + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.5 * b), -3, 3)
    return Lexicon(weights, harmless, tuple(float(v) for v in b))


def toxicity_model(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Lexicon:
    return learn(labelled_sample(docs, labels, "toxic", 4, 2, most, MOST_CHARS))


def toxicity(docs: DataFrame, model: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred patterns

    def run(batch: pa.RecordBatch) -> pa.Table:
        of = sent.value
        return pa.table({"doc_id": batch.column(0), "score": pa.array([of.score(t) for t in batch.column(1).to_pylist()], pa.float64())})

    out = map_arrow(spread(docs.select("doc_id", "text")), run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Lexicon) -> DataFrame:
    """docs, all columns, without the rows whose score reaches the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([sent.value.score(t) < THRESHOLD for t in batch.column("text").to_pylist()], pa.bool_()))

    return replace_rows(docs, run)

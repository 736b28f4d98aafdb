import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, id long, fp long, bucket long, kind string, h long, word string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text) with columns whose names operators use inside, and nulls in them."""

    def docs(rows, parts=3):
        full = [(i, t, "en", None, len(t) if t is not None else None, 0.5, "x", 1, None, 7, "k", 2, None) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return docs


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with what goes wrong: nulls, empty, blank and very long texts, copies, repeated rows, signs, several rows of an id."""
    rng = random.Random(11)
    vocab = ["the", "of", "Thing", "est", "ouaing", "über", "naïve", "x", "12", "foo.bar", "ñandú", "日本語", "🎉", "don't", "A-B", "\t", "ＦＵＬＬ", "K"]
    rows = [(0, ""), (1, None), (2, " \n\t "), (3, "one"), (4, "one two"), (5, "one two three"), (None, "one two three four five six"), (None, None), (6, "\x00\x01 \x85 ​"), (7, "a" * 5000), (8, "De " * 400), (9, "De " * 401)]
    for k in range(10, 60):
        rows.append((k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60)))))
    rows += [(60 + k, rows[12 + k][1]) for k in range(10)]  # copies
    rows += [rows[20], rows[20], (20, "another text of id 20 " * 9), (70, " ".join(rng.choice(vocab) for _ in range(30_000)))]
    return rows

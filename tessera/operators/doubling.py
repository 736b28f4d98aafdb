"""A vocabulary with every token a second time, as a control."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantize import private_character
from .analysis import SPECIALS, expansions, token_table

# Fixed values.
SENTINELS = ("[REST]", "[SEPARATOR]", "[AUTOREGRESS]", "[ANTICIPATE]")


def ids(vocab: DataFrame, merges: list[tuple[str, str, str]]) -> DataFrame:
    """(id, token, kind): special, base, merged, ctrl_base, ctrl_merged, sentinel, in the order of ids.

    Base tokens and their controls follow the order of tokens. A merged token is its base symbols; equal strings from two
    merges are one token, and their controls too.
    """
    spark = vocab.sparkSession
    b, s = vocab.count(), len(SPECIALS)
    base = vocab.select((F.col("idx") + s).alias("id"), "token", F.lit("base").alias("kind"))
    ctrl = lambda df, by, kind: df.select((F.col("id") + by).alias("id"), F.concat(F.lit("ctrl:"), F.col("token")).alias("token"), F.lit(kind).alias("kind"))
    whole = token_table(vocab, merges).where("size > 1").groupBy(F.replace("original_tokens", F.lit(" "), F.lit("+")).alias("token")).agg(F.min("sym").alias("sym"))
    m = whole.count()
    # As many rows as there are merges.
    merged = whole.select((F.row_number().over(Window.orderBy("sym")) - 1 + s + b).cast("long").alias("id"), "token", F.lit("merged").alias("kind"))
    ends = [(k, t, "special") for k, t in enumerate(SPECIALS)] + [(s + 2 * (b + m) + k, t, "sentinel") for k, t in enumerate(SENTINELS)]
    fixed = spark.createDataFrame(ends, "id long, token string, kind string")
    return fixed.unionByName(base).unionByName(merged).unionByName(ctrl(base, b + m, "ctrl_base")).unionByName(ctrl(merged, b + m, "ctrl_merged"))


def merge_rules(merges: list[tuple[str, str, str]], spark) -> DataFrame:
    """(rank, left, right, is_ctrl): the rules, and the same over controls behind them."""
    whole = expansions(merges)
    parts = [("+".join(whole.get(x, [x])), "+".join(whole.get(y, [y]))) for x, y, _ in merges]
    rows = [(k, x, y, False) for k, (x, y) in enumerate(parts)] + [(len(parts) + k, f"ctrl:{x}", f"ctrl:{y}", True) for k, (x, y) in enumerate(parts)]
    return spark.createDataFrame(rows, "rank long, left string, right string, is_ctrl boolean")


def doubled_json(text: str, tokens: list[str]) -> str:
    """A tokenizer file (see sources.files) with a second, control side: characters, merged tokens and merges once more.

    ``tokens`` are the base tokens in order, whose characters follow one another; a control's come behind them. The special
    tokens stay in the vocabulary but are no added tokens any more; the sentinels are.
    """
    spec = json.loads(text)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    to_control = str.maketrans({private_character(k): private_character(len(tokens) + k) for k in range(len(tokens))})
    spell = lambda s: s.translate(to_control)
    asked = [private_character(k) for k in range(len(tokens))]
    parts = [m if isinstance(m, list) else m.split(" ", 1) for m in merges]
    end = max(vocab.values()) + 1
    # A token's control stands as often as the token: once, at its first place.
    for new in [*map(spell, asked), *(spell(a + b) for a, b in parts), *SENTINELS]:
        if new not in vocab:
            vocab[new] = end
            end += 1
    merges += [[spell(a), spell(b)] if isinstance(m, list) else f"{spell(a)} {spell(b)}" for m, (a, b) in zip(list(merges), parts, strict=True)]
    kept = [x for x in spec["added_tokens"] if x["content"] not in SPECIALS]
    flags = dict.fromkeys(("single_word", "lstrip", "rstrip", "normalized"), False) | {"special": True}
    spec["added_tokens"] = kept + [{"id": vocab[s], "content": s, **flags} for s in SENTINELS]
    return json.dumps(spec, ensure_ascii=True)

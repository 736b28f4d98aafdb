"""Dictionaries of tokens, and notes as words of symbols.

A symbol is an index in the dictionary, written [dddddd]; a word is its symbols one behind another. Indices follow the order
of the tokens, so the order of symbols is that of tokens. A dictionary can't outgrow the private-use characters that stand
for its tokens in files (137,472): a larger one raises an error. That bounds the side that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import quantize as Q
from ..functions.quantize import CATEGORIES, FIELDS, Grid
from .notes import tokens

MOST_TOKENS = sum(b - a + 1 for a, b in Q.PRIVATE_USE)


def vocabulary(n: DataFrame, *by: str) -> DataFrame:
    """(token, category, idx), for each value of ``by``."""
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f).alias("value")) for c, f in zip(CATEGORIES, FIELDS, strict=True)])
    distinct = n.select(*by, F.inline(each)).distinct()  # before tokens are spelled
    return numbered(distinct.select(*by, Q.token(F.col("category"), F.col("value")).alias("token"), "category"), *by)


def numbered(tokens: DataFrame, *by: str) -> DataFrame:
    """tokens with ``idx``, their place in the order of tokens; an error where there are more than characters for them."""
    order = Window.partitionBy(*by).orderBy("token") if by else Window.orderBy("token")
    place = F.row_number().over(order) - 1
    checked = F.when(place < MOST_TOKENS, place).otherwise(F.raise_error(F.lit("more tokens than private-use characters")).cast("int"))
    return tokens.withColumn("idx", checked.cast("long"))


def with_controls(vocab: DataFrame) -> DataFrame:
    """(token, idx, is_ctrl): every token again as a control, behind all others."""
    size = vocab.agg(F.count("*").alias("b"))
    both = vocab.join(F.broadcast(size))  # one row
    return both.select("token", F.inline(F.array(F.struct(F.col("idx").alias("idx"), F.lit(False).alias("is_ctrl")), F.struct((F.col("idx") + F.col("b")).alias("idx"), F.lit(True).alias("is_ctrl")))))


def symbol(idx: Column) -> Column:
    return F.concat(F.lit("["), F.lpad(idx.cast("string"), 6, "0"), F.lit("]"))


def with_indices(n: DataFrame, vocab: DataFrame, *by: str) -> DataFrame:
    """n with the index of each field's token (t_idx ...), null where the dictionary has none."""
    return _with(n, vocab, F.col("idx"), INDICES, *by)


def with_symbols(n: DataFrame, vocab: DataFrame, *by: str) -> DataFrame:
    """n with the symbol of each field's token (t_sym ...), spelled once for each token of the dictionary."""
    return _with(n, vocab, symbol(F.col("idx")), SYMBOLS, *by)


def _with(n: DataFrame, vocab: DataFrame, value: Column, names: list[str], *by: str) -> DataFrame:
    out = n
    for c, f, name in zip(CATEGORIES, FIELDS, names, strict=True):
        side = vocab.where(F.col("category") == c).select(*[F.col(b).alias(f"_{b}") for b in by], F.regexp_extract("token", r"-(\d+)>$", 1).cast("long").alias("_value"), value.alias(name))
        on = F.col(f) == F.col("_value")
        for b in by:
            on &= F.col(b) == F.col(f"_{b}")
        out = out.join(F.broadcast(side), on, "left").drop("_value", *[f"_{b}" for b in by])
    return out


INDICES = [f"{f}_idx" for f in FIELDS]
SYMBOLS = [f"{f}_sym" for f in FIELDS]


def known(indexed: DataFrame, whole: str = "file") -> DataFrame:
    """Without the files (or, with whole="chunk", the chunks) that hold a token the dictionary hasn't."""
    keys = ["file_id"] if whole == "file" else ["file_id", "chunk_idx"]
    missing = F.max(F.greatest(*[F.col(c).isNull().cast("int") for c in INDICES])).over(Window.partitionBy(*keys))
    return indexed.withColumn("_missing", missing).where("_missing = 0").drop("_missing")


def words_of(indexed: DataFrame, standalone: bool = False) -> DataFrame:
    """Each note as a word, or with its onset as a word of its own: rows with ``word`` and ``part`` (place within the note)."""
    cols = [F.col(c) for c in SYMBOLS] if SYMBOLS[0] in indexed.columns else [symbol(F.col(c)) for c in INDICES]
    if not standalone:
        return indexed.select("*", F.lit(0).alias("part"), F.concat(*cols).alias("word"))
    return indexed.select("*", F.posexplode(F.array(cols[0], F.concat(*cols[1:]))).alias("part", "word"))


def lines(words: DataFrame) -> DataFrame:
    """(file_id, chunk_idx, text): the words of a chunk in order, a blank between."""
    return words.groupBy("file_id", "chunk_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part", "word"))), lambda x: x["word"]), " ").alias("text"))


def counted(words: DataFrame, *by: str) -> DataFrame:
    return words.groupBy(*by, "word").agg(F.count("*").alias("n"))


def summed(words: DataFrame, *by: str) -> DataFrame:
    """The same for words that come with a number."""
    return words.groupBy(*by, "word").agg(F.sum("n").alias("n"))


def counted_notes(n: DataFrame, *by: str) -> DataFrame:
    """(t, d, p, i, v, n): distinct notes, each once, whatever their file."""
    return n.groupBy(*by, *FIELDS).agg(F.count("*").alias("n"))


def coarsened(n: DataFrame, field: str, fine: float, coarse: float) -> DataFrame:
    """Notes as the corpus of a coarser grid derived from a finer one has them: chunks, order and onsets' origin stay."""
    return n.withColumn(field, Q.coarser(field, F.col(field), fine, coarse))


def private_character_of(idx: Column) -> Column:
    """The code point is encoded as UTF-32 by hand, as char() ends at 255."""
    (a0, a1), (b0, b1), (c0, _) = Q.PRIVATE_USE
    n1, n2 = a1 - a0 + 1, b1 - b0 + 1
    point = F.when(idx < n1, idx + a0).when(idx < n1 + n2, idx - n1 + b0).otherwise(idx - n1 - n2 + c0)
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def private_use(word: Column) -> Column:
    """Symbols to characters."""
    idx = F.transform(F.regexp_extract_all(word, F.lit(r"\[(\d+)\]"), 1), lambda s: s.cast("int"))
    return F.array_join(F.transform(idx, private_character_of), "")


def private_use_words(text: Column) -> Column:
    """The same for a line of words."""
    return F.array_join(F.transform(F.split(text, " "), private_use), " ")


def category_counts(n: DataFrame) -> DataFrame:
    return tokens(n).distinct().groupBy("category").agg(F.count("*").alias("n_tokens"))


def fine_grid(field: str, value: float) -> Grid:
    return Grid(onset_ms=value) if field == "t" else Grid(dur_ms=value) if field == "d" else Grid(vel_bins=int(value))

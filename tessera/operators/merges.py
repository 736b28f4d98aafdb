"""Byte-pair encoding over counted distinct words.

A word is a string of symbols [dddddd], a merge a plain replacement of two neighbours by a new symbol, left to right and not
overlapping. As merges never cross a word, all of training, encoding and counting works on distinct words with their
number; the corpus is read once to count them. The most frequent pair is merged, ties going to the smaller left, then right
symbol; the symbol of merge m is M and m in five digits, so that
symbols order as ids do. Several corpora (column ``grp``) train in the
same jobs. Merges of a small ladder are prefixes of those of a large one: the largest is trained, once, and one pass over the
words gives the counts at every size.

Words are encoded many at a time by a table of ranks that goes to every task (a row for each merge), so that the plan is the
same for 8 merges and for 65,536. A group of words that fits a bound, which is checked, is trained by one task, groups beside
each other; there a merge looks at its own places only. A larger group is trained by all tasks together, each with its share of the words
(``together``). Where even these can't hold it, a merge costs two small jobs over all distinct words. All ways give the same merges.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.quantize import ratio
from ..plans.tables import drop_settled, settled
from .together import TRAINED, as_columns, best_pairs_alone, best_pairs_together

LOCAL_WORDS = 2_000_000  # of a group, and
LOCAL_SYMBOLS = 16_000_000  # some 600 MB in the task that trains it
MADE = 1_000_000  # base symbols are numbers below, merged ones this and their place
WIDE = 1 << 21

Merges = dict[str, list[tuple[str, str, str]]]  # group -> (left, right, made), in order
Standing = dict[str, dict[str, int]]  # group -> symbol after all merges -> how often it stands


def made(m: int) -> str:
    return f"M{m:05d}"


def symbols(word: Column) -> Column:
    return F.split(F.substring(word, F.lit(2), F.length(word) - 2), r"\]\[")


def count_symbols(word: Column) -> Column:
    return (F.length(word) - F.length(F.replace(word, F.lit("["), F.lit("")))).cast("long")


def of_characters(words: DataFrame) -> DataFrame:
    """(word, n) of plain text with each word as symbols: code points."""
    point = lambda c: F.concat(F.lit("["), F.lpad(F.ascii(c).cast("string"), 6, "0"), F.lit("]"))
    return words.select(F.col("word").alias("plain"), F.concat_ws("", F.transform(F.split("word", ""), point)).alias("word"), "n")


def pairs(words: DataFrame, *by: str) -> DataFrame:
    """(l, r, n): neighbours, weighted by how often their word stands."""
    # No filter on the number of symbols: it would be pushed below the count of words and split every word of the corpus.
    s = words.select(*by, "n", symbols(F.col("word")).alias("s"))
    left, right = F.slice("s", F.lit(1), F.size("s") - 1).alias("l"), F.slice("s", F.lit(2), F.size("s") - 1).alias("r")
    return s.select(*by, "n", F.inline(F.arrays_zip(left, right))).groupBy(*by, "l", "r").agg(F.sum("n").alias("n"))


def top_pair(words: DataFrame) -> DataFrame:
    return pairs(words).orderBy(F.desc("n"), "l", "r").limit(1)


def applied(word: Column, merges: list[tuple[str, str, str]]) -> Column:
    """A few merges as an expression: one replacement each, so for a handful only (``encoded`` takes any number)."""
    for left, right, new in merges:
        word = F.replace(word, F.lit(f"[{left}][{right}]"), F.lit(f"[{new}]"))
    return word


def applied_by_group(word: Column, merges: Merges, upto: int, start: int = 0) -> Column:
    out = None
    for g, m in sorted(merges.items()):
        out = (F.when if out is None else out.when)(F.col("grp") == g, applied(word, m[start:upto]))
    return word if out is None else out.otherwise(word)


# Words as numbers: all symbols of a column one behind another, and how many each word has.


def number(symbol: str) -> int:
    return MADE + int(symbol[1:]) if symbol[0] == "M" else int(symbol)


def name(n: int) -> str:
    return made(n - MADE) if n >= MADE else f"{n:06d}"


def numbers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = words.cast(pa.string())
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = words.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, 8) if data is not None else np.zeros((0, 8), np.uint8)
    digits = flat[:, 1:7].astype(np.int64) - 48
    merged = digits[:, 0] == ord("M") - 48
    digits[merged, 0] = MADE // 100_000
    return digits @ 10 ** np.arange(5, -1, -1), np.diff(ends) // 8


def strings(s: np.ndarray, sizes: np.ndarray) -> pa.Array:
    flat = np.empty((len(s), 8), np.uint8)
    flat[:, 0], flat[:, 7] = ord("["), ord("]")
    flat[:, 1:7] = s[:, None] // 10 ** np.arange(5, -1, -1) % 10 + 48
    flat[s >= MADE, 1] = ord("M")
    ends = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes()))


def every_other(at: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of places in order, where one that ``follows`` the one before overlaps it, every other one of a run from its first on."""
    index = np.arange(len(at))
    first = np.maximum.accumulate(np.where(follows, 0, index))
    return at[(index - first) % 2 == 0]


class Rules:
    """A list of merges by the rank of each pair."""

    def __init__(self, merges: list[tuple[str, str, str]]):
        self.merges = merges
        pair = np.array([number(a) * WIDE + number(b) for a, b, _ in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank = pair[order], order
        self.new = np.array([number(m) for _, _, m in merges], np.int64)
        base: dict[int, list[int]] = {}
        for a, b, m in merges:
            base[number(m)] = base.get(number(a), [number(a)]) + base.get(number(b), [number(b)])
        self.base = base

    def __reduce__(self):
        return Rules, (self.merges,)

    def encode(self, s: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols and sizes after all merges, and word and rank of each replacement.

        In each round every word has its pair of the least rank replaced, wherever it stands: a merge makes no pair of a
        lesser rank than its own, so this is the order of the merges. Words without a pair that merges are put aside.
        """
        n_words = len(sizes)
        w = np.repeat(np.arange(n_words), sizes)
        done_s, done_w, words, ranks = [], [], [], []
        none = len(self.new)
        while len(s) > 1 and none:
            key = s[:-1] * WIDE + s[1:]
            at = np.minimum(np.searchsorted(self.pair, key), none - 1)
            rank = np.where((self.pair[at] == key) & (w[:-1] == w[1:]), self.rank[at], none)
            least = np.full(n_words, none, np.int64)
            np.minimum.at(least, w[:-1], rank)
            on = least[w] < none
            if not on.all():
                done_s.append(s[~on])
                done_w.append(w[~on])
                rank = np.append(rank, none)[on][:-1]
                s, w = s[on], w[on]
                if not len(s):
                    break
            at = np.flatnonzero(rank == least[w[:-1]])
            at = every_other(at, np.diff(at, prepend=-2) == 1)
            words.append(w[at])
            ranks.append(rank[at])
            s[at] = self.new[rank[at]]
            stays = np.ones(len(s), bool)
            stays[at + 1] = False
            s, w = s[stays], w[stays]
        s, w = np.concatenate([*done_s, s]), np.concatenate([*done_w, w])
        order = np.argsort(w, kind="stable")
        none_yet = [np.zeros(0, np.int64)]
        return s[order], np.bincount(w, minlength=n_words), np.concatenate(words or none_yet), np.concatenate(ranks or none_yet)

    def decode(self, s: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols taken apart into base ones."""
        kinds, of = np.unique(s, return_inverse=True)
        parts = [self.base.get(int(k), [int(k)]) for k in kinds]
        length = np.array([len(p) for p in parts], np.int64)
        flat = np.array([x for p in parts for x in p], np.int64)
        first = np.cumsum(length) - length
        n = length[of]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(np.arange(len(sizes)), sizes)
        return flat[np.repeat(first[of], n) + inner], np.bincount(w, n, len(sizes)).astype(np.int64)


def _mapped(words: DataFrame, column: str, new: str, f) -> DataFrame:
    """words with ``new``: f over the numbers of ``column``, some thousand words at a time."""
    schema = words.drop(new).schema.add(new, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([*part.columns, strings(*f(*numbers(part.column(column))))], [*part.schema.names, new])

    return words.drop(new).mapInArrow(run, schema)


def encoded(words: DataFrame, merges: list[tuple[str, str, str]]) -> DataFrame:
    """words with ``enc``, their symbols after all merges."""
    sent = words.sparkSession.sparkContext.broadcast(Rules(merges))  # a row for each merge
    return _mapped(words, "word", "enc", lambda s, sizes: sent.value.encode(s, sizes)[:2])


def unmerged(words: DataFrame, merges: list[tuple[str, str, str]]) -> DataFrame:
    """words with ``base``, the base symbols of ``enc``."""
    sent = words.sparkSession.sparkContext.broadcast(Rules(merges))
    return _mapped(words.withColumn("_enc", F.col("enc")), "_enc", "base", lambda s, sizes: sent.value.decode(s, sizes)).drop("_enc")


# Training.


def train(words: DataFrame, k: int, most: int = LOCAL_WORDS) -> Merges:
    """k merges for each group of (grp, word, n), or fewer if no pair is left; a group that fits the bounds in one task, a larger
    one in all tasks together.

    words is read twice, once for its sizes: settle it before, if it costs something to make.
    """
    return trained(words, k, most)[0]


def trained(words: DataFrame, k: int, most: int = LOCAL_WORDS) -> tuple[Merges, Standing]:
    """The same, and how often each symbol stands when all merges are done, as whoever trains has the words so: for all groups
    but those beyond what the tasks hold.
    """
    words = words.select("grp", "word", "n")
    sizes = words.groupBy("grp").agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("length")).collect()
    large = [r.grp for r in sizes if r.words > most or r.length > 8 * LOCAL_SYMBOLS]
    small = [r.grp for r in sizes if r.grp not in large]
    got: dict[str, Row] = {}
    if small:
        own = words.where(F.col("grp").isin(small)) if large else words
        own = own.repartition(4 * len(small), "grp")  # by a number, so that groups aren't put together into one task
        schema = ", ".join(map(" ".join, [("grp", "string"), *TRAINED.items()]))
        got = {r.grp: r for r in own.groupBy("grp").applyInArrow(_trainer(k), schema).collect()}
    tasks = words.sparkSession.sparkContext.defaultParallelism  # all have to run at once
    beyond = [r.grp for r in sizes if r.grp in large and r.length > 8 * LOCAL_SYMBOLS * tasks]
    for r in sizes:
        if r.grp in large and r.grp not in beyond:
            got[r.grp] = best_pairs_together(words.where(F.col("grp") == r.grp), k, tasks, numbers)
    out: Merges = {g: [(name(a), name(b), made(m)) for m, (a, b) in enumerate(zip(r.l, r.r, strict=True))] for g, r in got.items()}
    if beyond:
        out |= train_distributed(words.where(F.col("grp").isin(beyond)), k)
    return {g: m for g, m in out.items() if m}, {g: dict(zip(map(name, r.sym), r.n, strict=True)) for g, r in got.items()}


def _trainer(k: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        s, sizes = numbers(group["word"].combine_chunks() if group["word"].num_chunks != 1 else group["word"].chunk(0))
        cols = as_columns(*best_pairs_alone(s, sizes, np.asarray(group["n"]), k))
        return pa.table([pa.array([key[0].as_py()], pa.string()), *cols], names=["grp", *TRAINED])

    return run


def train_distributed(words: DataFrame, k: int) -> Merges:
    """Pairs are counted once over all words; a merge then changes the counts of pairs in the words that hold its pair, and only
    those are looked at. Counts of pairs are a table, too; what comes to the driver is one row for each group and merge.
    """
    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = settled(words.select("grp", "word", "n").repartition(spread, "word"))
    counts = settled(pairs(words, "grp"))
    merges: Merges = {}
    done = 0
    for m in range(k):
        best = counts.groupBy("grp").agg(F.min(F.struct((-F.col("n")).alias("n"), "l", "r")).alias("x")).collect()
        if not best:
            break
        last = applied_by_group(F.col("word"), merges, m, done)
        for r in best:
            merges.setdefault(r.grp, []).append((r.x.l, r.x.r, made(m)))
        if m + 1 == k:
            break
        if m - done == 16:  # the plan has a replacement for each merge; begin anew from a table now and then
            before, words = words, settled(words.withColumn("word", last).where(F.contains("word", F.lit("]["))))  # of one symbol: no pairs
            drop_settled(before)
            done, last = m, F.col("word")
        held = None
        for r in best:
            holds = (F.col("grp") == r.grp) & F.contains("word", F.lit(f"[{r.x.l}][{r.x.r}]"))
            held = holds if held is None else held | holds
        touched = words.withColumn("word", last).where(held)
        now = touched.withColumn("word", applied_by_group(F.col("word"), {g: x for g, x in merges.items() if len(x) == m + 1}, m + 1, m))
        change = pairs(now, "grp").unionByName(pairs(touched.withColumn("n", -F.col("n")), "grp"))
        before, counts = counts, settled(counts.unionByName(change).groupBy("grp", "l", "r").agg(F.sum("n").alias("n")).where("n > 0"))
        drop_settled(before)
    drop_settled(words)
    drop_settled(counts)
    return merges


def train_one(words: DataFrame, k: int, most: int = LOCAL_WORDS) -> list[tuple[str, str, str]]:
    return trained_one(words, k, most)[0]


def trained_one(words: DataFrame, k: int, most: int = LOCAL_WORDS) -> tuple[list[tuple[str, str, str]], dict[str, int] | None]:
    rules, standing = trained(words.withColumn("grp", F.lit("all")), k, most)
    return rules.get("all", []), standing.get("all")


def merges_of(words: list[str], counts: list[int], k: int) -> list[tuple[str, str, str]]:
    """The same for words in memory."""
    s, sizes = numbers(pa.array(words, pa.string()))
    return [(name(a), name(b), made(m)) for m, (a, b) in enumerate(best_pairs(s, sizes, np.asarray(counts, np.int64), k))]


def best_pairs(s: np.ndarray, sizes: np.ndarray, n: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The pairs that are merged, in order. All symbols of all words stand one behind another, each with its neighbours.

    For each pair there is a list of the places where it began to stand; a merge looks at those of its own pair only, some of
    which are gone by then. So all merges together look at a place no more often than it changes.
    """
    s, sizes, n = s.astype(np.int64), np.asarray(sizes, np.int64), np.asarray(n, np.int64)
    weight = np.repeat(n, sizes)
    after = np.arange(1, len(s) + 1, dtype=np.int64)
    ends = np.cumsum(sizes)
    after[ends[sizes > 0] - 1] = -1
    ahead = np.arange(-1, len(s) - 1, dtype=np.int64)
    ahead[(ends - sizes)[sizes > 0]] = -1
    places: dict[int, list[np.ndarray]] = {}
    total: dict[int, int] = {}

    def pairs_at(at: np.ndarray) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
        """Pairs that begin at these places: each with its weight, and the places in the order of pairs."""
        key = s[at] * WIDE + s[after[at]]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first].tolist(), np.add.reduceat(weight[at], first).tolist(), first, at

    def add(at: np.ndarray) -> list[int]:
        keys, sums, first, at = pairs_at(at)
        for key, c, a, b in zip(keys, sums, first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
            total[key] = total.get(key, 0) + c
            places.setdefault(key, []).append(at[a:b])
        return keys

    begin = np.flatnonzero(after >= 0)
    heap = [(-total[key], key) for key in add(begin)] if len(begin) else []
    heapq.heapify(heap)
    out: list[tuple[int, int]] = []
    while heap and len(out) < k:
        c, key = heapq.heappop(heap)
        if total.get(key, 0) != -c or not c:
            continue  # a later entry has its present count
        left, right = divmod(key, WIDE)
        new = MADE + len(out)
        out.append((left, right))
        own = places.pop(key)
        at = own[0] if len(own) == 1 else np.concatenate(own)
        at = at[(s[at] == left) & (after[at] >= 0)]
        at = at[s[after[at]] == right]
        if left == right:
            at = np.sort(at)
            at = every_other(at, np.concatenate([[False], after[at[:-1]] == at[1:]]))
        gone = after[at]
        before, behind = ahead[at], after[gone]
        touched = np.unique(np.concatenate([before[before >= 0], at, gone[behind >= 0]]))
        keys, sums, _, _ = pairs_at(touched)
        for q, c in zip(keys, sums, strict=True):
            total[q] -= c
        s[at], s[gone] = new, -1
        after[at] = behind
        ahead[behind[behind >= 0]] = at[behind >= 0]
        before = ahead[at]
        fresh = np.unique(np.concatenate([before[before >= 0], at[after[at] >= 0]]))
        keys = {*keys, *(add(fresh) if len(fresh) else ())}
        for q in keys:
            if total[q] > 0:
                heapq.heappush(heap, (-total[q], q))
            else:
                del total[q]
                places.pop(q, None)
    return out


# Measuring.


def evaluate(words: DataFrame, merges: Merges, ladder: list[int]) -> DataFrame:
    """(grp, merges, n_words, original_tokens, bpe_tokens, reduction_ratio, compression_factor) for each size of the ladder.

    One encoding of the counted words serves all sizes: each replacement takes away one symbol at all sizes beyond its rank.
    """
    sent = words.sparkSession.sparkContext.broadcast({g: Rules(m[: max(ladder)]) for g, m in merges.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                of = part.column(0).to_pylist()
                for g in set(of):
                    own = part if len(set(of)) == 1 else part.filter(pa.array([x == g for x in of]))
                    n = np.asarray(own.column(2))
                    s, sizes = numbers(own.column(1))
                    *_, w, ranks = sent.value.get(g, Rules([])).encode(s, sizes)
                    for k in ladder:
                        row = sums.setdefault((g, k), [0, 0, 0])
                        row[0] += int(n.sum())
                        row[1] += int((n * sizes).sum())
                        row[2] += int((n * sizes).sum() - n[w[ranks < k]].sum())
        if sums:
            rows = [(g, k, *x) for (g, k), x in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["grp", "merges", "n_words", "original_tokens", "bpe_tokens"])

    sums = ("n_words", "original_tokens", "bpe_tokens")
    each = words.select("grp", "word", "n").mapInArrow(run, "grp string, merges long, n_words long, original_tokens long, bpe_tokens long")
    out = each.groupBy("grp", "merges").agg(*[F.sum(c).alias(c) for c in sums])
    bpe, original = F.col("bpe_tokens"), F.col("original_tokens")
    return out.withColumn("reduction_ratio", ratio(bpe, original)).withColumn("compression_factor", ratio(original, bpe))

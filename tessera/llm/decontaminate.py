"""Benchmark decontamination by spaced seeds.

Words are hashed; a mask picks some of the words at fixed distances from a place and ignores the others, so a passage with
some words replaced still has places where a mask sees only kept words. Seeds of the benchmark are joined with those of
every document: the benchmark's side, of a checked size, goes to every task, and a larger benchmark is taken in as many
blocks as needed, one pass each. Around each hit the item is laid on the document without gaps and compared word by word.

No such overlap is missed: of 8 to 25 words with at most a fifth replaced, whichever these are, one of the masks sees only kept
words somewhere (the tests try all ways), and a longer stretch has a part of 13 to 25 words with no larger share replaced.

A document is contaminated by an item if, in some stretch of ``WINDOW`` words of the item (of all its words, if it has
fewer), at least ``SHARE`` of the words are the same, or so many of the whole item.

Words are runs of ASCII letters and digits and of other non-ASCII bytes, with A-Z lowered. Null or empty texts on either
side have no words and match nothing; items of fewer than ``LEAST`` words can't be told from chance and match nothing;
repeated rows on the document side each give their rows; an item that is there twice is one, and texts
that share an item's id are items of their own, and so are texts without an id (their item_id is null). Only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_arrow, replace_rows, spread

# Places that a mask looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 6, 7), (0, 1, 4, 6, 8), (0, 3, 4, 7, 9))
WINDOW, SHARE, LEAST = 13, 0.8, 8
BLOCK_BYTES = 16 << 20  # of benchmark text that goes to every task at once: some 3 million words
BITS = 22
MANY, AT_ONCE = 50_000, 1_000_000  # ways to lay items on a document by one seed, and words or ways held at a time

ODD = np.random.default_rng(7).integers(1 << 62, 1 << 63, 80, dtype=np.uint64) | np.uint64(1)
POWER = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
LOWER = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 0 for c in range(256)], np.uint64)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the byte at which each starts."""
    b = LOWER[np.frombuffer(data, np.uint8)]
    own = b > 0
    edge = np.diff(own.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    size = end - start
    at = np.flatnonzero(own)
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    h = np.add.reduceat(b[at] * POWER[place & 255], first)
    h ^= h >> np.uint64(31)
    h *= ODD[-1]
    return h ^ (h >> np.uint64(29)), start


def seeds(h: np.ndarray, k: int) -> np.ndarray:
    """What mask k sees from each place on."""
    mask = MASKS[k]
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, ODD[k], np.uint64)
    for j, at in enumerate(mask):
        out += h[at : at + n] * ODD[8 + 8 * k + j]
    return out ^ (out >> np.uint64(32))


class Items:
    """Part of a benchmark, with the seeds of its words."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, parts = [], []
        for i, t in rows:
            h, _ = words((t or "").encode())
            if len(h) >= LEAST:
                self.ids.append(i)
                parts.append(h)
        self.h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        size = np.array([len(x) for x in parts], np.int64)
        self.start, self.end = np.cumsum(size) - size, np.cumsum(size)
        item = np.repeat(np.arange(len(size)), size)
        self.seeds, self.places, self.filter = [], [], []
        for k, mask in enumerate(MASKS):
            s = seeds(self.h, k)
            inside = np.flatnonzero(item[: len(s)] == item[mask[-1] :]) if len(s) else np.zeros(0, np.int64)
            inside = inside[np.argsort(s[inside], kind="stable")]
            self.seeds.append(s[inside])
            self.places.append(inside)
            bits = np.zeros(1 << BITS, bool)
            bits[s[inside] >> np.uint64(64 - BITS)] = True
            self.filter.append(bits)
        self.item = item

    def alignments(self, h: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
        """(document, item, word of h where the item begins when laid so that a seed of both meets) of all ways, each once.

        A seed that a document has at a places and the items at b gives a * b ways, but no more than a + the words of an item for
        one of these: where a * b is large, the ways are marked on a line for each item, and nothing of their number is held.
        """
        # As one number each: the word is counted from the longest item's length before the first one.
        span, before = len(h) + 2 * len(self.h) + 1, len(self.h)
        keyed = lambda d, i, begin: (np.asarray(d) * len(self.ids) + i) * span + begin + before
        out = [np.zeros(0, np.int64)]
        for k in range(len(MASKS)):
            s = seeds(h, k)
            at = np.flatnonzero(self.filter[k][s >> np.uint64(64 - BITS)])
            lo = np.searchsorted(self.seeds[k], s[at], "left")
            n = np.searchsorted(self.seeds[k], s[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            doc = np.searchsorted(doc_start, at, "right") - 1
            order = np.lexsort((lo, doc))
            at, lo, n, doc = at[order], lo[order], n[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1])])) if len(at) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(at)))
            many = np.repeat(times * n[new] > MANY, times)
            out += [np.unique(keyed(*x)) for x in self._each(at[~many], lo[~many], n[~many], doc[~many], k)]
            for a, c in zip(new[times * n[new] > MANY].tolist(), times[times * n[new] > MANY].tolist(), strict=True):
                out += [keyed(doc[a], *x) for x in self._marked(at[a : a + c], self.places[k][lo[a] : lo[a] + n[a]])]
        pair, begin = np.divmod(np.unique(np.concatenate(out)), span)
        return np.stack([*np.divmod(pair, max(1, len(self.ids))), begin - before], 1)

    def _each(self, at: np.ndarray, lo: np.ndarray, n: np.ndarray, doc: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Every place with every one of the items, some at a time."""
        upto = np.cumsum(n)
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + AT_ONCE, "right")))
            m = n[begin:end]
            within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            q = self.places[k][np.repeat(lo[begin:end], m) + within]
            item = self.item[q]
            yield np.repeat(doc[begin:end], m), item, np.repeat(at[begin:end], m) - q + self.start[item]
            begin = end

    def _marked(self, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        item = self.item[q]
        order = np.argsort(item, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], item[order][1:] != item[order][:-1]]))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(q)], strict=True):
            i = int(item[order[a]])
            inner = q[order[a:b]] - self.start[i]
            low = int(p.min()) - int(inner.max())
            ways = np.zeros(int(p.max()) - int(inner.min()) - low + 1, bool)
            few, other = (inner, p) if len(inner) <= len(p) else (p, inner)
            for x in few.tolist():
                ways[(other - x if few is inner else x - other) - low] = True
            yield i, np.flatnonzero(ways) + low

    def compared(self, h: np.ndarray, doc_start: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(words alike, -first, last of them, whether that is an overlap) for each alignment, word by word."""
        doc, i, at = rows.T
        size = self.end[i] - self.start[i]
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(len(rows)), size)
        inner = np.arange(size.sum()) - first[row]
        place = at[row] + inner
        inside = (place >= doc_start[doc][row]) & (place < doc_start[doc + 1][row])
        same = inside & (h[np.where(inside, place, 0)] == self.h[self.start[i][row] + inner])
        n = np.add.reduceat(same, first, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(same)])
        w = np.minimum(WINDOW, size)
        ends = np.minimum(first[row] + inner + w[row], len(same))
        in_window = np.where(inner + w[row] <= size[row], total[ends] - total[:-1], 0)
        enough = (n >= SHARE * size) | (np.maximum.reduceat(in_window, first) >= SHARE * w)
        begin = np.minimum.reduceat(np.where(same, place, len(h)), first) - doc_start[doc]
        last = np.maximum.reduceat(np.where(same, place, -1), first) - doc_start[doc]
        return np.stack([n, -begin, last, enough], 1)

    def overlaps(self, h: np.ndarray, doc_start: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, words alike, first and last word of the document that is alike), at the best place of each pair.

        The ways to lay an item on a document are taken in the order of how many words can be alike, and of their places: those
        that can't be better than the best one any more aren't looked at.
        """
        if not len(self.h) or not len(h):
            return
        rows = self.alignments(h, doc_start)
        if not len(rows):
            return
        doc, i, at = rows.T
        most = np.minimum(at + self.end[i] - self.start[i], doc_start[doc + 1]) - np.maximum(at, doc_start[doc])
        order = np.lexsort((at, -most, i, doc))
        rows, most = rows[order], most[order]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
        left, end = new.copy(), np.append(new[1:], len(rows))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        step = 16
        while len(left):
            take = np.minimum(end - left, step)
            k = np.repeat(left - (np.cumsum(take) - take), take) + np.arange(take.sum())
            sizes = np.cumsum(self.end[rows[k, 1]] - self.start[rows[k, 1]])
            for part in np.split(k, np.flatnonzero(np.diff(sizes // AT_ONCE)) + 1):
                got = self.compared(h, doc_start, rows[part])
                for (d, j, _), (*found, enough) in zip(rows[part].tolist(), got.tolist(), strict=True):
                    if enough:
                        best[d, j] = max(best.get((d, j), (0, 0, 0)), tuple(found))
            left = left + take
            # What comes next has at most ``most`` words alike, and its first one no earlier than it begins.
            stay = []
            for g, (a, b) in enumerate(zip(left.tolist(), end.tolist(), strict=True)):
                if a < b:
                    d, j, x = rows[a].tolist()
                    n, first, _ = best.get((d, j), (0, 0, 0))
                    if most[a] > n or most[a] == n and x - doc_start[d] < -first:
                        stay.append(g)
            left, end = left[stay], end[stay]
            step *= 4
        for (d, j), (n, first, last) in sorted(best.items()):
            yield d, j, n, -first, last


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of a bounded size each; the size is measured, the parts are chosen by a hash of the id."""
    b = benchmark.select("item_id", "text").where("text is not null")
    size = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + 2 * size // BLOCK_BYTES if size > BLOCK_BYTES else 1
    return [b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def overlaps_of(of: Items, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """What Items.overlaps gives for a column of texts."""
    parts = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    h, at = words(b"\n".join(parts))
    return list(of.overlaps(h, np.searchsorted(at, np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])]))))


def sent_items(docs: DataFrame, part: DataFrame):
    """A block of the benchmark, bounded by BLOCK_BYTES, for every task."""
    return docs.sparkSession.sparkContext.broadcast(Items([(r.item_id, r.text) for r in part.distinct().collect()]))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item_words, n_same, first_word, last_word) for each pair that overlaps."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    names = ["doc_id", "item_id", "n_item_words", "n_same", "first_word", "last_word"]
    schema = f"doc_id {kind}, item_id {item_kind}, n_item_words long, n_same long, first_word long, last_word long"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    own, out = spread(docs.select("doc_id", "text")), None
    for part in blocks(benchmark):
        sent = sent_items(docs, part)

        def run(batch: pa.RecordBatch, sent=sent) -> pa.Table | None:
            of = sent.value
            rows = overlaps_of(of, batch.column(1))
            if not rows:
                return None
            d, i, n, first, last = zip(*rows, strict=True)
            cols = [batch.column(0).take(pa.array(d)), pa.array([of.ids[x] for x in i], item_type), pa.array([int(of.end[x] - of.start[x]) for x in i]), pa.array(n), pa.array(first), pa.array(last)]
            return pa.table(cols, names=names)

        found = map_arrow(own, run, schema, 400)
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that overlap with an item."""
    for part in blocks(benchmark):
        sent = sent_items(docs, part)

        def run(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            stays = np.ones(batch.num_rows, bool)
            stays[[row[0] for row in overlaps_of(sent.value, batch.column("text"))]] = False
            return batch.filter(pa.array(stays))

        docs = replace_rows(docs, run, 400)
    return docs

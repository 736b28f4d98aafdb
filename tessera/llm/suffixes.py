"""Suffix-array dedup: bytes of strings that an earlier document has too.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller id. Equal strings have to
meet to be found, so strings are dealt out by an anchor, the run of ``GRAM`` bytes in them with the least hash: neighbouring
strings mostly share one, and a stretch of them is one segment. Buckets by a hash of the anchor, so many that each holds
about ``BUCKET`` segments, find the anchors that several documents have. Where all segments of an anchor are equal, so are
their strings. Segments that differ around a shared anchor are compared by their suffix array: their bytes are fetched, one
copy of each different segment, and where one shares neither side of the anchor with another, its strings are its own.

On the Burrows-Wheeler transform of these segments, common prefixes are derived by increasing value: from the intervals of
all strings of one length, backward extension gives those of one more; where the end of a new interval isn't yet marked, two
neighbours in the suffix array share exactly that many bytes, the place is marked and the interval is extended in turn. The
packed keys of the sort give the first eight values. At ``LENGTH`` this stops: what isn't marked has at least so many bytes
in common, and the intervals left are the classes of equal strings. Each class has its smallest document.

An anchor can be in a third of all documents, with a different segment around it in each. Anchors that a sample of documents
shows to be that frequent (there can't be more than a fixed number of them, see ``frequent``) don't go to one bucket: their
segments are spread over buckets by document and taken apart into strings, of which partial minima meet by value.

Texts are UTF-8 bytes; a null text is empty. Nothing crosses a document or a segment's end. Rows with one id never count as
earlier than each other. Rows without an id are neither earlier nor later than others and stay whole. Texts shorter than
``LENGTH`` bytes stay whole. Every row gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread, written

LENGTH, GRAM = 50, 16
GRAMS = LENGTH - GRAM + 1  # places for the anchor in a string
SIDE = (LENGTH - GRAM) // 2  # a string holds that many bytes on one side of its anchor at least
BUCKET, DOCS, BYTES = 500_000, 2_000, 64 << 20
FREQUENT, FREQUENT_SHARE, SAMPLED = 200_000, 1e-4, 32  # segments of an anchor; and at least this share of documents; one in so many is looked at
TEXT, SPANS, WANTED, PLACES, SPREAD = 0, 1, 2, 3, 4


def gram_hashes(data: bytes) -> np.ndarray:
    """Of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    w = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))
    z = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(29)
    z += w[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first string and number of strings of each stretch of strings with one anchor value."""
    least = gram_hashes(data)
    width, n = 1, len(data) - LENGTH + 1
    while 2 * width <= GRAMS:
        least[:-width] = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[GRAMS - width : GRAMS - width + n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    # No segment is longer than strings around one place can be; repetitive texts would make it so.
    count = np.diff(np.append(first, n))
    if count.max() > GRAMS:
        parts = -(-count // GRAMS)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + inner * GRAMS
        count = np.diff(np.append(first, n))
    return least[first], first, count


def text_mark(data: bytes) -> int:
    return xxhash.xxh32_intdigest(data)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return z ^ (z >> np.uint64(33))


def by_key(key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, its places) for each value of key."""
    if not len(key):
        return []
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    return [(int(key[order[a]]), order[a:b]) for a, b in zip(edge, [*edge[1:], len(key)], strict=True)]


#: Columns of a table of segments and their bytes each when packed: small numbers in two halves, as the high one is mostly zero.
TYPES = {"anchor": np.uint64, "same": np.uint64, "doc": np.int64, "mark": np.uint32, "at": np.uint32, "count": np.uint8, "left": np.uint64, "right": np.uint64, "end": np.uint32}


def packed(cols: dict[str, np.ndarray], extra: bytes = b"") -> bytes:
    """Columns one behind another, each byte of them together, so that bytes which are alike compress; runs of doc and mark once."""
    n = len(next(iter(cols.values())))
    cols = dict(cols)
    parts = [np.array([n], np.uint32).tobytes()]
    new = np.ones(n, bool)
    new[1:] = (cols["doc"][1:] != cols["doc"][:-1]) | (cols["mark"][1:] != cols["mark"][:-1])
    at = np.flatnonzero(new)
    parts.append(np.array([len(at)], np.uint32).tobytes())
    parts.append(np.diff(np.append(at, n)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())
    for name in ("doc", "mark"):
        v = np.ascontiguousarray(cols.pop(name)[at].astype(TYPES[name]))
        parts.append(v.view(np.uint8).reshape(len(at), -1).T.tobytes())
    for name, v in cols.items():
        v = np.ascontiguousarray(v.astype(TYPES[name]))
        parts.append(v.view(np.uint8).reshape(n, -1).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts) + extra)


def unpacked(blobs: list[bytes], names: list[str]) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """The columns of all blobs, one behind another, and what each has behind its columns."""
    got: dict[str, list[np.ndarray]] = {k: [] for k in names}
    extras = []
    unzip = zstandard.ZstdDecompressor()
    for blob in blobs:
        data = unzip.decompress(blob)
        n, runs = (int(x) for x in np.frombuffer(data, np.uint32, 2))
        at = 8

        def take(rows: int, kind: type) -> np.ndarray:
            nonlocal at
            size = np.dtype(kind).itemsize
            v = np.frombuffer(data, np.uint8, rows * size, at).reshape(size, rows)  # noqa: B023
            at += rows * size
            return np.ascontiguousarray(v.T).view(kind).ravel()

        times = take(runs, np.uint32)
        for name in ("doc", "mark"):
            got[name].append(np.repeat(take(runs, TYPES[name]), times))
        for name in names:
            if name not in ("doc", "mark"):
                got[name].append(take(n, TYPES[name]))
        extras.append(data[at:])
    return {k: np.concatenate(v) if v else np.zeros(0, TYPES[k]) for k, v in got.items()}, extras


SEGMENT = ["doc", "mark", "anchor", "same", "at", "count"]
REPLY = ["doc", "mark", "anchor", "same", "at", "count", "left", "right", "end"]
SPAN = ["doc", "mark", "at", "end"]
ROWS = "kind int, bucket long, data binary"


def rows_of(kind: int, key: np.ndarray, cols: dict[str, np.ndarray]) -> list[tuple[int, int, bytes]]:
    return [(kind, k, packed({c: v[p] for c, v in cols.items()})) for k, p in by_key(key)]


def as_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    kind, bucket, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int64()), "data": pa.array(data, pa.binary())})


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(doc.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def anchor_bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(anchor) % np.uint64(buckets)).astype(np.int64)


def cut(ids: list[int], texts: list[bytes]) -> dict[str, np.ndarray]:
    """All segments of some documents."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in SEGMENT}
    h = xxhash.xxh64_intdigest
    for i, t in zip(ids, texts, strict=True):
        if len(t) < LENGTH:
            continue
        anchor, first, count = segments(t)
        same = np.fromiter((h(t[a:b]) for a, b in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), strict=True)), np.uint64, len(first))
        n = len(first)
        for k, v in zip(SEGMENT, (np.full(n, i), np.full(n, text_mark(t)), anchor, same, first, count), strict=True):
            out[k].append(v)
    return {k: np.concatenate(v).astype(TYPES[k]) if v else np.zeros(0, TYPES[k]) for k, v in out.items()}


def met(s: dict[str, np.ndarray], doc_buckets: int, own: int) -> list[tuple[int, int, bytes]]:
    """Of the segments of a bucket: spans that go for sure; segments whose bytes are wanted; places that wait for these."""
    order = np.lexsort((s["doc"], s["anchor"]))
    s = {k: v[order] for k, v in s.items()}
    n = len(order)
    if not n:
        return []
    new = np.concatenate([[True], s["anchor"][1:] != s["anchor"][:-1]])
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    least, most = np.minimum.reduceat(s["doc"], start), np.maximum.reduceat(s["doc"], start)
    differ = np.minimum.reduceat(s["same"], start) != np.maximum.reduceat(s["same"], start)
    shared = least != most
    gone = (shared & ~differ)[group] & (s["doc"] > least[group])
    spans = {"doc": s["doc"][gone], "mark": s["mark"][gone], "at": s["at"][gone], "end": s["at"][gone] + s["count"][gone].astype(np.uint32) + np.uint32(LENGTH - 1)}
    wait = (shared & differ)[group]
    w = {k: v[wait] for k, v in s.items()}
    order = np.lexsort((w["doc"], w["same"], w["anchor"]))
    first = np.ones(len(order), bool)
    a, b = w["anchor"][order], w["same"][order]
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    wanted = {k: v[order[first]] for k, v in w.items()}
    out = rows_of(SPANS, doc_bucket(spans["doc"], doc_buckets), spans) + rows_of(WANTED, doc_bucket(wanted["doc"], doc_buckets), wanted)
    if len(order):
        by_doc = np.lexsort((w["at"], w["mark"], w["doc"]))
        out.append((PLACES, own, packed({k: v[by_doc] for k, v in w.items()})))
    return out


def fetched(texts: dict[tuple[int, int], bytes], w: dict[str, np.ndarray], anchor_buckets: int) -> list[tuple[int, int, bytes]]:
    """The bytes of wanted segments, with hashes of what stands on either side of their anchor, by the bucket of the anchor."""
    n = len(w["doc"])
    if not n:
        return []
    left, right, parts = np.zeros(n, np.uint64), np.zeros(n, np.uint64), []
    h = xxhash.xxh64_intdigest
    for k, (doc, mark, at, count) in enumerate(zip(w["doc"].tolist(), w["mark"].tolist(), w["at"].tolist(), w["count"].tolist(), strict=True)):
        part = texts[doc, mark][at : at + count + LENGTH - 1]
        parts.append(part)
        grams = gram_hashes(part)
        m = int(grams.argmin())
        if (grams == grams[m]).sum() > 1:
            continue  # 0 on either side: with an anchor that comes again, sides say nothing about this anchor's strings
        # Strings with SIDE bytes left of the anchor hold ``left``; all others end at least as far to the right as ``right``.
        left[k] = h(part[max(0, m - SIDE) : m], m >= SIDE)
        right[k] = h(part[m + GRAM : m + LENGTH - SIDE + 1], m < SIDE + count)
        if m < SIDE:
            left[k] = h(part, 3)
        if count - 1 <= m - SIDE:
            right[k] = h(part, 4)
    out = []
    for b, p in by_key(anchor_bucket(w["anchor"], anchor_buckets)):
        own = [parts[k] for k in p.tolist()]
        cols = {k: v[p] for k, v in w.items()} | {"left": left[p], "right": right[p], "end": np.cumsum([len(x) for x in own])}
        out.append((TEXT, b, packed({k: cols[k] for k in REPLY}, b"".join(own))))
    return out


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes by their first LENGTH bytes at least, the place of each, and where the first 8 bytes change."""
    n = len(t)
    data = np.concatenate([t, np.zeros(LENGTH + 8, np.uint8)]).tobytes()
    key = np.ndarray((n,), ">u8", data, strides=(1,)).astype(np.uint64)
    order = np.argsort(key).astype(np.int32)
    changes = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n + LENGTH, np.int64)
    rank[n:] = 0
    rank[order] = np.cumsum(changes)
    first = changes
    for step in (8, 16, LENGTH - 32):
        key = rank[:n] << 32 | rank[step : n + step]
        order = np.argsort(key).astype(np.int32)
        k = key[order]
        rank[order] = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]]))
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order, place, first


def classes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each place of the suffix array, place of each suffix): suffixes of one class share LENGTH bytes. 0 in t ends a segment."""
    n = len(t)
    order, place, marked = suffix_array(t)
    marked = np.append(marked, True)
    before = np.where(order > 0, t[order - 1], 0)  # the Burrows-Wheeler transform
    to = np.where(before > 0, place[order - 1], -1)  # where backward extension leads
    lo = np.flatnonzero(marked[:-1])
    hi = np.append(lo[1:], n)
    for _ in range(8, LENGTH):
        sizes = hi - lo
        interval = np.repeat(np.arange(len(lo), dtype=np.int64), sizes)
        at = np.arange(len(interval)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
        v = to[at]
        own = v >= 0
        v, interval = v[own].astype(np.int64), interval[own]
        if not len(v):
            break
        by = np.argsort(v)
        v, interval = v[by], interval[by]
        # Extensions of one interval by one byte stand together; so do their ends.
        start = np.concatenate([[True], (v[1:] != v[:-1] + 1) | (interval[1:] != interval[:-1])])
        lo = v[start]
        hi = v[np.append(np.flatnonzero(start)[1:], len(v)) - 1] + 1
        fresh = ~marked[hi]
        lo, hi = lo[fresh], hi[fresh]
        marked[hi] = True
        if not len(lo):
            break
    return np.cumsum(marked[:-1]) - 1, place


def compared(r: dict[str, np.ndarray], data: list[np.ndarray], p: dict[str, np.ndarray], doc_buckets: int) -> list[tuple[int, int, bytes]]:
    """Spans that go, from the different segments of a bucket (r, with their bytes) and all places that hold one of them (p)."""
    if not len(p["doc"]):
        return []

    def several(key: np.ndarray) -> np.ndarray:
        _, back, n = np.unique(mixed(r["anchor"]) ^ key, return_inverse=True, return_counts=True)
        return n[back] > 1

    alike = several(r["left"]) | several(r["right"]) | np.isin(r["anchor"], r["anchor"][r["left"] == 0])
    count = r["count"].astype(np.int64)
    base = np.cumsum(count) - count  # of each segment's strings
    least = np.repeat(r["doc"], count)
    if alike.any():
        k = np.flatnonzero(alike)
        size = count[k] + LENGTH
        t = np.zeros(size.sum(), np.uint8)
        begin = np.cumsum(size) - size
        for b, j in zip(begin.tolist(), k.tolist(), strict=True):
            t[b : b + len(data[j])] = data[j] + np.uint8(1)  # 0 is left to the ends: UTF-8 has no byte 255
        of, place = classes(t)
        inner = np.arange(count[k].sum()) - np.repeat(np.cumsum(count[k]) - count[k], count[k])
        of = of[place[np.repeat(begin, count[k]) + inner]]
        smallest = np.full(of.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, of, np.repeat(r["doc"][k], count[k]))
        least[np.repeat(base[k], count[k]) + inner] = smallest[of]
    key = mixed(r["anchor"]) ^ r["same"]
    order = np.argsort(key)
    j = order[np.searchsorted(key[order], mixed(p["anchor"]) ^ p["same"])]
    n = count[j]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    gone = least[np.repeat(base[j], n) + inner] < np.repeat(p["doc"], n)
    owner = np.repeat(np.arange(len(j)), n)
    same = gone[1:] & gone[:-1] & (owner[1:] == owner[:-1])
    a = np.flatnonzero(gone & ~np.concatenate([[False], same]))
    b = np.flatnonzero(gone & ~np.concatenate([same, [False]]))
    who = owner[a]
    at = p["at"][who].astype(np.int64)
    spans = {"doc": p["doc"][who], "mark": p["mark"][who], "at": at + inner[a], "end": at + inner[b] + LENGTH}
    return rows_of(SPANS, doc_bucket(spans["doc"], doc_buckets), spans)


def union_of_spans(at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans; spans that touch are one run."""
    order = np.argsort(at)
    at, end = at[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64))
    new = np.concatenate([[True], at[1:] > end[:-1]])
    return at[new], end[np.append(np.flatnonzero(new)[1:], len(at)) - 1]


OUT = "n_bytes long, removed array<struct<start:long,end:long>>, kept binary"


def finished(ids: list[int | None], texts: list[bytes], spans: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    sizes, removed, kept = [], [], []
    for i, t in zip(ids, texts, strict=True):
        got = spans.get((i, text_mark(t))) if i is not None else None
        runs = [] if got is None else list(zip(*(x.tolist() for x in union_of_spans(*got)), strict=True))
        parts, last = [], 0
        for a, b in runs:
            parts.append(t[last:a])
            last = b
        sizes.append(len(t))
        removed.append([{"start": a, "end": b} for a, b in runs])
        kept.append(b"".join([*parts, t[last:]]) if runs else t)
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()),
        "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
    })


def frequent(own: DataFrame, n: int, size: int) -> np.ndarray:
    """Anchors with about FREQUENT segments or more, in at least FREQUENT_SHARE of the documents' number.

    A document has a segment for each 18 bytes or so, so there are at most (segments of a document) / FREQUENT_SHARE of them
    whatever the number of documents: some two million, or 15 MB, go to every task. What the sample misses goes the usual way,
    with the same result.
    """
    least = max(FREQUENT, n * FREQUENT_SHARE)
    if size < least * SAMPLED / 8:
        return np.zeros(0, np.uint64)

    def count(batch: pa.RecordBatch) -> pa.Table:
        found = [segments(t)[0] for t in (x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()) if len(t) >= LENGTH]
        anchors, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return pa.table({"anchor": pa.array(anchors.view(np.int64)), "times": pa.array(times, pa.int64())})

    some = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text")
    sums = map_arrow(some, count, "anchor long, times long").groupBy("anchor").agg(F.sum("times").alias("times"))
    rows = sums.where(F.col("times") * SAMPLED >= least).select("anchor").toArrow()
    return np.sort(np.asarray(rows["anchor"]).astype(np.int64).view(np.uint64))


def dealt(s: dict[str, np.ndarray], texts: dict[tuple[int, int], bytes], first_bucket: int, doc_buckets: int) -> list[tuple[int, int, bytes]]:
    """Segments of frequent anchors with their bytes, by document."""
    out = []
    for b, p in by_key(doc_bucket(s["doc"], doc_buckets)):
        own = {k: v[p] for k, v in s.items()}
        parts = [texts[d, m][a : a + c + LENGTH - 1] for d, m, a, c in zip(own["doc"].tolist(), own["mark"].tolist(), own["at"].tolist(), own["count"].tolist(), strict=True)]
        out.append((SPREAD, first_bucket + b, packed(own, b"".join(parts))))
    return out


def strings_of(blob: bytes) -> pa.Table:
    """(string, doc, mark, at): every string of spread segments."""
    s, (data,) = unpacked([blob], SEGMENT)
    count = s["count"].astype(np.int64)
    base = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(base, count) + inner
    return pa.table({
        "string": pa.array([data[a : a + LENGTH] for a in at.tolist()], pa.binary()), "doc": pa.array(np.repeat(s["doc"], count)),
        "mark": pa.array(np.repeat(s["mark"], count).astype(np.int64)), "at": pa.array(np.repeat(s["at"].astype(np.int64), count) + inner),
    })


def spans_of_strings(rows: DataFrame, doc_buckets: int) -> DataFrame:
    """Spans, as packed rows, of the spread strings that an earlier document has.

    The least document of a string comes from partial minima; it is a table before it is joined, so that a string which very
    many documents have is split on the side of these.
    """
    schema = "string binary, doc long, mark long, at long"
    strings = map_arrow(rows.select("data"), lambda b: pa.concat_tables([strings_of(x) for x in b.column(0).to_pylist()]), schema, 4)
    least = written(strings.groupBy("string").agg(F.min("doc").alias("least")), "least-of-strings")
    gone = strings.join(least, "string").where("least < doc").select("doc", "mark", "at")

    def pack(batch: pa.RecordBatch) -> pa.Table:
        doc, mark, at = (np.asarray(batch.column(k)) for k in range(3))
        return as_table(rows_of(SPANS, doc_bucket(doc, doc_buckets), {"doc": doc, "mark": mark, "at": at, "end": at + LENGTH}))

    return map_arrow(gone, pack, ROWS, 100_000)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed: runs of bytes that go, kept: the rest) for each row."""
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    own = docs.where("doc_id is not null")
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    doc_buckets = max(8, -(-n // DOCS), -(-size // BYTES))
    anchor_buckets = max(8, -(-size * 2 // (GRAMS + 1) // BUCKET))

    def texts_of(batch: pa.RecordBatch | pa.Table) -> tuple[list[int], list[bytes]]:
        return batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]

    often = docs.sparkSession.sparkContext.broadcast(frequent(own, n, size))  # of a bounded size

    def emit(batch: pa.RecordBatch) -> pa.Table:
        ids, texts = texts_of(batch)
        s = cut(ids, texts)
        rows = []
        if len(often.value):
            many = np.isin(s["anchor"], often.value)
            if many.any():
                of = {(i, text_mark(t)): t for i, t in zip(ids, texts, strict=True)}
                rows = dealt({k: v[many] for k, v in s.items()}, of, anchor_buckets, doc_buckets)
                s = {k: v[~many] for k, v in s.items()}
        return as_table(rows + rows_of(TEXT, anchor_bucket(s["anchor"], anchor_buckets), s))

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        if key[0].as_py() >= anchor_buckets:
            return as_table([(SPREAD, key[0].as_py(), d) for d in group["data"].to_pylist()])
        s, _ = unpacked(group["data"].to_pylist(), SEGMENT)
        return as_table(met(s, doc_buckets, key[0].as_py()))

    found = written(map_arrow(own, emit, ROWS, 500).select("bucket", "data").groupBy("bucket").applyInArrow(meet, ROWS), "segments")

    def zipped(batch: pa.RecordBatch) -> pa.Table:
        ids, texts = texts_of(batch)
        zip_ = zstandard.ZstdCompressor(level=1)
        rows = []
        for b, p in by_key(doc_bucket(np.array(ids, np.int64), doc_buckets)):
            part = [texts[k] for k in p.tolist()]
            head = np.concatenate([[len(p)], [ids[k] for k in p.tolist()], [len(x) for x in part]]).astype(np.int64).tobytes()
            rows.append((TEXT, b, zip_.compress(head + b"".join(part))))
        return as_table(rows)

    def texts_from(blobs: list[bytes]):
        unzip = zstandard.ZstdDecompressor()
        for blob in blobs:
            data = unzip.decompress(blob)
            n = int(np.frombuffer(data, np.int64, 1)[0])
            head = np.frombuffer(data, np.int64, 2 * n, 8).tolist()
            at = 8 + 16 * n
            for i, size in zip(head[:n], head[n:], strict=True):
                yield i, data[at : at + size]
                at += size

    def texts() -> DataFrame:
        """Anew for either use: its columns must not be taken for those of the other side."""
        return map_arrow(own, zipped, ROWS, 500)

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        w, _ = unpacked(right["data"].to_pylist(), SEGMENT)
        need = set(w["doc"].tolist())
        got = {(i, text_mark(t)): t for i, t in texts_from(left["data"].to_pylist()) if i in need} if need else {}
        return as_table(fetched(got, w, anchor_buckets))

    replies = texts().groupBy("bucket").cogroup(found.where(F.col("kind") == WANTED).groupBy("bucket")).applyInArrow(fetch, ROWS)

    def compare(group: pa.Table) -> pa.Table:
        kind, data = group["kind"].to_pylist(), group["data"].to_pylist()
        r, extras = unpacked([d for k, d in zip(kind, data, strict=True) if k == TEXT], REPLY)
        p, _ = unpacked([d for k, d in zip(kind, data, strict=True) if k == PLACES], SEGMENT)
        parts, k = [], 0
        for extra in extras:
            flat, at = np.frombuffer(extra, np.uint8), 0
            while at < len(flat):
                parts.append(flat[at : int(r["end"][k])])
                at = int(r["end"][k])
                k += 1
        return as_table(compared(r, parts, p, doc_buckets))

    waiting = found.where(F.col("kind") == PLACES)
    spans = replies.unionByName(waiting).groupBy("bucket").applyInArrow(compare, ROWS).unionByName(found.where(F.col("kind") == SPANS))
    if len(often.value):
        spans = spans.unionByName(spans_of_strings(found.where(F.col("kind") == SPREAD), doc_buckets))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        s, _ = unpacked(right["data"].to_pylist(), SPAN)
        order = np.lexsort((s["mark"], s["doc"]))
        s = {k: v[order] for k, v in s.items()}
        new = np.flatnonzero(np.concatenate([[True], (s["doc"][1:] != s["doc"][:-1]) | (s["mark"][1:] != s["mark"][:-1])])) if len(order) else []
        of = {(int(s["doc"][a]), int(s["mark"][a])): (s["at"][a:b], s["end"][a:b]) for a, b in zip(new, [*new[1:], len(order)], strict=True)} if len(order) else {}
        ids, parts = [], []
        for i, t in texts_from(left["data"].to_pylist()):
            ids.append(i)
            parts.append(t)
        return finished(ids, parts, of)

    done = texts().groupBy("bucket").cogroup(spans.select("bucket", "data").groupBy("bucket")).applyInArrow(finish, f"doc_id long, {OUT}")
    whole = docs.where("doc_id is null").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("kept"))
    rest = whole.select("doc_id", F.octet_length("kept").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,end:long>>").alias("removed"), "kept")
    return done.unionByName(rest)

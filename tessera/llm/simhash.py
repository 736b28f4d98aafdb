"""Near-duplicates by SimHash, linked by meeting in the middle.

Two fingerprints that differ in at most three bits have a value between them that is near to both. Every distinct
fingerprint emits all values within half the radius of it: within one bit if it has an odd number of bits set; within two if
it has an even number, as 3 is odd and one side has to go the longer way (fingerprints at distance 1 or 3 have one odd and
one even side, at distance 2 both are alike and one bit each does). Of the pairs of bits, those within one half of the word
are enough: of three differing bits, two lie in the same half. Equal values are brought together; of those that meet, a
fingerprint within one bit is within three of every other, so linking all to one such fingerprint loses no connection and
makes no pairs. Each link is checked by its distance. Links then give components of fingerprints, and those of documents.

Values go to buckets by a hash, so many that one holds about ``BUCKET`` of them whatever the number of documents; a value
can meet at most as many fingerprints as there are masks. Copies share a fingerprint and are one row from then on.

A null text counts as empty, and a text without words has fingerprint zero, linked like any other. Texts with fewer than
three words have one shingle. Repeated rows stay. A null id is no smallest id: such rows get that of the others, or null.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread, written
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
BUCKET, BATCH, EMIT = 2_000_000, 4096, 20_000  # fingerprints of a task that emits: some 110 MB of values
ONE = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
TWO = np.array([1 << i | 1 << j for i in range(64) for j in range(i + 1, 64) if i // 32 == j // 32], np.uint64)
MASKS = np.concatenate([ONE, TWO])


def text_mark() -> Column:
    return F.xxhash64("text")


def shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return []
    data, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [h(data, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [h(data[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])]  # noqa: B905


def fingerprint_of(hashes: list[list[int]]) -> np.ndarray:
    """For each list the bits set in over half of it."""
    sizes = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.fromiter((v for x in hashes for v in x), np.uint64, sizes.sum())
        starts = np.cumsum(sizes[full]) - sizes[full]
        counts = np.empty((len(full), 64), np.int64)
        for k, (a, n) in enumerate(zip(starts.tolist(), sizes[full].tolist(), strict=True)):
            bits = np.unpackbits(flat[a : a + n].view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
            # 255 rows at a time fit a byte.
            cut = np.add.reduceat(bits, np.arange(0, n, 255), axis=0, dtype=np.uint8)
            counts[k] = cut.sum(0, dtype=np.int64)
        out[full] = np.packbits(2 * counts > sizes[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark long: a checksum of the text, fp long: the 64 bits) for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.Table:
        fps = fingerprint_of([shingle_hashes(t) for t in batch.column(1).to_pylist()])
        return pa.table({"doc_id": batch.column(0), "mark": batch.column(2), "fp": pa.array(fps.view(np.int64))})

    return map_arrow(spread(docs.select("doc_id", "text", text_mark().alias("mark"))), run, f"doc_id {kind}, mark long, fp long", 200)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return z ^ (z >> np.uint64(33))


def meeting_links(z: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Links (rows of two fingerprints) among fingerprints z ^ MASKS[mask] that meet in an equal z."""
    order = np.argsort(z)
    z = z[order]
    new = np.concatenate([[True], z[1:] != z[:-1]])
    alone = new & np.concatenate([new[1:], [True]])
    z, mask, new = z[~alone], mask[order][~alone], new[~alone]
    if not len(z):
        return np.zeros((0, 2), np.uint64)
    fp = z ^ MASKS[mask]
    starts = np.flatnonzero(new)
    none = np.uint64(2**64 - 1)
    near = mask < len(ONE)
    # All ones is a fingerprint too: it may stand for "none", as then it links nothing that others don't.
    least = np.minimum.reduceat(np.where(near, fp, none), starts)
    some = np.logical_or.reduceat(near, starts)
    group = np.cumsum(new) - 1
    links = np.stack([fp, least[group]], 1)[some[group]]
    return np.unique(links[(links[:, 0] != links[:, 1]) & (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= RADIUS)], axis=0)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fp`` that keep every pair within the radius connected."""
    n = distinct.count()
    buckets = max(1, -(-n * (len(ONE) + len(MASKS)) // 2 // BUCKET))

    def emit(batch: pa.RecordBatch) -> pa.Table:
        fp = np.asarray(batch.column(0)).view(np.uint64)
        odd = np.bitwise_count(fp) % 2 == 1
        z = np.concatenate([(fp[:, None] ^ ONE).ravel(), (fp[~odd][:, None] ^ TWO).ravel()])
        mask = np.concatenate([np.tile(np.arange(len(ONE), dtype=np.uint16), len(fp)), np.tile(np.arange(len(ONE), len(MASKS), dtype=np.uint16), int((~odd).sum()))])
        to = mixed(z) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        z, mask, to = z[order], mask[order], to[order]
        edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        ends = [*edge[1:], len(z)]
        return pa.table({
            "bucket": pa.array(to[edge].astype(np.int64)),
            "z": pa.array([z[a:b].tobytes() for a, b in zip(edge, ends, strict=True)], pa.binary()),
            "mask": pa.array([mask[a:b].tobytes() for a, b in zip(edge, ends, strict=True)], pa.binary()),
        })

    def meet(group: pa.Table) -> pa.Table:
        z = np.frombuffer(b"".join(group["z"].to_pylist()), np.uint64)
        mask = np.frombuffer(b"".join(group["mask"].to_pylist()), np.uint16)
        got = meeting_links(z, mask).view(np.int64)
        return pa.table({"a": pa.array(got[:, 0]), "b": pa.array(got[:, 1])})

    spread_out = distinct.select("fp").repartition(-(-n // EMIT) or 1, "fp")  # the table itself has few files
    sent = map_arrow(spread_out, emit, "bucket long, z binary, mask binary", BATCH)
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(docs: DataFrame) -> DataFrame:
    """(fp, doc_id, mark, component_id) for each row."""
    fps = written(fingerprints(docs), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    stars = components(links(distinct))
    rooted = distinct.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least-documents")  # a table, so that a large root is split
    of = written(rooted.join(least, "root").select("fp", "component_id"), "components")
    return fps.join(of, "fp")


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, one that has the smallest id there.

    An id is a document: of rows that share one, one stays. It is one whose own group has that id as its smallest, never a copy of
    another document, and of several such texts that with the least checksum. Rows without an id can't be told apart and all
    stay.
    """
    stay = grouped(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.min("mark").alias("_mark"))
    kept = docs.where("doc_id is not null").withColumn("_mark", text_mark()).join(stay, ["doc_id", "_mark"], "left_semi").drop("_mark")
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null")).select(docs.columns)

"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors stay where they are read: a task builds a tree over each ``SHARD_ROWS`` of them, one after another, and asks each tree
all queries of a block, which is of a bounded size and goes to every task. A node of a tree bounds the inner product of a
query q with any point below it by q.centre + |q| * radius. Nodes are taken in the order of that bound, until it is less than
the query's kth score so far. That kth score is shared: a first job searches one shard for all queries, all tasks begin with
the kth scores found there, and a task goes on from shard to shard with what it has. A task gives k answers to a query, however
many shards it had; the best of all tasks are the answer. Scores are exact integers; ties go to the smaller id.

A block of queries is one pass over the vectors. Both are a fixed share of the rows in the query of this package, so there the
passes are one for each 3 million rows of 64 components, and what is shuffled is k rows for each query and task.

Components are floor(256 * x). Rows that are null, hold a null or non-finite component, or have no id take no part; vectors
of different length are compared as if the shorter went on with zeros; a query's own row is every row with its id, and
repeated rows count as often as they stand there, as queries too: rows that share a query's id give one list, of the best of
all their answers. Components so large that a score wouldn't fit a long raise an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread

SHARD_ROWS, LEAF = 20_000, 128
BLOCK_ROWS, BLOCK_BYTES = 60_000, 48 << 20  # of queries that go to every task at once


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(id, e array<double> of whole numbers) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), "embedding").where("id is not null and embedding is not null").where(fine)
    return rows.select("id", F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("double")).alias("e"))


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(x.value_lengths())
    values = np.asarray(x.flatten(), dtype=np.float64)
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class BallTree:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        # In the order of ids first, so that equal points stand by id in their leaf.
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []  # centre, radius, from, to, left, right
        todo = [(0, len(ids), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            part = self.x[lo:hi]
            centre = part.mean(0)
            away = np.sqrt(np.maximum(((part - centre) ** 2).sum(1), 0))
            me = len(self.nodes)
            self.nodes.append((centre, float(away.max()), lo, hi, -1, -1))
            if parent >= 0:
                n = list(self.nodes[parent])
                n[4 + side] = me
                self.nodes[parent] = tuple(n)
            if hi - lo > LEAF and away.max() > 0:
                a = part[away.argmax()]
                b = part[((part - a) ** 2).sum(1).argmax()]
                along = part @ (b - a)
                order = np.argsort(along, kind="stable")
                self.x[lo:hi], self.ids[lo:hi] = part[order], self.ids[lo:hi][order]
                mid = (lo + hi) // 2
                todo += [(lo, mid, me, 0), (mid, hi, me, 1)]
        self.centres = np.stack([n[0] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])
        big = np.abs(x).max(initial=0)
        self.exact = big * big * max(1, x.shape[1]) < 2**53
        self.scale = big * np.sqrt(max(1, x.shape[1]))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, found: list[list[tuple[int, int]]], bounds: np.ndarray) -> None:
        """Adds to the (score, -id) found so far for each query, at most k and kept as a heap, those that reach its bound and raises that;
        rows of a query's own id stay out.
        """
        norms = np.sqrt((queries**2).sum(1))
        # The bounds of all nodes at once, with room for rounding.
        upper = queries @ self.centres.T + norms[:, None] * self.radii[None]
        upper += 1e-9 * (1 + norms[:, None] * self.scale)
        if np.abs(queries).max(initial=0) * np.abs(self.x).max(initial=0) * max(1, queries.shape[1]) >= 2**62:
            raise ValueError("scores of such large components don't fit a long")
        ints = None if self.exact and (np.abs(queries).max(initial=0) * self.scale * np.sqrt(queries.shape[1]) < 2**53) else self.x.astype(np.int64)
        for n, (q, me, up, best) in enumerate(zip(queries, own.tolist(), upper, found, strict=True)):
            heap = [(-up[0], 0)]
            least = bounds[n]
            while heap and -heap[0][0] >= least:
                _, lo, hi, left, right = self.nodes[heapq.heappop(heap)[1]][1:]
                if left >= 0:
                    for child in (left, right):
                        if up[child] >= least:
                            heapq.heappush(heap, (-up[child], child))
                    continue
                score = self.x[lo:hi] @ q if ints is None else ints[lo:hi] @ q.astype(np.int64)
                for j in np.flatnonzero(score >= least):
                    i = int(self.ids[lo + j])
                    if i == me:
                        continue
                    got = (int(score[j]), -i)
                    if len(best) < k:
                        heapq.heappush(best, got)
                    elif got > best[0]:
                        heapq.heapreplace(best, got)
                if len(best) == k:
                    least = max(least, best[0][0])
            bounds[n] = least


def searched(rows: DataFrame, asked: pa.Table, bounds: np.ndarray, k: int) -> DataFrame:
    """(n, vec_id, score): for the nth query asked, at most k rows of each task that reach its bound. A task has one tree at a time."""
    sent = rows.sparkSession.sparkContext.broadcast((np.asarray(asked["id"]), matrix(asked["e"]), bounds))  # one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries, least = sent.value
        least, found = least.copy(), [[] for _ in own]
        held: list[pa.RecordBatch] = []

        def search() -> None:
            ids = np.concatenate([np.asarray(b.column(0)) for b in held])
            parts = [matrix(b.column(1)) for b in held]
            width = max(queries.shape[1], *(p.shape[1] for p in parts))
            x = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])
            BallTree(ids, x).search(np.pad(queries, ((0, 0), (0, width - queries.shape[1]))), own, k, found, least)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                held.append(batch.slice(at, SHARD_ROWS))
                if sum(b.num_rows for b in held) >= SHARD_ROWS:
                    search()
        if held:
            search()
        out = [(n, -i, s) for n, best in enumerate(found) for s, i in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["n", "vec_id", "score"])

    return rows.mapInArrow(run, "n long, vec_id long, score long")


def answers(rows: DataFrame, asked: pa.Table, share: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, times) for one block of queries: a first search in one of ``share`` parts of the rows, then all."""
    n = asked.num_rows
    bounds = np.full(n, -np.inf)
    if share > 1:
        part = rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(share)) == 0)  # some SHARD_ROWS rows, wherever they are
        best = F.sort_array(F.collect_list("score"), asc=False)
        first = searched(part, asked, bounds, k).groupBy("n").agg(F.get(best, F.lit(k - 1)).alias("kth")).where("kth is not null").toArrow()
        bounds[np.asarray(first["n"])] = np.asarray(first["kth"])
    names = rows.sparkSession.createDataFrame(pa.table({"n": pa.array(range(n), pa.int64()), "query_id": asked["id"], "times": asked["times"]}))
    return searched(rows, asked, bounds, k).join(F.broadcast(names), "n").drop("n")


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``, against all rows."""
    rows = whole_vectors(embeddings)
    queries = rows.where(F.col("id") % every == 0)
    n, n_queries, width = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.coalesce(F.max(F.size("e")), F.lit(0))).first()
    blocks = max(1, -(-n_queries // BLOCK_ROWS), -(-n_queries * (8 * width + 200) // BLOCK_BYTES))
    found = None
    for b in range(blocks):  # one pass each
        own = queries.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)) == b)
        asked = own.groupBy("id", "e").agg(F.count("*").alias("times")).toArrow()
        if asked.num_rows:
            got = answers(spread(rows), asked, -(-n // SHARD_ROWS), k)
            found = got if found is None else found.unionByName(got)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Each pair of a distinct query and a row was met once; a query that stands there n times has each answer n times.
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k)))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

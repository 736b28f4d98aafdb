"""Quality by a byte-level convolutional network in numpy.

Learned filters, each over ``WIDTH`` bytes, run over the whole document. They are pooled (largest and mean response) over
chunks of ``2 * BLOCK`` bytes that overlap by half; a small layer turns a chunk into one number, and the largest and mean
number of a document's chunks give its probability. The network is fitted on at most ``CHUNKS_OF_A_ROW`` chunks
each of at most ``MOST`` labelled rows with at most ``MOST_CHARS`` characters, taken in the order of a hash of the id; a fifth of them is kept back to fit how a document's chunks are combined.

Defined results: a null text counts as empty and is scored as a single blank; a null id isn't held out; repeated rows stay;
null labels and labels of ids without a row teach nothing; with too few labels of either kind every score is the share of
label 1 among them (0.5 without any). Only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_arrow, remainder, spread
from .toxicity import unlike

MOST, MOST_CHARS = 6000, 24 << 20
THRESHOLD = 0.3
WIDTH, EMBEDDED, FILTERS, HIDDEN, BLOCK = 6, 8, 16, 16, 128
CHUNK = 2 * BLOCK
CHUNKS_OF_A_ROW, BATCH, ROUNDS, RATE = 3, 64, 4, 3e-3


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    def __init__(self, weights: dict[str, np.ndarray], combined: np.ndarray):
        self.w, self.combined, self._tables = weights, combined, None

    def __reduce__(self):
        return Net, (self.w, self.combined)

    def tables(self) -> list[np.ndarray]:
        """For each pair of bytes, what it adds to every filter at places 0, 2 and 4 of the filter."""
        if self._tables is None:
            own = [self.w["embed"] @ k for k in self.w["filters"].reshape(WIDTH, EMBEDDED, FILTERS)]
            self._tables = [np.ascontiguousarray((own[j][:, None] + own[j + 1][None]).reshape(-1, FILTERS)) for j in range(0, WIDTH, 2)]
        return self._tables

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Of every filter at every place but the last WIDTH - 1."""
        pairs = data[:-1].astype(np.intp) << 8 | data[1:]
        n = len(data) - WIDTH + 1
        first, *rest = self.tables()
        out = first.take(pairs[:n], axis=0)
        part = np.empty_like(out)
        for j, t in enumerate(rest, 1):
            out += t.take(pairs[2 * j : 2 * j + n], axis=0, out=part, mode="clip")
        out += self.w["bias"]
        return np.maximum(out, 0, out=out)

    def chunk_scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of the chunks of all texts in order, and how many each text has."""
        sizes = np.array([max(1, len(t)) for t in texts])
        blocks = -(-sizes // BLOCK)
        high = np.empty((blocks.sum(), FILTERS), np.float32)
        mass = np.empty_like(high)
        at = 0
        for t, n in zip(texts, blocks, strict=True):
            # 1024 blocks at a time: a very long text needs no more memory than a short one.
            for k in range(0, n, 1024):
                m = min(1024, n - k)
                part = t[k * BLOCK : (k + m) * BLOCK + WIDTH - 1] or b"\0"
                data = np.zeros(m * BLOCK + WIDTH - 1, np.uint8)
                data[: len(part)] = np.frombuffer(part, np.uint8)
                got = self.responses(data)
                got[max(1, len(t) - k * BLOCK) :] = 0
                got = got.reshape(m, BLOCK, FILTERS)
                high[at : at + m], mass[at : at + m] = got.max(1), got.sum(1)
                at += m
        ends = np.cumsum(blocks)
        filled = np.full(ends[-1], float(BLOCK), np.float32)
        filled[ends - 1] = sizes - (blocks - 1) * BLOCK
        # A chunk is a block and the next one; a text's last block opens none, unless it is the only one.
        opens = np.ones(len(high), bool)
        opens[ends[blocks > 1] - 1] = False
        at = np.flatnonzero(opens)
        two = np.repeat(blocks > 1, blocks)[at]
        after = np.where(two, np.minimum(at + 1, len(high) - 1), at)
        high = np.maximum(high[at], high[after])
        mass = mass[at] + mass[after] * two[:, None]
        filled = filled[at] + filled[after] * two
        return self.head(high, mass / filled[:, None]), np.maximum(blocks - 1, 1)

    def head(self, high: np.ndarray, mean: np.ndarray) -> np.ndarray:
        w = self.w
        return np.tanh(np.concatenate([high, 4 * mean], 1) @ w["hidden"] + w["hidden_bias"]) @ w["out"] + w["out_bias"]

    def features(self, texts: list[bytes]) -> np.ndarray:
        if not self.w:
            return np.ones((len(texts), 1))
        scores, n = self.chunk_scores(texts)
        first = np.cumsum(n) - n
        low, mean = np.minimum.reduceat(scores, first), np.add.reduceat(scores, first) / n
        return np.stack([np.ones(len(n)), low, mean, np.maximum.reduceat(scores, first), np.minimum(low, 0) * np.log(n)], 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.features(texts) @ self.combined)


def fit_network(texts: list[bytes], y: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on the cross-entropy of single chunks, each with its row's label, both labels with equal weight."""
    r = np.random.default_rng(seed)
    f32 = lambda a: np.asarray(a, np.float32)
    w = {
        "embed": f32(r.normal(0, 0.5, (256, EMBEDDED))), "filters": f32(r.normal(0, 0.2, (WIDTH * EMBEDDED, FILTERS))), "bias": f32(np.zeros(FILTERS)),
        "hidden": f32(r.normal(0, 0.2, (2 * FILTERS, HIDDEN))), "hidden_bias": f32(np.zeros(HIDDEN)), "out": f32(r.normal(0, 0.3, HIDDEN)), "out_bias": f32(np.zeros(())),
    }
    step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    cuts = []
    for k, t in enumerate(texts):
        last = max(0, len(t) - CHUNK)
        cuts += [(k, int(a)) for a in ({0, last} | set(r.integers(0, last + 1, CHUNKS_OF_A_ROW - 2).tolist()))]
    cuts = np.array(cuts)
    label = y[cuts[:, 0]]
    rare = {v: np.flatnonzero(label == v) for v in (0, 1)}
    t = 0
    per_round = len(cuts) // BATCH
    for _ in range(ROUNDS * per_round):
        take = np.concatenate([r.choice(rare[0], BATCH // 2), r.choice(rare[1], BATCH // 2)])
        x = np.zeros((BATCH, CHUNK + WIDTH - 1), np.uint8)
        size = np.empty(BATCH, np.int64)
        for i, (k, a) in enumerate(cuts[take]):
            part = texts[k][a : a + CHUNK + WIDTH - 1] or b"\0"
            x[i, : len(part)] = np.frombuffer(part, np.uint8)
            size[i] = max(1, min(CHUNK, len(texts[k]) - a))
        goal = label[take].astype(np.float32)
        z = w["embed"][x]
        seen = np.concatenate([z[:, j : j + CHUNK] for j in range(WIDTH)], 2)
        h = seen @ w["filters"] + w["bias"]
        valid = np.arange(CHUNK) < size[:, None]
        a = np.where(valid[:, :, None], np.maximum(h, 0), 0)
        best = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, best[:, None], 1)[:, 0], 4 * a.sum(1) / size[:, None]], 1).astype(np.float32)
        u = np.tanh(pooled @ w["hidden"] + w["hidden_bias"])
        d = ((sigmoid(u @ w["out"] + w["out_bias"]) - goal) / BATCH).astype(np.float32)
        du = d[:, None] * w["out"] * (1 - u * u)
        dp = du @ w["hidden"].T
        da = np.repeat((4 * dp[:, FILTERS:] / size[:, None])[:, None], CHUNK, 1)
        np.put_along_axis(da, best[:, None], np.take_along_axis(da, best[:, None], 1) + dp[:, None, :FILTERS], 1)
        dh = np.where(a > 0, da, 0).astype(np.float32)
        flat = dh.reshape(-1, FILTERS)
        dz = np.zeros_like(z)
        ds = dh @ w["filters"].T
        for j in range(WIDTH):
            dz[:, j : j + CHUNK] += ds[:, :, j * EMBEDDED : (j + 1) * EMBEDDED]
        where = x.ravel()
        grad = {
            "embed": np.stack([np.bincount(where, dz[:, :, e].ravel(), 256) for e in range(EMBEDDED)], 1), "filters": seen.reshape(len(flat), -1).T @ flat, "bias": flat.sum(0),
            "hidden": pooled.T @ du, "hidden_bias": du.sum(0), "out": u.T @ d, "out_bias": d.sum(),
        }
        t += 1
        rate = RATE * min(1, 3 * (1 - t / (ROUNDS * per_round + 1)))
        for k, g in grad.items():
            m, v = step[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w[k] = f32(w[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
    return w


def learn(rows: list[tuple[str | None, int]]) -> Net:
    texts, y = [], []
    for v in (0, 1):
        some = unlike([t or "" for t, x in rows if x == v])
        texts += [t.encode() for t in some]
        y += [v] * len(some)
    y = np.array(y)
    if min((y == 0).sum(), (y == 1).sum()) < 10:
        share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
        return Net({}, np.array([np.log(share / (1 - share))]))
    back = np.random.default_rng(1).random(len(y)) < 0.2
    net = Net(fit_network([t for t, b in zip(texts, back, strict=True) if not b], y[~back]), np.zeros(5))
    own = [t for t, b in zip(texts, back, strict=True) if b]
    x = np.concatenate([net.features(own[k : k + 100]) for k in range(0, len(own), 100)])
    b = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps for a logistic curve with a little shrinkage
        p = sigmoid(x @ b)
        b = b + np.clip(np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.5 * np.eye(len(b)), x.T @ (y[back] - p) - 0.5 * b), -3, 3)
    return Net(net.w, b)


def quality_model(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Net:
    return learn(labelled_sample(docs, labels, "quality", 5, 0, most, MOST_CHARS))


def quality(docs: DataFrame, model: Net) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some thousand weights

    def run(batch: pa.RecordBatch) -> pa.Table:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return pa.table({"doc_id": batch.column(0), "score": pa.array(sent.value.scores(texts), pa.float64())})

    out = map_arrow(spread(docs.select("doc_id", "text")), run, f"doc_id {kind}, score double", 200)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Training on more words than one task should hold: all tasks of a barrier stage keep a share of the words each, and one of them,
the first, the counts of all pairs. It names the next pairs to be merged, and the others send back what that changed in their counts.

Of the best pairs in order, (a, b) before (c, d), both may be named at once unless d is a or c is b. Then the first merge leaves the
count of (c, d) as it is, and makes no pair that comes before it: a new pair (x, ab) or (ab, y) has at most the count of (x, a) or
(b, y), which come behind (c, d), and on equal counts it comes behind them, as its symbol is larger than a and b.

A pair's count never grows once the later one of its two symbols is made. So a pair that is made with a count below ``floor`` is
never merged before one that has ``floor``, and isn't counted at all; should all counted pairs fall below it before there are
enough merges, the training begins anew with a lower floor, at last 1. The floor saves memory and changes no merge.
"""

from __future__ import annotations

import heapq
import secrets
import socket
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

MADE = 1_000_000  # as in merges
WIDE = 1 << 21
END, ANEW = -1, -2
AT_ONCE = 256  # pairs named together
LARGE = 20_000  # places from which on they are sorted by 16 bits at a time
WAIT_SEC = 3600

Pairs = tuple[np.ndarray, np.ndarray]  # keys and sums


class Share:
    """The words of one task: all symbols one behind another, each with its neighbours, and the places of each pair.

    As a pair only begins to stand when the later one of its symbols is made, its places are kept with that symbol, by pair.
    """

    def __init__(self, s: np.ndarray, sizes: np.ndarray, n: np.ndarray):
        self.s, self.weight = s.copy(), np.repeat(n, sizes)
        ends = np.cumsum(sizes)
        self.after = np.arange(1, len(s) + 1, dtype=np.int32)
        self.after[ends[sizes > 0] - 1] = -1
        self.ahead = np.arange(-1, len(s) - 1, dtype=np.int32)
        self.ahead[(ends - sizes)[sizes > 0]] = -1
        self.made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # Symbols by their order, as long as that has 16 bits: these are sorted by digits.
        held = np.flatnonzero(np.bincount(s, minlength=1)) if len(s) else np.zeros(0, np.int64)
        self.n_codes, self.code = len(held), np.zeros(WIDE, np.uint16)
        if self.n_codes <= 1 << 16:
            self.code[held] = np.arange(self.n_codes)

    def pairs_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that begin at these places, each with its weight, and the places in the order of pairs."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), at
        left, right = self.s[at], self.s[self.after[at]]
        key = left.astype(np.int64) * WIDE + right
        if len(at) >= LARGE and self.n_codes <= 1 << 16:
            order = np.argsort(self.code[right], kind="stable")
            order = order[np.argsort(self.code[left[order]], kind="stable")]
        else:
            order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first], np.add.reduceat(self.weight[at], first, dtype=np.int64), first, at

    def keep(self, at: np.ndarray) -> Pairs:
        keys, sums, first, at = self.pairs_at(at)
        self.made.append((keys, np.append(first, len(at)), at))
        return keys, sums

    def distinct(self, *places: np.ndarray) -> np.ndarray:
        at = np.concatenate(places)
        if len(at) < LARGE or len(at) < len(self.s) >> 5:
            at.sort()
            return at[np.append(True, at[1:] != at[:-1])] if len(at) else at
        held = np.zeros(len(self.s), bool)
        held[at] = True
        return np.flatnonzero(held).astype(np.int32)

    def begin(self) -> Pairs:
        return self.keep(np.flatnonzero(self.after >= 0).astype(np.int32))

    def places(self, key: int) -> np.ndarray:
        left, right = divmod(key, WIDE)
        keys, first, at = self.made[max(left - MADE + 1, right - MADE + 1, 0)]
        j = int(np.searchsorted(keys, key))
        at = at[first[j] : first[j + 1]] if j < len(keys) and keys[j] == key else at[:0]
        at = at[(self.s[at] == left) & (self.after[at] >= 0)]
        at = at[self.s[self.after[at]] == right]
        if left == right and len(at):
            at = np.sort(at)
            follows = np.concatenate([[False], self.after[at[:-1]] == at[1:]])
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(follows, 0, index))) % 2 == 0]
        return at

    def merge(self, key: int, new: int) -> tuple[Pairs, Pairs]:
        """What pairs lose, and what pairs with the new symbol get."""
        at = self.places(key)
        gone = self.after[at]
        before, behind = self.ahead[at], self.after[gone]
        lost = self.pairs_at(self.distinct(before[before >= 0], at, gone[behind >= 0]))[:2]
        if self.n_codes < 1 << 16:
            self.code[new] = self.n_codes
        self.n_codes += 1
        self.s[at], self.s[gone] = new, -1
        self.after[at] = behind
        self.ahead[behind[behind >= 0]] = at[behind >= 0]
        before = self.ahead[at]
        return lost, self.keep(self.distinct(before[before >= 0], at[self.after[at] >= 0]))

    def standing(self) -> Pairs:
        """The symbols that stand now, and how often."""
        at = self.s >= 0
        own, n = self.s[at], np.zeros(WIDE, np.int64)
        np.add.at(n, own, self.weight[at])
        held = np.flatnonzero(np.bincount(own, minlength=1))
        return held, n[held]

    def merge_all(self, keys: list[int], new: int) -> Pairs:
        """What all pairs get or, below zero, lose when these are merged one after the other; ``new`` is the first one's symbol."""
        each = []
        for j, key in enumerate(keys):
            lost, got = self.merge(key, new + j)
            each += [(lost[0], -lost[1]), got]
        return summed(each)


class Counts:
    """The counts of all pairs that have reached the floor."""

    def __init__(self, pairs: Pairs, floor: int):
        self.floor = floor
        kept = pairs[1] >= floor
        self.total = dict(zip(pairs[0][kept].tolist(), pairs[1][kept].tolist(), strict=True))
        self.heap = [(-c, q) for q, c in self.total.items()]
        heapq.heapify(self.heap)

    def best(self, most: int) -> list[int]:
        """The best pair, and those next to it in order that its merge and each other's leave as they are."""
        out: dict[int, None] = {}
        lefts, rights = set(), set()
        while self.heap and len(out) < most:
            c, key = heapq.heappop(self.heap)
            if self.total.get(key) != -c or key in out:
                continue
            left, right = divmod(key, WIDE)
            if right in lefts or left in rights:
                heapq.heappush(self.heap, (c, key))
                break
            out[key] = None
            lefts.add(left)
            rights.add(right)
        return list(out)

    def change(self, pairs: Pairs) -> None:
        total, floor = self.total, self.floor
        # Only pairs with a new symbol gain, and those aren't counted yet. Most are below the floor, and stay so.
        some = pairs[1] >= floor
        if len(pairs[0]):
            counted = np.fromiter(total, np.int64, len(total))
            at = np.minimum(np.searchsorted(pairs[0], counted), len(pairs[0]) - 1)
            some[at[pairs[0][at] == counted]] = True
            some &= pairs[1] != 0
        for q, c in zip(pairs[0][some].tolist(), pairs[1][some].tolist(), strict=True):
            c += total.get(q, 0)
            if c >= floor:
                total[q] = c
                heapq.heappush(self.heap, (-c, q))
            else:
                total.pop(q, None)


def summed(each: list[Pairs]) -> Pairs:
    """One of several, each of them in order and without a key twice."""
    each = [x for x in each if len(x[0])]
    if not each:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(each) == 1:
        return each[0]
    key, n = np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _send(to: socket.socket, pairs: Pairs) -> None:
    to.sendall(struct.pack("<q", len(pairs[0])) + pairs[0].tobytes() + pairs[1].tobytes())


def _exactly(of: socket.socket, size: int) -> bytearray:
    out, at = bytearray(size), 0
    while at < size:
        got = of.recv_into(memoryview(out)[at:])
        if not got:
            raise ConnectionError("a task of the training has gone")
        at += got
    return out


def _receive(of: socket.socket) -> Pairs:
    size = struct.unpack("<q", _exactly(of, 8))[0]
    both = np.frombuffer(_exactly(of, 16 * size), np.int64)
    return both[:size], both[size:]


def _connected(context) -> list[socket.socket]:
    """For the first task its connections to all others, for these the one to the first."""
    me, host = context.partitionId(), context.getTaskInfos()[0].address.rsplit(":", 1)[0]
    if me:
        port, secret = context.allGather("")[0].split()
        own = socket.create_connection((host, int(port)), WAIT_SEC)
        own.sendall(bytes.fromhex(secret))
        out = [own]
    else:
        with socket.create_server((host, 0), backlog=1024) as server:
            server.settimeout(WAIT_SEC)
            secret, out = secrets.token_hex(16), []
            others = len(context.allGather(f"{server.getsockname()[1]} {secret}")) - 1
            while len(out) < others:
                own = server.accept()[0]
                own.settimeout(WAIT_SEC)
                if secrets.compare_digest(bytes(_exactly(own, 16)), bytes.fromhex(secret)):
                    out.append(own)
    for x in out:
        x.settimeout(WAIT_SEC)
        x.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return out


def _lead(others: list[socket.socket], words: tuple, k: int) -> tuple[list[tuple[int, int]], Pairs]:
    """The pairs that are merged, in order, and what stands after all merges."""
    floor = None
    while True:
        share = Share(*words)
        first = summed([share.begin(), *map(_receive, others)])
        # The last of k merges seldom has less than this; a guess, which is lowered where it is wrong.
        floor = max(1, int(first[1].sum()) // (64 * k)) if floor is None else max(1, floor // 8)
        counts, out = Counts(first, floor), []
        del first
        while len(out) < k and (keys := counts.best(min(k - len(out), AT_ONCE))):
            said = struct.pack(f"<{len(keys) + 1}q", len(keys), *keys)
            for x in others:
                x.sendall(said)
            counts.change(summed([share.merge_all(keys, MADE + len(out)), *map(_receive, others)]))
            out += [divmod(key, WIDE) for key in keys]
        done = len(out) == k or floor == 1
        for x in others:
            x.sendall(struct.pack("<q", END if done else ANEW))
        if done:
            return out, summed([share.standing(), *map(_receive, others)])


def _follow(lead: socket.socket, words: tuple) -> None:
    said = ANEW
    while said == ANEW:
        share, m = Share(*words), 0
        _send(lead, share.begin())
        while (said := struct.unpack("<q", _exactly(lead, 8))[0]) >= 0:
            keys = struct.unpack(f"<{said}q", _exactly(lead, 8 * said))
            _send(lead, share.merge_all(keys, MADE + m))
            m += said
    _send(lead, share.standing())


def best_pairs_alone(s: np.ndarray, sizes: np.ndarray, n: np.ndarray, k: int) -> tuple[list[tuple[int, int]], Pairs]:
    """The same by one task that has all words."""
    return _lead([], (s.astype(np.int32), np.asarray(sizes, np.int64), np.asarray(n, np.int64)), k)


#: What a training gives: the pairs' symbols in the order of merges; the symbols after all merges, and how often they stand.
TRAINED = {"l": "array<long>", "r": "array<long>", "sym": "array<long>", "n": "array<long>"}


def as_columns(out: list[tuple[int, int]], standing: Pairs) -> list[pa.Array]:
    """TRAINED as columns of one row."""
    return [pa.array([x], pa.list_(pa.int64())) for x in ([a for a, _ in out], [b for _, b in out], *standing)]


def best_pairs_together(words: DataFrame, k: int, tasks: int, numbers) -> Row:
    """TRAINED of (word, n). ``numbers`` gives the symbols of words and how many each word has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        s, sizes, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            a, b = numbers(batch.column(0))
            s.append(a.astype(np.int32))
            sizes.append(b.astype(np.int64))
            n.append(np.asarray(batch.column(1), np.int64))
        own = np.concatenate(s), np.concatenate(sizes), np.concatenate(n)
        del s, sizes, n
        context = BarrierTaskContext.get()
        others = _connected(context)
        if context.partitionId():
            _follow(others[0], own)
        else:
            yield pa.RecordBatch.from_arrays(as_columns(*_lead(others, own, k)), list(TRAINED))
        for x in others:
            x.close()

    spread = words.select("word", "n").repartition(tasks, "word")
    return spread.mapInArrow(run, ", ".join(map(" ".join, TRAINED.items())), barrier=True).collect()[0]

"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has one encoding, so one last token. A token that ends at a position is that last token if and
only if it and the last token of what stands before it stay apart when the two are merged on their own. Candidates are
the tokens that are suffixes of the prefix; an automaton with suffix links over all tokens finds them, longest first.
Back-pointers then give the ids. Words are encoded once each; a worker keeps as many as fit a bound of bytes.

Nulls and empty texts have no ids and decode to the empty string. Repeated rows stay; other columns are left out.
"""

from __future__ import annotations

import ctypes
import gc
import json
import unicodedata
from collections import deque
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import gathered, map_arrow, spread

END = 256  # added to the symbol of a word's last byte
WORDS_KEPT = 32 << 20  # bytes of words and their ids
PAIRS_KEPT = 200_000
BEGINNING, BEGINNINGS_KEPT, LONG = 6, 40_000, 1000
OTHER = regex.compile(r"[^\x00-\x1b\x20-\x84\x86-\u024f]").search


def byte_characters() -> list[str]:
    """The printable stand-in for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder:
    """Of a tokenizers JSON file whose model is BPE with an end-of-word suffix."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        names = byte_characters()
        first = [vocab[c] for c in names] + [vocab[c + suffix] for c in names]
        self.of_symbol = first
        self.symbols: dict[int, tuple[int, ...]] = {t: (s,) for s, t in enumerate(first)}
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = dict.fromkeys(first, -1)
        for k, merge in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            made = vocab[self.tokens[a] + self.tokens[b]]
            if made in self.rank:
                raise ValueError("two merges make one token; its parts aren't unique")
            self.pairs[a, b], self.parts[made], self.rank[made] = made, (a, b), k
            self.symbols[made] = self.symbols[a] + self.symbols[b]
        self.known: dict[int, bool] = {}
        self._automaton()
        del self.symbols
        self.words: dict[str, list[int]] = {}
        self.words_size = 0
        self.beginnings: dict[bytes, tuple[int, tuple[int, ...]]] = {}
        # The library's normalizer and splitter only: its own vocabulary isn't kept.
        lib = Tokenizer.from_str(text)
        self.normalizer, self.splitter, self.byte_of = lib.normalizer, lib.pre_tokenizer, {c: b for b, c in enumerate(names)}
        inner = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.split = regex.compile(inner).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def _automaton(self) -> None:
        goto: dict[int, int] = {}
        ends, depth = [-1], [0]
        for token, symbols in self.symbols.items():
            at = 0
            for s in symbols:
                key = at << 9 | s
                if key not in goto:
                    goto[key] = len(ends)
                    ends.append(-1)
                    depth.append(depth[at] + 1)
                at = goto[key]
            ends[at] = token
        below: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, node in goto.items():
            below[key >> 9].append((key & 511, node))
        link = [0] * len(ends)
        chainof: list[tuple[int, ...]] = [()] * len(ends)  # tokens that are suffixes of the node's string, longest first
        queue = deque(n for _, n in below[0])
        for n in queue:
            chainof[n] = (ends[n],) if ends[n] >= 0 else ()
        while queue:
            node = queue.popleft()
            for s, child in below[node]:
                to = link[node]
                while to and (to << 9 | s) not in goto:
                    to = link[to]
                link[child] = goto.get(to << 9 | s, 0)
                chainof[child] = ((ends[child],) if ends[child] >= 0 else ()) + chainof[link[child]]
                queue.append(child)
        self.size = {t: len(s) for t, s in self.symbols.items()}
        # Most nodes end no token of their own and share the list of the node that they are linked to.
        sized = {t: (t, n) for t, n in self.size.items()}
        shared: dict[tuple[int, ...], tuple[tuple[int, int], ...]] = {}
        self.goto, self.link, self.found = goto, link, [shared.setdefault(x, tuple(map(sized.__getitem__, x))) for x in chainof]

    def apart(self, left: int, right: int) -> bool:
        """Whether left and right, put side by side, encode to just these two tokens.

        Undoes merges from the latest on. At each moment the two symbols at the seam are the last part of left and the
        first part of right as they then stood. They would have been merged, were there a merge of both that came
        before either of them was taken up into something larger.
        """
        key = left << 17 | right
        got = self.known.get(key)
        if got is not None:
            return got
        if len(self.known) > PAIRS_KEPT:
            self.known.clear()
        rank, parts, pairs = self.rank, self.parts, self.pairs
        # A merge over the seam wins while both symbols stand there. On equal ranks the left place goes first: a symbol
        # of the left side is taken up before the seam, one of the right side after it.
        a, b = left, right
        until, on_left = float("inf"), False  # rank at which the present seam ends, and on which side
        while True:
            made = pairs.get((a, b))
            if made is not None and (rank[made] < until or rank[made] == until and not on_left):
                out = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                out = True
                break
            # The later of the two last merges is undone first; of equals, the right one came later.
            if ra > rb:
                until, on_left, a = ra, True, parts[a][1]
            else:
                until, on_left, b = rb, False, parts[b][0]
        self.known[key] = out
        return out

    def _on(self, data: bytes, last: list[int], node: int, upto: int) -> int:
        """Last tokens of the prefixes from len(last) bytes on up to ``upto``, appended to last; the automaton's node there."""
        goto, link, found, known, apart = self.goto.get, self.link, self.found, self.known.get, self.apart
        n = len(data)
        for i in range(len(last), upto + 1):
            s = data[i - 1] + (END if i == n else 0)
            while (to := goto(node << 9 | s)) is None:
                if not node:
                    to = 0
                    break
                node = link[node]
            node = to
            for t, size in found[node]:
                if size == i:
                    break
                if (ok := known(last[i - size] << 17 | t)) is None:
                    ok = apart(last[i - size], t)
                if ok:
                    break
            else:
                raise ValueError(f"no last token for a prefix of {data!r}")
            last.append(t)
        return node

    def word(self, word: str) -> list[int]:
        data = word.encode()
        n = len(data)
        if n > BEGINNING:
            # The last tokens of a word's first prefixes are those of any word that begins so.
            kept = self.beginnings.get(data[:BEGINNING])
            if kept is None:
                if len(self.beginnings) > BEGINNINGS_KEPT:
                    self.beginnings.clear()
                last = [0]
                node = self._on(data, last, 0, BEGINNING)
                self.beginnings[data[:BEGINNING]] = node, tuple(last)
            else:
                node, last = kept[0], list(kept[1])
        else:
            node, last = 0, [0]
        self._on(data, last, node, n)
        out = []
        while n:
            out.append(t := last[n])
            n -= self.size[t]
        return out[::-1]

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.split(text.lower())
        if not OTHER(text):
            return self.split(unicodedata.normalize("NFC", text).lower())
        # Beyond Latin, releases of Unicode differ in what is a letter: the splitter itself says what the words are.
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, x)).decode() for x, _ in pieces]

    def plain(self, text: str) -> list[int]:
        words, kept = self._words(text), self.words
        try:
            return list(chain.from_iterable([kept[w] for w in words]))
        except KeyError:
            pass
        if self.words_size > WORDS_KEPT:
            kept.clear()
            self.words_size = 0
        out = []
        for w in words:
            ids = kept.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) < LONG:  # a longer one hardly comes again
                    kept[w] = ids
                    self.words_size += 200 + 4 * len(w) + 8 * len(ids)
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut and "<|" in text:
            out = []
            for x in self.cut(text):
                out += [self.special[x]] if x in self.special else self.plain(x)
            return out
        return self.plain(text)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file; the file must be installed on every machine, as the library is."""
    if path not in _made:
        with open(path, encoding="utf-8") as f:
            _made[path] = Encoder(f.read())
        give_back()
    return _made[path]


def give_back() -> None:
    """What reading a tokenizer took and no longer needs goes back to the system, where its C library can do that."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bpe_encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.Table:
        of = encoder(tokenizer)
        ids = [of.encode(t) for t in batch.column(1).to_pylist()]
        return pa.table({"id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(map(of.decode, ids), pa.string())})

    return map_arrow(gathered(spread(df.select(id_col, text_col))), run, f"id {kind}, ids array<int>, decoded string", 500).withColumnRenamed("id", id_col)

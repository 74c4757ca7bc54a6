"""Byte-level BPE ids of whole texts by speculation and verification.

Every distinct word of a batch is first cut greedily into the longest tokens
that fit, all words at once in numpy.  The proposal is the true encoding if
and only if no pair of adjacent tokens would have merged across its border,
which is tested for all pairs at once by undoing their merges from the last to
the first.  Only words with a failing pair go through the exact merges.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"

# The published word pattern of the vocabulary; \s is spelled out as the White_Space property.
_SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Words of more bytes are cut by a table of the longest match at every place instead of in waves.
_LONG = 64
_CACHE = 300_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens, merges and the tables that the vectorised steps look up."""

    def __init__(self, text: str | bytes):
        model = json.loads(text)["model"]
        letters = _byte_letters()
        ids: dict[str, int] = model["vocab"]
        spelled = {t: bytes(letters[c] for c in t) for t in ids if all(c in letters for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = max(ids.values()) + 1
        self.left, self.right, self.rank = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.merges[x, y] = rank, z
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, rank
        keys = np.array([x << 32 | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        # Tokens that no merge makes and that are not single bytes can't come out of the exact merges, so none is proposed.
        usable = {b: ids[t] for t, b in spelled.items() if len(b) == 1 or self.rank[ids[t]] >= 0}
        self.bytes_ids = np.full(256, -1, np.int64)
        for b, i in usable.items():
            if len(b) == 1:
                self.bytes_ids[b[0]] = i
        if (self.bytes_ids < 0).any():
            raise ValueError(f"the vocabulary lacks a token for the bytes {np.flatnonzero(self.bytes_ids < 0).tolist()}")
        self.ids = usable
        self.longest = max(map(len, usable))
        names = list(usable)
        flat = np.frombuffer(b"".join(names), np.uint8)
        self.size = np.zeros(n, np.int64)
        self.start = np.zeros(n, np.int64)
        ends = np.cumsum([len(b) for b in names])
        numbers = np.array([usable[b] for b in names])
        self.size[numbers] = [len(b) for b in names]
        self.start[numbers] = ends - self.size[numbers]
        self.flat = flat
        hashes = _spans(_prefix(flat), ends - self.size[numbers], ends)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for s in np.unique(self.size[numbers]):
            own = self.size[numbers] == s
            o = np.argsort(hashes[own])
            self.by_size[int(s)] = hashes[own][o], numbers[own][o]


def _prefix(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte times power up to each place, and the inverse powers: any span's hash is one difference and product."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(flat), _BASE)]))
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(flat), _INVERSE)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    return sums, inverse


def _spans(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (prefix[0][end] - prefix[0][start]) * prefix[1][start]


def longest_matches(v: Vocabulary, word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(token, size) of the longest token that starts at each byte of the word."""
    flat = np.frombuffer(word, np.uint8)
    prefix, n = _prefix(flat), len(flat)
    got, length = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    open_ = np.arange(n)
    for s in sorted(v.by_size, reverse=True):
        try_ = open_[open_ + s <= n]
        known, numbers = v.by_size[s]
        h = _spans(prefix, try_, try_ + s)
        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[k] == h
        got[try_[hit]], length[try_[hit]] = numbers[k[hit]], s
        open_ = open_[got[open_] < 0]
    return got, length


def propose(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Greedy longest-match tokens of all words, none empty: (tokens, word of each token), in order of word and place.

    Short words advance together, one token a wave.  A long word would need as
    many waves as it has tokens, so it follows the table of its longest matches.
    """
    sizes = np.array([len(w) for w in words])
    short = np.flatnonzero(sizes <= _LONG)
    tokens, owners = _waves(v, [words[i] for i in short]) if len(short) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(short) == len(words):
        return tokens, owners
    parts, of = [tokens], [short[owners]]
    for i in np.flatnonzero(sizes > _LONG):
        got, length = longest_matches(v, words[i])
        step, at, path = length.tolist(), 0, []
        while at < len(step):
            path.append(at)
            at += step[at]
        parts.append(got[path])
        of.append(np.full(len(path), i))
    t, o = np.concatenate(parts), np.concatenate(of)
    order = np.argsort(o, kind="stable")
    return t[order], o[order]


def _waves(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    at = np.concatenate([[0], end[:-1]])
    prefix = _prefix(flat)
    live = np.arange(len(words))
    tokens, owners, waves = [], [], []
    wave = 0
    sizes = sorted(v.by_size, reverse=True)
    while len(live):
        pos, stop = at[live], end[live]
        got, length = np.full(len(live), -1, np.int64), np.zeros(len(live), np.int64)
        open_ = np.arange(len(live))
        room = int((stop - pos).max())
        for s in sizes:
            if s > room:
                continue
            try_ = open_[stop[open_] - pos[open_] >= s]
            if not len(try_):
                continue
            known, numbers = v.by_size[s]
            h = _spans(prefix, pos[try_], pos[try_] + s)
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[k] == h
            if hit.any():
                got[try_[hit]], length[try_[hit]] = numbers[k[hit]], s
                open_ = open_[got[open_] < 0]
                if not len(open_):
                    break
        tokens.append(got)
        owners.append(live)
        waves.append(np.full(len(live), wave))
        at[live] = pos + length
        live = live[at[live] < stop]
        wave += 1
    t, o, w = np.concatenate(tokens), np.concatenate(owners), np.concatenate(waves)
    order = np.lexsort((w, o))
    return t[order], o[order]


def spelled(v: Vocabulary, tokens: np.ndarray) -> np.ndarray:
    """The bytes of the tokens, one after the other."""
    size = v.size[tokens]
    first = np.repeat(v.start[tokens] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return v.flat[first + np.arange(int(size.sum()))]


def compatible(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the tokens a, b stay two when their bytes stand side by side.

    Time runs backwards over the merges.  x is the piece left of the border, y
    the one to the right of it.  They lived side by side until one of them was
    merged into its parent; had they a merge of an earlier rank, it would have
    come first.  Of two merges of one rank the one further left comes first.
    """
    x, y = a.astype(np.int64), b.astype(np.int64)
    until = np.full(len(x), np.iinfo(np.int64).max)
    good = np.ones(len(x), bool)
    live = np.arange(len(x))
    while len(live):
        xs, ys = x[live], y[live]
        key = xs << 32 | ys
        k = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        clash = (v.pair_keys[k] == key) & (2 * v.pair_ranks[k] < until[live])
        good[live[clash]] = False
        live = live[~clash & (np.maximum(v.rank[xs], v.rank[ys]) >= 0)]
        xs, ys = x[live], y[live]
        undo_left = v.rank[xs] > v.rank[ys]
        until[live] = np.where(undo_left, 2 * v.rank[xs], 2 * v.rank[ys] + 1)
        x[live] = np.where(undo_left, v.right[xs], xs)
        y[live] = np.where(undo_left, ys, v.left[ys])
    return good


def merge_exactly(v: Vocabulary, word: bytes) -> list[int]:
    """The merges in order of rank, leftmost first, with a queue: n log n steps for a word of n bytes."""
    piece = [int(v.bytes_ids[c]) for c in word]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (m := v.merges.get((piece[i], piece[j]))):
            heapq.heappush(queue, (m[0], i, piece[i], piece[j], m[1]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, x, y, z = heapq.heappop(queue)
        j = after[i] if piece[i] == x else n
        if j >= n or piece[j] != y:
            continue
        piece[i], piece[j] = z, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in piece if p >= 0]


class Encoder:
    """Ids of texts; words that were met before are looked up."""

    def __init__(self, text: str | bytes):
        self.v = Vocabulary(text)
        self.words = regex.compile(WORDS)
        self.known: dict[str, list[int]] = {}
        self.merged = 0

    @classmethod
    def read(cls, path: str) -> "Encoder":
        with open(path, "rb") as f:
            return cls(f.read())

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words that are not known yet."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        tokens, of = propose(self.v, raw)
        good = np.ones(len(raw), bool)
        # Equal hashes of unequal bytes would show here.
        byte_of = np.repeat(np.arange(len(raw)), [len(b) for b in raw])
        good[byte_of[spelled(self.v, tokens) != np.frombuffer(b"".join(raw), np.uint8)]] = False
        side = np.flatnonzero(of[1:] == of[:-1])
        good[of[side[~compatible(self.v, tokens[side], tokens[side + 1])]]] = False
        cuts = np.searchsorted(of, np.arange(len(raw) + 1))
        listed = tokens.tolist()
        for k, word in enumerate(new):
            if good[k]:
                self.known[word] = listed[cuts[k] : cuts[k + 1]]
            else:
                self.merged += 1
                self.known[word] = merge_exactly(self.v, raw[k])

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text as it is stored; a null or empty text has none."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > _CACHE:
            self.known.clear()
        self.learn(set(itertools.chain.from_iterable(cut)))
        known = self.known
        return [list(itertools.chain.from_iterable([known[w] for w in words])) for words in cut]


#: The encoder of this worker process, kept from task to task.
_KEPT: dict[str, Encoder] = {}


def _encoder(name: str, text: bytes) -> Encoder:
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Encoder(text)
    return _KEPT[name]


def _characters(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``most`` bytes of text, one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) // most) if len(sizes) else sizes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in itertools.pairwise(cuts):
        if b > a:
            yield batch.slice(a, b - a)


def encoded(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = os.path.join(TOKENIZERS, "byte_bpe_50k.json"), only_size: bool = False) -> DataFrame:
    """(id, ids) of every row, or (id, n) with ``only_size``; special tokens are never added, their spellings are plain text.

    A null or an empty text has an empty list.  Rows are neither dropped nor
    merged, whatever their id; other columns are ignored.  The vocabulary file
    is read by the driver and goes to the workers by broadcast, a few MB.
    """
    with open(path, "rb") as f:
        held = f.read()
    name, vocabulary = hashlib.sha256(held).hexdigest(), documents.sparkSession.sparkContext.broadcast(held)
    kept = documents.select(F.col(id_col), F.col(text_col).alias("_text"))
    name = documents.schema[id_col]
    value = T.StructField("n", T.LongType()) if only_size else T.StructField("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        encoder = _encoder(name, vocabulary.value)
        for batch in batches:
            for some in _characters(batch, "_text"):
                found = encoder.encode(some.column("_text").to_pylist())
                if only_size:
                    out = pa.array([len(x) for x in found], pa.int64())
                else:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(ends[-1]))
                    out = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([some.column(0), out], [id_col, value.name])

    return kept.mapInArrow(run, T.StructType([name, value]))

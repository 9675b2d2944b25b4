"""Byte-level BPE: texts to token ids and back, merging many words at once in numpy matrices.

Each text is cut by the vocabulary's pattern; text between single spaces is remembered with its ids, so
the pattern runs once for each distinct piece. The distinct words that a worker has not met lately are
sorted into buckets by byte length; a bucket is a padded matrix of token ids, one word a row. In each
round every row merges its leftmost pair of the smallest rank: ranks of neighbouring pairs are held in
a second matrix, pairs are looked up in a hash table, and one shift closes the gap that the merge left.
Rows without a pair to merge leave the matrix. Words above ``LONG`` bytes are merged one by one with a
heap by the same rule, because a matrix row costs the square of its length.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from digitscope.llm.shared import slices

# Bytes of the longest word that is merged in a matrix.
LONG = 256
# Cells of a matrix, and pieces of text that a worker remembers.
CELLS = 1 << 19
REMEMBERED = 400_000

_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Hash table from pairs of token ids to the id of the merged token, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int32)
        self.probes, slot, left = 1, self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask
            self.probes += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
        """Merged ids, ``_NONE`` where the pair does not merge or one side is padding."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        keys = left.astype(np.int64) * base + right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        held = self.keys[slot]
        found = np.where(held == keys, self.values[slot], _NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0) & (keys >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return found.reshape(shape)


class Tokenizer:
    """Encoder and decoder of one vocabulary: lines of a base64 token and its rank, which is its id.

    ``spaced`` says that a match of the pattern holds a space at its start only, or is white space alone.
    """

    def __init__(self, data: bytes, pattern: str, spaced: bool = True):
        self.spaced, self.runs = spaced, re.compile(r"\s\s").search
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for bytes {missing}")
        self.find = regex.compile(pattern).findall
        self.base = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.base
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.numbers = list(range(self.base))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.known: dict[str, tuple[int, ...]] = {}

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; a null text has none."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, cut = self.known, [self._pieces(t or "") for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(known))
        words = [self.find(piece) for piece in new]
        distinct = list(set(chain.from_iterable(words)))
        merged = dict(zip(distinct, self._merge_all([w.encode() for w in distinct]), strict=True))
        number = self.numbers.__getitem__
        for piece, parts in zip(new, words, strict=True):
            known[piece] = tuple(map(number, chain.from_iterable(map(merged.__getitem__, parts))))
        return [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in cut]

    def _pieces(self, text: str) -> list[str]:
        """Cut before single spaces, where no match of the pattern goes across; else leave the text whole."""
        if not self.spaced or self.runs(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def decode(self, ids: list[int] | None) -> bytes:
        """The bytes of token ids; null is empty."""
        return b"".join(map(self.tokens.__getitem__, ids)) if ids else b""

    def _merge_all(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = [whole]
            elif len(word) > LONG:
                out[i] = self._merge_long(word)
            else:
                buckets.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                some = rows[at:at + step]
                for i, ids in zip(some, self._merge_matrix([words[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _merge_matrix(self, words: list[bytes], width: int) -> list[list[int]]:
        length = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < length[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), width), _NONE, np.int32)
        ranks[:, :-1] = self.pairs.get(ids[:, :-1], ids[:, 1:], self.base)
        out: list[list[int]] = [[]] * len(words)
        rows = np.arange(len(words))
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            live = best < _NONE
            if not live.all():
                for i, got, n in zip(rows[~live].tolist(), ids[~live].tolist(), length[~live].tolist(), strict=True):
                    out[i] = got[:n]
                rows, ids, ranks, length, at, best = (x[live] for x in (rows, ids, ranks, length, at, best))
                if not len(rows):
                    break
            each, length = np.arange(len(rows)), length - 1
            ids[each, at] = best
            shift = np.arange(ids.shape[1] - 1)[None, :]
            shift = shift + (shift > at[:, None])
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)
            last = ids.shape[1] - 1
            after = np.where(at < last, ids[each, np.minimum(at + 1, last)], -1)
            ranks[each, np.minimum(at, last)] = self.pairs.get(best, after, self.base)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.pairs.get(ids[some, at[some] - 1], best[some], self.base)
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        """The same merges for one long word, with a heap of (rank, place) over linked pieces."""
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.ranks.get
        now: list[int | None] = [None] * n

        def offer(i: int) -> None:
            now[i] = rank = get(word[i:end[end[i]]]) if end[i] < n else None
            if rank is not None:
                heapq.heappush(heap, (rank, i))

        heap: list[tuple[int, int]] = []
        for i in range(n):
            offer(i)
        while heap:
            rank, i = heapq.heappop(heap)
            if now[i] != rank:
                continue
            gone = end[i]
            end[i], now[gone] = end[gone], None
            if end[i] < n:
                before[end[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        ids, i = [], 0
        while i < n:
            ids.append(get(word[i:end[i]]))
            i = end[i]
        return ids


_LOADED: dict[tuple[int, int, str], Tokenizer] = {}


def _tokenizer(data: bytes, pattern: str) -> Tokenizer:
    """The worker's tokenizer; built once and kept while the worker lives."""
    key = (len(data), hash(data), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(data, pattern)
    return _LOADED[key]


def _vocabulary(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """Add ``ids array<int>``, the token ids of the whole ``text``, as encode_ordinary of tiktoken gives them.

    ``path`` is a rank file on the driver; its few hundred kilobytes are broadcast. With ``decoded``, a
    binary column of that name gets the bytes which the ids decode to, in the same pass. Map-only; a null
    or empty text has no ids; other columns, nulls and repeated rows pass through; a column named like a
    new one is replaced. Very long words and texts are encoded whole.
    """
    data = _vocabulary(docs.sparkSession, path)
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    new = [F.lit(None).cast("array<int>").alias(ids)] + ([F.lit(None).cast("binary").alias(decoded)] if decoded else [])
    schema = docs.select(*kept, *new).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tokenizer(data.value, pattern)
        for batch in batches:
            for part in slices(batch, text):
                got = tool.encode_many(part.column(text).to_pylist())
                columns = [*part.columns, pa.array(got, pa.list_(pa.int32()))]
                names = [*part.schema.names, ids]
                if decoded:
                    columns.append(pa.array([tool.decode(x) for x in got], pa.binary()))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*kept).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded binary``, the bytes of the token ids; null or empty ids give no bytes. Map-only."""
    data = _vocabulary(tokens.sparkSession, path)
    kept = [c for c in tokens.columns if c != decoded]
    schema = tokens.select(*kept, F.lit(None).cast("binary").alias(decoded)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tokenizer(data.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                got = [tool.decode(x) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*part.schema.names, decoded])

    return tokens.select(*kept).mapInArrow(run, schema)

"""Phrases whose words stand together more often than apart, counted in counting quotient filters.

Phrases are built level by level. A phrase of n words is a pair of phrases of n - 1 words, its first and its last n - 1 ones; it
can be frequent only if both are. Frequent words and phrases have numbers, so a phrase is always a packed pair of numbers, and
that pair, permuted without loss, is its key: the upper bits are the quotient, all others the remainder, and nothing is
hashed away.

Texts are read once. Every shard (a bounded run of words of one task) turns its words into numbers of its own and keeps this
sequence. On each level a shard counts its pairs in a filter and sends it in pieces, cut by the first bits of the quotient. As keys are
permuted, pieces are of like size whatever the words are. The pieces of all shards, sorted by construction, are merged, the frequent
phrases get their numbers, and each shard is told the numbers of its own keys. No dictionary is broadcast.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from digitscope.llm.shared import parts, slices, stored

# Words of a shard, bytes of text that are split into words at a time, and of a shard's sequence in a row.
SHARD, SLAB, CHUNK = 1 << 21, 1 << 22, 1 << 24
# Groups in which the best phrases of a language are looked for first.
SALTS = 64

# What ends a piece, what parts words, and what is folded.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_BREAK = b"\xff"  # in no UTF-8 text
_FOLD = bytes(_BREAK[0] if b in ENDS else 32 if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _scrambled(x: np.ndarray, turn: int, width: int) -> np.ndarray:
    x = (x + _MIX[turn]) * _MIX[1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[2]
    return (x ^ (x >> np.uint64(32))) * _MIX[3] >> np.uint64(64 - width)


def permuted(left: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Permute pairs of numbers below ``2 ** width``: four rounds, each of which can be taken back."""
    high, low = left.astype(np.uint64), right.astype(np.uint64)
    for turn in (0, 2):
        high = high ^ _scrambled(low, turn, width)
        low = low ^ _scrambled(high, turn + 1, width)
    return high, low


def restored(high: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that ``permuted`` made these of."""
    for turn in (2, 0):
        low = low ^ _scrambled(high, turn + 1, width)
        high = high ^ _scrambled(low, turn, width)
    return high.astype(np.int64), low.astype(np.int64)


def _order(high: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Order of keys; runs that are in order already are merged."""
    return np.argsort(high << np.uint64(width) | low, kind="stable") if 2 * width <= 64 else np.lexsort((low, high))


def _packed(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    rows = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(rows[:, 64 - bits:]).tobytes()


def _unpacked(data: bytes, n: int, bits: int) -> np.ndarray:
    rows = np.zeros((n, 64), np.uint8)
    if bits:
        rows[:, 64 - bits:] = np.unpackbits(np.frombuffer(data, np.uint8))[:n * bits].reshape(n, bits)
    return np.packbits(rows, axis=1).view(">u8")[:, 0].astype(np.uint64)


class QuotientFilter:
    """Counters of permuted keys (two halves of ``width`` bits each) that share their first ``prefix`` bits.

    The next ``quotient`` bits say in which run a key stands; a bit for each run that is not empty, a bit for each key that ends its
    run, the remaining bits of each key, and a counter of one byte, or of nine from 255 on, are all that is kept.
    """

    HEAD = struct.Struct("<QBBBxI")

    def __init__(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray, width: int, prefix: int = 0):
        self.high, self.low, self.counts, self.width, self.prefix = high, low, counts, width, prefix

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, width: int, prefix: int = 0, counts: np.ndarray | None = None) -> tuple[QuotientFilter, np.ndarray]:
        """The filter that counts keys (times ``counts``), and for every key its place in it."""
        if not len(high):
            return cls(high, low, np.zeros(0, np.int64), width, prefix), np.zeros(0, np.int64)
        order = _order(high, low, width)
        high, low = high[order], low[order]
        first = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        total = np.diff(np.r_[starts, len(order)]) if counts is None else np.add.reduceat(counts[order], starts)
        return cls(high[starts], low[starts], total, width, prefix), place

    @classmethod
    def merged(cls, filters: Sequence[QuotientFilter]) -> tuple[QuotientFilter, list[np.ndarray]]:
        """One filter of all, and for each filter the places of its keys."""
        out, place = cls.of(np.concatenate([f.high for f in filters]), np.concatenate([f.low for f in filters]), filters[0].width, filters[0].prefix,
                            np.concatenate([f.counts for f in filters]))
        return out, np.split(place, np.cumsum([len(f.high) for f in filters])[:-1])

    def cut(self, bits: int) -> Iterator[tuple[int, QuotientFilter]]:
        """Filters of the keys by their first ``bits`` bits; those that hold keys."""
        which = (self.high >> np.uint64(self.width - bits)).astype(np.int64)
        edges = np.r_[0, np.flatnonzero(np.diff(which)) + 1, len(which)] if len(which) else np.zeros(1, np.int64)
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            yield int(which[a]), QuotientFilter(self.high[a:b], self.low[a:b], self.counts[a:b], self.width, bits)

    def to_bytes(self) -> bytes:
        n, free = len(self.high), self.width - self.prefix
        quotient = min(free, max(0, n - 1).bit_length())
        shared = int(self.high[0]) >> free if n else 0
        of = (self.high & np.uint64((1 << free) - 1)) >> np.uint64(free - quotient) if free else np.zeros(n, np.uint64)
        occupied = np.zeros(1 << quotient, bool)
        occupied[of] = True
        ends = np.r_[of[1:] != of[:-1], True] if n else np.zeros(0, bool)
        large = self.counts >= 255
        return b"".join([self.HEAD.pack(n, self.width, self.prefix, quotient, shared), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
                         _packed(self.high & np.uint64((1 << (free - quotient)) - 1), free - quotient), _packed(self.low, self.width),
                         np.minimum(self.counts, 255).astype(np.uint8).tobytes(), self.counts[large].astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        n, width, prefix, quotient, shared = cls.HEAD.unpack_from(data)
        at, rest = cls.HEAD.size, width - prefix - quotient

        def take(size: int) -> bytes:
            nonlocal at
            at += size
            return data[at - size:at]

        occupied = np.flatnonzero(np.unpackbits(np.frombuffer(take(-(-(1 << quotient) // 8)), np.uint8))[:1 << quotient])
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(take(-(-n // 8)), np.uint8))[:n])
        of = np.repeat(occupied[:len(ends)], np.diff(np.r_[-1, ends])).astype(np.uint64)
        high = np.uint64(shared << (width - prefix)) | of << np.uint64(rest) | _unpacked(take(-(-n * rest // 8)), n, rest)
        low = _unpacked(take(-(-n * width // 8)), n, width)
        counts = np.frombuffer(take(n), np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(data[at:], "<i8")
        return cls(high, low, counts, width, prefix)

    def count(self, left: int, right: int) -> int:
        """How often a pair was counted."""
        high, low = permuted(np.array([left]), np.array([right]), self.width)
        a, b = np.searchsorted(self.high, high[0]), np.searchsorted(self.high, high[0], "right")
        found = np.flatnonzero(self.low[a:b] == low[0])
        return int(self.counts[a + found[0]]) if len(found) else 0


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    size = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, size).T.tobytes())


def _whole(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


# Rows between steps: c, counts of words by language; k, keys of a shard in a bucket; s, a shard's sequence; a, the numbers of its keys.
_ROWS = "kind string, shard bigint, at bigint, data binary, words array<binary>, counts array<bigint>"
_FOUND = _ROWS + ", ids array<bigint>, lefts array<bigint>, rights array<bigint>"
_NAMES = ["kind", "shard", "at", "data", "words", "counts", "ids", "lefts", "rights"]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 4]


def _row(size: int, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], k) for n, k in zip(_NAMES[:size], _KINDS)], _NAMES[:size])


def _sequence_rows(shard: int, sequence: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A shard's sequence of its own key numbers from 1 on, 0 for a gap; gaps are one 0 long."""
    if len(sequence):
        sequence = sequence[np.r_[True, (sequence[1:] != 0) | (sequence[:-1] != 0)]]
    for at in range(0, len(sequence), CHUNK // 4):
        yield _row(6, kind="s", shard=shard, at=at, data=_squeezed(sequence[at:at + CHUNK // 4].astype(np.int32)))


class _Shard:
    """Words of a run of texts, numbered in the order of their first use; 0 is a break."""

    def __init__(self):
        self.known: dict[str, defaultdict[bytes, int]] = {}
        self.held: dict[str, list[np.ndarray]] = defaultdict(list)
        self.size = 0

    def add(self, lang: str, data: bytes) -> None:
        numbers = self.known.get(lang)
        if numbers is None:
            numbers = self.known[lang] = defaultdict()
            numbers.default_factory = numbers.__len__
            numbers[_BREAK]
        words = data.replace(_BREAK, b" \xff ").split()
        self.held[lang].append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def rows(self, shard: int, bits: int) -> Iterator[pa.RecordBatch]:
        """Counts by language, the words by bucket, and the sequence in which a word's number is its place among these."""
        keys, counts, sequences, totals = [], [], [], []
        for lang, numbers in self.known.items():
            sequence = np.concatenate(self.held.pop(lang))
            n = np.bincount(sequence, minlength=len(numbers))[1:]
            sequences.append(np.where(sequence > 0, sequence + len(keys), 0))
            mark = lang.encode()
            mark = b"%d:" % len(mark) + mark
            keys += [mark + w for w in list(numbers)[1:]]
            counts.append(n)
            totals.append((mark, int(n.sum())))
        counts = np.concatenate(counts)
        yield _row(6, kind="c", shard=shard, words=[m for m, _ in totals], counts=[n for _, n in totals])
        bucket = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)) >> np.uint64(64 - bits)
        order = np.argsort(bucket, kind="stable")
        place = np.zeros(len(keys) + 1, np.int32)
        place[order + 1] = np.arange(1, len(keys) + 1)
        edges = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(keys)].tolist() if keys else [0]
        for a, b in zip(edges, edges[1:]):
            own = order[a:b]
            yield _row(6, kind="k", shard=shard, at=int(bucket[own[0]]), words=[keys[i] for i in own.tolist()], counts=counts[own].tolist())
        gap = np.zeros(1, np.int32)
        yield from _sequence_rows(shard, np.concatenate([x for s in sequences for x in (place[s], gap)]))


def _slabs(data: bytes) -> Iterator[bytes]:
    """Folded text in runs of bounded length, cut where a piece ends if that is near, else between words."""
    at = 0
    while len(data) - at > 2 * SLAB:
        end = data.find(_BREAK, at + SLAB, at + 2 * SLAB) + 1 or data.find(b" ", at + SLAB) + 1 or len(data)
        yield data[at:end]
        at = end
    if at < len(data):
        yield data[at:]


def _word_rows(docs: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, shard = TaskContext.get().partitionId() << 24, 0, _Shard()
        for batch in batches:
            for some in slices(batch, "text", SLAB):
                by_lang: dict[str, list[str]] = defaultdict(list)
                for lang, text in zip(some.column("lang").to_pylist(), some.column("text").to_pylist()):
                    by_lang[lang].append(text)
                for lang, texts in by_lang.items():
                    for slab in _slabs("\n".join(["", *texts, ""]).encode().translate(_FOLD)):
                        shard.add(lang, slab)
                        if shard.size >= SHARD and slab.endswith(_BREAK):
                            yield from shard.rows(own + number, bits)
                            number, shard = number + 1, _Shard()
        if shard.size:
            yield from shard.rows(own + number, bits)

    return docs.mapInArrow(run, _ROWS)


def _answers(rows: DataFrame, width: int, bits: int, least: int, last: bool) -> DataFrame:
    """Merge the keys of all shards by bucket: rows f with the frequent ones and their numbers, and unless ``last`` rows a for each shard.

    With ``width`` 0 keys are words, else filters. The number of the i-th frequent key of bucket b is ``i * buckets + b + 1``.
    """
    def merge(bucket: int, held: list[tuple[int, object, object]]) -> Iterator[pa.RecordBatch]:
        if width:
            found, places = QuotientFilter.merged([QuotientFilter.from_bytes(zstandard.ZstdDecompressor().decompress(d)) for _, d, _ in held])
            total = found.counts
        else:
            coded = pa.concat_arrays([w.values.slice(w.offsets[0].as_py(), w.offsets[1].as_py() - w.offsets[0].as_py()) for _, w, _ in held]).dictionary_encode()
            place = coded.indices.to_numpy()
            total = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(total, place, np.concatenate([c for _, _, c in held]))
            places = np.split(place, np.cumsum([len(c) for _, _, c in held])[:-1])
        frequent = np.flatnonzero(total >= least)
        ids = np.zeros(len(total), np.int64)
        ids[frequent] = (np.arange(len(frequent)) << bits) + bucket + 1
        if len(frequent):
            if width:
                lefts, rights = restored(found.high[frequent], found.low[frequent], width)
                names = {"lefts": lefts.tolist(), "rights": rights.tolist()}
            else:
                names = {"words": coded.dictionary.take(pa.array(frequent)).to_pylist()}
            yield _row(9, kind="f", at=bucket, ids=ids[frequent].tolist(), counts=total[frequent].tolist(), **names)
        for (shard, _, _), place in zip(held, places):
            if not last:
                yield _row(9, kind="a", shard=shard, at=bucket, data=_squeezed(ids[place]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for i, (shard, at) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("at").to_pylist())):
                if at != bucket and held:
                    yield from merge(bucket, held)
                    held = []
                bucket = at
                held.append((shard, batch.column("data")[i].as_py(), None) if width else
                            (shard, batch.column("words").slice(i, 1), batch.column("counts")[i].values.to_numpy()))
        if held:
            yield from merge(bucket, held)

    own = rows.where("kind = 'k'").select("shard", "at", "data", "words", "counts")
    return stored(own.repartition(parts(rows.sparkSession), "at").sortWithinPartitions("at", "shard").mapInArrow(run, _FOUND))


def _pair_rows(rows: DataFrame, answers: DataFrame, width: int, bits: int, last: bool) -> DataFrame:
    """The next level's keys and sequences of every shard, from its sequence and the numbers of its keys."""
    def pairs(shard: int, numbers: list[np.ndarray], sequence: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        of = np.concatenate([np.zeros(1, np.int64), *numbers])[np.concatenate(sequence)]
        both = np.flatnonzero((of[:-1] > 0) & (of[1:] > 0))
        found, place = QuotientFilter.of(*permuted(of[both], of[both + 1], width), width)
        for bucket, piece in found.cut(bits):
            yield _row(6, kind="k", shard=shard, at=bucket, data=zstandard.ZstdCompressor(level=1).compress(piece.to_bytes()))
        if not last and len(both):
            out = np.zeros(len(of), np.int32)
            out[both] = place + 1
            yield from _sequence_rows(shard, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, numbers, sequence = None, [], []
        for batch in batches:
            for kind, own, data in zip(batch.column("kind").to_pylist(), batch.column("shard").to_pylist(), batch.column("data")):
                if own != shard and sequence:
                    yield from pairs(shard, numbers, sequence)
                if own != shard:
                    shard, numbers, sequence = own, [], []
                if kind == "a":
                    numbers.append(_whole(data.as_py(), np.int64))
                else:
                    sequence.append(_whole(data.as_py(), np.int32))
        if sequence:
            yield from pairs(shard, numbers, sequence)

    both = answers.where("kind = 'a'").select("kind", "shard", "at", "data").union(rows.where("kind = 's'").select("kind", "shard", "at", "data"))
    return stored(both.repartition(parts(rows.sparkSession), "shard").sortWithinPartitions("shard", "kind", "at").mapInArrow(run, _ROWS))


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, lang: str = "lang", text: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """Words by language ``(lang, n)``, and for each length the phrases that occur ``least`` times or more in a language.

    Phrases have ``id``, ``lang``, ``words``, ``a`` (how often), ``heads`` (how often their first word, first two words, ... occur) and ``tails``
    (their last word, last two words, ...); from two words on also ``left`` and ``right``, the ids of their first and last n - 1 words.
    """
    spark = docs.sparkSession
    bits = max(1, (2 * parts(spark) - 1).bit_length())
    rows = stored(_word_rows(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")), bits))

    def cut(words: Column) -> tuple[Column, Column]:
        """Language and word of a key: the language's length in bytes, a colon, the language, the word."""
        mark = F.expr("cast(substring_index(cast(key as string), ':', 1) as int)")
        start = F.length(F.substring_index(words.cast("string"), ":", 1)) + 2
        return words.substr(start, mark).cast("string"), words.substr(start + mark, F.length(words)).cast("string")

    each = F.explode(F.arrays_zip("words", "counts"))
    totals = rows.where("kind = 'c'").select(each.alias("w")).select(F.col("w.words").alias("key"), F.col("w.counts").alias("n"))
    totals = totals.select(cut(F.col("key"))[0].alias("lang"), "n").groupBy("lang").agg(F.sum("n").alias("n"))
    answers, out, width = _answers(rows, 0, bits, least, longest == 1), [], 0
    for n in range(1, longest + 1):
        found = answers.where("kind = 'f'")
        if n == 1:
            words = found.select(F.explode(F.arrays_zip("ids", "words", "counts")).alias("w")).select(
                F.col("w.ids").alias("id"), F.col("w.words").alias("key"), F.col("w.counts").alias("a"))
            name, word = cut(F.col("key"))
            out.append(stored(words.select("id", name.alias("lang"), F.array(word).alias("words"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"))))
        else:
            own = found.select(F.explode(F.arrays_zip("ids", "lefts", "rights", "counts")).alias("w")).select(
                F.col("w.ids").alias("id"), F.col("w.lefts").alias("left"), F.col("w.rights").alias("right"), F.col("w.counts").alias("a"))
            left = out[-1].select(F.col("id").alias("left"), "lang", "words", "heads")
            right = out[-1].select(F.col("id").alias("right"), F.element_at("words", -1).alias("word"), "tails")
            out.append(stored(own.join(left, "left").join(right, "right").select(
                "id", "left", "right", "lang", F.array_append("words", F.col("word")).alias("words"), "a",
                F.array_append("heads", F.col("a")).alias("heads"), F.array_append("tails", F.col("a")).alias("tails"))))
        if n < longest:
            top = out[-1].agg(F.max("id")).first()[0] or 0
            width = max(top.bit_length(), bits + 1)
            rows = _pair_rows(rows, answers, width, bits, n + 1 == longest)
            answers = _answers(rows, width, bits, least, n + 1 == longest)
    return totals, out


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, covered: int = 80, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """The best phrases of two to ``longest`` words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are folded (A-Z only), cut into pieces at ``.,;:!?`` and line ends, and these into words at blanks and tabs. ``a`` is how often the
    phrase occurs within pieces (``least`` at the least), ``n`` all words of the language. For the cut with the lowest score (the first of equal
    ones) ``l`` and ``r`` count its two parts, and ``score`` is ``floor(2000000 a / (l + r))``. Phrases inside a longer frequent phrase that
    occurs at least ``covered`` percent as often are left out. Ranks go by score, ``a`` and phrase.

    Null languages are ``und``, null and empty texts have no words, repeated rows count again, other columns are not read; without
    frequent phrases the result is empty. Texts of any length are split in runs; a shard grows beyond its bound only if
    a single piece does.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words at least and occur once at least")
    totals, levels = frequent_phrases(docs, least, longest, lang, text)
    found = []
    for n, rows in enumerate(levels[1:], 2):
        def part(k: int, rows=rows, n=n) -> Column:
            l, r = F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(n - k - 1))
            both = l.cast("decimal(19,0)") + r.cast("decimal(19,0)")
            score = F.call_function("div", F.lit(2000000).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)"), both)
            return F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

        rows = rows.withColumn("cut", F.array_min(F.array(*[part(k) for k in range(1, n)])))
        if n < longest:
            longer = levels[n].select(F.col("left").alias("of"), "a").union(levels[n].select("right", "a")).groupBy("of").agg(F.max("a").alias("most"))
            rows = rows.join(longer, rows["id"] == longer["of"], "left").where(
                F.col("most").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("most").cast("decimal(19,0)") < F.lit(covered).cast("decimal(3,0)") * F.col("a").cast("decimal(19,0)")))
        found.append(rows.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = every.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

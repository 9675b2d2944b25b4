"""SimHash fingerprints of word shingles, and their near-duplicate groups found by bit-sliced comparison.

Candidates: the 64 bits are cut into blocks, of which two fingerprints within the radius share all but
``radius``. Every choice of so many blocks makes a table keyed by their bits; enough blocks are taken that
a key holds some hundred fingerprints on average, and no pair within the radius is missed.

Comparison: the fingerprints of neighbouring keys form a block, whose bit planes are stored vertically, 64
fingerprints to a word. A query's differing bits are added to the counters of 64 fingerprints at once by
carry-save adders; cells (one query, 64 fingerprints) are abandoned once all their counters exceed the
radius. A key with very many fingerprints is dealt out as pairs of tiles. Each block gives the links of a
spanning forest, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from digitscope.llm.components import components, join_labels
from digitscope.llm.shared import parts, slices, stored

SEED = 42
# Fingerprints to a key on average, in a tile of a hot key, and in a block at least.
PER_KEY, TILE, BLOCK = 2048, 8192, 512
# Cells that are counted together, and shingles that are hashed together.
CELLS, STEP = 1 << 15, 1 << 16


def _shingle_hashes(text: str | None, words: int) -> list[np.ndarray]:
    """XXH64 of the text's word shingles, in arrays of bounded length."""
    found = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not found:
        return []
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[:max(1, len(found) - words + 1)].tolist()
    ends = ends[min(words, len(found)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return [np.array([digest(joined[i:j], SEED) for i, j in zip(starts[at:at + STEP], ends[at:at + STEP])], np.uint64)
            for at in range(0, len(starts), STEP)]


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes for a word of the fingerprint: themselves for the first, else scrambled with its number."""
    if word == 0:
        return hashes
    x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 % 2 ** 64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, words: int = 4, width: int = 1) -> list[int]:
    """SimHash of a text's word shingles as ``width`` unsigned 64-bit words; zero without words."""
    return _majority(_shingle_hashes(text, words), width)


def _majority(parts_: list[np.ndarray], width: int) -> list[int]:
    """The bits that more than half of the hashes have, in each word."""
    counts, total = np.zeros((width, 64), np.int64), 0
    for hashes in parts_:
        total += len(hashes)
        for w in range(width):
            bits = np.unpackbits(_mixed(hashes, w).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[w] += bits.sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > total, axis=1, bitorder="little").view("<u8").ravel().tolist()


def _words(width: int) -> list[str]:
    return [f"w{i}" for i in range(width)]


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, width: int = 1) -> DataFrame:
    """Replace ``text`` by the words ``w0``, ``w1``, ... (bigint) of its fingerprint. Map-only, over whole texts."""
    kept = [c for c in docs.columns if c not in (text, *_words(width))]
    schema = docs.select(*kept, *[F.lit(None).cast("bigint").alias(w) for w in _words(width)]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                got = np.array([fingerprint(t, words, width) for t in part.column(text).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(got[:, w]) for w in range(width))], [*kept, *_words(width)])

    return docs.select(*kept, text).mapInArrow(run, schema)


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ~np.uint64(0))
    for bit in reversed(range(len(counter))):
        if radius >> bit & 1:
            equal &= counter[bit]
        else:
            above |= equal & counter[bit]
            equal &= ~counter[bit]
    return above


def _add(counter: list[np.ndarray], d: list[np.ndarray]) -> None:
    """Add four planes to the bits of the counters with carry-save adders."""
    def full(a, b, c):
        x = a ^ b
        return x ^ c, (a & b) | (x & c)

    counter[0], low = full(counter[0], d[0], d[1])
    counter[0], high = full(counter[0], d[2], d[3])
    counter[1], carry = full(counter[1], low, high)
    for bit in range(2, len(counter)):
        counter[bit], carry = counter[bit] ^ carry, counter[bit] & carry


def near(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint (a row of uint64 words) the index of the first one it is connected with by links."""
    n, width = prints.shape
    labels = np.arange(n)
    if n < 2:
        return labels
    lanes, total = -(-n // 64), width * 64
    bits = np.zeros((lanes * 64, total), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(prints, "<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    unused = ~np.packbits(np.arange(lanes * 64) < n, bitorder="little").view("<u8")
    # Unrelated fingerprints pass the radius soon after twice as many planes; until then nothing is abandoned.
    dense = min(total, max(16, -(-(2 * radius + 8) // 8) * 8))
    deep, step = (radius + 8).bit_length(), max(1, CELLS // lanes)
    for first in range(0, n, step):
        at = first // 64
        masks = np.uint64(0) - np.ascontiguousarray(bits[first:min(n, first + step)].T).astype(np.uint64)
        counter = [np.zeros((masks.shape[1], lanes - at), np.uint64) for _ in range(deep)]
        over = np.repeat(unused[None, at:], masks.shape[1], 0)
        for p in range(0, dense, 4):
            _add(counter, [planes[k, at:][None, :] ^ masks[k][:, None] for k in range(p, p + 4)])
            if p % 8 == 4:
                over |= _exceeds(counter, radius)
        q, w = np.nonzero(~over)
        counter, over = [c[q, w] for c in counter], over[q, w]
        for p in range(dense, total, 4):
            _add(counter, [planes[k, at:][w] ^ masks[k][q] for k in range(p, p + 4)])
            if p % 8 == 4:
                over |= _exceeds(counter, radius)
                live = ~over != 0
                q, w, over, counter = q[live], w[live], over[live], [c[live] for c in counter]
        if len(q):
            cell, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            join_labels(labels, q[cell] + first, (w[cell] + at) * 64 + lane)
    return labels


def _masks(total: int, radius: int) -> list[int]:
    """Bit masks of the tables: all choices of blocks that must agree, for a number of fingerprints."""
    blocks = radius + 1
    while blocks < 2 * radius and total >> (64 * (blocks - radius) // blocks) > PER_KEY:
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(some) for some in combinations(own, blocks - radius)]


def links(prints: DataFrame, radius: int, tables: list[tuple[int, int]] | None = None) -> DataFrame:
    """Links ``(a, b)`` between nodes whose fingerprints share a key and are within ``radius`` bits of each other.

    ``prints`` has ``node`` and the words ``w0``, ``w1``, ... (all bigint, one row per node). ``tables`` holds the word and the bit mask
    of each table of keys; by default, for one word, the choices of blocks that miss no pair. Every pair
    that shares a key is compared; the links form spanning forests, with at most one link to a node and key.
    """
    spark, words = prints.sparkSession, [c for c in prints.columns if c != "node"]
    prints = stored(prints)
    total = prints.count()
    if tables is None:
        tables = [(0, m) for m in _masks(total, radius)]
    keys = [F.struct(F.lit(i).alias("at"), F.col(words[w]).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key"))
            for i, (w, m) in enumerate(tables)]
    keyed = prints.select("node", *words, F.explode(F.array(*keys)).alias("t")).select("node", *words, "t.at", "t.key")
    # At most 10,000 keys can hold a ten-thousandth of the rows: small enough to broadcast at any size.
    limit = max(TILE, total * len(tables) // 10_000)
    hot = stored(keyed.groupBy("at", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit))
    if hot.count():
        tiles = F.ceil(F.col("n") / TILE)
        own = F.pmod(F.xxhash64("node"), tiles)
        zero = F.lit(0).cast("bigint")
        others = F.filter(F.sequence(zero, tiles - 1), lambda j: j != own)
        pairs = F.when(F.col("n").isNull(), F.array(F.struct(zero.alias("i"), zero.alias("j")))).otherwise(
            F.transform(others, lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))))
        keyed = keyed.join(F.broadcast(hot), ["at", "key"], "left").select("at", "key", "node", *words, F.explode(pairs).alias("tile")) \
            .select("node", *words, F.xxhash64("at", "key", "tile.i", "tile.j").alias("unit"))
    else:
        keyed = keyed.select("node", *words, F.xxhash64("at", "key").alias("unit"))

    def compare(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of unit, node and words, by unit; units are compared together up to ``BLOCK`` rows."""
        start = 0
        for stop in np.append(np.flatnonzero(np.diff(rows[:, 0])) + 1, len(rows)).tolist():
            if stop - start >= BLOCK or stop == len(rows):
                nodes = rows[start:stop, 1]
                to = nodes[near(rows[start:stop, 2:].view(np.uint64), radius)]
                some = to != nodes
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(to[some]), pa.array(nodes[some])], ["a", "b"])
                start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2 + len(words)), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)])
            last = int(np.searchsorted(held[:, 0], held[-1, 0])) if len(held) else 0
            if last >= BLOCK:
                yield from compare(held[:last])
                held = held[last:]
        if len(held):
            yield from compare(held)

    return (keyed.select("unit", "node", *words).repartition(parts(spark), "unit").sortWithinPartitions("unit", "node")
            .mapInArrow(run, "a bigint, b bigint"))


def _grouped(prints: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``prints`` (of ``id`` and ``node``) with ``component``, the smallest id of the nodes (``node, first``) that links connect."""
    roots = components(found).withColumnRenamed("node", "of")
    member = stored(nodes.join(roots, nodes["node"] == roots["of"], "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    smallest = stored(member.groupBy("root").agg(F.min("first").alias("component")))
    classes = stored(member.join(smallest, "root").select("node", "component"))
    return prints.join(classes, "node")


def _check(radius: int) -> None:
    if not 0 <= radius <= 8:
        raise ValueError("the radius must be 0 to 8")


def _linked(rows: DataFrame, words: int, radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For rows of ``id`` and ``text``: their fingerprints, the distinct ones, and the links between these."""
    prints = stored(fingerprints(rows, words=words)).withColumnRenamed("w0", "node")
    nodes = stored(prints.groupBy("node").agg(F.min("id").alias("first")))
    return prints, nodes, links(nodes.select("node", F.col("node").alias("w0")), radius)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (bigint), ``component`` (smallest id reachable by links).

    Fingerprints link at ``radius`` (0 to 8) or fewer differing bits. Null and empty texts and texts without words have
    fingerprint zero and are linked like any other. Repeated rows and ids keep their rows; null ids get
    the smallest other id of their group, or null. All pairs of different fingerprints within the radius
    count; equal ones are one node, however many there are.
    """
    _check(radius)
    found = _grouped(*_linked(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), words, radius))
    return found.select(F.col("id").alias(doc_id), F.col("node").alias("fingerprint"), "component")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` with one document left of each group of near-duplicates, that of the smallest id.

    Groups are those of ``groups``: fingerprints within ``radius`` bits, closed over chains; texts without words have
    fingerprint zero and are one group with whatever lies near it. Ids may be null (they come last) or repeated; of
    rows with equal id and text one stays. All columns are kept as they are, whatever their names.
    """
    _check(radius)
    rows = docs.select(F.struct(F.col(doc_id).isNull().alias("null"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("h")).alias("id"), F.col(text).alias("text"))
    found = _grouped(*_linked(rows, words, radius)).where("id = component")
    kept = stored(found.groupBy("id").agg(F.count("*").alias("n")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))

    def chosen(which: DataFrame) -> DataFrame:
        same = (F.xxhash64(f"d.`{text}`") == F.col("id.h")) & F.col(f"d.`{doc_id}`").eqNullSafe(F.col("id.id"))
        return whole.join(which, same, "left_semi")

    once = chosen(kept.where("n = 1")).select("d.*")
    if not kept.where("n > 1").limit(1).count():
        return once
    # Repeated rows: one of each, combined before the shuffle.
    again = chosen(kept.where("n > 1")).groupBy(F.col(f"d.`{doc_id}`").alias("id"), F.xxhash64(f"d.`{text}`").alias("h")).agg(F.min("d").alias("d"))
    return once.unionByName(again.select("d.*"))

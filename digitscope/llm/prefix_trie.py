"""The trie of all conversations' beginnings, built from ternary search trees over ranges of conversations.

Every distinct turn (role and text) has a number, so a conversation is an array of numbers. Conversations are sorted as such arrays and
dealt out by ranges, in shards. A shard puts its distinct arrays into a ternary search tree, the middle one first and then the middle ones
of both halves, which keeps the searches among the children of a node short; the tree is walked without recursion, children
before parents, adding up members, leaves and savings.

A node of the trie lies in one shard, or is a beginning that neighbouring shards share. The shared ones are told by comparing the last
array of each shard with the first of the next. Shards give what they know of these boundary nodes; their sums, and the sums of
their subtrees, are put together at the end. There are at most as many as shards times shared turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from digitscope.llm.shared import parts, stored

EMPTY = hashlib.sha256(b"").hexdigest()


class TernaryTree:
    """Ternary search tree of arrays of numbers; a node's ``middle`` leads on to the next number, ``low`` and ``high`` to its siblings."""

    def __init__(self):
        self.value, self.low, self.middle, self.high, self.depth, self.above = [], [], [], [], [], []
        self.root = -1

    def _node(self, value: int, depth: int, above: int) -> int:
        for held, x in ((self.value, value), (self.low, -1), (self.middle, -1), (self.high, -1), (self.depth, depth), (self.above, above)):
            held.append(x)
        return len(self.value) - 1

    def insert(self, array: list[int]) -> int:
        """Put an array in; returns its last node, -1 for the empty array. ``above`` is the node of the number before."""
        last = -1
        for depth, value in enumerate(array, 1):
            at = self.root if last < 0 else self.middle[last]
            if at < 0:
                at = self._node(value, depth, last)
                if last < 0:
                    self.root = at
                else:
                    self.middle[last] = at
            while self.value[at] != value:
                side = self.low if value < self.value[at] else self.high
                if side[at] < 0:
                    side[at] = self._node(value, depth, last)
                at = side[at]
            last = at
        return last

    def children_first(self) -> Iterator[int]:
        """All nodes, each after the nodes below it."""
        order, open_ = [], [self.root] if self.root >= 0 else []
        while open_:
            at = open_.pop()
            order.append(at)
            open_ += [x for x in (self.low[at], self.middle[at], self.high[at]) if x >= 0]
        # A sibling that hangs on ``low`` or ``high`` comes after its tree parent, but nothing below a node comes before it.
        return reversed(order)


def median_order(n: int) -> Iterator[int]:
    """0 to n - 1: the middle one, then the middle ones of both halves, and so on."""
    open_ = [(0, n)]
    while open_:
        start, stop = open_.pop()
        if start < stop:
            middle = (start + stop) // 2
            yield middle
            open_ += [(middle + 1, stop), (start, middle)]


def _shared(a: Column, b: Column) -> Column:
    """How many first elements two arrays have in common."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(a.isNull() | b.isNull(), 0).when(first == 0, F.size(a)).otherwise(first - 1).cast("bigint")


def _numbered(turns: DataFrame) -> DataFrame:
    """``digest, id`` of all distinct turns; ids are dense and follow the digests."""
    distinct = stored(turns.groupBy("digest").agg(F.lit(1).alias("one")).select("digest"))
    # Two levels of counting by the digest's first bits: no window holds more than a bin or all bins.
    bins = F.conv(F.substring(F.hex("digest"), 1, 3), 16, 10).cast("int")
    counted = distinct.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))
    before = counted.select("bin", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = distinct.withColumn("bin", bins).withColumn("at", F.row_number().over(Window.partitionBy("bin").orderBy("digest")))
    return own.join(F.broadcast(before), "bin").select("digest", (F.col("before") + F.col("at")).alias("id"))  # 4,096 bins at most


def sequences(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns array<bigint>, sizes array<bigint>``: each conversation's turns in order, as numbers, and the UTF-8 bytes of their texts.

    Turns stand by ``turn`` (null first), then role and text. Null roles and texts are empty; rows without ``conv_id`` belong to no
    conversation. A turn is known by the SHA-256 of role and text. Texts are shuffled once; a conversation's numbers meet in one row.
    """
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    at = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text"))
    turns = stored(rows.select("conv", at.alias("at"), digest.alias("digest"), F.octet_length("text").cast("bigint").alias("size")))
    found = turns.join(_numbered(turns), "digest").select("conv", F.struct("at", "id", "size").alias("t"))
    return stored(found.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv", F.col("t.id").alias("turns"), F.col("t.size").alias("sizes")))


def grafted(found: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation ``c - c % family``; h is the CRC-32 of the decimal c modulo ``most``.

    All turns of that conversation if it has fewer, none if it does not exist, then c's own turns from the (h + 1)th on.
    """
    heads = found.where(F.col("conv") % family == 0).select(F.col("conv").alias("from"), *[F.slice(c, 1, most - 1).alias(f"first_{c}") for c in ("turns", "sizes")])
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    own = found.select("conv", "turns", "sizes", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("from")).join(heads, "from", "left")

    def joined(c: str) -> Column:
        rest = F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
        return F.concat(F.slice(F.coalesce(f"first_{c}", F.array().cast("array<bigint>")), F.lit(1), F.col("h")), rest).alias(c)

    return own.select("conv", joined("turns"), joined("sizes"))


_NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, "
         "kind string, key binary, above binary, size bigint")
_FIELDS = [f.split() for f in _NODE.split(", ")]
_TYPES = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_BATCH = 20_000


def _keys(array: list[int], depth: int) -> list[bytes]:
    """Names of an array's beginnings of up to ``depth`` elements."""
    state, out = hashlib.sha256(), []
    for value in array[:depth]:
        out.append(state.digest())
        state.update(value.to_bytes(8, "little"))
    return [*out, state.digest()]


def _shard_nodes(arrays: list[list[int]], sizes: list[list[int]], members: list[tuple[int, int, str | None]], left: int, right: int) -> Iterator[tuple]:
    """Rows n, the nodes of a shard with all their figures, and b, what the shard adds to boundary nodes.

    ``arrays`` are distinct and sorted; ``members`` gives how many conversations each is, the smallest of them and the digest of all. The first array's
    beginnings of up to ``left`` turns and the last one's of up to ``right`` are boundary nodes, the empty one always is.
    """
    tree = TernaryTree()
    last = [-1] * len(arrays)
    for i in median_order(len(arrays)):
        last[i] = tree.insert(arrays[i])
    n = len(tree.value)
    count, least, size = [0] * (n + 1), [None] * (n + 1), [0] * (n + 1)  # the last place is the root's
    children, leaves, saved, ends = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [EMPTY] * (n + 1)
    for i, at in enumerate(last):
        count[at], least[at], ends[at] = members[i]
    # A node's text size is that of its turn, which any array through it tells.
    for i, at in enumerate(last):
        for d in range(len(arrays[i]), 0, -1):
            if size[at] or at < 0:
                break
            size[at] = sizes[i][d - 1] + 1  # one more, so that 0 says not known yet
            at = tree.above[at]
    boundary: dict[int, tuple[bytes, bytes | None]] = {}
    for array, depth in ((arrays[0], left), (arrays[-1], right)):
        at, keys = -1, _keys(array, depth)
        boundary[-1] = (keys[0], None)
        for d in range(depth):
            at = _child(tree, at, array[d])
            boundary[at] = (keys[d + 1], keys[d])
    order = list(tree.children_first())
    # Members come together below a node before its own row is made.
    for at in order:
        above = tree.above[at]
        children[at], leaves[at], saved[at] = children[at], leaves[at] or 1 - bool(children[at]), saved[at] + (count[at] - 1) * (size[at] - 1)
        count[above] += count[at]
        if least[above] is None or least[at] < least[above]:
            least[above] = least[at]
        children[above] += 1
        if at not in boundary:
            leaves[above] += leaves[at]
            saved[above] += saved[at]
    for at in [-1, *order]:
        depth, above = (0, -1) if at < 0 else (tree.depth[at], tree.above[at])
        if at not in boundary:
            over = boundary.get(above)
            yield (least[at], depth, None if over else least[above], count[at], children[at], leaves[at], saved[at], ends[at], "n", None, over[0] if over else None, None)
    for at, (key, over) in boundary.items():
        depth = 0 if at < 0 else tree.depth[at]
        known = [x for x in _below(tree, at) if x not in boundary]
        yield (least[at], depth, None, count[at], len(known), sum(leaves[x] for x in known), sum(saved[x] for x in known), None, "b", key, over, max(size[at] - 1, 0) if at >= 0 else 0)


def _below(tree: TernaryTree, at: int) -> Iterator[int]:
    """The children of a node (-1: of the root)."""
    open_ = [tree.root if at < 0 else tree.middle[at]]
    while open_:
        x = open_.pop()
        if x >= 0:
            yield x
            open_ += [tree.low[x], tree.high[x]]


def _child(tree: TernaryTree, at: int, value: int) -> int:
    x = tree.root if at < 0 else tree.middle[at]
    while tree.value[x] != value:
        x = tree.low[x] if value < tree.value[x] else tree.high[x]
    return x


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[t]) for i, (_, t) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of the shards of a partition; rows come by shard, array and conversation. Also rows e: members that end at boundary nodes."""
    shard, limits, arrays, sizes, members, digest = None, (0, 0), [], [], [], None

    def close() -> None:
        members[-1] = (*members[-1][:2], digest.hexdigest())

    for batch in batches:
        for own, left, right, conv, array, size in zip(*(batch.column(c).to_pylist() for c in ("shard", "left", "right", "conv", "turns", "sizes")), strict=True):
            if own != shard:
                if arrays:
                    close()
                    yield from _batches(_shard_nodes(arrays, sizes, members, *limits))
                shard, limits, arrays, sizes, members = own, (left, right), [], [], []
            if arrays and arrays[-1] == array:
                members[-1] = (members[-1][0] + 1, members[-1][1], None)
                digest.update(b",%d" % conv)
            else:
                if arrays:
                    close()
                arrays.append(array)
                sizes.append(size)
                members.append((1, conv, None))
                digest = hashlib.sha256(b"%d" % conv)
    if arrays:
        close()
        yield from _batches(_shard_nodes(arrays, sizes, members, *limits))


def _digests(ends: DataFrame, spark) -> DataFrame:
    """``key, ends_sha256`` of the members ``conv`` that end at each boundary node; a digest is taken in order, without holding them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            keys, convs, out = batch.column("key").to_pylist(), batch.column("conv").to_numpy(), []
            start = 0
            for stop in [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]:
                if start == stop:
                    continue
                listed = ",".join(map(str, convs[start:stop].tolist())).encode()
                if keys[start] == key:
                    digest.update(b"," + listed)
                else:
                    if key is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = keys[start], hashlib.sha256(listed)
                start = stop
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out])], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    return ends.repartition(parts(spark), "key").sortWithinPartitions("key", "conv").mapInArrow(run, "key binary, ends_sha256 string")


def _boundary(rows: pd.DataFrame) -> pd.DataFrame:
    """Figures of the boundary nodes' whole subtrees, from what each has outside other boundary nodes; deepest first."""
    rows = rows.sort_values("depth", ascending=False, kind="stable").reset_index(drop=True)
    place = {k: i for i, k in enumerate(rows["key"])}
    above = np.array([place.get(k, -1) for k in rows["above"]])
    children, leaves, saved = (rows[c].to_numpy(np.int64, copy=True) for c in ("n_children", "n_leaves", "saved_tokens"))
    saved += (rows["n_convs"].to_numpy(np.int64) - 1) * rows["size"].to_numpy(np.int64)
    np.add.at(children, above[above >= 0], 1)
    leaves[children == 0] = 1
    depth = rows["depth"].to_numpy()
    edges = np.r_[0, np.flatnonzero(np.diff(depth)) + 1, len(depth)].tolist()
    for a, b in zip(edges, edges[1:]):
        some = slice(a, b) if above[a] >= 0 else slice(0, 0)
        np.add.at(leaves, above[some], leaves[some])
        np.add.at(saved, above[some], saved[some])
    conv = rows["conv_id"].to_numpy(np.int64)
    parent = pd.array([int(conv[i]) if i >= 0 else None for i in above], dtype="Int64")
    return pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": parent, "n_convs": rows["n_convs"], "n_children": children, "n_leaves": leaves,
                         "saved_tokens": saved, "key": rows["key"]})


def trie(found: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the conversations ``conv, turns, sizes`` (as ``sequences`` gives them), the empty one included.

    ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs`` (members), ``n_children``, ``n_leaves`` (nodes of its subtree, itself
    included, without children), ``saved_tokens`` (sum over its subtree of members but one, times the bytes of the last text) and ``ends_sha256`` (of the
    conversations that end there, ascending, joined by commas). Conversations without turns end at the root; an empty table has no nodes.

    Copies of one conversation are dealt out by ``conv``. The digest of all members that end at one boundary node is a sequential
    thing: one task reads their ids in order, without holding them.
    """
    spark = found.sparkSession
    dealt = found.repartitionByRange(parts(spark), "turns", "conv").withColumn("shard", F.spark_partition_id())
    dealt = stored(dealt)
    # A row for each shard: its first and last array, compared with its neighbours'.
    edges = dealt.groupBy("shard").agg(F.min("turns").alias("first"), F.max("turns").alias("last"))
    order = Window.orderBy("shard")
    limits = stored(edges.select("shard", _shared(F.col("first"), F.lag("last").over(order)).alias("left"), _shared(F.col("last"), F.lead("first").over(order)).alias("right"),
                                 F.col("first").alias("low"), F.col("last").alias("top")))
    bounded = dealt.join(F.broadcast(limits.select("shard", "left", "right")), "shard")  # a row for each shuffle partition
    nodes = stored(bounded.repartition(parts(spark), "shard").sortWithinPartitions("shard", "turns", "conv")
                   .select("shard", "left", "right", "conv", "turns", "sizes").mapInArrow(_shards, _NODE))

    shared = nodes.where("kind = 'b'").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("above").alias("above"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("size").alias("size"))
    whole = stored(shared.groupBy(F.lit(1).alias("all")).applyInPandas(
        lambda rows: _boundary(rows), "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, key binary"))

    # Members that end at a boundary node: arrays as long as what their shard shares with a neighbour, or shorter.
    length = F.size("turns")
    start = dealt.join(F.broadcast(limits), "shard").where(
        (length == 0) | ((length <= F.col("left")) & (F.col("turns") == F.slice("low", 1, F.greatest(length, F.lit(1))))) |
        ((length <= F.col("right")) & (F.col("turns") == F.slice("top", 1, F.greatest(length, F.lit(1))))))
    ends = _digests(start.select(_key(F.col("turns")).alias("key"), "conv"), spark)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tops = whole.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).select(*columns)
    inner = nodes.where("kind = 'n'").join(whole.select(F.col("key").alias("above"), F.col("conv_id").alias("over")), "above", "left")
    return inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over")).select(*columns).unionByName(tops)


def _key(array: Column) -> Column:
    """The name ``_keys`` gives a whole array: SHA-256 of its numbers, eight bytes each, the lowest first."""
    def little(x: Column) -> Column:
        digits = F.lpad(F.hex(x), 16, "0")
        return F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)])

    return F.unhex(F.sha2(F.unhex(F.array_join(F.transform(array, little), "")), 256))

"""Shards of near-equal bytes for indivisible groups, by Karmarkar-Karp differencing.

A partial partition is a list of shard sums. Differencing repeatedly takes the two partial partitions of
the largest spread and adds them oppositely ordered, largest sum to smallest, until one is left.

At scale the groups of equal texts are dealt by hash into buckets of about ``BUCKET``; in each bucket
differencing makes ``BUNDLES`` bundles of near-equal bytes, which are the indivisible groups of the next
level. Levels go on until at most ``TOP`` bundles are left; with the few groups above a ten-thousandth of
all bytes, which are never bundled, they are differenced into the shards in one small task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from digitscope.llm.shared import stored

# Items of a bucket, bundles made of it, and bundles that are differenced in one task in the end.
BUCKET, BUNDLES, TOP = 2048, 32, 8192
# Groups above this share of all bytes stand alone; there are at most as many as its inverse.
ALONE = 10_000
# Groups above this share of all rows are joined by broadcast; there are at most as many as its inverse.
HEAVY = 1_000
# Bytes that a row takes besides its text.
OVERHEAD = 16


def difference(sizes, shards: int) -> np.ndarray:
    """The shard of each size by Karmarkar-Karp differencing into ``shards`` sums. Ties go by position."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    sums: list[np.ndarray | None] = []
    for size in sizes:
        row = np.zeros(shards, np.int64)
        row[0] = size
        sums.append(row)
    heap = [(-int(s) if shards > 1 else 0, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        place = np.empty(shards, np.int64)
        place[order] = np.arange(shards)
        sums[a] = sums[b] = None
        heapq.heappush(heap, (int(total[order[-1]] - total[order[0]]), len(sums)))
        sums.append(total[order])
        merges.append((a, b, place))
    where: list[np.ndarray | None] = [None] * len(sums)
    where[-1] = np.arange(shards)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, place = merges[node - n]
        where[a], where[b] = where[node][place], where[node][place[::-1]]
        where[node] = None
    return np.array([w[0] for w in where[:n]], np.int64)


def _bundled(items: DataFrame, buckets: int) -> DataFrame:
    """``(item, parent)``: bundles of near-equal bytes within buckets that a hash of the item gives."""
    def bundle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "item"], ascending=[False, True])
        to = difference(group["bytes"].to_numpy(), BUNDLES)
        return pd.DataFrame({"item": group["item"], "bytes": group["bytes"], "parent": group["bucket"] * BUNDLES + to})

    return items.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets))).groupBy("bucket").applyInPandas(
        bundle, "item string, bytes bigint, parent bigint")


def _placed_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``(item, shard)`` for all groups ``(item, bytes)``."""
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    alone = groups.where(F.col("bytes") * ALONE > total).select("item", "bytes")
    items = groups.where(F.col("bytes") * ALONE <= total).select("item", "bytes")
    levels, count = [], items.count()
    while count > TOP:
        levels.append(stored(_bundled(items, -(-count // BUCKET))))
        items = stored(levels[-1].groupBy("parent").agg(F.sum("bytes").alias("bytes"))
                       .select(F.concat(F.lit(f"level {len(levels)} "), F.col("parent")).alias("item"), "bytes"))
        count = items.count()

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "item"], ascending=[False, True])
        return pd.DataFrame({"item": group["item"], "shard": difference(group["bytes"].to_numpy(), shards).astype("int32")})

    placed = stored(items.union(alone).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(place, "item string, shard int"))
    small = items.join(F.broadcast(placed), "item").select("item", "shard")
    for depth in range(len(levels), 0, -1):
        parents = small.withColumnRenamed("item", "up")
        if depth == len(levels):
            parents = F.broadcast(parents)  # at most TOP rows
        small = levels[depth - 1].withColumn("up", F.concat(F.lit(f"level {depth} "), F.col("parent"))) \
            .join(parents, "up").select("item", "shard")
    return small.union(alone.join(F.broadcast(placed), "item").select("item", "shard"))


def shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", chunk: int = 20_000) -> DataFrame:
    """Deal all rows into ``shards`` of near-equal bytes: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the UTF-8 bytes of the text plus 16; a null text has no bytes and CRC zero. Rows of equal
    texts stay together (nulls are a group, the empty text another), so a shard is as large as its largest
    group at least. ``slot`` numbers the rows of a shard from 0 without gaps. Null and repeated ids are rows
    like any other; an empty table gives no rows. Rows of a group above a thousandth of all rows find their
    shard by broadcast of those few groups, the others by a shuffle.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text_ = F.col(text)
    rows = stored(docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text_), F.lit(0)).cast("bigint") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text_, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.sha2(text_, 256), F.lit("null")).alias("item")))
    groups = stored(rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    where = stored(_placed_groups(groups, shards).join(groups.select("item", "n"), "item"))
    heavy = F.broadcast(where.where(F.col("n") * HEAVY > total).select("item", "shard"))
    light = where.where(F.col("n") * HEAVY <= total).select("item", "shard")
    placed = stored(rows.join(heavy, "item").unionByName(rows.join(heavy, "item", "left_anti").join(light, "item")))

    # Number the rows: chunks of a shard are counted, their first slots summed up, then each is numbered by itself.
    counts = {r[0]: r[1] for r in placed.groupBy("shard").count().collect()}
    chunks = F.array(*[F.lit(32 + counts.get(s, 0) // chunk) for s in range(shards)])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "item"), F.get(chunks, F.col("shard"))).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "item")
    return placed.join(first, ["shard", "part"]).select(
        F.col("doc_id").alias(doc_id), "size", "text_crc32", "shard", (F.col("first") + F.row_number().over(own) - 1).alias("slot"))

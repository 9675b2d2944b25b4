import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from digitscope.llm import queries, sharding


def slow_spread(sizes, k):
    """The spread that differencing ends with, on plain lists."""
    parts = [sorted([s] + [0] * (k - 1), reverse=True) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts[0], parts[1]
        parts = parts[2:] + [sorted((x + y for x, y in zip(a, b[::-1])), reverse=True)]
    return parts[0][0] - parts[0][-1]


def test_differencing():
    pick = random.Random(1)
    assert sharding.difference([], 4).tolist() == []
    for n in (1, 2, 5, 40, 300):
        for k in (1, 2, 3, 7):
            sizes = [pick.randint(1, 10 ** 6) for _ in range(n)]
            to = sharding.difference(sizes, k)
            sums = np.bincount(to, weights=sizes, minlength=k)
            assert sums.max() - sums.min() == slow_spread(sizes, k)
    assert slow_spread([4, 5, 6, 7, 8], 2) == 2  # the known example of two-way differencing
    sums = np.bincount(sharding.difference([4, 5, 6, 7, 8], 2), weights=[4, 5, 6, 7, 8])
    assert sorted(sums) == [14, 16]


def check(rows, out, shards, tight):
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
    slots, to, bytes_ = defaultdict(list), {}, [0] * shards
    for r in out:
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
        assert 0 <= r.shard < shards
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    if tight is not None:
        assert max(bytes_) - min(bytes_) <= tight
    return to


@pytest.mark.parametrize("limits", [(2048, 8192), (8, 16)])
def test_levels(spark, monkeypatch, limits):
    monkeypatch.setattr(sharding, "BUCKET", limits[0])
    monkeypatch.setattr(sharding, "TOP", limits[1])
    monkeypatch.setattr(sharding, "BUNDLES", 3)
    pick = random.Random(2)
    rows = [(i, "x" * pick.randint(0, 60) + str(i // 2)) for i in range(600)] + [(1000 + i, "hot") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(docs, 5).collect()
    check(rows, out, 5, None)
    text = dict(rows)
    at = defaultdict(set)
    for r in out:
        assert r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        at[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in at.values())
    loads = [0] * 5
    for r in out:
        loads[r.shard] += r.size
    hot = at["hot"].pop()
    rest = [b for s, b in enumerate(loads) if s != hot or b == min(loads)]
    assert max(rest) - min(rest) <= (200 if limits[1] == 16 else 10) or max(loads) - min(loads) <= 200


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (None, "é"), (7, "é"), (7, "é"), (8, "y" * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "'a' as item", "2 as size")
    out = sharding.shard(docs, 3).collect()
    check(rows, out, 3, None)
    assert {r.text_crc32 for r in out if r.doc_id in (1, 2, 3)} == {0}
    assert {r.size for r in out if r.doc_id in (1, 2, 3)} == {16}
    assert {r.size for r in out if r.doc_id == 7} == {18}
    assert sharding.shard(docs.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(docs, 0)


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    out = queries.op1_karmarkar_karp(spark, data).collect()
    check([(d.doc_id, d.text) for d in docs], out, 40, None)
    text, at = {d.doc_id: d.text for d in docs}, defaultdict(set)
    sizes, loads = defaultdict(int), [0] * 40
    for r in out:
        at[text[r.doc_id]].add(r.shard)
        sizes[text[r.doc_id]] += r.size
        loads[r.shard] += r.size
    assert all(len(s) == 1 for s in at.values())
    assert max(loads) - min(loads) == slow_spread(sizes.values(), 40)

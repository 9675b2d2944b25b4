import hashlib
import random

import pytest
from pyspark.sql import functions as F

from digitscope.llm import mixing, queries
from suite.compare import connect, differences

WEIGHTS = {("a",): 3, ("b",): 1, ("*",): 1, ("a", "x"): 2, ("a", "y"): 1, ("b", "x"): 1, ("b", "*"): 1, ("*", "*"): 5}


def test_share():
    assert mixing.share(100, [(1, 1000), (3, 1000)]) == [25, 75]
    assert mixing.share(100, [(1, 10), (3, 1000), (1, 1000)]) == [10, 67, 22]
    assert mixing.share(100, [(1, 10), (1, 20)]) == [10, 20]
    assert mixing.share(100, [(0, 10), (1, 200)]) == [0, 100]
    assert mixing.share(0, [(1, 10)]) == [0] and mixing.share(5, []) == []


def test_shortages_go_to_siblings_first():
    weights = {("a",): 1, ("b",): 1, ("a", "x"): 1, ("a", "y"): 1, ("b", "z"): 1}
    capacity = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    assert mixing.budgets(weights, capacity, 200) == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 100}
    capacity["a", "y"] = 50  # the family cannot use its part any more
    assert mixing.budgets(weights, capacity, 200) == {("a", "x"): 10, ("a", "y"): 50, ("b", "z"): 140}


def slow_mix(rows, weights, budget, epochs, seed):
    """Rows of (id, k1, k2, tokens) to sorted (id, leaf, epoch)."""
    order, leaves = {p: i for i, p in enumerate(sorted(weights))}, {}
    for row in rows:
        path = ()
        for value in row[1:3]:
            path += (value if (*path, value) in weights and value != "*" else "*",)
            if path not in weights:
                break
        else:
            leaves.setdefault(path, []).append(row)
    supply = {p: sum(r[3] or 0 for r in docs) for p, docs in leaves.items()}
    parts = mixing.budgets(weights, {p: n * epochs for p, n in supply.items()}, budget)
    out = []
    for path, docs in leaves.items():
        left = parts.get(path, 0)
        for epoch in range(epochs):
            def at(r, epoch=epoch):
                return hashlib.md5(f"{seed}:{epoch}:{r[0]}".encode()).hexdigest()[:15]
            if left >= supply[path] > 0:
                out += [(r[0], order[path], epoch) for r in docs]
                left -= supply[path]
                continue
            for r in docs:
                if left > 0 and sum(o[3] or 0 for o in docs if at(o) < at(r)) < left:
                    out.append((r[0], order[path], epoch))
            break
    return sorted(out)


def test_against_plain_python(spark):
    pick = random.Random(1)
    rows = [(i // 2 if i > 200 else i, pick.choice(["a", "a", "a", "b", "c", None, "*"]), pick.choice(["x", "y", "z", None]), pick.choice([None, 0, 1, 5, 40]))
            for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, k1 string, k2 string, t long").selectExpr("*", "'t' as text", "1 as leaf", "2 as epoch", "3 as name")
    for budget in (0, 1, 150, 700, 2500, 10 ** 9):
        for epochs in (1, 3):
            got = mixing.mix(docs, WEIGHTS, ("k1", "k2"), F.col("t"), budget, epochs, 4)
            assert sorted((r.doc_id, r.leaf, r.epoch) for r in got.collect()) == slow_mix(rows, WEIGHTS, budget, epochs, 4)
    assert mixing.mix(docs.limit(0), WEIGHTS, ("k1", "k2"), F.col("t"), 0.5).count() == 0


def test_null_ids_are_told_apart(spark):
    docs = spark.createDataFrame([(None, "a", "x", f"text {i}") for i in range(40)], "doc_id long, k1 string, k2 string, text string")
    assert mixing.mix(docs, WEIGHTS, ("k1", "k2"), F.lit(10), 200).count() == 20


def test_bad_trees(spark):
    docs = spark.createDataFrame([], "doc_id long, k1 string, k2 string, text string")
    for weights in ({("a",): -1}, {("a",): 1}, {("a", "x"): 1}, {("a",): 1.5, ("a", "x"): 1}, {("a",): 1, ("a", "x"): 1, ("a", "x", "z"): 1}):
        with pytest.raises(ValueError):
            mixing.mix(docs, weights, ("k1", "k2"), F.lit(1), 5)


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    frame = queries.op2_hierarchical_mix(spark, folder)
    assert differences(frame, connect(folder), queries.ORACLE["op2_hierarchical_mix"]) == []
    assert {r.epoch for r in frame.select("epoch").distinct().collect()} > {0}

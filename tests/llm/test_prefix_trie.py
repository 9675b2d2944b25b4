import hashlib
import random
import zlib

import pytest

from digitscope.llm import prefix_trie, queries


def ordered(rows):
    """Turns of each conversation, (role, text) in order."""
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(some)] for c, some in by.items()}


def rebuilt(by):
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = by.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute_force(by):
    """Every distinct beginning with its figures."""
    nodes, sha = {}, lambda some: hashlib.sha256(",".join(map(str, sorted(some))).encode()).hexdigest()
    for c, turns in by.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, convs in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        out.append((min(convs), len(path), min(nodes[path[:-1]]) if path else None, len(convs), len(children), len(leaves), saved,
                    sha([c for c in convs if len(by[c]) == len(path)])))
    return sorted(out, key=str)


def result(out):
    assert out.dtypes == [*[(c, "bigint") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", "string")]
    return sorted((tuple(r) for r in out.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def some_rows(seed, convs, words, turns):
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(pick.randint(0, turns)):
            rows.append((c * pick.choice([1, 1, 3]), t, pick.choice(["user", "assistant", None]), pick.choice(words)))
    return rows


def test_tree_keeps_children_before_parents():
    pick = random.Random(1)
    arrays = sorted({tuple(pick.randint(0, 5) for _ in range(pick.randint(0, 6))) for _ in range(300)})
    tree = prefix_trie.TernaryTree()
    order = list(prefix_trie.median_order(len(arrays)))
    assert sorted(order) == list(range(len(arrays))) and order[0] == len(arrays) // 2
    for i in order:
        tree.insert(list(arrays[i]))
    assert len(tree.value) == len({a[:d] for a in arrays for d in range(1, len(a) + 1)})
    done = set()
    for at in tree.children_first():
        assert all(x in done for x in prefix_trie._below(tree, at))
        done.add(at)
    assert len(done) == len(tree.value)


@pytest.mark.parametrize("partitions", ["1", "4", "30"])
def test_against_brute_force(spark, partitions):
    """From one shard to more shards than conversations; copies that fill several shards."""
    rows = some_rows(2, 40, ["a", "b", "é日", "", None], 5) + [(c, t, "user", f"copy {t}") for c in range(1000, 1060) for t in range(4)]
    rows += [(c, 0, "user", "copy 0") for c in range(2000, 2030)] + [(3000, t, "user", f"copy {t % 2}") for t in range(40)]
    rows += [(None, 0, "user", "lost"), (7, None, "user", "first"), (7, None, "system", "first"), (5001, 1, "user", "x"), (5001, 1, "user", "x")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as at", "2 as digest", "3 as key", "4 as shard", "5 as conv")
        found = prefix_trie.sequences(table)
        by = ordered(rows)
        assert result(prefix_trie.trie(found)) == brute_force(by)
        assert result(prefix_trie.trie(prefix_trie.grafted(found))) == brute_force(rebuilt(by))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_turnless_and_empty(spark):
    rows = [(c, 0, "user", "only") for c in range(1, 12) if c % 5]  # their bases do not exist
    found = prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA))
    got = result(prefix_trie.trie(prefix_trie.grafted(found)))
    assert got == brute_force(rebuilt(ordered(rows))) and got[0][3] == 9
    for none in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)):
        assert prefix_trie.trie(prefix_trie.grafted(prefix_trie.sequences(none))).count() == 0


def test_long_conversation_and_long_texts(spark):
    rows = [(c, t, "user", f"turn {t}" + "x" * (200_000 if t == 3 else 0)) for c in (5, 6) for t in range(600)] + [(7, 0, "user", "turn 0")]
    got = prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA))).orderBy("depth").collect()
    sizes = [len(t) for c, _, _, t in rows if c == 5]
    assert [r.depth for r in got] == list(range(601)) and [r.n_leaves for r in got] == [1] * 601
    assert [r.n_convs for r in got][:3] == [3, 3, 2] and got[0].saved_tokens == sum(sizes) + sizes[0] and got[600].saved_tokens == sizes[-1]


def test_query(spark, data):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    got = result(queries.op13_prefix_trie(spark, data))
    assert got == brute_force(rebuilt(ordered(rows))) and max(r[3] for r in got if r[1]) > 1


def test_query_against_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet')")
    out = queries.op13_prefix_trie(spark, folder)
    want = base.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.ORACLE['op13_prefix_trie']})").fetchall()
    assert result(out) == sorted(want, key=str) and want

import random

import numpy as np
import xxhash

from digitscope.llm import queries, simhash
from digitscope.llm.components import components


def slow_fingerprint(text, words=4):
    found, word = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c in " \t\n\x0b\x0c\r":
            found, word = found + [word] * bool(word), ""
        else:
            word += c
    found += [word] * bool(word)
    if not found:
        return 0
    grams = [" ".join(found[i:i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def around(pick, centres, n):
    out = set()
    while len(out) < n:
        p = pick.choice(centres)
        for _ in range(pick.randint(0, 7)):
            p ^= 1 << pick.randrange(64)
        out.add(p)
    return sorted(out)


def test_fingerprints():
    texts = [None, "", " \n", "one", "One two THREE", "a b c d", "a b c d e", "É é A", "x\x1cy z \x85 w", "same " * 50]
    assert [simhash.fingerprint(t)[0] for t in texts] == [slow_fingerprint(t) for t in texts]


def test_bit_sliced_comparison():
    pick = random.Random(3)
    for radius in range(7):
        for n in (1, 2, 63, 64, 65, 400):
            prints = around(pick, [pick.getrandbits(64) for _ in range(12)], n)
            got = simhash.near(np.array(prints, np.uint64)[:, None], radius).tolist()
            assert got == slow_roots(prints, radius)


def test_bit_sliced_comparison_of_wide_prints():
    pick = random.Random(8)
    for radius in (0, 12, 45):
        prints = []
        for centre in [pick.getrandbits(256) for _ in range(9)]:
            for _ in range(30):
                flips = pick.sample(range(256), pick.randint(0, 60))
                prints.append(centre ^ sum(1 << f for f in flips))
        rows = np.array([[p >> (64 * w) & (2 ** 64 - 1) for w in range(4)] for p in prints], np.uint64)
        assert simhash.near(rows, radius).tolist() == slow_roots(prints, radius)


def test_masks_share_enough_blocks():
    pick = random.Random(4)
    for total in (0, 10 ** 6, 10 ** 9, 10 ** 12):
        masks = simhash._masks(total, 4)
        for _ in range(200):
            bits = sum(1 << b for b in pick.sample(range(64), 4))
            assert any(bits & m == 0 for m in masks)


def test_links_with_hot_keys(spark, monkeypatch):
    pick = random.Random(5)
    prints = around(pick, [0, 1 << 63, pick.getrandbits(64)], 300)
    want = slow_roots(prints, 4)
    for tile in (8192, 16):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "BLOCK", 7)
        signed = np.array(prints, np.uint64).view(np.int64).tolist()
        roots = components(simhash.links(spark.createDataFrame([(p, p) for p in signed], "node long, w0 long"), 4)).collect()
        to = {r.node: r.root for r in roots}
        groups = {}
        for p, r in zip(signed, want):
            groups.setdefault(to.get(p, p), set()).add(r)
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(None, 3), (7, 7), (500, 501), (500, 501)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_on_odd_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(30000))
    rows = [(5, None), (6, ""), (None, "a b c d e"), (9, "a b c d e"), (9, "a b c d e"), (3, long), (4, long + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fingerprint", "1 as component")
    got = sorted(((r.doc_id, r.component) for r in simhash.groups(docs).collect()), key=str)
    assert got == sorted([(5, 5), (6, 5), (None, 9), (9, 9), (9, 9), (3, 3), (4, 3)], key=str)
    assert simhash.groups(docs.limit(0)).count() == 0


def slow_representatives(rows):
    """One row of each group of fingerprints within four bits: the smallest id, nulls last, one of equal rows."""
    prints = [slow_fingerprint(t) for _, t in rows]
    roots, best = slow_roots(prints, 4), {}
    for i, r in enumerate(roots):
        key = (rows[i][0] is None, rows[i][0] or 0)
        best[r] = min(best.get(r, key), key)
    return {r: k for r, k in best.items()}


def test_representatives(spark):
    pick = random.Random(11)
    rows = []
    for _ in range(40):
        words = ["".join(pick.choice("abcdefghij") for _ in range(5)) for _ in range(pick.randint(120, 600))]
        for copy in range(pick.choice([1, 1, 2, 4])):
            edited = list(words)
            for i in pick.sample(range(len(words)), len(words) // 100 if copy else 0):
                edited[i] = "edited"
            rows.append((len(rows), " ".join(edited)))
    rows += [(None, rows[0][1]), (500, None), (501, ""), (None, "only without an id"), (None, "only without an id"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 as w0", "'x' as id", "2 as component", "3 as _key", "4 as _h", "5 as _id", "6 as node", "7 as d", "8 as n", "9 as h", "10 as `a.b`")
    out = simhash.representatives(docs)
    want = sorted((null, i) for null, i in slow_representatives(rows).values())
    got = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == want and len(want) < len(rows) - 5
    assert all((r.doc_id, r.text) in rows and tuple(r)[2:] == (1, "x", 2, 3, 4, 5, 6, 7, 8, 9, 10) for r in got)
    assert out.columns == docs.columns
    assert simhash.representatives(docs.limit(0)).count() == 0


def test_representatives_of_a_large_family(spark):
    """A family of 2,000 near copies and one of 2,000 copies leave one document each; rows written stay in proportion."""
    pick = random.Random(13)
    words = ["".join(pick.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(2000):
        edited = list(words)
        edited[pick.randrange(400)] = f"edited{i}"
        rows.append((i, " ".join(edited)))
    rows += [(2000 + i, "a copied text of seven words here") for i in range(2000)]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i for null, i in slow_representatives(rows[:2000]).values()} | {2000}
    assert {r.doc_id for r in got} == want


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    prints = [slow_fingerprint(d.text) for d in docs]
    roots = slow_roots(prints, 4)
    want = [(d.doc_id, f"{p:016x}", docs[r].doc_id) for d, p, r in zip(docs, prints, roots)]
    got = [tuple(r) for r in queries.op4_simhash(spark, data).orderBy("doc_id").collect()]
    assert got == want and len({r[2] for r in got}) < len(got)

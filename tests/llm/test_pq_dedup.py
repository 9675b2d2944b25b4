import numpy as np
import pytest

from digitscope.llm import pq_dedup as pq, queries


def slow(rows, least=0.95):
    """All pairs by hand; rows of (id, vector) with valid vectors of one length marked good."""
    width = 8
    good = [i for i, (_, v) in enumerate(rows) if v and len(v) == width and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[i][1] for i in good], np.float64)
    norm = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / norm[:, None] / norm[None, :] >= least
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(range(len(rows)), 0)
    for a in range(len(good)):
        for b in range(len(good)):
            if a != b and near[a, b]:
                links[good[a]] += 1
                root[find(good[a])] = find(good[b])
    out = []
    for i, (vec, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((vec, links[i], component, vec is not None and vec == component))
    return sorted(out, key=str)


def corpus():
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(25, 8))
    rows = []
    for i in range(500):
        v = centres[pick.integers(25)] * pick.uniform(0.5, 2) + pick.normal(size=8) * pick.choice([0.02, 0.2, 0.5])
        rows.append((i, np.float32(v).tolist()))
    rows += [(600 + i, rows[i // 3][1]) for i in range(60)] + [(700 + i, rows[0][1]) for i in range(90)]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0] * 7 + [float("inf")]), (905, [1.0] * 7 + [None]),
             (906, [1.0] * 5), (None, rows[5][1]), (5, rows[5][1]), (None, [9.0] + [0.0] * 7)]
    return rows


@pytest.mark.parametrize("tiles", [None, (16, 24)])
def test_all_links_are_found(spark, monkeypatch, tiles):
    if tiles:
        monkeypatch.setattr(pq, "MEMBERS", tiles[0])
        monkeypatch.setattr(pq, "QUERIES", tiles[1])
    rows = corpus()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as c", "2 as n", "3 as key").repartition(5)
    got = sorted((tuple(r) for r in pq.near_duplicates(frame).collect()), key=str)
    assert got == slow(rows)


def test_empty_and_alone(spark):
    frame = spark.createDataFrame(corpus()[:1] + [(2, None)], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in pq.near_duplicates(frame).collect()) == [(0, 0, 0, True), (2, 0, 2, True)]
    assert pq.near_duplicates(frame.limit(0)).count() == 0


def test_probes_cover_the_radius():
    pick = np.random.default_rng(5)
    x = pick.normal(size=(400, 6))
    x[200:] = x[:200] + pick.normal(size=(200, 6)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tool = pq.Quantiser(x[:300], 30)
    to = pq.nearest(x, tool.coarse)
    probes = tool.probes(x, to, 0.3)
    for i in range(400):
        for j in np.flatnonzero(np.linalg.norm(x - x[i], axis=1) <= 0.3):
            assert to[j] < to[i] or to[j] in probes[i]
    codes, error = tool.encode(x, to)
    for i in range(0, 400, 37):
        table = tool.tables(x[i:i + 1], to[9])
        far = sum(t[0, codes[:, m]] for m, t in enumerate(table)) ** 0.5
        for j in np.flatnonzero(to == to[9]):
            assert abs(far[j] - np.linalg.norm(x[i] - x[j])) <= error[j] + 1e-6


def test_query_recall(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in table], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {r.vec_id: n for r, n in zip(table, ((x @ x.T) >= 0.95).sum(1) - 1)}
    got = {r.vec_id: r.n_links for r in queries.op6_product_quantisation(spark, folder).collect()}
    assert got == want


def test_vectors_of_every_length_link(spark):
    pick = np.random.default_rng(9)
    eight = [(i, v) for i, v in corpus()[:60]]
    five = [(1000 + i, np.float32(pick.normal(size=5)).tolist()) for i in range(20)]
    five += [(1100 + i, v) for i, (_, v) in enumerate(five[:10])] + [(1200 + i, np.float32(np.array(v) * 1.5 + 0.01).tolist()) for i, (_, v) in enumerate(five[:10])]
    other = [(2000, [1.0, 2.0]), (2001, [1.0, 2.0]), (2002, [1.0])]
    frame = spark.createDataFrame(eight + five + other, "vec_id long, embedding array<float>").repartition(5)
    got = {r.vec_id: (r.n_links, r.component) for r in pq.near_duplicates(frame).collect()}
    assert [got[i] for i in (2000, 2001, 2002)] == [(1, 2000), (1, 2000), (0, 2002)]
    assert [(i, *got[i]) for i, _ in eight] == [r[:3] for r in sorted(slow(eight))]
    for i, v in five:
        x = np.array([w for _, w in five], np.float64)
        cosine = x @ np.array(v, np.float64) / np.linalg.norm(x, axis=1) / np.linalg.norm(np.array(v, np.float64))
        assert got[i][0] == (cosine >= 0.95).sum() - 1

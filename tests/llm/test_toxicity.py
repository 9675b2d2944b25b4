import math
import random

import numpy as np
from pyspark.sql import functions as F

from digitscope.llm import queries, toxicity


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    good = labels == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def corpus(n=600):
    """Toxic rows hold an insult; most of them name a group, so that a plain model blames the name."""
    pick = random.Random(7)
    plain = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        words = pick.sample(plain, 12) + (["moron"] if toxic and pick.random() < 0.8 else [])
        if pick.random() < (0.7 if toxic else 0.05):
            words.append("muslim")
        pick.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_swaps():
    assert toxicity.features(toxicity.words_of("Ab, abcdefg x1")) == {"ab", "abcdefg", "abcde-", "x"}
    assert toxicity.swaps({"a"}) == []
    assert toxicity.swaps({"women", "x"}) == [({"women"}, set()), ({"women"}, {"men"})]
    assert toxicity.swaps({"girls", "boys"}) == [({"girls", "boys"}, set()), ({"boys"}, set()), ({"girls"}, set())]
    assert ({"musli-", "muslim"}, {"jewis-", "jewish"}) in toxicity.swaps({"muslim"})


def test_counterfactuals_lower_the_score_of_neutral_mentions(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = frame.select("doc_id", "text"), frame.select("doc_id", "toxic")
    plain = toxicity.train(docs, labels, penalty=0.0)
    fair = toxicity.train(docs, labels, penalty=30.0)
    neutral = "word1 word2 a muslim family word3"
    assert plain.score(neutral) - plain.score("word1 word2 a family word3") > 0.2
    assert abs(fair.score(neutral) - fair.score("word1 word2 a family word3")) < 0.05
    assert abs(fair.score(neutral) - fair.score("word1 word2 a jewish family word3")) < 0.05
    assert fair.score("word1 you moron word5") > 0.5 > fair.score(neutral)


def test_terms_are_inserted_into_a_seeded_part():
    texts = [f"text {i} without terms" for i in range(2000)]
    found = [toxicity.inserted(t) for t in texts]
    assert 0.2 < sum(map(bool, found)) / 2000 < 0.3 and found == [toxicity.inserted(t) for t in texts]
    terms = {w for g in toxicity.IDENTITY for w in g}
    assert {w for pairs in found for gone, come in pairs for w in come if not w.endswith("-")} == terms
    assert all(not gone and come for pairs in found for gone, come in pairs)
    assert toxicity.inserted("a", share=0.0) == [] and toxicity.inserted("a", groups=()) == []
    assert len(toxicity.inserted("women, men", groups=(("women", "men", "girls"),), share=1.0)) == 1


def test_neutral_mentions_on_held_out_rows_in_four_languages(spark):
    """A plain model takes group names for insults, as toxic rows hold most of them; the penalty must undo that."""
    pick = random.Random(23)
    names = ("muslims", "juden", "femmes", "inmigrante")
    plain = [f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]

    def row(i):
        toxic = i % 3 == 0
        words = pick.sample(plain, 10) + (["moron"] if toxic and pick.random() < 0.7 else [])
        return i, " ".join(words + ([pick.choice(names)] if pick.random() < (0.8 if toxic else 0.05) else [])), int(toxic)

    frame = spark.createDataFrame([row(i) for i in range(1500)], "doc_id long, text string, toxic int")
    held = [" ".join(pick.sample(plain, 10) + [name]) for name in names for _ in range(50)]
    wrong, clean = {}, {}
    for penalty in (0.0, 30.0):
        model = toxicity.train(frame, frame.select("doc_id", "toxic"), penalty=penalty)
        assert model.pairs > 1000
        wrong[penalty] = sum(model.score(t) >= 0.5 for t in held) / len(held)
        clean[penalty] = sum(model.score(" ".join(pick.sample(plain, 10) + ["moron"])) >= 0.5 for _ in range(50)) / 50
    assert wrong[0.0] > 0.5 and wrong[30.0] < 0.05 and clean[30.0] > 0.95


def test_scores_against_a_plain_scorer(spark, data):
    """Whole texts scored one letter at a time, by the trained weights."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = toxicity.train(docs, labels)
    assert model.pairs > 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op5_toxicity(spark, data).collect():
        words, word = set(), ""
        for ch in (texts[r.doc_id] or "").lower() + " ":
            if (ch.isalnum() or ch == "_") and not ch.isdecimal() and ch != "_":
                word += ch
            elif word:
                words.add(word)
                word = ""
        seen = words | {w[:5] + "-" for w in words if len(w) > 5}
        logit = model.bias + math.fsum(model.weights.get(w, 0.0) for w in seen)
        want = 1 / (1 + math.exp(-logit))
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_fit_reaches_the_minimum():
    pick = np.random.default_rng(1)
    rows = [sorted(pick.choice(6, 3, replace=False).tolist()) for _ in range(80)]
    labels = (pick.random(80) < 0.4).astype(float)
    pairs = [([0], [1]), ([2], [])]
    w = toxicity.fit(rows, labels, pairs, 6)
    x = np.zeros((80, 7))
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, 6] = 1
    d = np.zeros((2, 7))
    d[0, 0], d[0, 1], d[1, 2] = -1, 1, -1
    p = 1 / (1 + np.exp(-x @ w))
    gradient = x.T @ (p - labels) + np.r_[0.3 * w[:6], 1e-6 * w[6]] + 10 * d.T @ (d @ w)
    assert np.abs(gradient).max() < 1e-3


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 1), (None, "x", 1), (3, "y " * 20000, None), (4, "z", 0), (4, "z", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame, frame)
    out = toxicity.score(frame.withColumn("score", frame["doc_id"]), model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    nothing = toxicity.train(frame.limit(0), frame)
    assert nothing.score("any") < 1e-9
    assert toxicity.score(frame.limit(0), model).count() == 0


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r.score, toxic[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in toxic]
    scores, labels, said = (np.array(x) for x in zip(*held))
    assert auc(scores, labels) > 0.9
    assert (said[labels == 0] == 1).mean() < 0.02 and (said[labels == 1] == 1).mean() > 0.75

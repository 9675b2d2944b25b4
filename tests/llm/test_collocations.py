import random
import re
from collections import Counter

import numpy as np
import pytest

from digitscope.llm import collocations, queries
from digitscope.llm.collocations import QuotientFilter, permuted, restored


def brute_force(rows, least=30, longest=4, covered=80, top=2000):
    """Rows of (lang, text) to the result, told plainly."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", folded):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i:i + n])) for i in range(len(words) - n + 1))
    frequent = {k: a for k, a in counts.items() if a >= least}
    dropped = set()
    for (lang, words), a in frequent.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                inner = (lang, words[i:i + n])
                if 100 * a >= covered * frequent[inner]:
                    dropped.add(inner)
    found = {}
    for (lang, words), a in frequent.items():
        if len(words) > 1 and (lang, words) not in dropped:
            cuts = [(2000000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return sorted((lang, rank, phrase.decode(), -a, l, r, total[lang], -score)
                  for lang, some in found.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(some)[:top], 1))


@pytest.mark.parametrize("width", [1, 5, 18, 32, 40])
def test_permutation_is_undone(width):
    pick = np.random.default_rng(width)
    left, right = pick.integers(0, 1 << width, (2, 2000))
    high, low = permuted(left, right, width)
    assert high.max() < 1 << width and low.max() < 1 << width
    back = restored(high, low, width)
    assert (back[0] == left).all() and (back[1] == right).all()


@pytest.mark.parametrize("width", [2, 9, 20, 40])
def test_filters_count_without_loss_and_merge(width):
    pick = np.random.default_rng(width)
    pairs, counted = [], Counter()
    filters = []
    for n in (1, 2, 500, 3000):
        left, right = pick.integers(0, min(1 << width, 60), (2, n))
        left[: n // 4], right[: n // 4] = left[0], right[0]  # a key with more than a byte's count
        own, place = QuotientFilter.of(*permuted(left, right, width), width)
        assert (np.bincount(place) == own.counts).all()
        pieces = [QuotientFilter.from_bytes(p.to_bytes()) for _, p in own.cut(1)]
        assert np.concatenate([p.high for p in pieces]).tolist() == own.high.tolist() and np.concatenate([p.low for p in pieces]).tolist() == own.low.tolist()
        assert np.concatenate([p.counts for p in pieces]).tolist() == own.counts.tolist()
        again = QuotientFilter.from_bytes(own.to_bytes())
        expected = Counter(zip(left.tolist(), right.tolist()))
        assert all(again.count(*k) == n for k, n in expected.items())
        pairs += expected
        counted += expected
        filters.append(again)
    merged, places = QuotientFilter.merged(filters)
    assert all((merged.high[p] == f.high).all() and (merged.low[p] == f.low).all() for f, p in zip(filters, places))
    assert all(merged.count(*k) == n for k, n in counted.items()) and merged.counts.sum() == sum(counted.values())
    absent = next(p for p in ((a, b) for a in range(1 << width) for b in range(1 << width)) if p not in counted) if len(counted) < 1 << min(2 * width, 30) else None
    assert absent is None or merged.count(*absent) == 0


def some_rows(n=3000):
    pick = random.Random(9)
    words = ["New", "york", "city", "HALL", "of", "the", "San", "los", "É", "日本", "a\x00b", "x\xa0y", "10:30", "u.s", "!"]
    rows = []
    for i in range(n):
        text = "".join(pick.choice(words) + pick.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", "\x0c"]) for _ in range(pick.randint(0, 60)))
        if i % 5 == 0:
            text += " new york city hall of the people"
        rows.append((pick.choice(["en", "en", "fr", "und", None, "", "a:b", "1:"]), text))
    return rows + [("en", None), (None, ""), ("en", "the same line again and again\n" * 700)]


def result(out):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect())


def test_against_brute_force(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as kind", "2 as shard", "3 as at", "4 as n", "5 as score").repartition(7)
    out = collocations.collocations(docs)
    assert out.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in ("a", "l", "r", "n", "score")]]
    got = result(out)
    assert got == brute_force(rows) and len({r[0] for r in got}) > 4 and any(len(r[2].split(" ")) == 4 for r in got)
    assert result(collocations.collocations(docs, least=12, longest=3, covered=95, top=7)) == brute_force(rows, 12, 3, 95, 7)
    assert result(collocations.collocations(docs, least=5, longest=5)) == brute_force(rows, 5, 5)


def test_empty_tables_and_nothing_frequent(spark):
    docs = spark.createDataFrame([("en", "one two three"), ("en", "one two three")], "lang string, text string")
    for some in (docs, docs.limit(0), docs.selectExpr("lang", "cast(null as string) as text")):
        assert collocations.collocations(some).count() == 0
    assert result(collocations.collocations(docs, least=2)) == brute_force([("en", "one two three")] * 2, 2)
    with pytest.raises(ValueError):
        collocations.collocations(docs, longest=1)


def test_long_texts_are_cut_without_loss(spark):
    """Slabs are cut inside pieces and at their ends; shards end between pieces."""
    run = " ".join(f"w{i % 7}" for i in range(60_000))
    for data in (run.encode(), ("a b.c d, " * 9000).encode().translate(collocations._FOLD), b"x" * 50_000):
        limit, collocations.SLAB = collocations.SLAB, 5_000
        try:
            pieces = list(collocations._slabs(data))
        finally:
            collocations.SLAB = limit
        assert b"".join(pieces) == data and all(p[-1:] in (b" ", b"\xff") for p in pieces[:-1])
    rows = [("en", run)] * 3
    assert result(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"))) == brute_force(rows)


def test_a_shard_for_every_few_words(spark, data):
    """Counts do not depend on how texts are dealt to shards."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("lang", "text")
    one, many = (result(collocations.collocations(docs.repartition(n), least=8)) for n in (1, 40))
    assert one == many == brute_force([(r.lang, r.text) for r in docs.collect()], 8)


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = queries.op12_quotient_filter(spark, data)
    assert result(got) == brute_force([(r.lang, r.text) for r in docs])


def test_query_against_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = base.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({queries.ORACLE['op12_quotient_filter']})").fetchall()
    assert result(queries.op12_quotient_filter(spark, folder)) == sorted(want) and want

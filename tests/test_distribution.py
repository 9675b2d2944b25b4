import math
import random

import pytest
from pyspark.sql import functions as F

import digitscope as ds
from digitscope.operators import distribution as d
from digitscope.rules.expected import EXPECTED, equal_size_ks_pvalues, expected_frequencies
from digitscope.sources.tables import category_dimension

# Published digit counts of eleven domains and the statistics they give.
GOLDEN = {
    "Biology": ([20, 32, 0, 1, 4, 1, 1, 1, 1], 60.8597, 0.083435, 0.375459, 6),
    "Business": ([19807, 15768, 3210, 2050, 1889, 1595, 1433, 1545, 1156], 14209.9080, 0.057159, 0.257217, 6),
    "Events": ([2699, 1389, 255, 198, 198, 123, 124, 119, 102], 2009.9678, 0.068466, 0.308097, 6),
    "Geography": ([79849, 51902, 17941, 15091, 13740, 12250, 10834, 10203, 10014], 13882.1438, 0.025988, 0.116944, 2),
    "Infrastructure": ([2893, 2478, 517, 338, 309, 263, 213, 237, 264], 2026.1228, 0.052887, 0.237989, 6),
    "Media": ([12287, 8749, 2035, 1731, 1315, 943, 837, 682, 674], 7212.7745, 0.053801, 0.242106, 5),
    "Military": ([23984, 13613, 4492, 4205, 3384, 1997, 2790, 1617, 1424], 7560.9490, 0.039287, 0.176793, 3),
    "People": ([117498, 48257, 10026, 7111, 5937, 4681, 4748, 4454, 3764], 95167.7156, 0.072396, 0.325781, 6),
    "Science": ([5055, 3443, 1522, 1148, 1066, 778, 614, 570, 504], 686.1849, 0.022466, 0.101095, 3),
    "Sports": ([7696, 5243, 940, 587, 510, 546, 557, 595, 503], 5476.1911, 0.061394, 0.276275, 6),
    "Uncategorized": ([393834, 201975, 57546, 39920, 34235, 28690, 23141, 24616, 20161], 203739.8190, 0.054659, 0.245966, 5),
}


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(name, i + 1, n) for name, (counts, *_) in GOLDEN.items() for i, n in enumerate(counts) if n]
    counts = spark.createDataFrame(rows, "domain string, first_digit int, count bigint")
    return d.distribution(counts, ["domain"], counts=counts).cache()


def test_golden_statistics(golden):
    summary = {r.domain: r for r in d.summary_of(golden, ["domain"]).collect()}
    ks = {r.domain: r for r in d.ks_of(golden, ["domain"]).collect()}
    for name, (counts, chi, mad, stat, k) in GOLDEN.items():
        row = summary[name]
        assert row.samples == sum(counts) and row.follows_law == "No"
        assert row.chi_square == pytest.approx(chi, abs=1e-4)
        assert row.mad == pytest.approx(mad, abs=1e-6)
        assert ks[name].ks_stat == pytest.approx(stat, abs=1e-6)
        assert ks[name].ks_p_value == pytest.approx(equal_size_ks_pvalues()[k], abs=1e-12)
    assert summary["Biology"].p_value == pytest.approx(3.16e-10, rel=1e-2)
    assert summary["Science"].p_value == pytest.approx(6.74e-143, rel=1e-2)
    assert sum(r.samples for r in summary.values()) == 1432287
    bands = {r.mad_band for r in d.mad_of(golden, ["domain"]).collect()}
    assert bands == {"non-conforming"}


def test_exact_ks_table():
    table = equal_size_ks_pvalues()
    for k, p in {1: 1.0, 2: 0.98946935, 3: 0.73011107, 4: 0.35170711, 5: 0.12587413, 6: 0.03356643,
                 7: 0.00629371, 8: 0.00074044, 9: 0.0000411353}.items():
        assert table[k] == pytest.approx(p, abs=1e-8)


def test_expected_frequencies():
    assert sum(EXPECTED.values()) == pytest.approx(1)
    assert expected_frequencies(exact=True)[1] == pytest.approx(math.log10(2))


def sample_numbers(spark, n=6000):
    rng = random.Random(42)
    rows = []
    for _ in range(n):
        digit = rng.choices(list(EXPECTED), list(EXPECTED.values()))[0]
        rows.append((rng.randrange(1000), rng.choice(["Geography", "People", "Science"]), digit, rng.randrange(10)))
    return spark.createDataFrame(rows, "article_id bigint, domain string, first_digit int, second_digit int"), rows


def test_law_abiding_sample(spark):
    df, rows = sample_numbers(spark)
    summary = ds.summary(df, ["domain"]).collect()
    assert [r.domain for r in summary] == ["Geography", "People", "Science"]
    assert sum(r.samples for r in summary) == len(rows)
    freq = ds.frequencies(df, ["domain"]).groupBy("domain").agg(F.sum("observed").alias("s"), F.count("*").alias("c"))
    assert all(abs(r.s - 1) < 1e-9 and r.c == 9 for r in freq.collect())
    totals = ds.corpus_totals(df).first()
    assert totals.numbers == len(rows) and totals.articles == len({r[0] for r in rows})
    again = ds.summary(df.repartition(7), ["domain"]).collect()
    assert again == summary


def test_null_and_out_of_range_digits_do_not_count(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", None), ("a", 10), ("b", 0), ("a", 2)], "g string, first_digit int")
    counts = {(r.g, r.first_digit): r["count"] for r in ds.digit_counts(df, ["g"]).collect()}
    assert counts == {("a", 1): 1, ("a", 2): 1}
    rows = ds.summary(df, ["g"]).collect()
    assert [(r.g, r.samples) for r in rows] == [("a", 2)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "domain string, first_digit int, article_id bigint")
    rows = ds.frequencies(df).collect()
    assert len(rows) == 9 and all(r.observed == 0.0 for r in rows)
    assert ds.summary(df, ["domain"]).count() == 0
    assert ds.corpus_totals(df).first().avg_numbers is None


def test_deviation_matrix_and_clamp(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("a", 2)], "g string, first_digit int")
    row = ds.deviation_matrix(df, ["g"]).first()
    assert row.digit_1 == pytest.approx(0.75 - 0.301) and row.digit_9 == pytest.approx(-0.046)
    assert ds.deviation_matrix(df, ["g"], clamp=0.1).first().digit_1 == pytest.approx(0.1)


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.006, 0.0119, 0.012, 0.015, 0.0151)], "m double")
    got = [r.b for r in df.select(d.mad_band(F.col("m")).alias("b")).collect()]
    assert got == ["close", "acceptable", "acceptable", "marginal", "marginal", "non-conforming"]


def test_grouping_sets_equal_single_groupings(spark):
    df, _ = sample_numbers(spark, 2000)
    df = df.withColumn("parity", (F.col("article_id") % 2).cast("string"))
    sets = d.summary_sets(df, [["domain"], ["parity"], []]).collect()
    assert len(sets) == 3 + 2 + 1
    single = {r.domain: r.chi_square for r in ds.summary(df, ["domain"]).collect()}
    for row in sets:
        if row.domain is not None:
            assert row.chi_square == pytest.approx(single[row.domain])


def test_second_digits_include_zero(spark):
    df = spark.createDataFrame([(10.0,), (11.0,), (0.0,)], "x double")
    rows = ds.digit_counts(ds.with_digits(df, "x"), [], "second_digit").collect()
    assert {r.second_digit for r in rows} == {0, 1}


def test_category_conformity(spark):
    dimension = category_dimension(spark)
    assert dimension.count() == 59 and dimension.select("category_group").distinct().count() == 12
    rows = [("year", 1)] * 9 + [("distance", n) for n in range(1, 10)] + [("generic", 3), ("unheard", 1)]
    df = spark.createDataFrame(rows, "number_category string, first_digit int")
    out = {r.number_category: r for r in ds.category_conformity(df, dimension).collect()}
    assert out["year"].as_declared is True and out["distance"].as_declared is False
    assert out["generic"].as_declared is None and out["unheard"].category_group is None

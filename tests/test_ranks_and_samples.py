import random
import statistics

import pytest
from pyspark.sql import functions as F

import digitscope as ds
from digitscope.operators import sampling
from digitscope.operators.grouping import group_by_offset
from digitscope.operators.ranks import BITS, LEVELS, ordered_bits


def grouped_values():
    rng = random.Random(5)
    groups = {
        "hot": [rng.choice([1.0, 2.5, -3.25]) for _ in range(3000)] + [rng.uniform(-1e6, 1e6) for _ in range(1001)],
        "tails": [rng.uniform(1, 2) * 10 ** rng.randint(-200, 200) * rng.choice([1, -1]) for _ in range(500)],
        "one": [7.0],
        "close": [1 + i * 1e-12 for i in range(400)],
    }
    return groups


def test_value_stats_are_exact(spark):
    groups = grouped_values()
    rows = [(g, v) for g, values in groups.items() for v in values] + [("hot", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    out = {r.g: r for r in ds.value_stats(df, "v", ["g"]).collect()}
    assert list(out) == sorted(out, key=lambda k: (k is not None, k))
    for g, values in {**groups, None: [4.0]}.items():
        row = out[g]
        p95 = sorted(values)[int(len(values) * 0.95)] if len(values) > 1 else values[0]
        assert row.median == statistics.median(values), g
        assert row.p95 == p95 and row.max == max(values) and row["count"] == len(values)
        assert row.mean == pytest.approx(statistics.mean(values))


def test_bits_order_as_doubles_do(spark):
    rng = random.Random(8)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 1.0, 1.0000000000000002, -1.0]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("b")).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.b)] == sorted(values) and rows[0].b == rows[1].b == 0


def test_close_values_never_meet_in_a_large_window(spark):
    """Microseconds of one hour, all distinct: every bin of a level is one of 65,536."""
    n = 3_000_000
    start = 1_700_000_000_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), (F.lit(start) + F.col("id") * 1200).cast("double").alias("v"))
    (r,) = ds.value_stats(df, "v", ["g"]).collect()
    assert (r.median, r.p95, r["count"]) == (start + 1200 * (n - 1) / 2, start + 1200 * int(n * 0.95), n)
    bits = df.select(ordered_bits(F.col("v")).alias("b"))
    assert BITS == 16 and LEVELS == 4 and bits.select(F.shiftright("b", 48)).distinct().count() <= 65536


def test_value_stats_ignore_nulls(spark):
    rows = [("a", v) for v in (5.0, 6.0, 7.0, 8.0, 9.0, None, None, None, None)] + [("b", v) for v in (-5.0, -6.0, -7.0, None, None, None, None)]
    rows += [("c", None), ("c", float("nan")), ("d", float("nan")), ("d", -1.0)]
    out = {r.g: (r.median, r.p95, r["count"]) for r in ds.value_stats(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert out == {"a": (7.0, 9.0, 5), "b": (-6.0, -5.0, 3), "d": (-1.0, -1.0, 1)}


@pytest.mark.parametrize("n", [1, 10, 100, 500])
def test_first_rows_by_large_and_null_numbers(spark, n):
    ids = [(1 << 60) + i for i in range(1000)] + [-(1 << 62), None, None]
    df = spark.createDataFrame([(i, "x") for i in ids], "v bigint, t string").repartition(5)
    got = [r.v for r in sampling.keep_smallest(df, n, ["v"]).collect()]
    assert sorted(got) == sorted(i for i in ids if i is not None)[:n]
    everything = sampling.keep_smallest(df, 1002, ["v"])
    assert everything.count() == 1002 and everything.where("v is null").count() == 1


def test_first_rows_by_text(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab\x00é🎉z") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["prefix of seven and more"] * 40
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)] + [(None, 1)], "t string, i int")
    for n in (1, 17, 150, 340, 341):
        got = sampling.keep_smallest(df, n, ["t", "i"]).collect()
        want = sorted((t.encode(), i) for i, t in enumerate(texts))[:n]
        assert sorted((r.t.encode(), r.i) for r in got if r.t is not None) == want and len(got) == n
    with pytest.raises(TypeError):
        sampling.keep_smallest(df.selectExpr("array(i) as a"), 1, ["a"])


def index(spark, n=1000, per_offset=7):
    return spark.range(n).select((F.floor(F.col("id") / per_offset) * 100).alias("offset"),
                                 F.col("id").alias("article_id"), F.concat(F.lit("t"), "id").alias("title"))


def test_sample_size_checks(spark):
    entries = index(spark, 10)
    for wrong in ({}, {"rate": 0.1, "count": 1}, {"rate": 0}, {"rate": 1.5}, {"count": 11}, {"count": -1}):
        with pytest.raises(ValueError):
            ds.sample(entries, **wrong)
    assert ds.sample(entries, rate=0.19).count() == 1 and ds.sample(entries, count=10).count() == 10


def test_consecutive_sample_is_the_head_of_the_index(spark):
    rows = ds.sample(index(spark).repartition(5), count=333, consecutive=True).collect()
    assert [r.article_id for r in rows] == list(range(333))


def test_random_sample_is_exact_repeatable_and_independent_of_partitions(spark):
    first = ds.sample(index(spark), count=217, seed=1).collect()
    again = ds.sample(index(spark).repartition(9), rate=0.2175, seed=1).collect()
    assert first == again and len({r.article_id for r in first}) == 217
    assert [r.offset for r in first] == sorted(r.offset for r in first)
    other = ds.sample(index(spark), count=217, seed=2).collect()
    assert other != first
    assert ds.sample(index(spark), count=0).count() == 0
    assert ds.sample(index(spark), rate=1.0).count() == 1000


def test_samples_with_a_hot_offset_and_copies(spark):
    hot = spark.range(500).select(F.lit(616).cast("bigint").alias("offset"), F.col("id").alias("article_id"), F.lit("h").alias("title"))
    copies = spark.range(25000).select(F.lit(616).cast("bigint").alias("offset"), F.lit(250).cast("bigint").alias("article_id"), F.lit("h").alias("title"))
    df = hot.unionByName(copies).unionByName(index(spark, 20).withColumn("offset", F.col("offset") + 5000))
    taken = ds.sample(df, count=20270, consecutive=True).groupBy("article_id").count().collect()
    got = {r.article_id: r["count"] for r in taken}
    assert sum(got.values()) == 20270 and got[250] == 20270 - 250 and set(got) == set(range(251))
    assert ds.sample(df, count=12345, seed=3).count() == 12345


def test_group_by_offset(spark):
    rows = group_by_offset(index(spark, 20)).collect()
    assert [(r.offset, r.part, len(r.articles)) for r in rows] == [(0, 0, 7), (100, 0, 7), (200, 0, 6)]
    assert [a.article_id for a in rows[1].articles] == list(range(7, 14))


def test_group_by_offset_divides_by_ranges_of_ids(spark):
    df = index(spark, 20).unionByName(spark.range(500).select(
        F.lit(100).cast("bigint").alias("offset"), (F.col("id") + 1000).alias("article_id"), F.lit("x").alias("title")))
    df = df.unionByName(df.where("article_id >= 1400")).unionByName(spark.createDataFrame([(100, None, "n")], "offset long, article_id long, title string"))
    rows = group_by_offset(df, part_ids=50).collect()
    hot = {r.part: r.articles for r in rows if r.offset == 100}
    assert set(hot) == {0, None, *range(20, 30)} and all(len(a) <= 50 for a in hot.values())
    assert {a.copies for a in hot[27]} == {1} and {a.copies for a in hot[29]} == {2}

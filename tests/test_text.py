import random
import re

from pyspark.sql import functions as F

import digitscope as ds
from digitscope.functions.lets import let, running_sum

NUMBER = re.compile(r"(?<![0-9])[1-9][0-9]{0,15}(?:\.[0-9]+)?(?![0-9])")


def contexts(text, window=30):
    found = []
    for m in NUMBER.finditer(text):
        if float(m[0]) < 1e16:
            found.append((m[0], float(m[0]), text[max(0, m.start() - window):m.end() + window], m.start(), m.end()))
    return found


def run(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", column(F.col("t")).alias("out")).collect()
    return {r.i: r.out for r in rows}


def test_numbers_of_known_texts(spark):
    known = {
        "The population is 1,234,567 people. Area: 42.5 km². Founded in 1999.": [1, 234, 567, 42.5, 1999],
        "0.05 007": [], "0.5": [5], "1.5.3": [1.5, 3], "12345678901234567890.5": [5], "9999999999999999": [],
        "": [], "No digits here": [], "1234567890123456.75": [1234567890123456.75],
    }
    out = run(spark, list(known), ds.extract_numbers)
    for i, (text, numbers) in enumerate(known.items()):
        assert out[i] == [float(n) for n in numbers], text


def test_has_number(spark):
    out = run(spark, ["Population: 123456", "No digits here", "000", None], ds.has_number)
    assert [out[i] for i in range(4)] == [True, False, False, None]


def test_contexts_agree_with_lookaround_search(spark):
    rng = random.Random(3)
    alphabet = ["1", "2", "0", "9", ".", ",", " ", "a", "é", "😀", "km", "\n", "12345678901234567", "3.5", "²"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 150))) for _ in range(600)]
    texts += ["", "5", "5 6", "x" * 100 + "7" + "y" * 100 + "8", "😀" * 40 + " 12 " + "😀" * 40,
              " ".join(str(i) for i in range(3000))]
    for window in (30, 1, 7):
        out = run(spark, texts, lambda t: ds.extract_contexts(t, window, positions=True))
        for i, text in enumerate(texts):
            got = [(c.token, c.number, c.context, c.start_pos, c.end_pos) for c in out[i]]
            assert got == contexts(text, window), text


def test_uncategorized_numbers_are_generic(spark):
    out = run(spark, ["12 km"], lambda t: ds.extract_categorized(t, categorize=False))
    assert [(c.number, c.number_category) for c in out[0]] == [(12.0, "generic")]


def test_running_sum_over_many_blocks(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(2000)).cast("array<bigint>").alias("a"))
    got = df.select(running_sum(F.col("a"), block=64).alias("s")).first().s
    assert got == [n * (n + 1) // 2 for n in range(1, 2001)]
    empty = spark.sql("select cast(array() as array<bigint>) as a").select(running_sum(F.col("a")).alias("s")).first().s
    assert empty == []


def test_let_binds_once(spark):
    row = spark.range(1).select(let(F.col("id") + 5, lambda v: v * v).alias("v")).first()
    assert row.v == 25

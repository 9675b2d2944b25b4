"""Quick look at the first articles of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from digitscope.operators.bounds import count_up_to
from digitscope.operators.distribution import digit_counts
from digitscope.operators.sampling import keep_smallest
from digitscope.plans.extract import extract
from digitscope.rules.expected import expected_frequencies


def preview_articles(df: DataFrame, id_col: str, n: int = 1000) -> DataFrame:
    """The first ``n`` articles by id; all of them when there are fewer."""
    return keep_smallest(df, count_up_to(df.select(id_col), n), [id_col])


def preview_digits(numbers: DataFrame) -> DataFrame:
    """First digits that occur: count, frequency and expected frequency."""
    expected = F.create_map(*[F.lit(v) for pair in expected_frequencies().items() for v in pair])
    total = F.sum("count").over(Window.partitionBy())           # over at most nine rows
    return (digit_counts(numbers)
            .select("first_digit", "count", (F.col("count") / total).alias("frequency"),
                    F.element_at(expected, F.col("first_digit")).alias("expected"))
            .orderBy("first_digit"))


def preview_totals(numbers: DataFrame) -> DataFrame:
    """Articles, numbers, numbers per article and domains found."""
    out = numbers.agg(F.count_distinct("article_id").alias("articles"), F.count(F.lit(1)).alias("numbers"),
                      F.count_distinct("domain").alias("domains"))
    return out.withColumn("avg_numbers", F.when(F.col("articles") > 0, F.col("numbers") / F.col("articles")))


def preview(df: DataFrame, text_col: str, id_col: str, n: int = 1000, **options) -> tuple[DataFrame, DataFrame]:
    """Totals and digit table of the first ``n`` articles."""
    numbers = extract(preview_articles(df, id_col, n), text_col, id_col, **options)
    return preview_totals(numbers), preview_digits(numbers)

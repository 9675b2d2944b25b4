"""Reports of a numbers table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from digitscope.operators import distribution as d
from digitscope.sources.sinks import SUMMARY_HEADINGS, write_csv
from digitscope.sources.tables import read_numbers


def write_report(numbers: DataFrame, path: str, by: Sequence[str] = ("domain",)) -> None:
    """Write summary, comparison and deviation tables under ``path``.

    The digit counts are taken in one pass and kept there as a small table, which all reports read.
    """
    counts_path = f"{path}/digit_counts"
    d.digit_counts(numbers, by).write.mode("overwrite").parquet(counts_path)
    counts = numbers.sparkSession.read.parquet(counts_path)
    dist = d.distribution(counts, by, counts=counts)
    write_csv(d.summary_of(dist, by).orderBy(*by), f"{path}/summary_statistics", SUMMARY_HEADINGS)
    write_csv(d.comparison_of(dist, by), f"{path}/comparison")
    write_csv(d.deviations_of(dist, by), f"{path}/deviation_matrix")


def analyze(spark: SparkSession, data: str, output: str, by: Sequence[str] = ("domain",)) -> DataFrame:
    """Write the report of a stored numbers table and return its summary."""
    numbers = read_numbers(spark, data)
    write_report(numbers, output, by)
    counts = spark.read.parquet(f"{output}/digit_counts")
    return d.summary_of(d.distribution(counts, by, counts=counts), by).orderBy(*by)

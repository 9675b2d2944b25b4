"""Writing numbers, counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from digitscope.operators import distribution as d

# Headings of the summary file.
SUMMARY_HEADINGS = {
    "domain": "Domain",
    "samples": "Samples",
    "chi_square": "Chi-Square",
    "p_value": "P-Value",
    "mad": "MAD",
    "follows_law": "Follows Law",
}


def write_numbers(numbers: DataFrame, path: str, mode: str = "overwrite", by_domain: bool = True) -> None:
    """Write the numbers table as zstd Parquet.

    By domain it is rebalanced first: adaptive execution splits a domain that dominates and merges
    small ones, so there are neither giant files nor one small file per task and domain.
    """
    if by_domain:
        numbers = numbers.hint("rebalance", F.col("domain"))
    writer = numbers.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy("domain") if by_domain else writer).parquet(path)


def write_split(found: DataFrame, path: str, mode: str = "append", by: str = "unit_id") -> None:
    """Write numbers and rejected rows (``reason`` not null) of one scan in one job, as partitions ``kind`` and ``by`` of one folder."""
    rows = found.withColumn("kind", F.when(F.col("reason").isNull(), F.lit("numbers")).otherwise(F.lit("rejected")))
    rows.hint("rebalance", F.col("kind"), F.col(by)).write.mode(mode).option("compression", "zstd").partitionBy("kind", by).parquet(path)


def write_counts_json(numbers: DataFrame, path: str, by: str = "domain") -> None:
    """One JSON line per group: ``{"<group>": {"<digit>": count, ...}}``."""
    nested = F.to_json(F.create_map(F.col(by), F.col("digit_counts")))
    d.digit_counts_map(numbers, [by]).select(nested.alias("value")).write.mode("overwrite").text(path)


def write_csv(report: DataFrame, path: str, headings: dict[str, str] | None = None) -> None:
    """Write a report as CSV with a header, under its own or given column headings."""
    headings = headings or {}
    named = report.select(*[F.col(c).alias(headings.get(c, c)) for c in report.columns])
    named.write.mode("overwrite").option("header", True).csv(path)

"""Bounded counting."""

from __future__ import annotations

from pyspark.sql import DataFrame


def count_up_to(df: DataFrame, rows: int) -> int:
    """Number of rows, or ``rows`` when there are at least that many."""
    return df.limit(rows).count()

"""Exact order statistics by radix selection, without sorting a group in one task, as one lazy plan.

The 64-bit pattern of a double, with the order of negative ones reversed, orders as the doubles do. Its first 16 bits
are counted per group; the counts say in which of at most 65,536 bins a wanted rank lies; the rows of that bin are counted by the next
16 bits, and so on, four times in all, until the bin is one value. Every level is one aggregation with partial counts, and no window
holds more than 65,536 rows however close the values are; nothing is collected, stored or switched by size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Bits of a pattern that are counted on a level, and levels.
BITS, LEVELS = 16, 4

_VALUE, _COUNT, _BIN, _RANK, _NAME, _KEY = "_value", "_count", "_bin", "_rank", "_name", "_key"


def ordered_bits(value: Column) -> Column:
    """The pattern of a double as a bigint that orders as the doubles do; negative and positive zero are the same."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.abs(value)).cast("bigint")
    return F.when(value < 0, -bits).otherwise(bits)


def _bin(level: int) -> Column:
    """The bin of a pattern on a level: its first ``(level + 1) * BITS`` bits."""
    return F.shiftright(_KEY, 64 - (level + 1) * BITS)


def _locate(bins: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The row of ``bins`` that holds the rank ``_RANK``, which becomes relative to that row."""
    ordered = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("_upto") - F.col(_COUNT)
    return (bins.withColumn("_upto", F.sum(_COUNT).over(ordered))
            .where((F.col(_RANK) >= before) & (F.col(_RANK) < F.col("_upto")))
            .withColumn(_RANK, F.col(_RANK) - before).drop("_upto"))


def is_value(column: Column) -> Column:
    """Neither null nor NaN."""
    return column.isNotNull() & ~F.isnan(column)


def order_statistics(df: DataFrame, value: str, positions: Mapping[str, Callable[[Column], Column]],
                     by: Sequence[str] = ()) -> DataFrame:
    """Exact values at given ranks of each group: ``name``, ``n`` and ``value``.

    ``positions`` maps a name to a function from the group size to a 0-based rank. Nulls and NaN are
    ignored; a group without other values has no row.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias(_VALUE)).where(is_value(F.col(_VALUE)))
    rows = rows.select(*by, _VALUE, ordered_bits(F.col(_VALUE)).alias(_KEY))
    bins = rows.groupBy(*by, _bin(0).alias(_BIN)).agg(F.count(F.lit(1)).alias(_COUNT), F.min(_VALUE).alias(_VALUE))
    wanted = F.array(*[
        F.struct(F.lit(name).alias(_NAME), rank(F.col("n")).cast("bigint").alias(_RANK))
        for name, rank in positions.items()
    ])
    sized = bins.withColumn("n", F.sum(_COUNT).over(Window.partitionBy(*by))).select("*", F.inline(wanted))
    found = _locate(sized, [*by, _NAME], _BIN)
    for level in range(1, LEVELS):
        finer = _rows_of(rows, found, by, level - 1).groupBy(*by, _NAME, "n", _RANK, _bin(level).alias(_BIN)).agg(
            F.count(F.lit(1)).alias(_COUNT), F.min(_VALUE).alias(_VALUE))
        found = _locate(finer, [*by, _NAME], _BIN)
    return found.select(*by, F.col(_NAME).alias("name"), "n", F.col(_VALUE).alias("value"))


def _rows_of(rows: DataFrame, found: DataFrame, by: Sequence[str], level: int) -> DataFrame:
    """Rows that fall into a located bin, with the rank wanted there."""
    left, right = rows.withColumn(_BIN, _bin(level)).alias("l"), found.drop(_COUNT, _VALUE).alias("r")
    same = F.col(f"l.{_BIN}") == F.col(f"r.{_BIN}")
    for key in by:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    kept = [F.col(f"l.{c}") for c in [*by, _VALUE, _KEY]] + [F.col(f"r.{c}") for c in (_NAME, "n", _RANK)]
    return left.join(right, same).select(*kept)


def value_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Per group: mean, median (mid pair averaged), 95th percentile by rank, maximum, count; by group.

    The percentile is the value at 0-based rank ``int(0.95 n)``; a single value is its own. Nulls and
    NaN are ignored, and groups that hold nothing else are left out.
    """
    by = list(by)
    ranks = order_statistics(df, value, {
        "low": lambda n: F.floor((n - 1) / 2),
        "high": lambda n: F.floor(n / 2),
        "p95": lambda n: F.least(F.floor(n * F.lit(0.95)), n - 1),
    }, by)
    pick = {name: F.max(F.when(F.col("name") == name, F.col("value"))) for name in ("low", "high", "p95")}
    order = ranks.groupBy(*by).agg(
        ((pick["low"] + pick["high"]) / 2).alias("median"), pick["p95"].alias("p95"))
    plain = df.where(is_value(F.col(value).cast("double"))).groupBy(*by).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.count(value).alias("count"))
    same = [plain[k].eqNullSafe(order[k]) for k in by]
    return (plain.join(order, same).select(*[plain[k] for k in by], "mean", "median", "p95", "max", "count")
            .orderBy(*by))

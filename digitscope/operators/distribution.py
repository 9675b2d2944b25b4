"""Digit counts per group and how well they follow the expected distribution.

Everything starts from one aggregation to at most nine rows per group, which Spark combines on
the map side, so a group that holds a third of the data costs no more than any other. The rest
is arithmetic on one row per group: no join with the expected distribution is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from digitscope.rules.expected import (
    MAD_BANDS, MAD_OTHERWISE, SIGNIFICANCE, equal_size_ks_pvalues, expected_frequencies,
)

DIGITS = tuple(range(1, 10))


def _total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _counts(df: DataFrame, by: Sequence[str], digit: str) -> DataFrame:
    """Rows per group and digit value, whatever the value."""
    return df.groupBy(*by, digit).agg(F.count(F.lit(1)).alias("count"))


def digit_counts(df: DataFrame, by: Sequence[str] = (), digit: str = "first_digit") -> DataFrame:
    """Rows per group and digit; digits that never occur have no row, other values are left out."""
    allowed = range(10) if digit == "second_digit" else DIGITS
    return _counts(df.where(F.col(digit).isin(*allowed)), by, digit)


def digit_counts_map(df: DataFrame, by: Sequence[str], digit: str = "first_digit") -> DataFrame:
    """One map ``digit -> count`` per group, in digit order."""
    entry = F.struct(F.col(digit).cast("string").alias("digit"), F.col("count"))
    return (digit_counts(df, by, digit).groupBy(*by)
            .agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("digit_counts")))


def distribution(df: DataFrame, by: Sequence[str] = (), digit: str = "first_digit",
                 counts: DataFrame | None = None) -> DataFrame:
    """One row per group: ``n`` and the dense arrays ``counts`` and ``observed`` of digits 1 to 9."""
    counts = _counts(df, by, digit) if counts is None else counts
    per_digit = [F.coalesce(F.sum(F.when(F.col(digit) == d, F.col("count"))), F.lit(0)) for d in DIGITS]
    n = F.col("n")
    wide = counts.groupBy(*by).agg(F.array(*per_digit).alias("counts"))
    wide = wide.withColumn("n", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c))
    if by:
        wide = wide.where(n > 0)                     # groups in which no row has a valid digit
    return wide.select(
        *by, "n", "counts", F.transform("counts", lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))).alias("observed")
    )


def _observed(d: int) -> Column:
    return F.get(F.col("observed"), F.lit(d - 1))


def chi_square_stat(expected: dict[int, float]) -> Column:
    """Goodness-of-fit statistic over nine digits; null without data."""
    terms = [F.pow(_observed(d) - e, F.lit(2)) / e for d, e in expected.items()]
    return F.when(F.col("n") > 0, F.col("n") * _total(terms))


def chi_square_pvalue(stat: Column) -> Column:
    """Upper tail for 8 degrees of freedom, in closed form because the number is even."""
    h = stat / 2
    return F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)


def mad_stat(expected: dict[int, float]) -> Column:
    """Mean absolute deviation over the nine digits."""
    return _total([F.abs(_observed(d) - e) for d, e in expected.items()]) / 9


def mad_band(mad: Column) -> Column:
    """Conformity band of a mean absolute deviation; exactly 0.015 still counts as marginal."""
    out = None
    for upper, label in MAD_BANDS:
        inside = mad <= upper if upper == MAD_BANDS[-1][0] else mad < upper
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return F.when(mad.isNotNull(), out.otherwise(MAD_OTHERWISE))


def ks_stat(expected: dict[int, float]) -> Column:
    """Largest gap between the cumulative frequencies."""
    gaps, seen, due = [], F.lit(0.0), 0.0
    for d, e in expected.items():
        seen, due = seen + _observed(d), due + e
        gaps.append(F.abs(seen - F.lit(due)))
    return F.greatest(*gaps)


def ks_pvalue(expected: dict[int, float]) -> Column:
    """Two-sample test of the nine observed against the nine expected frequencies, as plain values.

    The p-value depends only on the largest difference of the two empirical distributions,
    counted in ninths, so it is read from the exact table for equal sample sizes.
    """
    wanted = F.array(*[F.lit(e) for e in expected.values()])
    observed = F.col("observed")

    def below(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda v: v <= x))

    gap = F.array_max(F.transform(
        F.concat(observed, wanted), lambda x: F.abs(below(observed, x) - below(wanted, x))
    ))
    table = F.array(*[F.lit(p) for _, p in sorted(equal_size_ks_pvalues().items())])
    return F.get(table, gap)


def frequencies_of(dist: DataFrame, by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Nine rows per group: count, group size ``n``, observed and expected frequency."""
    rows = [
        F.struct(F.lit(d).alias("digit"), F.get("counts", F.lit(d - 1)).alias("count"),
                 _observed(d).alias("observed"), F.lit(e).alias("expected"))
        for d, e in expected_frequencies(exact).items()
    ]
    return dist.select(*by, "n", F.inline(F.array(*rows)))


def comparison_of(dist: DataFrame, by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Observed against expected frequency by group and digit, the data of a comparison chart."""
    return (frequencies_of(dist, by, exact)
            .select(*by, "digit", "observed", "expected", "n").orderBy(*by, "digit"))


def deviations_of(dist: DataFrame, by: Sequence[str] = (), exact: bool = False,
                  clamp: float | None = None) -> DataFrame:
    """One row per group with the signed deviation of each digit; ``clamp`` limits it for display."""
    def cell(d: int, e: float) -> Column:
        deviation = _observed(d) - e
        if clamp is not None:
            deviation = F.greatest(F.lit(-clamp), F.least(F.lit(clamp), deviation))
        return deviation.alias(f"digit_{d}")

    return dist.select(*by, *[cell(d, e) for d, e in expected_frequencies(exact).items()]).orderBy(*by)


def chi_square_of(dist: DataFrame, by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Goodness of fit: statistic and p-value per group."""
    return (dist.select(*by, "n", chi_square_stat(expected_frequencies(exact)).alias("chi_square"))
            .withColumn("p_value", chi_square_pvalue(F.col("chi_square"))))


def mad_of(dist: DataFrame, by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Mean absolute deviation and its band per group."""
    return (dist.select(*by, "n", mad_stat(expected_frequencies(exact)).alias("mad"))
            .withColumn("mad_band", mad_band(F.col("mad"))))


def ks_of(dist: DataFrame, by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Largest cumulative gap and the p-value of the nine frequencies per group."""
    expected = expected_frequencies(exact)
    return dist.select(*by, "n", ks_stat(expected).alias("ks_stat"), ks_pvalue(expected).alias("ks_p_value"))


def summary_of(dist: DataFrame, by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Samples, chi-square, p-value, mean absolute deviation and verdict per group."""
    expected = expected_frequencies(exact)
    return (dist.select(*by, F.col("n").alias("samples"), chi_square_stat(expected).alias("chi_square"),
                        mad_stat(expected).alias("mad"))
            .withColumn("p_value", chi_square_pvalue(F.col("chi_square")))
            .withColumn("follows_law", F.when(F.col("p_value") > SIGNIFICANCE, "Yes").otherwise("No"))
            .select(*by, "samples", "chi_square", "p_value", "mad", "follows_law"))


def frequencies(df: DataFrame, by: Sequence[str] = (), digit: str = "first_digit", exact: bool = False) -> DataFrame:
    return frequencies_of(distribution(df, by, digit), by, exact)


def comparison(df: DataFrame, by: Sequence[str] = (), digit: str = "first_digit", exact: bool = False) -> DataFrame:
    return comparison_of(distribution(df, by, digit), by, exact)


def deviation_matrix(df: DataFrame, by: Sequence[str] = (), digit: str = "first_digit", exact: bool = False,
                     clamp: float | None = None) -> DataFrame:
    return deviations_of(distribution(df, by, digit), by, exact, clamp)


def chi_square_test(df: DataFrame, by: Sequence[str] = (), digit: str = "first_digit",
                    exact: bool = False) -> DataFrame:
    return chi_square_of(distribution(df, by, digit), by, exact)


def mean_absolute_deviation(df: DataFrame, by: Sequence[str] = (), digit: str = "first_digit",
                            exact: bool = False) -> DataFrame:
    return mad_of(distribution(df, by, digit), by, exact)


def kolmogorov_smirnov_test(df: DataFrame, by: Sequence[str] = (), digit: str = "first_digit",
                            exact: bool = False) -> DataFrame:
    return ks_of(distribution(df, by, digit), by, exact)


def summary(df: DataFrame, by: Sequence[str] = (), digit: str = "first_digit", exact: bool = False) -> DataFrame:
    """The summary table of each group, ordered by group."""
    return summary_of(distribution(df, by, digit), by, exact).orderBy(*by)


def summary_sets(df: DataFrame, sets: Sequence[Sequence[str]], digit: str = "first_digit",
                 exact: bool = False) -> DataFrame:
    """Summaries of several groupings from one scan.

    Counts are taken once at the finest level; only those few rows are then multiplied for the
    grouping sets. ``grouping_level`` tells a total from a null key.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    fine = _counts(df, keys, digit)
    wanted = [[F.col(k) for k in s] + [F.col(digit)] for s in sets]
    level = F.floor(F.grouping_id() / 2).cast("bigint").alias("grouping_level")      # the digit is always grouped
    counts = (fine.groupingSets(wanted, *[F.col(k) for k in keys], F.col(digit))
              .agg(F.sum("count").alias("count"), level))
    by = [*keys, "grouping_level"]
    return summary_of(distribution(counts, by, digit, counts=counts), by, exact)


def category_conformity(df: DataFrame, categories: DataFrame, category: str = "number_category",
                        digit: str = "first_digit", exact: bool = False) -> DataFrame:
    """Measured deviation of each category against its declared band; null where none is declared.

    ``categories`` has at most one row per category.
    """
    measured = distribution(df, [category], digit).select(
        F.col(category).alias("number_category"), "n", mad_stat(expected_frequencies(exact)).alias("mad")
    )
    low, high = F.col("mad_from"), F.col("mad_to")
    inside = (F.when(F.col("expected_mad").startswith("<"), F.col("mad") < high)
              .when(F.col("expected_mad").startswith(">"), F.col("mad") > low)
              .when(low.isNotNull(), F.col("mad").between(low, high)))
    return (measured.join(categories, "number_category", "left")
            .select("number_category", "category_group", "n", "mad", "expected_mad", inside.alias("as_declared")))


def distinct_groups(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Number of distinct groups, exact or estimated."""
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(counter(F.col(column)).alias("groups"))


def corpus_totals(df: DataFrame, article: str = "article_id") -> DataFrame:
    """Articles with at least one number, numbers, and numbers per article."""
    return (df.agg(F.count_distinct(F.col(article)).alias("articles"), F.count(F.lit(1)).alias("numbers"))
            .withColumn("avg_numbers",
                        F.when(F.col("articles") > 0, F.col("numbers") / F.col("articles"))))

"""First and second significant digits of a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Half a unit of the fifteenth significant digit, on the scale 10 <= m < 100, and the room that the
# errors of logarithm and power need beside a rounding border.
_HALF_DIGIT, _UNSURE = 5e-14, 3e-14


def _lookup(x: Column, table: list[int], part: int) -> Column:
    """Entry of ``table`` for the first two digits of x after rounding to 15 digits; 0 for x <= 0, NaN, infinity.

    The number is scaled by a power of ten into 10..99. Adding half of the fifteenth digit before
    flooring undoes the scaling error and is the rounding that a 15-digit rendering does. The rendering
    itself costs several times as much; it serves only where the scaled value is so near a rounding
    border that its error may decide, where the logarithm was rounded over a power of ten, and at the far ends
    of the double range, where powers of ten over- or underflow.
    """
    x = x.cast("double")
    scaled = x * F.pow(F.lit(10.0), 1 - F.floor(F.log10(x)))
    raised = scaled + _HALF_DIGIT
    beyond = raised - F.floor(raised)
    sure = (scaled >= 10) & (scaled < 100) & (beyond > _UNSURE) & (beyond < 1 - _UNSURE)
    text = F.substring(F.format_string("%.14e", x), part, 1)
    return (F.when((x >= 1e-290) & (x <= 1e290) & sure, F.get(F.lit(table), F.floor(raised).cast("int")))
            .when((x > 0) & (x < float("inf")), text.try_cast("int"))
            .otherwise(F.lit(0)))


def first_digit(x: Column) -> Column:
    """First significant digit 1..9; 0 when there is none."""
    return _lookup(x, [two // 10 for two in range(100)] + [1], 1)


def second_digit(x: Column) -> Column:
    """Second significant digit 0..9; 0 when there is none."""
    return _lookup(x, [two % 10 for two in range(100)] + [0], 3)


def analyze_number(x: Column) -> Column:
    """Struct of first and second digit."""
    return F.struct(first_digit(x).alias("first_digit"), second_digit(x).alias("second_digit"))


def with_digits(df: DataFrame, column: str, first: str = "first_digit", second: str = "second_digit") -> DataFrame:
    """Add the digit columns; unused ones are pruned by the optimizer."""
    return df.withColumns({first: first_digit(F.col(column)), second: second_digit(F.col(column))})

"""Exact-size samples of an index: the first entries, or a seeded random choice.

Both keep the ``n`` smallest rows of an order. The last row that is kept is found by counting, sixteen
bits of a key at a time, so nothing sorts the index or collects the sample; the rows are then taken by a plain
filter, and the result does not depend on how the data are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from digitscope.sources.index import read_index

# Hexadecimal digits of the hash that are used.
_HASH_DIGITS = 13
# Bits of a key that are counted in one job, and bytes of a text that make one key.
_BITS, _BYTES = 16, 7
# Copies of one row produced per task step when identical rows are multiplied again.
_COPIES = 10_000


def check_size(rate: float | None, count: int | None) -> None:
    """Exactly one of ``rate`` and ``count`` must be given, and it must make sense."""
    if (rate is None) == (count is None):
        raise ValueError("give exactly one of rate and count")
    if rate is not None and not 0 < rate <= 1:
        raise ValueError(f"rate must be in (0, 1], got {rate}")
    if count is not None and count < 0:
        raise ValueError(f"count must not be negative, got {count}")


def sampling_hash(key: Column, seed: int) -> Column:
    """Repeatable pseudo-random number in 0 .. 2^52 - 1."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, _HASH_DIGITS), 16, 10).cast("bigint")


def _keys(df: DataFrame, column: str) -> Iterator[Column]:
    """Whole numbers that order the rows as the column does, the most significant first; nulls come last."""
    kind, value = df.schema[column].dataType, F.col(column)
    yield F.when(value.isNull(), 1).otherwise(0).cast("bigint")
    if isinstance(kind, T.IntegralType):
        yield F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))
    elif isinstance(kind, T.StringType):
        raw = F.coalesce(value, F.lit("")).cast("binary")
        longest = df.agg(F.coalesce(F.max(F.octet_length(value)), F.lit(0))).first()[0]
        for at in range(0, max(1, longest), _BYTES):
            part = F.rpad(F.hex(F.substring(raw, at + 1, _BYTES)), 2 * _BYTES, "0")
            yield F.conv(part, 16, 10).cast("bigint")
        yield F.octet_length(F.coalesce(value, F.lit(""))).cast("bigint")  # bytes of zero at the end
    elif isinstance(kind, T.TimestampType):
        yield F.coalesce(F.unix_micros(value), F.lit(0))
    elif isinstance(kind, T.DateType):
        yield F.coalesce(F.unix_date(value), F.lit(0)).cast("bigint")
    else:
        raise TypeError(f"rows cannot be ordered by {column} of type {kind.simpleString()}")


def _nth(rows: DataFrame, key: Column, rank: int) -> tuple[int, int, int]:
    """The key at a 0-based rank, and the numbers of rows below and equal to it.

    One job finds the range of the key; each further one counts at most 2^16 values of its next sixteen bits.
    """
    low, high, equal = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    bits, below = (high - low).bit_length(), 0
    if bits > 62:
        low, bits = 0, 64                                # as it is: the sign is in the first bits
    prefix = 0
    for shift in range((bits - 1) // _BITS * _BITS, -1, -_BITS):
        part = F.shiftright(key - F.lit(low).cast("bigint"), shift)
        ordered = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = (rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
                 .withColumn("upto", F.sum("n").over(ordered)).where(F.col("upto") > rank - below).orderBy("part").first())
        prefix, equal = found["part"], found["n"]
        below += found["upto"] - equal
        rows = rows.where(part == prefix)
    return prefix + low, below, equal


def keep_smallest(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Exactly ``n`` rows, the first by the ``order`` columns (numbers, texts, dates or timestamps).

    Nulls come last. Rows that tie in all of them are taken by a hash of the whole row, and copies of one
    row as often as needed. The same rules hold for any number of rows.
    """
    if n <= 0:
        return df.limit(0)
    if df.select(F.lit(1)).limit(n).count() < n:
        raise ValueError(f"count {n} exceeds the number of entries")
    columns = df.columns

    def every() -> Iterator[Column]:
        for column in order:
            yield from _keys(tied, column)
        yield F.xxhash64(*columns)

    tied, left, below = df, n, F.lit(False)
    for key in every():
        last, fewer, equal = _nth(tied, key, left - 1)
        here = F.lit(True) if tied is df else same
        below = below | (here & (key < last))
        same = here & (key == last)
        tied, left = tied.where(key == last), left - fewer
        if equal == left:
            return df.where(below | same)
    return df.where(below).unionByName(_copies(df.where(same), left))


def _copies(rows: DataFrame, n: int) -> DataFrame:
    """``n`` copies of the one row that ``rows`` repeats."""
    steps = F.sequence(F.lit(0).cast("bigint"), F.lit((n - 1) // _COPIES).cast("bigint"))
    copies = F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(_COPIES).cast("bigint"), F.lit(n) - F.col("_step") * _COPIES))
    return (rows.limit(1).withColumn("_step", F.explode(steps)).repartition("_step")
            .withColumn("_copy", F.explode(copies)).select(*rows.columns))


def sample(entries: DataFrame, rate: float | None = None, count: int | None = None, seed: int = 42,
           consecutive: bool = False, key: str = "article_id", offset: str = "offset") -> DataFrame:
    """Exact-size sample of index entries, ordered by offset.

    ``consecutive`` takes the first entries in index order instead of a random choice.
    """
    check_size(rate, count)
    n = count if count is not None else int(entries.count() * rate)
    if consecutive:
        kept = keep_smallest(entries, n, [offset, key])
    else:
        hashed = entries.withColumn("_hash", sampling_hash(F.col(key), seed))
        kept = keep_smallest(hashed, n, ["_hash", key]).drop("_hash")
    return kept.orderBy(offset, key)


def create_sample(spark: SparkSession, path: str, rate: float | None = None, count: int | None = None,
                  seed: int = 42, consecutive: bool = False) -> DataFrame:
    """Sample of an index file."""
    return sample(read_index(spark, path), rate, count, seed, consecutive)

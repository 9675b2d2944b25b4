"""Parquet tables and the fixed dimensions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from digitscope.rules.categories import BAND_BOUNDS, CATEGORIES, GROUP_DESCRIPTIONS, GROUPS
from digitscope.rules.units import unit_rows
from digitscope.schemas import CATEGORY, NUMBERS, REJECTED, UNIT


def read_table(spark: SparkSession, path: str, *columns: str, heavy: bool = False) -> DataFrame:
    """A Parquet table, optionally narrowed to some columns.

    ``heavy`` announces costly work per row. If the files give fewer input splits than there are
    cores, the rows are dealt out once; data with enough splits are never shuffled for this.
    """
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    if heavy and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """The numbers table with its declared schema, also where the domain is a partition folder."""
    return spark.read.schema(NUMBERS).parquet(path).select(*NUMBERS.names)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """All readable part files of a numbers table; unreadable ones are skipped, and ``audit_parts`` tells which."""
    return spark.read.schema(NUMBERS).option("ignoreCorruptFiles", True).parquet(path).select(*NUMBERS.names)


def audit_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The readable rows of a numbers table and, for each part file that gave fewer than it should, what it lacks.

    The second table has ``file``, ``bytes``, ``reason``, ``rows`` (as its footer says, null without a footer) and ``rows_read``. Reasons:
    ``too_short`` (no room for a footer), ``no_magic`` (head or tail is not Parquet's), ``bad_footer`` (it claims to be longer than the
    file), ``unreadable`` (larger than ``binaryFile`` can show), ``no_rows`` (a sound frame in which no row is found: an empty part, or a
    damaged footer) and ``rows_lost`` (reading broke off in the middle). The files are listed as a table, the claims need footers only, and
    the content is looked at only for files without any row. Files that start with ``_`` or ``.`` are no parts, and Spark does not list
    files of zero bytes. Building the table runs one job, on the footers. A bare ``count()`` of the rows takes the footers' word as well;
    whatever reads a column gets the rows that can be read.
    """
    def parts() -> DataFrame:
        return spark.read.schema(NUMBERS).option("ignoreCorruptFiles", True).parquet(path)

    file = F.col("_metadata.file_path").alias("file")
    claimed = parts().select(file).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    # Rows are counted by a bit of their hash, so that the reader has to decode every column.
    odd = F.xxhash64(*NUMBERS.names).bitwiseAND(F.lit(1)) == 1
    read = parts().select(file, odd.alias("odd")).groupBy("file").agg((F.count_if("odd") + F.count_if(~F.col("odd"))).alias("rows_read"))
    found = claimed.join(read, "file", "left").withColumn("rows_read", F.coalesce("rows_read", F.lit(0).cast("bigint")))
    binary = spark.read.format("binaryFile")
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    listed = binary.option("recursiveFileLookup", True).load(path).select(file, "path", F.col("length").alias("bytes"))
    lost = found.where("rows_read < rows").join(listed, "file").select("file", "bytes", F.lit("rows_lost").alias("reason"), "rows", "rows_read")

    absent = listed.join(claimed, "file", "left_anti")
    # Their names are a part of the listing that the driver holds anyway.
    framed = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r.path) for r in absent.where(F.col("bytes").between(12, limit)).toLocalIterator()]
    looked_at = binary.load(framed) if framed else binary.load(path).limit(0)
    tail = F.col("content").substr(F.length("content") - 7, F.lit(8))
    size = F.conv(F.concat(*[F.substring(F.hex(tail), i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    magic = F.lit("PAR1").cast("binary")
    frame = (F.when(F.substring("content", 1, 4) != magic, F.lit("no_magic")).when(F.substring(tail, 5, 4) != magic, F.lit("no_magic"))
             .when(size > F.col("length") - 12, F.lit("bad_footer")).otherwise(F.lit("no_rows")))
    looked = looked_at.select(file, frame.alias("frame"))
    reason = F.when(F.col("bytes") < 12, F.lit("too_short")).when(F.col("bytes") > limit, F.lit("unreadable")).otherwise(F.col("frame"))
    skipped = absent.join(looked, "file", "left").select("file", "bytes", reason.alias("reason"), F.lit(None).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("rows_read"))
    return read_parts(spark, path), lost.unionByName(skipped)


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Numbers (with ``unit_id``) and rejected rows of a folder that ``write_split`` wrote; only the partitions asked for are read."""
    kinds = T.StructType([*NUMBERS, *REJECTED, T.StructField("kind", T.StringType())])
    rows = spark.read.schema(kinds).parquet(path)
    return (rows.where("kind = 'numbers'").select(*NUMBERS.names, "unit_id"), rows.where("kind = 'rejected'").select(*REJECTED.names))


def category_dimension(spark: SparkSession) -> DataFrame:
    """The 59 number categories with group, declared band and its bounds, description, examples and notes."""
    groups = dict(GROUPS)
    rows = [
        (name, group, band, examples[0], *BAND_BOUNDS[band], groups[group], description, list(examples), notes, GROUP_DESCRIPTIONS[group])
        for name, group, band, description, examples, notes in CATEGORIES
    ]
    return spark.createDataFrame(rows, CATEGORY)


def unit_dimension(spark: SparkSession, units_only: bool = False) -> DataFrame:
    """``(unit, measure)`` rows of the vocabularies."""
    return spark.createDataFrame(unit_rows(units_only), UNIT)


def units_with_measures(spark: SparkSession) -> DataFrame:
    """One row per unit with the sorted array of its measures."""
    measures: dict[str, set[str]] = {}
    for unit, measure in unit_rows(units_only=True):
        measures.setdefault(unit, set()).add(measure)
    return spark.createDataFrame([(u, sorted(m)) for u, m in measures.items()], "unit string, measures array<string>")


def all_units(spark: SparkSession) -> DataFrame:
    """The union of all unit vocabularies, without magnitude and context words."""
    return unit_dimension(spark, units_only=True).select("unit").distinct()

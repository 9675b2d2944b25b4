"""Index of a page dump: lines ``offset:article_id:title``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from digitscope.schemas import INDEX


def parse_index(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of index lines; later colons belong to the title, malformed lines are left out.

    The split line is exploded so that each filter below uses it instead of splitting again.
    """
    part = F.split(F.trim(F.col(column)), ":", 3)
    return (lines.select(F.explode(F.array(part)).alias("p")).where(F.size("p") == 3)
            .select(F.trim(F.get("p", F.lit(0))).try_cast("bigint").alias("offset"),
                    F.trim(F.get("p", F.lit(1))).try_cast("bigint").alias("article_id"),
                    F.get("p", F.lit(2)).alias("title"))
            .where("offset is not null and article_id is not null")
            .to(INDEX))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an index file or folder, plain or compressed."""
    return parse_index(spark.read.text(path))

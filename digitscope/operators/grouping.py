"""Index entries collected by offset, and unions of part tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Ids that one part of an offset spans.
PART_IDS = 100_000


def group_by_offset(entries: DataFrame, part_ids: int = PART_IDS) -> DataFrame:
    """``(offset, part, articles)``: the entries of an offset as ``array<struct<article_id, title, copies>>``.

    ``part`` is the range of ``part_ids`` ids that an entry falls into, null for a null id, so an array is bounded
    by the width of the range whatever the data; copies of an entry are counted. The rows do not depend
    on the number of entries.
    """
    part = F.expr(f"(article_id - pmod(article_id, {part_ids}L)) div {part_ids}L").alias("part")
    return (entries.groupBy("offset", part, "article_id", "title").agg(F.count(F.lit(1)).alias("copies"))
            .groupBy("offset", "part")
            .agg(F.sort_array(F.collect_list(F.struct("article_id", "title", "copies"))).alias("articles"))
            .orderBy("offset", "part"))


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """All rows of the part tables, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), parts)

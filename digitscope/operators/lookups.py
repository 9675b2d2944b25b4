"""Joins with id lists, ledgers and the fixed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from digitscope.functions.lets import escape
from digitscope.rules.units import SIGNS

# Largest vocabulary of units that is sent to every executor.
BROADCAST_BYTES = 8 << 20


def keep_ids(df: DataFrame, ids: DataFrame | None, key: str = "article_id") -> DataFrame:
    """Rows whose key is listed; no list or an empty one keeps everything.

    Meant to run before extraction. One job looks whether the list is empty; by its size Spark then
    broadcasts it or joins by shuffling.
    """
    if ids is None or ids.isEmpty():
        return df
    return df.join(ids.select(key).distinct(), key, "left_semi")


def pending(planned: DataFrame, ledger: DataFrame, key: str = "unit_id") -> DataFrame:
    """Planned keys without a completed entry; failed ones stay pending."""
    done = ledger.where(F.col("status") == "completed").select(key).distinct()
    return planned.join(done, key, "left_anti")


def with_category_info(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Add group and declared band of ``number_category``."""
    return df.join(categories, "number_category", "left")


def leading_words(after: Column) -> Column:
    """The words right after a number, single blanks between them, up to the first other mark: ``"square mile per"``."""
    run = F.regexp_extract(after, r"^[\s\x{a0}]?([^\s\x{a0},;:!?()\[\]][^\t\n\x{b}\f\r\x{a0},;:!?()\[\]]*)", 1)
    return F.rtrim(F.substring_index(run, "  ", 1))


def _first_word(words: Column) -> Column:
    """The key of a phrase: its first word without closing dots, as a unit ends a sentence too."""
    return F.regexp_replace(F.substring_index(words, " ", 1), r"\.+$", "")


def unit_trie(units: DataFrame) -> DataFrame:
    """The vocabulary by first word: ``key`` and ``phrases``, those that begin with it, most words first.

    Rows of equal units are merged. Units without text or with a closing dot cannot be met and are left out.
    """
    rows = units.where("unit != '' AND NOT endswith(unit, '.')").select(_first_word(F.col("unit")).alias("key"), "unit", "measures")
    known = rows.repartition("key").groupBy("key", "unit").agg(_merged_measures())
    phrase = F.struct(F.size(F.split("unit", " ")).alias("words"), "unit", "measures")
    return known.groupBy("key").agg(F.sort_array(F.collect_list(phrase), asc=False).alias("phrases"))


def _merged_measures() -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list("measures")))).alias("measures")


def _is_small(units: DataFrame) -> bool:
    """Whether a vocabulary fits a broadcast, by its rows' bytes: one small job."""
    row = 64 + F.coalesce(F.octet_length("unit"), F.lit(0)) + F.coalesce(F.octet_length(F.array_join("measures", "")), F.lit(0))
    return (units.agg(F.sum(row.cast("bigint")).alias("bytes")).first().bytes or 0) <= BROADCAST_BYTES


def unit_sign(before: Column) -> Column:
    """The currency sign that stands right before a number, if any."""
    signs = "|".join(map(escape, SIGNS))
    return F.nullif(F.regexp_extract(before, rf"({signs})[\s\x{{a0}}]?$", 1), F.lit(""))


def tag_units(df: DataFrame, after: str, units: DataFrame, before: str | None = None) -> DataFrame:
    """Add ``unit`` and ``measures`` of the longest known unit that follows a number, else of a sign before it.

    ``units`` has an array of ``measures`` per unit. One join by the first word brings the phrases that begin with it, and the
    first one that the text goes on with is taken, so units may have any number of words and the vocabulary any size: nothing is
    collected. A vocabulary of up to ``BROADCAST_BYTES`` is broadcast, which one small job finds; a larger one is joined as Spark sees
    fit, and adaptive execution splits a frequent word. A row costs as much as phrases share its first word. ``before`` names the column with the text in front of the number; the few signs come by a scalar
    subquery. Spelling and case must match; null texts, and those no unit follows, give nulls.
    """
    run = leading_words(F.col(after))
    sign = unit_sign(F.col(before)) if before is not None else F.lit(None).cast("string")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.nullif(run, F.lit("")).alias("run"), sign.alias("sign"))
    trie = F.broadcast(unit_trie(units)) if _is_small(units) else unit_trie(units)
    rows = rows.join(trie, _first_word(F.col("run")) == F.col("key"), "left")

    def follows(phrase: Column) -> Column:
        rest = F.substring(F.col("run"), F.length(phrase["unit"]) + 1, F.length("run"))
        return F.startswith(F.col("run"), phrase["unit"]) & rest.rlike(r"^\.*( |$)")

    found = F.get(F.filter("phrases", follows), F.lit(0))
    found = F.when(found.isNotNull(), F.struct(found["unit"].alias("unit"), found["measures"].alias("measures")))
    if before is not None:
        known = units.where(F.col("unit").isin(*SIGNS)).groupBy("unit").agg(_merged_measures())
        signs = known.agg(F.map_from_entries(F.collect_list(F.struct("unit", "measures"))).alias("signs")).scalar()
        of_sign = F.try_element_at(signs, F.col("sign"))
        found = F.coalesce(found, F.when(of_sign.isNotNull(), F.struct(F.col("sign").alias("unit"), of_sign.alias("measures"))))
    return rows.select("row", found.alias("found")).select("row.*", "found.unit", "found.measures")

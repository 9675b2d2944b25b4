"""Pages of an XML dump, the filters that admit an article, and the reasons why others are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from digitscope.operators.lookups import keep_ids
from digitscope.schemas import PAGE, PAGE_OR_BROKEN

_OPEN, _CLOSE = "<page>", "</page>"


def raw_id(record: Column) -> Column:
    """The page's id, read from its raw text without parsing: the ``id`` outside of ``revision``; null where there is none."""
    page = F.substring_index(record, _OPEN, -1)
    after = F.when(F.contains(page, F.lit("</revision>")), F.substring_index(page, "</revision>", -1)).otherwise("")
    own = F.when(F.contains(page, F.lit("<revision")), F.concat(F.substring_index(page, "<revision", 1), after)).otherwise(page)
    return F.regexp_extract(own, r"<id>\s*([+-]?[0-9]+)\s*</id>", 1).try_cast("bigint")


def _xml(record: Column) -> Column:
    return F.concat(F.lit(_OPEN), F.substring_index(record, _OPEN, -1), F.lit(_CLOSE))


def _is_page(record: Column) -> Column:
    return F.contains(record, F.lit(_OPEN))


def parse_pages(records: DataFrame, column: str = "value", main_only: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """Page fields from text records that end where ``</page>`` was; bad XML gives null fields.

    ``main_only`` leaves out other namespaces by a search in the raw record, and ``ids`` (of ``article_id``) all pages that are not
    listed by a semi join on the id in the raw record, before anything is parsed. The parsed page is exploded, not just selected: filters
    on its fields then stay above the parser, which would otherwise run again in every filter that is pushed below it.
    """
    raw = F.col(column)
    records = records.where(_is_page(raw))
    if main_only:
        records = records.where(raw.rlike(r"<ns>\s*0\s*</ns>"))
    records = keep_ids(records.select(raw.alias("raw"), raw_id(raw).alias("article_id")), ids)
    page = F.from_xml(_xml(F.col("raw")), PAGE, {"rowTag": "page", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"})
    return records.select(F.inline(F.array(page)))


def judge_pages(records: DataFrame, column: str = "value", ids: DataFrame | None = None) -> DataFrame:
    """Every page of the records with the reason why it is no article: ``article_id, title, text, reason, digest``.

    ``reason`` is null for articles, else the first that applies of ``other_namespace``, ``bad_xml``, ``no_namespace``, ``no_id``, ``bad_id`` (not a whole
    number of 64 bits) and ``no_text``. Rejected pages keep an id that can be read from the raw record. ``digest`` is the SHA-256 of the page as it stands in the dump. Pages of a whole-number namespace other
    than 0 are not parsed. With ``ids`` other pages with an id are left out unparsed; those without one are judged all the same.
    """
    raw = F.col(column)
    records = records.where(_is_page(raw)).select(raw.alias("raw"), raw_id(raw).alias("article_id"))
    if ids is not None and not ids.isEmpty():
        listed = ids.select(F.col("article_id").alias("listed")).distinct()
        records = records.join(listed, F.col("article_id") == F.col("listed"), "left").where("listed IS NOT NULL OR article_id IS NULL").drop("listed")
    xml = _xml(F.col("raw"))
    other = F.col("raw").rlike(r"<ns>\s*[+-]?[0-9]+\s*</ns>") & ~F.col("raw").rlike(r"<ns>\s*0\s*</ns>")
    options = {"rowTag": "page", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "broken"}
    page = F.when(~other, F.from_xml(xml, PAGE_OR_BROKEN, options))
    parsed = F.struct(page.alias("page"), other.alias("other"), F.sha2(xml.cast("binary"), 256).alias("digest"), F.col("article_id").alias("raw_id"))
    rows = records.select(F.inline(F.array(parsed)))
    ns, own, text = F.col("page.ns"), F.col("page.id"), F.col("page.revision.text._VALUE")
    article_id = own.try_cast("bigint")
    reason = (F.when(F.col("other"), F.lit("other_namespace")).when(F.col("page").isNull() | F.col("page.broken").isNotNull(), F.lit("bad_xml"))
              .when(ns.isNull(), F.lit("no_namespace")).when(F.trim(ns) != "0", F.lit("other_namespace"))
              .when(own.isNull(), F.lit("no_id")).when(article_id.isNull(), F.lit("bad_id")).when(text.isNull(), F.lit("no_text")))
    return rows.select(F.coalesce(article_id, "raw_id").alias("article_id"), F.col("page.title").alias("title"), text.alias("text"), reason.alias("reason"), "digest")


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", _CLOSE).text(path)


def read_pages(spark: SparkSession, path: str, main_only: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """Pages of a dump as a splittable text scan, all or those of the listed ``ids``.

    The closing tag is the record separator, so plain and bzip2 files are divided among tasks and
    every compressed stream of a file is read, which the XML source does in a single task.
    """
    return parse_pages(_records(spark, path), main_only=main_only, ids=ids)


def read_judged(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Articles and rejected pages of a dump, as ``judge_pages`` gives them, by the same splittable scan."""
    return judge_pages(_records(spark, path), ids=ids)


def articles(pages: DataFrame) -> DataFrame:
    """Main-namespace pages with a valid id and text, as ``(article_id, title, text)``."""
    return (pages.where(F.trim("ns") == "0")
            .select(F.col("id").try_cast("bigint").alias("article_id"), "title",
                    F.col("revision.text._VALUE").alias("text"))
            .where("article_id is not null and text is not null"))

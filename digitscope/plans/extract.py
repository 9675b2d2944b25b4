"""From texts to the numbers table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from digitscope.functions.digits import with_digits
from digitscope.functions.labels import number_category
from digitscope.functions.markup import domain_of_text, strip_markup
from digitscope.functions.text import WINDOW, extract_contexts, extract_numbers, has_number
from digitscope.operators.lookups import keep_ids
from digitscope.operators.sampling import create_sample
from digitscope.rules.domains import DEFAULT_DOMAIN
from digitscope.rules.number_rules import GENERIC_LABEL
from digitscope.schemas import NUMBERS
from digitscope.sources.pages import articles, read_judged, read_pages
from digitscope.sources.sinks import write_numbers


def extract(df: DataFrame, text_col: str, id_col: str, domain_col: str | None = None, window: int = WINDOW,
            categorize: bool = True, markup: str | None = None, carry: Sequence[str] = (),
            category: Callable[[Column, Column], Column] = number_category, reason: str | None = None,
            live: Observation | str | None = None) -> DataFrame:
    """Numbers table of a text table, one row per number with digits, category and domain.

    A map-only plan without a shuffle: texts without a digit are dropped by a cheap filter, markup is
    stripped, all numbers of a text are found in one array, and the array is exploded into rows
    that are then labelled. Unused columns, such as the category, are pruned together with their work. ``domain_col`` names a column with the domain; with ``markup="wikitext"`` and no such
    column the domain comes from the infobox. ``carry`` lists further columns to keep beside the numbers,
    ``category`` labels a token in its context (``declared_category`` is the larger rule set).
    Whole-number ids become bigint, ids of other types stay as they are. ``reason`` names one of the carried columns: rows in which it is not
    null are rejected ones and pass with null numbers, so that one scan gives both. ``live`` observes the scan: an
    ``Observation`` (batch) or a name (streams) under which ``articles`` with numbers, ``numbers`` and ``rejected`` rows are counted while
    the result is written, without another pass. Such totals count a row again where Spark computes it again, after a lost executor for
    example, and repeated ids one by one; ``corpus_totals`` of the written table is the exact count.
    """
    whole = isinstance(df.schema[id_col].dataType, T.IntegralType)
    rejected = F.col(reason).isNotNull() if reason else F.lit(False)
    rows = df.where(has_number(F.col(text_col)) | rejected if reason else has_number(F.col(text_col)))
    if domain_col is not None:
        domain = F.col(domain_col)
    elif markup == "wikitext":
        domain = domain_of_text(F.col(text_col))
    else:
        domain = F.lit(DEFAULT_DOMAIN)
    text = strip_markup(F.col(text_col), markup) if markup else F.col(text_col)
    rows = rows.select((F.col(id_col).cast("bigint") if whole else F.col(id_col)).alias("article_id"), domain.alias("domain"),
                       *carry, text.alias("_text"))
    def or_rejected(found: Column) -> Column:
        """The numbers found, or one null for a rejected row."""
        return F.when(rejected, F.array(F.lit(None))).otherwise(found) if reason else found

    arrays = extract_contexts(F.col("_text"), window) if categorize else extract_numbers(F.col("_text"))
    if live is not None:
        rows = rows.select("article_id", "domain", *carry, arrays.alias("_found"))
        arrays, n = F.col("_found"), F.when(rejected, 0).otherwise(F.size("_found"))
        rows = rows.observe(live, F.count_if(n > 0).alias("articles"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("numbers"), F.count_if(rejected).alias("rejected"))
    if categorize:
        found = rows.select("article_id", "domain", *carry, F.inline(or_rejected(arrays)))
        label = category(F.col("token"), F.col("context"))
    else:
        found = rows.select("article_id", "domain", *carry, F.explode(or_rejected(arrays)).alias("number"))
        label = F.lit(GENERIC_LABEL)
    found = with_digits(found.withColumn("number_category", label), "number")
    return found.where((F.col("first_digit") > 0) | rejected if reason else F.col("first_digit") > 0).select(*NUMBERS.names, *carry)


def extract_articles(pages: DataFrame, ids: DataFrame | None = None, **options) -> DataFrame:
    """Numbers table of dump pages, all or those of the listed ids; ``read_pages(ids=...)`` selects before it parses."""
    admitted = keep_ids(articles(pages), ids)
    return extract(admitted, "text", "article_id", markup="wikitext", **options)


def build_numbers(spark: SparkSession, dump: str, sink: str, index: str | None = None, rate: float | None = None,
                  count: int | None = None, seed: int = 42, consecutive: bool = False) -> dict[str, int]:
    """Read a dump, optionally only a sample of its index, and write the numbers table; returns the totals observed meanwhile.

    Pages are judged in the same scan, so rejected ones are counted too, though nothing of them is kept.
    """
    ids = None
    if rate is not None or count is not None:
        if index is None:
            raise ValueError("sampling needs an index")
        ids = create_sample(spark, index, rate, count, seed, consecutive).select("article_id")
    live = Observation("totals")
    found = extract(read_judged(spark, dump, ids), "text", "article_id", markup="wikitext", carry=["reason"], reason="reason", live=live)
    write_numbers(found.where("reason IS NULL").drop("reason"), sink)
    return live.get


def backfill_numbers(spark: SparkSession, dump: str, sink: str, ledger: str, index: str | None = None, rate: float | None = None,
                     count: int | None = None, seed: int = 42, consecutive: bool = False, unit_ids: int = 100_000, rejected: bool = False) -> DataFrame:
    """Like ``build_numbers``, but continue where an earlier run stopped: a unit is a range of ``unit_ids`` article ids.

    With ``rejected`` pages that are no articles are kept too, with reason and digest, in the same scan; those without a valid id are the unit
    ``no id``. The sink is then one of ``write_split``.
    """
    from digitscope.streaming.ingest import backfill

    ids = create_sample(spark, index, rate, count, seed, consecutive).select("article_id") if rate is not None or count is not None else None
    unit = F.expr(f"article_id div {unit_ids}").cast("string")
    if rejected:
        texts = read_judged(spark, dump, ids).withColumn("unit", F.coalesce(unit, F.lit("no id")))
    else:
        texts = articles(read_pages(spark, dump, main_only=True, ids=ids)).withColumn("unit", unit)
    return backfill(texts, "unit", "text", "article_id", sink, ledger, markup="wikitext")

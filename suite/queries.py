"""One query per operator, over the whole given tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

import digitscope as ds
from digitscope.functions.labels import domain_of_type, first_match_label, year_or_generic
from digitscope.operators import distribution as d
from digitscope.operators.grouping import group_by_offset, union_parts
from digitscope.operators.lookups import keep_ids, pending, tag_units, with_category_info
from digitscope.operators.ranks import value_stats
from digitscope.operators.sampling import keep_smallest, sample
from digitscope.plans.preview import preview_articles, preview_digits, preview_totals
from digitscope.schemas import NUMBERS
from digitscope.sources.index import parse_index
from digitscope.sources.pages import articles, judge_pages, parse_pages, read_pages
from digitscope.sources.sinks import write_counts_json, write_numbers, write_split
from digitscope.sources.tables import all_units, audit_parts, category_dimension, read_numbers, read_split, read_table, units_with_measures
from digitscope.streaming.ingest import backfill, failed, ledger_totals, read_ledger, rejected_totals
from suite.inputs import DIGIT_HEADS, KINDS, SENTENCES, UNIT_PHRASES, WIKITEXT


def _round(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


# -- inputs ---------------------------------------------------------------------------------

def _documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf}/documents.parquet", *columns, heavy=True)


def _document_numbers(spark: SparkSession, sf: str, categorize: bool = True) -> DataFrame:
    docs = _documents(spark, sf, "doc_id", "lang", "source", "text")
    return ds.extract(docs, "text", "doc_id", "lang", categorize=categorize, carry=["source"])


def _lineitem(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf}/lineitem.parquet", *columns)


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lineitem(spark, sf, "l_returnflag", "l_linestatus", "l_extendedprice")
    return ds.with_digits(rows, "l_extendedprice")


def _measurements(spark: SparkSession, sf: str) -> DataFrame:
    """A sentence around each quantity of ``lineitem``."""
    rows = read_table(spark, f"{sf}/lineitem.parquet", "l_orderkey", "l_linenumber", "l_quantity",
                      "l_extendedprice", heavy=True)
    number = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("int").cast("string")).otherwise(
        F.floor("l_extendedprice").cast("string"))
    sentence = _pick(SENTENCES, (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(SENTENCES))
    return (rows.withColumn("number_text", number).withColumn("sentence", sentence)
            .withColumn("context", F.replace("sentence", F.lit("{}"), F.col("number_text")))
            .withColumn("after", F.substring_index("sentence", "{}", -1)))


def _wikitext(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "doc_id", "lang", "source", "n_chars", "text")
    parts = {"KIND": _pick(KINDS, F.col("doc_id") % len(KINDS)), "ID": F.col("doc_id").cast("string"),
             "SIZE": F.col("n_chars").cast("string"), "LANG": F.col("lang"), "SOURCE": F.col("source"),
             "TEXT": F.col("text")}
    return docs.select("doc_id", F.concat(*[parts.get(p, F.lit(p)) for p in WIKITEXT]).alias("wikitext"))


def _index_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, f"{sf}/documents.parquet", "doc_id", "lang", "source")
    doc = F.col("doc_id")
    good = F.concat(F.floor(doc / 100) * 5000 + 616, F.lit(":"), doc, F.lit(":"), F.col("source"), F.lit(":"),
                    F.col("lang"))
    line = (F.when(doc % 17 == 3, F.concat(F.lit("bad line "), doc))
            .when(doc % 19 == 5, F.concat(F.lit("x:"), doc, F.lit(":y"))).otherwise(good))
    return docs.select(F.concat(F.lit(" "), line).alias("value"))


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return parse_index(_index_lines(spark, sf))


# -- scans and filters -------------------------------------------------------------------------

def has_numbers(spark, sf):
    return _documents(spark, sf, "doc_id", "text").select("doc_id", ds.has_number(F.col("text")).alias("has_number"))


def index_parse(spark, sf):
    return _index(spark, sf)


def _run_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share; local sessions without one get their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="digitscope-suite-")
    return f"{base}/{uuid.uuid4().hex}"


def _xml_records(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as XML that lacks its closing tag, as the splittable scan delivers them."""
    pages = read_table(spark, f"{sf}/pages.parquet", heavy=True)

    def escaped(c: str) -> Column:
        out = F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
        return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    page = F.col("page_id")
    article = F.when(page % 5 == 4, F.concat(F.lit("x"), page)).otherwise(page.cast("string"))
    record = F.concat(F.lit("<siteinfo/>\n <page>\n  <title>"), escaped("url"), F.lit("</title>\n  <ns>"),
                      (page % 3).cast("string"), F.lit("</ns>\n  <id>"), article,
                      F.lit("</id>\n  <revision><text>"), escaped("html"), F.lit("</text></revision>\n"))
    return pages.select(record.alias("value"))


def xml_articles(spark, sf):
    out = articles(parse_pages(_xml_records(spark, sf)))
    return out.select("article_id", "title", F.md5("text").alias("text_md5"))


def dump_articles(spark, sf):
    """The same pages written as dump files and read by the splittable scan."""
    folder = _run_folder(spark)
    _xml_records(spark, sf).write.option("lineSep", "</page>").text(folder)
    return articles(read_pages(spark, folder, main_only=True)).select("article_id", "title", F.md5("text").alias("text_md5"))


def _faulty_records(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of which some are no XML, or lack namespace, id or text, or have an id that is no number or too large."""
    def escaped(c: str) -> Column:
        out = F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
        return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    page = F.col("page_id")
    own = F.when(page % 19 == 3, "x").when(page % 19 == 4, "99999999999999999999").otherwise(page.cast("string"))
    parts = [F.lit("\n<title>"), escaped("url"), F.lit("</title>"),
             F.when(page % 7 == 2, "").otherwise(F.concat(F.lit("<ns>"), (page % 4 % 3).cast("string"), F.lit("</ns>"))),
             F.when(page % 11 == 5, "").otherwise(F.concat(F.lit("<id> "), own, F.lit(" </id>"))),
             F.lit("<revision><id>5</id>"),
             F.when(page % 13 == 6, "").otherwise(F.concat(F.lit("<text>"), escaped("html"), F.lit("</text>"))),
             F.when(page % 17 == 8, "<b>").otherwise("</revision>")]
    pages = read_table(spark, f"{sf}/pages.parquet", "page_id", "url", "html", heavy=True)
    return pages.select(F.concat(F.lit("<siteinfo/>\n<page>"), *parts).alias("value"))


def rejected_pages(spark, sf):
    """Pages of a faulty dump that are no articles, written by one scan with the numbers of the others, and read back."""
    folder = _run_folder(spark)
    judged = judge_pages(_faulty_records(spark, sf)).withColumn("unit_id", F.coalesce(F.expr("article_id div 100").cast("string"), F.lit("no id")))
    found = ds.extract(judged, "text", "article_id", categorize=False, carry=["unit_id", "reason", "digest"], reason="reason")
    write_split(found, folder)
    return read_split(spark, folder)[1]


def rejected_by_reason(spark, sf):
    judged = judge_pages(_faulty_records(spark, sf)).withColumn("unit_id", F.lit("all"))
    return rejected_totals(judged.where("reason IS NOT NULL")).select("reason", "pages")


def units_completed(spark, sf):
    """Ledger after a backfill by source in which one source cannot be read: it fails alone."""
    folder = _run_folder(spark)
    docs = _documents(spark, sf, "doc_id", "source", "text")
    broken = docs.withColumn("text", F.when(F.col("source") == "src3", F.raise_error(F.lit("cannot be read"))).otherwise(F.col("text")))
    try:
        backfill(broken, "source", "text", "doc_id", f"{folder}/numbers", f"{folder}/ledger", categorize=False)
    except Exception as problem:
        if "cannot be read" not in str(problem):
            raise
    return read_ledger(spark, f"{folder}/ledger").select("unit_id", "status", "articles", "numbers", "retries")


def sampled_dump(spark, sf):
    """Articles of a dump whose ids are listed, chosen before anything is parsed."""
    folder = _run_folder(spark)
    _xml_records(spark, sf).write.option("lineSep", "</page>").text(folder)
    ids = read_table(spark, f"{sf}/pages.parquet", "page_id").where("page_id % 9 = 0").select(F.col("page_id").alias("article_id"))
    return articles(read_pages(spark, folder, main_only=True, ids=ids)).select("article_id", "title", F.md5("text").alias("text_md5"))


def numbers_written(spark, sf):
    """The numbers table written by domain and read back."""
    folder = _run_folder(spark)
    write_numbers(_document_numbers(spark, sf), folder)
    return read_numbers(spark, folder)


def totals_observed(spark, sf):
    """Articles, numbers and rejected rows, counted while the numbers are written."""
    live = Observation("totals")
    docs = _documents(spark, sf, "doc_id", "lang", "text")
    write_numbers(ds.extract(docs, "text", "doc_id", "lang", live=live), _run_folder(spark))
    return spark.createDataFrame([live.get], "articles bigint, numbers bigint, rejected bigint")


def parts_audited(spark, sf):
    """Numbers in part files by source, every fourth source as text: the readable numbers by domain, and what the audit says of the others."""
    folder = _run_folder(spark)
    numbers = _document_numbers(spark, sf, categorize=False)
    broken = F.coalesce(F.substring("source", 4, 9).try_cast("int") % 4 == 1, F.lit(False))
    numbers.where(~broken).write.partitionBy("source").parquet(folder)
    lines = F.to_csv(F.struct(*NUMBERS.names)).alias("value")
    numbers.where(broken).select("source", lines).write.mode("append").partitionBy("source").text(folder)
    rows, skipped = audit_parts(spark, folder)
    by_source = F.regexp_extract("file", "source=([^/]*)/", 1)
    return (rows.groupBy(F.col("domain").alias("part")).agg(F.lit("read").alias("reason"), F.count(F.lit(1)).alias("numbers"))
            .unionByName(skipped.groupBy(by_source.alias("part"), "reason").agg(F.sum("rows_read").alias("numbers"))))


def counts_json(spark, sf):
    """Digit counts of each domain as nested JSON, written and read back."""
    folder = _run_folder(spark)
    write_counts_json(_document_numbers(spark, sf, categorize=False), folder)
    return spark.read.text(folder).select(F.col("value").alias("counts"))


# -- text ------------------------------------------------------------------------------------------

def numbers_from_documents(spark, sf):
    docs = _documents(spark, sf, "doc_id", "text").where(ds.has_number(F.col("text")))
    return docs.select("doc_id", F.posexplode(ds.extract_numbers(F.col("text"))).alias("position", "number"))


def numbers_from_conversations(spark, sf):
    told = F.concat(F.col("turn") * 7 + 1, F.lit(" of "), F.length("text"), F.lit(".5: "), "text")
    rows = read_table(spark, f"{sf}/conversations.parquet", heavy=True).withColumn("text", told).where(ds.has_number(F.col("text")))
    return rows.select("conv_id", "turn", F.explode(ds.extract_numbers(F.col("text"))).alias("number"))


def number_contexts(spark, sf):
    docs = _documents(spark, sf, "doc_id", "text").where(ds.has_number(F.col("text")))
    return docs.select("doc_id", F.inline(ds.extract_contexts(F.col("text"), positions=True)))


def number_categories(spark, sf):
    docs = _documents(spark, sf, "doc_id", "text").where(ds.has_number(F.col("text")))
    found = ds.extract_categorized(F.col("text"), positions=True)
    return docs.select("doc_id", F.inline(found)).select("doc_id", "number", "number_category", "start_pos")


def measured_categories(spark, sf):
    return _measurements(spark, sf).select(
        "l_orderkey", "l_linenumber", "context",
        ds.number_category(F.col("number_text"), F.col("context")).alias("number_category"))


def declared_categories(spark, sf):
    return _measurements(spark, sf).select(
        "l_orderkey", "l_linenumber",
        ds.declared_category(F.col("number_text"), F.col("context")).alias("number_category"))


def document_declared_categories(spark, sf):
    docs = _documents(spark, sf, "doc_id", "lang", "text")
    numbers = ds.extract(docs, "text", "doc_id", "lang", category=ds.declared_category)
    return numbers.groupBy("domain", "number_category").agg(F.count("*").alias("numbers"))


def year_heuristic(spark, sf):
    orders = read_table(spark, f"{sf}/orders.parquet", "o_orderkey", "o_totalprice")
    return orders.select("o_orderkey", year_or_generic(F.round(F.col("o_totalprice") / 100, 2).cast("string")).alias("label"))


def numbers_table(spark, sf):
    return _document_numbers(spark, sf)


def strip_html(spark, sf):
    pages = read_table(spark, f"{sf}/pages.parquet", "page_id", "html", heavy=True)
    return pages.select("page_id", ds.strip_markup(F.col("html"), "html").alias("text"))


def html_numbers(spark, sf):
    pages = read_table(spark, f"{sf}/pages.parquet", "page_id", "html", heavy=True)
    return ds.extract(pages, "html", "page_id", markup="html", categorize=False).select(
        "article_id", "number", "first_digit", "second_digit")


def strip_wikitext(spark, sf):
    return _wikitext(spark, sf).select("doc_id", ds.strip_markup(F.col("wikitext"), "wikitext").alias("text"))


def infobox_type(spark, sf):
    return _wikitext(spark, sf).select("doc_id", ds.infobox_type(F.col("wikitext")).alias("infobox_type"))


def domain_of_text(spark, sf):
    return _wikitext(spark, sf).select("doc_id", ds.domain_of_text(F.col("wikitext")).alias("domain"))


def domain_label(spark, sf):
    orders = read_table(spark, f"{sf}/orders.parquet", "o_orderkey")
    return orders.select("o_orderkey", domain_of_type(_pick(KINDS, F.col("o_orderkey") % len(KINDS))).alias("domain"))


def rule_label(spark, sf):
    parts = read_table(spark, f"{sf}/part.parquet", "p_partkey", "p_type")
    rules = [("metal", "(?i)(?:steel|copper|brass|nickel|tin)"), ("plain", "(?i)^(?:small|standard)")]
    return parts.select("p_partkey", first_match_label(F.col("p_type"), rules, "other").alias("label"))


def domain_summary(spark, sf):
    numbers = ds.extract(_wikitext(spark, sf), "wikitext", "doc_id", markup="wikitext", categorize=False)
    return _round(ds.summary(numbers, ["domain"]), "chi_square", "p_value", "mad")


# -- digits and distributions ------------------------------------------------------------------------

def digits_lineitem(spark, sf):
    rows = _lineitem(spark, sf, "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    out = ds.with_digits(rows, "l_extendedprice")
    out = ds.with_digits(out, "l_discount", "discount_first", "discount_second")
    return out.select("l_orderkey", "l_linenumber", "first_digit", "second_digit", "discount_first", "discount_second")


def digits_near_powers(spark, sf):
    """Values of fourteen to sixteen digits just below and at rounding borders, from text so that both sides read the same doubles."""
    rows = _lineitem(spark, sf, "l_orderkey", "l_linenumber")
    head = F.element_at(F.array(*[F.lit(h) for h in DIGIT_HEADS]), (F.col("l_orderkey") % len(DIGIT_HEADS) + 1).cast("int"))
    text = F.concat(head, F.expr("repeat('9', cast(9 + l_linenumber % 4 as int))"), F.col("l_orderkey") % 3 * 3 + 1, F.lit("e"), F.col("l_orderkey") % 41 - 15)
    return ds.with_digits(rows.withColumn("x", text.cast("double")), "x").select("l_orderkey", "l_linenumber", "first_digit", "second_digit")


def digits_acctbal(spark, sf):
    rows = read_table(spark, f"{sf}/customer.parquet", "c_custkey", "c_acctbal")
    return rows.select("c_custkey", ds.first_digit(F.col("c_acctbal")).alias("first_digit"),
                       ds.second_digit(F.col("c_acctbal")).alias("second_digit"))


def digit_counts(spark, sf):
    return ds.digit_counts(_prices(spark, sf), ["l_returnflag"])


def second_digit_counts(spark, sf):
    return ds.digit_counts(_prices(spark, sf), ["l_returnflag"], "second_digit")


def document_digit_counts(spark, sf):
    return ds.digit_counts(_document_numbers(spark, sf, categorize=False), ["domain", "source"])


def digit_counts_map(spark, sf):
    return ds.digit_counts_map(_prices(spark, sf), ["l_returnflag"]).select(
        "l_returnflag", F.to_json("digit_counts").alias("digit_counts"))


def frequencies(spark, sf):
    return _round(ds.frequencies(_document_numbers(spark, sf, categorize=False), ["domain"]), "observed")


def frequencies_one_group(spark, sf):
    numbers = _document_numbers(spark, sf, categorize=False).where("domain = 'en'")
    return _round(ds.frequencies(numbers), "observed")


def chi_square(spark, sf):
    return _round(ds.chi_square_test(_prices(spark, sf), ["l_returnflag", "l_linestatus"]), "chi_square", "p_value")


def mad(spark, sf):
    return _round(ds.mean_absolute_deviation(_prices(spark, sf), ["l_returnflag", "l_linestatus"]), "mad").drop("mad_band")


def mad_band(spark, sf):
    events = ds.with_digits(read_table(spark, f"{sf}/events.parquet", "event_type", "value"), "value")
    return _round(ds.mean_absolute_deviation(events, ["event_type"]), "mad")


def ks(spark, sf):
    return _round(ds.kolmogorov_smirnov_test(_prices(spark, sf), ["l_returnflag"]), "ks_stat", "ks_p_value")


def cumulative_frequencies(spark, sf):
    from pyspark.sql import Window
    upto = Window.partitionBy("l_returnflag").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    rows = ds.frequencies(_prices(spark, sf), ["l_returnflag"])
    out = rows.select("l_returnflag", "digit", F.sum("observed").over(upto).alias("observed_upto"),
                      F.sum("expected").over(upto).alias("expected_upto"))
    return _round(out, "observed_upto", "expected_upto")


def summary(spark, sf):
    return _round(ds.summary(_prices(spark, sf), ["l_returnflag"]), "chi_square", "p_value", "mad")


def summary_orders(spark, sf):
    orders = read_table(spark, f"{sf}/orders.parquet", "o_orderpriority", "o_totalprice")
    return _round(ds.summary(ds.with_digits(orders, "o_totalprice"), ["o_orderpriority"]), "chi_square", "p_value", "mad")


def summary_parts(spark, sf):
    parts = read_table(spark, f"{sf}/part.parquet", "p_brand", "p_retailprice")
    return _round(ds.summary(ds.with_digits(parts, "p_retailprice"), ["p_brand"]), "chi_square", "p_value", "mad")


def summary_overall(spark, sf):
    sets = [["l_returnflag"], ["l_linestatus"], []]
    return _round(d.summary_sets(_prices(spark, sf), sets), "chi_square", "p_value", "mad")


def comparison(spark, sf):
    return _round(ds.comparison(_prices(spark, sf), ["l_returnflag"]), "observed")


def deviation_matrix(spark, sf):
    out = ds.deviation_matrix(_prices(spark, sf), ["l_returnflag"])
    return _round(out, *[f"digit_{i}" for i in range(1, 10)])


def deviation_matrix_clamped(spark, sf):
    out = ds.deviation_matrix(_prices(spark, sf), ["l_returnflag"], clamp=0.1)
    for i in range(1, 10):
        out = out.withColumn(f"digit_{i}", F.round(f"digit_{i}", 3))
    return out


def distinct_groups(spark, sf):
    return d.distinct_groups(read_table(spark, f"{sf}/documents.parquet", "source"), "source")


def corpus_totals(spark, sf):
    return _round(ds.corpus_totals(_document_numbers(spark, sf, categorize=False)), "avg_numbers")


def preview_summary(spark, sf):
    docs = preview_articles(_documents(spark, sf, "doc_id", "lang", "text"), "doc_id", 1000)
    return _round(preview_totals(ds.extract(docs, "text", "doc_id", "lang", categorize=False)), "avg_numbers")


def preview_distribution(spark, sf):
    docs = preview_articles(_documents(spark, sf, "doc_id", "lang", "text"), "doc_id", 1000)
    return _round(preview_digits(ds.extract(docs, "text", "doc_id", "lang", categorize=False)), "frequency")


def group_value_stats(spark, sf):
    events = read_table(spark, f"{sf}/events.parquet", "event_type", "value")
    return _round(value_stats(events, "value", ["event_type"]), "mean", "median", "p95", "max")


def group_value_stats_sparse(spark, sf):
    """Three of four values are null, and the others are mostly negative."""
    events = read_table(spark, f"{sf}/events.parquet", "event_type", "user_id", "value")
    few = events.select("event_type", F.when(F.col("user_id") % 4 == 0, F.col("value") - 60).alias("value"))
    return _round(value_stats(few, "value", ["event_type"]), "mean", "median", "p95", "max")


def group_value_stats_close(spark, sf):
    """Microseconds since 1970: large values that lie close together."""
    events = read_table(spark, f"{sf}/events.parquet", "event_type", "ts")
    return value_stats(events.select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("value")), "value", ["event_type"]).select(
        "event_type", F.col("median").cast("bigint").alias("median"), F.col("p95").cast("bigint").alias("p95"), "max", "count")


def category_conformity(spark, sf):
    rows = _measurements(spark, sf).select(
        ds.number_category(F.col("number_text"), F.col("context")).alias("number_category"),
        F.col("number_text").cast("double").alias("number"))
    out = ds.category_conformity(ds.with_digits(rows, "number"), category_dimension(spark))
    return _round(out, "mad")


def category_info(spark, sf):
    counts = _document_numbers(spark, sf).groupBy("number_category").agg(F.count("*").alias("numbers"))
    return with_category_info(counts, category_dimension(spark)).select(
        "number_category", "category_group", "expected_mad", "numbers")


# -- lookups, samples, set operations -----------------------------------------------------------------

def sample_first_n(spark, sf):
    return sample(_index(spark, sf), count=150, consecutive=True)


def sample_hashed(spark, sf):
    return sample(_index(spark, sf), count=120, seed=42)


def sample_by_rate(spark, sf):
    return sample(_index(spark, sf), rate=0.25, seed=7)


def first_n_large_ids(spark, sf):
    """The first documents by ids that no double can hold."""
    docs = _documents(spark, sf, "doc_id", "lang").select((F.lit(1 << 60) + F.col("doc_id") * 3).alias("doc_id"), "lang")
    return keep_smallest(docs, 137, ["doc_id"])


def first_n_text_ids(spark, sf):
    """The first documents by a text id, after their language; some languages are null."""
    docs = _documents(spark, sf, "doc_id", "lang").select(
        F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang"), F.concat(F.lit("document "), F.col("doc_id")).alias("name"))
    return keep_smallest(docs, 150, ["lang", "name"])


def grouped_ids(spark, sf):
    entry = F.transform("articles", lambda a: F.concat(a["article_id"], F.lit("="), a["title"], F.lit("*"), a["copies"]))
    index = _index(spark, sf)
    return group_by_offset(index.unionByName(index.where("article_id % 7 = 0")), part_ids=30).select(
        "offset", "part", F.size("articles").alias("entries"), F.array_join(entry, ";").alias("articles"))


def semi_join_sample(spark, sf):
    ids = sample(_index(spark, sf), rate=0.5, seed=42).select(F.col("article_id").alias("doc_id"))
    docs = keep_ids(_documents(spark, sf, "doc_id", "lang", "text"), ids, "doc_id")
    return ds.digit_counts(ds.extract(docs, "text", "doc_id", "lang", categorize=False), ["domain"])


def pending_anti_join(spark, sf):
    planned = read_table(spark, f"{sf}/documents.parquet", "doc_id").select(F.col("doc_id").alias("unit_id"))
    ledger = read_table(spark, f"{sf}/labels.parquet").select(
        F.col("doc_id").alias("unit_id"), F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))
    return pending(planned, ledger)


def _ledger(spark, sf):
    labels = read_table(spark, f"{sf}/labels.parquet")
    docs = read_table(spark, f"{sf}/documents.parquet", "doc_id", "n_chars")
    ledger = labels.join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("unit_id"),
        F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"),
        F.lit(1).cast("bigint").alias("articles"), F.col("n_chars").alias("numbers"),
        (F.col("n_chars") % 4).cast("int").alias("retries"))
    return ledger


def ledger_summary(spark, sf):
    return ledger_totals(_ledger(spark, sf))


def failed_units(spark, sf):
    return failed(_ledger(spark, sf))


def union_of_parts(spark, sf):
    parts = [
        read_table(spark, f"{sf}/lineitem.parquet").select(F.lit("lineitem").alias("domain"), F.col("l_extendedprice").alias("number")),
        read_table(spark, f"{sf}/orders.parquet").select(F.col("o_totalprice").alias("number"), F.lit("orders").alias("domain")),
        read_table(spark, f"{sf}/part.parquet").select(F.lit("part").alias("domain"), F.col("p_retailprice").alias("number")),
    ]
    return ds.digit_counts(ds.with_digits(union_parts(parts), "number"), ["domain"])


def unit_tag(spark, sf):
    tagged = tag_units(_measurements(spark, sf), "after", units_with_measures(spark))
    return tagged.select("l_orderkey", "l_linenumber", "unit", F.array_join("measures", ",").alias("measures"))


def unit_tag_phrases(spark, sf):
    """Units of up to four words behind a number, and signs before it."""
    rows = _lineitem(spark, sf, "l_orderkey", "l_linenumber")
    at = F.col("l_orderkey") % len(UNIT_PHRASES)
    rows = rows.select("*", _pick([p[0] for p in UNIT_PHRASES], at).alias("before"), _pick([p[1] for p in UNIT_PHRASES], at).alias("after"))
    tagged = tag_units(rows, "after", units_with_measures(spark), before="before")
    return tagged.select("l_orderkey", "l_linenumber", "unit", F.array_join("measures", ",").alias("measures"))


def strip_wikitext_deep(spark, sf):
    """Templates and links nested as deep as the document's id says, with single braces and brackets inside."""
    docs = _documents(spark, sf, "doc_id", "lang")
    text = F.expr("""concat('Seen ', repeat('{{a|{b}', cast(doc_id % 40 as int)), ' 41 ', repeat('}}', cast(doc_id % 40 as int)), ' 7',
        repeat('[[t|u ', cast(doc_id % 23 as int)), lang, ' [5] ', repeat(']]', cast(doc_id % 23 as int)), ' }} ', cast(doc_id as string), ' {{open {n} }')""")
    return docs.select("doc_id", ds.strip_markup(text, "wikitext").alias("text"))


def unit_union(spark, sf):
    words = _documents(spark, sf, "text").select(F.explode(F.split("text", "[ \n]")).alias("unit"))
    known = words.join(F.broadcast(all_units(spark)), "unit", "left_semi")
    return known.groupBy("unit").agg(F.count("*").alias("occurrences"))


QUERIES = {f.__name__: f for f in (
    has_numbers, index_parse, xml_articles, dump_articles, numbers_written, counts_json, numbers_from_documents, numbers_from_conversations, number_contexts,
    number_categories, measured_categories, declared_categories,
    document_declared_categories, year_heuristic, numbers_table, strip_html, html_numbers,
    strip_wikitext, strip_wikitext_deep, infobox_type, domain_of_text, domain_label, rule_label, domain_summary, digits_lineitem,
    digits_near_powers, digits_acctbal, digit_counts, second_digit_counts, document_digit_counts, digit_counts_map, frequencies,
    frequencies_one_group, chi_square, mad, mad_band, ks, cumulative_frequencies, summary, summary_orders,
    summary_parts, summary_overall, comparison, deviation_matrix, deviation_matrix_clamped, distinct_groups,
    corpus_totals, preview_summary, preview_distribution, group_value_stats, group_value_stats_sparse, category_conformity,
    totals_observed, parts_audited, rejected_pages, rejected_by_reason, units_completed, sampled_dump, group_value_stats_close, category_info, sample_first_n, sample_hashed, sample_by_rate, first_n_large_ids, first_n_text_ids, grouped_ids, semi_join_sample,
    pending_anti_join, ledger_summary, failed_units, union_of_parts, unit_tag, unit_tag_phrases, unit_union,
)}

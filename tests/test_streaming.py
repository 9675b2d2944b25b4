import hashlib
import re

import pytest
from pyspark.sql import functions as F

import digitscope as ds
from digitscope.plans.extract import backfill_numbers, extract_articles
from digitscope.sources.pages import judge_pages, parse_pages, raw_id
from digitscope.sources.tables import read_split
from digitscope.streaming.ingest import backfill, failed, follow, ingest, ledger_totals, read_ledger, rejected_totals, stream_pages, stream_table


def rows_of(df):
    return sorted(map(tuple, df.select("article_id", "domain", "number", "number_category", "first_digit", "second_digit").collect()))


def test_two_runs_over_a_growing_folder_equal_one_batch(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    source, sink, place = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def transform(df):
        return ds.extract(df, "text", "doc_id", "lang")

    for part in (0, 1):
        docs.where(F.col("doc_id") % 2 == part).coalesce(2).write.mode("append").parquet(source)
        ingest(stream_table(spark, source, docs.schema), transform, sink, place).awaitTermination()
    assert rows_of(spark.read.parquet(sink)) == rows_of(transform(docs))
    ingest(stream_table(spark, source, docs.schema), transform, sink, place, by_domain=False).awaitTermination()
    assert spark.read.parquet(sink).count() == transform(docs).count()


def test_stream_of_dump_pages(spark, tmp_path):
    source, sink, place = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    for n in (1, 2):
        pages = "".join(f"<page><title>t</title><ns>0</ns><id>{n}{i}</id><revision><text>{{{{Infobox film}}}} in 19{n}{i} km"
                        f"</text></revision></page>\n" for i in range(5))
        (source / f"{n}.xml").write_text(f"<mediawiki>{pages}</mediawiki>")
        ingest(stream_pages(spark, str(source)), extract_articles, sink, place, by_domain=True).awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == 10 and {r.domain for r in out.collect()} == {"Media"}


def test_backfill_continues_where_it_stopped(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sink, ledger = str(tmp_path / "numbers"), str(tmp_path / "ledger")
    first = docs.where("source in ('src1', 'src2')")
    entries = backfill(first, "source", "text", "doc_id", sink, ledger)
    assert {r.unit_id for r in entries.collect()} == {"src1", "src2"}
    assert backfill(first, "source", "text", "doc_id", sink, ledger).count() == 0
    backfill(docs, "source", "text", "doc_id", sink, ledger)
    whole = ds.extract(docs, "text", "doc_id")
    assert rows_of(spark.read.parquet(sink)) == rows_of(whole)
    totals = ledger_totals(read_ledger(spark, ledger)).first()
    assert totals.completed_units == docs.select("source").distinct().count() and totals.failed_units == 0
    assert totals.numbers == whole.count()


def test_backfill_records_failures_and_replaces_what_they_left(spark, tmp_path):
    sink, ledger = str(tmp_path / "numbers"), str(tmp_path / "ledger")
    rows = [(1, "a", "in 1999"), (2, "b/x", "in 2001 and 7"), (3, None, "5"), (4, "c", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, unit string, text string")
    broken = docs.withColumn("text", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("no such page"))).otherwise(F.col("text")))
    for _ in range(2):
        with pytest.raises(Exception, match="no such page"):
            backfill(broken, "unit", "text", "doc_id", sink, ledger)
    assert {(r.unit_id, r.retries) for r in failed(read_ledger(spark, ledger)).collect()} == {("b/x", 1)}
    done = {r.unit_id: (r.articles, r.numbers) for r in read_ledger(spark, ledger).where("status = 'completed'").collect()}
    assert done == {"a": (1, 1), "c": (0, 0)}
    # An attempt that broke off after writing: its rows are replaced, also where nothing comes in their place.
    left = ds.extract(docs.where("unit = 'b/x'").withColumn("text", F.lit("8 9 10")), "text", "doc_id", carry=["unit"]).withColumnRenamed("unit", "unit_id")
    left.write.mode("append").partitionBy("unit_id").parquet(sink)
    done = {r.unit_id: (r.articles, r.numbers) for r in backfill(docs, "unit", "text", "doc_id", sink, ledger).collect()}
    assert done == {"b/x": (1, 2)}
    assert sorted(r.number for r in spark.read.parquet(sink).collect()) == [7.0, 1999.0, 2001.0]
    totals = ledger_totals(read_ledger(spark, ledger)).first()
    assert (totals.completed_units, totals.failed_units, totals.numbers) == (3, 0, 3)


def test_one_failing_unit_among_fifty_stands_alone(spark, tmp_path):
    sink, ledger = str(tmp_path / "numbers"), str(tmp_path / "ledger")
    docs = spark.range(500).selectExpr("id as doc_id", "concat('u', cast(id % 50 as string)) as unit", "concat('in ', cast(id + 1 as string)) as text")
    broken = docs.withColumn("text", F.when(F.col("unit") == "u17", F.raise_error(F.lit("no such page"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no such page"):
        backfill(broken, "unit", "text", "doc_id", sink, ledger, categorize=False)
    entries = read_ledger(spark, ledger).collect()
    assert len(entries) == 50 and {r.unit_id for r in entries if r.status == "failed"} == {"u17"}
    assert all(r.articles == r.numbers == 10 for r in entries if r.status == "completed")
    assert spark.read.parquet(sink).count() == 490
    assert {r.unit_id for r in backfill(docs, "unit", "text", "doc_id", sink, ledger, categorize=False).collect()} == {"u17"}
    assert spark.read.parquet(sink).count() == 500


def test_many_failing_units_are_not_taken_apart_for_ever(spark, tmp_path):
    sink, ledger = str(tmp_path / "numbers"), str(tmp_path / "ledger")
    docs = spark.range(40).selectExpr("id as doc_id", "cast(id as string) as unit", "raise_error('all broken') as text")
    with pytest.raises(Exception, match="all broken"):
        backfill(docs, "unit", "text", "doc_id", sink, ledger, isolate=2, categorize=False)
    assert read_ledger(spark, ledger).where("status = 'failed'").select("unit_id").distinct().count() == 40


def test_rows_are_read_once_for_the_plan_and_once_for_the_work(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def unit(i):
        seen.add(1)
        return f"u{i % 7}"

    unit = unit.asNondeterministic()  # evaluated once for each row that is read, never copied into a filter
    docs = spark.range(300).select(F.col("id").alias("doc_id"), unit("id").alias("unit"), F.concat(F.lit("in "), F.col("id") + 1).alias("text"))
    backfill(docs, "unit", "text", "doc_id", str(tmp_path / "numbers"), str(tmp_path / "ledger"), categorize=False)
    assert seen.value == 600


FAULTY = {
    "<title>t</title><ns>0</ns><id>11</id><revision><id>5</id><text>in 1999 km</text></revision>": None,
    "<title>t</title><ns>0</ns><id> 12 </id><revision><text>no number</text></revision>": None,
    "<title>t</title><ns>1</ns><id>13</id><revision><text>7</text></revision>": "other_namespace",
    "<title>t</title><ns>main</ns><id>14</id><revision><text>7</text></revision>": "other_namespace",
    "<title>t</title><ns>0</ns><id>15</id><revision><text>7</revision>": "bad_xml",
    "<title>t</title><id>16</id><revision><text>7</text></revision>": "no_namespace",
    "<title>t</title><ns>0</ns><revision><id>5</id><text>7</text></revision>": "no_id",
    "<title>t</title><ns>0</ns><id>x</id><revision><text>7</text></revision>": "bad_id",
    "<title>t</title><ns>0</ns><id>99999999999999999999</id><revision><text>7</text></revision>": "bad_id",
    "<title>t</title><ns>0</ns><id>19</id><revision></revision>": "no_text",
    "<title>t</title><ns>0</ns><id>20</id>": "no_text",
    "<title>&broken;</title><ns>0</ns><id>21</id><revision><text>7</text></revision>": "bad_xml",
}


def test_rejected_pages_are_kept_with_their_reason(spark, tmp_path):
    dump, sink, ledger = tmp_path / "dump.xml", str(tmp_path / "out"), str(tmp_path / "ledger")
    dump.write_text("<mediawiki>" + "\n".join(f"<page>{p}</page>" for p in FAULTY) + "\n<page><ns>0</ns><id>30</id><revision><text>cut off")
    backfill_numbers(spark, str(dump), sink, ledger, unit_ids=10, rejected=True)
    numbers, rejected = read_split(spark, sink)
    assert [(r.article_id, r.number, r.unit_id) for r in numbers.collect()] == [(11, 1999.0, "1")]
    want = [(hashlib.sha256(f"<page>{p}</page>".encode()).hexdigest(), r, str(int(m.group(1)) // 10) if (m := re.search(r"<id> ?(\d{2}) ?</id>", p)) else "no id")
            for p, r in FAULTY.items() if r]
    want.append((hashlib.sha256(b"<page><ns>0</ns><id>30</id><revision><text>cut off</page>").hexdigest(), "bad_xml", "3"))
    assert sorted((r.digest, r.reason, r.unit_id) for r in rejected.collect()) == sorted(want)
    totals = {r.reason: (r.pages, r.units) for r in rejected_totals(rejected).collect()}
    assert totals["bad_id"] == (2, 1) and totals["bad_xml"] == (3, 3) and sum(n for n, _ in totals.values()) == 11
    entries = {r.unit_id: (r.articles, r.numbers, r.rejected) for r in read_ledger(spark, ledger).collect()}
    assert entries == {"1": (1, 1, 5), "2": (0, 0, 2), "3": (0, 0, 1), "no id": (0, 0, 3)}
    assert backfill_numbers(spark, str(dump), sink, ledger, unit_ids=10, rejected=True).count() == 0
    assert judge_pages(spark.createDataFrame([], "value string")).count() == 0


def test_listed_pages_are_chosen_before_anything_is_parsed(spark):
    records = spark.createDataFrame([(f"<page>{p}",) for p in FAULTY], "value string")
    found = {r.id for r in records.select(raw_id(F.col("value")).alias("id")).collect()}
    assert found == {11, 12, 13, 14, 15, 16, 19, 20, 21, None}
    ids = spark.createDataFrame([(11,), (13,), (15,), (77,)], "article_id long")
    pages = parse_pages(records, main_only=True, ids=ids)
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LeftSemi")  # the join stands below the parser
    assert {r.id for r in pages.collect()} <= {"11", None} and pages.count() == 2
    judged = judge_pages(records, ids=ids).collect()
    assert {(r.article_id, r.reason) for r in judged} == {(11, None), (13, "other_namespace"), (15, "bad_xml"), (None, "no_id"), (None, "bad_id")}


def test_running_totals_of_a_stream(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    source, sink, place = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def transform(df):
        return ds.extract(df, "text", "doc_id", "lang", categorize=False, live="totals")

    docs.repartition(5).write.parquet(source)
    seen = list(follow(ingest(stream_table(spark, source, docs.schema, files_per_batch=1), transform, sink, place), "totals", 0.2))
    counted = ds.corpus_totals(spark.read.parquet(sink)).first()
    assert seen[-1] == {"articles": counted.articles, "numbers": counted.numbers, "rejected": 0}
    assert [s["numbers"] for s in seen] == sorted(s["numbers"] for s in seen) and counted.numbers > 0
    # A second run without new files reports nothing.
    assert list(follow(ingest(stream_table(spark, source, docs.schema), transform, sink, place), "totals", 0.2)) == []

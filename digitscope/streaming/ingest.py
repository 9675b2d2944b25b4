"""Incremental ingest of new files, and backfills that continue where they stopped.

The extraction is stateless, so the same plan serves batch and stream. A stream keeps its place
in its checkpoint folder; a backfill keeps a ledger of completed units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from digitscope.operators.lookups import pending
from digitscope.plans.extract import extract
from digitscope.schemas import LEDGER
from digitscope.sources.pages import parse_pages
from digitscope.sources.sinks import write_split
from digitscope.sources.tables import read_split


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the main-namespace pages of the dump files that appear in a folder."""
    return parse_pages(spark.readStream.option("lineSep", "</page>")
                       .option("maxFilesPerTrigger", files_per_batch).text(path), main_only=True)


def ingest(source: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
           by_domain: bool = False) -> StreamingQuery:
    """Process everything that is new since the last run and append it to the Parquet sink.

    Files are taken exactly once, also when a run is interrupted and repeated.
    """
    writer = (transform(source).writeStream.format("parquet").outputMode("append")
              .option("path", sink).option("compression", "zstd").option("checkpointLocation", checkpoint)
              .trigger(availableNow=True))
    return (writer.partitionBy("domain") if by_domain else writer).start()


def follow(query: StreamingQuery, name: str, seconds: float = 1.0) -> Iterator[dict[str, int]]:
    """Running totals of a stream whose transformation observes itself as ``name`` (``extract(..., live=name)``).

    Yields the sums so far whenever batches were finished, at last those of the whole run, and ends with the query; a failure of the query
    is raised. Reads the query's own progress, which Spark keeps for the last ``spark.sql.streaming.numRecentProgressUpdates`` (100) batches;
    should more than that finish within ``seconds``, the run is longer than what can be seen, and a ``RuntimeError`` says so.
    """
    totals, last = {}, -1
    while True:
        ended = query.awaitTermination(seconds)
        recent = [p for p in query.recentProgress if p.batchId > last and p.numInputRows]
        if recent:
            if last >= 0 and min(p.batchId for p in query.recentProgress) > last + 1:
                raise RuntimeError("batches finished faster than they were followed")
            for progress in recent:
                for key, value in progress.observedMetrics[name].asDict().items():
                    totals[key] = totals.get(key, 0) + value
                last = progress.batchId
            yield dict(totals)
        if ended:
            return


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger of processed units; empty before the first run."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)
    return spark.read.schema(LEDGER).parquet(path) if exists else spark.createDataFrame([], LEDGER)


def record(spark: SparkSession, units: DataFrame, path: str) -> None:
    """Append entries to the ledger."""
    units.to(LEDGER).write.mode("append").parquet(path)


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """Articles and numbers of the completed units, and how many units completed or last failed."""
    completed = F.col("status") == "completed"
    per_unit = ledger.groupBy("unit_id").agg(
        F.bool_or(completed).alias("done"),
        F.max(F.when(completed, F.col("articles"))).alias("articles"),
        F.max(F.when(completed, F.col("numbers"))).alias("numbers"))
    return per_unit.agg(
        F.coalesce(F.sum(F.col("done").cast("int")), F.lit(0)).alias("completed_units"),
        F.coalesce(F.sum((~F.col("done")).cast("int")), F.lit(0)).alias("failed_units"),
        F.coalesce(F.sum("articles"), F.lit(0)).alias("articles"),
        F.coalesce(F.sum("numbers"), F.lit(0)).alias("numbers"))


def rejected_totals(rejected: DataFrame) -> DataFrame:
    """How many pages were rejected for which ``reason``, with the number of units they are from."""
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("unit_id").alias("units"))


def failed(ledger: DataFrame) -> DataFrame:
    """Units that were tried and never completed, with the number of retries."""
    return (ledger.groupBy("unit_id")
            .agg(F.bool_or(F.col("status") == "completed").alias("done"),
                 F.max(F.when(F.col("status") == "failed", F.col("retries"))).alias("retries"))
            .where("not done and retries is not null").drop("done"))


def _drop_partitions(spark: SparkSession, sink: str, units: DataFrame, keys: str) -> None:
    """Remove what earlier attempts left in the sink for these units; only folders that exist are touched."""
    jvm, root = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root) or not [s for s in files.listStatus(root) if s.isDirectory()]:
        return
    held = spark.read.schema(", ".join(f"{k} string" for k in keys.split("/"))).parquet(sink).select(*keys.split("/")).distinct().join(units, "unit_id", "left_semi")
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in held.toLocalIterator():
        files.delete(jvm.org.apache.hadoop.fs.Path(root, "/".join(f"{k}={escape(row[k])}" for k in keys.split("/"))), True)


def backfill(texts: DataFrame, unit_col: str, text_col: str, id_col: str, sink: str, ledger: str, isolate: int = 100,
             **options) -> DataFrame:
    """Extract all units that the ledger does not list as completed; returns the new ledger entries.

    The units to do are written once, beside the ledger, and worked off in one job. If it fails, their halves (by a hash of the unit) are tried,
    and so on, until a failing unit stands alone; it is recorded as failed, with the error and one more retry, and stays pending, while
    all others complete. Once ``isolate`` units have failed, failing groups are recorded as they are. The first error is raised
    at the end.

    The sink is partitioned by unit; what an attempt that broke off has left there for a pending unit is removed first, so counts and rows
    are those of the last attempt. Units without numbers complete too. If ``texts`` has ``reason`` and ``digest``, as ``judge_pages`` gives
    them, rejected rows are written in the same job, the sink is one of ``write_split``, and the ledger counts them.
    """
    spark, split = texts.sparkSession, "reason" in texts.columns
    at = F.lit(datetime.now(timezone.utc)).cast("timestamp")
    rows = texts.withColumn("unit_id", F.col(unit_col).cast("string"))
    before = read_ledger(spark, ledger)
    plan = f"{ledger.rstrip('/')}-todo"
    pending(rows.select("unit_id").where("unit_id IS NOT NULL").distinct(), before).withColumn("slot", F.xxhash64("unit_id")).write.mode("overwrite").parquet(plan)
    todo = spark.read.schema("unit_id string, slot bigint").parquet(plan)
    _drop_partitions(spark, sink, todo, "kind/unit_id" if split else "unit_id")
    tried = before.where("status = 'failed'").groupBy("unit_id").agg(F.max("retries").alias("last"))
    none, problems, open_ = F.lit(0).cast("bigint"), [], [(0, 0)]
    while open_:
        bits, own = open_.pop()
        group = lambda slot: slot.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")) == own  # noqa: B023, E731
        units = todo.where(group(F.col("slot")))
        n = units.count()
        if not n:
            continue
        try:
            # Other units' texts are not even looked at: they might be the failing ones.
            mine = rows.withColumn(text_col, F.when(group(F.xxhash64("unit_id")), F.col(text_col)))
            counted = _write_units(mine, units, text_col, id_col, sink, split, options)
        except Exception as problem:
            if n > 1 and bits < 60 and len(problems) < isolate:
                open_ += [(bits + 1, own | 1 << bits), (bits + 1, own)]
                continue
            problems.append(problem)
            record(spark, units.join(tried, "unit_id", "left").select(
                "unit_id", F.lit("failed").alias("status"), none.alias("articles"), none.alias("numbers"),
                F.coalesce(F.col("last") + 1, F.lit(0)).alias("retries"), F.lit(str(problem)[:1000]).alias("error"), at.alias("at"), none.alias("rejected")), ledger)
            continue
        record(spark, units.join(counted, "unit_id", "left").select(
            "unit_id", F.lit("completed").alias("status"), *[F.coalesce(c, none).alias(c) for c in ("articles", "numbers", "rejected")],
            F.lit(0).alias("retries"), F.lit(None).cast("string").alias("error"), at.alias("at")), ledger)
    if problems:
        raise problems[0]
    return read_ledger(spark, ledger).where((F.col("at") == at) & (F.col("status") == "completed"))


def _write_units(rows: DataFrame, units: DataFrame, text_col: str, id_col: str, sink: str, split: bool, options: dict) -> DataFrame:
    """Extract the units' rows into the sink; returns what each unit has there: ``unit_id, articles, numbers, rejected``."""
    spark, own = rows.sparkSession, rows.join(units.select("unit_id"), "unit_id", "left_semi")
    if split:
        write_split(extract(own, text_col, id_col, carry=["unit_id", "reason", "digest"], reason="reason", **options), sink)
        numbers, rejected = read_split(spark, sink)
    else:
        found = extract(own, text_col, id_col, carry=["unit_id"], **options)
        found.hint("rebalance", F.col("unit_id")).write.mode("append").option("compression", "zstd").partitionBy("unit_id").parquet(sink)
        numbers, rejected = spark.read.schema(found.schema).parquet(sink), None
    out = (numbers.join(units, "unit_id", "left_semi").groupBy("unit_id")
           .agg(F.count_distinct("article_id").alias("articles"), F.count(F.lit(1)).alias("numbers")))
    if rejected is None:
        return out.withColumn("rejected", F.lit(None).cast("bigint"))
    return out.join(rejected.join(units, "unit_id", "left_semi").groupBy("unit_id").agg(F.count(F.lit(1)).alias("rejected")), "unit_id", "full")

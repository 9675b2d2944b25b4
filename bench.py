"""Time the headline queries; prints one JSON line.

Every query is run once to warm up and then timed; the timed run builds the plan anew and
computes all rows and columns of the result without storing them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from suite.queries import QUERIES  # noqa: E402

HEADLINE = (
    "summary", "summary_overall", "summary_orders", "digit_counts", "digits_lineitem", "deviation_matrix", "ks",
    "group_value_stats", "has_numbers", "numbers_table", "number_contexts", "document_digit_counts", "corpus_totals",
    "measured_categories", "category_conformity", "domain_summary", "strip_html", "html_numbers", "unit_tag",
    "index_parse", "sample_hashed", "sample_first_n", "semi_join_sample", "pending_anti_join",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             # Recording the call site of every expression costs more than building it.
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    articles = spark.read.parquet(f"{folder}/documents.parquet").count()
    result = {"metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
              "queries": times, "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf")}
    if "domain_summary" in times:
        result["ms_per_article"] = round(times["domain_summary"] * 1000 / articles, 3)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

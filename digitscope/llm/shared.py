"""Shared folder for intermediate tables, and batches of bounded size for Arrow functions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Text bytes that an Arrow function turns into Python objects at a time.
SLICE_BYTES = 4_000_000


def work_folder(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a local session without that setting gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="digitscope-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/digitscope-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Cuts the lineage so that lost executors do not set off a recomputation from the start, and gives
    the planner true sizes. The files stay until the folder is cleaned.
    """
    spark = df.sparkSession
    path = work_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Number of partitions that Spark is told to use for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes; a longer value stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)

"""Folders and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches of whole texts and pages stay small, as a worker holds several forms of one batch at a time.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what Spark hands to a Python worker at once, in rows and bytes, for this session; lower settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = spark.conf.get(key).lower().removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, most)


def free_memory() -> None:
    """Gives the memory that this Python worker has no use for back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def freed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` (over a task's batches), followed by ``free_memory``."""

    def until_the_end(batches):
        yield from run(batches)
        free_memory()

    return until_the_end


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark is local (tests).

    What operators write there stays for as long as their results may be read; it expires like checkpoints do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/ledgerlake/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and any executor can read it again.

    Unlike a checkpoint the table is compressed, read by column, and has a known size, by which Spark
    decides whether a later join may broadcast it.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``row``, so that helper columns beside it can't clash with any of them."""
    return F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row")

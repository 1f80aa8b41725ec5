"""What the operators of this folder have in common: the shared folder and row plumbing."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.session import tune

# Rows handed to Python at once; texts differ in length, so bytes are bounded as well.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def give_back() -> None:
    """Gives what this worker has freed back to the system; Arrow and glibc would keep it while the worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def prepared(spark: SparkSession) -> SparkSession:
    """``spark`` with adaptive execution on and bounded Arrow batches."""
    tune(spark)
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, as in tests, the
    warehouse holds it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialised_small(df: DataFrame, name: str) -> DataFrame:
    """:func:`materialised` for a table of narrow rows, one for each of some groups: at most one file for each core."""
    return materialised(df.coalesce(df.sparkSession.sparkContext.defaultParallelism), name)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if it was counted to have at most ``rows``."""
    return F.broadcast(df) if df.count() <= rows else df


def with_row(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole row as struct ``_row`` beside ``columns``; names of a caller's columns can't clash then."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), *[docs[c] for c in columns])


def rows_of(df: DataFrame) -> DataFrame:
    """The rows that :func:`with_row` had wrapped."""
    return df.select("_row.*")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")

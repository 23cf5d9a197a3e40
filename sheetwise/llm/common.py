"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df lacks, in any case, made from the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        k = 0
        while f"{name}_{k}".lower() in taken:
            k += 1
        out.append(f"{name}_{k}")
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the session has it.

    Without that setting (tests on one machine) a folder under the session's
    warehouse is used and also set as the checkpoint folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if not urlparse(where).scheme:
            where = f"file://{where}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def binary(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """An Arrow string or binary column as one large_binary array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string())
    column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def give_back() -> None:
    """Freed memory back to the system: a worker serves many groups one after the other."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

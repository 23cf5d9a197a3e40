"""Cutting the lineage of iterative queries in the folder that a cluster shares."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession

#: After so many cuts, or with so much of its heap in use, the driver collects its garbage; Spark then drops the checkpoints and
#: shuffles that nothing refers to. Each stage leaves some 4 MB blocks in the driver, which fill a small heap within seconds.
COLLECT, FULL = 24, 0.4
_cuts = count(1)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session has it, else a folder under the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        where = where if ":" in where else f"file://{where}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept by a reliable checkpoint.

    A checkpoint keeps the size that Spark estimates for its plan, for a join the product
    of both sides. Over the rounds of a loop that number doubles its digits with each
    join until it fills the driver, so the rows go on as a table of unknown size.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint()
    jvm = spark.sparkContext._jvm
    heap = jvm.Runtime.getRuntime()
    if next(_cuts) % COLLECT == 0 or heap.totalMemory() - heap.freeMemory() > FULL * heap.maxMemory():
        jvm.System.gc()
    rows = out._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, out._jdf.schema(), False), spark)

"""Intermediate tables in the shared folder, and their removal."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import scratch_path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with files that outlive executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, or array entries, up to which a stored table is broadcast: some 20 MB.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, name: str, weight: Column | None = None) -> DataFrame:
    """The stored table, marked for broadcast if its size allows it; else joins shuffle as usual.

    ``weight`` counts a row's entries where rows hold arrays.
    """
    stored = keep(df, name)
    total = stored.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(stored) if total <= BROADCAST_ROWS else stored


def drop(df: DataFrame) -> None:
    """Remove the files of a table that ``keep`` wrote and nobody reads any more."""
    remove(df.sparkSession, *df.inputFiles()[:1])


def remove(spark: SparkSession, *files: str) -> None:
    jvm = spark.sparkContext._jvm
    for name in files:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 256, megabytes: int = 2) -> None:
    """Rows and megabytes per Arrow batch, so that long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def released(run, *memories):
    """``run`` over a task's batches, after which its worker gives back what it holds.

    Workers live on between tasks and stages, so the words that one stage remembers
    would stay beside the memory of the next stages. ``memories`` are emptied, and
    freed pages go back to the system.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            for memory in memories:
                memory.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole

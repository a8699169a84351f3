"""What the operators need of a session besides the library's own helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bitcurve.session import scratch

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, whose Python workers import it; once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    handle, path = tempfile.mkstemp(suffix=".zip", prefix="bitcurve-")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: computed once, its partitions
    fixed, and no lost executor can take it along."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of what earlier steps left on the driver. Spark drops shuffles, broadcasts and plans once their handles
    are collected, in Python and then in the JVM, which by itself waits until its heap is full."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()

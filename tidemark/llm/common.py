"""What the operators share: scratch space and the columns they take."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import drop, held, materialise, scratch_path, shared_dir, sweep, written

__all__ = ["doc_key", "documents", "drop", "forget", "held", "materialise", "scratch_path", "shared_dir", "shrinking", "shuffle_partitions", "small_batches", "streamed", "sweep", "trim", "written"]

#: Of an Arrow batch on its way to a Python worker; by rows alone, 10,000 long texts are held at once, in the JVM and again in the worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Per cent of the driver's heap that may stay free, of what is left after `forget`; the JVM's own are 40 and 70.
_FREE = {"MinHeapFreeRatio": "10", "MaxHeapFreeRatio": "30"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_key(docs: DataFrame) -> DataFrame:
    """doc_id as long and text, the only columns most operators take, so that extra columns can never clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands its rows to Python in batches of about BATCH_BYTES; the session's own setting is back afterwards."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def streamed(df: DataFrame, label: str) -> DataFrame:
    """`materialise` with small batches, for tables that Python makes from texts or sets."""
    with small_batches(df.sparkSession):
        return materialise(df, label)


@contextmanager
def shrinking(spark: SparkSession) -> Iterator[None]:
    """A full collection meanwhile leaves the driver's heap as _FREE says; the JVM's own ratios are back afterwards. Without effect on a JVM that has no such options."""
    before: dict[str, str] = {}
    jvm = spark.sparkContext._jvm
    try:
        kind = jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
        for name, value in _FREE.items():  # the smaller one first, as neither may pass the other
            found = options.getVMOption(name).getValue()
            options.setVMOption(name, value)
            before[name] = found
    except Py4JError:
        pass
    try:
        yield
    finally:
        for name, value in reversed(before.items()):
            options.setVMOption(name, value)


def trim(spark: SparkSession) -> str:
    """What the driver's JVM has freed beside its heap goes back to the system, where malloc would hold it in an arena of each thread that the
    compilers and queries used. Returns what the JVM says of it; empty on one that cannot."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        # the server's class is not open to py4j, its interface is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[1] = "systemTrimNativeHeap"
        return str(invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args))
    except Py4JError:
        return ""


def forget(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a query that is over when the driver collects garbage, which may be many queries later; this has it done
    now. The memory that this frees goes back to the system, else the driver keeps for good what its largest moment took."""
    gc.collect()
    with shrinking(spark):
        spark.sparkContext._jvm.System.gc()
    trim(spark)

"""Tables in the folder that driver and executors share: written once, read again, removed when they are no longer needed."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK = "/tmp/checkpoints"
#: Scratch paths that are still there, and the sessions they belong to.
_scratch: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine serves a
    session in local mode; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{_LOCAL_FALLBACK}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found if ":/" in found else f"file://{found}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed by `sweep` or when the driver ends."""
    if not _scratch:
        atexit.unregister(sweep)
        atexit.register(sweep)
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def held() -> set[str]:
    return set(_scratch)


def sweep(keep: set[str] = frozenset()) -> None:
    """Remove all scratch paths but those to keep."""
    drop(held() - keep)


def drop(paths: set[str]) -> None:
    """Remove the paths of these that are still there."""
    for path in [p for p in _scratch if p in paths]:
        remove(_scratch.pop(path), path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; a stopped session leaves it to the owner of the shared folder."""
    jsc = spark.sparkContext._jsc
    if jsc is None:
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: lineage is cut, and a lost executor costs only its own tasks."""
    return written(df, scratch_path(df.sparkSession, label))

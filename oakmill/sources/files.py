"""Hadoop paths: the folders of tables, wherever the cluster keeps them."""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: Used only where no shared folder is named, and then by local masters alone.
LOCAL_SHARED = "/tmp/checkpoints/oakmill"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; a cluster has to name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """A path's file system and the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = at(spark, path)
    return bool(fs.exists(p))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    fs, p = at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def written(spark: SparkSession, path: str, pattern: str = "") -> list[str]:
    """Names of the folders in ``path`` that a job has finished writing, in order."""
    return [n for n in names(spark, path) if n.startswith(pattern) and exists(spark, f"{path}/{n}/_SUCCESS")]


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = at(spark, path)
    return bool(fs.delete(p, True))


def write_bytes(spark: SparkSession, path: str, data: bytes, step: int = 1 << 24) -> None:
    """Write a file."""
    fs, p = at(spark, path)
    out = fs.create(p)
    for i in range(0, len(data), step):
        out.write(bytearray(data[i : i + step]))
    out.close()


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a DataFrame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

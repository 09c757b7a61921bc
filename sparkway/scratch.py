"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of narrow rows (at most some 200 bytes) may be broadcast.
BROADCAST_ROWS = 200_000

_written: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of this machine only where that is unset and Spark runs on this machine alone."""
    found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not found and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or f"file://{tempfile.gettempdir()}/sparkway-scratch").rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write and read back: cuts lineage, and survives lost executors."""
    path, schema = f"{root(df.sparkSession)}/sparkway-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    _written.append(path)
    # The driver deletes it when it ends, if nothing did before.
    p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return df.sparkSession.read.schema(schema).parquet(path)


def join_sized(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join that broadcasts `right` only after it was written and counted; past `limit` it is a shuffled join."""
    right = materialize(right)
    few = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if few else right, keys, how)


def folder(spark: SparkSession) -> str:
    """A new folder among the scratch tables, deleted when the driver ends."""
    path = f"{root(spark)}/sparkway-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    fs.delete(p, True)
    return path


def drop_all(spark: SparkSession) -> None:
    """Delete the tables written so far; only when nothing reads them any more."""
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        p = fs.Path(_written.pop())
        p.getFileSystem(conf).delete(p, True)

"""Shared pieces: scratch tables, bounded samples, size-checked joins."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of narrow rows (at most some 200 bytes) may be broadcast.
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch, at most: texts of a batch are held by the JVM and by the worker.
BATCH_ROWS = 4000

_written: dict[str, list[str]] = {}


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most `BATCH_ROWS` rows in this session, unless it has smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of this machine only where the session names none and runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/sparkway-scratch"
    return root.rstrip("/")


def materialize(df: DataFrame, scope: str = "default") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/sparkway-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.setdefault(scope, []).append(path)
    delete_on_exit(spark, path)
    return spark.read.schema(schema).parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """The driver deletes the folder when it ends, if nothing did before."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_scratch(spark: SparkSession, scope: str = "default") -> None:
    """Delete the tables that `materialize` wrote for `scope`; only when nothing reads them any more."""
    for path in _written.pop(scope, []):
        delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_sized(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join that broadcasts `right` only after counting it; past `limit` it is a shuffled join.

    `right` should be materialized. Skewed shuffled joins are split by adaptive execution.
    """
    few = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if few else right.hint("merge"), keys, how)


def id_filter(ids: DataFrame, most: int = 1 << 27) -> tuple[int, Broadcast]:
    """A Bloom filter of one hash over the longs of `ids`: its number of bits, and its words, broadcast.

    Sixteen bits an id up to `most` (16 MB); beyond that more rows pass. What passes is for an exact join.
    """
    spark = ids.sparkSession
    bits = min(most, 1 << max(16, (16 * ids.count()).bit_length()))
    (name,) = ids.columns
    at = ids.select(F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(bits)).alias("h"))
    found = at.groupBy(F.expr("shiftright(h, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("w").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits, spark.sparkContext.broadcast(words)


def passes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Flags of places (`pmod(xxhash64(id), bits)`) that the filter lets through."""
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added where a table already has them (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def release() -> None:
    """Gives memory that is free back to the system: workers outlive their tasks, and several share a machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """`mapInArrow`, with the worker's free memory given back at the end of a partition."""

    def whole(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(whole, schema)


def worker_cache() -> dict:
    """Lives as long as the Python worker, across tasks."""
    return sys.__dict__.setdefault("_sparkway_cache", {})

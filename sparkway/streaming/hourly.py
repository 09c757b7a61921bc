"""Structured Streaming: hourly means, sessions per vehicle, the latest values, the event log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def replayed(events: DataFrame, path: str, files: int = 3) -> DataFrame:
    """A table of SCHEMA as a stream of some files, a range of time each, read in the order of time.

    Sources take files by their times of change, and tasks that write side by side end in
    any order: the files are given times in the order of their ranges.
    """
    spark = events.sparkSession
    events.withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(files, "ts").write.parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((x.getPath() for x in fs.listStatus(p) if x.getPath().getName().startswith("part-")), key=lambda x: x.getName())
    start = fs.getFileStatus(p).getModificationTime() - 10_000 * len(parts)
    for i, part in enumerate(parts):
        fs.setTimes(part, start + 10_000 * i, -1)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def hourly_means(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Mean per segment and hour; an hour is final once the watermark passed it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), F.col("user_id").alias("seg")).agg(F.avg("value").alias("speed"), F.count("*").alias("n")).select("seg", F.col("window.start").alias("hr"), "speed", "n")


def gaps(stream: DataFrame, idle: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of activity per segment, ended by `idle`."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", idle).alias("w"), F.col("user_id").alias("seg")).agg(F.count("*").alias("n")).select("seg", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def open_hours(events: DataFrame, closed: DataFrame) -> DataFrame:
    """Hours that `hourly_means` has not closed yet, from a batch read of the same events: those after the last closed one, and earlier ones that it lacks."""
    every = events.groupBy(F.col("user_id").alias("seg"), F.date_trunc("hour", "ts").alias("hr")).agg(F.avg("value").alias("speed"), F.count("*").alias("n"))
    return every.join(closed.select("seg", "hr"), ["seg", "hr"], "left_anti")


SESSION = "vehicle string, first_s double, elapsed_s double, node string, updates long, late long, reroutes long, ended boolean"
VALUE = "first_s double, elapsed_s double, node string, updates long, late long, reroutes long"
FIELDS = ["first_s", "elapsed_s", "node", "updates", "late", "reroutes"]


def sessions_of(rows: pd.DataFrame, before: tuple | None, idle_s: float) -> pd.DataFrame:
    """Sessions of one vehicle's messages after a state: FIELDS, in order; all but the last have ended.

    Messages earlier than the state are counted as late and move nothing; of those without
    a time, the same. A pause of more than `idle_s` begins a session.
    """
    return pd.DataFrame(session_rows(rows, before, idle_s), columns=FIELDS)


def session_rows(rows: pd.DataFrame, before: tuple | None, idle_s: float) -> list[tuple]:
    """The rows of `sessions_of`, without a table: there is one call a vehicle and micro-batch."""
    at = rows["elapsed_s"].to_numpy(dtype=float, na_value=np.nan)
    late = np.isnan(at) if before is None else np.isnan(at) | (at < before[1])
    new, n_late = np.flatnonzero(~late), int(late.sum())
    by = (rows["seq"].to_numpy()[new], at[new]) if "seq" in rows else (at[new],)
    new = new[np.lexsort(by)]
    at, node, turned = at[new], rows["node"].to_numpy(dtype=object)[new], rows["kind"].to_numpy(dtype=object)[new] == "ROUTE_UPDATE"
    out, start = [], 0
    for end in [*(np.flatnonzero(np.diff(at) > idle_s) + 1).tolist(), len(at)] if len(at) else []:
        # The last node that is known.
        last = next((x for x in node[start:end][::-1] if not pd.isna(x)), None)
        out.append((float(at[start]), float(at[end - 1]), last, end - start, 0, int(turned[start:end].sum())))
        start = end
    if before is not None:
        if out and not out[0][0] - before[1] > idle_s:  # the first run goes on from the state
            first = out[0]
            out[0] = before[0], first[1], first[2], first[3] + before[3], before[4], first[5] + before[5]
        else:
            out.insert(0, tuple(before))
    if n_late:
        first = out[0] if out else (None, None, None, 0, 0, 0)
        out[:1] = [(*first[:3], int(first[3]) + n_late, int(first[4]) + n_late, first[5])]
    return out


class Sessions(StatefulProcessor):
    """Session state of each vehicle in one value; a timer ends it when the watermark has passed its last message by `idle_s`, and its state goes."""

    def __init__(self, idle_s: float) -> None:
        self.idle_s = idle_s

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("session", VALUE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, before = list(rows), self.state.get() if self.state.exists() else None
        found = session_rows(parts[0] if len(parts) == 1 else pd.concat(parts), before, self.idle_s)
        last = found[-1]
        old, new = (None if x is None or x[1] is None else self.timer(x[1]) for x in (before, last))
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is None:  # only messages without a time so far
            self.state.clear()
        else:
            self.state.update((last[0], last[1], last[2], int(last[3]), int(last[4]), int(last[5])))
            if old != new:
                self.handle.registerTimer(new)
        yield self.shown(key, pd.DataFrame(found, columns=FIELDS), [*[True] * (len(found) - 1), False])

    def timer(self, last_s: float) -> int:
        return int((last_s + self.idle_s) * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            found = pd.DataFrame([self.state.get()], columns=FIELDS)
            self.state.clear()
            yield self.shown(key, found, [True])

    def close(self) -> None:
        pass

    def shown(self, key, found: pd.DataFrame, ended: list[bool]) -> pd.DataFrame:
        out = found.assign(vehicle=key[0], ended=ended)
        return out.astype({"first_s": "float64", "elapsed_s": "float64", "updates": "int64", "late": "int64", "reroutes": "int64"})[["vehicle", *FIELDS, "ended"]]


def vehicles(messages: DataFrame, idle: float = 1800.0, late: str = "2 hours") -> DataFrame:
    """Sessions of each vehicle from its messages (vehicle, kind, node, ts): a row for each that a micro-batch changed or ended; times in seconds of the epoch.

    Messages of one time come in the order of `seq`, if they have such a column. Those
    without a vehicle are left out: they are nobody's. State holds the sessions
    that are open by the watermark, and nothing else.
    """
    known = messages.where("vehicle is not null").withColumn("elapsed_s", F.unix_micros("ts") / 1e6).withWatermark("ts", late)
    return known.groupBy("vehicle").transformWithStateInPandas(Sessions(idle), SESSION, "Update", "EventTime")


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session with the state store that values with timers need."""
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    return spark


#: Parts of the latest table, each rewritten only when a micro-batch has rows of it.
BUCKETS = 16


def latest_table(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Last value per segment: each micro-batch is reduced, and merged by key with the buckets of the table that it has rows of, as their next version.

    Buckets are written whole under their epoch, so a repeated epoch gives the same table;
    those that no row falls in stay as they are.
    """

    def keep(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")
        rows = batch.select("user_id", "ts", "event_id", F.col("value").alias("speed"), bucket.alias("bucket"))
        touched = {r.bucket for r in rows.select("bucket").distinct().collect()}  # no more than there are buckets
        before = _parts(spark, path, epoch)
        old = [before[b] for b in sorted(touched & set(before))]
        if old:
            rows = rows.unionByName(spark.read.option("basePath", path).parquet(*old).select("user_id", "ts", "event_id", "speed", F.col("bucket").cast("int")))
        newest = rows.groupBy("bucket", "user_id").agg(F.max(F.struct("ts", "event_id", "speed")).alias("_m")).select("bucket", "user_id", "_m.*")
        newest.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/epoch={epoch}")
        for part in old:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def _parts(spark: SparkSession, path: str, below: int | None = None) -> dict[int, str]:
    """The folder of each bucket's newest version, of complete epochs (under `below`)."""
    fs_ = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = fs_.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_.Path(path)):
        return {}
    names = [x.getPath().getName() for x in fs.listStatus(fs_.Path(path))]
    done = sorted(int(n[6:]) for n in names if n.startswith("epoch=") and fs.exists(fs_.Path(f"{path}/{n}/_SUCCESS")))
    out = {}
    for epoch in (n for n in done if below is None or n < below):
        for x in fs.listStatus(fs_.Path(f"{path}/epoch={epoch}")):
            if x.getPath().getName().startswith("bucket="):
                out[int(x.getPath().getName()[7:])] = f"{path}/epoch={epoch}/{x.getPath().getName()}"
    return out


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every bucket: user_id, ts, event_id, speed."""
    return spark.read.option("basePath", path).parquet(*_parts(spark, path).values()).select("user_id", "ts", "event_id", "speed")


def last_states(states: DataFrame, path: str, checkpoint: str):
    """Updated states of each micro-batch, under its epoch."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)


def event_log(stream: DataFrame, path: str, checkpoint: str):
    """Append-only log of events, exactly once."""
    return stream.select("event_id", "ts", F.col("user_id").alias("source"), F.col("event_type").alias("type"), "props").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")

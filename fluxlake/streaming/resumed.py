"""Streams that can be stopped anywhere: a sentinel on keyed state with event-time timers, newest-wins upserts, and what was read with its fingerprints.

Sinks write a folder for each micro-batch, so a batch that is run again after a failure replaces
what it wrote before: results are those of an unbroken run, none twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..fixtures import table
from ..model import q
from ..registry import query
from ..sources.stores import shared_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs the store that can list it, and a batch commits what it changed, not the whole store; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in (_PROVIDER, _CHANGES)}
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(_CHANGES, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batch_sink(out: str, after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch to its own folder; `after` is called with its number when it is written."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if after:
            after(number)

    return write


def run_to_end(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Takes all that is there since the checkpoint, and ends."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


ALARM = "run long, since_us long, t_us long, low_count long"


_WAITING = np.dtype([("run", "<i8"), ("us", "<i8"), ("event_id", "<i8"), ("c", "<i8")])
_SPELL = np.dtype([("run", "<i8"), ("since", "<i8"), ("n", "<i8")])
#: 2 to this power runs with neighbouring numbers share a state, so that a call to the store serves many rows; states grow in number with the runs, not in size.
BLOCK_BITS = 6


def spells(rows: np.ndarray, before: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (as _WAITING) in order of run and time; since when each row's run is low and how many rows of that (0 if it is not); and the spells (as _SPELL, ascending) open after them, if those `before` were open."""
    rows = rows[np.lexsort((rows["event_id"], rows["us"], rows["run"]))]
    run, is_low = rows["run"], rows["c"] < low
    head, last = np.ones(len(rows), bool), np.ones(len(rows), bool)
    head[1:] = last[:-1] = run[1:] != run[:-1]
    first = head.copy()
    first[1:] |= ~is_low[:-1]
    place = np.arange(len(rows))
    start = np.maximum.accumulate(np.where(first, place, 0))
    since, n = rows["us"].copy(), np.zeros(len(rows), np.int64)
    if len(before):  # a run's first spell goes on from before
        at = np.minimum(np.searchsorted(before["run"], run), len(before) - 1)
        on = head & (before["run"][at] == run)
        since[on], n[on] = before["since"][at[on]], before["n"][at[on]]
    since, n = since[start], np.where(is_low, n[start] + place - start + 1, 0)
    here = last & is_low
    now = np.empty(int(here.sum()), _SPELL)
    now["run"], now["since"], now["n"] = run[here], since[here], n[here]
    now = np.concatenate([before[~np.isin(before["run"], run)], now])
    return rows, since, n, now[np.argsort(now["run"])]


class Sentinel(StatefulProcessor):
    """An alarm for each row that makes a run's low spell longer than allowed, in time order.

    State of a block of runs, packed: since when each run is low and how many rows of that, and the rows
    that wait for the watermark. A timer at the earliest waiting row wakes the block once rows up to
    there are complete: rows that come late, but before that, take their place; later ones Spark
    leaves out."""

    def __init__(self, low: int, longest_us: int):
        self.low, self.longest = low, longest_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spells = handle.getValueState("spells", "packed binary")
        self.waiting = handle.getListState("waiting", "packed binary")

    def _wake(self, first_us: int) -> None:
        self.handle.registerTimer(int(first_us) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for part in rows:
            if len(part):
                packed = np.empty(len(part), _WAITING)
                for c in _WAITING.names:
                    packed[c] = part[c].to_numpy()
                self.waiting.appendValue((packed.tobytes(),))
                first.append(packed["us"].min())
        if first:
            self._wake(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = np.concatenate([np.empty(0, _WAITING), *(np.frombuffer(w[0], _WAITING) for w in (self.waiting.get() if self.waiting.exists() else ()))])
        due = rows["us"] < mark
        if not due.any():  # an earlier timer took them
            if len(rows):
                self._wake(rows["us"].min())
            return
        rest = rows[~due]
        before = np.frombuffer(self.spells.get()[0], _SPELL) if self.spells.exists() else np.empty(0, _SPELL)
        done, since, n, now = spells(rows[due], before, self.low)
        self.spells.update((now.tobytes(),))
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
            self._wake(rest["us"].min())
        else:
            self.waiting.clear()
        out = (n > 0) & (done["us"] - since > self.longest)
        if out.any():
            yield pd.DataFrame({"run": done["run"][out], "since_us": since[out], "t_us": done["us"][out], "low_count": n[out]})

    def close(self) -> None:
        pass


def alarms(events: DataFrame, delay: str = "2 days", low: int = 5000, longest_us: int = 14_400_000_000) -> DataFrame:
    """The sentinel over a stream of events (event_id, ts, user_id, value), by user. Rows up to `delay` late count; rows without a time have no place and are left out."""
    e = events.where("ts is not null and (user_id is not null or event_id is null)").withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", delay)
    rows = e.select(F.coalesce("user_id", F.lit(-1).cast("long")).alias("run"), F.coalesce("event_id", F.lit(-1).cast("long")).alias("event_id"), F.unix_micros("time").alias("us"), F.coalesce(q("value", 100), F.lit(low).cast("long")).alias("c"), "time")
    blocks = rows.withColumn("block", F.shiftright("run", BLOCK_BITS))
    return blocks.groupBy("block").transformWithStateInPandas(Sentinel(low, longest_us), ALARM, "append", "eventTime")


def closing(spark: SparkSession, after, schema) -> DataFrame:
    """One row without a run, far after the others: it says that no rows before it are still to come."""
    return spark.createDataFrame([(None, after)], "event_id long, ts timestamp_ntz").select(*(F.col(f.name) if f.name in ("event_id", "ts") else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def upsert(path: str, key: list[str], order: list[str], after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink of status rows, the newest of a key winning. Batch n merges its rows with version n - 1 into version n, so a batch that is run again finds what it found before; readers take the highest version."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/version={number - 1}").unionByName(batch)
        columns = batch.columns
        newest = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row"))
        newest.select(*(F.col(f"row.{c}").alias(c) for c in columns)).write.mode("overwrite").parquet(f"{path}/version={number}")
        if after:
            after(number)

    return write


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the highest version."""
    found = spark.read.parquet(path)
    last = found.agg(F.max("version")).first()[0]
    return spark.read.schema(schema).parquet(f"{path}/version={last}")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, md5) of the Parquet files in a folder."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.md5("content").alias("md5"))


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files that a run has read and that are not what they were: a stream resumed over them would mix two sources."""
    n = now.select("file", F.col("md5").alias("now"))
    return before.join(n, "file", "left").where(~F.col("md5").eqNullSafe(F.col("now"))).select("file", F.when(F.col("now").isNull(), "gone").otherwise("changed").alias("what"))


# --- queries


def _deliveries(spark, sf_dir, path: str, closed: bool) -> Iterator[StructType]:
    """The events in four deliveries in the order of arrival, half of the rows a day late. Whoever takes them reads one before the next is written, so that a delivery may have many files."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    arrival = F.when(F.col("event_id") % 2 == 0, us + 86_400_000_000).otherwise(us)
    lo, hi, last = e.agg(F.min(arrival), F.max(arrival), F.max(F.col("ts") + F.expr("INTERVAL 10 DAYS"))).first()
    parts = e.withColumn("part", F.floor((arrival - (lo or 0)) * 4 / ((hi or 0) - (lo or 0) + 1)))
    for p in range(4):
        parts.where(F.col("part") == p).drop("part").write.mode("append").parquet(path)
        yield e.schema
    if closed:
        closing(spark, last, e.schema).write.mode("append").parquet(path)
        yield e.schema


@query("st_sentinel_keyed", """SELECT run, since_us, t_us, low_count FROM (SELECT run, us AS t_us, min(us) OVER w AS since_us, row_number() OVER w AS low_count FROM (
    SELECT *, sum(CASE WHEN c >= 5000 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY us, event_id) AS island FROM (SELECT user_id AS run, event_id, epoch_us(ts) AS us, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c FROM events)
  ) WHERE c < 5000 WINDOW w AS (PARTITION BY run, island ORDER BY us, event_id)) WHERE t_us - since_us > 14400000000""")
def st_sentinel_keyed(spark, sf_dir):
    """Alarms of every run from four deliveries that arrive out of order, with a stop and a restart after each."""
    path, out, checkpoint = (shared_path(spark, x) for x in ("arrivals", "alarms", "alarms-state"))
    with keyed_state(spark):
        for schema in _deliveries(spark, sf_dir, path, closed=True):
            run_to_end(alarms(spark.readStream.schema(schema).parquet(path)), checkpoint, batch_sink(out))
        run_to_end(alarms(spark.readStream.schema(schema).parquet(path)), checkpoint, batch_sink(out))  # nothing is new
    return spark.read.schema(ALARM).parquet(out).select("run", "since_us", "t_us", "low_count")


@query("st_status_upsert", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def st_status_upsert(spark, sf_dir):
    """The last status of every user, merged over four micro-batches."""
    path, out, checkpoint = (shared_path(spark, x) for x in ("arrivals", "status", "status-state"))
    for schema in _deliveries(spark, sf_dir, path, closed=False):
        s = spark.readStream.schema(schema).parquet(path).select("user_id", "event_id", "ts", F.col("event_type").alias("status"))
        run_to_end(s, checkpoint, upsert(out, ["user_id"], ["ts", "event_id"]))
    return current(spark, out, s.schema).select("user_id", "status", "event_id")

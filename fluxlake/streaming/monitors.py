"""Stateful monitors on Structured Streaming: event-time windows, sessions, deduplication, running statistics and the sentinel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import q
from ..registry import query
from ..sources.stores import shared_path


def event_stream(spark: SparkSession, sf_dir: str, late: str = "1 day", files: int | None = None) -> DataFrame:
    """The events as a stream of files, with a watermark; so many files a micro-batch, all at once if not given."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema)
    if files:
        s = s.option("maxFilesPerTrigger", files)
    s = s.parquet(path + "*")
    return s.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns its result: the last state in complete mode, every row in append mode."""
    spark = stream.sparkSession
    out, check = shared_path(spark, "stream"), shared_path(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again writes its own folder again.
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)  # without the folders' batch


_W = "CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT)"


@query("st_tumbling", f"SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) // 1000000 AS start_s, count(*) AS n, {_W} AS cents FROM events GROUP BY ALL")
def st_tumbling(spark, sf_dir):
    g = event_stream(spark, sf_dir).groupBy("event_type", F.window("time", "6 hours")).agg(F.count("*").alias("n"), F.sum(q("value", 100)).alias("cents"))
    return drain(g.select("event_type", F.col("window.start").cast("long").alias("start_s"), "n", "cents"), "complete")


@query("st_sliding", f"SELECT s AS start_s, count(*) AS n FROM (SELECT epoch_us(ts) // 1000000 AS t, unnest([epoch_us(ts) // 1000000 // 21600 * 21600 - 21600, epoch_us(ts) // 1000000 // 21600 * 21600]) AS s FROM events) GROUP BY s")
def st_sliding(spark, sf_dir):
    g = event_stream(spark, sf_dir).groupBy(F.window("time", "12 hours", "6 hours")).agg(F.count("*").alias("n"))
    return drain(g.select(F.col("window.start").cast("long").alias("start_s"), "n"), "complete")


@query("st_session", "SELECT user_id, min(u) AS first_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN u - prev >= 21600000000 OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY u) AS s FROM (SELECT user_id, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY user_id, s")
def st_session(spark, sf_dir):
    """Sessions of a user, which end after six hours without an event."""
    g = event_stream(spark, sf_dir).groupBy("user_id", F.session_window("time", "6 hours")).agg(F.count("*").alias("n"), F.min(F.unix_micros("time")).alias("first_us"))
    return drain(g.select("user_id", "first_us", "n"), "complete")


@query("st_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY ALL")
def st_dedup(spark, sf_dir):
    rows = drain(event_stream(spark, sf_dir).select("user_id", "event_type", "time").dropDuplicates(["user_id", "event_type", "time"]), "append")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("st_running_stats", "SELECT event_type, count(*) AS n, CAST(floor(min(value) * 100 + 0.5) AS BIGINT) AS lo, CAST(floor(max(value) * 100 + 0.5) AS BIGINT) AS hi, CAST(floor(avg(value) * 1e4 + 0.5) AS BIGINT) AS mean_q, CAST(floor(stddev_pop(value) * 1e4 + 0.5) AS BIGINT) AS std_q FROM events GROUP BY event_type")
def st_running_stats(spark, sf_dir):
    """Mergeable moments, kept up to date."""
    v = F.col("value")
    g = event_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), q(F.min(v), 100).alias("lo"), q(F.max(v), 100).alias("hi"), q(F.avg(v), 1e4).alias("mean_q"), q(F.stddev_pop(v), 1e4).alias("std_q"))
    return drain(g, "complete")


@query("st_stream_static_join", "SELECT c_mktsegment, count(*) AS n FROM events JOIN customer ON c_custkey = user_id GROUP BY ALL")
def st_stream_static_join(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return drain(event_stream(spark, sf_dir).join(c, "user_id").groupBy("c_mktsegment").agg(F.count("*").alias("n")), "complete")


SENTINEL = "seed long, since_us long, t_us long, low_count long"


def sentinel(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: since when the level has been low, and how many rows of it. An alarm row for each row that makes it longer than allowed. A key's rows of one micro-batch come in several chunks, in any order: they are put in order together, 24 bytes a row."""
    since, count = state.get if state.exists else (-1, 0)
    us, event, c = (np.concatenate(v) for v in zip(*((b["us"].to_numpy(), b["event_id"].to_numpy(), b["c"].to_numpy()) for b in batches), strict=True))
    order = np.lexsort([event, us])
    out = []
    for t, low in zip(us[order].tolist(), (c[order] < 5000).tolist(), strict=True):
        if not low:
            since, count = -1, 0
            continue
        since, count = (t, 1) if since < 0 else (since, count + 1)
        if t - since > 14_400_000_000:
            out.append((key[0], since, t, count))
    state.update((int(since), int(count)))
    yield pd.DataFrame(out, columns=["seed", "since_us", "t_us", "low_count"])


def alarms(events: DataFrame) -> DataFrame:
    """The sentinel over a stream of events, by seed."""
    s = events.select((F.col("user_id") % 10).alias("seed"), "event_id", F.unix_micros("time").alias("us"), q("value", 100).alias("c"))
    return s.groupBy("seed").applyInPandasWithState(sentinel, SENTINEL, "since long, n long", "append", GroupStateTimeout.NoTimeout)


@query("st_sentinel", """SELECT seed, since_us, t_us, low_count FROM (SELECT seed, us AS t_us, min(us) OVER w AS since_us, row_number() OVER w AS low_count FROM (
    SELECT *, sum(CASE WHEN c >= 5000 THEN 1 ELSE 0 END) OVER (PARTITION BY seed ORDER BY us, event_id) AS island FROM (SELECT user_id % 10 AS seed, event_id, epoch_us(ts) AS us, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c FROM events)
  ) WHERE c < 5000 WINDOW w AS (PARTITION BY seed, island ORDER BY us, event_id)) WHERE t_us - since_us > 14400000000""")
def st_sentinel(spark, sf_dir):
    return drain(alarms(event_stream(spark, sf_dir)), "append")


@query("st_batch_session", "SELECT user_id, min(u) AS first_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN u - prev >= 21600000000 OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY u) AS s FROM (SELECT user_id, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY user_id, s")
def st_batch_session(spark, sf_dir):
    """The batch twin of the sessions."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("time", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("time", "6 hours")).agg(F.min(F.unix_micros("time")).alias("first_us"), F.count("*").alias("n")).select("user_id", "first_us", "n")

"""Watches runs whose time series grow: takes the rows that are new, keeps daily statistics, says which runs are steady.

    python -m jobs.watch_runs --config jobs/watch_runs.json --events 'IN/events/' --output OUT --checkpoint CHECK

The input is a folder (or glob) of Parquet files with event_id, ts, user_id and value: a run is a user_id, its
level is the value, in whole hundredths. The job reads it as a stream of files, takes what its checkpoint
does not know yet, and ends. It can be started after each delivery; without new files it changes nothing.

In OUT:

* `partials`, by batch and day: for each run of a micro-batch its rows, sum, sum of squares, least, most,
  first and last level; rows that lack a run, time or level are counted without day and run. A batch that is run again after a failure replaces its own folder;
* `daily`, by day: the partials of all batches merged. Only days that a batch touched are written anew
  (dynamic partition overwrite), so late rows need no watermark: they mend their day;
* `batches`, by batch: rows taken, and rows of these set aside for a null run, time or level;
* `verdicts`: for each run its days, rows and drift, and the first that holds of `short` (fewer days than
  `least_days`), `gap` (a day without rows between its first and last), `drift` (the means of its
  first and last `window_days` days differ by more than `drift_limit` of its mean) and `steady`.

Rows of one run and day are aggregated before they are shuffled, so a run with a third of all rows is no
hot spot; windows run over daily rows, never over events. A file taken once is not taken
again, even if it is replaced: deliveries add files.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxlake.model import q

from .common import command_line_session, config, logger

log = logger("watch_runs")

EVENTS = "event_id long, ts timestamp_ntz, user_id long, value double"
_LEVEL = "struct<ts: timestamp_ntz, event_id: bigint, c: bigint>"
_STATS = f"run long, n long, s1 decimal(38,0), s2 decimal(38,0), lo long, hi long, first {_LEVEL}, last {_LEVEL}"
PARTIALS, DAILY = f"{_STATS}, batch long, day date", f"{_STATS}, day date"


@dataclass
class Config:
    files_per_batch: int = 16
    window_days: int = 3
    least_days: int = 7
    drift_limit: float = 0.25

    def __post_init__(self):
        if min(self.files_per_batch, self.window_days, self.least_days) < 1 or self.drift_limit < 0:
            raise ValueError("counts must be 1 at least and the drift limit not below 0")


def partial(events: DataFrame) -> DataFrame:
    """Mergeable statistics of each run and day; rows that lack a run, time or level count under no run and no day."""
    usable = F.col("user_id").isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")
    if_usable = lambda x, name: F.when(usable, x).alias(name)
    c = q("value", 100)
    rows = events.select(if_usable(F.col("user_id"), "run"), if_usable(F.to_date("ts"), "day"), if_usable(c, "c"), if_usable(F.struct("ts", "event_id", c.alias("c")), "level"))
    d = F.col("c").cast("decimal(19,0)")
    return rows.groupBy("day", "run").agg(F.count("*").alias("n"), F.sum(d).cast("decimal(38,0)").alias("s1"), F.sum(d * d).cast("decimal(38,0)").alias("s2"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("level").alias("first"), F.max("level").alias("last"))


def merged(partials: DataFrame) -> DataFrame:
    """Statistics of each run and day from those of parts of its rows."""
    return partials.groupBy("day", "run").agg(F.sum("n").alias("n"), F.sum("s1").cast("decimal(38,0)").alias("s1"), F.sum("s2").cast("decimal(38,0)").alias("s2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), F.max("last").alias("last"))


def verdicts(daily: DataFrame, c: Config) -> DataFrame:
    """run, days, n, drift (millionths of the mean) and verdict of each run."""
    by_day = Window.partitionBy("run").orderBy("day")
    d = daily.select("run", "day", "n", "s1", F.row_number().over(by_day).alias("up"), F.row_number().over(by_day.orderBy(F.desc("day"))).alias("down"))

    def mean(of: Column | None = None) -> Column:
        part = lambda x: F.sum(F.col(x) if of is None else F.when(of, F.col(x))).cast("double")
        return part("s1") / part("n")

    r = d.groupBy("run").agg(
        F.count("*").alias("days"), F.sum("n").alias("n"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("span"), mean().alias("mean"),
        mean(F.col("up") <= c.window_days).alias("start"), mean(F.col("down") <= c.window_days).alias("end"),
    )
    drift = F.when(F.col("mean") != 0, F.floor((F.col("end") - F.col("start")) / F.col("mean") * 1e6 + 0.5).cast("long"))
    verdict = (
        F.when(F.col("days") < c.least_days, "short").when(F.col("span") > F.col("days"), "gap")
        .when(F.abs("drift") > F.lit(int(c.drift_limit * 1e6)), "drift").otherwise("steady")
    )
    return r.withColumn("drift", drift).select("run", "days", "n", "drift", verdict.alias("verdict"))


def run(spark: SparkSession, events: str, output: str, checkpoint: str, c: Config | None = None) -> dict[str, int]:
    """Takes the files that the checkpoint does not know and returns how many rows were taken and set aside."""
    c = c or Config()
    report = {"batches": 0, "rows": 0, "rejected": 0}
    spark.createDataFrame([], DAILY).write.mode("append").partitionBy("day").parquet(f"{output}/daily")  # there, if empty

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        partial(batch).write.mode("overwrite").partitionBy("day").parquet(f"{output}/partials/batch={number}")
        parts = session.read.schema(PARTIALS).parquet(f"{output}/partials")
        own = parts.where(F.col("batch") == number)
        touched = own.where("day is not null").select("day").distinct()
        merged(parts.join(touched, "day", "left_semi")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{output}/daily")
        taken, rejected = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("day").isNull(), F.col("n"))), F.lit(0))).first()
        session.range(1).select(F.lit(taken).alias("rows"), F.lit(rejected).alias("rejected")).coalesce(1).write.mode("overwrite").parquet(f"{output}/batches/batch={number}")
        for k, v in (("batches", 1), ("rows", taken), ("rejected", rejected)):
            report[k] += v
        log.info("batch %s: took %s rows, set %s aside", number, taken, rejected)

    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", c.files_per_batch).parquet(events)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    verdicts(spark.read.schema(DAILY).parquet(f"{output}/daily"), c).write.mode("overwrite").parquet(f"{output}/verdicts")
    log.info("read %s new rows of %s in %s batches, wrote %s", report["rows"], events, report["batches"], output)
    return report


def whole_output(spark: SparkSession, output: str) -> DataFrame:
    """Daily statistics and verdicts as rows of one shape."""
    number, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    daily = spark.read.schema(DAILY).parquet(f"{output}/daily").select("run", F.col("day").cast("string").alias("day"), F.col("n").cast("long").alias("n"), F.col("s1").cast("long").alias("s1"), F.col("s2").cast("long").alias("s2"), "lo", "hi", F.col("first.c").alias("first"), F.col("last.c").alias("last"), number.alias("days"), number.alias("drift"), text.alias("verdict"))
    runs = spark.read.parquet(f"{output}/verdicts").select("run", text.alias("day"), F.col("n").cast("long"), *[number] * 6, "days", "drift", "verdict")
    return daily.union(runs)


def job2_watch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxlake.sources.stores import shared_path

    output = shared_path(spark, "watch")
    for _ in range(2):  # the second run finds nothing new
        run(spark, f"{sf_dir}/events.parquet*", f"{output}/out", f"{output}/checkpoint")
    return whole_output(spark, f"{output}/out")


ORACLE = """WITH e AS (SELECT user_id AS run, CAST(ts AS DATE) AS day, ts, event_id, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
  daily AS (SELECT run, day, count(*) AS n, CAST(sum(c) AS BIGINT) AS s1, CAST(sum(c * c) AS BIGINT) AS s2, min(c) AS lo, max(c) AS hi, arg_min(c, (ts, event_id)) AS first, arg_max(c, (ts, event_id)) AS last FROM e GROUP BY run, day),
  d AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY day) AS up, row_number() OVER (PARTITION BY run ORDER BY day DESC) AS down FROM daily),
  r AS (SELECT run, count(*) AS days, CAST(sum(n) AS BIGINT) AS n, date_diff('day', min(day), max(day)) + 1 AS span, CAST(sum(s1) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS mean,
      CAST(sum(s1) FILTER (up <= 3) AS DOUBLE) / CAST(sum(n) FILTER (up <= 3) AS DOUBLE) AS "start", CAST(sum(s1) FILTER (down <= 3) AS DOUBLE) / CAST(sum(n) FILTER (down <= 3) AS DOUBLE) AS "end" FROM d GROUP BY run),
  v AS (SELECT *, CASE WHEN mean <> 0 THEN CAST(floor(("end" - "start") / mean * 1e6 + 0.5) AS BIGINT) END AS drift FROM r)
SELECT run, CAST(day AS VARCHAR) AS day, n, s1, s2, lo, hi, first, last, NULL::BIGINT AS days, NULL::BIGINT AS drift, NULL AS verdict FROM daily
UNION ALL SELECT run, NULL, n, NULL, NULL, NULL, NULL, NULL, NULL, days, drift, CASE WHEN days < 7 THEN 'short' WHEN span > days THEN 'gap' WHEN abs(drift) > 250000 THEN 'drift' ELSE 'steady' END FROM v"""


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("events", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="JSON file with the settings of Config")
    a = p.parse_args(argv)
    spark = command_line_session("watch_runs")
    try:
        run(spark, a.events, a.output, a.checkpoint, config(spark, Config, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

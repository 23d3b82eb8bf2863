"""Projections of the driver's tables into the data model, in Spark and, as SQL, for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import place, q


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples4(spark, sf_dir) -> DataFrame:
    """Four-channel bulk samples: seed and u, v, w, p in whole millionths."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") % 8).alias("seed"), q("l_quantity").alias("u"), q("l_discount").alias("v"), q("l_tax").alias("w"), q("l_extendedprice").alias("p"))


SAMPLES4 = """samples4 AS (SELECT l_suppkey % 8 AS seed, CAST(floor(l_quantity * 1e6 + 0.5) AS BIGINT) AS u, CAST(floor(l_discount * 1e6 + 0.5) AS BIGINT) AS v,
  CAST(floor(l_tax * 1e6 + 0.5) AS BIGINT) AS w, CAST(floor(l_extendedprice * 1e6 + 0.5) AS BIGINT) AS p FROM lineitem)"""


def run_ts(spark, sf_dir) -> DataFrame:
    """Scalar time series by seed: ord, t (days) and t_us since the first, K and eps; c is K in whole hundredths."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = e.agg(F.min(us).alias("t0"))
    rows = e.select("event_id", (F.col("user_id") % 10).alias("seed"), us.alias("us"), F.col("value").alias("K"), (F.col("value") / (1 + F.col("user_id") % 7)).alias("eps"), q("value", 100).alias("c"))
    w = Window.partitionBy("seed").orderBy("us", "event_id")
    return (
        rows.crossJoin(F.broadcast(first))  # one row
        .select("seed", "event_id", (F.col("us") - F.col("t0")).alias("t_us"), ((F.col("us") - F.col("t0")) / 8.64e10).alias("t"), "K", "eps", "c", (F.row_number().over(w) - 1).alias("ord"))
    )


RUN_TS = """run_ts AS (SELECT seed, event_id, us - (SELECT min(epoch_us(ts)) FROM events) AS t_us, (us - (SELECT min(epoch_us(ts)) FROM events)) / 8.64e10 AS t, K, eps, c,
  CAST(row_number() OVER (PARTITION BY seed ORDER BY us, event_id) - 1 AS INTEGER) AS ord
  FROM (SELECT event_id, user_id % 10 AS seed, epoch_us(ts) AS us, value AS K, value / (1 + user_id % 7) AS eps, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c FROM events))"""


def spectrum(spark, sf_dir) -> DataFrame:
    """Energy spectra by seed: wavenumber k = 1..32 and E."""
    e = table(spark, sf_dir, "events")
    k = (1 + F.col("event_id") % 32).alias("k")
    return e.groupBy((F.col("user_id") % 10).alias("seed"), k).agg(F.sum(q("value", 100)).alias("c")).select("seed", "k", (F.col("c") / (F.col("k") * F.col("k"))).alias("E"))


def spectrum_met(spark, sf_dir) -> DataFrame:
    """Energy spectra by seed, each mode with the place at which the table first has it."""
    e = table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 10).alias("seed"), (1 + F.col("event_id") % 32).alias("k"), q("value", 100).alias("c"), *place())
    met = rows.groupBy("seed", "k", "file").agg(F.sum("c").alias("c"), F.min("row").alias("row"))  # by file, so that the least of a plain number is kept
    modes = met.groupBy("seed", "k").agg(F.sum("c").alias("c"), F.min(F.struct("file", "row")).alias("met"))
    return modes.select("seed", "k", (F.col("c") / (F.col("k") * F.col("k"))).alias("E"), "met")


SPECTRUM = """spectrum AS (SELECT seed, k, CAST(c AS DOUBLE) / (k * k) AS E FROM (SELECT user_id % 10 AS seed, 1 + event_id % 32 AS k, sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS c
  FROM events GROUP BY ALL))"""


def field4(spark, sf_dir) -> DataFrame:
    """4x4x4 fields: frame, ch (0..2 velocity, 3 pressure), z, y, x and the value in whole millionths."""
    e = table(spark, sf_dir, "embeddings")
    pos = e.select(F.floor(F.col("vec_id") / 4).cast("long").alias("frame"), (F.col("vec_id") % 4).cast("int").alias("ch"), F.posexplode("embedding").alias("pos", "value"))
    at = lambda d: F.floor(F.col("pos") / d).cast("int") % 4
    return pos.select("frame", "ch", at(16).alias("z"), at(4).alias("y"), at(1).alias("x"), q("value").alias("q"))


FIELD4 = """field4 AS (SELECT vec_id // 4 AS frame, CAST(vec_id % 4 AS INTEGER) AS ch, CAST((pos - 1) // 16 AS INTEGER) AS z, CAST(((pos - 1) // 4) % 4 AS INTEGER) AS y, CAST((pos - 1) % 4 AS INTEGER) AS x,
  CAST(floor(CAST(embedding[pos] AS DOUBLE) * 1e6 + 0.5) AS BIGINT) AS q FROM embeddings, unnest(range(1, 65)) AS u(pos))"""


def per_seed(spark, sf_dir) -> DataFrame:
    """Manifest rows: case, seed, frames, k_max_eta (null for some) and drift."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    g = j.groupBy(F.col("c_mktsegment").alias("case"), (F.col("o_custkey") % 16).alias("seed")).agg(F.count("*").alias("frames"), F.sum(q("o_totalprice", 100)).alias("cents"))
    eta = F.col("cents") / F.col("frames") / 1e7
    return g.select("case", "seed", "frames", F.when(F.col("seed") % 5 != 4, eta).alias("k_max_eta"), (F.col("cents") % 1000 / 100.0).alias("drift"))


PER_SEED = """per_seed AS (SELECT "case", seed, frames, CASE WHEN seed % 5 <> 4 THEN CAST(cents AS DOUBLE) / frames / 1e7 END AS k_max_eta, (cents % 1000) / 100.0::DOUBLE AS drift FROM (
  SELECT c_mktsegment AS "case", o_custkey % 16 AS seed, count(*) AS frames, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL))"""


def result_rows(spark, sf_dir) -> DataFrame:
    """Result rows: root, model, task, case, nrmse; about a seventh of the keys are missing."""
    li, p, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    g = j.groupBy(F.col("l_linestatus").alias("root"), F.col("p_brand").alias("model"), F.col("l_returnflag").alias("task"), F.col("n_name").alias("case")).agg(
        F.sum(q("l_discount", 100) * q("l_extendedprice", 100)).alias("a"), F.sum(q("l_extendedprice", 100)).alias("b"), F.count("*").alias("n")
    )
    return g.where("n % 7 <> 0").select("root", "model", "task", "case", (F.col("a").cast("double") / F.col("b") / 100.0).alias("nrmse"))


RESULT_ROWS = """result_rows AS (SELECT root, model, task, "case", CAST(a AS DOUBLE) / CAST(b AS DOUBLE) / 100.0::DOUBLE AS nrmse FROM (
  SELECT l_linestatus AS root, p_brand AS model, l_returnflag AS task, n_name AS "case", sum(CAST(floor(l_discount * 100 + 0.5) AS BIGINT) * CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS a,
    sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS b, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) WHERE n % 7 <> 0)"""


def with_(*parts: str, rest: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + rest

"""Schedules, losses and steps of samplers as plain columns: everything about the learned models that needs no weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import place, q
from ..registry import query

#: Groups of keys that are looked at in order, or not, together; as many rows are broadcast at most.
GROUPS = 1 << 18


def mean_in_order(table: DataFrame, key: str, value: Column) -> DataFrame:
    """Means of a value that is not negative, as whole millionths, as if added row by row in the order of the table.

    In any order a mean of n doubles is right to n units of rounding. Only keys for which that leaves two
    results open, with the few others of their groups, have their rows sorted.
    """
    columns = [F.col(key), F.xxhash64(key).bitwiseAND(F.lit(GROUPS - 1)).alias("g"), value.alias("x")]
    means = table.select(*columns).groupBy(key, "g").agg(F.avg("x").alias("m"), (F.count("x") * 2.0**-51).alias("slack"))
    least, most = (q(F.col("m") * (1 + sign * F.col("slack"))) for sign in (-1, 1))
    unsettled = F.broadcast(means.where(~least.eqNullSafe(most)).select("g").distinct())
    rows = table.select(*columns, *place()).join(unsettled, "g", "left_semi")
    w = Window.partitionBy(key).orderBy("file", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_order = rows.withColumn("m", F.avg("x").over(w)).groupBy(key).agg(q(F.max_by("m", F.struct("file", "row"))).alias("mean_q"))
    # A left join, since an anti join would be done before the means, which would be taken once more for it.
    settled = means.join(unsettled.withColumn("unsettled", F.lit(True)), "g", "left").where("unsettled IS NULL")
    return settled.select(key, least.alias("mean_q")).unionByName(in_order)


@query("loss_smooth_l1", "SELECT l_suppkey, CAST(floor(avg(CASE WHEN abs(d) < 1 THEN 0.5 * d * d ELSE abs(d) - 0.5 END) * 1e6 + 0.5) AS BIGINT) AS loss_q FROM (SELECT l_suppkey, (l_quantity - 25) / 10 AS d FROM lineitem) GROUP BY l_suppkey")
def loss_smooth_l1(spark, sf_dir):
    """A mean of doubles depends on the order of its rows where it lies on the edge of the last digit: there it is taken in the order of the table."""
    d = (F.col("l_quantity") - 25) / 10
    loss = F.when(F.abs(d) < 1, 0.5 * d * d).otherwise(F.abs(d) - 0.5)
    return mean_in_order(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", loss).withColumnRenamed("mean_q", "loss_q")


@query("loss_nested_reduction", "SELECT CAST(floor(avg(s) * 1e4 + 0.5) AS BIGINT) AS loss_q FROM (SELECT l_suppkey, sum(m) AS s FROM (SELECT l_suppkey, l_linenumber, avg(l_quantity * l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY l_suppkey)")
def loss_nested_reduction(spark, sf_dir):
    """Mean over space, sum over time and channels, mean over the batch."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    m = li.groupBy("l_suppkey", "l_linenumber").agg(F.avg(F.col("l_quantity") * F.col("l_quantity")).alias("m"))
    return m.groupBy("l_suppkey").agg(F.sum("m").alias("s")).agg(q(F.avg("s"), 1e4).alias("loss_q"))


@query("step_modulation", "SELECT vec_id, CAST(floor((embedding[1]::DOUBLE * (1 + embedding[2]::DOUBLE) + embedding[3]::DOUBLE) * 1e6 + 0.5) AS BIGINT) AS h_q FROM embeddings")
def step_modulation(spark, sf_dir):
    """Adaptive normalisation h (1 + scale) + shift."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", q(e(0) * (1 + e(1)) + e(2)).alias("h_q"))


@query("step_euler", "SELECT vec_id, CAST(floor((embedding[1]::DOUBLE + 4 * 0.25 * embedding[2]::DOUBLE) * 1e6 + 0.5) AS BIGINT) AS x_q FROM embeddings")
def step_euler(spark, sf_dir):
    """Four Euler steps of a constant velocity, folded."""
    e = lambda i: F.col("embedding")[i].cast("double")
    x = F.aggregate(F.sequence(F.lit(1), F.lit(4)), e(0), lambda a, i: a + 0.25 * e(1))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", q(x).alias("x_q"))


@query("pool_slices", "SELECT label, CAST(floor(sum(w * v) / (sum(w) + 1e-5) * 1e6 + 0.5) AS BIGINT) AS token_q FROM (SELECT label, exp(embedding[1]::DOUBLE / 0.5) AS w, embedding[2]::DOUBLE AS v FROM embeddings) GROUP BY label")
def pool_slices(spark, sf_dir):
    """Tokens pooled by weight: sum(w v) / (sum(w) + 1e-5)."""
    e = lambda i: F.col("embedding")[i].cast("double")
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.exp(e(0) / 0.5).alias("w"), e(1).alias("v"))
    return d.groupBy("label").agg(q(F.sum(F.col("w") * F.col("v")) / (F.sum("w") + 1e-5)).alias("token_q"))


@query("slice_batches", "SELECT vec_id // 4 AS frame, CAST((pos - 1) // 16 AS INTEGER) AS z, CAST(floor(sum(embedding[pos]::DOUBLE) * 1e4 + 0.5) AS BIGINT) AS s FROM embeddings, unnest(range(1, 65)) AS u(pos) WHERE vec_id % 4 = 0 GROUP BY ALL")
def slice_batches(spark, sf_dir):
    """A field regrouped into its z-slices, the batches of a two-dimensional model."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 4 = 0").select(F.floor(F.col("vec_id") / 4).cast("long").alias("frame"), F.posexplode("embedding").alias("pos", "v"))
    return e.groupBy("frame", F.floor(F.col("pos") / 16).cast("int").alias("z")).agg(q(F.sum(F.col("v").cast("double")), 1e4).alias("s"))


_STEP = "event_id % 20"


@query("schedule_columns", f"""WITH b AS (SELECT CAST(j AS BIGINT) AS step, 0.02::DOUBLE * (1 - j / 20.0::DOUBLE) + 0.0001::DOUBLE AS beta FROM range(0, 20) AS r(j)),
  s AS (SELECT event_id, {_STEP} AS step FROM events)
SELECT event_id, CAST(floor((1e-5::DOUBLE + (1e-3::DOUBLE - 1e-5::DOUBLE) * 0.5 * (1 + cos(pi() * s.step / 25))) * 1e12 + 0.37) AS BIGINT) AS lr_q,
  CAST(floor(beta * 1e9 + 0.37) AS BIGINT) AS beta_q, CAST(floor((SELECT product(1 - c.beta) FROM b AS c WHERE c.step <= s.step) * 1e9 + 0.37) AS BIGINT) AS alpha_bar_q,
  CAST(floor(pow(cos((s.step / 20.0::DOUBLE + 0.008) / 1.008 * pi() / 2), 2) / pow(cos(0.008 / 1.008::DOUBLE * pi() / 2), 2) * 1e9 + 0.37) AS BIGINT) AS cosine_q,
  CAST(floor((0.01::DOUBLE + (0.001::DOUBLE - 0.01::DOUBLE) * s.step / 19) * 1e9 + 0.37) AS BIGINT) AS linear_q, CAST(floor(pow(10, -2 - s.step / 5.0::DOUBLE) * 1e9 + 0.37) AS BIGINT) AS log_q,
  CAST(floor((1 - pow(1e-4, (s.step + 1) / 20.0::DOUBLE)) * 1e9 + 0.37) AS BIGINT) AS refine_q FROM s JOIN b USING (step)""")
def schedule_columns(spark, sf_dir):
    """The schedules of every training step: cosine learning rate, noise levels with their cumulated product, cosine, linear and logarithmic levels, refinement levels."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 20).alias("step"))
    i = F.col("step")
    beta = lambda j: 0.02 * (1 - j / 20.0) + 0.0001
    f = lambda x: F.pow(F.cos((x + 0.008) / 1.008 * F.pi() / 2), F.lit(2))
    columns = {
        "lr_q": (1e-5 + (1e-3 - 1e-5) * 0.5 * (1 + F.cos(F.pi() * i / 25)), 1e12), "beta_q": (beta(i), 1e9), "alpha_bar_q": (F.aggregate(F.sequence(F.lit(0).cast("long"), i), F.lit(1.0), lambda a, j: a * (1 - beta(j))), 1e9),
        "cosine_q": (f(i / 20.0) / f(F.lit(0.0)), 1e9), "linear_q": (0.01 + (0.001 - 0.01) * i / 19, 1e9), "log_q": (F.pow(F.lit(10.0), -2 - i / 5.0), 1e9), "refine_q": (1 - F.pow(F.lit(1e-4), (i + 1) / 20.0), 1e9),
    }
    return e.select("event_id", *(F.floor(c * scale + 0.37).cast("long").alias(name) for name, (c, scale) in columns.items()))

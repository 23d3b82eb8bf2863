"""Result rows, leaderboard, run matrix, costs and the manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import PER_SEED, RESULT_ROWS, per_seed, result_rows, with_
from ..model import q
from ..registry import query


def last_root_wins(rows: DataFrame, keys: list[str], root: str) -> DataFrame:
    """One row for each identity: that of the last root."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), root).alias("r")).select(*keys, "r.*")


_LAST = """lr AS (SELECT model, task, "case", arg_max(root, root) AS root, arg_max(nrmse, root) AS nrmse FROM result_rows GROUP BY ALL)"""
KEY = ["model", "task", "case"]


@query("lb_identity_rows", with_(RESULT_ROWS, _LAST, rest='SELECT model, task, "case", root, CAST(floor(nrmse * 1e9 + 0.5) AS BIGINT) AS nrmse_q FROM lr'))
def lb_identity_rows(spark, sf_dir):
    return last_root_wins(result_rows(spark, sf_dir), KEY, "root").select(*KEY, "root", q("nrmse", 1e9).alias("nrmse_q"))


@query("lb_root_override", with_(RESULT_ROWS, rest='SELECT model, task, "case", count(*) AS copies FROM result_rows GROUP BY ALL HAVING count(*) > 1'))
def lb_root_override(spark, sf_dir):
    return result_rows(spark, sf_dir).groupBy(*KEY).agg(F.count("*").alias("copies")).where("copies > 1")


def skill(rows: DataFrame, baseline: str) -> DataFrame:
    """1 - nrmse / the baseline's on the same task and case; blank if either is missing or the baseline is 0."""
    b = rows.where(F.col("model") == baseline).select("task", "case", F.col("nrmse").alias("base"))
    return rows.join(b, ["task", "case"], "left").withColumn("skill", 1 - F.try_divide("nrmse", "base"))


_SKILL = """sk AS (SELECT a.model, a.task, a."case", a.nrmse, 1 - a.nrmse / nullif(b.nrmse, 0) AS skill FROM lr a LEFT JOIN lr b ON b.model = 'Brand#11' AND b.task = a.task AND b."case" = a."case")"""


def _rows(spark, sf_dir) -> DataFrame:
    return last_root_wins(result_rows(spark, sf_dir), KEY, "root")


@query("lb_skill", with_(RESULT_ROWS, _LAST, _SKILL, rest='SELECT model, task, "case", CAST(floor(skill * 1e6 + 0.5) AS BIGINT) AS skill_q FROM sk'))
def lb_skill(spark, sf_dir):
    return skill(_rows(spark, sf_dir), "Brand#11").select(*KEY, q("skill").alias("skill_q"))


@query("lb_skill_pivot", with_(RESULT_ROWS, _LAST, _SKILL, rest="SELECT model, " + ", ".join(f"CAST(floor(avg(skill) FILTER (task = '{t}') * 1e6 + 0.5) AS BIGINT) AS {t.lower()}" for t in "ANR") + " FROM sk GROUP BY model"))
def lb_skill_pivot(spark, sf_dir):
    p = skill(_rows(spark, sf_dir), "Brand#11").groupBy("model").pivot("task", ["A", "N", "R"]).agg(F.avg("skill"))
    return p.select("model", *(q(t).alias(t.lower()) for t in "ANR"))


@query("lb_three_axis", with_(RESULT_ROWS, _LAST, _SKILL, rest="SELECT model, count(*) AS n, count(skill) AS scored, CAST(floor(avg(skill) * 1e6 + 0.5) AS BIGINT) AS mean_q, CAST(floor(stddev_pop(skill) * 1e6 + 0.5) AS BIGINT) AS spread_q FROM sk GROUP BY model"))
def lb_three_axis(spark, sf_dir):
    s = skill(_rows(spark, sf_dir), "Brand#11")
    return s.groupBy("model").agg(F.count("*").alias("n"), F.count("skill").alias("scored"), q(F.avg("skill")).alias("mean_q"), q(F.stddev_pop("skill")).alias("spread_q"))


@query("lb_seed_std", with_(RESULT_ROWS, rest='SELECT model, task, "case", count(*) AS n, CAST(floor(avg(nrmse) * 1e9 + 0.5) AS BIGINT) AS mean_q, CAST(floor(CASE WHEN count(*) > 1 THEN stddev_pop(nrmse) ELSE 0 END * 1e6 + 0.5) AS BIGINT) AS std_q FROM result_rows GROUP BY ALL'))
def lb_seed_std(spark, sf_dir):
    """Main value and seed repeats together: population deviation, 0 for a single value."""
    std = F.when(F.count("*") > 1, F.stddev_pop("nrmse")).otherwise(0.0)
    return result_rows(spark, sf_dir).groupBy(*KEY).agg(F.count("*").alias("n"), q(F.avg("nrmse"), 1e9).alias("mean_q"), q(std).alias("std_q"))


@query("lb_missing_baseline", with_(RESULT_ROWS, _LAST, rest='SELECT DISTINCT task, "case" FROM lr a WHERE NOT EXISTS (SELECT 1 FROM lr b WHERE b.model = \'Brand#11\' AND b.task = a.task AND b."case" = a."case")'))
def lb_missing_baseline(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return r.select("task", "case").distinct().join(r.where("model = 'Brand#11'"), ["task", "case"], "left_anti")


@query("lb_best_per_task", with_(RESULT_ROWS, _LAST, rest='SELECT task, "case", model, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY task, "case" ORDER BY nrmse, model) AS rank FROM lr) WHERE rank <= 3'))
def lb_best_per_task(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("task", "case").orderBy("nrmse", "model"))
    return _rows(spark, sf_dir).select("task", "case", "model", r.alias("rank")).where("rank <= 3")


@query("cost_median", "SELECT o_orderpriority AS model, count(*) AS runs, CAST(floor(median(o_totalprice) * 100 + 0.5) AS BIGINT) AS median_q, count(*) FILTER (o_totalprice >= 200000) AS long_runs FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def cost_median(spark, sf_dir):
    """Median wall-clock of finished runs by model."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'")
    return o.groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").alias("runs"), q(F.median("o_totalprice"), 100).alias("median_q"), F.count_if(F.col("o_totalprice") >= 200000).alias("long_runs"))


@query("run_matrix", """SELECT r_name AS task, n_name AS "case", m AS model, (nation.n_nationkey + len(m)) % 3 = 0 AS allowed FROM region, nation, (VALUES ('fno'), ('ufno'), ('persistence')) AS t(m) WHERE m <> 'persistence' OR r_name LIKE 'A%'""")
def run_matrix(spark, sf_dir):
    """Every case, task and model that may run together: small dimensions, crossed on purpose."""
    r, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    m = spark.createDataFrame([("fno",), ("ufno",), ("persistence",)], "model string")
    j = n.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(m)).where("model <> 'persistence' or r_name like 'A%'")
    return j.select(F.col("r_name").alias("task"), F.col("n_name").alias("case"), "model", ((F.col("n_nationkey") + F.length("model")) % 3 == 0).alias("allowed"))


@query("suite_resume", "SELECT o_custkey AS run, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey HAVING arg_max(o_orderstatus, (o_orderdate, o_orderkey)) <> 'F'")
def suite_resume(spark, sf_dir):
    """Runs whose newest status is not final."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.col("o_custkey").alias("run")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status")).where("status <> 'F'")


@query("suite_summary", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def suite_summary(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("man_rollup", with_(PER_SEED, rest='SELECT "case", count(*) AS seeds, CAST(sum(frames) AS BIGINT) AS frames, min(frames) AS f_min, max(frames) AS f_max, CAST(floor(avg(k_max_eta) * 1e6 + 0.5) AS BIGINT) AS eta_q, count(k_max_eta) AS eta_n FROM per_seed GROUP BY "case"'))
def man_rollup(spark, sf_dir):
    """Totals and regime means of each case; unknown values are skipped."""
    return per_seed(spark, sf_dir).groupBy("case").agg(F.count("*").alias("seeds"), F.sum("frames").alias("frames"), F.min("frames").alias("f_min"), F.max("frames").alias("f_max"), q(F.avg("k_max_eta")).alias("eta_q"), F.count("k_max_eta").alias("eta_n"))


@query("man_rebuild", with_(PER_SEED, rest='SELECT "case", list(seed ORDER BY seed)::VARCHAR AS seeds, count(*) FILTER (frames < 10) AS short_, count(*) FILTER (k_max_eta < 0.015) AS coarse FROM per_seed GROUP BY "case"'))
def man_rebuild(spark, sf_dir):
    seeds = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("seed")).cast("array<string>"), ", "), F.lit("]"))
    return per_seed(spark, sf_dir).groupBy("case").agg(seeds.alias("seeds"), F.count_if(F.col("frames") < 10).alias("short_"), F.count_if(F.col("k_max_eta") < 0.015).alias("coarse"))


@query("man_missing", with_(PER_SEED, rest="""SELECT c AS "case" FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('DECAY'), ('ROTATING')) AS t(c) WHERE c NOT IN (SELECT "case" FROM per_seed)"""))
def man_missing(spark, sf_dir):
    declared = spark.createDataFrame([("AUTOMOBILE",), ("BUILDING",), ("DECAY",), ("ROTATING",)], "case string")
    return declared.join(per_seed(spark, sf_dir).select("case").distinct(), "case", "left_anti")


@query("man_caveat_union", "SELECT caveat, CAST(row_number() OVER (ORDER BY first, caveat) AS INTEGER) AS pos FROM (SELECT p_type AS caveat, min(p_partkey) AS first FROM part GROUP BY p_type)")
def man_caveat_union(spark, sf_dir):
    """The ordered distinct union: each caveat where it first occurs."""
    c = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_type").alias("caveat")).agg(F.min("p_partkey").alias("first"))
    return c.select("caveat", F.row_number().over(Window.orderBy("first", "caveat")).alias("pos"))


@query("man_group_order", with_(PER_SEED, rest="""SELECT "case", CAST(row_number() OVER (ORDER BY CASE "case" WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, "case") AS INTEGER) AS pos FROM per_seed GROUP BY "case" """))
def man_group_order(spark, sf_dir):
    """Canonical order: by group, then by name."""
    grp = F.when(F.col("case") == "MACHINERY", 0).when(F.col("case") == "BUILDING", 1).otherwise(2)
    return per_seed(spark, sf_dir).select("case").distinct().select("case", F.row_number().over(Window.orderBy(grp, "case")).alias("pos"))


@query("man_nested_json", with_(PER_SEED, rest="""SELECT "case", count(*) AS seeds, CAST(sum(frames) AS BIGINT) AS frames FROM per_seed GROUP BY "case" """))
def man_nested_json(spark, sf_dir):
    """The nested manifest: written as JSON text, read back with its schema, and exploded."""
    m = per_seed(spark, sf_dir).groupBy("case").agg(F.to_json(F.struct(F.collect_list(F.struct("seed", "frames")).alias("per_seed"))).alias("j"))
    rows = m.select("case", F.explode(F.from_json("j", "per_seed array<struct<seed:long,frames:long>>")["per_seed"]).alias("r"))
    return rows.groupBy("case").agg(F.count("*").alias("seeds"), F.sum("r.frames").alias("frames"))


GATES = [("A1", "frames >= 10", "frames"), ("A7", "drift <= 5", "drift"), ("A9", "k_max_eta >= 0.012", "k_max_eta"), ("D1", "seed < 15", "seed")]


def gate_table(rows: DataFrame, gates: list[tuple[str, str, str]], keys: list[str]) -> DataFrame:
    """One row for each gate: measured value and verdict; an unknown value is MISSING, never a pass."""
    items = [F.struct(F.lit(i).alias("item"), F.col(c).cast("double").alias("measured"), F.when(F.col(c).isNull(), "MISSING").when(F.expr(rule), "pass").otherwise("**FAIL**").alias("verdict")) for i, rule, c in gates]
    return rows.select(*keys, F.inline(F.array(*items)))


_GATES = "g AS (" + " UNION ALL ".join(f"""SELECT "case", seed, '{i}' AS item, CASE WHEN {c} IS NULL THEN 'MISSING' WHEN {rule} THEN 'pass' ELSE '**FAIL**' END AS verdict FROM per_seed""" for i, rule, c in GATES) + ")"


@query("gate_table", with_(PER_SEED, _GATES, rest='SELECT "case", seed, item, verdict FROM g'))
def q_gate_table(spark, sf_dir):
    return gate_table(per_seed(spark, sf_dir), GATES, ["case", "seed"]).drop("measured")


@query("gate_overall", with_(PER_SEED, _GATES, rest="""SELECT "case", seed, bool_and(verdict = 'pass') AS accepted, count(*) FILTER (verdict = '**FAIL**') AS failed FROM g GROUP BY ALL"""))
def gate_overall(spark, sf_dir):
    g = gate_table(per_seed(spark, sf_dir), GATES, ["case", "seed"])
    return g.groupBy("case", "seed").agg(F.bool_and(F.col("verdict") == "pass").alias("accepted"), F.count_if(F.col("verdict") == "**FAIL**").alias("failed"))


@query("gate_presence", with_(PER_SEED, _GATES, rest="""SELECT "case", seed FROM g WHERE verdict <> 'MISSING' GROUP BY ALL HAVING count(DISTINCT item) < 4"""))
def gate_presence(spark, sf_dir):
    """Runs for which a gate is absent: absence never counts as a pass."""
    g = gate_table(per_seed(spark, sf_dir), GATES, ["case", "seed"]).where("verdict <> 'MISSING'")
    return g.groupBy("case", "seed").agg(F.count_distinct("item").alias("n")).where("n < 4").select("case", "seed")


@query("pool_seed_stats", with_(PER_SEED, rest='SELECT "case", CAST(floor(avg(drift) * 1e6 + 0.5) AS BIGINT) AS mean_q, CAST(floor(stddev_pop(drift) * 1e6 + 0.5) AS BIGINT) AS pstd_q, CAST(floor(CASE WHEN count(*) > 1 THEN stddev_samp(drift) ELSE 0 END * 1e6 + 0.5) AS BIGINT) AS std_q FROM per_seed GROUP BY "case"'))
def pool_seed_stats(spark, sf_dir):
    """Seed pool: population and sample deviations."""
    return per_seed(spark, sf_dir).groupBy("case").agg(q(F.avg("drift")).alias("mean_q"), q(F.stddev_pop("drift")).alias("pstd_q"), q(F.when(F.count("*") > 1, F.stddev_samp("drift")).otherwise(0.0)).alias("std_q"))


@query("regime_numbers", """SELECT s_suppkey, CASE WHEN om = 0 THEN 'inf' ELSE CAST(CAST(floor(u / (2 * om) * 1e6 + 0.5) AS BIGINT) AS VARCHAR) END AS ro, CASE WHEN b > 1 THEN 'resolved' WHEN b > 0.5 THEN 'marginal' ELSE 'coarse' END AS cls
  FROM (SELECT s_suppkey, s_suppkey % 4 AS om, abs(s_acctbal) / 100 AS u, abs(s_acctbal) / 5000 AS b FROM supplier)""")
def regime_numbers(spark, sf_dir):
    """Rossby number, infinite without rotation, and a resolution class."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") % 4).alias("om"), (F.abs("s_acctbal") / 100).alias("u"), (F.abs("s_acctbal") / 5000).alias("b"))
    ro = F.when(F.col("om") > 0, F.col("u") / (2 * F.nullif("om", F.lit(0)))).otherwise(F.lit(float("inf")))
    shown = F.when(ro == float("inf"), "inf").otherwise(q(F.when(ro != float("inf"), ro)).cast("string"))
    return s.select("s_suppkey", shown.alias("ro"), F.when(F.col("b") > 1, "resolved").when(F.col("b") > 0.5, "marginal").otherwise("coarse").alias("cls"))

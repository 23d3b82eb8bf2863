"""Acceptance tables: the A, B, D, S and decay groups as typed rows, trajectory verdicts, refusals, and the task views around them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import FIELD4, PER_SEED, RUN_TS, field4, per_seed, run_ts, with_
from ..model import q
from ..registry import query
from .timeseries import KMAX, NU, k_max_eta

#: Acceptance bands, item -> (low, high); either may be open.
def resolution_class(eta: Column) -> Column:
    return F.when(eta >= 1.5, "I").when(eta >= 1.0, "II").otherwise("FAIL")


def band_verdict(value: Column, low: float | None, high: float | None) -> Column:
    """pass within the closed band; unknown or not-a-number is MISSING, never a pass."""
    ok = (value >= low if low is not None else F.lit(True)) & (value <= high if high is not None else F.lit(True))
    return F.when(value.isNull() | F.isnan(value), "MISSING").when(ok, "pass").otherwise("**FAIL**")


def appendix(measured: DataFrame, keys: list[str], bands: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(keys, item, measured, low, high, verdict) of a wide row of measurements, one column an item."""
    items = [F.struct(F.lit(i).alias("item"), F.col(i).cast("double").alias("measured"), F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high"), band_verdict(F.col(i).cast("double"), lo, hi).alias("verdict")) for i, (lo, hi) in bands.items()]
    return measured.select(*keys, F.inline(F.array(*items)))


@query("gate_a1_class", with_(RUN_TS, rest=f"SELECT seed, CASE WHEN e >= 1.5 THEN 'I' WHEN e >= 1.0 THEN 'II' ELSE 'FAIL' END AS cls FROM (SELECT seed, avg({KMAX} * pow(CAST({NU**3!r} AS DOUBLE) / (eps / 1000), 0.25)) AS e FROM run_ts GROUP BY seed)"))
def gate_a1_class(spark, sf_dir):
    e = run_ts(spark, sf_dir).groupBy("seed").agg(F.avg(k_max_eta(F.col("eps") / 1000)).alias("e"))
    return e.select("seed", resolution_class(F.col("e")).alias("cls"))


@query("gate_a6_steps", with_(RUN_TS, rest="SELECT seed, max(c) <= 48000 AS courant, CAST(sum(d) AS BIGINT) AS steps_us FROM (SELECT seed, c, ord, t_us - lag(t_us) OVER (PARTITION BY seed ORDER BY ord) AS d FROM run_ts) WHERE ord > 0 GROUP BY seed"))
def gate_a6_steps(spark, sf_dir):
    """Largest Courant number, and the mean step without the first sample."""
    w = Window.partitionBy("seed").orderBy("ord")
    d = run_ts(spark, sf_dir).withColumn("d", F.col("t_us") - F.lag("t_us").over(w)).where("ord > 0")
    return d.groupBy("seed").agg((F.max("c") <= 48000).alias("courant"), F.sum("d").alias("steps_us"))


def _gradients(field: DataFrame) -> DataFrame:
    """Periodic differences of every component along every axis: frame, comp, axis, d (twice the derivative, whole numbers), by shift joins on computed keys."""
    f = field.where("ch < 3").select("frame", "ch", "z", "y", "x", "q")
    out = None
    for axis in ("x", "y", "z"):
        others = [c for c in ("z", "y", "x") if c != axis]
        line = f.groupBy("frame", "ch", *others).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, "q"))), lambda s: s["q"]).alias("v"))  # four values
        d = line.select("frame", F.col("ch").alias("comp"), F.lit("xyz".index(axis)).alias("axis"), F.explode(F.transform("v", lambda _, i: F.get("v", F.pmod(i + 1, F.lit(4))) - F.get("v", F.pmod(i + 3, F.lit(4))))).alias("d"))
        out = d if out is None else out.union(d)
    return out


_GRAD = "gr AS (" + " UNION ALL ".join(f"SELECT a.frame, a.ch AS comp, {i} AS axis, b.q - c.q AS d FROM field4 a JOIN field4 b ON b.frame = a.frame AND b.ch = a.ch AND b.{p} = (a.{p} + 1) % 4 AND b.{r} = a.{r} AND b.{s} = a.{s} JOIN field4 c ON c.frame = a.frame AND c.ch = a.ch AND c.{p} = (a.{p} + 3) % 4 AND c.{r} = a.{r} AND c.{s} = a.{s} WHERE a.ch < 3" for i, (p, r, s) in enumerate((("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y")))) + ")"
_LT = "lt AS (SELECT frame, CAST(sum(CAST(d AS HUGEINT) * d) FILTER (comp = axis) AS DOUBLE) / 3 AS l, CAST(sum(CAST(d AS HUGEINT) * d) FILTER (comp <> axis) AS DOUBLE) / 6 AS t FROM gr GROUP BY frame)"


@query("gate_a11_gradients", with_(FIELD4, _GRAD, _LT, rest="SELECT frame, CAST(floor(t / (2 * l) * 1e6 + 0.5) AS BIGINT) AS ratio_q, t / (2 * l) BETWEEN 0.95 AND 1.05 AS ok FROM lt"))
def gate_a11_gradients(spark, sf_dir):
    """Transverse over twice the longitudinal gradient variance."""
    d2 = F.col("d").cast("decimal(19,0)") * F.col("d").cast("decimal(19,0)")
    g = _gradients(field4(spark, sf_dir)).groupBy("frame").agg((F.sum(F.when(F.col("comp") == F.col("axis"), d2)).cast("double") / 3).alias("l"), (F.sum(F.when(F.col("comp") != F.col("axis"), d2)).cast("double") / 6).alias("t"))
    r = F.col("t") / (2 * F.col("l"))
    return g.select("frame", q(r).alias("ratio_q"), r.between(0.95, 1.05).alias("ok"))


@query("gate_b_bands", with_(FIELD4, _GRAD, rest="SELECT frame, CAST(floor(f * 1e6 + 0.5) AS BIGINT) AS flat_q, CASE WHEN f BETWEEN 4 AND 8 THEN 'report' ELSE 'REPORT' END AS verdict FROM (SELECT frame, avg(pow(d / 1e6, 4)) / pow(avg(pow(d / 1e6, 2)), 2) AS f FROM gr WHERE comp = axis GROUP BY frame)"))
def gate_b_bands(spark, sf_dir):
    """Flatness of the longitudinal gradients: reported, never gated."""
    x = F.col("d") / 1e6
    g = _gradients(field4(spark, sf_dir)).where("comp = axis").groupBy("frame").agg((F.avg(F.pow(x, F.lit(4))) / F.pow(F.avg(F.pow(x, F.lit(2))), F.lit(2))).alias("f"))
    return g.select("frame", q("f").alias("flat_q"), F.when(F.col("f").between(4, 8), "report").otherwise("REPORT").alias("verdict"))


@query("gate_dissipation_ratio", with_(FIELD4, _GRAD, _LT, rest="SELECT frame, CAST(floor((3 * l + 6 * t) / (15 * l) * 1e6 + 0.5) AS BIGINT) AS ratio_q FROM lt"))
def gate_dissipation_ratio(spark, sf_dir):
    """Field dissipation over its isotropic estimate 15 nu <(du/dx)^2>."""
    d2 = F.col("d").cast("decimal(19,0)") * F.col("d").cast("decimal(19,0)")
    g = _gradients(field4(spark, sf_dir)).groupBy("frame").agg(F.sum(F.when(F.col("comp") == F.col("axis"), d2)).cast("double").alias("l"), F.sum(F.when(F.col("comp") != F.col("axis"), d2)).cast("double").alias("t"))
    return g.select("frame", q((F.col("l") + F.col("t")) / (5 * F.col("l"))).alias("ratio_q"))


@query("gate_stratified", """SELECT s_suppkey, re_b > 20 AND eta < lo AND lo < 1 AS s_ok, CASE WHEN sc >= 1 THEN 'batchelor' ELSE 'obukhov-corrsin' END AS scale FROM (SELECT s_suppkey, abs(s_acctbal) / 50 AS re_b, 0.001::DOUBLE * (1 + s_suppkey % 9) AS eta, abs(s_acctbal) / 20000 AS lo, (s_suppkey % 5) / 2.0::DOUBLE AS sc FROM supplier)""")
def gate_stratified(spark, sf_dir):
    """Buoyancy Reynolds number over 20 and eta < Ozmidov < outer scale; the scalar's own small scale by its Schmidt number."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    b, k = F.abs("s_acctbal"), F.col("s_suppkey")
    d = s.select("s_suppkey", (b / 50).alias("re_b"), (0.001 * (1 + k % 9)).alias("eta"), (b / 20000).alias("lo"), ((k % 5) / 2.0).alias("sc"))
    return d.select("s_suppkey", ((F.col("re_b") > 20) & (F.col("eta") < F.col("lo")) & (F.col("lo") < 1)).alias("s_ok"), F.when(F.col("sc") >= 1, "batchelor").otherwise("obukhov-corrsin").alias("scale"))


@query("gate_empty_split", with_(PER_SEED, rest="""SELECT "case", count(*) FILTER (seed < 6) = 0 OR count(*) FILTER (seed = 6) = 0 OR count(*) FILTER (seed > 6) = 0 AS degraded FROM per_seed WHERE seed <> 6 OR "case" < 'F' GROUP BY "case" """))
def gate_empty_split(spark, sf_dir):
    m = per_seed(spark, sf_dir).where("seed <> 6 or case < 'F'")
    return m.groupBy("case").agg(((F.count_if(F.col("seed") < 6) == 0) | (F.count_if(F.col("seed") == 6) == 0) | (F.count_if(F.col("seed") > 6) == 0)).alias("degraded"))


def refuse_unsupported(rows: DataFrame, case: str, supported: tuple[str, ...]) -> DataFrame:
    """The rows, or an error at the first one whose case has physics that the operator does not have."""
    ok = F.lit(False)
    for p in supported:
        ok = ok | F.startswith(case, F.lit(p))
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unsupported physics: "), F.col(case))).cast("boolean")))


def require_finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, or an error at the first value that is null, NaN or infinite."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == math.inf)
    return rows.where(F.when(bad, F.raise_error(F.lit("a value is missing or not finite")).cast("boolean")).otherwise(F.lit(True)))


@query("gate_finite", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def gate_finite(spark, sf_dir):
    li = require_finite(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("gate_supported_physics", "SELECT n_name FROM nation WHERE n_name LIKE 'NATION%' OR n_name LIKE '%A%'")
def gate_supported_physics(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_name like 'NATION%' or n_name like '%A%'").select("n_name")
    return refuse_unsupported(n, "n_name", tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def denormalise(task: Column, pred: Column, absmax_u: Column, absmax_p: Column) -> Column:
    """Output of a task in physical units: velocity or pressure scale; subgrid stresses have their own and stay."""
    return F.when(task == "pressure", pred * absmax_p).when(task == "sgs", pred).otherwise(pred * absmax_u)


@query("task_denormalise", "SELECT l_orderkey, l_linenumber, CAST(floor(CASE l_returnflag WHEN 'A' THEN l_tax * 100 WHEN 'N' THEN l_tax ELSE l_tax * 50 END * 1e6 + 0.5) AS BIGINT) AS y_q FROM lineitem")
def task_denormalise(spark, sf_dir):
    task = F.when(F.col("l_returnflag") == "A", "pressure").when(F.col("l_returnflag") == "N", "sgs").otherwise("rollout")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", q(denormalise(task, F.col("l_tax"), F.lit(50.0), F.lit(100.0))).alias("y_q"))


@query("calibrate_viscosity", with_(RUN_TS, rest="SELECT seed, CAST(floor(0.0022::DOUBLE * pow(avg(K) / 200, 2) * 1e9 + 0.5) AS BIGINT) AS nu_q FROM run_ts GROUP BY seed"))
def calibrate_viscosity(spark, sf_dir):
    """nu (Re / target)^2."""
    return run_ts(spark, sf_dir).groupBy("seed").agg(q(0.0022 * F.pow(F.avg("K") / 200, F.lit(2)), 1e9).alias("nu_q"))


@query("case_constants", "SELECT c_mktsegment AS \"case\", CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 2500 WHEN 'BUILDING' THEN 810 ELSE 0 END::BIGINT AS omega_q, coalesce(c_mktsegment = 'MACHINERY', FALSE) AS buoyant, count(*) AS n FROM customer GROUP BY ALL")
def case_constants(spark, sf_dir):
    """Constants of a case from a small dimension; an unknown case does not rotate and is not buoyant."""
    dim = spark.createDataFrame([("AUTOMOBILE", 2.5, False), ("BUILDING", 0.81, False), ("MACHINERY", 0.0, True)], "case string, omega_z double, buoyant boolean")
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_mktsegment").alias("case")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(dim), "case", "left").select("case", q(F.coalesce("omega_z", F.lit(0.0)), 1000).alias("omega_q"), F.coalesce("buoyant", F.lit(False)).alias("buoyant"), "n")


@query("task_rollout_pairs", with_(FIELD4, "one AS MATERIALIZED (SELECT frame, frame - 1 AS before, (z * 4 + y) * 4 + x AS at, z, y, x, q FROM field4 WHERE ch = 0)", rest="SELECT a.frame, a.z, a.y, a.x, a.q AS input, b.q AS output FROM one a JOIN one b ON b.before = a.frame AND b.at = a.at"))
def task_rollout_pairs(spark, sf_dir):
    f = field4(spark, sf_dir).where("ch = 0").drop("ch")
    nxt = f.select((F.col("frame") - 1).alias("frame"), "z", "y", "x", F.col("q").alias("output"))
    return f.withColumnRenamed("q", "input").join(nxt, ["frame", "z", "y", "x"])


@query("task_recon_masked", with_(FIELD4, rest="SELECT frame, z, y, x, CASE WHEN ((frame * 1103515245 + (z * 16 + y * 4 + x)::BIGINT * 12345 + 7) % 2147483648) % 20 = 0 THEN q ELSE 0 END AS input, q AS output FROM field4 WHERE ch = 0"))
def task_recon_masked(spark, sf_dir):
    point = (F.col("z") * 16 + F.col("y") * 4 + F.col("x")).cast("long")
    keep = F.pmod(F.col("frame") * 1103515245 + point * 12345 + 7, F.lit(2147483648)) % 20 == 0
    return field4(spark, sf_dir).where("ch = 0").select("frame", "z", "y", "x", F.when(keep, F.col("q")).otherwise(F.lit(0).cast("long")).alias("input"), F.col("q").alias("output"))


@query("task_superres_input", with_(FIELD4, rest="SELECT frame, CAST(z // 2 AS INTEGER) AS z, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST(sum(q) AS BIGINT) AS q8 FROM field4 WHERE ch = 0 GROUP BY ALL"))
def task_superres_input(spark, sf_dir):
    """Block sums of 2x2x2 points: the coarse input of super-resolution."""
    h = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return field4(spark, sf_dir).where("ch = 0").groupBy("frame", h("z"), h("y"), h("x")).agg(F.sum("q").alias("q8"))


@query("constraint_residuals", with_(FIELD4, "e AS (SELECT frame, CAST(sum(CAST(q AS HUGEINT) * q) AS DOUBLE) AS e, CAST(sum(q) FILTER (ch = 0) AS BIGINT) AS mx FROM field4 WHERE ch < 3 GROUP BY frame)", rest="SELECT a.frame, CAST(floor(100 * abs(a.e - b.e) / b.e * 1e6 + 0.5) AS BIGINT) AS energy_q, abs(a.mx - b.mx) AS momentum FROM e a JOIN e b ON b.frame = a.frame - 1"))
def constraint_residuals(spark, sf_dir):
    """Energy error in percent and momentum error of a frame against the one before."""
    qq = F.col("q").cast("decimal(19,0)") * F.col("q").cast("decimal(19,0)")
    e = field4(spark, sf_dir).where("ch < 3").groupBy("frame").agg(F.sum(qq).cast("double").alias("e"), F.sum(F.when(F.col("ch") == 0, F.col("q"))).alias("mx"))
    b = e.select((F.col("frame") + 1).alias("frame"), F.col("e").alias("e0"), F.col("mx").alias("mx0"))
    return e.join(b, "frame").select("frame", q(100 * F.abs(F.col("e") - F.col("e0")) / F.col("e0")).alias("energy_q"), F.abs(F.col("mx") - F.col("mx0")).alias("momentum"))


@query("results_unpivot", "SELECT p_brand, metric, CAST(floor(v * 100 + 0.5) AS BIGINT) AS v_q FROM (SELECT p_brand, 'size' AS metric, avg(p_size)::DOUBLE AS v FROM part GROUP BY p_brand UNION ALL SELECT p_brand, 'price', avg(p_retailprice) FROM part GROUP BY p_brand)")
def results_unpivot(spark, sf_dir):
    """A wide result table as one row for each metric."""
    g = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"))
    return g.unpivot("p_brand", ["size", "price"], "metric", "v").select("p_brand", "metric", q("v", 100).alias("v_q"))


@query("experiment_filter", "SELECT p_partkey FROM part WHERE contains(p_name, '1') AND NOT regexp_matches(p_name, '_ar$')")
def experiment_filter(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").where(F.contains("p_name", F.lit("1")) & ~F.col("p_name").rlike("_ar$")).select("p_partkey")


@query("grad_accumulation", "SELECT l_suppkey, n // 4 * 4 AS used, n % 4 AS dropped FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)")
def grad_accumulation(spark, sf_dir):
    """Samples in whole groups of four; a partial group is dropped."""
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return n.select("l_suppkey", (F.floor(F.col("n") / 4) * 4).alias("used"), (F.col("n") % 4).alias("dropped"))

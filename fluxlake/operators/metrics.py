"""Prediction quality: errors, band errors, spectra, enstrophy, tails, transfers, and result rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import FIELD4, field4, with_
from ..model import q
from ..registry import query
from .spectral import _MODES, UVW, by_channel, curl, dft4, packed4

_D = lambda c: F.col(c).cast("decimal(19,0)")


def persistence(field: DataFrame) -> DataFrame:
    """Each frame's truth beside the frame before as its prediction: (frame, ch, z, y, x, pred, truth)."""
    before = field.select((F.col("frame") + 1).alias("frame"), "ch", "z", "y", "x", F.col("q").alias("pred"))
    return before.join(field.withColumnRenamed("q", "truth"), ["frame", "ch", "z", "y", "x"])


_PT = "pt AS (SELECT t.frame, t.ch, t.z, t.y, t.x, p.q AS pred, t.q AS truth FROM field4 t JOIN field4 p ON p.frame + 1 = t.frame AND p.ch = t.ch AND p.z = t.z AND p.y = t.y AND p.x = t.x)"
_N = "sqrt(CAST(sum(CAST(pred - truth AS HUGEINT) * (pred - truth)) AS DOUBLE)) / greatest(sqrt(CAST(sum(CAST(truth AS HUGEINT) * truth) AS DOUBLE)), 1e-12)"


def nrmse(pred: str = "pred", truth: str = "truth") -> Column:
    """|pred - truth| / |truth| over the group, with a floor."""
    d = (F.col(pred) - F.col(truth)).cast("decimal(19,0)")
    return F.sqrt(F.sum(d * d).cast("double")) / F.greatest(F.sqrt(F.sum(_D(truth) * _D(truth)).cast("double")), F.lit(1e-12))


@query("m_nrmse", with_(FIELD4, _PT, rest=f"SELECT frame, CAST(floor({_N} * 1e9 + 0.5) AS BIGINT) AS nrmse_q FROM pt WHERE ch < 3 GROUP BY frame"))
def m_nrmse(spark, sf_dir):
    return persistence(field4(spark, sf_dir).where("ch < 3")).groupBy("frame").agg(q(nrmse(), 1e9).alias("nrmse_q"))


@query("m_rollout_curve", with_(FIELD4, _PT, f"e AS (SELECT frame, {_N} AS e FROM pt WHERE ch < 3 GROUP BY frame)", rest="SELECT frame % 10 AS step, count(*) AS n, CAST(floor(avg(e) * 1e6 + 0.5) AS BIGINT) AS mean_q, CAST(floor(CASE WHEN count(*) > 1 THEN stddev_pop(e) ELSE 0 END * 1e6 + 0.5) AS BIGINT) AS std_q FROM e GROUP BY ALL"))
def m_rollout_curve(spark, sf_dir):
    """Mean and population deviation of the error at each step of a rollout of ten."""
    e = persistence(field4(spark, sf_dir).where("ch < 3")).groupBy("frame").agg(nrmse().alias("e"))
    std = F.when(F.count("*") > 1, F.stddev_pop("e")).otherwise(0.0)
    return e.groupBy((F.col("frame") % 10).alias("step")).agg(F.count("*").alias("n"), q(F.avg("e")).alias("mean_q"), q(std).alias("std_q"))


@query("m_nan_filtered_mean", "SELECT l_linenumber, CAST(floor(coalesce(avg(CASE WHEN l_linenumber < 7 AND l_orderkey % 3 > 0 THEN l_quantity END), -1) * 1e6 + 0.5) AS BIGINT) AS mean_q FROM lineitem GROUP BY l_linenumber")
def m_nan_filtered_mean(spark, sf_dir):
    """Per-step mean without NaN; NaN only where nothing else is there (shown as -1)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    e = F.when((F.col("l_linenumber") < 7) & (F.col("l_orderkey") % 3 > 0), F.col("l_quantity")).otherwise(F.lit(math.nan))
    mean = F.coalesce(F.avg(F.nanvl(F.col("e"), F.lit(None).cast("double"))), F.lit(math.nan))
    return li.select("l_linenumber", e.alias("e")).groupBy("l_linenumber").agg(q(F.nanvl(mean, F.lit(-1.0))).alias("mean_q"))


@query("m_frmse_bands", with_(FIELD4.replace("field4 AS", "f0 AS"), "field4 AS (SELECT t.frame, t.ch, t.z, t.y, t.x, p.q - t.q AS q FROM f0 t JOIN f0 p ON p.frame + 1 = t.frame AND p.ch = t.ch AND p.z = t.z AND p.y = t.y AND p.x = t.x WHERE t.ch < 3)", _MODES,
       rest="""SELECT frame, band, CAST(floor(avg(r) * 1e3 + 0.5) AS BIGINT) AS rms_q FROM (SELECT frame, ch, CAST(least(floor(sqrt(k2) / (sqrt(12::DOUBLE) + 1e-6) * 3), 2) AS INTEGER) AS band, sqrt(avg(CAST(re AS DOUBLE) * re + CAST(im AS DOUBLE) * im)) AS r FROM mode GROUP BY ALL) GROUP BY ALL"""))
def m_frmse_bands(spark, sf_dir):
    """Root mean square of the error's modes in three bands up to the corner, unweighted, then the mean over channels."""
    f = packed4(spark, sf_dir).where("ch < 3")
    before = f.select((F.col("frame") + 1).alias("frame"), "ch", F.col("v").alias("pred"))
    d = before.join(f, ["frame", "ch"]).select("frame", "ch", F.zip_with("pred", "v", lambda a, b: a - b).alias("v"))
    band = F.least(F.floor(F.sqrt("k2") / (math.sqrt(12.0) + 1e-6) * 3), F.lit(2)).cast("int")
    e = F.col("re").cast("double") * F.col("re") + F.col("im").cast("double") * F.col("im")
    r = dft4(d).groupBy("frame", "ch", band.alias("band")).agg(F.sqrt(F.avg(e)).alias("r"))
    return r.groupBy("frame", "band").agg(q(F.avg("r"), 1e3).alias("rms_q"))


_SP = "e AS (SELECT frame, shell, CAST(sum(w * (CAST(re AS HUGEINT) * re + CAST(im AS HUGEINT) * im)) AS DOUBLE) / 4096 / 1e12 AS e FROM mode WHERE ch < 3 AND shell <= 2 GROUP BY ALL)"


def _spectra(spark, sf_dir) -> DataFrame:
    m = dft4(packed4(spark, sf_dir).where("ch < 3")).where("shell <= 2")
    return m.groupBy("frame", "shell").agg((F.sum(F.col("w") * (_D("re") * _D("re") + _D("im") * _D("im"))).cast("double") / 4096 / 1e12).alias("e"))


def _pairs(e: DataFrame) -> DataFrame:
    return e.join(e.select((F.col("frame") + 1).alias("frame"), "shell", F.col("e").alias("ep")), ["frame", "shell"])


@query("m_spectrum_l2", with_(FIELD4, _MODES, _SP, rest="SELECT t.frame, CAST(floor(sqrt(sum((p.e - t.e) * (p.e - t.e))) / greatest(sqrt(sum(t.e * t.e)), 1e-12) * 1e6 + 0.5) AS BIGINT) AS l2_q FROM e t JOIN e p ON p.frame + 1 = t.frame AND p.shell = t.shell GROUP BY t.frame"))
def m_spectrum_l2(spark, sf_dir):
    d = F.col("ep") - F.col("e")
    return _pairs(_spectra(spark, sf_dir)).groupBy("frame").agg(q(F.sqrt(F.sum(d * d)) / F.greatest(F.sqrt(F.sum(F.col("e") * F.col("e"))), F.lit(1e-12))).alias("l2_q"))


@query("m_centroid_drift", with_(FIELD4, _MODES, _SP, rest="SELECT t.frame, CAST(floor((sum(t.shell * p.e) / greatest(sum(p.e), 1e-12) - sum(t.shell * t.e) / greatest(sum(t.e), 1e-12)) * 1e6 + 0.5) AS BIGINT) AS drift_q FROM e t JOIN e p ON p.frame + 1 = t.frame AND p.shell = t.shell GROUP BY t.frame"))
def m_centroid_drift(spark, sf_dir):
    c = lambda e: F.sum(F.col("shell") * F.col(e)) / F.greatest(F.sum(e), F.lit(1e-12))
    return _pairs(_spectra(spark, sf_dir)).groupBy("frame").agg(q(c("ep") - c("e")).alias("drift_q"))


_ENS = """ens AS (SELECT frame, CAST(sum(w * (CAST(ky * im_w - kz * im_v AS HUGEINT) * (ky * im_w - kz * im_v) + CAST(ky * re_w - kz * re_v AS HUGEINT) * (ky * re_w - kz * re_v)
  + CAST(kz * im_u - kx * im_w AS HUGEINT) * (kz * im_u - kx * im_w) + CAST(kz * re_u - kx * re_w AS HUGEINT) * (kz * re_u - kx * re_w)
  + CAST(kx * im_v - ky * im_u AS HUGEINT) * (kx * im_v - ky * im_u) + CAST(kx * re_v - ky * re_u AS HUGEINT) * (kx * re_v - ky * re_u))) AS DOUBLE) AS z FROM uvw GROUP BY frame)"""


def enstrophy(m: DataFrame) -> DataFrame:
    o = curl(m)
    s = sum((_D(f"{p}_o{a}") * _D(f"{p}_o{a}") for a in "xyz" for p in ("re", "im")), F.lit(0).cast("decimal(19,0)"))
    return o.groupBy("frame").agg(F.sum(F.col("w") * s).cast("double").alias("z"))


@query("m_enstrophy_ratio", with_(FIELD4, _MODES, _ENS, rest="SELECT t.frame, CAST(floor(p.z / t.z * 1e6 + 0.5) AS BIGINT) AS ratio_q FROM ens t JOIN ens p ON p.frame + 1 = t.frame"))
def m_enstrophy_ratio(spark, sf_dir):
    z = enstrophy(by_channel(packed4(spark, sf_dir), UVW))
    p = z.select((F.col("frame") + 1).alias("frame"), F.col("z").alias("zp"))
    return z.join(p, "frame").select("frame", q(F.col("zp") / F.col("z")).alias("ratio_q"))


@query("m_correlation", with_(FIELD4, _PT, rest="SELECT frame, CAST(floor(corr(pred, truth) * 1e6 + 0.5) AS BIGINT) AS corr_q FROM pt WHERE ch < 3 GROUP BY frame"))
def m_correlation(spark, sf_dir):
    return persistence(field4(spark, sf_dir).where("ch < 3")).groupBy("frame").agg(q(F.corr("pred", "truth")).alias("corr_q"))


@query("m_structure_fn", with_(FIELD4, rest="SELECT a.frame, r, CAST(floor(avg(pow((b.q - a.q) / 1e6, 3)) * 1e6 + 0.5) AS BIGINT) AS s3_q FROM field4 a, range(1, 3) AS g(r), field4 b WHERE a.ch = 0 AND b.ch = 0 AND b.frame = a.frame AND b.z = a.z AND b.y = a.y AND b.x = (a.x + r) % 4 GROUP BY ALL"))
def m_structure_fn(spark, sf_dir):
    """Signed third-order longitudinal structure function: a shift join along x, periodic."""
    f = field4(spark, sf_dir).where("ch = 0").select("frame", "z", "y", "x", "q")
    a = f.select("frame", "z", "y", F.col("q").alias("qa"), F.col("x").alias("xa"), F.explode(F.array(F.lit(1), F.lit(2))).alias("r")).withColumn("x", F.pmod(F.col("xa") + F.col("r"), F.lit(4)))
    d = (F.col("q") - F.col("qa")) / 1e6
    return a.join(f, ["frame", "z", "y", "x"]).groupBy("frame", F.col("r").cast("long").alias("r")).agg(q(F.avg(F.pow(d, F.lit(3)))).alias("s3_q"))


@query("m_derivative_skewness", with_(FIELD4, "d AS (SELECT a.frame, (b.q - c.q) / 2e6 AS d FROM field4 a JOIN field4 b ON b.frame = a.frame AND b.ch = a.ch AND b.z = a.z AND b.y = a.y AND b.x = (a.x + 1) % 4 JOIN field4 c ON c.frame = a.frame AND c.ch = a.ch AND c.z = a.z AND c.y = a.y AND c.x = (a.x + 3) % 4 WHERE a.ch = 0)",
       rest="SELECT frame, CAST(floor(avg(d * d * d) / pow(greatest(avg(d * d), 1e-30), 1.5) * 1e6 + 0.5) AS BIGINT) AS skew_q FROM d GROUP BY frame"))
def m_derivative_skewness(spark, sf_dir):
    """Raw third moment of the central difference over the 3/2 power of its second."""
    f = field4(spark, sf_dir).where("ch = 0")
    row = f.groupBy("frame", "z", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "q"))), lambda s: s["q"]).alias("v"))  # four values
    d = row.select("frame", F.explode(F.transform("v", lambda _, i: (F.get("v", F.pmod(i + 1, F.lit(4))) - F.get("v", F.pmod(i + 3, F.lit(4)))) / 2e6)).alias("d"))
    c = F.col("d")
    return d.groupBy("frame").agg(q(F.avg(c * c * c) / F.pow(F.greatest(F.avg(c * c), F.lit(1e-30)), F.lit(1.5))).alias("skew_q"))


@query("m_anisotropy_tensor", with_(FIELD4, "m AS (SELECT frame, " + ", ".join(f"CAST(sum(CAST({a} AS HUGEINT) * {b}) AS DOUBLE) / 64 / 1e12 AS {n}" for n, a, b in (("uu", "a", "a"), ("vv", "b", "b"), ("ww", "c", "c"), ("uv", "a", "b"), ("uw", "a", "c"), ("vw", "b", "c"))) +
       " FROM (SELECT frame, z, y, x, max(CASE WHEN ch = 0 THEN q END) AS a, max(CASE WHEN ch = 1 THEN q END) AS b, max(CASE WHEN ch = 2 THEN q END) AS c FROM field4 GROUP BY ALL) GROUP BY frame)",
       "b AS (SELECT frame, uu / t - 1.0 / 3 AS b11, vv / t - 1.0 / 3 AS b22, ww / t - 1.0 / 3 AS b33, uv / t AS b12, uw / t AS b13, vw / t AS b23 FROM (SELECT *, uu + vv + ww AS t FROM m))",
       "p AS (SELECT *, sqrt((b11 * b11 + b22 * b22 + b33 * b33 + 2 * (b12 * b12 + b13 * b13 + b23 * b23)) / 6) AS p, b11 * (b22 * b33 - b23 * b23) - b12 * (b12 * b33 - b23 * b13) + b13 * (b12 * b23 - b22 * b13) AS det FROM b)",
       "a AS (SELECT frame, p, acos(least(1, greatest(-1, det / (2 * p * p * p)))) / 3 AS phi FROM p)",
       rest="SELECT frame, CAST(floor(2 * p * cos(phi) * 1e6 + 0.5) AS BIGINT) AS e1_q, CAST(floor(2 * p * cos(phi + 2 * pi() / 3) * 1e6 + 0.5) AS BIGINT) AS e3_q FROM a"))
def m_anisotropy_tensor(spark, sf_dir):
    """Largest and smallest eigenvalue of b_ij, in closed form for a symmetric traceless tensor."""
    v = field4(spark, sf_dir).where("ch < 3").groupBy("frame", "z", "y", "x").pivot("ch", [0, 1, 2]).agg(F.max("q"))
    d = lambda a, b: (F.sum(F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")).cast("double") / 64 / 1e12)
    m = v.groupBy("frame").agg(d("0", "0").alias("uu"), d("1", "1").alias("vv"), d("2", "2").alias("ww"), d("0", "1").alias("uv"), d("0", "2").alias("uw"), d("1", "2").alias("vw"))
    t = F.col("uu") + F.col("vv") + F.col("ww")
    b = m.select("frame", *((F.col(c) / t - 1.0 / 3).alias(n) for c, n in (("uu", "b11"), ("vv", "b22"), ("ww", "b33"))), *((F.col(c) / t).alias(n) for c, n in (("uv", "b12"), ("uw", "b13"), ("vw", "b23"))))
    c = F.col
    p = F.sqrt((c("b11") ** 2 + c("b22") ** 2 + c("b33") ** 2 + 2 * (c("b12") ** 2 + c("b13") ** 2 + c("b23") ** 2)) / 6)
    det = c("b11") * (c("b22") * c("b33") - c("b23") ** 2) - c("b12") * (c("b12") * c("b33") - c("b23") * c("b13")) + c("b13") * (c("b12") * c("b23") - c("b22") * c("b13"))
    a = b.select("frame", p.alias("p"), det.alias("det")).select("frame", "p", (F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c("det") / (2 * c("p") * c("p") * c("p"))))) / 3).alias("phi"))
    return a.select("frame", q(2 * c("p") * F.cos("phi")).alias("e1_q"), q(2 * c("p") * F.cos(c("phi") + 2 * math.pi / 3)).alias("e3_q"))


@query("result_row", with_(FIELD4, _PT, f"e AS (SELECT frame, {_N} AS e FROM pt WHERE ch < 3 GROUP BY frame)", rest="SELECT 'persistence' AS model, 'rollout' AS task, count(*) AS n_test_samples, CAST(floor(avg(e) * 1e6 + 0.5) AS BIGINT) AS mean_q, CAST(floor(stddev_pop(e) * 1e6 + 0.5) AS BIGINT) AS std_q FROM e"))
def result_row(spark, sf_dir):
    """One row of the leaderboard, scored from frames."""
    e = persistence(field4(spark, sf_dir).where("ch < 3")).groupBy("frame").agg(nrmse().alias("e"))
    return e.agg(F.lit("persistence").alias("model"), F.lit("rollout").alias("task"), F.count("*").alias("n_test_samples"), q(F.avg("e")).alias("mean_q"), q(F.stddev_pop("e")).alias("std_q"))


@query("momentum_correction", with_(FIELD4, rest="SELECT frame, ch, CAST(sum(q) AS BIGINT) AS total, CAST(sum(q * 64 - s) AS BIGINT) AS after FROM (SELECT frame, ch, q, sum(q) OVER (PARTITION BY frame, ch) AS s FROM field4) GROUP BY ALL"))
def momentum_correction(spark, sf_dir):
    """Fields shifted to zero mean, in 64ths so that it is exact."""
    f = field4(spark, sf_dir)
    s = f.groupBy("frame", "ch").agg(F.sum("q").alias("s"))
    return f.join(s, ["frame", "ch"]).groupBy("frame", "ch").agg(F.sum("q").alias("total"), F.sum(F.col("q") * 64 - F.col("s")).alias("after"))


@query("energy_correction", with_(FIELD4, "e AS (SELECT frame, CAST(sum(CAST(q AS HUGEINT) * q) AS DOUBLE) AS e FROM field4 WHERE ch < 3 GROUP BY frame)", rest="SELECT a.frame, CAST(floor(sqrt(b.e / a.e) * 1e9 + 0.5) AS BIGINT) AS scale_q FROM e a JOIN e b ON b.frame + 1 = a.frame"))
def energy_correction(spark, sf_dir):
    """Scale that gives a frame the energy of the one before."""
    e = field4(spark, sf_dir).where("ch < 3").groupBy("frame").agg(F.sum(_D("q") * _D("q")).cast("double").alias("e"))
    return e.join(e.select((F.col("frame") + 1).alias("frame"), F.col("e").alias("want")), "frame").select("frame", q(F.sqrt(F.col("want") / F.col("e")), 1e9).alias("scale_q"))


def early_stop(losses: DataFrame, key: str, order: str, loss: str, patience: int, min_delta: float) -> DataFrame:
    """First epoch at which the loss has not improved on the best so far for `patience` epochs."""
    w = Window.partitionBy(key).orderBy(order)
    best = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.when(best.isNull() | (F.col(loss) < best * (1 - min_delta)), F.col(order))
    since = F.max("better").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = losses.withColumn("better", better).withColumn("idle", F.col(order) - since)
    return d.groupBy(key).agg(F.min(F.when(F.col("idle") >= patience, F.col(order))).alias("stop"))


@query("early_stop", "SELECT l_suppkey, min(CASE WHEN idle >= 3 THEN e END) AS stop FROM (SELECT l_suppkey, e, e - max(better) OVER (PARTITION BY l_suppkey ORDER BY e) AS idle FROM (SELECT *, CASE WHEN best IS NULL OR loss < best * (1 - 0.01::DOUBLE) THEN e END AS better FROM (SELECT l_suppkey, e, loss, min(loss) OVER (PARTITION BY l_suppkey ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS BIGINT) AS e, l_extendedprice AS loss FROM lineitem)))) GROUP BY l_suppkey")
def q_early_stop(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    e = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")).cast("long")
    return early_stop(li.select("l_suppkey", e.alias("e"), F.col("l_extendedprice").alias("loss")), "l_suppkey", "e", "loss", 3, 0.01)

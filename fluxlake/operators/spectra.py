"""Operators on one-dimensional spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import SPECTRUM, spectrum, spectrum_met, with_
from ..model import q
from ..registry import query

#: Length that makes the resolved range of the fixture spectra reach k eta = 1.28.
ETA = 0.04


def trapezoid(y: Column, x: Column, w) -> Column:
    """A cell of the trapezoid rule between the row before and this one."""
    return 0.5 * (y + F.lag(y).over(w)) * (x - F.lag(x).over(w))


def summary(df: DataFrame, key: str, nu: float) -> DataFrame:
    """K, eps, u', integral length, Taylor length and Re_lambda by trapezoids over the positive part of a spectrum."""
    w = Window.partitionBy(key).orderBy("k")
    d = df.where("k > 0 and E > 0")
    cells = d.select(key, trapezoid(F.col("E"), F.col("k"), w).alias("e"), trapezoid(2 * nu * F.col("k") * F.col("k") * F.col("E"), F.col("k"), w).alias("d"), trapezoid(F.col("E") / F.col("k"), F.col("k"), w).alias("l"))
    s = cells.groupBy(key).agg(F.sum("e").alias("K"), F.sum("d").alias("eps"), F.sum("l").alias("ek"))
    up = F.sqrt(2 * F.col("K") / 3)
    lam = F.sqrt(15 * nu * up * up / F.col("eps"))
    return s.select(key, "K", "eps", up.alias("u_rms"), (3.141592653589793 / (2 * up * up) * F.col("ek")).alias("L"), lam.alias("lam"), (up * lam / nu).alias("re_lambda"))


_CELLS = """c AS (SELECT seed, 0.5 * (E + lag(E) OVER w) * (k - lag(k) OVER w) AS e_, 0.5 * (2 * 0.05 * k * k * E + 2 * 0.05 * lag(k) OVER w * lag(k) OVER w * lag(E) OVER w) * (k - lag(k) OVER w) AS d_,
  0.5 * (E / k + lag(E) OVER w / lag(k) OVER w) * (k - lag(k) OVER w) AS l_ FROM spectrum WHERE k > 0 AND E > 0 WINDOW w AS (PARTITION BY seed ORDER BY k)),
s AS (SELECT seed, sum(e_) AS kk, sum(d_) AS eps, sum(l_) AS ek FROM c GROUP BY seed)"""


@query("spec_trapz_summary", with_(SPECTRUM, _CELLS, rest="""SELECT seed, CAST(floor(kk * 100 + 0.5) AS BIGINT) AS k_q, CAST(floor(eps * 100 + 0.5) AS BIGINT) AS eps_q, CAST(floor(pi() / (2 * (2 * kk / 3)) * ek * 1e6 + 0.5) AS BIGINT) AS l_q,
  CAST(floor(sqrt(2 * kk / 3) * sqrt(15 * 0.05 * (2 * kk / 3) / eps) / 0.05 * 100 + 0.5) AS BIGINT) AS re_q FROM s"""))
def spec_trapz_summary(spark, sf_dir):
    s = summary(spectrum(spark, sf_dir), "seed", 0.05)
    return s.select("seed", q("K", 100).alias("k_q"), q("eps", 100).alias("eps_q"), q("L").alias("l_q"), q("re_lambda", 100).alias("re_q"))


@query("spec_slope_fit", with_(SPECTRUM, rest="SELECT seed, CASE WHEN count(*) >= 3 THEN CAST(floor(regr_slope(ln(E), ln(k)) * 1e6 + 0.5) AS BIGINT) END AS slope_q, CAST(floor(regr_r2(ln(E), ln(k)) * 1e6 + 0.5) AS BIGINT) AS r2_q FROM spectrum WHERE k BETWEEN 4 AND 20 AND E > 0 GROUP BY seed"))
def spec_slope_fit(spark, sf_dir):
    """Log-log slope over a range of wavenumbers; undefined under three points."""
    d = spectrum(spark, sf_dir).where("k between 4 and 20 and E > 0")
    lx, ly = F.log("k"), F.log("E")
    return d.groupBy("seed").agg(F.when(F.count("*") >= 3, q(F.regr_slope(ly, lx))).alias("slope_q"), q(F.regr_r2(ly, lx)).alias("r2_q"))


_KE = "k * 0.04"


@query("spec_peak", with_(SPECTRUM, f"p AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY 2 * k * k * E DESC, k) AS r FROM spectrum)", rest=f"SELECT seed, k AS k_peak, {_KE} BETWEEN 0.1 AND 0.4 AND k / 32.0 <= 0.5 AS ok FROM p WHERE r = 1"))
def spec_peak(spark, sf_dir):
    """Peak of the dissipation spectrum, the lowest wavenumber on ties, and whether it lies in the resolved band."""
    d = 2 * F.col("k") * F.col("k") * F.col("E")
    p = spectrum(spark, sf_dir).groupBy("seed").agg(F.max_by("k", F.struct(d, -F.col("k"))).alias("k_peak"))
    return p.select("seed", "k_peak", ((F.col("k_peak") * ETA).between(0.1, 0.4) & (F.col("k_peak") / 32.0 <= 0.5)).alias("ok"))


@query("spec_tail_fraction", with_(SPECTRUM, "t AS (SELECT seed, regr_slope(ln(2 * k * k * E), k * 0.04) AS slope, regr_intercept(ln(2 * k * k * E), k * 0.04) AS icpt, count(*) AS n FROM spectrum WHERE k >= 24 AND E > 0 GROUP BY seed)",
       rest="SELECT seed, n, CAST(floor(slope * 1e6 + 0.5) AS BIGINT) AS slope_q, CASE WHEN n < 3 OR slope >= 0 THEN 'undetermined' WHEN exp(icpt + slope * 1.28) / -slope < 1e4 THEN 'pass' ELSE '**FAIL**' END AS verdict FROM t"))
def spec_tail_fraction(spark, sf_dir):
    """Exponential fit of the dissipation tail; too few points or a rising tail leave it undetermined."""
    y, x = F.log(2 * F.col("k") * F.col("k") * F.col("E")), F.col("k") * ETA
    t = spectrum(spark, sf_dir).where("k >= 24 and E > 0").groupBy("seed").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icpt"), F.count("*").alias("n"))
    rest = F.exp(F.col("icpt") + F.col("slope") * 1.28) / -F.col("slope")
    v = F.when((F.col("n") < 3) | (F.col("slope") >= 0), "undetermined").when(rest < 1e4, "pass").otherwise("**FAIL**")
    return t.select("seed", "n", q("slope").alias("slope_q"), v.alias("verdict"))


@query("spec_upticks", with_(SPECTRUM, "d AS (SELECT seed, k, E > lag(E) OVER (PARTITION BY seed ORDER BY k) AS up FROM spectrum)", rest="SELECT seed, count(*) FILTER (up AND k * 0.04 >= 0.5) AS upticks FROM d GROUP BY seed"))
def spec_upticks(spark, sf_dir):
    up = F.col("E") > F.lag("E").over(Window.partitionBy("seed").orderBy("k"))
    return spectrum(spark, sf_dir).withColumn("up", up).groupBy("seed").agg(F.count_if(F.col("up") & (F.col("k") * ETA >= 0.5)).alias("upticks"))


@query(
    "spec_pileup",
    with_(SPECTRUM, "z AS (SELECT seed, k, E, coalesce(E > lag(E) OVER (PARTITION BY seed ORDER BY k), FALSE) AS up, row_number() OVER (PARTITION BY seed ORDER BY k) AS r, count(*) OVER (PARTITION BY seed) AS n FROM spectrum WHERE k >= 13)",
          "g AS (SELECT *, k - row_number() OVER (PARTITION BY seed, up ORDER BY k) AS grp FROM z)", "run AS (SELECT seed, max(c) AS longest FROM (SELECT seed, grp, count(*) AS c FROM g WHERE up GROUP BY seed, grp) GROUP BY seed)",
          "tail AS (SELECT seed, max_by(E, k) < min_by(E, k) * 1.0 AS decays FROM (SELECT seed, k, E FROM z WHERE r > floor(0.8 * n)) GROUP BY seed)".replace("min_by(E, k)", "arg_min(E, k)").replace("max_by(E, k)", "arg_max(E, k)"),
          rest="SELECT seed, coalesce(longest, 0) AS longest, decays, CASE WHEN coalesce(longest, 0) >= 3 OR NOT decays THEN '**FAIL**' ELSE 'pass' END AS verdict FROM tail LEFT JOIN run USING (seed)"),
)
def spec_pileup(spark, sf_dir):
    """Pile-up at the grid scale: upticks in three adjacent shells (one that is missing ends a run), or a last fifth that does not fall."""
    w = Window.partitionBy("seed").orderBy("k")
    z = spectrum(spark, sf_dir).where("k >= 13").withColumn("up", F.col("E") > F.lag("E").over(w))
    run = z.where("up").withColumn("run", F.col("k") - F.row_number().over(w)).groupBy("seed", "run").agg(F.count("*").alias("c")).groupBy("seed").agg(F.max("c").alias("longest"))
    ranked = z.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("seed")))
    tail = ranked.where("r > floor(0.8D * n)").groupBy("seed").agg((F.max_by("E", "k") < F.min_by("E", "k")).alias("decays"))
    longest = F.coalesce("longest", F.lit(0)).cast("long")
    return tail.join(run, "seed", "left").select("seed", longest.alias("longest"), "decays", F.when((longest >= 3) | ~F.col("decays"), "**FAIL**").otherwise("pass").alias("verdict"))


@query("spec_compensated", with_(SPECTRUM, rest="SELECT seed, CAST(floor(max(pow(k, 5.0 / 3) * E) FILTER (k * 0.04 BETWEEN 0.08 AND 0.2) * 100 + 0.5) AS BIGINT) AS plateau_q, arg_max(k, pow(k, 5.0 / 3) * E) FILTER (k * 0.04 BETWEEN 0.08 AND 0.2) AS k_at FROM spectrum GROUP BY seed"))
def spec_compensated(spark, sf_dir):
    c = F.pow("k", F.lit(5.0 / 3)) * F.col("E")
    d = spectrum(spark, sf_dir).withColumn("c", F.when((F.col("k") * ETA).between(0.08, 0.2), c))
    return d.groupBy("seed").agg(q(F.max("c"), 100).alias("plateau_q"), F.max_by("k", "c").alias("k_at"))


def running(xs: Column) -> Column:
    """Count, total, mean and sum of squared deviations of the numbers of an array, taken one by one."""

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), (s["total"] + x).alias("total"), mean.alias("mean"), (s["m2"] + (x - s["mean"]) * (x - mean)).alias("m2"))

    return F.aggregate(xs, F.struct(*(F.lit(0.0).alias(c) for c in ("n", "total", "mean", "m2"))), step)


@query("spec_mean_std", with_(SPECTRUM, rest="SELECT k, CAST(floor(avg(E) * 1000 + 0.5) AS BIGINT) AS mean_q, CAST(floor(stddev_samp(E) * 1000 + 0.5) AS BIGINT) AS std_q FROM spectrum GROUP BY k"))
def spec_mean_std(spark, sf_dir):
    """Mean spectrum and its field-to-field spread (sample deviation), of fields in the order in which the table first has them: sums of doubles depend on it."""
    fields = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("met", "E"))), lambda f: f["E"]), lambda e: e.isNotNull())  # one a seed
    d = spectrum_met(spark, sf_dir).groupBy("k").agg(running(fields).alias("r"))
    n = F.col("r.n")
    return d.select("k", q(F.when(n > 0, F.col("r.total") / n), 1000).alias("mean_q"), q(F.when(n > 1, F.sqrt(F.col("r.m2") / (n - 1))), 1000).alias("std_q"))


@query("spec_kolmogorov_units", with_(SPECTRUM, rest="SELECT seed, k, CAST(floor(k * 0.04 * 1e6 + 0.5) AS BIGINT) AS k_eta_q, CAST(floor(E / pow(0.1 * pow(0.05, 5), 0.25) + 0.5) AS BIGINT) AS e_q FROM spectrum"))
def spec_kolmogorov_units(spark, sf_dir):
    return spectrum(spark, sf_dir).select("seed", "k", q(F.col("k") * ETA).alias("k_eta_q"), q(F.col("E") / F.pow(F.lit(0.1) * F.pow(F.lit(0.05), F.lit(5)), F.lit(0.25)), 1).alias("e_q"))


@query("spec_band_energy", with_(SPECTRUM, rest="SELECT seed, least((k - 1) // 8, 3) AS band, CAST(floor(sum(E) * 100 + 0.5) AS BIGINT) AS e_q FROM spectrum GROUP BY ALL"))
def spec_band_energy(spark, sf_dir):
    """Range join of modes and bands, done by arithmetic binning."""
    band = F.least(F.floor((F.col("k") - 1) / 8), F.lit(3)).cast("long")
    return spectrum(spark, sf_dir).groupBy("seed", band.alias("band")).agg(q(F.sum("E"), 100).alias("e_q"))

"""Time-series operators: ordinals, differences, splices, drifts, crossings, sentinels and decay fits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import RUN_TS, run_ts, with_
from ..model import q
from ..registry import query

NU = 0.0022
KMAX = 85.0


def diffs(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """d_<column>: the change since the row before, null in the first row."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def drift_percent(t: str, k: str, t_e: float) -> Column:
    """100 |slope| T_E / mean."""
    return 100 * F.abs(F.regr_slope(k, t)) * t_e / F.avg(k)


@query("ts_ordinal", with_(RUN_TS, rest="SELECT seed, event_id, ord, t_us FROM run_ts"))
def ts_ordinal(spark, sf_dir):
    return run_ts(spark, sf_dir).select("seed", "event_id", "ord", "t_us")


@query("ts_diff", with_(RUN_TS, rest="SELECT seed, ord, t_us - lag(t_us) OVER w AS d_us, c - lag(c) OVER w AS d_c FROM run_ts WINDOW w AS (PARTITION BY seed ORDER BY ord)"))
def ts_diff(spark, sf_dir):
    d = diffs(run_ts(spark, sf_dir), "seed", "ord", "t_us", "c")
    return d.select("seed", "ord", F.col("d_t_us").alias("d_us"), F.col("d_c"))


def splices(df: DataFrame, key: str, order: str, t: str, factor: float = 3.0) -> DataFrame:
    """Steps longer than factor times the key's own median step; keys of fewer than three rows are absent, a median of 0 or less gives 0."""
    d = diffs(df, key, order, t)
    med = d.groupBy(key).agg(F.median(f"d_{t}").alias("med"), F.count("*").alias("n")).where("n >= 3")
    return d.join(med, key).groupBy(key).agg(F.count_if((F.col("med") > 0) & (F.col(f"d_{t}") > factor * F.col("med"))).alias("splices"))


_D = "d AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY seed ORDER BY ord) AS dt FROM run_ts)"


@query("ts_splices", with_(RUN_TS, _D, "m AS (SELECT seed, median(dt) AS med, count(*) AS n FROM d GROUP BY seed HAVING count(*) >= 3)", rest="SELECT seed, count(*) FILTER (med > 0 AND dt > 3 * med) AS splices FROM d JOIN m USING (seed) GROUP BY seed"))
def ts_splices(spark, sf_dir):
    return splices(run_ts(spark, sf_dir), "seed", "ord", "t_us")


@query("ts_dt_cov", with_(RUN_TS, _D, rest="SELECT seed, CAST(floor(stddev_pop(dt) / avg(dt) * 1e6 + 0.5) AS BIGINT) AS cov_q, stddev_pop(dt) / avg(dt) > 0.05 AS uneven FROM d GROUP BY seed"))
def ts_dt_cov(spark, sf_dir):
    """Coefficient of variation of the step; over 0.05 the sampling counts as uneven."""
    cov = F.stddev_pop("d_t_us") / F.avg("d_t_us")
    return diffs(run_ts(spark, sf_dir), "seed", "ord", "t_us").groupBy("seed").agg(q(cov).alias("cov_q"), (cov > 0.05).alias("uneven"))


@query("ts_drift_slope", with_(RUN_TS, rest="SELECT seed, CAST(floor(100 * abs(regr_slope(K, t)) * 1.665 / avg(K) * 1e6 + 0.5) AS BIGINT) AS drift_q, 100 * abs(regr_slope(K, t)) * 1.665 / avg(K) <= 1 AS steady FROM run_ts GROUP BY seed"))
def ts_drift_slope(spark, sf_dir):
    d = drift_percent("t", "K", 1.665)
    return run_ts(spark, sf_dir).groupBy("seed").agg(q(d).alias("drift_q"), (d <= 1).alias("steady"))


def last_window(df: DataFrame, key: str, t: str, span: float) -> DataFrame:
    """Rows of the last `span` of each key's time."""
    end = df.groupBy(key).agg(F.max(t).alias("end"))
    return df.join(end, key).where(F.col(t) >= F.col("end") - span)


@query("ts_last_window_drift", with_(RUN_TS, "e AS (SELECT seed, max(t) AS tend FROM run_ts GROUP BY seed)", rest="SELECT seed, count(*) AS n, CAST(floor(regr_slope(K, t) * 1e6 + 0.5) AS BIGINT) AS slope_q FROM run_ts JOIN e USING (seed) WHERE t >= tend - 5 GROUP BY seed"))
def ts_last_window_drift(spark, sf_dir):
    return last_window(run_ts(spark, sf_dir), "seed", "t", 5.0).groupBy("seed").agg(F.count("*").alias("n"), q(F.regr_slope("K", "t")).alias("slope_q"))


@query("ts_half_means", with_(RUN_TS, "n AS (SELECT seed, count(*) AS n FROM run_ts GROUP BY seed)", rest="SELECT seed, CAST(sum(c) FILTER (ord < n // 2) AS BIGINT) AS c_first, CAST(sum(c) FILTER (ord >= n // 2) AS BIGINT) AS c_second FROM run_ts JOIN n USING (seed) GROUP BY seed"))
def ts_half_means(spark, sf_dir):
    r = run_ts(spark, sf_dir)
    n = r.groupBy("seed").agg(F.count("*").alias("n"))
    first = F.col("ord") < F.floor(F.col("n") / 2)
    return r.join(n, "seed").groupBy("seed").agg(F.sum(F.when(first, F.col("c"))).alias("c_first"), F.sum(F.when(~first, F.col("c"))).alias("c_second"))


@query("ts_monotone_frac", with_(RUN_TS, "d AS (SELECT seed, c - lag(c) OVER (PARTITION BY seed ORDER BY ord) AS dc FROM run_ts)", rest="SELECT seed, count(*) FILTER (dc > 0) AS rising, count(dc) AS steps, 2 * count(*) FILTER (dc > 0) < count(dc) AS decays FROM d GROUP BY seed"))
def ts_monotone_frac(spark, sf_dir):
    d = diffs(run_ts(spark, sf_dir), "seed", "ord", "c")
    rising = F.count_if(F.col("d_c") > 0)
    return d.groupBy("seed").agg(rising.alias("rising"), F.count("d_c").alias("steps"), (2 * rising < F.count("d_c")).alias("decays"))


def k_max_eta(eps: Column, nu: float = NU, kmax: float = KMAX) -> Column:
    """kmax times the Kolmogorov length, which is infinite where nothing is dissipated."""
    return kmax * F.pow(F.when(eps == 0, F.lit(math.inf)).otherwise(nu**3 / eps), F.lit(0.25))


_ETA = f"{KMAX} * pow(CAST({NU**3!r} AS DOUBLE) / (eps / 1000), 0.25)"


@query("ts_inst_resolution", with_(RUN_TS, rest=f"SELECT seed, count(*) FILTER (eps / 1000 > 1e-30 AND {_ETA} >= 1.5) AS fine, count(*) AS n, count(*) FILTER (eps / 1000 > 1e-30 AND {_ETA} >= 1.5) >= 0.95 * count(*) AS resolved FROM run_ts GROUP BY seed"))
def ts_inst_resolution(spark, sf_dir):
    """Share of rows with instantaneous kmax eta of 1.5 or more; vanishing dissipation counts as unresolved."""
    eps = F.col("eps") / 1000
    fine = F.count_if((eps > 1e-30) & (k_max_eta(eps) >= 1.5))
    return run_ts(spark, sf_dir).groupBy("seed").agg(fine.alias("fine"), F.count("*").alias("n"), (fine >= 0.95 * F.count("*")).alias("resolved"))


@query("ts_frame_gate", with_(RUN_TS, rest=f"SELECT seed, count(*) AS seen, count(*) FILTER ({_ETA} >= 1.5) AS exported, count(*) FILTER ({_ETA} < 1.5) AS skipped FROM run_ts GROUP BY seed"))
def ts_frame_gate(spark, sf_dir):
    eta = k_max_eta(F.col("eps") / 1000)
    return run_ts(spark, sf_dir).groupBy("seed").agg(F.count("*").alias("seen"), F.count_if(eta >= 1.5).alias("exported"), F.count_if(eta < 1.5).alias("skipped"))


def islands(df: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """The flagged rows with `island`, a number for each run of consecutive flagged rows."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumn("flag", F.coalesce(flag, F.lit(False)))
    starts = (F.col("flag") & ~F.coalesce(F.lag("flag").over(w), F.lit(False))).cast("int")
    return d.withColumn("starts", starts).withColumn("island", F.sum("starts").over(w)).where("flag").drop("starts", "flag")


_LOW = """f AS (SELECT *, c < 5000 AS low, lag(c < 5000) OVER (PARTITION BY seed ORDER BY ord) AS was FROM run_ts),
i AS (SELECT *, sum(CASE WHEN low AND NOT coalesce(was, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY seed ORDER BY ord) AS island FROM f)"""


@query("ts_sentinel", with_(RUN_TS, _LOW, rest="SELECT seed, CAST(max(span) AS BIGINT) AS longest_us, bool_or(span > 14400000000) AS abort FROM (SELECT seed, island, max(t_us) - min(t_us) AS span FROM i WHERE low GROUP BY seed, island) GROUP BY seed"))
def ts_sentinel(spark, sf_dir):
    """Longest time for which the level stayed low without a break; too long aborts the run."""
    low = islands(run_ts(spark, sf_dir), "seed", "ord", F.col("c") < 5000)
    spans = low.groupBy("seed", "island").agg((F.max("t_us") - F.min("t_us")).alias("span"))
    return spans.groupBy("seed").agg(F.max("span").alias("longest_us"), F.bool_or(F.col("span") > 14_400_000_000).alias("abort"))


@query("ts_longest_rise", with_(RUN_TS, "r AS (SELECT *, coalesce(c > lag(c) OVER (PARTITION BY seed ORDER BY ord), FALSE) AS up FROM run_ts), g AS (SELECT *, ord - row_number() OVER (PARTITION BY seed, up ORDER BY ord) AS grp FROM r)", rest="SELECT seed, max(n) AS longest FROM (SELECT seed, grp, count(*) AS n FROM g WHERE up GROUP BY seed, grp) GROUP BY seed"))
def ts_longest_rise(spark, sf_dir):
    d = diffs(run_ts(spark, sf_dir), "seed", "ord", "c")
    return islands(d, "seed", "ord", F.col("d_c") > 0).groupBy("seed", "island").agg(F.count("*").alias("n")).groupBy("seed").agg(F.max("n").alias("longest"))


@query("ts_cadence_sample", with_(RUN_TS, rest="SELECT seed, t_us // 43200000000 AS bucket, min(ord) AS ord FROM run_ts GROUP BY ALL"))
def ts_cadence_sample(spark, sf_dir):
    """The first row at or after every half day: the earliest of each bucket."""
    return run_ts(spark, sf_dir).groupBy("seed", F.floor(F.col("t_us") / 43_200_000_000).cast("long").alias("bucket")).agg(F.min("ord").alias("ord"))


@query("ts_first_dropped_mean", with_(RUN_TS, _D, rest="SELECT seed, CAST(sum(dt) FILTER (ord > 1) AS BIGINT) AS dt_sum, count(*) FILTER (ord > 1) AS n FROM d GROUP BY seed"))
def ts_first_dropped_mean(spark, sf_dir):
    """Steps without the first, which follows the start-up."""
    d = diffs(run_ts(spark, sf_dir), "seed", "ord", "t_us")
    late = F.col("ord") > 1
    return d.groupBy("seed").agg(F.sum(F.when(late, F.col("d_t_us"))).alias("dt_sum"), F.count_if(late).alias("n"))


@query("ts_k_budget", with_(RUN_TS, rest="SELECT seed, CAST(floor(100 * abs(regr_slope(K, t)) / greatest(avg(eps), 1e-30) * 1e6 + 0.5) AS BIGINT) AS closure_q FROM run_ts GROUP BY seed"))
def ts_k_budget(spark, sf_dir):
    """Closure by the energy budget: 100 |dK/dt| over the mean dissipation."""
    return run_ts(spark, sf_dir).groupBy("seed").agg(q(100 * F.abs(F.regr_slope("K", "t")) / F.greatest(F.avg("eps"), F.lit(1e-30))).alias("closure_q"))


def first_crossing(df: DataFrame, key: str, order: str, value: str, threshold: float, below: bool = False, dt: float = 1.0) -> DataFrame:
    """Where `value` first reaches the threshold (or falls under it), interpolated within the step: 0 if at once, the last index if never."""
    w = Window.partitionBy(key).orderBy(order)
    hit = F.col(value) < threshold if below else F.col(value) >= threshold
    d = df.select(key, (F.row_number().over(w) - 1).alias("i"), F.col(value).alias("v"), F.lag(value).over(w).alias("before"), hit.alias("hit"))
    part = (threshold - F.col("before")) / F.when(F.col("v") != F.col("before"), F.col("v") - F.col("before"))
    at = F.when(F.col("i") == 0, 0.0).otherwise(F.col("i") - 1 + F.coalesce(part, F.lit(0.0)))
    return d.groupBy(key).agg(F.coalesce(F.min_by(F.when(F.col("hit"), at), F.when(F.col("hit"), F.col("i"))), F.max("i").cast("double")).alias("x")).select(key, (F.col("x") * dt).alias("crossing"))


_CROSS = """x AS (SELECT seed, ord, K, lag(K) OVER (PARTITION BY seed ORDER BY ord) AS before FROM run_ts),
h AS (SELECT seed, min(ord) FILTER ({hit}) AS hit, max(ord) AS last FROM x GROUP BY seed)"""


@query("m_effective_time", with_(RUN_TS, _CROSS.format(hit="K >= 480"), rest="SELECT h.seed, CAST(floor(CASE WHEN hit IS NULL THEN last WHEN hit = 0 THEN 0 ELSE hit - 1 + (480 - before) / (K - before) END * 1e6 + 0.5) AS BIGINT) AS ept_q FROM h LEFT JOIN x ON x.seed = h.seed AND x.ord = h.hit"))
def m_effective_time(spark, sf_dir):
    return first_crossing(run_ts(spark, sf_dir), "seed", "ord", "K", 480.0).select("seed", q("crossing").alias("ept_q"))


@query("m_corr_time", with_(RUN_TS, _CROSS.format(hit="K < 2"), rest="SELECT h.seed, CAST(floor(CASE WHEN hit IS NULL THEN last WHEN hit = 0 THEN 0 ELSE hit - 1 + (2 - before) / (K - before) END * 1e6 + 0.5) AS BIGINT) AS time_q FROM h LEFT JOIN x ON x.seed = h.seed AND x.ord = h.hit"))
def m_corr_time(spark, sf_dir):
    return first_crossing(run_ts(spark, sf_dir), "seed", "ord", "K", 2.0, below=True).select("seed", q("crossing").alias("time_q"))


@query("decay_window_start", with_(RUN_TS, "n AS (SELECT seed, count(*) AS n, max(ord) FILTER (c % 100 < 3) AS below, max_by(ord, (c, -ord)) AS peak FROM run_ts GROUP BY seed)", rest="SELECT seed, greatest(coalesce(below + 1, 0), peak, CAST(floor(0.02 * n) AS BIGINT))::BIGINT AS start FROM n"))
def decay_window_start(spark, sf_dir):
    """Start of the self-similar window: after the last unresolved row, the peak and the first two hundredths."""
    r = run_ts(spark, sf_dir)
    n = r.groupBy("seed").agg(F.count("*").alias("n"), F.max(F.when(F.col("c") % 100 < 3, F.col("ord"))).alias("below"), F.max_by("ord", F.struct("c", -F.col("ord"))).alias("peak"))
    return n.select("seed", F.greatest(F.coalesce(F.col("below") + 1, F.lit(0)).cast("long"), F.col("peak").cast("long"), F.floor(0.02 * F.col("n")).cast("long")).alias("start"))


def decay_fit(df: DataFrame, key: str, t: str, k: str, offsets: int = 40, least: int = 20) -> DataFrame:
    """Power-law fit over a grid of virtual origins before the first time: the origin with the highest R2, the first on ties."""
    first = df.groupBy(key).agg(F.min(t).alias("first"), F.count("*").alias("n")).where(f"n >= {least}")
    grid = first.select(key, "first", F.posexplode(F.sequence(F.lit(0), F.lit(offsets - 1))).alias("g", "g2"))
    t0 = F.col("first") - 5 + F.col("g") * ((5 - 1e-3) / (offsets - 1))
    j = df.join(F.broadcast(grid.select(key, "g", t0.alias("t0"))), key)  # one row for each key and origin
    lx, ly = F.log(F.col(t) - F.col("t0")), F.log(k)
    fits = j.where(F.col(k) > 0).groupBy(key, "g", "t0").agg(F.regr_r2(ly, lx).alias("r2"), F.regr_slope(ly, lx).alias("slope"))
    best = F.max_by(F.struct("g", "t0", "r2", "slope"), F.struct(F.round("r2", 9), -F.col("g")))
    return fits.groupBy(key).agg(best.alias("b")).select(key, "b.*")


@query(
    "decay_fit_grid",
    with_(RUN_TS, "f AS (SELECT seed, min(t) AS t1 FROM run_ts GROUP BY seed HAVING count(*) >= 20)", "g AS (SELECT seed, g, t1 - 5 + g * ((5 - 1e-3::DOUBLE) / 39) AS t0 FROM f, range(0, 40) AS r(g))",
          "fits AS (SELECT seed, g, regr_r2(ln(K), ln(t - t0)) AS r2, regr_slope(ln(K), ln(t - t0)) AS slope FROM run_ts JOIN g USING (seed) WHERE K > 0 GROUP BY seed, g)",
          rest="SELECT seed, CAST(g AS INTEGER) AS g, CAST(floor(r2 * 1e6 + 0.5) AS BIGINT) AS r2_q, CAST(floor(-slope * 1e6 + 0.5) AS BIGINT) AS alpha_q FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(r2, 9) DESC, g) AS k FROM fits) WHERE k = 1"),
)
def decay_fit_grid(spark, sf_dir):
    return decay_fit(run_ts(spark, sf_dir), "seed", "t", "K").select("seed", "g", q("r2").alias("r2_q"), q(-F.col("slope")).alias("alpha_q"))


@query(
    "decay_gates",
    with_(RUN_TS, "d AS (SELECT *, c > lag(c) OVER (PARTITION BY seed ORDER BY ord) AS up FROM run_ts)", f"a AS (SELECT seed, 2 * count(*) FILTER (up) < count(up) AS falls, max(eps) < 50 AS bounded, min({_ETA}) >= 1.5 AS resolved, bool_and(isfinite(K)) AS finite FROM d GROUP BY seed)",
          rest="SELECT seed, item, CASE WHEN ok THEN 'pass' ELSE '**FAIL**' END AS verdict FROM (SELECT seed, 'DEC2_falls' AS item, falls AS ok FROM a UNION ALL SELECT seed, 'DEC2_bounded', bounded AND finite FROM a UNION ALL SELECT seed, 'DEC3_resolved', resolved FROM a)"),
)
def decay_gates(spark, sf_dir):
    d = diffs(run_ts(spark, sf_dir), "seed", "ord", "c")
    finite = ~F.isnan("K") & (F.abs("K") != math.inf)
    a = d.groupBy("seed").agg((2 * F.count_if(F.col("d_c") > 0) < F.count("d_c")).alias("falls"), ((F.max("eps") < 50) & F.bool_and(finite)).alias("bounded"), (F.min(k_max_eta(F.col("eps") / 1000)) >= 1.5).alias("resolved"))
    rows = F.inline(F.array(*(F.struct(F.lit(i).alias("item"), F.when(F.col(c), "pass").otherwise("**FAIL**").alias("verdict")) for i, c in (("DEC2_falls", "falls"), ("DEC2_bounded", "bounded"), ("DEC3_resolved", "resolved")))))
    return a.select("seed", rows)


def cfl_step(umax: Column, left: Column, dx: float, cfl: float, dt_max: float) -> Column:
    """Courant step, snapped down to dt_max 0.99^n; lands on the target when it is nearer."""
    dt = F.least(cfl * dx / umax, F.lit(dt_max))
    n = F.ceil(F.log(dt / dt_max) / math.log(0.99) - 1e-12)
    return F.least(dt_max * F.pow(F.lit(0.99), n.cast("double")), left)


@query("ts_cfl_step", with_(RUN_TS, rest=f"SELECT seed, ord, CAST(floor(least(0.02 * pow(0.99, ceil(ln(least(0.5 * 0.02 / K * 100, 0.02) / 0.02) / {math.log(0.99)!r}::DOUBLE - 1e-12)), 0.015) * 1e9 + 0.5) AS BIGINT) AS dt_q FROM run_ts WHERE K > 0"))
def ts_cfl_step(spark, sf_dir):
    return run_ts(spark, sf_dir).where("K > 0").select("seed", "ord", q(cfl_step(F.col("K") / 100, F.lit(0.015), 0.02, 0.5, 0.02), 1e9).alias("dt_q"))


def fading_sum(rows: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """b = b/2 + x in order 0..n, over all rows of a key: a sum weighted by 1/2 to the power of the rows that follow, in partial sums."""
    end = rows.groupBy(key).agg(F.max(order).alias("n"))
    return rows.join(end, key).groupBy(key).agg(F.sum(F.pow(F.lit(0.5), F.col("n") - F.col(order)) * F.col(x)).alias("b"))


@query("ou_fold", with_(RUN_TS, rest="SELECT seed, CAST(floor(sum(pow(0.5, n - ord) * c) * 1000 + 0.5) AS BIGINT) AS b_q FROM (SELECT *, max(ord) OVER (PARTITION BY seed) AS n FROM run_ts) GROUP BY seed"))
def ou_fold(spark, sf_dir):
    """Exponentially fading memory b = b/2 + x, folded in time order over each seed's whole series."""
    return fading_sum(run_ts(spark, sf_dir), "seed", "ord", "c").select("seed", q("b", 1000).alias("b_q"))

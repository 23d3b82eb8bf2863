"""Reviews of runs and releases: sanity of a decay, spectra against a reference, shells and their gains, times from file names, a guard of earlier scores.

Defined cases: a run without rows has no review; nulls and non-finite levels fail the check that reads them; a fit
of fewer than three points has no slope and no difference; a name without a time has none and lies in no window; a shell
without energy gets no gain; guards raise and name what they refuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import RESULT_ROWS, RUN_TS, SPECTRUM, result_rows, run_ts, spectrum, table, with_
from ..model import q
from ..registry import query
from . import separable as S

_finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def decay_check(series: DataFrame, key: str, start: float | None = None, most_eps: float = 50.0) -> DataFrame:
    """(key, n, why) of series (key, ord, t, K, eps): what speaks against an unforced run, null if nothing does. It must start where it was resumed, lose energy, keep its dissipation bounded and rise on no more than half of its steps."""
    w = Window.partitionBy(key).orderBy("ord")
    s = series.withColumn("rises", F.col("K") > F.lag("K").over(w))
    first, last = (lambda c: F.min_by(c, "ord")), (lambda c: F.max_by(c, "ord"))
    g = s.groupBy(key).agg(
        F.count("*").alias("n"), first("t").alias("t0"), first("K").alias("k0"), last("K").alias("k1"), F.bool_and(_finite("K")).alias("k_ok"), F.bool_and(_finite("eps")).alias("eps_ok"), F.max("eps").alias("eps_max"),
        F.count_if("rises").alias("rising"), F.count("rises").alias("steps"),
    )
    reasons = [
        F.when(F.lit(start is not None) & (F.abs(F.col("t0") - F.lit(start)) > 0.05), "start"), F.when(~F.col("k_ok"), "K not finite").when(F.col("k1") >= F.col("k0"), "no decay"),
        F.when(~F.col("eps_ok") | (F.col("eps_max") > most_eps), "blow-up"), F.when((F.col("n") > 10) & (F.col("rising") > 0.5 * F.col("steps")), "rises"),
    ]
    return g.select(key, "n", F.nullif(F.array_join(F.array_compact(F.array(*reasons)), ", "), F.lit("")).alias("why"))


#: Further windows of the comparison.
WINDOWS = [(0.10, 0.25), (0.10, 0.30), (0.075, 0.25)]


def slope_differences(spectra: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(key, window, lo, hi, slope, reference, difference) of spectra (key, k, E, eta) against one reference (k, E, eta) in units of eta. Window 0 begins where both are past twice their peak and ends at 0.25; the others are fixed, to show how much the window matters."""
    at = lambda df, keys: df.withColumn("x", F.col("k") * F.col("eta")).groupBy(*keys).agg(
        F.max_by("x", F.struct("E", -F.col("k"))).alias("peak"), F.min("x").alias("least"), F.max("x").alias("most"), F.collect_list(F.when(F.col("E") > 0, F.struct("x", "E"))).alias("points")
    )
    own = at(spectra, [key])
    ref = at(reference, []).select(*(F.col(c).alias(f"r_{c}") for c in ("peak", "least", "most", "points")))
    both = own.crossJoin(F.broadcast(ref))  # one row of a spectrum's shells
    first = F.struct(F.lit(0).alias("window"), F.greatest(2 * F.col("peak"), 2 * F.col("r_peak"), "least", "r_least").alias("lo"), F.least(F.lit(0.25), "most", "r_most").alias("hi"))
    rows = both.withColumn("w", F.explode(F.array(first, *(F.struct(F.lit(i + 1).alias("window"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(WINDOWS)))))

    def slope(points: str) -> Column:
        """Least squares of ln E on ln x within the window."""
        p = F.transform(F.filter(points, lambda s: (s["x"] >= F.col("w.lo")) & (s["x"] <= F.col("w.hi"))), lambda s: F.struct(F.ln(s["x"]).alias("x"), F.ln(s["E"]).alias("y")))
        n = F.size(p)
        mean = lambda f: F.aggregate(p, F.lit(0.0), lambda a, s: a + f(s)) / F.nullif(n, F.lit(0))
        mx, my = mean(lambda s: s["x"]), mean(lambda s: s["y"])
        return F.when(n >= 3, F.try_divide(mean(lambda s: s["x"] * s["y"]) - mx * my, mean(lambda s: s["x"] * s["x"]) - mx * mx))

    return rows.select(key, "w.window", "w.lo", "w.hi", slope("points").alias("slope"), slope("r_points").alias("reference")).withColumn("difference", F.abs(F.col("slope") - F.col("reference")))


def modes_of(planes: DataFrame, n: int) -> DataFrame:
    """(frame, kz, ky, kx, shell, w, re_u .. im_w): the velocity's modes as rows, with the shell round(|k|) and the weight of the half axis."""
    h = n // 2 + 1
    m = S.forward(planes, n, [0, 1, 2])
    names = [f"{p}_{u}" for p in ("re", "im") for u in "uvw"]
    rows = m.select("frame", S.wave(F.col("ky"), n).cast("int").alias("ky"), F.posexplode(F.arrays_zip(*(F.col(c[:2])[i % 3].alias(c) for i, c in enumerate(names)))).alias("at", "v"))
    kz, kx = S.wave(F.floor(F.col("at") / h), n).cast("int"), (F.col("at") % h).cast("int")
    rows = rows.select("frame", kz.alias("kz"), "ky", kx.alias("kx"), *(F.col(f"v.{c}").alias(c) for c in names))
    size = F.sqrt(F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky") + F.col("kz") * F.col("kz"))
    # |k| is never half a whole number, so that round and [s - 1/2, s + 1/2) give the same shells.
    return rows.withColumn("shell", F.floor(size + 0.5).cast("int")).withColumn("w", F.when((F.col("kx") == 0) | (F.col("kx") * 2 == n), 1).otherwise(2))


_NAMES = [f"{p}_{u}" for u in "uvw" for p in ("re", "im")]


def shells(modes: DataFrame, n: int) -> DataFrame:
    """(frame, shell, E): the energy of each shell up to n / 2; beyond, shells are not whole and are left out."""
    e = sum((F.col(c) * F.col(c) for c in _NAMES[1:]), F.col(_NAMES[0]) * F.col(_NAMES[0]))
    return modes.where(F.col("shell") * 2 <= n).groupBy("frame", "shell").agg((0.5 * F.sum(F.col("w") * e) / float(n**6)).alias("E"))


def shaped(modes: DataFrame, spectra: DataFrame, target: DataFrame) -> DataFrame:
    """Modes whose shells have the target's energy (shell, E): each is multiplied by its shell's gain, by an equi-join on frame and shell; shells without a target or energy vanish."""
    gain = spectra.join(target.select("shell", F.col("E").alias("goal")), "shell").select("frame", "shell", F.sqrt(F.try_divide("goal", "E")).alias("gain"))
    g = F.coalesce("gain", F.lit(0.0))
    return modes.join(gain, ["frame", "shell"], "left").select("frame", "kz", "ky", "kx", "shell", "w", *((F.col(c) * g).alias(c) for c in _NAMES))


def snap_times(files: DataFrame) -> DataFrame:
    """Files with `t`, the time in a name such as run_t12.5.npy; null if there is none."""
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[A-Za-z]+$", "")
    return files.withColumn("t", F.get(F.split(stem, "_t"), F.lit(1)).try_cast("double"))


def within(files: DataFrame, windows: DataFrame) -> DataFrame:
    """Files (case, t, ..) in the window (case, lo, hi) of their case, ends included."""
    return files.join(windows, "case").where((F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi"))).drop("lo", "hi")


def guard_scores(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that had a score and would have none: left out of `new` or without a value there."""
    return old.where("score is not null").select(*keys).distinct().join(new.where("score is not null").select(*keys).distinct(), keys, "left_anti")


def refuse_lost_scores(old: DataFrame, new: DataFrame, keys: list[str], allowed: int = 0) -> DataFrame:
    """`new`, unless it would blank scores that are there."""
    lost = guard_scores(old, new, keys)
    if (n := lost.count()) > allowed:
        raise ValueError(f"refused: {n} scores would be lost, such as {[tuple(r) for r in lost.orderBy(*keys).limit(5).collect()]}")
    return new


# --- queries


@query("decay_check", with_(RUN_TS, f"s AS (SELECT *, K > lag(K) OVER (PARTITION BY seed ORDER BY ord) AS rises FROM run_ts), g AS (SELECT seed, count(*) AS n, arg_min(t, ord) AS t0, arg_min(K, ord) AS k0, arg_max(K, ord) AS k1, max(eps) AS em, count(*) FILTER (rises) AS up, count(rises) AS steps FROM s GROUP BY seed)",
       rest="SELECT seed, n, nullif(concat_ws(', ', CASE WHEN abs(t0 - 0.01) > 0.05 THEN 'start' END, CASE WHEN k1 >= k0 THEN 'no decay' END, CASE WHEN em > 480 THEN 'blow-up' END, CASE WHEN n > 10 AND up > 0.5 * steps THEN 'rises' END), '') AS why FROM g"))
def q_decay_check(spark, sf_dir):
    return decay_check(run_ts(spark, sf_dir), "seed", 0.01, 480.0)


_ETA = "0.005 * (1 + seed % 3)"
_SLOPE = "(avg(ln(x) * ln(E)) - avg(ln(x)) * avg(ln(E))) / (avg(ln(x) * ln(x)) - avg(ln(x)) * avg(ln(x)))"


@query("slope_differences", with_(SPECTRUM, f"o AS (SELECT seed, k, E, k * {_ETA} AS x FROM spectrum), m AS (SELECT k, E, k * 0.008 AS x FROM (SELECT k, avg(E) AS E FROM spectrum GROUP BY k))",
       "ob AS (SELECT seed, arg_max(x, (E, -k)) AS peak, min(x) AS least, max(x) AS most FROM o GROUP BY seed), mb AS (SELECT arg_max(x, (E, -k)) AS peak, min(x) AS least, max(x) AS most FROM m)",
       "w AS (SELECT ob.seed, 0 AS win, greatest(2 * ob.peak, 2 * mb.peak, ob.least, mb.least) AS lo, least(0.25, ob.most, mb.most) AS hi FROM ob, mb UNION ALL SELECT seed, i, lo, hi FROM ob, (VALUES " + ", ".join(f"({i + 1}, {lo}, {hi})" for i, (lo, hi) in enumerate(WINDOWS)) + ") AS v(i, lo, hi))",
       f"so AS (SELECT w.seed, win, CASE WHEN count(x) >= 3 THEN {_SLOPE} END AS s FROM w LEFT JOIN o ON o.seed = w.seed AND x BETWEEN lo AND hi AND E > 0 GROUP BY ALL), sm AS (SELECT w.seed, win, CASE WHEN count(x) >= 3 THEN {_SLOPE} END AS s FROM w LEFT JOIN m ON x BETWEEN lo AND hi AND E > 0 GROUP BY ALL)",
       rest="SELECT so.seed, so.win AS \"window\", CAST(floor(so.s * 1e6 + 0.37) AS BIGINT) AS slope_q, CAST(floor(abs(so.s - sm.s) * 1e6 + 0.37) AS BIGINT) AS difference_q FROM so JOIN sm ON so.seed = sm.seed AND so.win = sm.win"))
def q_slope_differences(spark, sf_dir):
    """Each seed's spectrum against the mean of all."""
    s = spectrum(spark, sf_dir)
    own = s.withColumn("eta", F.lit(0.005) * (1 + F.col("seed") % 3))
    mean = s.groupBy("k").agg(F.avg("E").alias("E")).withColumn("eta", F.lit(0.008))
    d = slope_differences(own, mean, "seed")
    whole = lambda c: F.floor(F.col(c) * 1e6 + 0.37).cast("long")
    return d.select("seed", "window", whole("slope").alias("slope_q"), whole("difference").alias("difference_q"))


_SHELLS = "x AS (SELECT *, CAST(floor(sqrt(kx * kx + ky * ky + kz * kz) + 0.5) AS INTEGER) AS shell FROM b), sh AS (SELECT frame, shell, 0.5 * sum(w * (" + " + ".join(f"{c} * {c}" for c in _NAMES) + ")) / 262144.0 AS E FROM x WHERE shell <= 4 GROUP BY frame, shell)"


@query("spectrum_shells_n8", f"WITH {S._sql_field(8, [0, 1, 2])}, {S._UVW}, {_SHELLS} SELECT frame, shell, CAST(floor(E / 1e3 + 0.37) AS BIGINT) AS e_q FROM sh")
def spectrum_shells_n8(spark, sf_dir):
    return shells(modes_of(S.planes_of(spark, sf_dir, 8), 8), 8).select("frame", "shell", F.floor(F.col("E") / 1e3 + 0.37).cast("long").alias("e_q"))


@query("shell_gain_n8", f"WITH {S._sql_field(8, [0, 1, 2])}, {S._UVW}, {_SHELLS}, goal AS (SELECT shell, avg(E) AS goal FROM sh GROUP BY shell) SELECT frame, kz, ky, kx, " + ", ".join(f"CAST(floor({c} * coalesce(CASE WHEN E <> 0 THEN sqrt(goal / E) END, 0) + 0.37) AS BIGINT) AS {c}" for c in _NAMES) + " FROM x LEFT JOIN sh USING (frame, shell) LEFT JOIN goal USING (shell)")
def shell_gain_n8(spark, sf_dir):
    """Every frame shaped to the mean spectrum of all."""
    m = modes_of(S.planes_of(spark, sf_dir, 8), 8)
    e = shells(m, 8)
    out = shaped(m, e, e.groupBy("shell").agg(F.avg("E").alias("E")))
    return out.select("frame", "kz", "ky", "kx", *(F.floor(F.col(c) + 0.37).cast("long").alias(c) for c in _NAMES))


@query("snapshots_in_window", """WITH f AS (SELECT o_orderkey, 'c' || o_custkey % 5 AS "case", CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 1000) / 8.0 END AS t FROM orders), w AS (SELECT 'c' || s_suppkey % 5 AS "case", min(s_suppkey) / 4.0 AS lo, 20.0 + max(s_suppkey) / 4.0 AS hi FROM supplier GROUP BY 1)
  SELECT o_orderkey, f."case", CAST(floor(t * 1000 + 0.5) AS BIGINT) AS t_q FROM f JOIN w ON f."case" = w."case" AND t BETWEEN lo AND hi""")
def snapshots_in_window(spark, sf_dir):
    """Times out of file names, kept where the case's window holds them."""
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 7 == 0, F.lit("final.npy")).otherwise(F.concat(F.lit("snap_t"), ((F.col("o_orderkey") % 1000) / 8.0).cast("string"), F.lit(".npy")))
    files = o.select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey") % 5).alias("case"), F.concat(F.lit("runs/a_t1/"), name).alias("file"))
    s = table(spark, sf_dir, "supplier")
    windows = s.groupBy(F.concat(F.lit("c"), F.col("s_suppkey") % 5).alias("case")).agg((F.min("s_suppkey") / 4.0).alias("lo"), (20.0 + F.max("s_suppkey") / 4.0).alias("hi"))
    return within(snap_times(files), windows).select("o_orderkey", "case", q("t", 1000).alias("t_q"))


@query("lost_scores", with_(RESULT_ROWS, rest="""SELECT DISTINCT model, task, "case" FROM result_rows WHERE root = 'O' EXCEPT SELECT model, task, "case" FROM result_rows WHERE root = 'F' """))
def lost_scores(spark, sf_dir):
    """Scores of one root that a release of the other would blank."""
    r = result_rows(spark, sf_dir).withColumnRenamed("nrmse", "score")
    return guard_scores(r.where("root = 'O'"), r.where("root = 'F'"), ["model", "task", "case"])

"""The acceptance standard of a run, measured: resolution from spectrum and series, budgets and spans from the series, isotropy, incompressibility, skewness and structure functions from fields.

Items (bands are fixed values): A1 k_max eta; A2 resolved share of the dissipation in percent, with an
exponential tail beyond the grid; A3 the dissipation's peak; A4 upticks of the spectral tail; A5 box over
integral scale; A6 Courant number and step over eta's time; A7 drift in a turnover time; A8 closure
of the budget by dK/dt; A9 spans in turnover times; A10 moments, A11 gradients, A12 divergence, A13 skewness.
B items and the share of instants that are resolved are reported and never gate.

Defined cases: what cannot be measured is null and its verdict MISSING, which does not pass: a tail of fewer than three
points or that does not fall, a run without spectrum, fields or samples. A dissipation that vanished
counts as unresolved. Of equal peaks the lowest wavenumber or lag counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import RUN_TS, SPECTRUM, run_ts, spectrum, with_
from ..registry import query
from . import separable as S
from .gates import appendix
from .spectra import summary

#: Viscosity, greatest wavenumber, points an axis and end of the spin-up of the queries' runs.
NU, K_MAX, POINTS, SPIN_UP = 0.05, 32, 64, 5.0
#: Least and greatest of each item that gates.
BANDS = {
    "A1": (1.5, None), "A2": (99.5, None), "A3_keta": (0.1, 0.4), "A3_share": (None, 0.5), "A4": (None, 0.0), "A5": (4.0, None), "A6_cfl": (None, 0.5), "A6_dt": (None, 0.05), "A7": (None, 1.0), "A8": (None, 2.0),
    "A9_spin": (5.0, None), "A9_span": (5.0, None), "A10_comp": (None, 5.0), "A10_cross": (None, 2.0), "A11_trans": (0.95, 1.05), "A11_eps15": (0.95, 1.05), "A12": (None, 1e-6), "A13": (0.45, 0.60),
}


_over = F.try_divide  # what has no divisor cannot be measured


def series_items(series: DataFrame, key: str, nu: float = NU, k_max: float = K_MAX, n: int = POINTS, spin_up: float = SPIN_UP) -> DataFrame:
    """Of series (key, ord, t, K, eps, umax) after the spin-up: eps, eta, slope and mean of K, span, Courant number, dt over eta's time, and the least and the resolved share of the instants' k_max eta."""
    every, sampled = Window.partitionBy(key).orderBy("ord"), Window.partitionBy(key, "sampled").orderBy("ord")
    s = series.withColumn("sampled", F.col("t") >= spin_up).withColumn("step", F.col("t") - F.lag("t").over(every)).withColumn("dt", F.col("t") - F.lag("t").over(sampled)).where("sampled")
    instant = F.when(F.col("eps") > 1e-30, k_max * F.pow(_over(F.lit(nu**3), F.col("eps")), F.lit(0.25))).otherwise(0.0)
    g = s.groupBy(key).agg(
        F.avg("eps").alias("eps"), F.regr_slope("K", "t").alias("slope"), F.avg("K").alias("K"), (F.max("t") - F.min("t")).alias("span"), F.max(F.col("umax") * F.col("step") / (2 * np.pi / n)).alias("cfl"),
        F.avg("dt").alias("dt"), F.min(instant).alias("least"), F.avg((instant >= 1.5).cast("double")).alias("share"),
    )
    return g.withColumn("eta", F.pow(_over(F.lit(nu**3), F.col("eps")), F.lit(0.25))).withColumn("A1", k_max * F.col("eta")).withColumn("A6_dt", F.col("dt") / F.sqrt(_over(F.lit(nu), F.col("eps"))))


def resolved(spectra: DataFrame, key: str, nu: float = NU, k_max: float = K_MAX) -> DataFrame:
    """Of spectra (key, k, E, eta): A2 (null if its tail is undetermined), the fit's slope and points, A3 and A4."""
    w = Window.partitionBy(key).orderBy("k")
    d = spectra.where(F.col("k") <= k_max).withColumn("D", 2 * nu * F.col("k") * F.col("k") * F.col("E")).withColumn("x", F.col("k") * F.col("eta"))
    d = d.withColumn("cell", 0.5 * (F.col("D") + F.lag("D").over(w)) * (F.col("k") - F.lag("k").over(w)))
    tail = F.col("x") >= 0.5
    up = Window.partitionBy(key, tail).orderBy("k")
    d = d.withColumn("up", tail & (F.col("E") > F.lag("E").over(up)))
    fits = tail & (F.col("D") > 0)
    y, x = F.when(fits, F.log(F.when(fits, F.col("D")))), F.when(fits, F.col("x"))
    g = d.groupBy(key).agg(
        F.sum("cell").alias("inside"), F.count(x).alias("points"), F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b"), F.first("eta").alias("eta"),
        F.max_by("k", F.struct("D", -F.col("k"))).alias("peak"), F.count_if("up").cast("double").alias("A4"),
    )
    beyond = -_over(F.exp(F.col("b") + F.col("a") * k_max * F.col("eta")), F.col("a") * F.col("eta"))
    a2 = F.when((F.col("points") >= 3) & (F.col("a") < 0), _over(100.0 * F.col("inside"), F.col("inside") + beyond))
    return g.select(key, a2.alias("A2"), "a", "points", (F.col("peak") * F.col("eta")).alias("A3_keta"), (F.col("peak") / float(k_max)).alias("A3_share"), "A4")


AXES = [(c, a) for c in range(3) for a in "xyz"]
_G = [f"g{c}{a}" for c, a in AXES]
_LONG, _ACROSS = ["g0x", "g1y", "g2z"], [g for g in _G if g not in ("g0x", "g1y", "g2z")]
_PAIRS = ("uu", "vv", "ww", "uv", "uw", "vw")


def field_items(planes: DataFrame, n: int) -> DataFrame:
    """Of each frame: signed moments uu .. vw, grad2, A11, A12, skewness and flatness of the longitudinal gradients. Gradients come from one forward and one inverse transform; sums over points combine before they are shuffled."""
    m = S.forward(planes, n, [0, 1, 2])
    made = [S.times_ik(F.col("re")[c], F.col("im")[c], a, n) for c, a in AXES] + [(F.col("re")[c], F.col("im")[c]) for c in range(3)]
    both = m.select("frame", "ky", F.array(*(x[0] for x in made)).alias("re"), F.array(*(x[1] for x in made)).alias("im"))
    p = S.points(S.inverse(both, n, 12), n, [*_G, "u", "v", "w"])
    power = lambda g, k: F.avg(F.pow(F.col(g), F.lit(k)))
    g = p.groupBy("frame").agg(
        *(F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in _PAIRS), *(F.avg(F.col(g) * F.col(g)).alias(f"{g}_2") for g in _G),
        *(power(g, k).alias(f"{g}_{k}") for g in _LONG for k in (3, 4)), F.avg((F.col("g0x") + F.col("g1y") + F.col("g2z")) * (F.col("g0x") + F.col("g1y") + F.col("g2z"))).alias("div2"),
    )
    total = lambda names: sum((F.col(f"{g}_2") for g in names[1:]), F.col(f"{names[0]}_2"))
    mean = lambda f: (f("g0x") + f("g1y") + f("g2z")) / 3
    g = g.withColumn("l2", total(_LONG) / 3).withColumn("t2", total(_ACROSS) / 6).withColumn("grad2", total(_G))
    return g.select(
        "frame", *_PAIRS, "grad2", _over(F.col("t2"), 2 * F.col("l2")).alias("trans"), _over(F.col("grad2"), 15 * F.col("l2")).alias("eps15"), _over(F.col("div2"), F.col("grad2")).alias("div"),
        mean(lambda g: _over(F.col(f"{g}_3"), F.pow(f"{g}_2", F.lit(1.5)))).alias("skew"), mean(lambda g: _over(F.col(f"{g}_4"), F.col(f"{g}_2") * F.col(f"{g}_2"))).alias("flat"),
    )


def lags(n: int) -> list[int]:
    """Lags spaced by a factor, from 1 to n / 2."""
    return np.unique(np.round(np.geomspace(1, n // 2, 24)).astype(int)).tolist()


def structure(planes: DataFrame, n: int) -> DataFrame:
    """(frame, r, s3): the mean cube of longitudinal differences, over the three axes. Differences are taken inside packed planes; the third axis is packed by one shuffle of that channel."""
    flat = planes.where("ch < 2").select("frame", "values", (F.col("ch") == 1).alias("down"))
    rows = planes.where("ch = 2").select("frame", "z", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda y: F.slice("values", y * n + 1, n))).alias("y", "row"))
    turned = rows.groupBy("frame", "y").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("z", "row"))), lambda s: s["row"])).alias("values")).select("frame", "values", F.lit(True).alias("down"))
    every = flat.unionByName(turned).where(F.size("values") == n * n).withColumn("r", F.explode(F.array(*map(F.lit, lags(n)))))
    at = lambda i: F.when(F.col("down"), (i + F.col("r") * n) % (n * n)).otherwise(F.floor(i / n) * n + (i + F.col("r")) % n).cast("int")
    cubes = F.transform("values", lambda v, i: F.pow(F.get("values", at(i)) - v, F.lit(3)))
    sums = every.select("frame", "r", F.aggregate(cubes, F.lit(0.0), lambda a, x: a + x).alias("s"))
    # A frame that lacks planes has no value.
    return sums.groupBy("frame", "r").agg(F.sum("s").alias("s"), F.count("*").alias("planes")).where(F.col("planes") == 3 * n).select("frame", "r", (F.col("s") / (3 * n**3)).alias("s3"))


def four_fifths(s3: DataFrame, fields: DataFrame, n: int, nu: float = NU) -> DataFrame:
    """(frame, B4, r): the greatest -S3 / (eps r), and its lag."""
    value = -_over(F.col("s3"), nu * F.col("grad2") * F.col("r") * (2 * np.pi / n))
    v = s3.join(fields.select("frame", "grad2"), "frame").select("frame", "r", value.alias("v"))
    return v.groupBy("frame").agg(F.max("v").alias("B4"), F.max_by("r", F.struct("v", -F.col("r"))).alias("r"))


def pooled(fields: DataFrame, key: str) -> DataFrame:
    """Of fields (key, ..): A10 from signed moments, pooled before they are made absolute; means of A11 and the skewness; the greatest A12."""
    g = fields.groupBy(key).agg(*(F.avg(c).alias(c) for c in (*_PAIRS, "trans", "eps15", "skew")), F.max("div").alias("A12"))
    k2 = F.col("uu") + F.col("vv") + F.col("ww")
    comp = 100.0 * F.greatest(*(F.abs(_over(3.0 * F.col(c), k2) - 1.0) for c in ("uu", "vv", "ww")))
    cross = 100.0 * _over(F.greatest(*(F.abs(F.col(c)) for c in ("uv", "uw", "vw"))), k2 / 3.0)
    return g.select(key, comp.alias("A10_comp"), cross.alias("A10_cross"), F.col("trans").alias("A11_trans"), F.col("eps15").alias("A11_eps15"), "A12", (-F.col("skew")).alias("A13"))


def measured(series: DataFrame, spectra: DataFrame, fields: DataFrame, key: str, nu: float = NU, k_max: float = K_MAX, n: int = POINTS, spin_up: float = SPIN_UP) -> DataFrame:
    """A row of all items for each run that has a series; the other tables are one row a run by then."""
    t = series_items(series, key, nu, k_max, n, spin_up)
    shape = summary(spectra, key, nu).select(key, "L", _over(F.col("L"), F.sqrt(2 * F.col("K") / 3)).alias("turnover"))
    tails = resolved(spectra.join(t.select(key, "eta"), key), key, nu, k_max)
    m = t.join(shape, key, "left").join(tails, key, "left").join(pooled(fields, key), key, "left")
    slope = F.abs("slope")
    return m.select(
        key, "A1", "A2", "A3_keta", "A3_share", "A4", _over(F.lit(2 * np.pi), F.col("L")).alias("A5"), F.col("cfl").alias("A6_cfl"), "A6_dt", _over(100.0 * slope * F.col("turnover"), F.col("K")).alias("A7"),
        (100.0 * slope / F.greatest("eps", F.lit(1e-30))).alias("A8"), _over(F.lit(spin_up), F.col("turnover")).alias("A9_spin"), _over(F.col("span"), F.col("turnover")).alias("A9_span"),
        "A10_comp", "A10_cross", "A11_trans", "A11_eps15", "A12", "A13",
    )


def overall(table: DataFrame, key: str) -> DataFrame:
    """Accepted if every item passes; the items that stand against it."""
    why = F.array_join(F.array_sort(F.collect_list(F.when(F.col("verdict") != "pass", F.col("item")))), ",")
    return table.groupBy(key).agg(F.bool_and(F.col("verdict") == "pass").alias("accepted"), F.nullif(why, F.lit("")).alias("why"))


# --- queries


def _q(c, scale: float = 1e6):
    """The odd offset keeps rational values away from the edge."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * scale + 0.37).cast("long")


def _sq(c: str, scale: str = "1e6") -> str:
    return f"CAST(floor(({c}) * {scale} + 0.37) AS BIGINT)"


def _series(spark, sf_dir) -> DataFrame:
    """The largest speed that the level allows for."""
    return run_ts(spark, sf_dir).withColumn("umax", F.sqrt(2 * F.col("K")))


_NU3 = f"CAST({NU**3!r} AS DOUBLE)"
_ITEMS = f"""st AS (SELECT *, t - lag(t) OVER (PARTITION BY seed ORDER BY ord) AS step FROM run_ts),
  sp AS (SELECT *, t - lag(t) OVER (PARTITION BY seed ORDER BY ord) AS dt, CASE WHEN eps > 1e-30 THEN {K_MAX} * pow({_NU3} / eps, 0.25) ELSE 0 END AS inst FROM st WHERE t >= {SPIN_UP}),
  ti AS (SELECT seed, avg(eps) AS eps, regr_slope(K, t) AS slope, avg(K) AS kk, max(t) - min(t) AS span, max(sqrt(2 * K) * step / (2 * pi() / {POINTS})) AS cfl, avg(dt) AS dt, min(inst) AS least, avg(CASE WHEN inst >= 1.5 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM sp GROUP BY seed),
  t1 AS (SELECT *, pow({_NU3} / eps, 0.25) AS eta FROM ti)"""


@query("std_series", with_(RUN_TS, _ITEMS, rest=f"SELECT seed, {_sq(f'{K_MAX} * eta')} AS a1, {_sq('least')} AS least, {_sq('share')} AS share, {_sq('cfl')} AS cfl, {_sq(f'dt / sqrt({NU} / eps)')} AS dt_tau, {_sq('slope')} AS slope, {_sq('span')} AS span FROM t1"))
def std_series(spark, sf_dir):
    s = series_items(_series(spark, sf_dir), "seed")
    return s.select("seed", _q("A1").alias("a1"), *(_q(c).alias(c) for c in ("least", "share", "cfl")), _q("A6_dt").alias("dt_tau"), _q("slope").alias("slope"), _q("span").alias("span"))


_TAIL = f"""d AS (SELECT s.seed, k, E, eta, 2 * {NU} * k * k * E AS D, k * eta AS x, k * eta >= 0.5 AS tail FROM spectrum s JOIN t1 USING (seed) WHERE k <= {K_MAX}),
  dd AS (SELECT *, 0.5 * (D + lag(D) OVER w) * (k - lag(k) OVER w) AS cell, tail AND E > lag(E) OVER (PARTITION BY seed, tail ORDER BY k) AS up FROM d WINDOW w AS (PARTITION BY seed ORDER BY k)),
  r0 AS (SELECT seed, sum(cell) AS inside, count(*) FILTER (tail AND D > 0) AS points, regr_slope(ln(D), x) FILTER (tail AND D > 0) AS a, regr_intercept(ln(D), x) FILTER (tail AND D > 0) AS b, any_value(eta) AS eta, arg_max(k, (D, -k)) AS peak, count(*) FILTER (up) AS a4 FROM dd GROUP BY seed),
  rs AS (SELECT *, CASE WHEN points >= 3 AND a < 0 THEN 100.0::DOUBLE * inside / (inside - exp(b + a * {K_MAX} * eta) / (a * eta)) END AS a2 FROM r0)"""


@query("std_resolved", with_(RUN_TS, SPECTRUM, _ITEMS, _TAIL, rest=f"SELECT seed, points, {_sq('a')} AS slope, {_sq('a2')} AS a2, {_sq('peak * eta')} AS a3, {_sq(f'peak / {float(K_MAX)}')} AS a3_share, a4 FROM rs"))
def std_resolved(spark, sf_dir):
    s = spectrum(spark, sf_dir).join(series_items(_series(spark, sf_dir), "seed").select("seed", "eta"), "seed")
    return resolved(s, "seed").select("seed", "points", _q("a").alias("slope"), _q("A2").alias("a2"), _q("A3_keta").alias("a3"), _q("A3_share").alias("a3_share"), F.col("A4").cast("long").alias("a4"))


def _sql_stats(n: int) -> str:
    """CTEs up to fs: the items of each frame, from points in millionths."""
    k = {"x": "kx", "y": "ky", "z": "kz"}
    dm = "dm AS (SELECT frame, kz, ky, kx, w, " + ", ".join(f"-{k[a]} * im_{'uvw'[c]} AS re_g{c}{a}, {k[a]} * re_{'uvw'[c]} AS im_g{c}{a}" for c, a in AXES) + " FROM b)"
    grid, back = S._sql_back(n, "dm", _G, n**3)
    back = back.replace("CAST(floor(", "(").replace(" + 0.37) AS BIGINT)", ")")
    two = lambda g: f"avg({g} * {g})"
    l2, t2, grad2 = (f"({' + '.join(map(two, names))})" for names in (_LONG, _ACROSS, _G))
    uvw = "pt AS (SELECT frame, z, y, x, " + ", ".join(f"max(CASE WHEN ch = {c} THEN q END) AS {u}" for c, u in enumerate("uvw")) + " FROM f GROUP BY ALL)"
    skew = " + ".join(f"avg({g} * {g} * {g}) / pow({two(g)}, 1.5)" for g in _LONG)
    flat = " + ".join(f"avg({g} * {g} * {g} * {g}) / pow({two(g)}, 2)" for g in _LONG)
    return f"""{S._sql_field(n, [0, 1, 2])},
  {S._UVW},
  {dm}, {grid}, gp AS ({back}), {uvw},
  gs AS (SELECT frame, {grad2} AS grad2, {t2} / 6 / (2 * {l2} / 3) AS trans, {grad2} / (15 * {l2} / 3) AS eps15, avg((g0x + g1y + g2z) * (g0x + g1y + g2z)) / {grad2} AS div, ({skew}) / 3 AS skew, ({flat}) / 3 AS flat FROM gp GROUP BY frame),
  us AS (SELECT frame, {", ".join(f"avg({a} * {b}) AS {a}{b}" for a, b in _PAIRS)} FROM pt GROUP BY frame),
  fs AS (SELECT * FROM gs JOIN us USING (frame))"""


def _register(n: int) -> None:
    names = ("trans", "eps15", "div", "skew", "flat")

    @query(f"std_fields_n{n}", f"WITH {_sql_stats(n)} SELECT frame, {_sq('grad2', '1e-3')} AS grad2, " + ", ".join(f"{_sq(c)} AS {c}" for c in names) + ", " + ", ".join(f"{_sq(c, '1e-3')} AS {c}" for c in _PAIRS) + " FROM fs")
    def std_fields(spark, sf_dir):
        f = field_items(S.planes_of(spark, sf_dir, n), n)
        return f.select("frame", _q("grad2", 1e-3).alias("grad2"), *(_q(c).alias(c) for c in names), *(_q(c, 1e-3).alias(c) for c in _PAIRS))

    pairs = " UNION ALL ".join(f"SELECT f.frame, r, pow(o.q - f.q, 3) AS c FROM f JOIN l ON TRUE JOIN f AS o ON o.frame = f.frame AND o.ch = f.ch AND o.{a} = (f.{a} + r) % {n} AND o.{b} = f.{b} AND o.{c} = f.{c} WHERE f.ch = {ch}" for ch, (a, b, c) in enumerate((("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))))
    s3 = f"""l AS (SELECT unnest([{", ".join(map(str, lags(n)))}]) AS r), s3 AS (SELECT frame, r, sum(c) / {3 * n**3} AS s3 FROM ({pairs}) GROUP BY frame, r)"""

    @query(f"std_structure_n{n}", f"WITH {_sql_stats(n)}, {s3}, v AS (SELECT frame, r, -s3 / ({NU} * grad2 * r * (2 * pi() / {n})) AS v FROM s3 JOIN fs USING (frame)) SELECT frame, {_sq('max(v)', '1e-3')} AS b4, CAST(arg_max(r, (v, -r)) AS INTEGER) AS r FROM v GROUP BY frame")
    def std_structure(spark, sf_dir):
        """The greatest compensated third-order structure function over spaced lags, and where it is."""
        p = S.planes_of(spark, sf_dir, n)
        return four_fifths(structure(p, n), field_items(p, n), n).select("frame", _q("B4", 1e-3).alias("b4"), F.col("r").cast("int").alias("r"))


for _n in (4, 8):
    _register(_n)

_K2 = "(uu + vv + ww)"
_POOLED = f"""po AS (SELECT frame % 10 AS seed, {", ".join(f"avg({c}) AS {c}" for c in (*_PAIRS, "trans", "eps15", "skew"))}, max(div) AS div FROM fs GROUP BY ALL),
  cs AS (SELECT *, 0.5 * (E + lag(E) OVER w) * (k - lag(k) OVER w) AS e_, 0.5 * (E / k + lag(E) OVER w / lag(k) OVER w) * (k - lag(k) OVER w) AS l_ FROM spectrum WHERE k > 0 AND E > 0 WINDOW w AS (PARTITION BY seed ORDER BY k)),
  sh AS (SELECT seed, pi() / (2 * (2 * sum(e_) / 3)) * sum(l_) AS L, pi() / (2 * (2 * sum(e_) / 3)) * sum(l_) / sqrt(2 * sum(e_) / 3) AS te FROM cs GROUP BY seed),
  a AS (SELECT t1.seed, {K_MAX} * t1.eta AS "A1", a2 AS "A2", peak * rs.eta AS "A3_keta", peak / {float(K_MAX)} AS "A3_share", a4 AS "A4", 2 * pi() / L AS "A5", cfl AS "A6_cfl", dt / sqrt({NU} / eps) AS "A6_dt", 100 * abs(slope) * te / kk AS "A7", 100 * abs(slope) / greatest(eps, 1e-30) AS "A8",
    {SPIN_UP} / te AS "A9_spin", span / te AS "A9_span", 100 * greatest(abs(3 * uu / {_K2} - 1), abs(3 * vv / {_K2} - 1), abs(3 * ww / {_K2} - 1)) AS "A10_comp", 100 * greatest(abs(uv), abs(uw), abs(vw)) / ({_K2} / 3) AS "A10_cross", trans AS "A11_trans", eps15 AS "A11_eps15", div AS "A12", -skew AS "A13"
    FROM t1 LEFT JOIN sh USING (seed) LEFT JOIN rs USING (seed) LEFT JOIN po USING (seed)),
  v AS (""" + " UNION ALL ".join(
    f"""SELECT seed, '{i}' AS item, "{i}" AS measured, CASE WHEN "{i}" IS NULL THEN 'MISSING' WHEN {' AND '.join(([f'"{i}" >= {lo}'] if lo is not None else []) + ([f'"{i}" <= {hi}'] if hi is not None else []))} THEN 'pass' ELSE '**FAIL**' END AS verdict FROM a""" for i, (lo, hi) in BANDS.items()
) + ")"
_SPECTRA = f"WITH {RUN_TS},\n{SPECTRUM},\n{_ITEMS},\n{_TAIL},\n{_sql_stats(8)},\n{_POOLED}\n"


def _table(spark, sf_dir) -> DataFrame:
    fields = field_items(S.planes_of(spark, sf_dir, 8), 8).withColumn("seed", F.col("frame") % 10)
    return appendix(measured(_series(spark, sf_dir), spectrum(spark, sf_dir), fields, "seed"), ["seed"], BANDS)


@query("std_table", _SPECTRA + f"SELECT seed, item, {_sq('measured', '1e4')} AS measured_q, verdict FROM v")
def std_table(spark, sf_dir):
    """Every item of every run, measured, with its verdict."""
    return _table(spark, sf_dir).select("seed", "item", _q("measured", 1e4).alias("measured_q"), "verdict")


@query("std_overall", _SPECTRA + "SELECT seed, bool_and(verdict = 'pass') AS accepted, string_agg(item, ',' ORDER BY item) FILTER (verdict <> 'pass') AS why FROM v GROUP BY seed")
def std_overall(spark, sf_dir):
    return overall(_table(spark, sf_dir), "seed")

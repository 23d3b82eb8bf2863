"""Subgrid stresses of filtered fields and their models: strain, stress, transfer, the dynamic coefficient, vorticity tails; pressures of rotating and buoyant flows.

Frames are packed rows of three velocity components; each is a task's own work on one Arrow
batch, for any number of points. The oracles have the same on relational modes of 4x4x4 fields.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixtures import FIELD4, with_
from ..model import q
from ..registry import query
from .dynamics import Box
from .spectral import _KK, _MODES, _PMODES, _PROD, UVW, abreast, curl, packed4, pressure

#: Components of a symmetric tensor in order, and how often each counts in a full contraction.
PAIRS = ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))
WEIGHT = np.array([1.0, 1, 1, 2, 2, 2])[:, None, None, None]
#: The dynamic coefficient's cap and the static model's constant.
CAP, STATIC = 0.09, 0.17
FRACTION = 0.25


def smooth(box: Box, f, fraction: float):
    """Gaussian filter of width fraction * 2 pi, of any number of fields."""
    width = fraction * 2 * math.pi
    return box.back(box.forward(f) * np.exp(-box.k2 * (width * width / 24)))


def strain(box: Box, u):
    """S_ij, six components."""
    h = box.forward(u)
    d = lambda i, j: box.back(1j * box.k[j] * h[i])
    return np.stack([(d(i, j) + d(j, i)) / 2 for i, j in PAIRS])


def size(s):
    """|S| = sqrt(2 S_ij S_ij)."""
    return np.sqrt(2 * (WEIGHT * s * s).sum(0) + 1e-20)


def products(u):
    return np.stack([u[i] * u[j] for i, j in PAIRS])


def stress(box: Box, u, fraction: float):
    """Subgrid stress: filtered products less products of the filtered."""
    return smooth(box, products(u), fraction) - products(smooth(box, u, fraction))


def transfer(box: Box, tau, filtered):
    """-tau_ij S_ij at every point: energy that leaves the filtered field, where positive."""
    return -(WEIGHT * tau * strain(box, filtered)).sum(0)


def germano(box: Box, filtered, fraction: float) -> tuple[float, float]:
    """<L M> and <M M> of the Germano identity with a test filter of twice the width."""
    s, delta = strain(box, filtered), fraction * 2 * math.pi
    twice = smooth(box, filtered, 2 * fraction)
    coarse = strain(box, twice)
    leonard = smooth(box, products(filtered), 2 * fraction) - products(twice)
    m = 2 * delta**2 * (smooth(box, size(s) * s, 2 * fraction) - 4 * size(coarse) * coarse)
    return float((WEIGHT * leonard * m).sum()), float((WEIGHT * m * m).sum())


def eddy_stress(box: Box, filtered, fraction: float, cs2: float):
    """Deviatoric stress of an eddy viscosity cs2 delta^2 |S|."""
    s = strain(box, filtered)
    tau = -2 * cs2 * (fraction * 2 * math.pi) ** 2 * size(s) * s
    tau[:3] -= tau[:3].mean(0)
    return tau


def dynamic_stress(box: Box, filtered, fraction: float, cap: float = CAP):
    """The eddy stress whose coefficient the Germano identity gives, between 0 and the cap."""
    top, below = germano(box, filtered, fraction)
    return eddy_stress(box, filtered, fraction, min(max(top / max(below, 1e-20), 0.0), cap))


def packed_velocity(spark, sf_dir) -> DataFrame:
    """frame and its three components as one array, where all are there."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 4 < 3")
    g = e.groupBy(F.floor(F.col("vec_id") / 4).cast("long").alias("frame"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: F.transform(s["embedding"], lambda x: q(x) / 1e6))  # three components
    return g.agg(F.flatten(own).alias("values")).where(F.size("values") == 192)


def per_frame(frames: DataFrame, n: int, f: Callable[[Box, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows that f makes of each packed frame, after its number."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        box = Box(n)
        for b in batches:
            for frame, v in zip(b["frame"], b["values"], strict=True):
                rows = f(box, np.asarray(v, float).reshape(3, n, n, n))
                yield pd.DataFrame([(frame, *r) for r in rows], columns=names)

    return frames.select("frame", "values").mapInPandas(run, schema)


def _points(t) -> list[tuple]:
    return [(c, z, y, x, float(v)) for (c, z, y, x), v in np.ndenumerate(t)]


_POINTS = "frame long, comp int, z int, y int, x int, v double"
_OUT = "SELECT frame, c AS comp, z, y, x, CAST(floor(v * {scale} + 0.5) AS BIGINT) AS v_q FROM {of}"


def _at_points(spark, sf_dir, f, scale: float = 1e6) -> DataFrame:
    d = per_frame(packed_velocity(spark, sf_dir), 4, lambda box, u: _points(f(box, u)), _POINTS)
    return d.select("frame", "comp", "z", "y", "x", q("v", scale).alias("v_q"))


# The oracles' steps, on (frame, c, z, y, x, v) and on modes (frame, c, kz, ky, kx, k2, w, re, im).
_M = "(kz * z + ky * y + kx * x + 32) % 4"
_C, _S = f"CASE {_M} WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END", f"CASE {_M} WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END"
_K4 = _MODES.split(",\nmode AS")[0]
_U = "u AS (SELECT frame, ch AS c, z, y, x, q / 1e6::DOUBLE AS v FROM field4 JOIN (SELECT frame FROM field4 WHERE ch < 3 GROUP BY frame HAVING count(*) = 192) USING (frame) WHERE ch < 3)"
_PTS = "pts AS (SELECT CAST(i // 16 AS INTEGER) AS z, CAST(i // 4 % 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x FROM range(0, 64) AS r(i))"
_PAIR = "pair AS (SELECT * FROM (VALUES (0, 0, 0, 1), (1, 1, 1, 1), (2, 2, 2, 1), (3, 0, 1, 2), (4, 0, 2, 2), (5, 1, 2, 2)) AS t(p, i, j, n))"
_BASE = (FIELD4, _K4, _U, _PTS, _PAIR)


def _ahead(name: str, of: str) -> str:
    return f"{name} AS (SELECT frame, c, kz, ky, kx, k2, w, sum(v * {_C}) AS re, -sum(v * {_S}) AS im FROM {of}, k4 GROUP BY ALL)"


def _back(name: str, of: str) -> str:
    return f"{name} AS (SELECT frame, c, z, y, x, sum(w * (re * {_C} - im * {_S})) / 64 AS v FROM {of}, pts GROUP BY ALL)"


def _smooth(name: str, of: str, fraction: float) -> list[str]:
    g = f"exp(-k2 * {(fraction * 2 * math.pi) ** 2 / 24!r}::DOUBLE)"
    return [_ahead(f"{name}_a", of), f"{name}_b AS (SELECT frame, c, kz, ky, kx, k2, w, re * {g} AS re, im * {g} AS im FROM {name}_a)", _back(name, f"{name}_b")]


def _products(name: str, of: str) -> str:
    return f"{name} AS (SELECT a.frame, p AS c, a.z, a.y, a.x, a.v * b.v AS v FROM pair JOIN {of} a ON a.c = i JOIN {of} b ON b.c = j AND b.frame = a.frame AND b.z = a.z AND b.y = a.y AND b.x = a.x)"


def _strain(name: str, of: str) -> list[str]:
    k = lambda a: f"CASE {a} WHEN 0 THEN kx WHEN 1 THEN ky ELSE kz END"
    terms = f"SELECT frame, p, kz, ky, kx, k2, w, {k('j')} AS kk, re, im FROM {name}_a JOIN pair ON i = c UNION ALL SELECT frame, p, kz, ky, kx, k2, w, {k('i')}, re, im FROM {name}_a JOIN pair ON j = c"
    return [_ahead(f"{name}_a", of), f"{name}_b AS (SELECT frame, p AS c, kz, ky, kx, k2, w, -sum(kk * im) / 2 AS re, sum(kk * re) / 2 AS im FROM ({terms}) GROUP BY ALL)", _back(name, f"{name}_b")]


def _size(name: str, of: str) -> str:
    return f"{name} AS (SELECT frame, z, y, x, sqrt(2 * sum(n * v * v) + 1e-20) AS m FROM {of} JOIN pair ON p = c GROUP BY ALL)"


def _less(name: str, a: str, b: str) -> str:
    return f"{name} AS (SELECT a.frame, a.c, a.z, a.y, a.x, a.v - b.v AS v FROM {a} a JOIN {b} b USING (frame, c, z, y, x))"


def _times(name: str, of: str, by: str) -> str:
    return f"{name} AS (SELECT frame, c, z, y, x, v * m AS v FROM {of} JOIN {by} USING (frame, z, y, x))"


_D = (FRACTION * 2 * math.pi) ** 2
_FILTERED = _smooth("uf", "u", FRACTION)
_TAU = [_products("uu", "u"), *_smooth("uuf", "uu", FRACTION), _products("ufuf", "uf"), _less("tau", "uuf", "ufuf")]
_GERMANO = [
    *_strain("s", "uf"), _size("sm", "s"), *_smooth("u2", "uf", 2 * FRACTION), *_strain("s2", "u2"), _size("s2m", "s2"),
    _products("fp", "uf"), *_smooth("fps", "fp", 2 * FRACTION), _products("u2p", "u2"), _less("leo", "fps", "u2p"),
    _times("ss", "s", "sm"), *_smooth("sss", "ss", 2 * FRACTION), _times("s2s", "s2", "s2m"),
    f"m AS (SELECT a.frame, a.c, a.z, a.y, a.x, {2 * _D!r}::DOUBLE * (a.v - 4 * b.v) AS v FROM sss a JOIN s2s b USING (frame, c, z, y, x))",
    "lm AS (SELECT l.frame, sum(n * l.v * m.v) AS top, sum(n * m.v * m.v) AS below FROM leo l JOIN m USING (frame, c, z, y, x) JOIN pair ON p = l.c GROUP BY ALL)",
    f"cs AS (SELECT frame, least(greatest(top / greatest(below, 1e-20), 0), {CAP}) AS cs2, top / greatest(below, 1e-20) AS free FROM lm)",
]


@query("strain_points_n4", with_(*_BASE, *_strain("s", "u"), rest=_OUT.format(scale="8e6", of="s")))
def strain_points_n4(spark, sf_dir):
    """S_ij at every point, in eighths of the field's unit, which are whole on four points."""
    return _at_points(spark, sf_dir, strain, 8e6)


@query("sgs_stress_n4", with_(*_BASE, *_FILTERED, *_TAU, rest=_OUT.format(scale="1e6", of="tau")))
def sgs_stress_n4(spark, sf_dir):
    return _at_points(spark, sf_dir, lambda box, u: stress(box, u, FRACTION))


@query("sgs_transfer_n4", with_(*_BASE, *_FILTERED, *_TAU, *_strain("s", "uf"), "pi AS (SELECT frame, z, y, x, -sum(n * t.v * s.v) AS v FROM tau t JOIN s USING (frame, c, z, y, x) JOIN pair ON p = t.c GROUP BY ALL)",
       rest="SELECT frame, CAST(floor(avg(v) * 1e6 + 0.5) AS BIGINT) AS mean_q, count(*) FILTER (v < 0) AS back, CAST(floor(coalesce(sum(-v) FILTER (v < 0), 0) / greatest(sum(abs(v)), 1e-12) * 1e6 + 0.5) AS BIGINT) AS back_energy_q FROM pi GROUP BY frame"))
def sgs_transfer_n4(spark, sf_dir):
    """Mean transfer, points of backscatter and their share of the energy."""

    def f(box, u):
        pi = transfer(box, stress(box, u, FRACTION), smooth(box, u, FRACTION))
        return [(float(pi.mean()), int((pi < 0).sum()), float(-pi[pi < 0].sum() / max(np.abs(pi).sum(), 1e-12)))]

    d = per_frame(packed_velocity(spark, sf_dir), 4, f, "frame long, mean double, back long, share double")
    return d.select("frame", q("mean").alias("mean_q"), "back", q("share").alias("back_energy_q"))


@query("sgs_germano_n4", with_(*_BASE, *_FILTERED, *_GERMANO, rest="SELECT frame, CAST(floor(free * 1e6 + 0.5) AS BIGINT) AS free_q, CAST(floor(cs2 * 1e6 + 0.5) AS BIGINT) AS cs2_q FROM cs"))
def sgs_germano_n4(spark, sf_dir):
    """The dynamic coefficient, free and between 0 and its cap."""

    def f(box, u):
        top, below = germano(box, smooth(box, u, FRACTION), FRACTION)
        free = top / max(below, 1e-20)
        return [(free, min(max(free, 0.0), CAP))]

    d = per_frame(packed_velocity(spark, sf_dir), 4, f, "frame long, free double, cs2 double")
    return d.select("frame", q("free").alias("free_q"), q("cs2").alias("cs2_q"))


_EDDY = f"SELECT frame, c, z, y, x, -2 * {{cs2}} * {_D!r}::DOUBLE * v * m AS v FROM s JOIN sm USING (frame, z, y, x)"
_DEVIATOR = "model AS (SELECT frame, c, z, y, x, v - CASE WHEN c < 3 THEN sum(v) FILTER (c < 3) OVER (PARTITION BY frame, z, y, x) / 3 ELSE 0 END AS v FROM raw)"


@query("sgs_dynamic_n4", with_(*_BASE, *_FILTERED, *_GERMANO, "raw AS (" + _EDDY.format(cs2="cs2").replace("FROM s JOIN", "FROM s JOIN cs USING (frame) JOIN") + ")", _DEVIATOR, rest=_OUT.format(scale="1e6", of="model")))
def sgs_dynamic_n4(spark, sf_dir):
    """Stress of the dynamic model."""
    return _at_points(spark, sf_dir, lambda box, u: dynamic_stress(box, smooth(box, u, FRACTION), FRACTION))


@query("sgs_correlation_n4", with_(*_BASE, *_FILTERED, *_TAU, *_strain("s", "uf"), _size("sm", "s"), "raw AS (" + _EDDY.format(cs2=repr(STATIC**2)) + ")", _DEVIATOR,
       rest="SELECT frame, CAST(floor(corr(m.v, t.v) * 1e6 + 0.5) AS BIGINT) AS corr_q FROM model m JOIN tau t USING (frame, c, z, y, x) GROUP BY frame"))
def sgs_correlation_n4(spark, sf_dir):
    """Correlation of the static model's stress with the true one, over all six components and points, each once."""

    def f(box, u):
        model, true = eddy_stress(box, smooth(box, u, FRACTION), FRACTION, STATIC**2).ravel(), stress(box, u, FRACTION).ravel()
        a, b = model - model.mean(), true - true.mean()
        return [(float(a @ b / max(np.sqrt((a @ a) * (b @ b)), 1e-12)),)]

    return per_frame(packed_velocity(spark, sf_dir), 4, f, "frame long, corr double").select("frame", q("corr").alias("corr_q"))


_CURL3 = """om AS (SELECT frame, c, kz, ky, kx, k2, w, -sum(kk * im) AS re, sum(kk * re) AS im FROM (
  SELECT frame, o AS c, kz, ky, kx, k2, w, g * CASE a WHEN 0 THEN kx WHEN 1 THEN ky ELSE kz END AS kk, re, im FROM ua JOIN (VALUES (0, 1, 2, 1), (0, 2, 1, -1), (1, 2, 0, 1), (1, 0, 2, -1), (2, 0, 1, 1), (2, 1, 0, -1)) AS t(o, a, i, g) ON i = ua.c) GROUP BY ALL)"""


@query("vorticity_tails_n4", with_(*_BASE, _ahead("ua", "u"), _CURL3, _back("o", "om"), "mag AS (SELECT frame, z, y, x, sqrt(sum(v * v)) AS m FROM o GROUP BY ALL)", "st AS (SELECT frame, avg(m) + 3 * stddev_samp(m) AS limit_, avg(m) + stddev_samp(m) AS one FROM mag GROUP BY frame)",
       "fl AS (SELECT frame, avg(pow(v, 4)) / pow(avg(v * v), 2) AS flat FROM o GROUP BY frame)",
       rest="SELECT frame, CAST(floor(any_value(flat) * 1e6 + 0.5) AS BIGINT) AS flat_q, count(*) FILTER (m > limit_) AS beyond, count(*) FILTER (m > one) AS beyond_one FROM mag JOIN st USING (frame) JOIN fl USING (frame) GROUP BY frame"))
def vorticity_tails_n4(spark, sf_dir):
    """Flatness of the vorticity over all components, and points whose magnitude lies beyond the mean by three (and one) sample deviations."""

    def f(box, u):
        o = box.back(box.curl(box.forward(u)))
        m = np.sqrt((o * o).sum(0))
        return [(float((o**4).mean() / (o * o).mean() ** 2), int((m > m.mean() + 3 * m.std(ddof=1)).sum()), int((m > m.mean() + m.std(ddof=1)).sum()))]

    d = per_frame(packed_velocity(spark, sf_dir), 4, f, "frame long, flat double, beyond long, beyond_one long")
    return d.select("frame", q("flat").alias("flat_q"), "beyond", "beyond_one")


_PSQL = lambda c: " + ".join(f"{f} * {a} * {b} * max(CASE WHEN ch = {i} THEN {c} END)" for i, (a, b, f) in enumerate(_KK))
_EXT = [_MODES, _PROD, _PMODES[_PMODES.index("pmode AS") :], f"pp AS (SELECT frame, kz, ky, kx, k2, -({_PSQL('re')}) / k2::DOUBLE AS re_p, -({_PSQL('im')}) / k2::DOUBLE AS im_p FROM pmode WHERE k2 > 0 GROUP BY frame, kz, ky, kx, k2)"]
_OMEGA = 2.5


def rotating_pressure(p: DataFrame, omega: float) -> DataFrame:
    """Pressure modes re_p, im_p with the part of a rotation about z: -(2 Omega omega_z) / k2."""
    return p.withColumns({f"{c}_p": F.when(F.col("k2") > 0, F.col(f"{c}_p") - 2 * omega * F.col(f"{c}_oz") / F.col("k2")).otherwise(F.lit(0.0)) for c in ("re", "im")})


def buoyant_pressure(p: DataFrame, re_b: Column, im_b: Column) -> DataFrame:
    """Pressure modes with the part of a buoyancy along z: -i kz b / k2."""
    some = lambda c: F.when(F.col("k2") > 0, c).otherwise(F.lit(0.0))
    return p.withColumns({"re_p": some(F.col("re_p") + F.col("kz") * im_b / F.col("k2")), "im_p": some(F.col("im_p") - F.col("kz") * re_b / F.col("k2"))})


_KEY = ["frame", "kz", "ky", "kx"]


@query("pressure_rotating_n4", with_(FIELD4, *_EXT, rest=f"""SELECT frame, kz, ky, kx, CAST(floor((re_p - {2 * _OMEGA} * -(kx * im_v - ky * im_u) / u.k2::DOUBLE) * 10 + 0.5) AS BIGINT) AS re_q,
  CAST(floor((im_p - {2 * _OMEGA} * (kx * re_v - ky * re_u) / u.k2::DOUBLE) * 10 + 0.5) AS BIGINT) AS im_q FROM pp JOIN uvw u USING (frame, kz, ky, kx)"""))
def pressure_rotating_n4(spark, sf_dir):
    p = pressure(abreast(packed4(spark, sf_dir).where("ch < 3"), UVW), ["u", "v", "w"])
    d = rotating_pressure(curl(p).where("k2 > 0"), _OMEGA)
    return d.select(*_KEY, q("re_p", 10).alias("re_q"), q("im_p", 10).alias("im_q"))


@query("pressure_buoyant_n4", with_(FIELD4, *_EXT, rest="""SELECT frame, kz, ky, kx, CAST(floor((re_p + kz * im / b.k2::DOUBLE) * 10 + 0.5) AS BIGINT) AS re_q,
  CAST(floor((im_p - kz * re / b.k2::DOUBLE) * 10 + 0.5) AS BIGINT) AS im_q FROM pp JOIN (SELECT * FROM mode WHERE ch = 3) b USING (frame, kz, ky, kx)"""))
def pressure_buoyant_n4(spark, sf_dir):
    """The fourth channel as buoyancy."""
    p = pressure(abreast(packed4(spark, sf_dir), UVW | {3: "b"}).where("b is not null"), ["b"])
    d = buoyant_pressure(p.where("k2 > 0"), F.col("re_b"), F.col("im_b"))
    return d.select(*_KEY, q("re_p", 10).alias("re_q"), q("im_p", 10).alias("im_q"))

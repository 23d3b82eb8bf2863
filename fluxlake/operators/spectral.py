"""Field algebra in (re, im) columns: relational DFT on small boxes, exact on whole-number inputs for N = 4, and the same transforms by numpy FFT for packed fields of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixtures import FIELD4, field4, table, with_
from ..model import q
from ..registry import query

#: The 48 modes (kz, ky, kx, k2, shell, w) of the half spectrum of 4 points an axis; the half axis stands for its mirror image, with weight w.
MODES4 = [(kz, ky, kx, kz * kz + ky * ky + kx * kx, int((kz * kz + ky * ky + kx * kx) ** 0.5 + 0.5), 1 if kx in (0, 2) else 2) for kz in (0, 1, -2, -1) for ky in (0, 1, -2, -1) for kx in range(3)]
_MODE = ("kz", "ky", "kx", "k2", "shell", "w")
_PHASE = np.array([[(kz * (i // 16) + ky * (i // 4 % 4) + kx * (i % 4)) % 4 for kz, ky, kx, *_ in MODES4] for i in range(64)])
#: cos and sin of -2 pi m / 4, by points and modes.
_COS, _SIN = np.array([1, 0, -1, 0])[_PHASE], np.array([0, -1, 0, 1])[_PHASE]


def packed4(spark, sf_dir) -> DataFrame:
    """field4 with the 64 points of a frame's channel as one array: frame, ch, v. A row of the table is a row here, so that nothing is shuffled."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: q(x)))
    v = F.coalesce(F.when(F.size("v") == 64, F.col("v")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("v", i)))
    return e.select(F.floor(F.col("vec_id") / 4).cast("long").alias("frame"), (F.col("vec_id") % 4).cast("int").alias("ch"), v.alias("v"))


def _numbers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole numbers, with 0 for what is null, and which rows have any."""
    flat = column.flatten()
    size = len(flat) // max(len(column), 1)
    x = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, size)
    if x.size and max(x.max(), -x.min()) > 2**56:
        raise OverflowError("sums of these values are not exact")
    return x, flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size).any(1)


def _lists(x: np.ndarray, there: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), mask=np.repeat(~there, x.shape[1])))


def transformed(fields: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The forward real DFT of each named column of 64 points: keys, and re_<name>, im_<name> of the 48 modes as whole numbers. Rows stay where they are; a field without any value has null modes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.columns[: len(keys)]
            for c in b.columns[len(keys) :]:
                x, there = _numbers(c)
                out += [_lists(x @ _COS, there), _lists(x @ _SIN, there)]
            yield pa.RecordBatch.from_arrays(out, names=[*keys, *(f"{p}_{n}" for n in names for p in ("re", "im"))])

    nothing = F.array_repeat(F.lit(None).cast("long"), 64)
    types = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields.select(*keys).schema), *(f"{p}_{n} array<long>" for n in names for p in ("re", "im"))])
    return fields.select(*keys, *(F.coalesce(n, nothing).alias(n) for n in names)).mapInArrow(run, types)


def spread(modes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each of the 48 modes of packed modes: keys, kz, ky, kx, k2, shell, w and the columns."""
    dim = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(_MODE, m, strict=True))) for m in MODES4))
    rows = modes.select(*keys, F.inline(F.arrays_zip(dim.alias("mode"), *columns)))
    return rows.select(*keys, *(F.col(f"mode.{c}").alias(c) for c in _MODE), *columns)


def dft4(packed: DataFrame) -> DataFrame:
    """Forward real DFT of packed 4x4x4 fields (frame, ch, v): modes (frame, ch, kz, ky, kx, k2, shell, w, re, im) as whole numbers."""
    m = transformed(packed.select("frame", "ch", "v"), ["frame", "ch"], ["v"])
    return spread(m.select("frame", "ch", F.col("re_v").alias("re"), F.col("im_v").alias("im")), ["frame", "ch"], ["re", "im"])


def idft4(modes: DataFrame) -> DataFrame:
    """Inverse of transformed, of whole-number modes (frame, ch, re_v, im_v): v, the 64 points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array([m[5] for m in MODES4])
        for b in batches:
            (re, there), (im, _) = _numbers(b.column(2)), _numbers(b.column(3))
            # The half axis stands for its mirror image; e^{+i} has the opposite sine, which the forward table holds.
            v = ((re * w) @ _COS.T + (im * w) @ _SIN.T) // 64
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(v, there)], names=["frame", "ch", "v"])

    return modes.select("frame", "ch", "re_v", "im_v").mapInArrow(run, "frame long, ch int, v array<long>")


def abreast(packed: DataFrame, channels: dict[int, str]) -> DataFrame:
    """Channels of a frame side by side: frame and an array <name> for each, null where the frame has none. One shuffle of packed fields by frame."""
    return packed.groupBy("frame").agg(*(F.any_value(F.when(F.col("ch") == c, F.col("v")), True).alias(n) for c, n in channels.items()))


def by_channel(packed: DataFrame, channels: dict[int, str]) -> DataFrame:
    """Modes of channels side by side: re_<name>, im_<name>."""
    wide = abreast(packed.where(F.col("ch").isin(*channels)), channels)
    return modes_of(wide, list(channels.values()))


def modes_of(wide: DataFrame, names: list[str]) -> DataFrame:
    """A row for each frame and mode, with re_<name>, im_<name> of each packed column."""
    return spread(transformed(wide, ["frame"], names), ["frame"], [f"{p}_{n}" for n in names for p in ("re", "im")])


UVW = {0: "u", 1: "v", 2: "w"}

_MODES = """k4 AS (SELECT CAST(kz AS INTEGER) AS kz, CAST(ky AS INTEGER) AS ky, CAST(kx AS INTEGER) AS kx, CAST(kz * kz + ky * ky + kx * kx AS INTEGER) AS k2,
  CAST(floor(sqrt(kz * kz + ky * ky + kx * kx) + 0.5) AS INTEGER) AS shell, CASE WHEN kx IN (0, 2) THEN 1 ELSE 2 END AS w FROM range(-2, 2) AS a(kz), range(-2, 2) AS b(ky), range(0, 3) AS c(kx)),
mode AS (SELECT frame, ch, kz, ky, kx, k2, shell, w, CAST(sum(q * CASE (kz * z + ky * y + kx * x + 32) % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END) AS BIGINT) AS re,
  CAST(sum(q * CASE (kz * z + ky * y + kx * x + 32) % 4 WHEN 1 THEN -1 WHEN 3 THEN 1 ELSE 0 END) AS BIGINT) AS im FROM field4, k4 GROUP BY ALL),
uvw AS (SELECT frame, kz, ky, kx, k2, shell, w, """ + ", ".join(f"max(CASE WHEN ch = {c} THEN {p} END) AS {p}_{n}" for c, n in UVW.items() for p in ("re", "im")) + """ FROM mode WHERE ch < 3 GROUP BY ALL)"""
_D = lambda c: F.col(c).cast("decimal(19,0)")


def _sql(rest: str) -> str:
    return with_(FIELD4, _MODES, rest=rest)


@query("dft_n4", _sql("SELECT frame, ch, kz, ky, kx, re, im FROM mode"))
def q_dft_n4(spark, sf_dir):
    return dft4(packed4(spark, sf_dir)).select("frame", "ch", "kz", "ky", "kx", "re", "im")


@query("idft_roundtrip_n4", with_(FIELD4, rest="SELECT frame, ch, z, y, x, q FROM field4"))
def idft_roundtrip_n4(spark, sf_dir):
    back = idft4(transformed(packed4(spark, sf_dir), ["frame", "ch"], ["v"]))
    at = lambda d: (F.floor(F.col("pos") / d) % 4).cast("int")
    return back.select("frame", "ch", F.posexplode("v").alias("pos", "q")).select("frame", "ch", at(16).alias("z"), at(4).alias("y"), at(1).alias("x"), "q")


@query("energy_parseval", with_(FIELD4, rest="SELECT frame, CAST(sum(CAST(q AS HUGEINT) * q) AS DOUBLE) / 64 / 2 / 1e12 AS e FROM field4 WHERE ch < 3 GROUP BY frame").replace("SELECT frame, CAST(sum", "SELECT frame, CAST(floor(e * 1e9 + 0.5) AS BIGINT) AS e_q FROM (SELECT frame, CAST(sum").replace("GROUP BY frame", "GROUP BY frame)"))
def energy_parseval(spark, sf_dir):
    """Kinetic energy as the weighted sum over modes; the oracle has it from the points."""
    m = dft4(packed4(spark, sf_dir).where("ch < 3"))
    e = F.sum(F.col("w") * (_D("re") * _D("re") + _D("im") * _D("im"))).cast("double") / 4096 / 2 / 1e12
    return m.groupBy("frame").agg(q(e, 1e9).alias("e_q"))


_E = "CAST(sum(w * (CAST(re AS HUGEINT) * re + CAST(im AS HUGEINT) * im)) AS DOUBLE) / 4096 / 2 / 1e12"


def shell_spectrum(modes: DataFrame, n: int = 4) -> DataFrame:
    """Energy by shell 1..N/2; corners beyond are left out of the report."""
    e = F.sum(F.col("w") * (_D("re") * _D("re") + _D("im") * _D("im"))).cast("double") / n**6 / 2 / 1e12
    return modes.where(F.col("shell").between(1, n // 2)).groupBy("frame", "shell").agg(e.alias("E"))


@query("shell_spectrum", _sql(f"SELECT frame, shell, CAST(floor({_E} * 1e9 + 0.5) AS BIGINT) AS e_q FROM mode WHERE ch < 3 AND shell BETWEEN 1 AND 2 GROUP BY ALL"))
def q_shell_spectrum(spark, sf_dir):
    return shell_spectrum(dft4(packed4(spark, sf_dir).where("ch < 3"))).select("frame", "shell", q("E", 1e9).alias("e_q"))


@query("dissipation", _sql("SELECT frame, CAST(floor(2 * 0.0022 * CAST(sum(k2 * w * (CAST(re AS HUGEINT) * re + CAST(im AS HUGEINT) * im)) AS DOUBLE) / 4096 / 2 / 1e12 * 1e9 + 0.5) AS BIGINT) AS eps_q FROM mode WHERE ch < 3 GROUP BY frame"))
def dissipation(spark, sf_dir):
    s = F.sum(F.col("k2") * F.col("w") * (_D("re") * _D("re") + _D("im") * _D("im"))).cast("double")
    return dft4(packed4(spark, sf_dir).where("ch < 3")).groupBy("frame").agg(q(2 * 0.0022 * s / 4096 / 2 / 1e12, 1e9).alias("eps_q"))


def curl(m: DataFrame) -> DataFrame:
    """i k x u: i (a + ib) = -b + ia."""
    k, c = {"x": "kx", "y": "ky", "z": "kz"}, F.col
    pairs = {"x": ("y", "w", "z", "v"), "y": ("z", "u", "x", "w"), "z": ("x", "v", "y", "u")}
    out = {}
    for axis, (k1, a, k2, b) in pairs.items():
        out[f"re_o{axis}"] = -(c(k[k1]) * c(f"im_{a}") - c(k[k2]) * c(f"im_{b}"))
        out[f"im_o{axis}"] = c(k[k1]) * c(f"re_{a}") - c(k[k2]) * c(f"re_{b}")
    return m.withColumns(out)


_CURL = """SELECT frame, kz, ky, kx, -(ky * im_w - kz * im_v) AS re_ox, ky * re_w - kz * re_v AS im_ox, -(kz * im_u - kx * im_w) AS re_oy, kz * re_u - kx * re_w AS im_oy,
  -(kx * im_v - ky * im_u) AS re_oz, kx * re_v - ky * re_u AS im_oz FROM uvw"""


@query("curl_n4", _sql(_CURL))
def curl_n4(spark, sf_dir):
    m = curl(by_channel(packed4(spark, sf_dir), UVW))
    return m.select("frame", "kz", "ky", "kx", *(f"{p}_o{a}" for a in "xyz" for p in ("re", "im")))


def divergence(m: DataFrame) -> DataFrame:
    c = F.col
    return m.withColumns({"re_div": -(c("kx") * c("im_u") + c("ky") * c("im_v") + c("kz") * c("im_w")), "im_div": c("kx") * c("re_u") + c("ky") * c("re_v") + c("kz") * c("re_w")})


@query("divergence_n4", _sql("SELECT frame, kz, ky, kx, -(kx * im_u + ky * im_v + kz * im_w) AS re_div, kx * re_u + ky * re_v + kz * re_w AS im_div FROM uvw"))
def divergence_n4(spark, sf_dir):
    return divergence(by_channel(packed4(spark, sf_dir), UVW)).select("frame", "kz", "ky", "kx", "re_div", "im_div")


def leray(m: DataFrame) -> DataFrame:
    """Projection on divergence-free fields, n - k (k.n) / k2; the mean stays."""
    c = F.col
    out = {}
    for p in ("re", "im"):
        dot = c("kx") * c(f"{p}_u") + c("ky") * c(f"{p}_v") + c("kz") * c(f"{p}_w")
        for k, n in (("kx", "u"), ("ky", "v"), ("kz", "w")):
            out[f"{p}_p{n}"] = c(f"{p}_{n}") - F.when(c("k2") > 0, c(k) * dot / c("k2")).otherwise(F.lit(0.0))
    return m.withColumns(out)


_DOT = "(kx * {p}_u + ky * {p}_v + kz * {p}_w)"


@query("leray_n4", _sql("SELECT frame, kz, ky, kx, " + ", ".join(f"CAST(floor(({p}_{n} - CASE WHEN k2 > 0 THEN {k} * {_DOT.format(p=p)} / k2::DOUBLE ELSE 0 END) * 10 + 0.5) AS BIGINT) AS {p}_p{n}" for p in ("re", "im") for k, n in (("kx", "u"), ("ky", "v"), ("kz", "w"))) + " FROM uvw"))
def leray_n4(spark, sf_dir):
    m = leray(by_channel(packed4(spark, sf_dir), UVW))
    return m.select("frame", "kz", "ky", "kx", *(q(f"{p}_p{n}", 10).alias(f"{p}_p{n}") for p in ("re", "im") for n in "uvw"))


@query("leray_divergence_free", with_(FIELD4, rest="SELECT count(DISTINCT frame) AS frames, 0::BIGINT AS modes_with_divergence FROM field4"))
def leray_divergence_free(spark, sf_dir):
    """Modes whose divergence survives the projection: none."""
    m = leray(by_channel(packed4(spark, sf_dir), UVW))
    d = lambda p: F.abs(F.col("kx") * F.col(f"{p}_pu") + F.col("ky") * F.col(f"{p}_pv") + F.col("kz") * F.col(f"{p}_pw")) > 1e-3
    return m.agg(F.count_distinct("frame").alias("frames"), F.count_if(d("re") | d("im")).alias("modes_with_divergence"))


@query("dealias_n4", _sql("SELECT frame, count(*) AS kept, count(*) FILTER (9 * k2 <= 16) AS kept_spherical, CAST(sum(abs(re)) AS BIGINT) AS re_sum FROM mode WHERE ch = 0 AND 3 * abs(kz) <= 4 AND 3 * abs(ky) <= 4 AND 3 * kx <= 4 GROUP BY frame"))
def dealias_n4(spark, sf_dir):
    """The two-thirds rule, cubic, and the spherical one within."""
    m = dft4(packed4(spark, sf_dir).where("ch = 0")).where("3 * abs(kz) <= 4 and 3 * abs(ky) <= 4 and 3 * kx <= 4")
    return m.groupBy("frame").agg(F.count("*").alias("kept"), F.count_if(9 * F.col("k2") <= 16).alias("kept_spherical"), F.sum(F.abs("re")).alias("re_sum"))


_HEL = """CAST(sum(w * (CAST(re_u AS HUGEINT) * -(ky * im_w - kz * im_v) + CAST(im_u AS HUGEINT) * (ky * re_w - kz * re_v) + CAST(re_v AS HUGEINT) * -(kz * im_u - kx * im_w) + CAST(im_v AS HUGEINT) * (kz * re_u - kx * re_w)
  + CAST(re_w AS HUGEINT) * -(kx * im_v - ky * im_u) + CAST(im_w AS HUGEINT) * (kx * re_v - ky * re_u))) AS DOUBLE)"""


@query("helicity", _sql(f"SELECT frame, CAST(floor({_HEL} / 4096 / 1e12 * 1e9 + 0.5) AS BIGINT) AS h_q FROM uvw GROUP BY frame"))
def helicity(spark, sf_dir):
    m = curl(by_channel(packed4(spark, sf_dir), UVW))
    terms = sum((_D(f"{p}_{n}") * _D(f"{p}_o{a}") for p in ("re", "im") for n, a in zip("uvw", "xyz", strict=True)), F.lit(0).cast("decimal(19,0)"))
    return m.groupBy("frame").agg(q(F.sum(F.col("w") * terms).cast("double") / 4096 / 1e12, 1e9).alias("h_q"))


@query("partition_2d3d", _sql(f"SELECT frame, CAST(floor({_E.replace('sum(w', 'sum(w * (kz = 0)::INTEGER')} * 1e9 + 0.5) AS BIGINT) AS e2d_q, CAST(floor({_E} * 1e9 + 0.5) AS BIGINT) AS e_q FROM mode WHERE ch < 3 GROUP BY frame"))
def partition_2d3d(spark, sf_dir):
    e = F.col("w") * (_D("re") * _D("re") + _D("im") * _D("im"))
    m = dft4(packed4(spark, sf_dir).where("ch < 3"))
    scaled = lambda c: q(c.cast("double") / 4096 / 2 / 1e12, 1e9)
    return m.groupBy("frame").agg(scaled(F.coalesce(F.sum(F.when(F.col("kz") == 0, e)), F.lit(0))).alias("e2d_q"), scaled(F.sum(e)).alias("e_q"))


def helical(m: DataFrame, sign: int) -> DataFrame:
    """Projection on modes of one handedness: (u + s (i k x u) / |k|) / 2 of the solenoidal part."""
    p = leray(m)
    s = p.select("frame", "kz", "ky", "kx", "k2", "shell", "w", *(F.col(f"{c}_p{n}").alias(f"{c}_{n}") for c in ("re", "im") for n in "uvw"))
    o = curl(s)
    k = F.sqrt("k2")
    return o.withColumns({f"{c}_h{n}": F.when(F.col("k2") > 0, (F.col(f"{c}_{n}") + sign * F.col(f"{c}_o{a}") / k) / 2).otherwise(F.lit(0.0)) for c in ("re", "im") for n, a in zip("uvw", "xyz", strict=True)})


@query("helical_sum", _sql("SELECT frame, kz, ky, kx, " + ", ".join(f"CAST(floor(({p}_{n} - {k} * {_DOT.format(p=p)} / k2::DOUBLE) * 10 + 0.5) AS BIGINT) AS {p}_{n}" for p in ("re", "im") for k, n in (("kx", "u"), ("ky", "v"), ("kz", "w"))) + " FROM uvw WHERE k2 > 0"))
def helical_sum(spark, sf_dir):
    """Both hands together are the solenoidal field."""
    m = by_channel(packed4(spark, sf_dir), UVW).where("k2 > 0")
    plus, minus, key = helical(m, 1), helical(m, -1), ["frame", "kz", "ky", "kx"]
    j = plus.join(minus.select(*key, *(F.col(f"{p}_h{n}").alias(f"{p}_g{n}") for p in ("re", "im") for n in "uvw")), key)
    return j.select(*key, *(q(F.col(f"{p}_h{n}") + F.col(f"{p}_g{n}"), 10).alias(f"{p}_{n}") for p in ("re", "im") for n in "uvw"))


def products(wide: DataFrame) -> DataFrame:
    """The six products u_i u_j at every point as packed columns p0..p5 (uu, vv, ww, uv, uw, vw), in whole millionths of the field's unit, beside u, v and w."""
    pairs = ["uu", "vv", "ww", "uv", "uw", "vw"]
    # Rounded to the field's unit, so that sums over modes stay exact.
    value = lambda a, b: F.floor((a * b).cast("double") / 1e6 + 0.5).cast("long")
    return wide.withColumns({f"p{i}": F.zip_with(a, b, value) for i, (a, b) in enumerate(pairs)})


_PROD = """v3 AS (SELECT frame, z, y, x, max(CASE WHEN ch = 0 THEN q END) AS a, max(CASE WHEN ch = 1 THEN q END) AS b, max(CASE WHEN ch = 2 THEN q END) AS c FROM field4 GROUP BY ALL),
prod AS (""" + " UNION ALL ".join(f"SELECT frame, z, y, x, {i} AS ch, CAST(floor(CAST({a} * {b} AS DOUBLE) / 1e6 + 0.5) AS BIGINT) AS q FROM v3" for i, (a, b) in enumerate([("a", "a"), ("b", "b"), ("c", "c"), ("a", "b"), ("a", "c"), ("b", "c")])) + ")"
_PMODES = _MODES.split(",\nuvw AS")[0].replace("FROM field4, k4", "FROM prod, k4").replace("mode AS", "pmode AS")
_KK = [("kx", "kx", 1), ("ky", "ky", 1), ("kz", "kz", 1), ("kx", "ky", 2), ("kx", "kz", 2), ("ky", "kz", 2)]


def _source(c: str) -> Column:
    """k_i k_j of the products' modes, summed."""
    return sum((f * F.col(a) * F.col(b) * F.col(f"{c}_p{i}") for i, (a, b, f) in enumerate(_KK)), F.lit(0))


def pressure(wide: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Pressure modes re_p, im_p of the Poisson equation for packed u, v, w, -k_i k_j / k2 of the products' modes; the mean is 0. Modes of the columns in `also` stand beside."""
    p = modes_of(products(wide), [*(f"p{i}" for i in range(6)), *(also or [])])
    return p.withColumns({f"{c}_p": F.when(F.col("k2") > 0, -_source(c) / F.col("k2")).otherwise(F.lit(0.0)) for c in ("re", "im")})


_PSUM = lambda c: " + ".join(f"{f} * {a} * {b} * max(CASE WHEN ch = {i} THEN {c} END)" for i, (a, b, f) in enumerate(_KK))


@query("pressure_poisson_n4", with_(FIELD4, _PROD, _PMODES, rest=f"""SELECT frame, kz, ky, kx, CAST(floor(CASE WHEN k2 > 0 THEN -({_PSUM('re')}) / k2::DOUBLE ELSE 0 END * 10 + 0.5) AS BIGINT) AS re_q,
  CAST(floor(CASE WHEN k2 > 0 THEN -({_PSUM('im')}) / k2::DOUBLE ELSE 0 END * 10 + 0.5) AS BIGINT) AS im_q FROM pmode GROUP BY frame, kz, ky, kx, k2"""))
def pressure_poisson_n4(spark, sf_dir):
    p = pressure(abreast(packed4(spark, sf_dir), UVW))
    return p.select("frame", "kz", "ky", "kx", q("re_p", 10).alias("re_q"), q("im_p", 10).alias("im_q"))


@query("poisson_residual_n4", with_(FIELD4, _PROD, _PMODES, _MODES.replace("k4 AS (", "k4b AS (", 1), f"""rhs AS (SELECT frame, kz, ky, kx, k2, w, {_PSUM('re')} AS r, {_PSUM('im')} AS i FROM pmode GROUP BY frame, kz, ky, kx, k2, w)""",
       rest="""SELECT frame, CAST(floor(sqrt(sum(w * (pow(-k2 * re + -r, 2) + pow(-k2 * im + -i, 2)))) / sqrt(sum(w * (pow(r::DOUBLE, 2) + pow(i::DOUBLE, 2)))) * 1e5 + 0.5) AS BIGINT) AS res_q
  FROM rhs JOIN (SELECT frame, kz, ky, kx, re, im FROM mode WHERE ch = 3) p USING (frame, kz, ky, kx) WHERE k2 > 0 GROUP BY frame"""))
def poisson_residual_n4(spark, sf_dir):
    """|laplace p - rhs| / |rhs| of the stored pressure, without the mean."""
    wide = products(abreast(packed4(spark, sf_dir), UVW | {3: "s"}).where("s is not null"))
    m = modes_of(wide, [*(f"p{i}" for i in range(6)), "s"])
    j = m.where("k2 > 0").select("frame", "k2", "w", F.col("re_s").alias("re"), F.col("im_s").alias("im"), _source("re").cast("double").alias("r"), _source("im").cast("double").alias("i"))
    sq = lambda x: x * x
    top = F.sum(F.col("w") * (sq(-F.col("k2") * F.col("re") - F.col("r")) + sq(-F.col("k2") * F.col("im") - F.col("i"))))
    return j.groupBy("frame").agg(q(F.sqrt(top) / F.sqrt(F.sum(F.col("w") * (sq(F.col("r")) + sq(F.col("i"))))), 1e5).alias("res_q"))


def gauss(k2: Column, fraction: float) -> Column:
    """Transfer of the Gaussian filter of width fraction * 2 pi."""
    width = fraction * 2 * np.pi
    return F.exp(-k2 * (width * width / 24))


_GAUSS = f"exp(-k2 * {(0.25 * 2 * np.pi) * (0.25 * 2 * np.pi) / 24!r}::DOUBLE)"


@query("gauss_filter_n4", _sql(f"SELECT frame, ch, kz, ky, kx, CAST(floor(re * {_GAUSS} * 10 + 0.5) AS BIGINT) AS re_q, CAST(floor(im * {_GAUSS} * 10 + 0.5) AS BIGINT) AS im_q FROM mode"))
def gauss_filter_n4(spark, sf_dir):
    g = gauss(F.col("k2"), 0.25)
    return dft4(packed4(spark, sf_dir)).select("frame", "ch", "kz", "ky", "kx", q(F.col("re") * g, 10).alias("re_q"), q(F.col("im") * g, 10).alias("im_q"))


@query("strain_n4", _sql("SELECT frame, kz, ky, kx, -kx * im_u AS re_s11, kx * re_u AS im_s11, -(ky * im_u + kx * im_v) / 2.0::DOUBLE AS re_s12, (ky * re_u + kx * re_v) / 2.0::DOUBLE AS im_s12 FROM uvw"))
def strain_n4(spark, sf_dir):
    c = F.col
    m = by_channel(packed4(spark, sf_dir), UVW)
    return m.select("frame", "kz", "ky", "kx", (-c("kx") * c("im_u")).alias("re_s11"), (c("kx") * c("re_u")).alias("im_s11"), (-(c("ky") * c("im_u") + c("kx") * c("im_v")) / 2.0).alias("re_s12"), ((c("ky") * c("re_u") + c("kx") * c("re_v")) / 2.0).alias("im_s12"))


@query("downsample_n4", _sql("SELECT frame, ch, kz, ky, kx, CAST(floor(re / 8.0::DOUBLE + 0.5) AS BIGINT) AS re_q FROM mode WHERE kz IN (0, 1) AND ky IN (0, 1) AND kx <= 1"))
def downsample_n4(spark, sf_dir):
    """Spectral truncation to half the resolution."""
    return dft4(packed4(spark, sf_dir)).where("kz in (0, 1) and ky in (0, 1) and kx <= 1").select("frame", "ch", "kz", "ky", "kx", q(F.col("re") / 8.0, 1).alias("re_q"))


@query("slice_midplane", with_(FIELD4, rest="SELECT frame, y, x, q FROM field4 WHERE ch = 0 AND z = 2"))
def slice_midplane(spark, sf_dir):
    return field4(spark, sf_dir).where("ch = 0 and z = 2").select("frame", "y", "x", "q")


@query("velocity_magnitude", with_(FIELD4, _PROD.split(",\nprod AS")[0], rest="SELECT frame, z, y, x, CAST(floor(sqrt(CAST(CAST(a AS HUGEINT) * a + CAST(b AS HUGEINT) * b + CAST(c AS HUGEINT) * c AS DOUBLE)) + 0.5) AS BIGINT) AS mag FROM v3"))
def velocity_magnitude(spark, sf_dir):
    """Unknown where a component is missing."""
    part = lambda c: F.max(F.when(F.col("ch") == c, _D("q")))
    s = sum((part(c) * part(c) for c in (1, 2)), part(0) * part(0))
    v = field4(spark, sf_dir).groupBy("frame", "z", "y", "x").agg(s.cast("double").alias("s"))
    return v.select("frame", "z", "y", "x", q(F.sqrt("s"), 1).alias("mag"))


@query("coriolis_n4", _sql("SELECT frame, kz, ky, kx, CAST(-2 * 2.5 * re_v AS BIGINT) AS re_cx, CAST(2 * 2.5 * re_u AS BIGINT) AS re_cy FROM uvw"))
def coriolis_n4(spark, sf_dir):
    """2 Omega x u about the z axis, with Omega 2.5."""
    m = by_channel(packed4(spark, sf_dir), UVW)
    return m.select("frame", "kz", "ky", "kx", (-5 * F.col("re_v")).alias("re_cx"), (5 * F.col("re_u")).alias("re_cy"))


def upsample_linear(field: DataFrame, n: int = 4) -> DataFrame:
    """Linear interpolation to twice the points per axis, half-pixel centres, clamped at the edges: eight weighted neighbours of each new point."""
    for axis in ("x", "y", "z"):
        at = F.explode(F.sequence(F.greatest(F.lit(0), 2 * F.col(axis) - 1), F.least(F.lit(2 * n - 1), 2 * F.col(axis) + 2)))
        others = [c for c in ("frame", "z", "y", "x") if c != axis]
        spread = field.select(*others, F.col(axis).alias("from"), at.alias("to"), "q")
        src = F.least(F.greatest((F.col("to") + 0.5) / 2 - 0.5, F.lit(0.0)), F.lit(n - 1.0))
        weight = F.greatest(F.lit(0.0), 1 - F.abs(src - F.col("from")))
        field = spread.groupBy(*others, F.col("to").alias(axis)).agg(F.sum(F.col("q") * weight).alias("q"))
    return field.select("frame", "z", "y", "x", "q")


@query("upsample_linear_n4_all", with_(FIELD4, "w AS (SELECT CAST(t AS INTEGER) AS t, CAST(f AS INTEGER) AS f, greatest(0, 1 - abs(least(greatest((t + 0.5) / 2 - 0.5, 0), 3) - f))::DOUBLE AS w FROM range(0, 8) AS a(t), range(0, 4) AS b(f))",
       rest="SELECT frame, wz.t AS z, wy.t AS y, wx.t AS x, CAST(floor(sum(q * wz.w * wy.w * wx.w) * 64 + 0.5) AS BIGINT) AS q64 FROM field4 JOIN w wz ON wz.f = z AND wz.w > 0 JOIN w wy ON wy.f = y AND wy.w > 0 JOIN w wx ON wx.f = x AND wx.w > 0 WHERE ch = 0 GROUP BY ALL"))
def upsample_linear_n4_all(spark, sf_dir):
    """Every frame."""
    return upsample_linear(field4(spark, sf_dir).where("ch = 0").select("frame", "z", "y", "x", F.col("q").cast("double").alias("q"))).select("frame", "z", "y", "x", q("q", 64).alias("q64"))


def rfft_packed(fields: DataFrame, n: int) -> DataFrame:
    """Forward real FFT of packed fields (frame, values: n^3 doubles): re and im arrays in C order of the half spectrum. One Arrow batch at a time, no grouping."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            h = np.fft.rfftn(np.stack(b["values"].to_numpy()).reshape(-1, n, n, n), axes=(1, 2, 3)).reshape(len(b), -1)
            yield pd.DataFrame({"frame": b["frame"], "re": list(h.real), "im": list(h.imag)})

    return fields.select("frame", "values").mapInPandas(run, "frame long, re array<double>, im array<double>")


@query("fft_packed_energy", with_(FIELD4, rest="SELECT frame * 4 + ch AS frame, CAST(floor(sum((q / 1e6) * (q / 1e6)) * 1e6 + 0.5) AS BIGINT) AS e_q FROM field4 GROUP BY ALL"))
def fft_packed_energy(spark, sf_dir):
    """Parseval by numpy FFT; the oracle has it from the points."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: q(x) / 1e6).alias("values"))
    w = F.array(*(F.lit(1.0 if i % 3 != 1 else 2.0) for i in range(48)))
    h = rfft_packed(e, 4).withColumn("s", F.zip_with(F.zip_with("re", "im", lambda a, b: a * a + b * b), w, lambda a, b: a * b))
    return h.select("frame", q(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / 64).alias("e_q"))

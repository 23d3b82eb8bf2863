"""Transforms of N x N x N fields for any N, one axis at a time, and what needs them back at points: gradients, vorticity, downsampling.

A field travels as planes (frame, ch, z, values: N x N in order y, x). Tasks transform planes
over x and y by products with an N x N table of twiddles; one shuffle by (frame, ky) turns planes
into lines over z, whose transform gives the half spectrum: rows (frame, ky, re, im), with one
array of N x (N/2 + 1) numbers (kz, kx) for each channel. That is O(N^4) work a field, in units of
one plane, against O(N^6) for points joined with modes. All channels of a frame's ky are in one
row, so mode algebra is column arithmetic without a shuffle. The inverse goes the same way back,
with one shuffle by (frame, z).

Modes of the half axis stand for their mirror images; as in a real inverse transform, what is
not mirror-symmetric (such as i k at the Nyquist mode) adds its real part only. A frame that
lacks planes of an asked channel gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixtures import table
from ..model import q
from ..registry import query


@cache
def twiddles(n: int, half: bool, sign: int) -> np.ndarray:
    """exp(sign 2 pi i k x / n), rows k."""
    k = np.arange(n // 2 + 1 if half else n)
    m = np.outer(k, np.arange(n)) % n
    return np.cos(2 * np.pi * m / n) + sign * 1j * np.sin(2 * np.pi * m / n)


def _numbers(column: pa.Array, *shape: int) -> np.ndarray:
    while not pa.types.is_floating(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).reshape(-1, *shape)


def _small(batches: Iterator[pa.RecordBatch], numbers: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows of so many numbers, and what is worked out from them, stay small in memory."""
    rows = max(1, 2**17 // numbers)
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def _lists(x: np.ndarray) -> pa.ListArray:
    """A column of lists from the rows of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _nested(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), _lists(x.reshape(-1, x.shape[2])))


def _lined(df: DataFrame, keys: list[str], position: str, lines: int) -> DataFrame:
    """Lines of one key in order of channel and position; keys that lack some are left out. A group holds the lines of one plane of each channel."""
    got = F.sort_array(F.collect_list(F.struct("ch", position, "re", "im"))).alias("lines")
    return df.groupBy(*keys).agg(got).where(F.size("lines") == lines).select(*keys, F.col("lines.re").alias("re"), F.col("lines.im").alias("im"))


def forward(planes: DataFrame, n: int, channels: list[int]) -> DataFrame:
    """(frame, ky, re, im) of planes (frame, ch, z, values): for each channel, in the order given, an array over kz and kx. ky and kz are places 0 to n - 1."""
    h = n // 2 + 1

    def over_yx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, n * n):
            t = twiddles(n, False, -1) @ (_numbers(b.column(3), n, n) @ twiddles(n, True, -1).T)
            again = lambda c: pa.array(np.repeat(c.to_numpy(), n))  # noqa: B023, E731
            t = t.reshape(-1, h)
            yield pa.RecordBatch.from_arrays([again(b.column(0)), again(b.column(1)), again(b.column(2)), pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows)), _lists(t.real.copy()), _lists(t.imag.copy())], names=["frame", "ch", "z", "ky", "re", "im"])

    def over_z(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, len(channels) * n * h):
            x = _numbers(b.column(2), len(channels), n, h) + 1j * _numbers(b.column(3), len(channels), n, h)
            t = (twiddles(n, False, -1) @ x).reshape(b.num_rows, len(channels), n * h)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _nested(t.real.copy()), _nested(t.imag.copy())], names=["frame", "ky", "re", "im"])

    place = F.array_position(F.array(*map(F.lit, channels)), F.col("ch").cast("int")).cast("int")
    rows = planes.where(F.col("ch").isin(*channels)).select(F.col("frame").cast("long").alias("frame"), place.alias("ch"), F.col("z").cast("int").alias("z"), F.col("values").cast("array<double>").alias("values"))
    lines = rows.mapInArrow(over_yx, "frame long, ch int, z int, ky int, re array<double>, im array<double>")
    return _lined(lines, ["frame", "ky"], "z", len(channels) * n).mapInArrow(over_z, "frame long, ky int, re array<array<double>>, im array<array<double>>")


def inverse(modes: DataFrame, n: int, channels: int) -> DataFrame:
    """(frame, z, values) of modes (frame, ky, re, im): for each channel an array over y and x."""
    h = n // 2 + 1
    weight = np.array([1.0 if k in (0, n / 2) else 2.0 for k in range(h)])

    def over_z(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, channels * n * h):
            x = _numbers(b.column(2), channels, n, h) + 1j * _numbers(b.column(3), channels, n, h)
            t = (twiddles(n, False, 1) @ x).reshape(-1, h)
            each = lambda c: pa.array(np.repeat(c.to_numpy(), channels * n))  # noqa: B023, E731
            ch, z = (pa.array(np.tile(v.ravel().astype(np.int32), b.num_rows)) for v in np.indices((channels, n)))
            yield pa.RecordBatch.from_arrays([each(b.column(0)), ch, z, each(b.column(1)), _lists(t.real.copy()), _lists(t.imag.copy())], names=["frame", "ch", "z", "ky", "re", "im"])

    def over_yx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, channels * n * h):
            x = _numbers(b.column(2), channels, n, h) + 1j * _numbers(b.column(3), channels, n, h)
            t = ((twiddles(n, False, 1) @ x) * weight) @ twiddles(n, True, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _nested((t.real / n**3).reshape(b.num_rows, channels, n * n))], names=["frame", "z", "values"])

    lines = modes.select("frame", "ky", "re", "im").mapInArrow(over_z, "frame long, ch int, z int, ky int, re array<double>, im array<double>")
    return _lined(lines, ["frame", "z"], "ky", channels * n).mapInArrow(over_yx, "frame long, z int, values array<array<double>>")


def wave(place: Column, n: int) -> Column:
    """The integer wavenumber of a place on a full axis; the Nyquist mode is -n/2."""
    return F.when(place * 2 >= n, place - n).otherwise(place)


def wavenumber(axis: str, n: int) -> Callable[[Column], Column]:
    """The wavenumber along an axis as a function of the place in a row's arrays."""
    h = n // 2 + 1
    if axis == "x":
        return lambda i: i % h
    return (lambda i: wave(F.floor(i / h), n)) if axis == "z" else (lambda i: wave(F.col("ky"), n))


def times_ik(re: Column, im: Column, axis: str, n: int) -> tuple[Column, Column]:
    """i k (a + ib) = -k b + i k a."""
    k = wavenumber(axis, n)
    return F.transform(im, lambda v, i: -v * k(i)), F.transform(re, lambda v, i: v * k(i))


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def derivatives(modes: DataFrame, n: int, of: list[tuple[int, str]]) -> DataFrame:
    """Modes whose channels are the derivatives asked for: (channel, axis)."""
    made = [times_ik(F.col("re")[c], F.col("im")[c], axis, n) for c, axis in of]
    return modes.select("frame", "ky", F.array(*(m[0] for m in made)).alias("re"), F.array(*(m[1] for m in made)).alias("im"))


def gradient(planes: DataFrame, n: int, channel: int) -> DataFrame:
    """The gradient of a channel at points, in order d/dx, d/dy, d/dz."""
    return inverse(derivatives(forward(planes, n, [channel]), n, [(0, a) for a in "xyz"]), n, 3)


#: Of each component of a curl: (channel, axis) of the derivative that counts, and of the one that is taken off.
CURL = [((2, "y"), (1, "z")), ((0, "z"), (2, "x")), ((1, "x"), (0, "y"))]


def curl(modes: DataFrame, n: int) -> DataFrame:
    """i k x u of modes of the three velocity channels."""
    d = lambda c, a: times_ik(F.col("re")[c], F.col("im")[c], a, n)
    pairs = [(d(*plus), d(*minus)) for plus, minus in CURL]
    return modes.select("frame", "ky", *(F.array(*(_minus(p[j], m[j]) for p, m in pairs)).alias(name) for j, name in enumerate(("re", "im"))))


def vorticity(planes: DataFrame, n: int) -> DataFrame:
    """The curl of the channels 0 to 2 at points."""
    return inverse(curl(forward(planes, n, [0, 1, 2]), n), n, 3)


def cross(modes: DataFrame, omega: tuple[float, float, float]) -> DataFrame:
    """omega x u of modes of the three velocity channels, both parts."""
    x, y, z = (F.lit(float(w)) for w in omega)

    def of(part: str) -> Column:
        u, v, w = (F.col(part)[c] for c in range(3))
        term = lambda a, p, b, r: F.zip_with(p, r, lambda s, t: a * s - b * t)
        return F.array(term(y, w, z, v), term(z, u, x, w), term(x, v, y, u)).alias(part)

    return modes.select("frame", "ky", of("re"), of("im"))


def truncate(modes: DataFrame, n: int, factor: int) -> DataFrame:
    """The modes that a grid of n / factor points an axis holds: of ky and kz the lowest from either end, re-indexed, of kx those up to the new Nyquist mode; scaled for the smaller inverse."""
    m, h, g = n // factor, n // 2 + 1, n // factor // 2 + 1
    low = m // 2
    kept = modes.where((F.col("ky") < low) | (F.col("ky") >= n - low))
    places = F.flatten(F.transform(F.array(*(F.lit(k) for k in [*range(low), *range(n - low, n)])), lambda k: F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda x: k * h + x)))
    pick = lambda part: F.transform(part, lambda v: F.transform(places, lambda i: v[i] / float(factor**3)))
    return kept.select("frame", F.when(F.col("ky") < low, F.col("ky")).otherwise(F.col("ky") - (n - m)).alias("ky"), pick("re").alias("re"), pick("im").alias("im"))


def downsample(planes: DataFrame, n: int, channels: list[int], factor: int = 2) -> DataFrame:
    """The channels on a grid coarser by a factor, by truncation of their spectrum. (n / factor must be even.)"""
    if n % factor or n // factor % 2:
        raise ValueError("the coarse grid must have an even number of points")
    return inverse(truncate(forward(planes, n, channels), n, factor), n // factor, len(channels))


def points(planes: DataFrame, n: int, names: list[str]) -> DataFrame:
    """(frame, z, y, x) and a column for each channel of inverse's rows."""
    at = planes.select("frame", "z", F.posexplode(F.arrays_zip(*(F.col("values")[i].alias(c) for i, c in enumerate(names)))).alias("at", "v"))
    return at.select("frame", "z", F.floor(F.col("at") / n).cast("int").alias("y"), (F.col("at") % n).cast("int").alias("x"), *(F.col(f"v.{c}").alias(c) for c in names))


# --- queries over fields from `embeddings`, of 4 or 8 points an axis, in whole millionths


def planes_of(spark, sf_dir: str, n: int) -> DataFrame:
    """A vector of 64 components is a field of four planes of 4 x 4, or one plane of 8 x 8."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("v"), F.transform("embedding", lambda x: q(x).cast("double")).alias("e"))
    if n == 8:
        return e.select(F.floor(F.col("v") / 32).alias("frame"), (F.floor(F.col("v") / 8) % 4).cast("int").alias("ch"), (F.col("v") % 8).cast("int").alias("z"), F.col("e").alias("values"))
    z = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("z")
    return e.select(F.floor(F.col("v") / 4).alias("frame"), (F.col("v") % 4).cast("int").alias("ch"), z, "e").select("frame", "ch", "z", F.slice("e", F.col("z") * 4 * 4 + 1, 16).alias("values"))


def _sql_field(n: int, channels: list[int]) -> str:
    at = "vec_id // 32 AS frame, CAST((vec_id // 8) % 4 AS INTEGER) AS ch, CAST(vec_id % 8 AS INTEGER) AS z, CAST((pos - 1) // 8 AS INTEGER) AS y, CAST((pos - 1) % 8 AS INTEGER) AS x" if n == 8 else "vec_id // 4 AS frame, CAST(vec_id % 4 AS INTEGER) AS ch, CAST((pos - 1) // 16 AS INTEGER) AS z, CAST((pos - 1) // 4 % 4 AS INTEGER) AS y, CAST((pos - 1) % 4 AS INTEGER) AS x"
    asked = ", ".join(map(str, channels))
    return f"""every AS (SELECT {at}, floor(CAST(embedding[pos] AS DOUBLE) * 1e6 + 0.5) AS q FROM embeddings, unnest(range(1, 65)) AS u(pos)),
  f AS MATERIALIZED (SELECT * FROM every WHERE ch IN ({asked}) AND frame IN (SELECT frame FROM every WHERE ch IN ({asked}) GROUP BY frame HAVING count(*) = {len(channels) * n**3})),
  k AS (SELECT CAST(a AS INTEGER) AS kz, CAST(b AS INTEGER) AS ky, CAST(c AS INTEGER) AS kx, CASE WHEN c IN (0, {n // 2}) THEN 1 ELSE 2 END AS w FROM range({-(n // 2)}, {n // 2}) AS z(a), range({-(n // 2)}, {n // 2}) AS y(b), range(0, {n // 2 + 1}) AS x(c)),
  m AS (SELECT frame, ch, kz, ky, kx, w, sum(q * cos(2 * pi() * ((kz * z + ky * y + kx * x) % {n}) / {n})) AS re, -sum(q * sin(2 * pi() * ((kz * z + ky * y + kx * x) % {n}) / {n})) AS im FROM f, k GROUP BY ALL)"""


def _sql_back(n: int, source: str, parts: list[str], norm: int) -> tuple[str, str]:
    """The grid as a CTE `p`, and the SELECT of the points of `source`, which has kz, ky, kx, w and re_, im_ of each part."""
    angle = f"2 * pi() * ((s.kz * z + s.ky * y + s.kx * x) % {n}) / {n}"
    grid = f"p AS (SELECT CAST(a AS INTEGER) AS z, CAST(b AS INTEGER) AS y, CAST(c AS INTEGER) AS x FROM range({n}) AS z(a), range({n}) AS y(b), range({n}) AS x(c))"
    columns = ", ".join(f"CAST(floor(sum(s.w * (re_{c} * cos({angle}) - im_{c} * sin({angle}))) / {norm} + 0.37) AS BIGINT) AS {c}" for c in parts)
    return grid, f"SELECT frame, z, y, x, {columns} FROM {source} AS s, p GROUP BY frame, z, y, x"


_UVW = "b AS (SELECT frame, kz, ky, kx, w, " + ", ".join(f"max(CASE WHEN ch = {c} THEN {p} END) AS {p}_{u}" for c, u in enumerate("uvw") for p in ("re", "im")) + " FROM m GROUP BY ALL)"
_CURL = "o AS (SELECT frame, kz, ky, kx, w, -(ky * im_w - kz * im_v) AS re_ox, ky * re_w - kz * re_v AS im_ox, -(kz * im_u - kx * im_w) AS re_oy, kz * re_u - kx * re_w AS im_oy, -(kx * im_v - ky * im_u) AS re_oz, kx * re_v - ky * re_u AS im_oz FROM b)"


def _whole(df: DataFrame, names: list[str]) -> DataFrame:
    """Points in whole millionths; the odd offset keeps rational values away from the edge."""
    return df.select("frame", "z", "y", "x", *(F.floor(F.col(c) + 0.37).cast("long").alias(c) for c in names))


def _sql_gradient(n: int) -> str:
    g = "g AS (SELECT frame, kz, ky, kx, w, " + ", ".join(f"-{k} * im AS re_g{k[1]}, {k} * re AS im_g{k[1]}" for k in ("kx", "ky", "kz")) + " FROM m)"
    grid, points = _sql_back(n, "g", ["gx", "gy", "gz"], n**3)
    return f"WITH {_sql_field(n, [3])},\n{g},\n{grid}\n{points}"


def _sql_vorticity(n: int) -> str:
    grid, points = _sql_back(n, "o", ["ox", "oy", "oz"], n**3)
    return f"WITH {_sql_field(n, [0, 1, 2])},\n{_UVW},\n{_CURL},\n{grid}\n{points}"


def _sql_downsample(n: int) -> str:
    low = n // 4
    d = f"d AS (SELECT frame, kz, ky, kx, CASE WHEN kx IN (0, {low}) THEN 1 ELSE 2 END AS w, " + ", ".join(f"{p}_{u}" for u in "uvw" for p in ("re", "im")) + f" FROM b WHERE kz >= {-low} AND kz < {low} AND ky >= {-low} AND ky < {low} AND kx <= {low})"
    grid, points = _sql_back(n // 2, "d", ["u", "v", "w"], n**3)
    return f"WITH {_sql_field(n, [0, 1, 2])},\n{_UVW},\n{d},\n{grid}\n{points}"


def _register(n: int) -> None:
    @query(f"gradient_points_n{n}", _sql_gradient(n))
    def gradient_points(spark, sf_dir):
        """The pressure's gradient at every point."""
        return _whole(points(gradient(planes_of(spark, sf_dir, n), n, 3), n, ["gx", "gy", "gz"]), ["gx", "gy", "gz"])

    @query(f"vorticity_points_n{n}", _sql_vorticity(n))
    def vorticity_points(spark, sf_dir):
        return _whole(points(vorticity(planes_of(spark, sf_dir, n), n), n, ["ox", "oy", "oz"]), ["ox", "oy", "oz"])

    @query(f"downsample_points_n{n}", _sql_downsample(n))
    def downsample_points(spark, sf_dir):
        """The velocity on half the points an axis."""
        return _whole(points(downsample(planes_of(spark, sf_dir, n), n, [0, 1, 2]), n // 2, ["u", "v", "w"]), ["u", "v", "w"])

    @query(f"separable_roundtrip_n{n}", f"WITH {_sql_field(n, [0, 1, 2, 3])} SELECT frame, z, y, x, " + ", ".join(f"CAST(max(CASE WHEN ch = {c} THEN q END) AS BIGINT) AS c{c}" for c in range(4)) + " FROM f GROUP BY frame, z, y, x")
    def roundtrip(spark, sf_dir):
        """Forward and back gives every point of all channels."""
        names = [f"c{c}" for c in range(4)]
        p = points(inverse(forward(planes_of(spark, sf_dir, n), n, [0, 1, 2, 3]), n, 4), n, names)
        return p.select("frame", "z", "y", "x", *(F.round(c).cast("long").alias(c) for c in names))


for _n in (4, 8):
    _register(_n)

_OMEGA = (0.5, -1.25, 2.5)


@query("coriolis_modes_n8", f"WITH {_sql_field(8, [0, 1, 2])},\n{_UVW}\nSELECT frame, kz, ky, kx, " + ", ".join(f"CAST(floor({w1} * {p}_{a} - ({w2}) * {p}_{b} + 0.37) AS BIGINT) AS {p}_c{x}" for p in ("re", "im") for x, w1, a, w2, b in (("x", -1.25, "w", 2.5, "v"), ("y", 2.5, "u", 0.5, "w"), ("z", 0.5, "v", -1.25, "u"))) + " FROM b")
def coriolis_modes_n8(spark, sf_dir):
    """A constant vector times velocity, real and imaginary parts on every axis."""
    m = cross(forward(planes_of(spark, sf_dir, 8), 8, [0, 1, 2]), _OMEGA)
    names = [f"{p}_c{x}" for p in ("re", "im") for x in "xyz"]
    at = m.select("frame", wave(F.col("ky"), 8).cast("int").alias("ky"), F.posexplode(F.arrays_zip(*(F.col(c[:2])[i % 3].alias(c) for i, c in enumerate(names)))).alias("at", "v"))
    return at.select("frame", wave(F.floor(F.col("at") / 5), 8).cast("int").alias("kz"), "ky", (F.col("at") % 5).cast("int").alias("kx"), *(F.floor(F.col(f"v.{c}") + 0.37).cast("long").alias(c) for c in names))


_grid, _points = _sql_back(8, "o", ["ox", "oy", "oz"], 512)


@query("midplane_slices_n8", f"""WITH {_sql_field(8, [0, 1, 2])},\n{_UVW},\n{_CURL},\n{_grid},\nr AS ({_points} HAVING z = 4)
SELECT r.frame, r.y, r.x, CAST(floor(sqrt(CAST(CAST(ox AS HUGEINT) * ox + CAST(oy AS HUGEINT) * oy + CAST(oz AS HUGEINT) * oz AS DOUBLE)) + 0.5) AS BIGINT) AS magnitude, CAST(f.q AS BIGINT) AS ux
FROM r JOIN f ON f.frame = r.frame AND f.z = r.z AND f.y = r.y AND f.x = r.x AND f.ch = 0""")
def midplane_slices_n8(spark, sf_dir):
    """The vorticity's magnitude and u_x on the middle plane of the first axis. The vorticity is in whole millionths, as at points."""
    planes = planes_of(spark, sf_dir, 8)
    o = _whole(points(vorticity(planes, 8).where("z = 4"), 8, ["ox", "oy", "oz"]), ["ox", "oy", "oz"])
    d = lambda c: F.col(c).cast("decimal(19,0)")
    ux = planes.where("ch = 0 and z = 4").select("frame", F.posexplode("values").alias("at", "q")).select("frame", F.floor(F.col("at") / 8).cast("int").alias("y"), (F.col("at") % 8).cast("int").alias("x"), F.col("q").cast("long").alias("ux"))
    s = (d("ox") * d("ox") + d("oy") * d("oy") + d("oz") * d("oz")).cast("double")
    return o.join(ux, ["frame", "y", "x"]).select("frame", "y", "x", q(F.sqrt(s), 1).alias("magnitude"), "ux")

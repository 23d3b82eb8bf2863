"""Transforms by axes against numpy's, and known fields."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlake.operators import separable as S

SCHEMA = "frame long, ch int, z int, values array<double>"


def planes(spark, fields, parts=3):
    """fields: {(frame, ch): N x N x N}"""
    return spark.createDataFrame([(f, c, z, p.ravel().tolist()) for (f, c), x in fields.items() for z, p in enumerate(x)], SCHEMA).repartition(parts)


def gathered(df, n, channels):
    out = {}
    for r in df.collect():
        out.setdefault(r["frame"], np.full((channels, n, n, n), np.nan))[:, r["z"]] = np.array(r["values"]).reshape(channels, n, n)
    return out


def random(n, frames=2, channels=3, seed=1):
    rng = np.random.default_rng(seed)
    return {(f, c): rng.normal(size=(n, n, n)) for f in range(frames) for c in range(channels)}


@pytest.mark.parametrize("n", [2, 5, 8, 16])
def test_forward_and_inverse(spark, n):
    x = random(n)
    m = S.forward(planes(spark, x), n, [2, 0])
    h = n // 2 + 1
    for r in m.collect():
        for i, c in enumerate((2, 0)):
            want = np.fft.rfftn(x[r["frame"], c])[:, r["ky"]]
            assert np.allclose(np.array(r["re"][i]).reshape(n, h) + 1j * np.array(r["im"][i]).reshape(n, h), want)
    back = gathered(S.inverse(m, n, 2), n, 2)
    assert all(np.allclose(back[f], [x[f, 2], x[f, 0]]) for f in (0, 1))


def numpy_derivative(x, axis):
    """The real part of the inverse of i k u; axes x, y, z are the last, second and first."""
    n = len(x)
    k = np.fft.fftfreq(n, 1 / n) if axis != "x" else np.fft.rfftfreq(n, 1 / n)
    shape = {"z": (-1, 1, 1), "y": (1, -1, 1), "x": (1, 1, -1)}[axis]
    return np.fft.irfftn(1j * k.reshape(shape) * np.fft.rfftn(x), s=(n, n, n), axes=(0, 1, 2))


@pytest.mark.parametrize("n", [5, 8])
def test_gradient_and_vorticity(spark, n):
    x = random(n)
    g = gathered(S.gradient(planes(spark, x), n, 1), n, 3)
    o = gathered(S.vorticity(planes(spark, x), n), n, 3)
    for f in (0, 1):
        assert np.allclose(g[f], [numpy_derivative(x[f, 1], a) for a in "xyz"])
        u, v, w = (x[f, c] for c in range(3))
        d = numpy_derivative
        assert np.allclose(o[f], [d(w, "y") - d(v, "z"), d(u, "z") - d(w, "x"), d(v, "x") - d(u, "y")])


def test_known_fields(spark):
    n = 8
    z, y, x = np.meshgrid(*[2 * np.pi * np.arange(n) / n] * 3, indexing="ij")
    shear = planes(spark, {(0, 0): np.sin(y)})
    assert np.allclose(gathered(S.gradient(shear, n, 0), n, 3)[0], [0 * x, np.cos(y), 0 * x], atol=1e-12)
    # A field that is its own curl: sin z + cos y, sin x + cos z, sin y + cos x.
    own = {(0, 0): np.sin(z) + np.cos(y), (0, 1): np.sin(x) + np.cos(z), (0, 2): np.sin(y) + np.cos(x)}
    assert np.allclose(gathered(S.vorticity(planes(spark, own), n), n, 3)[0], [own[0, c] for c in range(3)], atol=1e-12)


@pytest.mark.parametrize(("n", "factor"), [(8, 2), (16, 4), (12, 3)])
def test_downsample_keeps_all_corner_blocks(spark, n, factor):
    x = random(n, 1)
    m = n // factor
    low = m // 2
    for got, c in ((gathered(S.downsample(planes(spark, x), n, [0, 1, 2], factor), m, 3)[0][c], c) for c in range(3)):
        h = np.fft.rfftn(x[0, c])
        keep = [*range(low), *range(n - low, n)]
        want = np.fft.irfftn(h[np.ix_(keep, keep, range(low + 1))] / factor**3, s=(m, m, m), axes=(0, 1, 2))
        assert np.allclose(got, want)
    smooth = {(0, 0): np.fromfunction(lambda z, y, x: np.cos(2 * np.pi * (y - x) / n) + np.sin(2 * np.pi * z / n), (n, n, n))}
    assert np.allclose(gathered(S.downsample(planes(spark, smooth), n, [0], factor), m, 1)[0][0], smooth[0, 0][::factor, ::factor, ::factor])


def test_no_points_are_joined_with_modes_and_two_shuffles_do(spark):
    plan = S.vorticity(planes(spark, random(4)), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    final = S.inverse(S.curl(S.forward(spark.read.schema(SCHEMA).parquet(_written(spark)), 4, [0, 1, 2]), 4), 4, 3)
    assert final._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def _written(spark):
    from fluxlake.sources.stores import shared_path

    path = shared_path(spark, "planes")
    planes(spark, random(4)).write.parquet(path)
    return path


def test_edges(spark):
    x = random(4)
    p = planes(spark, x)
    lacking = p.where(~((F.col("frame") == 1) & (F.col("ch") == 2) & (F.col("z") == 3)))
    assert set(gathered(S.vorticity(lacking, 4), 4, 3)) == {0}  # a frame without one of its planes
    assert set(gathered(S.gradient(lacking, 4, 1), 4, 3)) == {0, 1}
    assert S.vorticity(p.limit(0), 4).count() == 0
    with pytest.raises(ValueError, match="even"):
        S.downsample(p, 4, [0], 4)
    with pytest.raises(ValueError, match="even"):
        S.downsample(p, 4, [0], 3)


def test_large_batches_are_worked_in_small_parts():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["frame"])
    parts = list(S._small([b, b.slice(0, 0)], 12 * 40))
    assert max(p.num_rows for p in parts) * 12 * 40 <= 2**17
    assert [v for p in parts for v in p.column(0).to_pylist()] == list(range(10_000))
    assert [p.num_rows for p in S._small([b.slice(0, 2)], 2**20)] == [1, 1]

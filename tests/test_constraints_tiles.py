"""The constraint chain and tiled stencils against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlake.operators import constraints as C
from fluxlake.operators import tiles as T
from test_separable import gathered, planes, random

def first():
    return F.col("frame") % 2 == 0


def wavenumbers(n):
    full, half = np.fft.fftfreq(n, 1 / n), np.fft.rfftfreq(n, 1 / n)
    if n % 2 == 0:
        full[n // 2] = half[n // 2] = 0
    return np.meshgrid(full, full, half, indexing="ij")


def projected(u):
    n = u.shape[-1]
    kz, ky, kx = wavenumbers(n)
    h = np.fft.rfftn(u, axes=(1, 2, 3))
    k2 = kx**2 + ky**2 + kz**2
    dot = (kx * h[0] + ky * h[1] + kz * h[2]) / np.where(k2 > 0, k2, 1)
    return np.fft.irfftn(h - np.stack([kx, ky, kz]) * dot, s=(n, n, n), axes=(1, 2, 3))


def divergence(u):
    n = u.shape[-1]
    kz, ky, kx = wavenumbers(n)
    h = np.fft.rfftn(u, axes=(1, 2, 3))
    return np.fft.irfftn(1j * (kx * h[0] + ky * h[1] + kz * h[2]), s=(n, n, n), axes=(0, 1, 2))


def chain(x, truth, first, links):
    u = truth if "initial" in links and first else x
    u = projected(u) if "divergence" in links else u
    if "momentum" in links:
        u = u + (truth.mean((1, 2, 3)) - u.mean((1, 2, 3)))[:, None, None, None]
    if "energy" in links:
        u = u * np.sqrt((truth**2).sum(0).mean() / (u**2).sum(0).mean())
    return u


def stacked(fields, frame):
    return np.stack([fields[frame, c] for c in range(3)])


ALL = ("initial", "divergence", "momentum", "energy")


@pytest.mark.parametrize("links", [ALL, ALL[1:], ("divergence",), ("momentum",), ("energy",), ("initial",), ("divergence", "momentum")])
def test_the_chain(spark, links):
    n = 6
    x, y = random(n, seed=1), random(n, seed=2)
    got = gathered(C.project(planes(spark, x), planes(spark, y), n, first(), links), n, 3)
    assert all(np.allclose(got[f], chain(stacked(x, f), stacked(y, f), f == 0, links)) for f in (0, 1))


@pytest.mark.parametrize("n", [5, 8])
def test_each_link_closes_its_residual_and_no_other_does(spark, n):
    x, y = random(n, seed=1), random(n, seed=2)
    p, t = planes(spark, x), planes(spark, y)

    def left(links):
        r = C.residuals(C.project(p, t, n, F.lit(False), links), t, n)
        got = {v["frame"]: v for v in r.collect()}
        u = chain(stacked(x, 1), stacked(y, 1), False, links)
        d = np.abs(divergence(u))
        assert got[1]["div_max"] == pytest.approx(d.max(), abs=1e-9) and got[1]["div_mean"] == pytest.approx(d.mean(), abs=1e-9)
        return C.summed(r).first()

    whole = left(ALL)
    assert whole["div_max"] < 1e-9 and whole["energy_pct"] < 1e-9
    assert left(("divergence", "momentum"))["mean_velocity"] < 1e-12  # scaling comes after it
    assert left(("momentum", "energy"))["div_max"] > 0.1
    assert left(("divergence", "momentum"))["energy_pct"] > 0.1
    assert left(("divergence", "energy"))["mean_velocity"] > 1e-3


def test_chain_edges(spark):
    n = 4
    x, y = random(n, seed=1), random(n, seed=2)
    p, t = planes(spark, x), planes(spark, y)
    no_goal = gathered(C.project(p, t.where("frame = 1"), n, first()), n, 3)
    assert np.allclose(no_goal[0], projected(stacked(x, 0)))  # no true frame: only projected
    r = {v["frame"]: v for v in C.residuals(C.pack(p), t.where("frame = 1"), n).collect()}
    assert r[0]["energy_pct"] is None and r[0]["mean_velocity"] is None and r[1]["energy_pct"] is not None
    still = {(0, c): np.zeros((n, n, n)) for c in range(3)}
    assert np.allclose(gathered(C.project(planes(spark, still), planes(spark, still), n, F.lit(False)), n, 3)[0], 0)
    lacking = p.where("not (frame = 1 and ch = 0 and z = 2)")
    assert set(gathered(C.project(lacking, t, n, F.lit(False)), n, 3)) == {0}
    assert C.project(p.limit(0), t, n, first()).count() == 0
    with pytest.raises(ValueError, match="mass"):
        C.project(p, t, n, first(), ("mass",))


# --- tiles


def tiled(spark, x, c, halo, weights):
    n = len(x)
    rows = [("a", 1, 0, 0, z, v.ravel().tolist()) for z, v in enumerate(x)]
    df = spark.createDataFrame(rows, "case string, seed int, ord int, ch int, z int, values array<double>").repartition(3)
    out = np.full(x.shape, np.nan)
    got = T.stencil(df, n, c, halo, weights).collect()
    for r in got:
        out[r["z"], r["y"], r["x"]] = r["value"]
    assert len(got) == n**3
    return out


def whole(x, weights):
    return sum(w * np.roll(x, [-d for d in o], (0, 1, 2)) for o, w in weights.items())


WIDE = {(0, 0, 2): 1.0, (-2, 0, 0): -3.0, (2, -1, 2): 0.5, (0, 0, 0): 1.0}


@pytest.mark.parametrize(("n", "c", "halo", "weights"), [(8, 4, 1, T.LAPLACE), (6, 2, 1, T.BOX), (6, 3, 2, WIDE), (4, 2, 2, WIDE), (4, 4, 1, T.BOX), (6, 2, 2, T.BOX)])
def test_tiles_equal_the_whole_frame(spark, n, c, halo, weights):
    x = np.random.default_rng(3).normal(size=(n, n, n))
    assert np.allclose(tiled(spark, x, c, halo, weights), whole(x, weights))


def test_without_a_halo_the_seams_show(spark):
    x = np.random.default_rng(4).normal(size=(6, 6, 6))
    got, want = tiled(spark, x, 3, 0, T.LAPLACE), whole(x, T.LAPLACE)
    inner = np.ix_(*[[1, 4]] * 3)
    assert np.allclose(got[inner], want[inner]) and not np.allclose(got, want)
    assert (~np.isclose(got, want)).sum() == 6**3 - 8  # all points but the middles of the tiles
    with pytest.raises(ValueError, match="halo"):
        tiled(spark, x, 2, 3, T.BOX)


def test_stencils_share_their_tiles_and_keep_nulls(spark, sf_dir):
    from fluxlake import registry

    x = np.random.default_rng(5).normal(size=(4, 4, 4))
    rows = [("a", 1, 0, 0, z, [None if (z, i) == (1, 5) else float(u) for i, u in enumerate(v.ravel())]) for z, v in enumerate(x)]
    df = spark.createDataFrame(rows, "case string, seed int, ord int, ch int, z int, values array<double>")
    got = {(r["z"], r["y"], r["x"]): r for r in T.stencils(df, 4, 2, 1, {"laplace": T.LAPLACE, "box": T.BOX}).collect()}
    near = {p for p in got if all((a - b + 5) % 4 < 3 for a, b in zip(p, (1, 1, 1), strict=True))}
    assert len(got) == 64 and {p for p in got if got[p]["box"] is None} == near
    assert all(got[p]["box"] == pytest.approx(whole(x, T.BOX)[p]) for p in set(got) - near)
    assert sum(r["laplace"] is None for r in got.values()) == 7
    plan = registry.queries()["tile_stencil_n4"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 2

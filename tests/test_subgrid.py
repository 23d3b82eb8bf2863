"""Known answers of the subgrid stresses and gates, and mutations that must show."""

import numpy as np
import pytest

from fluxlake.operators import acceptance as a
from fluxlake.operators import dynamics as d
from fluxlake.operators import subgrid as s


def points(n):
    z, y, x = np.meshgrid(*[np.arange(n) * 2 * np.pi / n] * 3, indexing="ij")
    return z, y, x


def test_strain_of_a_shear():
    _, y, _ = points(32)
    got = s.strain(d.Box(32), np.stack([np.sin(y), 0 * y, 0 * y]))
    assert np.allclose(got[3], np.cos(y) / 2, atol=1e-12) and np.allclose(np.delete(got, 3, 0), 0, atol=1e-12)


def test_uniform_flow_has_no_stress_and_a_wave_has():
    n = 16
    _, y, _ = points(n)
    box = d.Box(n)
    assert np.abs(s.stress(box, np.ones((3, n, n, n)), 0.1)).max() < 1e-12
    g = np.exp(-((0.1 * 2 * np.pi) ** 2) / 24)
    tau = s.stress(box, np.stack([np.sin(y), 0 * y, 0 * y]), 0.1)
    # sin^2 = (1 - cos 2y) / 2; the filter takes g^4 off cos 2y and g off sin y.
    assert np.allclose(tau[0], (1 - g**4 * np.cos(2 * y)) / 2 - g**2 * np.sin(y) ** 2, atol=1e-12)


def test_eddy_models_only_drain_and_have_no_trace():
    n = 16
    box = d.Box(n)
    u = s.smooth(box, d.random_solenoidal(n, 3), 0.1)
    tau = s.eddy_stress(box, u, 0.1, 0.03)
    assert np.abs(tau[:3].sum(0)).max() < 1e-12
    assert s.transfer(box, tau, u).min() > -1e-12  # u has no divergence
    assert s.transfer(box, -tau, u).max() < 1e-12
    top, below = s.germano(box, u, 0.1)
    assert np.allclose(s.dynamic_stress(box, u, 0.1, cap=1e9), s.eddy_stress(box, u, 0.1, max(top / below, 0)))


def test_trajectories_without_d_rows_are_refused(spark):
    good = (1e-8, 1e-3, 4.0, 1e-12, 1e-12)
    samples = {
        "good": [good, (1e-8, 1e-3, None, 1e-12, 1e-12)], "large": [good, (2e-6, 1e-3, 4.0, 1e-12, 1e-12)], "steep": [good, (1e-8, 1e-3, 7.0, 1e-12, 1e-12)],
        "no probe": [(1e-8, 1e-3, None, 1e-12, 1e-12)], "no pressure": [good, (1e-8, 1e-3, 4.0, None, 1e-12)], "pressure": [(1e-8, 1e-3, 4.0, 1e-12, 2e-8)],
    }
    rows = [(k, *r) for k, v in samples.items() for r in v]
    v = a.d_group(spark.createDataFrame(rows, "run string, d1 double, d2 double, ratio double, d4_poisson double, d4_gradient double"), "run")
    got = {(r["run"], r["item"]): r["verdict"] for r in v.collect()}
    odd = {("large", "D1"): "FAIL", ("steep", "D3"): "FAIL", ("no probe", "D3"): "MISSING", ("no pressure", "D4"): "MISSING", ("pressure", "D4"): "FAIL"}
    assert got == {(k, i): "pass" for k in samples for i in a.D_ITEMS} | odd
    runs = spark.createDataFrame([(k, 1.6, False, "pass", 9) for k in [*samples, "none"]] + [("coarse", 0.9, False, "pass", 0), ("dead", 1.6, True, None, 0)], "run string, k_max_eta double, a14_aborted boolean, a2 string, drift int")
    why = {r["run"]: r["why"] for r in a.trajectory_gate(runs, v, "run").collect()}
    assert why["good"] == "" and why["none"] == "D1,D2,D3,D4" and why["no probe"] == "D3" and why["coarse"] == "A1,D1,D2,D3,D4" and why["dead"].startswith("A14,A2")


@pytest.mark.parametrize("rows", [[], [(0, [0.0] * 24)]])
def test_frames_of_any_number(spark, rows):
    df = spark.createDataFrame(rows, "frame long, values array<double>")
    out = s.per_frame(df, 2, lambda box, u: [(float(u.sum()),)], "frame long, total double")
    assert out.count() == len(rows)

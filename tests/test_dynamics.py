"""Known answers of the field algebra and the steppers, and mutations that must fail."""

import numpy as np
import pytest

from fluxlake.operators import dynamics as d


def test_taylor_green_is_solenoidal_with_energy_an_eighth():
    box = d.Box(8)
    h = box.forward(d.taylor_green(8))
    assert abs(box.energy(h) - 1 / 8) < 1e-12
    assert np.abs((box.k * h).sum(0)).max() < 1e-10


def test_abc_is_beltrami():
    box = d.Box(8)
    u = d.abc(8)
    assert np.allclose(box.back(box.curl(box.forward(u))), u, atol=1e-12)
    assert abs(box.energy(box.forward(u)) - 1.5) < 1e-12


def test_abc_decays_exactly():
    box, nu, dt = d.Box(16), 0.05, 0.01
    h = box.forward(d.abc(16))
    for _ in range(20):
        h = d.rk3(box, h, dt, nu)
    assert abs(box.energy(h) - 1.5 * np.exp(-2 * nu * 20 * dt)) < 1e-9


def test_projection_is_idempotent_and_shells_sum_to_energy():
    box = d.Box(16)
    h = box.forward(np.random.default_rng(0).standard_normal((3, 16, 16, 16)))
    p = box.solenoidal(h)
    assert np.allclose(box.solenoidal(p), p)
    u = d.random_solenoidal(16, 1, energy=0.7)
    g = box.forward(u)
    assert abs(box.energy(g) - 0.7) < 1e-12
    assert abs(box.shells(g).sum() - 0.7) < 1e-9
    assert abs(box.energy(g) - (u**2).sum(0).mean() / 2) < 1e-12


def test_orders_of_the_steppers():
    box = d.Box(16)
    h0 = box.forward(d.random_solenoidal(16, 3, peak=2.0)) * box.keep

    def run(step, n):
        h = h0
        for _ in range(n):
            h = step(box, h, 0.2 / n, 0.02)
        return h

    exact = run(d.rk4, 128)
    for step, order in ((d.rk3, 3), (d.rk4, 4)):
        e = [np.abs(run(step, n) - exact).max() for n in (4, 8)]
        assert np.log2(e[0] / e[1]) > order - 0.6


def test_fixed_power_injects_its_power():
    box = d.Box(16)
    h = box.forward(d.random_solenoidal(16, 4))
    f = d.fixed_power(0.3, 3.0)(box, h)
    assert abs((box.weight * (h.conj() * f).real.sum(0)).sum() / box.n**6 - 0.3) < 1e-9


def test_coriolis_does_no_work_and_wrong_axis_would():
    box = d.Box(16)
    h = box.forward(d.random_solenoidal(16, 5))
    work = lambda f: abs((box.weight * (h.conj() * f).real.sum(0)).sum() / box.n**6)
    f = d.rotating(2.5)(box, h)
    assert work(f) < 1e-12
    assert work(f[::-1]) > 1e-3


def test_pressure_of_taylor_green():
    n = 16
    z, y, x = np.meshgrid(*[np.arange(n) * 2 * np.pi / n] * 3, indexing="ij")
    want = (np.cos(2 * x) + np.cos(2 * y)) * (np.cos(2 * z) + 2) / 16
    assert np.allclose(d.Box(n).pressure(d.taylor_green(n)), want, atol=1e-12)


def test_ornstein_uhlenbeck_is_stationary():
    rng = np.random.default_rng(0)
    s = np.zeros(20_000)
    for _ in range(200):
        s = d.ornstein_uhlenbeck(s, 0.1, 1.0, 2.0, rng.standard_normal(len(s)))
    assert abs(s.var() - 2.0) < 0.1


def test_smagorinsky_of_a_shear():
    n = 16
    z, y, x = np.meshgrid(*[np.arange(n) * 2 * np.pi / n] * 3, indexing="ij")
    u = np.stack([np.sin(y), np.zeros_like(y), np.zeros_like(y)])
    tau = d.Box(n).smagorinsky(u)
    assert np.allclose(tau[:3], 0, atol=1e-12)
    s12 = np.cos(y) / 2
    assert np.allclose(tau[3], -2 * (0.17 * 2 * np.pi / n) ** 2 * 2 * np.abs(s12) * s12, atol=1e-12)


def test_spectral_conv_identity_on_low_modes():
    n, m = 8, 4
    x = d.abc(n)
    w = np.zeros((4, 3, 3, m, m, m))
    for c in range(3):
        w[:, c, c] = 1
    assert np.allclose(d.spectral_conv(x, w, m), x, atol=1e-12)
    assert d.branch_trunk(np.ones((2, 5)), np.ones((7, 5))).shape == (2, 7)
    assert np.allclose(d.slice_pool(np.ones((6, 2)), np.zeros((6, 3)), 1.0), 1, atol=1e-4)


@pytest.mark.parametrize("model", sorted(d.MODELS))
def test_models_run_on_packed_frames(spark, model):
    u = d.taylor_green(4).ravel().tolist()
    out = d.predict(spark.createDataFrame([(0, u)], "frame long, values array<double>"), model, 4).first()
    assert out["frame"] == 0 and len(out["values"]) % 64 == 0


def test_a_wrong_pressure_has_residuals():
    box = d.Box(16)
    u = d.random_solenoidal(16, 7, peak=2.0)
    p = box.pressure_modes(u)
    assert max(d.pressure_residuals(box, u, p)) < 1e-8
    assert min(d.pressure_residuals(box, u, 1.01 * p)) > 1e-3
    assert min(d.pressure_residuals(box, u[::-1], p)) > 1e-3

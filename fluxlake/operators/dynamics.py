"""Time stepping of periodic fields: closed-form initial states, a pseudo-spectral solver by trajectory, forcing, and reference models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import q
from ..registry import query


@dataclass(frozen=True)
class Box:
    """Wavenumbers of an n^3 box; arrays run over (z, y, x), the half axis is x."""

    n: int

    def __post_init__(self):
        k, h = np.fft.fftfreq(self.n, 1 / self.n), np.fft.rfftfreq(self.n, 1 / self.n)
        kz, ky, kx = np.meshgrid(k, k, h, indexing="ij")
        put = lambda name, v: object.__setattr__(self, name, v)
        put("k", np.stack([kx, ky, kz]))
        put("k2", kx**2 + ky**2 + kz**2)
        put("inverse", np.where(self.k2 > 0, 1 / np.maximum(self.k2, 1), 0))
        put("keep", (np.abs(self.k) <= self.n / 3).all(0))
        put("weight", np.where((kx == 0) | (kx == self.n / 2), 1.0, 2.0))

    def forward(self, u):
        return np.fft.rfftn(u, axes=(-3, -2, -1))

    def back(self, h):
        return np.fft.irfftn(h, s=(self.n,) * 3, axes=(-3, -2, -1))

    def curl(self, h):
        return 1j * np.cross(self.k, h, axis=0)

    def solenoidal(self, h):
        return h - self.k * ((self.k * h).sum(0) * self.inverse)

    def energy(self, h) -> float:
        return float((self.weight * (np.abs(h) ** 2).sum(0)).sum() / 2 / self.n**6)

    def dissipation(self, h, nu: float) -> float:
        return float(2 * nu * (self.weight * self.k2 * (np.abs(h) ** 2).sum(0)).sum() / 2 / self.n**6)

    def shells(self, h) -> np.ndarray:
        e = self.weight * (np.abs(h) ** 2).sum(0) / 2 / self.n**6
        return np.bincount(np.floor(np.sqrt(self.k2) + 0.5).astype(int).ravel(), e.ravel())[: self.n // 2 + 1]

    def stresses(self, u) -> dict[tuple[int, int], np.ndarray]:
        """Modes of the products u_i u_j, i <= j."""
        return {(i, j): self.forward(u[i] * u[j]) for i in range(3) for j in range(i, 3)}

    def pressure_modes(self, u):
        """Of a velocity field: Poisson's equation in modes, zero mean."""
        p = np.zeros_like(self.k2, complex)
        for (i, j), t in self.stresses(u).items():
            p -= (1 if i == j else 2) * self.k[i] * self.k[j] * t
        return p * self.inverse

    def pressure(self, u):
        return self.back(self.pressure_modes(u))

    def smagorinsky(self, u, cs: float = 0.17):
        """-2 (Cs dx)^2 |S| S_ij, six components 11, 22, 33, 12, 13, 23."""
        h = self.forward(u)
        g = [[self.back(1j * self.k[j] * h[i]) for j in range(3)] for i in range(3)]
        s = {(i, j): (g[i][j] + g[j][i]) / 2 for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))}
        size = np.sqrt(2 * sum(v * v * (1 if i == j else 2) for (i, j), v in s.items()))
        return np.stack([-2 * (cs * 2 * np.pi / self.n) ** 2 * size * v for v in s.values()])


def taylor_green(n: int):
    z, y, x = np.meshgrid(*[np.arange(n) * 2 * np.pi / n] * 3, indexing="ij")
    return np.stack([np.sin(x) * np.cos(y) * np.cos(z), -np.cos(x) * np.sin(y) * np.cos(z), np.zeros_like(x)])


def abc(n: int, a: float = 1.0, b: float = 1.0, c: float = 1.0):
    z, y, x = np.meshgrid(*[np.arange(n) * 2 * np.pi / n] * 3, indexing="ij")
    return np.stack([a * np.sin(z) + c * np.cos(y), b * np.sin(x) + a * np.cos(z), c * np.sin(y) + b * np.cos(x)])


def random_solenoidal(n: int, seed: int, peak: float = 4.0, energy: float = 0.5):
    """Random phases under k^4 exp(-2 (k/peak)^2), divergence-free, with the given energy."""
    box = Box(n)
    h = box.solenoidal(box.forward(np.random.default_rng(seed).standard_normal((3, n, n, n))))
    k = np.sqrt(box.k2)
    shell = np.floor(k + 0.5).astype(int)
    have = np.maximum(np.bincount(shell.ravel(), (box.weight * (np.abs(h) ** 2).sum(0)).ravel()), 1e-300)
    want = np.arange(len(have)) ** 4.0 * np.exp(-2 * (np.arange(len(have)) / peak) ** 2)
    want[n // 3 + 1 :] = 0
    h *= np.sqrt(want / have)[shell] * (k > 0)
    return box.back(h * np.sqrt(energy / box.energy(h)))


def rotating(omega: float) -> Callable:
    """Coriolis acceleration -2 Omega x u about z, in modes."""
    return lambda box, h: np.stack([2 * omega * h[1], -2 * omega * h[0], np.zeros_like(h[0])])


def damping(rate: float, cut: float) -> Callable:
    """Linear forcing of the large scales (negative rates damp)."""
    return lambda box, h: rate * h * (box.k2 <= cut * cut)


def fixed_power(power: float, cut: float) -> Callable:
    """Forcing along the large scales that puts in the given power exactly."""

    def force(box: Box, h):
        low = h * (box.k2 <= cut * cut) * (box.k2 > 0)
        return low * (power / max(2 * box.energy(low), 1e-30))

    return force


def rate_of_change(box: Box, h, forces: tuple[Callable, ...] = ()):
    """Projected, dealiased advection in rotation form, and forces; without viscosity."""
    n = np.cross(box.back(h), box.back(box.curl(h)), axis=0)
    r = box.forward(n) * box.keep
    for f in forces:
        r = r + f(box, h)
    return box.solenoidal(r)


#: The low-storage third-order scheme's coefficients.
RK3_A, RK3_B, RK3_D = (0.0, -5 / 9, -153 / 128), (1 / 3, 15 / 16, 8 / 15), (1 / 3, 5 / 12, 1 / 4)


def rk3(box: Box, h, dt: float, nu: float, forces: tuple[Callable, ...] = ()):
    """One step with an exact viscous factor."""
    register = np.zeros_like(h)
    for a, b, d in zip(RK3_A, RK3_B, RK3_D, strict=True):
        decay = np.exp(-nu * box.k2 * d * dt)
        register = a * register + dt * rate_of_change(box, h, forces)
        h, register = (h + b * register) * decay, register * decay
    return h


def rk4(box: Box, h, dt: float, nu: float, forces: tuple[Callable, ...] = ()):
    """One step of the classical scheme, viscosity included."""
    f = lambda g: rate_of_change(box, g, forces) - nu * box.k2 * g
    a = f(h)
    b = f(h + dt / 2 * a)
    c = f(h + dt / 2 * b)
    return h + dt / 6 * (a + 2 * b + 2 * c + f(h + dt * c))


def ornstein_uhlenbeck(state, dt: float, tau: float, sigma2: float, noise):
    """Exact update of the forcing process."""
    d = np.exp(-dt / tau)
    return d * state + np.sqrt(sigma2 * (1 - d * d)) * noise


def trajectories(configs: DataFrame) -> DataFrame:
    """Runs each configuration (seed, n, nu, dt, steps, start, omega) in one task: a row of diagnostics a step. Runs are independent, so they spread over the cluster."""
    starts = {"taylor_green": lambda n, s: taylor_green(n), "abc": lambda n, s: abc(n), "random": random_solenoidal}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b.itertuples(index=False):
                box = Box(int(c.n))
                h = box.forward(starts[c.start](int(c.n), int(c.seed)))
                forces = (rotating(c.omega),) if c.omega else ()
                rows = []
                for s in range(int(c.steps) + 1):
                    div = np.abs((box.k * h).sum(0)).max() / box.n**3
                    rows.append((int(c.seed), s, s * c.dt, box.energy(h), box.dissipation(h, c.nu), float(np.abs(box.back(h)).max()), float(div)))
                    h = rk3(box, h, c.dt, c.nu, forces)
                yield pd.DataFrame(rows, columns=["seed", "step", "t", "K", "eps", "umax", "div"])

    return configs.select("seed", "n", "nu", "dt", "steps", "start", "omega").mapInPandas(run, "seed long, step long, t double, K double, eps double, umax double, div double")


def pressure_residuals(box: Box, u, p) -> tuple[float, float]:
    """D4 of a velocity and its pressure's modes: the Poisson residual against -d_i d_j (u_i u_j), and the pressure's gradient against the irrotational part of the advection, both largest over largest."""
    source, advection = np.zeros_like(p), np.zeros((3, *p.shape), complex)
    for (i, j), t in box.stresses(u).items():
        source += (1 if i == j else 2) * box.k[i] * box.k[j] * t
        advection[i] += 1j * box.k[j] * t
        if i != j:
            advection[j] += 1j * box.k[i] * t
    gradient = 1j * box.k * p
    irrotational = -box.k * ((box.k * advection).sum(0) * box.inverse)
    ratio = lambda d, of: float(np.abs(d).max() / max(np.abs(of).max(), 1e-300))
    return ratio(-box.k2 * p - source, source), ratio(irrotational - gradient, gradient)


def residuals(box: Box, h, dt: float, nu: float, forces: tuple[Callable, ...] = ()) -> dict[str, float]:
    """Consistency of a state: divergence (D1), the momentum residual of a central difference over dt against the right side (D2), and the pressure's two residuals (D4)."""
    norm = lambda g: float(np.sqrt((box.weight * (np.abs(g) ** 2).sum(0)).sum()))
    mid = rk3(box, h, dt, nu, forces)
    after = rk3(box, mid, dt, nu, forces)
    right = rate_of_change(box, mid, forces) - nu * box.k2 * mid
    u = box.back(mid)
    poisson, gradient = pressure_residuals(box, u, box.pressure_modes(u))
    return {"d1": float(np.abs((box.k * mid).sum(0)).max() / box.n**3), "d2": norm((after - h) / (2 * dt) - right) / max(norm(right), 1e-30), "d4": poisson, "d4_gradient": gradient}


def spectral_conv(x, weights, modes: int):
    """A Fourier layer: the low modes of the four corner blocks are mixed over channels. x: (channels, z, y, x); weights: (4, out, in, modes, modes, modes)."""
    n = x.shape[-1]
    h = np.fft.rfftn(x, axes=(-3, -2, -1))
    m = min(modes, n // 2)
    out = np.zeros((weights.shape[1], *h.shape[1:]), complex)
    low, high = slice(0, m), slice(n - m, n)
    for i, (a, b) in enumerate(((low, low), (high, low), (low, high), (high, high))):
        block = (slice(None), a, b, slice(0, m))
        out[block] = np.einsum("oizyx,izyx->ozyx", weights[i, :, :, :m, :m, :m], h[block])
    return np.fft.irfftn(out, s=x.shape[-3:], axes=(-3, -2, -1))


def branch_trunk(branch, trunk):
    """Operator output at the trunk's points: inner products of branch and trunk features."""
    return np.einsum("bp,np->bn", branch, trunk)


def slice_pool(tokens, logits, temperature: float):
    """Tokens pooled into slices by softmax weights: weighted means."""
    z = logits / np.clip(temperature, 0.1, 5)
    w = np.exp(z - z.max(-1, keepdims=True))
    w /= w.sum(-1, keepdims=True)
    return np.einsum("ns,nc->sc", w, tokens) / (w.sum(0)[:, None] + 1e-5)


#: Reference models without weights, by name: of a frame (channels, n, n, n) the next one, or what its task asks for.
MODELS: dict[str, Callable] = {
    "persistence": lambda u: u,
    "identity": lambda u: u,
    "spectral_interp": lambda u: u,
    "smagorinsky": lambda u: Box(u.shape[-1]).smagorinsky(u),
    "poisson": lambda u: Box(u.shape[-1]).pressure(u)[None],
    "ns_integrator": lambda u: Box(u.shape[-1]).back(rk4(Box(u.shape[-1]), Box(u.shape[-1]).forward(u), 0.01, 0.0022)),
}


def predict(frames: DataFrame, model: str, n: int) -> DataFrame:
    """frame and the model's output of packed frames (frame, values: 3 n^3 doubles), one Arrow batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"frame": b["frame"], "values": [np.asarray(MODELS[model](np.asarray(v, float).reshape(3, n, n, n))).ravel() for v in b["values"]]})

    return frames.select("frame", "values").mapInPandas(run, "frame long, values array<double>")


@query("ud_persistence", "SELECT vec_id // 3 AS frame, CAST(floor(sum(list_sum([x::DOUBLE for x in embedding])) * 1e4 + 0.5) AS BIGINT) AS s FROM embeddings WHERE vec_id < (SELECT count(*) // 3 * 3 FROM embeddings) GROUP BY ALL")
def ud_persistence(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    g = e.groupBy(F.floor(F.col("vec_id") / 3).cast("long").alias("frame")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"])).cast("array<double>").alias("values"))
    return predict(g.where(F.size("values") == 192), "persistence", 4).select("frame", q(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 1e4).alias("s"))


@query("ud_poisson")
def ud_poisson(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    g = e.groupBy(F.floor(F.col("vec_id") / 3).cast("long").alias("frame")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"])).cast("array<double>").alias("values"))
    return predict(g.where(F.size("values") == 192), "poisson", 4).select("frame", q(F.array_max("values")).alias("p_max"))

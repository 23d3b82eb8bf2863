"""Constraints on predicted fields: initial frame, projection, momentum, energy, and the residuals before and after.

A prediction is planes (sample, t, ch, z, values). The chain's links, in order, each of which can be
left out: the first frame of a sample is replaced by the true one; velocity is projected on
divergence-free fields (the Nyquist modes, whose sign is open, count as wavenumber 0); its mean is moved
to the target momentum; it is scaled to the target energy. Scaling keeps the divergence at zero and the
momentum's direction, not its size. Targets are aggregates of the true fields, one row a frame, which
are joined back; the last two links need one pass of sums of the projected field, as the energy after
the shift follows from them. Momentum and energy are integrals over a box of side 2 pi.

Defined cases: a frame without a true one keeps its first frame, momentum and energy, and
counts in no energy or momentum error; a field at rest is not scaled; a frame that
lacks planes gives no rows; the pressure channel is not touched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from . import separable as S

VOLUME = (2 * math.pi) ** 3


def _wave(axis: str, n: int):
    """Wavenumbers with the Nyquist modes at 0."""
    k = S.wavenumber(axis, n)
    return lambda i: F.when(F.abs(k(i)) * 2 == n, 0).otherwise(k(i))


def leray(modes: DataFrame, n: int) -> DataFrame:
    """u - k (k.u) / k^2 of three channels; where k is 0, u."""
    k = [_wave(a, n) for a in "xyz"]

    def part(name: str) -> Column:
        u = [F.col(name)[c] for c in range(3)]
        places = F.sequence(F.lit(0), F.size(u[0]) - 1)

        def share(i: Column) -> Column:
            dot, k2 = (sum((f(c) for c in (1, 2)), f(0)) for f in (lambda c: k[c](i) * F.get(u[c], i), lambda c: k[c](i) * k[c](i)))
            return F.when(k2 > 0, dot / F.nullif(k2, F.lit(0))).otherwise(0.0)

        gradient = F.transform(places, share)
        along = lambda c: F.transform(gradient, lambda g, i: g * k[c](i))
        return F.array(*(F.zip_with(u[c], along(c), lambda a, b: a - b) for c in range(3))).alias(name)

    return modes.select("frame", "ky", part("re"), part("im"))


def divergence(modes: DataFrame, n: int) -> DataFrame:
    """i k.u as the only channel."""
    k = [_wave(a, n) for a in "xyz"]

    def dot(name: str) -> Column:
        u = [F.col(name)[c] for c in range(3)]
        return F.transform(F.sequence(F.lit(0), F.size(u[0]) - 1), lambda i: sum((k[c](i) * F.get(u[c], i) for c in (1, 2)), k[0](i) * F.get(u[0], i)))

    # Names apart from the results': inside a lambda a name would mean the new column.
    named = modes.select("frame", "ky", F.col("re").alias("a"), F.col("im").alias("b"))
    return named.select("frame", "ky", F.array(F.transform(dot("b"), lambda v: -v)).alias("re"), F.array(dot("a")).alias("im"))


def budgets(packed: DataFrame, n: int) -> DataFrame:
    """(frame, energy, mx, my, mz) of packed planes (frame, z, values of three channels); a frame with all its planes only."""
    total = lambda c, f: F.sum(F.aggregate(F.transform(F.col("values")[c], f), F.lit(0.0), lambda a, x: a + x))
    squares = sum((total(c, lambda x: x * x) for c in (1, 2)), total(0, lambda x: x * x))
    g = packed.groupBy("frame").agg((0.5 * squares / n**3 * VOLUME).alias("energy"), *(((total(c, lambda x: x) / n**3) * VOLUME).alias(f"m{a}") for c, a in enumerate("xyz")), F.count("*").alias("planes"))
    return g.where(F.col("planes") == n).drop("planes")


def pack(planes: DataFrame) -> DataFrame:
    """(frame, z, values: the three velocity channels) of planes (frame, ch, z, values)."""
    got = F.sort_array(F.collect_list(F.struct("ch", "values")))
    return planes.where("ch < 3").groupBy("frame", "z").agg(got.alias("c")).where(F.size("c") == 3).select("frame", "z", F.col("c.values").alias("values"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("frame", "z", F.posexplode("values").alias("ch", "values"))


def initial(planes: DataFrame, truth: DataFrame, n: int, is_first: Column) -> DataFrame:
    """Planes whose first frames are the true ones, where there are any; a true frame that lacks planes is none."""
    t = truth.where("ch < 3").select("frame", "ch", "z", F.col("values").alias("true"))
    t = t.join(t.groupBy("frame").count().where(F.col("count") == 3 * n), "frame", "left_semi")
    return planes.join(t, ["frame", "ch", "z"], "left").select("frame", "ch", "z", F.when(is_first, F.coalesce("true", "values")).otherwise(F.col("values")).alias("values"))


def project(planes: DataFrame, truth: DataFrame, n: int, is_first: Column, links: tuple[str, ...] = ("initial", "divergence", "momentum", "energy")) -> DataFrame:
    """Packed planes (frame, z, values) of the prediction after the chain's links. Both have planes (frame, ch, z, values)."""
    if odd := set(links) - {"initial", "divergence", "momentum", "energy"}:
        raise ValueError(f"unknown links {sorted(odd)}")
    velocity = planes.where("ch < 3")
    if "initial" in links:
        velocity = initial(velocity, truth, n, is_first)
    packed = S.inverse(leray(S.forward(velocity, n, [0, 1, 2]), n), n, 3) if "divergence" in links else pack(velocity)
    if not {"momentum", "energy"} & set(links):
        return packed
    goal = budgets(pack(truth), n).select("frame", *(F.col(c).alias(f"goal_{c}") for c in ("energy", "mx", "my", "mz")))
    now = budgets(packed, n).join(goal, "frame", "left")
    shift = {a: F.coalesce((F.col(f"goal_m{a}") - F.col(f"m{a}")) / VOLUME, F.lit(0.0)) if "momentum" in links else F.lit(0.0) for a in "xyz"}
    # Of the mean square of u + d: that of u, 2 d mean(u) and d^2.
    moved = F.col("energy") + sum((shift[a] * F.col(f"m{a}") + 0.5 * shift[a] * shift[a] * VOLUME for a in "yz"), shift["x"] * F.col("mx") + 0.5 * shift["x"] * shift["x"] * VOLUME)
    scale = F.coalesce(F.sqrt(F.try_divide(F.col("goal_energy"), moved)), F.lit(1.0)) if "energy" in links else F.lit(1.0)
    fix = now.select("frame", F.array(*(shift[a] for a in "xyz")).alias("shift"), scale.alias("scale"))
    fixed = F.transform("values", lambda v, c: F.transform(v, lambda x: (x + F.get("shift", c)) * F.col("scale")))
    return packed.join(fix, "frame").select("frame", "z", fixed.alias("values"))


def residuals(packed: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """(frame, div_max, div_mean, energy_pct, mean_velocity): how far a packed prediction is from free of divergence and from its targets."""
    d = S.inverse(divergence(S.forward(unpack(packed), n, [0, 1, 2]), n), n, 1)
    size = F.transform(F.col("values")[0], lambda x: F.abs(x))
    of = d.groupBy("frame").agg(F.max(F.array_max(size)).alias("div_max"), (F.sum(F.aggregate(size, F.lit(0.0), lambda a, x: a + x)) / n**3).alias("div_mean"))
    goal = budgets(pack(truth), n).select("frame", *(F.col(c).alias(f"goal_{c}") for c in ("energy", "mx", "my", "mz")))
    now = budgets(packed, n).join(goal, "frame", "left")
    away = lambda c: F.abs(F.col(c) - F.col(f"goal_{c}"))
    errors = now.select("frame", (100 * away("energy") / (F.abs("goal_energy") + 1e-12)).alias("energy_pct"), ((away("mx") + away("my") + away("mz")) / 3 / VOLUME).alias("mean_velocity"))
    return of.join(errors, "frame")


def summed(per_frame: DataFrame) -> DataFrame:
    """Means over samples and times; the maximum is taken within frames before."""
    return per_frame.agg(*(F.avg(c).alias(c) for c in ("div_max", "div_mean", "energy_pct", "mean_velocity")))


# --- queries: a frame of `embeddings` predicts the next one; five frames are a sample


def _fields(spark, sf_dir):
    """In units of 1, as targets of energy are relative."""
    p = S.planes_of(spark, sf_dir, 4).where("ch < 3").withColumn("values", F.transform("values", lambda x: x / 1e6))
    return p, p.withColumn("frame", F.col("frame") - 1)


def _first() -> Column:
    return F.col("frame") % 5 == 0


def _sql(n: int = 4) -> str:
    field = S._sql_field(n, [0, 1, 2]).split(",\n  k AS")
    k = lambda c: f"(CASE WHEN abs({c}) = {n // 2} THEN 0 ELSE {c} END)"
    kx, ky, kz = k("kx"), k("ky"), k("kz")
    k2 = f"({kx} * {kx} + {ky} * {ky} + {kz} * {kz})"
    dot = lambda p: f"({kx} * {p}_u + {ky} * {p}_v + {kz} * {p}_w)"
    pm = "pm AS (SELECT frame, kz, ky, kx, w, " + ", ".join(f"{p}_{u} - CASE WHEN {k2} > 0 THEN {kk} * {dot(p)} / {k2} ELSE 0 END AS {p}_{u}" for u, kk in zip("uvw", (kx, ky, kz), strict=True) for p in ("re", "im")) + " FROM b)"
    grid, back = S._sql_back(n, "pm", ["u", "v", "w"], n**3)
    back = back.replace("CAST(floor(", "(").replace(" + 0.37) AS BIGINT)", ")")
    sums = lambda source: f"SELECT frame, 0.5 * avg(u * u + v * v + w * w) * {VOLUME!r} AS e, avg(u) AS mu, avg(v) AS mv, avg(w) AS mw FROM {source} GROUP BY frame"
    return f"""WITH {field[0].replace("f AS MATERIALIZED", "f0 AS MATERIALIZED").replace("every AS (", "every AS (", 1)},
  unit AS (SELECT frame, z, y, x, {", ".join(f"max(CASE WHEN ch = {c} THEN q END) / 1e6 AS {u}" for c, u in enumerate("uvw"))} FROM f0 GROUP BY ALL),
  truth AS (SELECT frame - 1 AS frame, z, y, x, u, v, w FROM unit),
  start AS (SELECT p.frame, p.z, p.y, p.x, {", ".join(f"CASE WHEN p.frame % 5 = 0 THEN coalesce(t.{u}, p.{u}) ELSE p.{u} END AS {u}" for u in "uvw")} FROM unit p LEFT JOIN truth t USING (frame, z, y, x)),
  f AS MATERIALIZED (SELECT frame, 0 AS ch, z, y, x, u AS q FROM start UNION ALL SELECT frame, 1, z, y, x, v FROM start UNION ALL SELECT frame, 2, z, y, x, w FROM start),
  k AS{field[1]},
  {S._UVW},
  {pm}, {grid}, r AS MATERIALIZED ({back}),
  g AS ({sums("truth")}), n AS ({sums("r")}),
  d AS (SELECT n.frame, {", ".join(f"coalesce(g.m{u} - n.m{u}, 0) AS d{u}" for u in "uvw")}, g.e AS goal, n.e, n.mu, n.mv, n.mw FROM n LEFT JOIN g USING (frame)),
  s AS (SELECT *, coalesce(sqrt(goal / (e + {VOLUME!r} * ({" + ".join(f"d{u} * m{u} + 0.5 * d{u} * d{u}" for u in "uvw")}))), 1) AS scale FROM d),
  done AS MATERIALIZED (SELECT frame, z, y, x, (u + du) * scale AS u, (v + dv) * scale AS v, (w + dw) * scale AS w FROM r JOIN s USING (frame))"""


@query("constraint_chain_n4", _sql() + "SELECT frame, z, y, x, " + ", ".join(f"CAST(floor({u} * 1e6 + 0.37) AS BIGINT) AS {u}" for u in "uvw") + " FROM done")
def constraint_chain_n4(spark, sf_dir):
    """Every frame after the four links."""
    p, t = _fields(spark, sf_dir)
    done = S.points(project(p, t, 4, _first()), 4, ["u", "v", "w"])
    return done.select("frame", "z", "y", "x", *(F.floor(F.col(c) * 1e6 + 0.37).cast("long").alias(c) for c in "uvw"))


def _sql_residuals() -> str:
    g2 = "SELECT '{0}' AS stage, {1}"

    def of(source: str, tag: str) -> str:
        """Residuals of a table of points, by modes of its own."""
        n = 4
        k = lambda c: f"(CASE WHEN abs({c}) = {n // 2} THEN 0 ELSE {c} END)"
        angle = f"2 * pi() * ((kz * z + ky * y + kx * x) % {n}) / {n}"
        modes = ", ".join(f"sum({u} * cos({angle})) AS re_{u}, -sum({u} * sin({angle})) AS im_{u}" for u in "uvw")
        dot = lambda p: f"({k('kx')} * {p}_u + {k('ky')} * {p}_v + {k('kz')} * {p}_w)"
        return f""", m{tag} AS MATERIALIZED (SELECT frame, kz, ky, kx, w AS weight, {modes} FROM (SELECT frame, z, y, x, u, v, w AS w_ FROM {source}) AS pts(frame, z, y, x, u, v, w_), k GROUP BY ALL)""".replace("sum(w *", "sum(w_ *") + f""",
  q{tag} AS (SELECT frame, z, y, x, sum(weight * (-{dot("im")} * cos({angle}) - {dot("re")} * sin({angle}))) / {n**3} AS dv FROM m{tag}, p GROUP BY frame, z, y, x),
  x{tag} AS (SELECT frame, max(abs(dv)) AS div_max, avg(abs(dv)) AS div_mean FROM q{tag} GROUP BY frame),
  y{tag} AS (SELECT frame, 0.5 * avg(u * u + v * v + w * w) * {VOLUME!r} AS e, avg(u) AS mu, avg(v) AS mv, avg(w) AS mw FROM {source} GROUP BY frame),
  z{tag} AS (SELECT frame, div_max, div_mean, 100 * abs(o.e - g.e) / (abs(g.e) + 1e-12) AS energy_pct, (abs(o.mu - g.mu) + abs(o.mv - g.mv) + abs(o.mw - g.mw)) / 3 AS mean_velocity FROM x{tag} JOIN y{tag} o USING (frame) LEFT JOIN g USING (frame))"""

    whole = ", ".join(f"CAST(floor(avg({c}) * 1e9 + 0.37) AS BIGINT) AS {c}" for c in ("div_max", "div_mean", "energy_pct", "mean_velocity"))
    return _sql() + of("unit", "a") + of("done", "b") + " " + g2.format("before", whole) + " FROM za UNION ALL " + g2.format("after", whole) + " FROM zb"


@query("constraint_residuals_n4", _sql_residuals())
def constraint_residuals_n4(spark, sf_dir):
    """The mean residuals before and after the chain."""
    p, t = _fields(spark, sf_dir)
    before, after = summed(residuals(pack(p), t, 4)), summed(residuals(project(p, t, 4, _first()), t, 4))
    both = before.select(F.lit("before").alias("stage"), "*").union(after.select(F.lit("after"), "*"))
    return both.select("stage", *(F.floor(F.col(c) * 1e9 + 0.37).cast("long").alias(c) for c in ("div_max", "div_mean", "energy_pct", "mean_velocity")))

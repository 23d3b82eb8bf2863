"""Acceptance of a run from measured rows: the D group, the trajectory's hard gate, errors of decaying fields, laminar runs, numbers of stratified flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixtures import FIELD4, field4, table, with_
from ..model import q
from ..registry import query
from .gates import resolution_class
from .metrics import persistence
from .timeseries import _ETA, k_max_eta

#: Bands of the D group.
D1_MAX, D2_MAX, D3_LOW, D3_HIGH, D4_MAX = 1e-6, 1e-2, 2.5, 6.0, 1e-8
D_ITEMS = ("D1", "D2", "D3", "D4")
#: Share of the first frame's energy under which an error counts no more, and the mean dissipation of a run that is not laminar.
ENERGY_FLOOR, LAMINAR = 0.05, 0.03


def d_group(samples: DataFrame, key: str) -> DataFrame:
    """(key, item, verdict) of a run's samples (d1, d2, ratio, d4_poisson, d4_gradient): the largest residuals within their bands, every step-halving ratio in its band (null: a sample without a probe), and both parts of D4. A run with a sample that lacks a residual, or without any probe, is MISSING there, which is no pass."""
    whole = lambda c: F.count(c) == F.count("*")
    verdict = lambda there, ok: F.when(~there, "MISSING").when(ok, "pass").otherwise("FAIL")
    items = {
        "D1": verdict(whole("d1"), F.max("d1") <= D1_MAX),
        "D2": verdict(whole("d2"), F.max("d2") <= D2_MAX),
        "D3": verdict(F.count("ratio") > 0, F.bool_and(F.col("ratio").between(D3_LOW, D3_HIGH))),
        "D4": verdict(whole("d4_poisson") & whole("d4_gradient"), (F.max("d4_poisson") <= D4_MAX) & (F.max("d4_gradient") <= D4_MAX)),
    }
    wide = samples.groupBy(key).agg(*(v.alias(k) for k, v in items.items()))
    return wide.select(key, F.inline(F.array(*(F.struct(F.lit(k).alias("item"), F.col(k).alias("verdict")) for k in items))))


def trajectory_gate(runs: DataFrame, d_verdicts: DataFrame, key: str) -> DataFrame:
    """(key, cls, accepted, why) of runs (k_max_eta, a14_aborted, a2, drift): resolved, not aborted, A2 passed, and all four D items there and passed. A run without D rows is refused; drift is recorded beside and never gates."""
    d = d_verdicts.groupBy(key).agg(*(F.coalesce(F.bool_and(F.when(F.col("item") == i, F.col("verdict") == "pass")), F.lit(False)).alias(i) for i in D_ITEMS))
    cls = resolution_class(F.col("k_max_eta"))
    faults = {"A1": cls == "FAIL", "A14": F.col("a14_aborted"), "A2": F.coalesce(F.col("a2") != "pass", F.lit(True)), **{i: ~F.coalesce(F.col(i), F.lit(False)) for i in D_ITEMS}}
    why = F.array_join(F.array_compact(F.array(*(F.when(f, i) for i, f in faults.items()))), ",")
    j = runs.join(d, key, "left").select(key, cls.alias("cls"), why.alias("why"), "drift")
    return j.select(key, "cls", (F.col("why") == "").alias("accepted"), "why", "drift")


def _samples(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c, i = q("value", 100), F.col("event_id")
    return e.select(
        F.col("user_id").alias("run"), (c * 2.05e-11).alias("d1"), (c % 1000 * 1.0015e-5).alias("d2"), F.when(F.col("event_type") == "click", 2.49 + i % 351 / 100).alias("ratio"),
        (c % 997 * 1.0045e-11).alias("d4_poisson"), F.when(i % 211 > 0, c % 499 * 1e-11).alias("d4_gradient"),
    )


_SAMPLES = """cents AS (SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c FROM events),
samples AS (SELECT user_id AS run, c * 2.05e-11::DOUBLE AS d1, c % 1000 * 1.0015e-5::DOUBLE AS d2, CASE WHEN event_type = 'click' THEN 2.49::DOUBLE + event_id % 351 / 100 END AS ratio,
  c % 997 * 1.0045e-11::DOUBLE AS d4_poisson, CASE WHEN event_id % 211 > 0 THEN c % 499 * 1e-11::DOUBLE END AS d4_gradient FROM cents),
wide AS (SELECT run, CASE WHEN max(d1) <= 1e-6 THEN 'pass' ELSE 'FAIL' END AS D1, CASE WHEN max(d2) <= 1e-2 THEN 'pass' ELSE 'FAIL' END AS D2,
  CASE WHEN count(ratio) = 0 THEN 'MISSING' WHEN count(*) FILTER (ratio < 2.5::DOUBLE OR ratio > 6.0::DOUBLE) = 0 THEN 'pass' ELSE 'FAIL' END AS D3,
  CASE WHEN count(*) FILTER (d4_poisson IS NULL OR d4_gradient IS NULL) > 0 THEN 'MISSING' WHEN greatest(max(d4_poisson), max(d4_gradient)) <= 1e-8 THEN 'pass' ELSE 'FAIL' END AS D4 FROM samples GROUP BY run)"""


@query("gate_d_verdicts", with_(_SAMPLES, rest="SELECT run, item, verdict FROM (UNPIVOT wide ON D1, D2, D3, D4 INTO NAME item VALUE verdict)"))
def gate_d_verdicts(spark, sf_dir):
    return d_group(_samples(spark, sf_dir), "run")


_RUNS = f"""runs AS (SELECT user_id AS run, avg({_ETA.replace('(eps / 1000)', '(value / 1000)')}) AS eta, bool_or(c < 50) AS aborted, CASE WHEN min(c) >= 100 THEN 'pass' ELSE 'unresolvable' END AS a2, CAST(max(c) - min(c) AS BIGINT) AS drift FROM cents WHERE user_id % 13 > 0 GROUP BY user_id)"""


@query("gate_trajectory_hard", with_(_SAMPLES, _RUNS, rest="""SELECT run, CASE WHEN eta >= 1.5 THEN 'I' WHEN eta >= 1.0 THEN 'II' ELSE 'FAIL' END AS cls, why = '' AS accepted, why, drift FROM (
  SELECT *, concat_ws(',', CASE WHEN eta < 1 THEN 'A1' END, CASE WHEN aborted THEN 'A14' END, CASE WHEN a2 <> 'pass' THEN 'A2' END, CASE WHEN coalesce(D1, '') <> 'pass' THEN 'D1' END, CASE WHEN coalesce(D2, '') <> 'pass' THEN 'D2' END,
    CASE WHEN coalesce(D3, '') <> 'pass' THEN 'D3' END, CASE WHEN coalesce(D4, '') <> 'pass' THEN 'D4' END) AS why FROM runs LEFT JOIN (SELECT * FROM wide WHERE run % 17 > 0) USING (run))"""))
def gate_trajectory_hard(spark, sf_dir):
    """Runs of the event table, of which some were never given a D group."""
    c = q("value", 100)
    e = table(spark, sf_dir, "events").where("user_id % 13 > 0")
    runs = e.groupBy(F.col("user_id").alias("run")).agg(
        F.avg(k_max_eta(F.col("value") / 1000)).alias("k_max_eta"), F.bool_or(c < 50).alias("a14_aborted"), F.when(F.min(c) >= 100, "pass").otherwise("unresolvable").alias("a2"), (F.max(c) - F.min(c)).alias("drift")
    )
    return trajectory_gate(runs, d_group(_samples(spark, sf_dir), "run").where("run % 17 > 0"), "run")


def decay_safe(errors: DataFrame, energy: Column, first: Column, floor: float = ENERGY_FLOOR) -> DataFrame:
    """The errors `e`, null where the energy has fallen under a share of the first frame's."""
    return errors.withColumn("e", F.when(energy >= floor * first, F.col("e")))


@query("m_decay_floor", with_(FIELD4, "d AS (SELECT frame, ch, z, y, x, frame // 8 AS run, q / (1 + frame % 8)::DOUBLE AS v FROM field4 WHERE ch < 3)",
       "f AS (SELECT t.frame, any_value(t.run) AS run, avg(t.v * t.v) / 2 AS ke, sqrt(sum((p.v - t.v) * (p.v - t.v))) / sqrt(sum(t.v * t.v)) AS e FROM d t JOIN d p ON p.frame + 1 = t.frame AND p.ch = t.ch AND p.z = t.z AND p.y = t.y AND p.x = t.x GROUP BY t.frame)",
       "k0 AS (SELECT run, avg(v * v) / 2 AS k0 FROM d WHERE frame % 8 = 0 GROUP BY run)",
       rest="SELECT frame, CASE WHEN ke >= 0.05 * k0 THEN CAST(floor(e * 1e6 + 0.5) AS BIGINT) END AS e_q FROM f JOIN k0 USING (run)"))
def m_decay_floor(spark, sf_dir):
    """Errors along runs of eight frames that decay as 1/t, null under a twentieth of the first one's mean square."""
    v = F.col("q") / (1 + F.col("frame") % 8).cast("double")
    d = field4(spark, sf_dir).where("ch < 3").select("frame", "ch", "z", "y", "x", v.alias("q"))
    t, run = F.col("truth"), F.floor(F.col("frame") / 8).alias("run")
    f = persistence(d).groupBy("frame").agg((F.avg(t * t) / 2).alias("ke"), (F.sqrt(F.sum((F.col("pred") - t) * (F.col("pred") - t))) / F.sqrt(F.sum(t * t))).alias("e")).select("*", run)
    k0 = d.where("frame % 8 = 0").groupBy(run).agg((F.avg(F.col("q") * F.col("q")) / 2).alias("k0"))
    return decay_safe(f.join(k0, "run"), F.col("ke"), F.col("k0")).select("frame", q("e").alias("e_q"))


@query("gate_laminar", "SELECT user_id AS run, avg(value) / 1650 >= 0.03::DOUBLE AS kept, avg(value) / 1650 > 0.03::DOUBLE AS kept_strictly FROM events GROUP BY user_id")
def gate_laminar(spark, sf_dir):
    """Runs whose mean dissipation shows turbulence: at least the bound, and, where that is asked, more."""
    eps = F.avg("value") / 1650
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg((eps >= LAMINAR).alias("kept"), (eps > LAMINAR).alias("kept_strictly"))


def froude(u: Column, length: Column, n: Column) -> Column:
    return F.when((n > 0) & (length > 0), u / (n * length)).otherwise(F.lit(float("inf")))


def buoyancy_reynolds(eps: Column, nu: Column, n: Column) -> Column:
    return F.when(n > 0, eps / (nu * n * n)).otherwise(F.lit(float("inf")))


def ozmidov(eps: Column, n: Column) -> Column:
    """Scale under which stratification is not felt."""
    return F.when(n > 0, F.sqrt(eps / (n * n * n))).otherwise(F.lit(float("inf")))


_STRAT = "SELECT s_suppkey, abs(s_acctbal) / 1000 AS a, (1 + s_suppkey % 5)::DOUBLE AS len, (s_suppkey % 4) / 2.0::DOUBLE AS n FROM supplier"


@query("stratified_numbers", f"SELECT s_suppkey, CASE WHEN n > 0 THEN CAST(floor(a / (n * len) * 1e6 + 0.5) AS BIGINT) END AS froude_q, CASE WHEN n > 0 THEN CAST(floor(a / (0.0022::DOUBLE * n * n) * 1000 + 0.5) AS BIGINT) END AS re_b_q, CASE WHEN n > 0 THEN CAST(floor(sqrt(a / (n * n * n)) * 1e6 + 0.5) AS BIGINT) END AS ozmidov_q FROM ({_STRAT})")
def stratified_numbers(spark, sf_dir):
    """Froude, buoyancy Reynolds and Ozmidov numbers; without stratification they are infinite, here null."""
    a, n = F.abs("s_acctbal") / 1000, (F.col("s_suppkey") % 4) / 2.0
    finite = lambda c, s: F.when(c < float("inf"), q(c, s))
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", finite(froude(a, (1 + F.col("s_suppkey") % 5).cast("double"), n), 1e6).alias("froude_q"), finite(buoyancy_reynolds(a, F.lit(0.0022), n), 1000).alias("re_b_q"), finite(ozmidov(a, n), 1e6).alias("ozmidov_q"))

"""Reviews: each check can fail, known answers, guards that refuse."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlake.operators import reviews as R
from test_separable import planes, random

NAN = float("nan")


def review(spark, levels, eps=None, start=None, **more):
    eps = eps or [1.0] * len(levels)
    df = spark.createDataFrame([("r", i, 5.0 + 0.1 * i, k, e) for i, (k, e) in enumerate(zip(levels, eps, strict=True))], "run string, ord int, t double, K double, eps double")
    return R.decay_check(df.repartition(3), "run", start, **more).first()["why"]


def test_decay_check(spark):
    falls = [10.0 - 0.1 * i for i in range(20)]
    assert review(spark, falls, start=5.02) is None
    assert review(spark, falls, start=5.1) == "start"
    assert review(spark, falls[::-1]) == "no decay, rises"
    assert review(spark, [*falls[:5], NAN, *falls[5:]]) == "K not finite"
    assert review(spark, [*falls[:5], None, *falls[5:]]) == "K not finite"
    assert review(spark, falls, [1.0] * 19 + [50.1]) == "blow-up" and review(spark, falls, [1.0] * 19 + [50.0]) is None
    assert review(spark, falls, [NAN] + [1.0] * 19) == "blow-up"
    saw = [20.0] + [10.0 + 0.01 * i for i in range(19)]
    assert review(spark, saw) == "rises" and review(spark, saw[:10]) is None  # too short to tell


def test_slope_differences(spark):
    k = list(range(1, 61))
    own = spark.createDataFrame([("a", i, i**-2.0, 0.005) for i in k] + [("b", i, i**-1.5, 0.005) for i in k] + [("few", i, 1.0 / i, 0.12) for i in k[:2]], "run string, k int, E double, eta double").repartition(3)
    ref = spark.createDataFrame([(i, i ** (-5 / 3), 0.004) for i in k], "k int, E double, eta double")
    got = {(r["run"], r["window"]): r for r in R.slope_differences(own, ref, "run").collect()}
    for w in range(4):
        assert got["a", w]["slope"] == pytest.approx(-2) and got["a", w]["reference"] == pytest.approx(-5 / 3) and got["b", w]["difference"] == pytest.approx(1 / 6)
    assert got["a", 0]["lo"] == pytest.approx(0.01) and got["a", 0]["hi"] == pytest.approx(0.24)  # twice the later peak; the reference ends first
    assert got["few", 0]["slope"] is None and got["few", 0]["difference"] is None


def test_shells_hold_the_energy_and_gains_give_the_target(spark):
    n = 8
    x = random(n)
    m = R.modes_of(planes(spark, x), n)
    e = R.shells(m, n)
    got = {(r["frame"], r["shell"]): r["E"] for r in e.collect()}
    k = np.fft.fftfreq(n, 1 / n)
    size = np.round(np.sqrt(sum(v**2 for v in np.meshgrid(k, k, k, indexing="ij")))).astype(int)
    for f in (0, 1):
        energy = sum(0.5 * np.abs(np.fft.fftn(x[f, c]) / n**3) ** 2 for c in range(3))
        assert {s: pytest.approx(energy[size == s].sum()) for s in range(n // 2 + 1)} == {s: v for (g, s), v in got.items() if g == f}
    goal = spark.createDataFrame([(s, 1.0 / s) for s in range(1, 5)], "shell int, E double")
    after = {(r["frame"], r["shell"]): r["E"] for r in R.shells(R.shaped(m, e, goal), n).collect()}
    assert all(v == pytest.approx(1.0 / s if s else 0.0) for (_, s), v in after.items())  # no target for the mean


def test_times_and_windows(spark):
    files = spark.createDataFrame([("a", "x/snap_t12.5.npy"), ("a", "x/ckpt_t3.pt"), ("a", "x/final.npy"), ("a", "x_t1/y.npy"), ("b", "snap_t7.npy"), ("a", "snap_tx.npy")], "case string, file string")
    t = R.snap_times(files)
    assert [r["t"] for r in t.collect()] == [12.5, 3.0, None, None, 7.0, None]
    w = spark.createDataFrame([("a", 3.0, 12.5), ("b", 7.5, 9.0)], "case string, lo double, hi double")
    assert sorted(r["t"] for r in R.within(t, w).collect()) == [3.0, 12.5]


def test_scores_are_not_lost_unseen(spark):
    old = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.6), ("n", 1, None)], "model string, task int, score double")
    new = spark.createDataFrame([("m", 1, 0.7), ("m", 2, None)], "model string, task int, score double")
    with pytest.raises(ValueError, match=r"1 scores would be lost.*\('m', 2\)"):
        R.refuse_lost_scores(old, new, ["model", "task"])
    assert R.refuse_lost_scores(old, new, ["model", "task"], allowed=1) is new
    assert R.refuse_lost_scores(old, old, ["model", "task"]) is old
    assert math.isclose(R.guard_scores(old, new.limit(0), ["model", "task"]).count(), 2)


def test_planes_that_lack_rows(spark):
    p = planes(spark, random(4)).where(~((F.col("frame") == 0) & (F.col("ch") == 1) & (F.col("z") == 1)))
    assert {r["frame"] for r in R.shells(R.modes_of(p, 4), 4).collect()} == {1}
    assert R.shells(R.modes_of(p.limit(0), 4), 4).count() == 0

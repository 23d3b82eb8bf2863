"""Frozen normalisers: every refusal, replacement, readers meanwhile."""

import pytest
from pyspark.sql import functions as F

from fluxlake.sources import sidecars as S
from fluxlake.sources.stores import shared_path

FRAMES = [(s, float(10 * s + i), float(i), 1.0, -1.0) for s in range(4) for i in range(5)]
GROUPS = {"velocity": ["u", "v", "w"], "pressure": ["p"]}
SLICE = [("a", 0, "train", False), ("a", 1, "train", False), ("a", 2, "val", False), ("far", 3, None, True), ("lost", 4, None, False), ("lost", 5, "test", None)]


@pytest.fixture
def frames(spark):
    return spark.createDataFrame(FRAMES, "seed int, u double, v double, w double, p double")


@pytest.fixture
def slice_rows(spark):
    return spark.createDataFrame(SLICE, "case string, seed int, part string, held_out boolean")


def refused(rule):
    return pytest.raises(S.Refusal, match=rf"\({rule}\)")


def test_fit_scope(slice_rows):
    assert S.fit_seeds(slice_rows, "a") == [0, 1]
    assert S.fit_seeds(slice_rows, "far", "all") is None and S.fit_seeds(None, "x", "all") is None
    with refused("no slice"):
        S.fit_seeds(None, "a")
    with refused("unknown case"):
        S.fit_seeds(slice_rows, "b")
    with refused("held out"):
        S.fit_seeds(slice_rows, "far")
    with refused("no train split"):
        S.fit_seeds(slice_rows, "lost")
    with pytest.raises(ValueError, match="unknown filter"):
        S.fit_seeds(slice_rows, "a", "val")
    assert {r["case"]: r["rule"] for r in S.scopes(slice_rows).collect()} == {"a": None, "far": "held out", "lost": "no train split"}


def test_scoped_frames(frames):
    assert S.scoped(frames, [0, 1]).count() == 10 and S.scoped(frames, None).count() == 20
    with refused("missing seeds"):
        S.scoped(frames, [0, 9])
    with refused("no frames"):
        S.scoped(frames, [8, 9])
    with refused("no seeds"):
        S.scoped(frames.drop("seed"), [0])


def test_freeze_and_load(spark, frames):
    path = shared_path(spark, "norm")
    with refused("no sidecar"):
        S.load(spark, path, "a")
    assert S.freeze(frames, path, "a", GROUPS, [0, 1]) == 1
    got = {r["grp"]: r for r in S.load(spark, path, "a", "minmax", ["velocity", "pressure"]).collect()}
    u = [x for s, *uvw, _ in FRAMES if s < 2 for x in uvw]  # the seeds of the fit only
    assert got["velocity"]["n"] == len(u) and got["velocity"]["vmax"] == max(u) and got["velocity"]["mean"] == pytest.approx(sum(u) / len(u))
    assert got["velocity"]["seeds"] == [0, 1] and got["pressure"]["vmin"] == -1 and got["velocity"]["frozen_at"] is not None
    with refused("no channel"):
        S.load(spark, path, "a", "minmax", ["velocity", "theta"])
    with refused("no sidecar"):
        S.load(spark, path, "a", "standardize")
    with refused("no sidecar"):
        S.load(spark, path, "b")
    with pytest.raises(ValueError, match="unknown mode"):
        S.freeze(frames, path, "a", GROUPS, None, "log")


def test_replacement_keeps_the_old_one_and_never_leaves_a_gap(spark, frames, tmp_path):
    path = f"{tmp_path}/norm"
    S.freeze(frames, path, "a", GROUPS, [0])
    reader = S.load(spark, path, "a")  # planned before the swap
    assert S.freeze(frames, path, "a", GROUPS, [0, 1, 2]) == 2
    assert {r["n"] for r in reader.where("grp = 'velocity'").collect()} == {15}  # still the old one, whole
    assert {r["n"] for r in S.load(spark, path, "a").where("grp = 'velocity'").collect()} == {45}
    every = spark.read.schema(S.SIDECAR).parquet(path)
    assert {r["version"] for r in every.select("version").distinct().collect()} == {1, 2}
    # A freeze that is under way, or broke, has nothing but its writer's temporary files.
    half = tmp_path / "norm/case=a/mode=minmax/version=3/_temporary/0/_temporary/attempt"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"half")
    assert {r["version"] for r in S.load(spark, path, "a").collect()} == {2}
    with pytest.raises(Exception, match="(?i)already exists"):  # another freeze has taken the number
        S.freeze(frames, path, "a", GROUPS, None)


def test_a_broken_freeze_leaves_the_old_sidecar(spark, frames):
    path = shared_path(spark, "norm")
    S.freeze(frames, path, "a", GROUPS, [0])
    broken = frames.withColumn("u", F.when(F.col("seed") == 2, F.raise_error(F.lit("bad frame")).cast("double")).otherwise(F.col("u")))
    with pytest.raises(Exception, match="bad frame"):
        S.freeze(broken, path, "a", GROUPS, None)
    assert {r["version"] for r in S.load(spark, path, "a").collect()} == {1}


def test_channels():
    S.check_channels("pressure", 1, 1)
    with refused("channels"):
        S.check_channels("pressure", 3, 1)

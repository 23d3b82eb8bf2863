"""Frozen normalisers beside a store: which seeds they may be fitted on, how they are replaced, and readers that refuse to go without.

A sidecar is a few rows of Parquet under case, mode and version. Freezing anew writes the next
version; earlier ones stay as copies, with the time they were frozen. Spark's writer moves a
version's file into place when it is whole, and readers take the highest version there, so a
reader meanwhile sees the old or the new one, never neither and never half of one. Two freezes at once ask for the same version, and one fails.

What can go wrong raises `Refusal`, whose `rule` names it: a silent fallback would train on raw or leaked
numbers. Fit scope: `no slice`, `unknown case`, `held out`, `no train split`, `no seeds`, `missing seeds`, `no
frames`; reading: `no sidecar`, `no channel`; tasks: `channels`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import PER_SEED, SAMPLES4, per_seed, samples4, with_
from ..operators.statistics import GROUPS, fit
from ..registry import query
from .stores import shared_path

SIDECAR = "grp string, n long, vmin double, vmax double, mean double, std double, absmax double, seeds array<int>, frozen_at timestamp, case string, mode string, version int"
MODES = ("minmax", "standardize")


class Refusal(ValueError):
    def __init__(self, rule: str, why: str):
        super().__init__(f"REFUSE ({rule}): {why}")
        self.rule = rule


def scopes(slice_rows: DataFrame) -> DataFrame:
    """(case, rule, seeds) of slice rows (case, seed, part, held_out): the seeds a train-only fit may use, or the rule that forbids it."""
    g = slice_rows.groupBy("case").agg(F.array_sort(F.collect_set(F.when(F.col("part") == "train", F.col("seed").cast("int")))).alias("seeds"), F.coalesce(F.bool_or("held_out"), F.lit(False)).alias("held_out"))
    rule = F.when(F.size("seeds") > 0, F.lit(None)).when(F.col("held_out"), "held out").otherwise("no train split")
    return g.select("case", rule.cast("string").alias("rule"), "seeds")


def fit_seeds(slice_rows: DataFrame | None, case: str, seed_filter: str = "train") -> list[int] | None:
    """The seeds to fit on, None for all; refuses rather than guesses."""
    if seed_filter == "all":
        return None
    if seed_filter != "train":
        raise ValueError(f"unknown filter {seed_filter!r}")
    if slice_rows is None:
        raise Refusal("no slice", "a train-only fit needs the slice that says which seeds are train")
    row = scopes(slice_rows.where(F.col("case") == case)).first()  # one row
    if row is None:
        raise Refusal("unknown case", f"{case} is not in the slice")
    if row["rule"]:
        raise Refusal(row["rule"], f"{case} has no train seeds" + ("; nothing trains on it, so fit on all" if row["rule"] == "held out" else "; its manifest is not there, so nothing can be said"))
    return row["seeds"]


def scoped(frames: DataFrame, seeds: list[int] | None) -> DataFrame:
    """The frames that a fit may see; refuses if the store cannot show them."""
    if seeds is None:
        return frames
    if "seed" not in frames.columns:
        raise Refusal("no seeds", "the store has no seed of each frame, so a train-only fit cannot be verified")
    wanted = frames.where(F.col("seed").isin(seeds))
    there = {r["seed"] for r in wanted.select("seed").distinct().collect()}  # as many as asked for at most
    if there and (missing := sorted(set(seeds) - there)):
        raise Refusal("missing seeds", f"train seeds {missing} are not in the store")
    if not there:
        raise Refusal("no frames", f"no frames of seeds {seeds}")
    return wanted


def _versions(spark: SparkSession, path: str, case: str, mode: str) -> DataFrame | None:
    try:
        rows = spark.read.schema(SIDECAR).parquet(path)
    except AnalysisException:
        return None  # no such path
    return rows.where((F.col("case") == case) & (F.col("mode") == mode))


def freeze(frames: DataFrame, path: str, case: str, groups: dict[str, list[str]], seeds: list[int] | None, mode: str = "minmax", scale: float = 1.0) -> int:
    """Fits the normaliser on the frames of these seeds and writes it as the next version, whose number it returns."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    spark = frames.sparkSession
    stats = fit(scoped(frames, seeds), groups, scale)
    old = _versions(spark, path, case, mode)
    version = 1 + ((old.agg(F.max("version")).first()[0] or 0) if old is not None else 0)
    rows = stats.select("*", F.lit(seeds).cast("array<int>").alias("seeds"), F.current_timestamp().alias("frozen_at"))
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/case={case}/mode={mode}/version={version}")
    return version


def load(spark: SparkSession, path: str, case: str, mode: str = "minmax", groups: list[str] | None = None) -> DataFrame:
    """The newest version of a sidecar; refuses if there is none, or if it lacks a group of channels that is asked for."""
    every = _versions(spark, path, case, mode)
    last = every.agg(F.max("version")).first()[0] if every is not None else None
    if last is None:
        raise Refusal("no sidecar", f"{path} has no {mode} normaliser of {case}; freeze one, or ask for raw fields")
    rows = every.where(F.col("version") == last)
    if groups and (missing := sorted(set(groups) - {r["grp"] for r in rows.select("grp").collect()})):
        raise Refusal("no channel", f"the normaliser of {case} has no constants of {missing}")
    return rows


def check_channels(task: str, made: int, wanted: int) -> None:
    """A model whose channels are not the task's would be broadcast without a word."""
    if made != wanted:
        raise Refusal("channels", f"the model gives {made} channels, task {task} needs {wanted}")


# --- queries


@query("sidecar_norm", with_(SAMPLES4, "t AS (SELECT avg(x) AS mean, stddev_pop(x) AS std FROM (SELECT unnest([u, v, w]) / 1e6 AS x FROM samples4 WHERE seed IN (0, 1, 2)))", rest="SELECT seed, count(*) AS n, CAST(floor((avg(u / 1e6) - any_value(mean)) / any_value(std) * 1e6 + 0.37) AS BIGINT) AS mean_q FROM samples4, t GROUP BY seed"))
def sidecar_norm(spark, sf_dir):
    """Frozen on all seeds, then anew on the train seeds only: what is loaded is the newest, applied to every seed."""
    path, frames = shared_path(spark, "sidecars"), samples4(spark, sf_dir)
    freeze(frames, path, "c", GROUPS, None, "standardize", 1e6)
    freeze(frames, path, "c", GROUPS, [0, 1, 2], "standardize", 1e6)
    c = F.broadcast(load(spark, path, "c", "standardize", ["velocity"]).where("grp = 'velocity'").select("mean", "std"))  # one row
    g = frames.groupBy("seed").agg(F.count("*").alias("n"), F.avg(F.col("u") / 1e6).alias("u"))
    return g.crossJoin(c).select("seed", "n", F.floor((F.col("u") - F.col("mean")) / F.col("std") * 1e6 + 0.37).cast("long").alias("mean_q"))


_HELD, _UNKNOWN = "MACHINERY", "HOUSEHOLD"


@query("fit_scope_matrix", with_(PER_SEED, rest=f"""SELECT "case", CASE WHEN "case" = '{_HELD}' THEN 'held out' WHEN "case" = '{_UNKNOWN}' THEN 'no train split' END AS rule,
  array_to_string(list_sort(coalesce(list(DISTINCT CAST(seed AS INTEGER)) FILTER (seed % 4 <> 3 AND "case" NOT IN ('{_HELD}', '{_UNKNOWN}')), [])), ',') AS seeds FROM per_seed GROUP BY "case" """))
def fit_scope_matrix(spark, sf_dir):
    """Which case may be fitted on which seeds, and why some may not."""
    c = F.col("case")
    part = F.when(c.isin(_HELD, _UNKNOWN), None).when(F.col("seed") % 4 != 3, "train").otherwise("test")
    return scopes(per_seed(spark, sf_dir).select("case", "seed", part.alias("part"), (c == _HELD).alias("held_out"))).select("case", "rule", F.array_join("seeds", ",").alias("seeds"))

"""Sources and sinks: the frame store with its completion mark, time series, JSON documents, result rows of several roots, logs, markdown gates and binary frames."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import PER_SEED, RUN_TS, per_seed, result_rows, run_ts, with_, RESULT_ROWS
from ..model import q
from ..operators.leaderboard import GATES, KEY, gate_table
from ..registry import query


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder of the cluster. Where none is set, in a folder of our own, but on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("fluxlake.own.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fluxlake-")
        spark.conf.set("fluxlake.own.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def write_store(frames: DataFrame, path: str, channels: list[str], order: str = "ord") -> None:
    """Frames partitioned by case and seed, each file sorted by ordinal; the attributes, with the completion mark, last."""
    spark = frames.sparkSession
    # One case and seed may be large: it is dealt into as many files as it needs.
    frames.sortWithinPartitions("case", "seed", order).write.partitionBy("case", "seed").parquet(f"{path}/frames")
    spark.createDataFrame([(True, channels)], "complete boolean, channels array<string>").coalesce(1).write.parquet(f"{path}/attrs")


def read_store(spark: SparkSession, path: str, cases: list[str] | None = None, seeds: list[int] | None = None) -> DataFrame:
    """The frames of a complete store, pruned to cases and seeds; a store without its completion mark is refused."""
    try:
        complete = spark.read.parquet(f"{path}/attrs").where("complete").limit(1).count() == 1
    except Exception as e:
        raise ValueError(f"the store at {path} has no attributes") from e
    if not complete:
        raise ValueError(f"the store at {path} is not complete")
    frames = spark.read.parquet(f"{path}/frames")
    if cases is not None:
        frames = frames.where(F.col("case").isin(cases))
    return frames if seeds is None else frames.where(F.col("seed").isin(seeds))


@query("src_store_scan", with_(RUN_TS, rest="SELECT seed, count(*) AS n, CAST(sum(c) AS BIGINT) AS c FROM run_ts WHERE seed IN (1, 2, 3) GROUP BY seed"))
def src_store_scan(spark, sf_dir):
    path = shared_path(spark, "store")
    write_store(run_ts(spark, sf_dir).select(F.lit("events").alias("case"), "seed", "ord", "c"), path, ["u", "p"])
    return read_store(spark, path, ["events"], [1, 2, 3]).groupBy(F.col("seed").cast("long").alias("seed")).agg(F.count("*").alias("n"), F.sum("c").alias("c"))


@query("src_csv_series", with_(RUN_TS, rest="SELECT seed, ord, c FROM run_ts"))
def src_csv_series(spark, sf_dir):
    """Time series as CSV with a header, read back with its schema."""
    path = shared_path(spark, "series")
    run_ts(spark, sf_dir).select("seed", "ord", "c").write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="seed long, ord int, c long")


@query("src_json_manifest", with_(PER_SEED, rest='SELECT "case", seed, frames FROM per_seed'))
def src_json_manifest(spark, sf_dir):
    """Manifests as JSON; unreadable lines are set aside, not fatal."""
    path = shared_path(spark, "manifest")
    m = per_seed(spark, sf_dir).select(F.to_json(F.struct("case", "seed", "frames")).alias("value"))
    m.union(spark.createDataFrame([("{broken",)], "value string")).write.text(path)
    r = spark.read.json(path, schema="case string, seed long, frames long, _corrupt_record string", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return r.where("_corrupt_record is null").select("case", "seed", "frames")


@query("src_result_roots_all", with_(RESULT_ROWS, rest="""SELECT model, task, "case", CAST(floor(arg_max(nrmse, root) * 1e9 + 0.5) AS BIGINT) AS nrmse_q FROM result_rows GROUP BY ALL"""))
def src_result_roots_all(spark, sf_dir):
    """Rows of two roots, of which the later overrides."""
    return _result_roots(spark, result_rows(spark, sf_dir))


def _result_roots(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows written to a folder for each root and read back, later roots first."""
    roots = []
    for root in ("F", "O"):
        path = shared_path(spark, "rows")
        ident = F.concat_ws("__", *KEY)
        part = rows.where(F.col("root") == root).select(*KEY, F.col("nrmse").alias("nRMSE_mean"))
        bad = part.limit(1).withColumn("model", F.lit("mislabelled")).withColumn("dir", F.lit("other__name__here"))
        part.withColumn("dir", ident).unionByName(bad).repartition("dir").write.partitionBy("dir").json(path)
        roots.append(path)
    # Spark names a partition's folder dir=<value>; the identity is what follows.
    found = None
    for i, r in enumerate(roots):
        d = spark.read.json(r, schema="model string, task string, case string, nRMSE_mean double, dir string").where(F.col("dir") == F.concat_ws("__", *KEY)).withColumn("root", F.lit(i))
        found = d if found is None else found.union(d)
    return found.groupBy(*KEY).agg(F.max_by("nRMSE_mean", "root").alias("v")).select(*KEY, q("v", 1e9).alias("nrmse_q"))


@query("src_log_duration_all", "SELECT count(*) AS runs, CAST(sum(o_orderkey % 100) AS BIGINT) AS hours FROM orders WHERE o_orderkey % 100 > 0")
def src_log_duration_all(spark, sf_dir):
    """Every order."""
    return _log_duration(spark, spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _log_duration(spark: SparkSession, o: DataFrame) -> DataFrame:
    path = shared_path(spark, "logs")
    start = F.to_timestamp(F.lit("2024-01-01T00:00:00+00:00"))
    end = start + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 100).cast("int"))
    o.select(F.concat(F.lit("run started 2024-01-01T00:00:00+00:00 ended "), F.date_format(end, "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("value")).write.text(path)
    t = lambda i: F.to_timestamp(F.regexp_extract("value", r"started (\S+) ended (\S+)", i).try_cast("string"))
    h = spark.read.text(path).select(((t(2).cast("long") - t(1).cast("long")) / 3600).cast("long").alias("h")).where("h > 0 and h < 200")
    return h.agg(F.count("*").alias("runs"), F.sum("h").alias("hours"))


_G = "g AS (" + " UNION ALL ".join(f"""SELECT "case", seed, '{i}' AS item, CASE WHEN {c} IS NULL THEN 'MISSING' WHEN {rule} THEN 'pass' ELSE '**FAIL**' END AS verdict FROM per_seed""" for i, rule, c in GATES) + ")"


@query("src_markdown_gates", with_(PER_SEED, _G, rest="SELECT item, verdict, count(*) AS n FROM g GROUP BY ALL"))
def src_markdown_gates(spark, sf_dir):
    """A gate table rendered as markdown lines and parsed again."""
    path = shared_path(spark, "markdown")
    g = gate_table(per_seed(spark, sf_dir), GATES, ["case", "seed"])
    g.select(F.concat(F.lit("| "), "item", F.lit(" | "), F.coalesce(F.col("measured").cast("string"), F.lit("—")), F.lit(" | "), "verdict", F.lit(" |")).alias("value")).write.text(path)
    cell = lambda i: F.trim(F.get(F.split("value", r"\|"), F.lit(i)))
    return spark.read.text(path).where(F.startswith("value", F.lit("| "))).select(cell(1).alias("item"), cell(3).alias("verdict")).groupBy("item", "verdict").agg(F.count("*").alias("n"))


def decode_npy(files: DataFrame) -> DataFrame:
    """Arrays of .npy files read as binary: path, shape and values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "shape": [list(map(int, a.shape)) for a in arrays], "values": [a.astype(float).ravel() for a in arrays]})

    return files.select("path", "content").mapInPandas(run, "path string, shape array<int>, values array<double>")


@query("src_npy_frames_all", "SELECT vec_id, CAST(floor(list_sum([x::DOUBLE for x in embedding]) * 1e4 + 0.5) AS BIGINT) AS s FROM embeddings")
def src_npy_frames_all(spark, sf_dir):
    """Every frame."""
    return _npy_frames(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _npy_frames(vectors: DataFrame) -> DataFrame:
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b["embedding"]:
                f = io.BytesIO()
                np.save(f, np.asarray(v, np.float32).reshape(4, 4, 4))
                out.append(f.getvalue())
            yield pd.DataFrame({"path": b["vec_id"].astype(str), "content": out})

    e = vectors.select("vec_id", "embedding").mapInPandas(encode, "path string, content binary")
    return decode_npy(e).select(F.col("path").cast("long").alias("vec_id"), q(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 1e4).alias("s"))

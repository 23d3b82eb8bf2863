"""Edge cases of the library's operators on small literals."""

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from conftest import rows_of
from fluxlake import registry
from fluxlake.operators import leaderboard, metrics, splits, statistics, timeseries
from fluxlake.plans import relational
from fluxlake.sources import stores


def test_effective_time_of_known_curves(spark):
    curves = {"a": [0.05, 0.1, 0.2, 0.4, 0.6], "b": [0.01, 0.02, 0.03], "c": [0.5, 0.6]}
    df = spark.createDataFrame([(k, i, v) for k, vs in curves.items() for i, v in enumerate(vs)], "k string, i int, v double")
    got = {r["k"]: r["crossing"] for r in timeseries.first_crossing(df, "k", "i", "v", 0.3).collect()}
    assert got["a"] == pytest.approx(2.5) and got["b"] == 2.0 and got["c"] == 0.0


def test_nrmse_of_twice_the_truth(spark):
    df = spark.createDataFrame([(1, 2)] * 8, "truth long, pred long")
    assert df.agg(metrics.nrmse().alias("e")).first()["e"] == 1.0


def test_joint_normaliser(spark):
    df = spark.createDataFrame([(10, 1, -1, 5)], "u long, v long, w long, p long")
    s = {r["grp"]: r for r in statistics.fit(df, statistics.GROUPS, 1.0).collect()}
    assert s["velocity"]["absmax"] == 10 and s["velocity"]["n"] == 3 and s["pressure"]["std"] == 0


def test_signed_moments_are_pooled_before_the_absolute_value(spark):
    rows = [(0, 1, 1, 1)] * 4 + [(1, 1, -1, 1)] * 4
    df = spark.createDataFrame(rows, "seed long, u long, v long, w long")
    iso = statistics.isotropy(statistics.pool(statistics.moments(df, ["seed"], 1.0))).first()
    assert iso["uv"] == 0.0 and iso["comp"] == pytest.approx(0)


@pytest.mark.parametrize(("n", "want"), [(8, (6, 1, 1)), (10, (6, 1, 3)), (6, (6, 0, 0))])
def test_split_by_ic(spark, n, want):
    m = spark.createDataFrame([("c", i, 150) for i in range(n)], "case string, seed long, frames long")
    parts = [r["part"] for r in splits.split_by_ic(m).collect()]
    assert tuple(parts.count(p) for p in ("train", "val", "test")) == want


def test_equidistant_and_windows(spark):
    f = spark.createDataFrame([(0, i) for i in range(12)], "seed long, ord int")
    assert sorted(r["ord"] for r in splits.equidistant(f, 5).collect()) == [0, 2, 5, 8, 11]
    g = spark.createDataFrame([(0, i) for i in range(150)], "seed long, ord int")
    assert sorted(r["start"] for r in splits.windows(g, 21, 8).collect()) == list(range(0, 129, 8))


def test_zscore_of_unknown_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 3.0), ("c", 2.0), ("c", 2.0)], "case string, x double")
    got = sorted((r["case"], r["z"]) for r in df.select("case", splits.zscore("x", "case").alias("z")).collect())
    assert got == [("a", 0.0), ("a", 0.0), ("b", -1.0), ("b", 1.0), ("c", 0.0), ("c", 0.0)]


def test_islands(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate("xxoxxxoox")], "k string, i int, c string")
    runs = timeseries.islands(df, "k", "i", F.col("c") == "x").groupBy("island").count().collect()
    assert sorted(r["count"] for r in runs) == [1, 2, 3]


def test_missing_values_never_pass_a_gate(spark):
    df = spark.createDataFrame([(1, None)], "seed long, frames double")
    assert leaderboard.gate_table(df, [("A1", "frames >= 10", "frames")], ["seed"]).first()["verdict"] == "MISSING"


def test_skill_is_blank_without_a_baseline(spark):
    rows = spark.createDataFrame([("m", "t", "c", 0.5), ("m", "t", "d", 0.5), ("b", "t", "c", 0.0)], "model string, task string, case string, nrmse double")
    assert all(r["skill"] is None for r in leaderboard.skill(rows, "b").where("model = 'm'").collect())


def test_asof_takes_the_last_known_value(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 20), ("b", 3, 30)], "k string, t int, v int")
    got = sorted((r["k"], r["t"], r["v"]) for r in relational.asof_join(left, right, "k", "t", "v").collect())
    assert got == [("a", 1, None), ("a", 5, 20), ("b", 2, None)]


def test_partial_store_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    spark.createDataFrame([Row(case="c", seed=0, ord=0)]).write.partitionBy("case", "seed").parquet(f"{path}/frames")
    with pytest.raises(ValueError, match="no attributes"):
        stores.read_store(spark, path)


def test_cfl_step_snaps_down(spark):
    df = spark.createDataFrame([(1.0,)], "u double")
    dt = df.select(timeseries.cfl_step(F.col("u"), F.lit(1.0), 0.01, 0.5, 0.01).alias("dt")).first()["dt"]
    assert dt <= 0.005 and dt > 0.005 * 0.98


def test_registry_refuses_a_second_query_of_one_name():
    registry.query("only_here")(lambda s, d: None)
    with pytest.raises(ValueError):
        registry.query("only_here")(len)
    registry._QUERIES.pop("only_here")


def test_entry_imports_without_the_llm_folders(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/jobs", tmp_path / "jobs")
    shutil.copytree(f"{root}/fluxlake", tmp_path / "fluxlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 150"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


@pytest.mark.parametrize(
    ("name", "whole"),
    [
        ("upsample_linear_n4_all", "SELECT 512 * count(DISTINCT vec_id // 4) FROM embeddings"),
        ("src_npy_frames_all", "SELECT count(*) FROM embeddings"),
        ("src_log_duration_all", "SELECT count(*) FROM orders WHERE o_orderkey % 100 > 0"),
    ],
)
def test_whole_tables_of_spectral_and_sources(spark, sf_dir, duck, name, whole):
    out, want = registry.queries()[name](spark, sf_dir), duck.sql(whole).fetchall()[0][0]
    assert (out.first()["runs"] if "runs" in out.columns else out.count()) == want


@pytest.mark.parametrize(
    ("name", "whole"),
    [
        ("gen_unpivot_all", "SELECT 2 * count(*) FROM lineitem"),
        ("gen_join_full_all", "SELECT count(*) FROM (SELECT s_suppkey FROM supplier UNION SELECT c_custkey FROM customer)"),
        ("shuffle_drop_last_all", "SELECT sum(n // 64) FROM (SELECT count(*) AS n FROM events GROUP BY user_id % 10)"),
    ],
)
def test_whole_tables_of_plans_and_splits(spark, sf_dir, duck, name, whole):
    assert registry.queries()[name](spark, sf_dir).count() == duck.sql(whole).fetchall()[0][0]


def test_fading_sum_has_the_whole_series(spark):
    df = spark.createDataFrame([("a", i, 2**50 if i == 0 else 1) for i in range(46)] + [("b", 0, 7)], "k string, i int, x long")
    got = {r["k"]: r["b"] for r in timeseries.fading_sum(df, "k", "i", "x").collect()}
    assert got["b"] == 7 and got["a"] == pytest.approx(2**5 + 2 - 2**-44, rel=1e-12)


def test_without_dissipation_the_smallest_length_is_infinite(spark):
    df = spark.createDataFrame([(0, 0.0), (1, None), (2, timeseries.NU**3)], "i int, eps double")
    got = {r["i"]: r["e"] for r in df.select("i", timeseries.k_max_eta(F.col("eps")).alias("e")).collect()}
    assert got == {0: float("inf"), 1: None, 2: timeseries.KMAX}


def as_its_sql(spark, name, table, path, rows):
    """Runs a query and its oracle on a table made by SQL."""
    con = duckdb.connect()
    con.sql(f"COPY ({rows}) TO '{path}/{table}.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    got, want = registry.queries()[name](spark, str(path)).toArrow(), con.sql(registry.oracle_sql()[name]).to_arrow_table()
    assert rows_of(got, want.column_names) == rows_of(want, want.column_names)
    return got.to_pylist()


@pytest.mark.parametrize("name", ["decay_gates", "gate_a1_class", "gate_trajectory_hard", "ts_frame_gate"])
def test_gates_over_events_without_dissipation(spark, sf_dir, tmp_path, name):
    as_its_sql(spark, name, "events", tmp_path, f"SELECT * REPLACE (CASE WHEN event_id % 100 = 3 THEN 0 ELSE value END AS value) FROM '{sf_dir}/events.parquet'")


def test_the_magnitude_of_a_frame_that_lacks_a_component_is_unknown(spark, sf_dir, tmp_path):
    """Frame 0 lacks w, frame 1 has its pressure only."""
    got = as_its_sql(spark, "velocity_magnitude", "embeddings", tmp_path, f"SELECT * FROM '{sf_dir}/embeddings.parquet' WHERE vec_id NOT IN (2, 4, 5, 6)")
    assert {r["frame"] for r in got if r["mag"] is None} == {0, 1}


def test_a_true_frame_that_lacks_planes_starts_no_sample(spark, sf_dir, tmp_path):
    """Frame 1, the truth of the first frame of a sample, has no w."""
    as_its_sql(spark, "constraint_chain_n4", "embeddings", tmp_path, f"SELECT * FROM '{sf_dir}/embeddings.parquet' WHERE vec_id <> 6")


@pytest.mark.parametrize("name", ["dft_n4", "idft_roundtrip_n4", "pressure_poisson_n4", "poisson_residual_n4", "pressure_buoyant_n4", "pressure_rotating_n4", "m_frmse_bands", "curl_n4"])
def test_transforms_of_frames_that_lack_channels(spark, sf_dir, tmp_path, name):
    """Frame 0 lacks w, frame 1 has its fourth channel only, frame 2 lacks that."""
    as_its_sql(spark, name, "embeddings", tmp_path, f"SELECT * FROM '{sf_dir}/embeddings.parquet' WHERE vec_id NOT IN (2, 4, 5, 6, 11)")


@pytest.mark.parametrize(("name", "shuffles"), [("dft_n4", 0), ("idft_roundtrip_n4", 0), ("curl_n4", 1), ("pressure_poisson_n4", 1), ("pressure_buoyant_n4", 1), ("pressure_rotating_n4", 1)])
def test_modes_are_made_without_a_shuffle(spark, sf_dir, name, shuffles):
    """Packed fields meet by frame at most once; points and modes never travel one by one."""
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == shuffles and "Join" not in plan


def test_a_sketch_is_kept_for_each_flag_and_not_for_each_part(spark, sf_dir):
    plan = registry.queries()["gen_approx_distinct"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    sketches = [line for line in plan.splitlines() if "approx_count_distinct" in line]
    assert sketches and not any("l_partkey" in line.split("functions=")[0] for line in sketches)


def as_its_sql_row_by_row(spark, name, table, path, files):
    """Runs a query on a table of files made by SQL, and its oracle in one thread, which takes the rows in their order."""
    con = duckdb.connect(config={"threads": 1})
    (path / f"{table}.parquet").mkdir()
    for i, rows in enumerate(files):
        con.sql(f"COPY ({rows}) TO '{path}/{table}.parquet/part-{i}.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    got, want = registry.queries()[name](spark, str(path)).toArrow(), con.sql(registry.oracle_sql()[name]).to_arrow_table()
    assert rows_of(got, want.column_names) == rows_of(want, want.column_names)
    return got.to_pylist()


def test_a_mean_loss_on_the_edge_is_taken_in_the_order_of_the_table(spark, tmp_path):
    """Both suppliers' means are 917187.5 millionths exactly, but row by row the first falls short of it; from the sums of the two files neither does."""
    sizes = [2, 42, 35, 1, 25, 44, 14, 28, 47, 2, 34, 15, 49, 29, 32, 36]
    rows = [(1, s) for s in sizes] + [(2, s) for s in reversed(sizes)] + [("NULL", 30), ("NULL", 31), (3, "NULL"), (4, "NULL"), (4, 7)]
    files = ["SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, {s}::DOUBLE)" for k, s in part) + ") AS t(l_suppkey, l_quantity)" for part in (rows[:8] + rows[16:24] + rows[32:33], rows[8:16] + rows[24:32] + rows[33:])]
    got = {r["l_suppkey"]: r["loss_q"] for r in as_its_sql_row_by_row(spark, "loss_smooth_l1", "lineitem", tmp_path, files)}
    assert got == {1: 917187, 2: 917188, None: 152500, 3: None, 4: 1300000}


@pytest.mark.parametrize(("order", "want"), [(1, 77699), (-1, 77700)])
def test_a_mean_spectrum_on_the_edge_is_taken_in_the_order_of_the_seeds(spark, tmp_path, order, want):
    """The mean at k = 20 is 77699.5 thousandths exactly, but seed by seed, as the table first has them, one order falls short of it and the other does not."""
    cents = [49690, 4329, 19901, 54807, 212, 45523, 51053, 28366, 38150, 18767]
    seeds = list(range(10))[::order]
    rows = [(19 + 32 * i, s, (cents[s] - 1) / 100) for i, s in enumerate(seeds)]
    last = [(19 + 32 * (10 + i), s, 0.01) for i, s in enumerate(reversed(seeds))] + [(20, 3, 1.5), (21, 3, "NULL"), (21, 4, 2), (21, 5, "NULL"), (22, 6, "NULL")]
    files = ["SELECT * FROM (VALUES " + ", ".join(f"({e}::BIGINT, {u}::BIGINT, {v}::DOUBLE)" for e, u, v in part) + ") AS t(event_id, user_id, value)" for part in (rows[:5], rows[5:] + last)]
    got = {r["k"]: (r["mean_q"], r["std_q"]) for r in as_its_sql_row_by_row(spark, "spec_mean_std", "events", tmp_path, files)}
    assert got[20][0] == want and got[21][1] is None and got[22][1] is None and got[23] == (None, None)

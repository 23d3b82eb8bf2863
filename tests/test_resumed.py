"""Streams that stop and start: against a plain pass over all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fluxlake.streaming import resumed as R

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, value double"
START = dt.datetime(2024, 1, 1)


def made(n=160, runs=4, seed=2):
    rng = random.Random(seed)
    return [(i, START + dt.timedelta(minutes=30 * i + rng.randrange(30)), i % runs, rng.choice([10.0, 20.0, 30.0, 80.0])) for i in range(n)]


def plain(rows):
    out, spell = [], {}
    for t, i, u, v in sorted((r[1], r[0], r[2], r[3]) for r in rows):
        us = (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        if v >= 50:
            spell.pop(u, None)
            continue
        since, n = spell.get(u, (us, 0))
        spell[u] = (since, n + 1)
        if us - since > 14_400_000_000:
            out.append((u, since, us, n + 1))
    return sorted(out)


def deliver(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return R.alarms(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), "1 day")


def alarms(spark, out):
    return sorted(tuple(r) for r in spark.read.schema(R.ALARM).parquet(out).select("run", "since_us", "t_us", "low_count").collect())


def arrivals(rows, late):
    """Four files in order of arrival: some rows come `late` hours after their time."""
    rng = random.Random(5)
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rng.choice([0, late])))
    return [order[i * len(order) // 4 : (i + 1) * len(order) // 4] for i in range(4)]


def close(spark, path, rows):
    last = max(r[1] for r in rows) + dt.timedelta(days=9)
    R.closing(spark, last, spark.createDataFrame([], SCHEMA).schema).write.mode("append").parquet(path)


def test_late_rows_take_their_place_and_a_restart_changes_nothing(spark, tmp_path):
    rows = made()
    want = plain(rows)
    assert len(want) > 20
    path, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    before = spark.conf.get(R._PROVIDER)
    with R.keyed_state(spark):
        for k, part in enumerate(arrivals(rows, 12)):
            deliver(spark, path, part)
            if k in (1, 3):  # stopped after two files, taken up again
                R.run_to_end(stream(spark, path), check, R.batch_sink(out))
        early = alarms(spark, out)
        assert 0 < len(early) < len(want) and set(early) <= set(want)
        close(spark, path, rows)
        R.run_to_end(stream(spark, path), check, R.batch_sink(out))
    assert spark.conf.get(R._PROVIDER) == before
    assert alarms(spark, out) == want


def test_a_state_serves_a_block_of_runs(spark, tmp_path):
    rows = [(i, t, u * 3 - 70, v) for i, t, u, v in made(900, 75)]
    rows = [(i, t - dt.timedelta(minutes=30 * i) + dt.timedelta(hours=i // 75), u, v) for i, t, u, v in rows]
    want = plain(rows)
    assert len({r[0] for r in want}) > 30
    path, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    sizes = []
    with R.keyed_state(spark):
        for part in (rows[:450], rows[450:], None):
            close(spark, path, rows) if part is None else deliver(spark, path, part)
            s = stream(spark, path).writeStream.option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(R.batch_sink(out)).start()
            s.awaitTermination()
            sizes += [p["stateOperators"][0]["numRowsTotal"] for p in s.recentProgress if p["stateOperators"]]
    assert alarms(spark, out) == want
    assert 0 < max(sizes) <= 4 * len({u // 64 for _, _, u, _ in rows})  # not one for each row or run


def test_a_run_killed_between_batches_gives_the_rows_of_an_unbroken_one(spark, tmp_path):
    rows = made(120)
    path, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for part in arrivals(rows, 12):
        deliver(spark, path, part)
    close(spark, path, rows)

    def dies(number):
        if number == 2:
            raise RuntimeError("killed")

    with R.keyed_state(spark):
        with pytest.raises(Exception, match="killed"):  # written, but not yet known to be
            R.run_to_end(stream(spark, path), check, R.batch_sink(out, dies))
        R.run_to_end(stream(spark, path), check, R.batch_sink(out))
    assert alarms(spark, out) == plain(rows)


def test_upserts_survive_a_kill_at_any_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, START + dt.timedelta(minutes=rng.randrange(500)), rng.choice([1, 2, 3, None]), float(i)) for i in range(80)]
    want = {}
    for e, t, u, v in rows:
        if u not in want or (t, e) > want[u][:2]:
            want[u] = (t, e, v)
    path = f"{tmp_path}/in"
    for k in range(4):
        deliver(spark, path, rows[k * 20 : (k + 1) * 20])
    s = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    for at in (0, 2, 3):
        out, check = f"{tmp_path}/out{at}", f"{tmp_path}/check{at}"

        def dies(number, at=at):
            if number == at:
                raise RuntimeError("killed")

        with pytest.raises(Exception, match="killed"):
            R.run_to_end(s(), check, R.upsert(out, ["user_id"], ["ts", "event_id"], dies))
        R.run_to_end(s(), check, R.upsert(out, ["user_id"], ["ts", "event_id"]))
        got = {r["user_id"]: (r["ts"], r["event_id"], r["value"]) for r in R.current(spark, out, SCHEMA).collect()}
        assert got == want


def test_fingerprints_tell_changed_sources(spark, tmp_path):
    path = tmp_path / "in"
    deliver(spark, str(path), made(10))
    deliver(spark, str(path), made(12))
    before = spark.createDataFrame(R.fingerprints(spark, str(path)).collect())
    assert R.changed(before, R.fingerprints(spark, str(path))).count() == 0
    first, second = sorted(path.glob("*.parquet"))
    first.write_bytes(second.read_bytes())
    for crc in path.glob(".*.crc"):
        crc.unlink()
    assert [tuple(r) for r in R.changed(before, R.fingerprints(spark, str(path))).collect()] == [(first.name, "changed")]
    second.unlink()
    assert {r["what"] for r in R.changed(before, R.fingerprints(spark, str(path))).collect()} == {"changed", "gone"}
    assert R.fingerprints(spark, str(path)).where(F.length("md5") != 32).count() == 0


def test_a_delivery_has_as_many_files_as_its_input(spark, tmp_path):
    spark.createDataFrame(made(160), SCHEMA).repartition(3).write.option("maxRecordsPerFile", 20).parquet(f"{tmp_path}/events.parquet")
    path = f"{tmp_path}/arrivals"
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        seen = [spark.read.parquet(path).inputFiles() for _ in R._deliveries(spark, str(tmp_path), path, False)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(seen) == 4 and len(seen[-1]) > 4
    assert sorted(r["event_id"] for r in spark.read.parquet(path).collect()) == list(range(160))

"""State across micro-batches."""

import os

from fluxlake.streaming import monitors as m


def test_sentinel_keeps_its_state_across_files(spark, sf_dir, duck, tmp_path):
    """Four files in order of time, one a micro-batch, whose rows come in any order and in chunks of 50 rows."""
    from fluxlake import registry

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.count()
    os.makedirs(tmp_path / "events.parquet")
    ordered = e.orderBy("ts", "event_id").toPandas()
    for k in range(4):
        part = ordered.iloc[k * rows // 4 : (k + 1) * rows // 4].sample(frac=1, random_state=k)
        path = tmp_path / "events.parquet" / f"{k}.parquet"
        part.to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + 100 * k,) * 2)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        got = m.drain(m.alarms(m.event_stream(spark, f"file://{tmp_path}", files=1)), "append").toPandas()
    finally:
        spark.conf.set(key, before)
    want = duck.sql(registry.oracle_sql()["st_sentinel"]).df()
    columns = ["seed", "since_us", "t_us", "low_count"]
    assert len(want) and sorted(map(tuple, got[columns].to_numpy().tolist())) == sorted(map(tuple, want[columns].to_numpy().tolist()))

"""The two jobs: against SQL, by hand, run again, over growing input, after a failure, by command line."""

import datetime as dt
import hashlib
import os
import subprocess
import sys

import pytest

from jobs import release_slice, watch_runs
from jobs.common import config

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def command(job, *args):
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--config", f"{ROOT}/jobs/{job}.json", *args], cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": ROOT, "SPARK_MASTER": "local[2]"})
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stderr


# --- release_slice


def test_release_against_sql(same):
    same(release_slice.job1_release_slice, release_slice.ORACLE)


LONG = "some words of a text that is long enough to be released, with a number at its end: "
DOCS = [
    (1, LONG + "1", "en", "a"), (2, LONG.upper() + " \t1\n", "de", "b"), (3, LONG + "2", "en", "a"), (4, "short", "en", None), (5, None, None, None), (6, " \n", "en", "a"),
    (7, LONG + "3", None, "a"), (None, LONG + "3", "en", "b"), (8, LONG + "4", "fr", "a"), (9, LONG + "4 ", "fr", "a"), (10, LONG + "5", "fr", "a"), (10, LONG + "5", "fr", "a"), (None, LONG + "6", "", "x"),
]
LABELS = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (9, 1, 1), (8, None, None), (99, 0, 0), (7, None, 0)]
SETTINGS = release_slice.Config(least_chars=40)


@pytest.fixture
def release(spark, tmp_path):
    def write(docs, labels=LABELS):
        # columns that are not asked for, with names that the job uses
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as copies", "'x' as split", "2 as `group`", "3 as `row`", "4 as quality").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/docs")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels")
        return release_slice.run(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out", SETTINGS)

    write.out = f"{tmp_path}/out"
    return write


def by_hand(docs):
    fold = lambda t: " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split())
    groups = {}
    for r in docs:
        groups.setdefault(fold(r[1]), []).append(r)
    out = []
    for text, own in groups.items():
        head = min(own, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        said = [(q, t) for i, q, t in LABELS if i in {r[0] for r in own}]
        low = any(q is not None and q < 1 for q, _ in said)
        n = len(head[1] or "")
        reason = "empty" if not text else "short" if n < 40 else "quality" if low else "toxic" if any(t for _, t in said) else None
        group = hashlib.sha256(text.encode()).hexdigest()
        place = int(group[:7], 16) % 100
        split = "refused" if reason else "train" if place < 80 else "val" if place < 90 else "test"
        out.append((head[0], None if reason else head[1], head[3], n, len(own), reason, group, split, head[2] or None))
    return sorted(out, key=repr)


def test_release_by_hand(spark, release):
    report = release(DOCS)
    want = by_hand(DOCS)
    data = release_slice.read_release(spark, release.out)
    assert rows(data) == want
    assert report == {"groups": len(want), "rows": len(DOCS), "refused": sum(r[7] == "refused" for r in want)}
    assert [r[5] for r in want if r[0] == 3] == ["quality"] and [r[5] for r in want if r[0] == 8] == ["toxic"]
    train = [r for r in want if r[7] == "train"]
    norm = {r["lang"]: r for r in release_slice.read_release(spark, release.out, "norm").collect()}
    n = [r[3] for r in train]
    assert norm["*"]["n"] == len(n) and abs(norm["*"]["mean"] - sum(n) / len(n)) < 1e-9  # training rows only
    manifest = release_slice.read_release(spark, release.out, "manifest")
    assert manifest.selectExpr("sum(groups)", "sum(rows)", "sum(chars)").first()[:] == (len(want), len(DOCS), sum(r[3] for r in want))
    before = rows(release_slice.whole_output(spark, release.out))
    release(DOCS)
    assert rows(release_slice.whole_output(spark, release.out)) == before


def test_groups_stay_in_their_split_as_the_table_grows(spark, release):
    docs = [(i, f"{LONG}{i}", "en", "a") for i in range(300)]
    release(docs)
    of = lambda: {r["group"]: r["split"] for r in release_slice.read_release(spark, release.out).where("split <> 'refused'").collect()}
    before = of()
    assert set(before.values()) == {"train", "val", "test"}
    release([*docs, *[(1000 + i, f"{LONG}{i}", "de", "late copy") for i in range(0, 600, 2)]])
    after = of()
    assert len(after) > len(before) and all(after[g] == s for g, s in before.items())
    release([])
    assert release_slice.whole_output(spark, release.out).count() == 0


def test_a_broken_release_is_refused_and_mended(spark, release, monkeypatch):
    release(DOCS)
    with monkeypatch.context() as m:
        m.setattr(release_slice, "manifest_of", lambda data: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            release(DOCS[:3])
    with pytest.raises(ValueError, match="not complete"):
        release_slice.read_release(spark, release.out)
    release(DOCS)
    assert rows(release_slice.read_release(spark, release.out)) == by_hand(DOCS)


def test_settings_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="100 percent"):
        release_slice.Config(splits={"train": 50})
    (tmp_path / "odd.json").write_text('{"least_char": 3}')
    with pytest.raises(ValueError, match="least_char"):
        config(spark, release_slice.Config, str(tmp_path / "odd.json"))
    assert config(spark, release_slice.Config, f"{ROOT}/jobs/release_slice.json") == release_slice.Config()
    assert config(spark, watch_runs.Config, f"{ROOT}/jobs/watch_runs.json").window_days == watch_runs.Config().window_days


# --- watch_runs


def test_watch_against_sql(same):
    same(watch_runs.job2_watch_runs, watch_runs.ORACLE)


def deliver(spark, path, events):
    spark.createDataFrame(events, watch_runs.EVENTS).coalesce(1).write.mode("append").parquet(path)


def made(n, seed=0, days=12):
    """n rows over some runs and days."""
    start = dt.datetime(2024, 3, 1)
    return [(seed * 10_000 + i, start + dt.timedelta(minutes=(i * 7919 * (seed + 1)) % (days * 1440)), i % 5, ((i * 31) % 97) / 7 + (i % 5)) for i in range(n)]


def daily_by_hand(events):
    out = {}
    for e, t, u, v in events:
        if None in (t, u, v) or v != v:
            continue
        out.setdefault((u, t.date()), []).append((t, e, int((v * 100 + 0.5) // 1)))
    level = lambda x: {"ts": x[0], "event_id": x[1], "c": x[2]}
    return {k: (len(v), sum(x[2] for x in v), sum(x[2] ** 2 for x in v), min(x[2] for x in v), max(x[2] for x in v), level(min(v)), level(max(v))) for k, v in out.items()}


def daily_of(spark, out):
    got = spark.read.schema(watch_runs.DAILY).parquet(f"{out}/daily").collect()
    held = {(r["run"], r["day"]): (r["n"], int(r["s1"]), int(r["s2"]), r["lo"], r["hi"], r["first"].asDict(), r["last"].asDict()) for r in got}
    assert len(held) == len(got)
    return held


def test_growing_input_is_taken_once(spark, tmp_path):
    events, out, check = f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/check"
    first, second = made(400), made(60, 1, days=3)
    deliver(spark, events, first)
    watch = lambda: watch_runs.run(spark, events, out, check, watch_runs.Config(files_per_batch=1))
    assert watch() == {"batches": 1, "rows": 400, "rejected": 0}
    assert daily_of(spark, out) == daily_by_hand(first)
    files = lambda: {r[0] for r in spark.read.schema(watch_runs.DAILY).parquet(f"{out}/daily").where("day >= '2024-03-04'").selectExpr("_metadata.file_path").distinct().collect()}
    before = files()
    # Late rows of three days, rows that lack something, in two files.
    odd = [(1, None, 1, 1.0), (2, dt.datetime(2024, 3, 1), None, 1.0), (3, dt.datetime(2024, 3, 1), 1, None), (4, dt.datetime(2024, 3, 1), 1, float("nan")), (None, dt.datetime(2024, 3, 2), 1, 2.0)]
    deliver(spark, events, second)
    deliver(spark, events, odd)
    assert watch() == {"batches": 2, "rows": 65, "rejected": 4}  # only what is new
    want = daily_by_hand([*first, *second])
    got = daily_of(spark, out)
    assert {k: v for k, v in got.items() if k != (1, dt.date(2024, 3, 2))} == {k: v for k, v in want.items() if k != (1, dt.date(2024, 3, 2))}
    assert got[1, dt.date(2024, 3, 2)][0] == want[1, dt.date(2024, 3, 2)][0] + 1
    assert files() == before  # days without new rows are not written again
    whole = rows(watch_runs.whole_output(spark, out))
    assert watch() == {"batches": 0, "rows": 0, "rejected": 0}
    assert rows(watch_runs.whole_output(spark, out)) == whole
    one = f"{tmp_path}/one"
    watch_runs.run(spark, events, f"{one}/out", f"{one}/check")  # all at once
    assert rows(watch_runs.whole_output(spark, f"{one}/out")) == whole


@pytest.mark.parametrize("step", ["merged", "verdicts"])
def test_a_run_that_broke_is_taken_up(spark, tmp_path, monkeypatch, step):
    events, out, check = f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/check"
    deliver(spark, events, made(100))
    watch_runs.run(spark, events, out, check)
    deliver(spark, events, made(100, 1))
    with monkeypatch.context() as m:
        m.setattr(watch_runs, step, lambda *a: 1 / 0)  # after the partials of the batch, or after the stream
        with pytest.raises(Exception, match="division by zero"):
            watch_runs.run(spark, events, out, check)
    watch_runs.run(spark, events, out, check)
    assert daily_of(spark, out) == daily_by_hand([*made(100), *made(100, 1)])
    assert spark.read.parquet(f"{out}/batches").selectExpr("sum(rows)").first()[0] == 200
    assert spark.read.parquet(f"{out}/verdicts").selectExpr("sum(n)").first()[0] == 200


def test_verdicts(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    series = {1: [(i, 100) for i in range(10)], 2: [(i, 100) for i in range(3)], 3: [(i, 100) for i in range(12) if i != 5], 4: [(i, 100 + 20 * i) for i in range(10)], 5: [(i, 0) for i in range(9)]}
    d = spark.createDataFrame([(r, day(i), 2, 2 * v) for r, own in series.items() for i, v in own], "run long, day date, n long, s1 long")
    got = {r["run"]: (r["verdict"], r["drift"]) for r in watch_runs.verdicts(d, watch_runs.Config()).collect()}
    assert got == {1: ("steady", 0), 2: ("short", 0), 3: ("gap", 0), 4: ("drift", 736842), 5: ("steady", None)}


def test_an_empty_folder(spark, tmp_path):
    deliver(spark, f"{tmp_path}/events", [])
    assert watch_runs.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/check")["rows"] == 0
    assert watch_runs.whole_output(spark, f"{tmp_path}/out").count() == 0


def test_command_lines(spark, sf_dir, tmp_path):
    said = command("release_slice", "--documents", f"{sf_dir}/documents.parquet", "--labels", f"{sf_dir}/labels.parquet", "--output", f"{tmp_path}/release")
    assert "wrote" in said and release_slice.read_release(spark, f"{tmp_path}/release").count() > 0
    said = command("watch_runs", "--events", f"{sf_dir}/events.parquet*", "--output", f"{tmp_path}/watch", "--checkpoint", f"{tmp_path}/check")
    assert "1000 new rows" in said and watch_runs.whole_output(spark, f"{tmp_path}/watch").count() > 0

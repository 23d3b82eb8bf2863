"""The chunked store: boxes against numpy, and what the plan opens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlake.sources.chunks import ChunkStore, write_chunks
from fluxlake.sources.stores import shared_path

SCHEMA = "case string, seed int, ord int, ch int, z int, values array<double>"


@pytest.fixture(scope="module")
def fields():
    rng = np.random.default_rng(4)
    return {(case, seed, k, ch): rng.normal(size=(6, 6, 6)) for case in ("a", "b") for seed in (1, 2) for k in range(3) for ch in range(2)}


@pytest.fixture(scope="module")
def store(spark, fields):
    rows = [(*key, z, p.ravel().tolist()) for key, x in fields.items() for z, p in enumerate(x)]
    path = shared_path(spark, "chunks")
    write_chunks(spark.createDataFrame(rows, SCHEMA).repartition(3), path, 6, 2, ["u", "v"])
    return ChunkStore(spark, path)


def rolled(x, origin, size):
    return np.roll(x, [-o for o in origin], (0, 1, 2))[: size[0], : size[1], : size[2]]


@pytest.mark.parametrize(("origin", "size"), [((0, 0, 0), (6, 6, 6)), ((5, 5, 5), (2, 2, 2)), ((-3, 4, 1), (4, 5, 6)), ((2, 2, 2), (2, 2, 2)), ((1, 7, 11), (1, 3, 6))])
def test_boxes(store, fields, origin, size):
    got = store.box(origin, size, "a", [2]).collect()
    held = {}
    for r in got:
        held.setdefault((r["case"], r["seed"], r["ord"], r["ch"]), np.full(size, np.nan))[r["z"], r["y"], r["x"]] = r["value"]
    want = {k: rolled(x, origin, size) for k, x in fields.items() if k[:2] == ("a", 2)}
    assert held.keys() == want.keys() and all(np.array_equal(held[k], want[k]) for k in want)
    assert len(got) == len(want) * int(np.prod(size))


def scanned(df):
    """Files read by the scan, and its description."""
    df.collect()
    nodes, out = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        p = nodes.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            nodes.append(p.executedPlan())
        if p.nodeName().startswith("Scan parquet"):
            out.append((p.metrics().apply("numFiles").value(), p.simpleString(1000)))
        nodes += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_other_chunks_are_not_opened(store):
    every = len(store.rows().inputFiles())
    assert every >= 2 * 2 * 27
    [(files, said)] = scanned(store.box((5, 5, 5), (2, 2, 2), "a", [2], [1]))
    assert files == 8 * every // (2 * 2 * 27)  # the eight corner cubes of one case and seed
    assert "PartitionFilters" in said and "chunk" in said.split("PartitionFilters")[1]
    assert "EqualTo(ord,1)" in said.replace("In(ord, [1])", "EqualTo(ord,1)")  # row groups of other ordinals are passed over
    [(files, _)] = scanned(store.box((2, 2, 2), (2, 2, 2), "a", [2]))
    assert files == every // (2 * 2 * 27)  # exactly one cube
    read = {r[0].rsplit("/", 2)[-2] for r in store.box((2, 2, 2), (2, 2, 2)).select(F.input_file_name()).distinct().collect()}
    assert read == {"chunk=13"} and store.touched((2, 2, 2), (2, 2, 2)) == [13]


def test_one_frame(store, fields):
    got = store.frame("b", 1, 2)
    assert got.count() == 2 * 216 and got.select("ord", "seed").distinct().collect()[0][:] == (2, 1)


def test_patches(spark, store, fields):
    rng = np.random.default_rng(8)
    asked = [("a" if i % 3 else "b", 1 + i % 2, i % 4, *map(int, rng.integers(-9, 9, 3))) for i in range(20)]
    asked += [asked[1]]  # asked twice, given once; ordinal 3 is not there
    df = spark.createDataFrame(asked, "case string, seed int, ord int, oz int, oy int, ox int").withColumn("values", F.lit("clash"))
    got = {(r["case"], r["seed"], r["ord"], r["oz"], r["oy"], r["ox"], r["ch"]): np.array(r["values"]).reshape(3, 2, 4) for r in store.patches(df, (3, 2, 4)).collect()}
    want = {(*a, ch): rolled(fields[*a[:3], ch], a[3:], (3, 2, 4)) for a in asked if a[2] < 3 for ch in range(2)}
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)


def test_refusals_and_edges(spark, store, tmp_path):
    with pytest.raises(ValueError, match="does not fit"):
        store.box((0, 0, 0), (7, 1, 1))
    with pytest.raises(ValueError, match="no attributes"):
        ChunkStore(spark, f"{tmp_path}/none")
    spark.createDataFrame([(False, 6, 2, ["u"])], "complete boolean, n int, c int, channels array<string>").write.parquet(f"{tmp_path}/open/attrs")
    with pytest.raises(ValueError, match="not complete"):
        ChunkStore(spark, f"{tmp_path}/open")
    with pytest.raises(ValueError, match="fill"):
        write_chunks(spark.createDataFrame([], SCHEMA), f"{tmp_path}/odd", 6, 4, ["u"])
    write_chunks(spark.createDataFrame([], SCHEMA), f"{tmp_path}/empty", 6, 2, ["u"])
    assert ChunkStore(spark, f"{tmp_path}/empty").box((0, 0, 0), (6, 6, 6)).count() == 0
    rows = [("a", 1, 0, 0, z, [None if z == 1 and i == 3 else float(i) for i in range(36)]) for z in range(6)] + [("a", 1, 1, 0, z, [0.0] * 36) for z in range(5)]
    write_chunks(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/holes", 6, 2, ["u"])
    s = ChunkStore(spark, f"{tmp_path}/holes")
    got = s.box((1, 0, 0), (1, 1, 6), "a", [1], [0]).collect()
    assert {r["x"]: r["value"] for r in got} == {0: 0.0, 1: 1.0, 2: 2.0, 3: None, 4: 4.0, 5: 5.0}
    assert s.frame("a", 1, 1).count() == 4 * 36  # the last plane is missing, so the cubes of the last two

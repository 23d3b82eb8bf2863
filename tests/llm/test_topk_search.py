import math

import numpy as np
import pytest

from fluxlake.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=5, k=T.K):
    def ok(r):
        return r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])

    whole = [(r[0], [math.floor(max(min(256 * x, T.HELD), -T.HELD)) for x in r[1]]) for r in rows if ok(r)]
    out = []
    for n, (i, a) in enumerate(whole):
        if i % every == 0:
            others = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for m, (j, b) in enumerate(whole) if m != n and len(a) == len(b))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(others[:k])]
    return sorted(out)


def found(spark, rows, every=5, k=T.K):
    v = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as q", "1 as rank", "2 as score", "3 as x", "4 as cell").repartition(3)
    return sorted(tuple(r) for r in T.top_k(v, v.where(f"vec_id % {every} = 0"), k).collect())


def clustered(seed, n, dim=8, noise=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return (centres[rng.integers(0, 12, n)] + noise * rng.normal(size=(n, dim))).tolist()


@pytest.mark.parametrize(("page", "tree", "block"), [(8, 400, 160), (4, 1 << 20, 1 << 18)])
def test_against_brute_force(spark, monkeypatch, page, tree, block):
    monkeypatch.setattr(T, "PAGE", page)
    monkeypatch.setattr(T, "TREE", tree)
    monkeypatch.setattr(T, "BLOCK", block)
    rows = [(i, v, 1) for i, v in enumerate(clustered(1, 500))]
    rows += [(1000 + i, rows[7][1], 2) for i in range(40)] + [(2000 + 5 * i, [0.5] * 8, 2) for i in range(20)]  # copies: ties everywhere
    assert found(spark, rows) == brute(rows)


def test_lengths_that_vary_and_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-6, 9)).tolist(), 1) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [2.0, 1.0], 1), (5, None, 1), (10, [1.0, None], 1), (15, [nan, 1.0], 1), (20, [inf, 1.0], 1), (25, [], 1), (26, [], 1), (30, [1.0, 2.0, 3.0], None), (None, [9.0, 9.0], 1), (35, [0.0, 0.0], 1), (-5, [-1.0, -0.001], 1), (7, [1e300, -1e300], 1)]
    assert found(spark, rows) == brute(rows)
    assert (30, 1) not in {r[:2] for r in found(spark, rows)}  # nothing of its length
    v = spark.createDataFrame(rows, SCHEMA)
    assert T.top_k(v.limit(0), v.limit(0)).count() == 0
    assert T.top_k(v.limit(0), v.where("vec_id = 0")).count() == 0
    assert T.top_k(v, v.limit(0)).count() == 0


def test_bounds_save_distances_and_lose_nothing():
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.array(clustered(4, 3000, 8, 0.03))).astype(np.int64)
    x = np.unique(x, axis=0)
    greatest = int((x * x).sum(1).max())
    space = T.Space(x, greatest)
    pages = T.load(space, 32)
    for p in pages:  # radii cover what is below, stored distances are those to the routing object
        for r, c, h in zip(p.radius, p.child, p.entries, strict=False):
            below = pages[int(c)]
            assert np.allclose(below.parent, space.between(below.entries, np.array([h]))[:, 0]) and below.parent.max() <= r + 1e-9
    assert sorted(np.concatenate([p.entries for p in pages if p.leaf])) == list(range(len(x)))
    vectors, ids = [space.x[p.entries] for p in pages], [[[int(e)] for e in p.entries] for p in pages]
    count = [0]
    for i in rng.integers(0, len(x), 50):
        got = sorted(((-s, j) for s, j in T.search(pages, vectors, ids, space.x[i], int(i), greatest, 5, None, count)))
        assert got == sorted((-int(s), j) for j, s in enumerate(space.x @ space.x[i]) if j != i)[:5]
    assert count[0] < 0.4 * 50 * len(x)

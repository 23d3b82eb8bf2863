import numpy as np
import pytest

from fluxlake.llm import embedding_dedup as D

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    usable = [(i, np.array(v, float), c) for i, v, c in rows if v is not None and c is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = {i: i for i, *_ in rows}
    links = {i: 0 for i, *_ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for p, (i, v, c) in enumerate(usable):
        for j, w, d in usable[:p]:
            if c == d and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= D.COSINE:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], find(i)) for i, *_ in rows}


def vectors(seed, n, dim=16, noise=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, dim))
    x = centres[rng.integers(0, len(centres), n)] + noise * rng.normal(size=(n, dim))
    return [(i, [float(np.float32(v)) for v in x[i]], int(rng.integers(0, 3))) for i in range(n)]


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(D, "LEAF", 40)
    monkeypatch.setattr(D, "BLOCK", 16)
    rows = vectors(1, 700)
    want = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in D.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    a, b = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert b > 500 and 0.95 * b <= a <= b
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.95 * len(want)


def test_one_leaf_is_exact(spark):
    rows = vectors(2, 300) + [(1000 + i, [float(np.float32(v)) for v in np.ones(16)], 1) for i in range(50)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in D.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_spill_puts_points_near_a_split_on_both_sides():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = D.plant(x, 8000, 8, trees=2)
    rows, leaves = f.leaves(x)
    assert set(rows) == set(range(2000)) and 2 * 2000 < len(rows) < 2 * 2000 * 2**f.depth
    assert len(set(zip(rows, leaves, strict=True))) == len(rows)


def test_edges(spark):
    one, nan = [1.0, 2.0], float("nan")
    rows = [(0, one, 1), (1, [2.0, 4.0], 1), (2, one, None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [], 1), (9, [1.0, 2.0, 3.0], 1), (10, one, 2), (11, one, 1), (12, [-1.0, -2.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as id", "1 as n", "2 as links", "3 as component", "4 as h1")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in D.near_duplicates(df).collect()}
    assert {i: v[:2] for i, v in got.items()} == brute(rows)
    assert got[0] == (2, 0, True) and got[11] == (2, 0, False)
    assert D.near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_link(spark):
    rows = [(5, [1.0, 0.0], 1)] * 3
    out = D.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["n_links"], r["component_id"]) for r in out] == [(2, 5)] * 3


def planted(n, pairs, cosine, dim=64, seed=1):
    """n vectors anywhere, and for the first ones a partner each at this cosine."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, r = x[:pairs], rng.normal(size=(pairs, dim))
    r -= (r * a).sum(1, keepdims=True) * a
    return x, cosine * a + np.sqrt(1 - cosine**2) * r / np.linalg.norm(r, axis=1, keepdims=True)


@pytest.mark.parametrize(("size", "depth"), [(100_000, 8), (1_600_000, 12), (26_000_000, 16)])
@pytest.mark.parametrize("cosine", [0.93, 0.94, 0.96])
def test_recall_of_deep_trees(size, depth, cosine):
    x, y = planted(40_000, 500, cosine)
    f = D.plant(x[np.random.default_rng(0).choice(len(x), D.SAMPLE, replace=False)], size, 64)
    assert f.depth == depth

    def held(v):
        out = [set() for _ in v]
        for r, leaf in zip(*f.leaves(v), strict=True):
            out[r].add(leaf)
        return out

    assert np.mean([not a.isdisjoint(b) for a, b in zip(held(x[:500]), held(y), strict=True)]) >= 0.95


def test_recall_of_the_query_with_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(D, "LEAF", 20)
    x, y = planted(5_500, 500, 0.935, dim=24)
    v = np.concatenate([x, y]).astype(np.float32)
    want = v.astype(float)
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    want = int((want @ want.T >= D.COSINE).sum()) - len(v)
    assert D.plant(x, len(v), 24).depth >= 8
    got = D.near_duplicates(spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(v)], SCHEMA)).agg({"n_links": "sum"}).first()[0]
    assert want >= 1000 and 0.9 * want <= got <= want


def dense(seed, n, dim=64, far=0, cosine=0.95):
    """n vectors around one centre whose pairs have about this cosine, and others anywhere."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dim)
    x = centre / np.linalg.norm(centre) + np.sqrt((1 / cosine - 1) / dim) * rng.normal(size=(n, dim))
    x = np.concatenate([x, rng.normal(size=(far, dim))])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("n", "far", "cosine"), [(12_800, 0, 0.95), (12_800, 0, 0.93), (8_000, 16_000, 0.95)])
def test_dense_groups_are_not_cut(n, far, cosine):
    x = dense(4, n, far=far, cosine=cosine)
    rng = np.random.default_rng(0)
    f = D.plant(x[rng.choice(len(x), min(len(x), D.SAMPLE), replace=False)], 200_000, 64)
    some = rng.choice(n, 1_500, replace=False)
    a, b = np.nonzero(np.triu(x[some] @ x[some].T >= D.COSINE, 1))
    rows, leaves = f.leaves(x[some])
    held = [set() for _ in some]
    for r, leaf in zip(rows, leaves, strict=True):
        held[r].add(leaf)
    assert len(a) > 10_000
    assert np.mean([not held[i].isdisjoint(held[j]) for i, j in zip(a[:200_000], b[:200_000], strict=True)]) >= 0.95


def test_links_of_a_dense_label(spark):
    x = dense(6, 10_000, dim=16).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = int((y @ y.T >= D.COSINE).sum()) - len(y)
    got = D.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * want <= got <= want


@pytest.mark.parametrize("share", [0.6, 0.4])
def test_a_dense_group_does_not_keep_others_together(share):
    size, total = 200_000, 20_000
    n = int(share * total)
    x = dense(4, n, far=total - n - 400)
    a, b = planted(200, 200, 0.94, seed=8)  # near pairs among the others
    x = np.concatenate([x, a, b])
    f = D.plant(x[np.random.default_rng(0).permutation(total)[: D.SAMPLE]], size, 64)
    assert f.depth >= 9 and len(f.picks) == D.TREES
    rows, leaves = f.leaves(x)
    of_others = np.unique(leaves[rows >= n], return_counts=True)[1]
    assert of_others.max() < 4 * D.LEAF * total / size * 10  # in the sample's numbers; all together before
    held = [set() for _ in x]
    for r, leaf in zip(rows, leaves, strict=True):
        held[r].add(leaf)
    pairs = [not held[total - 400 + i].isdisjoint(held[total - 200 + i]) for i in range(200)]
    some = np.random.default_rng(1).choice(n, 600, replace=False)
    i, j = np.nonzero(np.triu(x[some] @ x[some].T >= D.COSINE, 1))
    linked = [not held[some[p]].isdisjoint(held[some[q]]) for p, q in zip(i[:20_000], j[:20_000], strict=True)]
    assert len(linked) > 1000 and np.mean(pairs) >= 0.9 and np.mean(linked) >= 0.9


def test_links_of_a_dense_group_among_others(spark, monkeypatch):
    monkeypatch.setattr(D, "LEAF", 60)
    x = np.concatenate([dense(6, 1_500, dim=16, far=1_000), *planted(150, 150, 0.95, dim=16, seed=3)]).astype(np.float32)
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = y @ y.T >= D.COSINE
    np.fill_diagonal(want, False)
    out = {r["vec_id"]: r["n_links"] for r in D.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA).repartition(4)).collect()}
    got = np.array([out[i] for i in range(len(x))])
    assert (got <= want.sum(1)).all()
    for part in (slice(0, 1_500), slice(1_500, None)):
        assert 0.9 * want[part].sum() <= got[part].sum()

import hashlib
import math

import numpy as np
import pytest

from fluxlake.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, entries=V.ENTRIES, rounds=V.ROUNDS):
    """Plain assignment in Python's whole numbers."""
    kept = [(i, [math.floor(max(min(1024 * x, V.HELD), -V.HELD)) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1]) if kept else 0
    good = [r for r in kept if len(r[1]) == dim and dim and dim % 4 == 0]
    w = dim // 4
    parts = [[tuple(r[1][p * w : (p + 1) * w]) for r in good] for p in range(4)]
    books = [part[:entries] for part in parts] if good else []
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = [nearest(x, book)[1] for x in parts[p]]
            books[p] = [tuple(sum(v) // len(v) for v in zip(*own, strict=True)) if (own := [x for x, o in zip(parts[p], of, strict=True) if o == e]) else c for e, c in enumerate(book)]
    got = [[nearest(x, book) for x in part] for part, book in zip(parts, books, strict=False)]
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    coded = [(i, "".join(f"{g[n][1]:02x}" for g in got), sum(g[n][0] for g in got), c) for n, (i, _, c) in enumerate(good)]
    coded += [(i, None, None, c) for i, v, c in kept if (i, v, c) not in good]
    per = {}
    for _, _, e, c in coded:
        per[c] = per.get(c, 0) + (e or 0)
    return sorted(((i, code, e, per[c], sha) for i, code, e, c in coded), key=repr)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as code", "1 as error", "2 as x", "3 as of", "4 as part").repartition(3)
    return sorted((tuple(r) for r in V.compress(df).collect()), key=repr)


@pytest.mark.parametrize("chunk", [8 * 16, 64 * 16, 1 << 18])
def test_against_plain_assignment(spark, monkeypatch, chunk):
    monkeypatch.setattr(V, "ENTRIES", 20)
    monkeypatch.setattr(V, "CHUNK", chunk)
    monkeypatch.setattr(V, "STEP", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 16))
    x = centres[rng.integers(0, 9, 300)] + 0.05 * rng.normal(size=(300, 16))
    rows = [(int(i), v, int(i) % 3 if i % 7 else None) for i, v in zip(rng.permutation(300), x.tolist(), strict=True)]
    rows += [(500 + i, rows[3][1], 1) for i in range(60)] + [rows[0]]  # copies, and a row twice
    assert found(spark, rows) == brute(rows, 20)


def test_ties_go_to_the_lower_entry():
    grid = np.array([[a, b] for a in range(-6, 7) for b in range(-6, 7)], np.int64)
    book = np.array([[2, 2], [0, 0], [2, 2], [4, 0], [0, 4], [-4, 0], [0, -4]], np.int64)
    t = V.grow(grid)
    to, sums, counts = V.assign(t, book)
    want = ((grid[:, None, :] - book[None]) ** 2).sum(2).argmin(1)  # the first of equals
    real = t.weight > 0
    assert (want[t.order[real]] == to[real]).all() and counts[2] == 0
    assert all((sums[e] == grid[want == e].sum(0)).all() and counts[e] == (want == e).sum() for e in range(len(book)))


def test_boxes_save_comparisons():
    rng = np.random.default_rng(6)
    centres = rng.integers(-4000, 4000, size=(64, 4))
    x = centres[rng.integers(0, 64, 4096)] + rng.integers(-40, 40, size=(4096, 4))
    seen = [0]
    to, _, counts = V.assign(V.grow(x), centres, seen)
    assert counts.sum() == 4096 and seen[0] < 0.1 * 4096 * 64


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(4, [1.0, -2.0, 3.0, 0.5], None), (2, [0.0, -0.0001, 5.0, 1e12], 1), (2, [0.0, 1.0, 5.0, -1e12], 1), (9, None, 1), (10, [1.0, None, 1.0, 1.0], 1), (11, [nan, 1.0, 1.0, 1.0], 1), (12, [inf, 1.0, 1.0, 1.0], 1), (13, [1.0, 2.0], None), (14, [], 7), (None, [1.0, 1.0, 1.0, 1.0], 1), (4, [1.0, -2.0, 3.0, 0.5], None)]
    assert found(spark, rows) == brute(rows)
    odd = [(1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0, 4.0], 1)]  # the length is odd: no codes
    assert found(spark, odd) == brute(odd) and found(spark, odd)[0][1] is None
    assert V.compress(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0

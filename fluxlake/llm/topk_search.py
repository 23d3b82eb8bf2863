"""Exact top-k by inner product with M-trees.

Vectors become whole numbers. A largest inner product is a smallest distance once every
vector x gets one more coordinate, sqrt(M - |x|^2), where M is the greatest |x|^2, and a
query gets 0 there; so metric trees serve. Equal vectors are one entry with its k + 1
smallest ids. Entries go to the cell of the nearest of a few routing objects; a cell is cut
by hash into as many trees of bounded size as it needs, each loaded in one task and
written as pages. A page holds entries with their distance to the routing object above and,
above the leaves, their covering radius and page.

A block of queries and a tree meet in one task. The search is best first: pages are taken in order of
the least distance they can hold, until that is beyond the k-th best; an entry whose
stored parent distance already shows that it is too far is passed over without computing
its distance. Each query first searches a tree of its own cell; what it finds there tells
which cells it still has to visit. Each visit hands on k rows at most.

Defined cases: vectors that are null or hold null or non-finite components, and rows without
an id, take no part; a query meets only vectors of its own length (empty ones score 0 with
each other); a component x counts at most as 2^24 / scale on either side; rows that repeat an
id are rows of their own, so each can find the others and each query row has its own result;
ties go to the smaller vec_id; a query with fewer than k candidates has that many rows; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, discard, mapped, materialise, read

K, SCALE, EVERY = 5, 256, 50
#: Entries of a page; components of one tree's entries, and of the queries that meet it at once; routing objects of the top level; vectors they are drawn from.
PAGE, TREE, BLOCK, CELLS, SAMPLE = 128, 1 << 20, 1 << 18, 256, 4096
#: Whole components are held to this on either side, so that scores fit in a long.
HELD = 1 << 24


def whole(v: str, scale: int = SCALE) -> Column:
    """The components as whole numbers."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(HELD))), F.lit(-float(HELD)))).cast("int"))


def finite(v: str) -> Column:
    """A vector without null or non-finite components."""
    return F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of lists of one length as a matrix of whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _exact(dim: int, *most: int) -> type:
    """float64 where its inner products are exact, else int64."""
    return np.float64 if dim * int(np.prod([max(1, m) for m in most], dtype=object)) < 1 << 52 else np.int64


def _most(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


class Space:
    """Distances between vectors with their further coordinate; `greatest` is the greatest |x|^2."""

    def __init__(self, x: np.ndarray, greatest: int):
        self.dim = x.shape[1]
        self.x = x.astype(_exact(self.dim, _most(x), _most(x), 4))
        self.n = (self.x * self.x).sum(1)
        self.last = np.sqrt(np.maximum(greatest - self.n, 0).astype(float))

    def between(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        plain = self.n[rows][:, None] + self.n[others][None, :] - 2 * (self.x[rows] @ self.x[others].T)
        return np.sqrt(plain.astype(float) + (self.last[rows][:, None] - self.last[others][None, :]) ** 2)


@dataclass
class Page:
    """Entries of one node: their distance to the routing object above; for inner nodes their covering radii and pages."""

    entries: np.ndarray
    parent: np.ndarray
    radius: np.ndarray
    child: np.ndarray

    @property
    def leaf(self) -> bool:
        return not len(self.child)


def load(space: Space, page: int = PAGE, seed: int = 3) -> list[Page]:
    """A bulk-loaded M-tree over distinct vectors; page 0 is the root."""
    rng = np.random.default_rng(seed)
    pages: list[Page] = [None]
    open_ = [(0, np.arange(len(space.x)), 0)]
    none = np.zeros(0)
    while open_:
        at, own, above = open_.pop()
        if len(own) <= page:
            pages[at] = Page(own, space.between(own, np.array([above]))[:, 0], none, none)
            continue
        m = min(page, max(2, -(-2 * len(own) // page)))
        heads = rng.choice(own, m, replace=False)
        far = space.between(own, heads)
        of = far.argmin(1)
        if np.bincount(of).max() > 0.9 * len(own):  # nearly all by one head: shells around it
            first = heads[np.bincount(of).argmax()]
            order = own[np.argsort(space.between(own, np.array([first]))[:, 0], kind="stable")]
            parts = np.array_split(order, m)
            heads = np.array([p[0] for p in parts])
        else:
            parts = [own[of == j] for j in range(m)]
        radius = np.array([space.between(p, np.array([h]))[:, 0].max() for p, h in zip(parts, heads, strict=True)])
        child = np.arange(len(pages), len(pages) + m)
        pages.extend([None] * m)
        pages[at] = Page(heads, space.between(heads, np.array([above]))[:, 0], radius, child)
        open_.extend(zip(child.tolist(), parts, heads.tolist(), strict=True))
    return pages


class Best:
    """The k best (score, smaller id) of one query."""

    def __init__(self, k: int, least: int | None):
        self.k, self.least, self.heap = k, least, []

    @property
    def bound(self) -> int | None:
        """Scores below it are of no use."""
        own = self.heap[0][0] if len(self.heap) == self.k else None
        return own if self.least is None else self.least if own is None else max(own, self.least)

    def add(self, score: int, ids: list[int]) -> None:
        for i in ids:
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (score, -i))
            elif (score, -i) > self.heap[0]:
                heapq.heapreplace(self.heap, (score, -i))


def search(pages: list[Page], vectors: list[np.ndarray], ids: list[list[list[int]]], q: np.ndarray, own: int, greatest: int, k: int, least: int | None, count: list[int] | None = None) -> list[tuple[int, int]]:
    """(score, id) of the k best of one tree for query q with id `own`, best first. `least` is a score that k others reach already; `count` gathers the computed distances."""
    base = float(int((q * q).sum()) + greatest)
    slack = 1e-7 * np.sqrt(base) + 1e-9
    best = Best(k, least)
    reach = np.inf if least is None else np.sqrt(max(base - 2.0 * least, 0.0)) + slack
    heap: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
    while heap and heap[0][0] <= reach:
        low, at, up = heapq.heappop(heap)
        p = pages[at]
        x, which = vectors[at], None
        if up >= 0:
            near = np.abs(up - p.parent) <= (reach if p.leaf else reach + p.radius)
            if not near.all():
                which = np.flatnonzero(near)
                x = x[which]
        score = x @ q
        if count is not None:
            count[0] += len(x)
        if p.leaf:
            bound = best.bound
            good = np.arange(len(score)) if bound is None else np.flatnonzero(score >= bound)
            for j in good[np.argsort(-score[good], kind="stable")]:
                bound = best.bound
                if bound is not None and score[j] < bound:
                    break
                held = ids[at][j if which is None else which[j]]
                if own in held and np.array_equal(x[j], q):
                    held = list(held)
                    held.remove(own)
                best.add(int(score[j]), held)
            if best.bound is not None:
                reach = np.sqrt(max(base - 2.0 * best.bound, 0.0)) + slack
            continue
        d = np.sqrt(np.maximum(base - 2.0 * score, 0.0))
        radius, child = (p.radius, p.child) if which is None else (p.radius[which], p.child[which])
        lows = np.maximum(d - radius, low)
        for j in np.flatnonzero(lows <= reach):
            heapq.heappush(heap, (float(lows[j]), int(child[j]), float(d[j])))
    return [(s, -i) for s, i in best.heap]


_PAGES = "dim int, cell int, salt int, page int, vectors array<int>, ids array<array<long>>, parent array<double>, radius array<double>, child array<int>"


def _loaded(table: pa.Table, greatest: int) -> pa.Table:
    """Pages of the tree over one group of entries (dim, cell, salt, x, ids)."""
    dim, cell, salt = (table[c][0].as_py() for c in ("dim", "cell", "salt"))
    x = _rows(table["x"], dim)
    ids = table["ids"].combine_chunks()
    out = []
    for number, p in enumerate(load(Space(x, greatest))):
        own = ids.take(pa.array(p.entries, pa.int64())).to_pylist() if p.leaf else []
        out.append({"dim": dim, "cell": cell, "salt": salt, "page": number, "vectors": x[p.entries].ravel().tolist(), "ids": own, "parent": p.parent.tolist(), "radius": p.radius.tolist(), "child": p.child.astype(int).tolist()})
    return pa.Table.from_pylist(out, pa.schema([*[(c, pa.int32()) for c in ("dim", "cell", "salt", "page")], ("vectors", pa.list_(pa.int32())), ("ids", pa.list_(pa.list_(pa.int64()))), ("parent", pa.list_(pa.float64())), ("radius", pa.list_(pa.float64())), ("child", pa.list_(pa.int32()))]))


_FOUND = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searched(queries: pa.Table, tree: pa.Table, greatest: int, k: int) -> pa.Table:
    """What the queries of a block find in one tree."""
    if not len(queries) or not len(tree):
        return _FOUND.empty_table()
    dim = queries["dim"][0].as_py()
    tree = tree.sort_by("page")
    q = _rows(queries["x"], dim)
    pages, vectors, ids = [], [], []
    for r in tree.to_pylist():
        x = np.array(r["vectors"], np.int64).reshape(len(r["parent"]), dim)
        pages.append(Page(None, np.array(r["parent"]), np.array(r["radius"]), np.array(r["child"], np.int64)))
        vectors.append(x)
        ids.append(r["ids"])
    kind = _exact(dim, _most(q), max(_most(x) for x in vectors))
    vectors, q = [x.astype(kind) for x in vectors], q.astype(kind)
    out = []
    for v, number, own, least in zip(q, queries["q"].to_pylist(), queries["query_id"].to_pylist(), queries["least"].to_pylist(), strict=True):
        out += [(number, own, i, s) for s, i in search(pages, vectors, ids, v, own, greatest, k, least)]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_FOUND) if out else _FOUND.empty_table()


class Cells:
    """The routing objects of the top level, by length, and once known the covering radii of their cells."""

    def __init__(self, drawn: list[list[int]], greatest: int, radius: dict[int, float] | None = None):
        self.greatest, self.radius = greatest, radius or {}
        self.of = {}
        for dim in sorted({len(v) for v in drawn}):
            numbers = [i for i, v in enumerate(drawn) if len(v) == dim]
            self.of[dim] = (np.array(numbers), np.array([drawn[i] for i in numbers], np.int64).reshape(len(numbers), dim))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each entry and its distance to the routing object; a length without any is cell -1."""
        if x.shape[1] not in self.of:
            return np.full(len(x), -1), np.zeros(len(x))
        numbers, heads = self.of[x.shape[1]]
        d = Space(np.concatenate([heads, x]), self.greatest).between(np.arange(len(heads), len(heads) + len(x)), np.arange(len(heads)))
        at = d.argmin(1)
        return numbers[at], d[np.arange(len(x)), at]

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers, and the distance of each query to their routing objects."""
        if q.shape[1] not in self.of:
            return np.array([-1]), np.zeros((len(q), 1))
        numbers, heads = self.of[q.shape[1]]
        kind = _exact(q.shape[1], _most(q), _most(heads), 4)
        q, heads = q.astype(kind), heads.astype(kind)
        return numbers, np.sqrt(np.maximum(((q * q).sum(1)[:, None] + self.greatest - 2 * (q @ heads.T)).astype(float), 0.0))


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch in which all vectors have one length."""
    width = np.diff(batch.column(column).offsets.to_numpy())
    for dim in np.unique(width):
        yield int(dim), batch.take(pa.array(np.flatnonzero(width == dim))) if (width != dim).any() else batch


def _visit(pairs: DataFrame, pages: DataFrame, greatest: int, k: int, first: bool) -> DataFrame:
    """Rows (q, query_id, vec_id, score): the k best in each tree that a query visits. pairs: (dim, cell, home, q, query_id, x, least); first: the first tree of the home cell, else all trees but that."""
    trees = pages.select("dim", "cell", "salt").distinct()
    trees = trees.where("salt = 0") if first else trees
    met = pairs.join(trees, ["dim", "cell"])
    met = met if first else met.where("not (cell = home and salt = 0)")
    of = ["dim", "cell", "salt"]
    sizes = met.groupBy(of).agg(F.count("*").alias("n")).select(*of, F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("dim") / BLOCK)).cast("int").alias("blocks"))
    left = met.join(sizes, of).withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks").cast("long")).cast("int"))
    right = pages.join(sizes, of).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own on either side
    return left.groupBy(*of, "block").cogroup(right.groupBy(*of, "block")).applyInArrow(lambda a, b: _searched(a, b, greatest, k), "q long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of `queries` the k rows of `vectors` with the highest inner product, not the row itself. Both have vec_id and embedding."""
    spark = vectors.sparkSession
    bounded(spark)
    ints = lambda df: df.where(finite("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole("embedding", scale).alias("x"))
    smallest = Window.partitionBy("x").orderBy("vec_id")
    entries = ints(vectors).withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)  # Spark limits groups before it shuffles them
    entries = materialise(entries.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = materialise(ints(queries).select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "x"), "queries")
    norm = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v)
    size, total, greatest = entries.agg(F.count("*"), F.sum(F.size("x")), F.max(norm)).first()
    greatest = max(greatest or 0, asked.agg(F.max(norm)).first()[0] or 0)
    chance = F.pmod(F.xxhash64("x", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    drawn = sorted(r["x"] for r in entries.where(chance < min(1.0, SAMPLE / max(1, size))).limit(2 * SAMPLE).select("x").collect())
    heads = min(CELLS, len(drawn), max(1, 2 * (total or 0) // TREE))
    drawn = [drawn[i] for i in np.random.default_rng(1).permutation(len(drawn))[:heads]]
    cells = spark.sparkContext.broadcast(Cells(drawn, greatest))  # CELLS vectors at most

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in _by_length(b, 0):
                cell, far = cells.value.nearest(_rows(part.column(0), dim))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(cell), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(far)], names=["x", "ids", "dim", "cell", "far"])

    held = materialise(mapped(entries.select("x", "ids"), placed, "x array<int>, ids array<long>, dim int, cell int, far double"), "cells")
    per_cell = held.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    radius = {r["cell"]: r["radius"] for r in per_cell.where("cell >= 0").collect()}  # CELLS rows at most
    salts = per_cell.select("dim", "cell", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("dim") / TREE)).alias("salts"))
    salted = held.join(salts, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("x"), "salts").cast("int").alias("salt"), "x", "ids")
    pages = materialise(salted.groupBy("dim", "cell", "salt").applyInArrow(lambda t: _loaded(t, greatest), _PAGES), "pages")
    discard(entries, held)
    routes = spark.sparkContext.broadcast(Cells(drawn, greatest, radius))

    def visits(batches: Iterator[pa.RecordBatch], home_only: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in _by_length(b, 2):
                q, least = _rows(part.column(2), dim), part.column(3).to_numpy(zero_copy_only=False).astype(float)
                numbers, d = routes.value.distances(q)
                home = numbers[d.argmin(1)]
                if home_only:
                    rows, cell = np.arange(len(q)), home
                else:
                    base = (q.astype(float) ** 2).sum(1) + greatest
                    reach = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(base - 2 * least, 0)) + 1e-7 * np.sqrt(base) + 1e-9)
                    far = d - np.array([routes.value.radius.get(int(c), np.inf) for c in numbers])
                    rows, at = np.nonzero(far <= reach[:, None])
                    cell = numbers[at]
                kept = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(home[rows], pa.int32()), *kept.columns], names=["dim", "cell", "home", "q", "query_id", "x", "least"])

    pairs = "dim int, cell int, home int, q long, query_id long, x array<int>, least long"
    start = asked.select("q", "query_id", "x", F.lit(None).cast("long").alias("least"))
    probed = materialise(_visit(mapped(start, lambda b: visits(b, True), pairs), pages, greatest, k, True), "probed")
    least = probed.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select("q", F.col("s").alias("least"))
    rest = asked.join(least, "q", "left").select("q", "query_id", "x", "least")
    found = probed.union(_visit(mapped(rest, lambda b: visits(b, False), pairs), pages, greatest, k, False))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_topk_search(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return top_k(v, v.where(F.col("vec_id") % EVERY == 0))


ORACLE = f"""WITH v AS (SELECT vec_id, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0)
  SELECT query_id, CAST("rank" AS INTEGER) AS "rank", vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS "rank" FROM s) WHERE "rank" <= {K}"""

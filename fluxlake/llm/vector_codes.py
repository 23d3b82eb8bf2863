"""Product codes of vectors by the filtering form of Lloyd's algorithm.

Vectors become whole numbers and are cut into equal parts; each part position has a
codebook. Every partition builds kd-trees over chunks of its vectors, one for each part,
once: nodes hold their bounding box and the sum and count of their points, and are written
to the shared folder. A round sends the codebooks (ENTRIES vectors at most) to the tasks
and walks down the trees: of the entries that are left for a node, the one nearest to the
middle of its box stays, and any entry that is nowhere in the box nearer than that one is
eliminated. A node with one entry left is assigned at once by its sum and count; only
points of leaves with several are compared singly. Tasks hand on one sum and count for an
entry. All arithmetic is in whole numbers, so the result is that of plain assignment.

Defined cases: rows whose vector is null or holds null or non-finite components are
dropped; the length is that of the kept row with the smallest id, and kept rows of another length, or all
if the parts don't come out even, have null code and error and add nothing to their label; a component
counts at most as 2^26 / scale on either side; null ids come last, equal ids are ordered by
vector for the first codebook; rows that repeat an id or a vector count each; with fewer rows
than entries, codebooks are shorter; a null label is a label; ties go to the lower entry; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mapped, materialise, read

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Components of a chunk of vectors with trees of their own; points of a leaf; (node, entry) pairs looked at in one step.
CHUNK, LEAF, STEP = 1 << 18, 8, 1 << 15
HELD = 1 << 26


@dataclass
class Tree:
    """A kd-tree in heap order over points, padded to LEAF times a power of two with points of no weight."""

    order: np.ndarray
    points: np.ndarray
    weight: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @property
    def depth(self) -> int:
        return len(self.counts).bit_length() - 1


def grow(x: np.ndarray) -> Tree:
    """The tree of the rows of x: each node is halved at the median of its widest side."""
    n, d = x.shape
    size = LEAF
    while size < n:
        size *= 2
    x = np.concatenate([x, np.repeat(x[-1:], size - n, 0)])
    order = np.arange(size)[None, :]
    while order.shape[1] > LEAF:
        at = x[order]
        wide = (at.max(1) - at.min(1)).argmax(1)
        side = np.take_along_axis(at, wide[:, None, None], 2)[:, :, 0]
        half = order.shape[1] // 2
        order = np.take_along_axis(order, np.argpartition(side, half - 1, axis=1), 1).reshape(-1, half)
    points = x[order]
    weight = (order < n).astype(np.int64)
    levels = [(points.min(1), points.max(1), (points * weight[:, :, None]).sum(1), weight.sum(1))]
    while len(levels[0][0]) > 1:
        low, high, sums, counts = levels[0]
        levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), sums[::2] + sums[1::2], counts[::2] + counts[1::2]))
    low, high, sums, counts = (np.concatenate(v) for v in zip(*levels, strict=True))
    return Tree(order.ravel(), points.reshape(-1, d), weight.ravel(), low, high, sums, counts)


def _first_least(score: np.ndarray, starts: np.ndarray, own: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """For each run of pairs the lowest entry among those with the least score."""
    least = np.minimum.reduceat(score, starts, axis=0)
    return np.minimum.reduceat(np.where(score == least[own], entry if score.ndim == 1 else entry[:, None], np.iinfo(np.int64).max), starts, axis=0)


def assign(tree: Tree, book: np.ndarray, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of every point in tree order, and the sums and counts of each entry's points. `seen` gathers the compared (node or point, entry) pairs."""
    e, d = book.shape
    norm = (book * book).sum(1)
    to = np.zeros(len(tree.points), np.int64)
    sums, counts = np.zeros((e, d), np.int64), np.zeros(e, np.int64)
    nodes, own, entry = np.zeros(1, np.int64), np.zeros(e, np.int64), np.arange(e)
    for level in range(tree.depth + 1):
        heap = nodes + (1 << level) - 1
        middle, width = tree.low[heap] + tree.high[heap], tree.high[heap] - tree.low[heap]
        starts = np.searchsorted(own, np.arange(len(nodes)))
        keep = np.zeros(len(own), bool)
        star = np.zeros(len(nodes), np.int64)
        for a, b in _steps(starts, len(own), STEP):
            s = slice(starts[a], starts[b] if b < len(starts) else len(own))
            of, c = own[s], entry[s]
            score = norm[c] - np.einsum("pd,pd->p", book[c], middle[of])
            star[a:b] = _first_least(score, starts[a:b] - starts[a], of - a, c)
            best = star[of]
            diff = book[c] - book[best]
            nearest = norm[c] - norm[best] - np.einsum("pd,pd->p", diff, middle[of]) - np.einsum("pd,pd->p", np.abs(diff), width[of])
            keep[s] = (nearest < 0) | ((nearest == 0) & (c <= best))
        if seen is not None:
            seen[0] += len(own)
        own, entry = own[keep], entry[keep]
        left = np.bincount(own, minlength=len(nodes))
        done = np.flatnonzero(left == 1)
        if len(done):  # whole subtrees
            np.add.at(sums, star[done], tree.sums[heap[done]])
            np.add.at(counts, star[done], tree.counts[heap[done]])
            size = len(to) >> level
            to.reshape(-1, size)[nodes[done]] = star[done][:, None]
        open_ = np.flatnonzero(left > 1)
        if not len(open_):
            return to, sums, counts
        number = np.full(len(nodes), -1)
        number[open_] = np.arange(len(open_))
        alive = left[own] > 1
        own, entry, nodes = number[own[alive]], entry[alive], nodes[open_]
        if level < tree.depth:  # both children look at what is left
            pairs = np.searchsorted(own, np.arange(len(nodes) + 1))
            length = np.repeat(np.diff(pairs), 2)
            at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(np.repeat(pairs[:-1], 2), length)
            own, entry = np.repeat(np.arange(2 * len(nodes)), length), entry[at]
            nodes = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel()
    points = tree.points.reshape(-1, LEAF, d)
    starts = np.searchsorted(own, np.arange(len(nodes)))
    for a, b in _steps(starts, len(own), STEP // LEAF):
        s = slice(starts[a], starts[b] if b < len(starts) else len(own))
        of, c = own[s], entry[s]
        score = norm[c][:, None] - 2 * np.einsum("pd,pld->pl", book[c], points[nodes[of]])
        to.reshape(-1, LEAF)[nodes[a:b]] = _first_least(score, starts[a:b] - starts[a], of - a, c)
        if seen is not None:
            seen[0] += score.size
    rows = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
    np.add.at(sums, to[rows], tree.points[rows] * tree.weight[rows][:, None])
    np.add.at(counts, to[rows], tree.weight[rows])
    return to, sums, counts


def _steps(starts: np.ndarray, pairs: int, most: int) -> Iterator[tuple[int, int]]:
    """Runs of nodes with so many pairs at most; a node with more is a run of its own."""
    ends = np.append(starts[1:], pairs)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
        yield at, to
        at = to


_FOREST = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), *[(c, pa.list_(pa.list_(pa.int32()))) for c in ("order", "points", "low", "high", "counts")], ("sums", pa.list_(pa.list_(pa.int64())))])


def _chunk(ids: pa.Array, labels: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    """One row: the trees of a chunk of vectors, one for each part."""
    trees = [grow(p) for p in np.split(x, PARTS, axis=1)]
    lists = lambda name, kind: pa.array([[t.ravel() for t in (getattr(v, name).astype(kind) for v in trees)]], _FOREST.field(name).type)
    nested = lambda v, kind: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.cast(kind))
    return pa.RecordBatch.from_arrays([nested(ids, pa.int64()), nested(labels, pa.string()), *[lists(f.name, np.int64 if f.name == "sums" else np.int32) for f in list(_FOREST)[2:]]], schema=_FOREST)


def _trees(batch: pa.RecordBatch, row: int, width: int) -> list[Tree]:
    got = {f.name: [np.asarray(v.values.to_numpy(zero_copy_only=False), np.int64) for v in batch.column(f.name)[row]] for f in list(_FOREST)[2:]}
    n = len(batch.column("ids")[row])
    return [
        Tree(order, got["points"][i].reshape(-1, width), (order < n).astype(np.int64), *(got[c][i].reshape(-1, width) for c in ("low", "high", "sums")), got["counts"][i])
        for i, order in enumerate(got["order"])
    ]


def forest(vectors: DataFrame, dim: int) -> DataFrame:
    """The written trees of vectors (vec_id, label, x), a row for each chunk."""
    rows = LEAF
    while rows * 2 * dim <= CHUNK:
        rows *= 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, rows - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == rows:
                    yield one(held)
                    held, n = [], 0
        if n:
            yield one(held)

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids, labels, x = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns)
        return _chunk(ids, labels, x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim))

    return materialise(mapped(vectors.select("vec_id", "label", "x"), build, "ids array<long>, labels array<string>, `order` array<array<int>>, points array<array<int>>, low array<array<int>>, high array<array<int>>, counts array<array<int>>, sums array<array<long>>"), "forest")


def improve(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry becomes the floor of the mean of its parts."""
    width = books[0].shape[1]
    sent = trees.sparkSession.sparkContext.broadcast(books)  # ENTRIES vectors at most

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in sent.value], [np.zeros(len(b), np.int64) for b in sent.value]
        for b in batches:
            for r in range(b.num_rows):
                for i, t in enumerate(_trees(b, r, width)):
                    _, s, c = assign(t, sent.value[i])
                    sums[i] += s
                    counts[i] += c
        for i, (s, c) in enumerate(zip(sums, counts, strict=True)):
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i), pa.int32()), pa.array(used, pa.int32()), pa.array(c[used]), pa.array(list(s[used]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    partial = mapped(trees, walk, "part int, entry int, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums"))
    out = [b.copy() for b in books]
    for r in total.collect():  # a row for each entry
        out[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
    return out


def codes(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of every vector by these codebooks."""
    width = books[0].shape[1]
    sent = trees.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, labels = b.column("ids")[r].values, b.column("labels")[r].values
                error, code = np.zeros(len(ids), np.int64), np.full(len(ids), "", f"U{2 * PARTS}")
                for i, t in enumerate(_trees(b, r, width)):
                    to = assign(t, sent.value[i])[0]
                    real = t.weight > 0
                    of, to = t.order[real], to[real]
                    error[of] += ((t.points[real] - sent.value[i][to]) ** 2).sum(1)
                    placed = np.empty(len(ids), digits.dtype)
                    placed[of] = digits[to]
                    code = np.char.add(code, placed)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code.tolist(), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return mapped(trees, walk, "vec_id long, label string, code string, error long")


def whole(v: str, scale: int = SCALE):
    return F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(HELD))), F.lit(-float(HELD)))).cast("int"))


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], DataFrame | None]:
    """The codebooks of vectors (vec_id, label, x), and the written trees. No vectors, or a length that does not come out even: no codebooks."""
    by_id = [F.col("vec_id").asc_nulls_last(), "x"]
    first = vectors.orderBy(*by_id).limit(1).collect()
    dim = len(first[0]["x"]) if first else 0
    if not dim or dim % PARTS:
        return [], None
    fit = vectors.where(F.size("x") == dim)
    start = np.array([r["x"] for r in fit.orderBy(*by_id).limit(ENTRIES).select("x").collect()], np.int64)
    books = np.split(start, PARTS, axis=1)
    trees = forest(fit, dim)
    for _ in range(rounds):
        books = improve(trees, books)
    return books, trees


def compress(embeddings: DataFrame, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = embeddings.where(F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), whole("embedding", scale).alias("x"))
    books, trees = train(kept, rounds)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    none = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if books:
        coded = materialise(codes(trees, books).union(none.where(F.size("x") != books[0].shape[1] * PARTS)), "codes")
        discard(trees)
    else:
        coded = none
    per_label = coded.groupBy(F.col("label").alias("of")).agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error"))
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir):
    return compress(read(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    nearest = "(list_inner_product(c, c) - 2 * list_inner_product(v, c))"
    parts = [
        f"""v AS (SELECT vec_id, label, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS v FROM v, unnest(range({PARTS})) AS u(part))",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v AS c FROM p QUALIFY e < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):  # the lowest of the nearest entries: least score * ENTRIES + entry, exact in doubles
        parts.append(f"a{r} AS MATERIALIZED (SELECT p.vec_id, any_value(p.label) AS label, p.part, any_value(v) AS v, min({nearest} * {ENTRIES} + e) AS least FROM p JOIN b{r} AS b ON p.part = b.part GROUP BY p.vec_id, p.part)")
        parts.append(f"t{r} AS MATERIALIZED (SELECT vec_id, label, part, v, CAST(least - {ENTRIES} * floor(least / {ENTRIES}) AS BIGINT) AS e, floor(least / {ENTRIES}) + list_inner_product(v, v) AS d FROM a{r})")
        if r < ROUNDS:
            parts.append(f"m{r} AS (SELECT part, e, list(m ORDER BY j) AS c FROM (SELECT part, e, j, floor(sum(v[j]) / count(*)) AS m FROM t{r}, unnest(range(1, len(v) + 1)) AS u(j) GROUP BY part, e, j) GROUP BY part, e)")
            parts.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM b{r} AS b LEFT JOIN m{r} AS m ON b.part = m.part AND b.e = m.e)")
    parts.append(f"""c AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM t{ROUNDS} GROUP BY vec_id)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(c[j] AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, j)) FROM b{ROUNDS}, unnest(range(1, len(c) + 1)) AS u(j)) AS codebooks_sha256 FROM c"""  # fmt: skip


ORACLE = _oracle()

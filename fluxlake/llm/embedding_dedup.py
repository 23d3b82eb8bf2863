"""Near-duplicate embeddings by a random-projection tree forest.

Trees split recursively at random directions; points near a split fall on both
sides. A split that would part links widens its margin; a dense group within a node is set
apart by the cosine to its centre, and the rest goes on splitting; a node that is one dense
group is not split. Only thresholds are learned, from a bounded sample; every vector is
indexed. Vectors of one label that share a leaf of any tree are compared exactly,
in double precision, in blocks of bounded size, and links are united.

Equal vectors of one label are one class, so any number of copies is compared
once. A pair is counted in the first leaf that both share, so no pair is stored.

Defined cases: null label, null, empty or zero vectors and vectors with null or
non-finite components link with nothing; vectors of different lengths link with
nothing; repeated rows are vectors of their own and link; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, mapped, materialise
from .components import components

COSINE = 0.93
#: Vectors of the sample that sets the thresholds; trees; vectors aimed at in a leaf of one label; the share of a node's spread on either side of a split that goes both ways; directions to draw from; deepest tree.
SAMPLE, TREES, LEAF, SPILL, DIRECTIONS, DEEPEST = 20_000, 8, 400, 0.15, 256, 18
#: Vectors of a leaf that one task compares with as many others.
BLOCK = 1024
#: Splits must not cut dense groups: sample vectors of a node whose links are looked at, links needed to tell, share of them that a split may part, share of the node that may go both ways for that, directions tried before a group is set apart.
SEEN, TELLING, PARTED, BOTH, TRIES = 512, 32, 0.05, 0.35, 8
#: Groups that a forest sets apart, levels more for that, and the least share of a node on either side of such a split.
GROUPS, MORE, ASIDE = 64, 2, 0.02
#: Cosine to a group's centre at which it is set apart.
FAR = 0.75


@dataclass
class Forest:
    """For each tree the direction, threshold and margin of each node, in heap order."""

    directions: np.ndarray
    picks: np.ndarray
    cuts: np.ndarray
    margins: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf number) of every leaf of every tree that a row falls into."""
        p = x @ self.directions
        rows_out, leaves_out = [], []
        for t in range(len(self.picks)):
            rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                d = p[rows, self.picks[t, node]] - self.cuts[t, node]
                m = self.margins[t, node]
                left, right = d <= m, d >= -m
                rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            rows_out.append(rows)
            leaves_out.append(t * (1 << (self.depth + 1)) + node)
        return np.concatenate(rows_out), np.concatenate(leaves_out)


def _margin(v: np.ndarray, cut: float, a: np.ndarray, b: np.ndarray) -> float:
    """The least margin with which a split at `cut` parts no more than PARTED of the links a-b."""
    if len(a) < TELLING:
        return 0.0
    low, high = np.minimum(v[a], v[b]) - cut, np.maximum(v[a], v[b]) - cut
    return max(0.0, float(np.quantile(np.minimum(-low, high), 1 - PARTED)))  # a pair is parted by margins below this


def _centre(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The mean direction of the vector with the most links and of those it is linked with."""
    most = np.bincount(np.concatenate([a, b]), minlength=len(x)).argmax()
    c = x[np.unique(np.concatenate([[most], b[a == most], a[b == most]]))].sum(0)
    return c / np.linalg.norm(c)


def plant(sample: np.ndarray, size: int, dim: int, trees: int = TREES, seed: int = 5, threshold: float = COSINE) -> Forest:
    """Trees for `size` vectors of the most frequent label; the sample sets each node's median and spread, and where splitting ends."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(dim, DIRECTIONS))
    directions /= np.linalg.norm(directions, axis=0)
    depth = int(min(DEEPEST, max(0, np.ceil(np.log2(max(1, size) / LEAF)))))
    seen = rng.choice(len(sample), min(len(sample), 4 * SEEN), replace=False) if len(sample) else np.zeros(0, int)
    if depth and np.bincount(np.nonzero(sample[seen] @ sample[seen].T >= threshold)[0], minlength=1).max(initial=0) > ASIDE * len(seen) + TELLING:
        depth = min(DEEPEST, depth + MORE)  # a dense group: setting it apart takes levels
    nodes = (1 << depth) - 1
    picks = rng.integers(0, DIRECTIONS, (trees, max(1, nodes)), np.int16)
    cuts, margins = np.zeros(picks.shape, np.float32), np.zeros(picks.shape, np.float32)
    p = sample @ directions if len(sample) else np.zeros((0, DIRECTIONS))
    middle, spread = (np.median(p, 0), p.std(0)) if len(sample) else (np.zeros(DIRECTIONS), np.zeros(DIRECTIONS))
    for t in range(trees):
        inside = {0: np.arange(len(p))}
        for node in range(nodes):
            own = inside.pop(node)
            if node and np.isinf(cuts[t, (node - 1) // 2]):  # below a whole node
                cuts[t, node] = np.inf
            elif len(own) >= 8:
                seen = own if len(own) <= SEEN else rng.choice(own, SEEN, replace=False)
                a, b = np.nonzero(np.triu(sample[seen] @ sample[seen].T >= threshold, 1))
                for pick in (picks[t, node], *rng.integers(0, DIRECTIONS, TRIES - 1)):
                    v = p[own, pick]
                    cut = np.median(v)
                    margin = max(SPILL * v.std(), _margin(p[seen, pick], cut, a, b))
                    picks[t, node], cuts[t, node], margins[t, node] = pick, cut, margin
                    if len(a) < TELLING or (np.abs(v - cut) <= margin).mean() <= BOTH:
                        break
                else:
                    c = _centre(sample[seen], a, b)
                    v = sample[own] @ c
                    inside_ = v > FAR
                    if directions.shape[1] < DIRECTIONS + GROUPS and ASIDE <= inside_.mean() <= 1 - ASIDE:  # the group on one side, the rest, which goes on splitting, on the other
                        margin = _margin(sample[seen] @ c, FAR, a, b)
                        if (np.abs(v - FAR) <= margin).mean() <= BOTH:
                            directions, p = np.column_stack([directions, c]), np.column_stack([p, sample @ c])
                            picks[t, node], cuts[t, node], margins[t, node] = directions.shape[1] - 1, FAR, margin
                    if picks[t, node] < DIRECTIONS:  # all go left: the node stays whole
                        cuts[t, node], margins[t, node] = np.inf, 0.0
            else:  # too few to tell: as in the whole sample
                cuts[t, node], margins[t, node] = middle[picks[t, node]], SPILL * spread[picks[t, node]]
            v = p[own, picks[t, node]]
            inside[2 * node + 1], inside[2 * node + 2] = own[v <= cuts[t, node]], own[v > cuts[t, node]]
        if nodes and np.isinf(cuts[t, 0]):  # this tree alone compares all pairs
            return Forest(directions, picks[:1], cuts[:1], margins[:1], 0)
    return Forest(directions, picks, cuts, margins, depth)


def usable(v: str = "embedding"):
    """A vector that can link: no null or non-finite component, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(v).isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n points the smallest one that links lead to."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            break
        root = new
    return root


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one block pair: for each class its number of links counted here, and its root among them."""
    ids = table["id"].to_numpy()
    side, number, leaf = table["side"].to_numpy(), table["n"].to_numpy(), table["leaf"][0].as_py()
    order = np.lexsort([ids, side])
    ids, side, number = ids[order], side[order], number[order]
    column = table["embedding"].combine_chunks()
    x = _unit(column, len(column[0]))[order]
    lists = table["leaves"].combine_chunks()
    widths = np.diff(lists.offsets.to_numpy())[order]
    held = np.full((len(ids), int(widths.max())), -1, np.int64)
    starts = lists.offsets.to_numpy()[:-1][order]
    values = lists.values.to_numpy()
    for k in range(held.shape[1]):
        has = widths > k
        held[has, k] = values[starts[has] + k]
    split = int((side == 0).sum())
    two = table["two"][0].as_py()
    count = np.zeros(len(ids), np.int64)
    edges_a, edges_b = [], []
    left, right = (slice(0, split), slice(split, None)) if two else (slice(0, None), slice(0, None))
    # Vectors that share an earlier leaf were compared there: skip the pairs within the earlier leaf that most are in.
    earlier, often = np.unique(held[(held >= 0) & (held < leaf)], return_counts=True)
    known = (held == earlier[often.argmax()]).any(1) if len(earlier) else np.zeros(len(ids), bool)
    rows, others = np.arange(len(ids))[left], np.arange(len(ids))[right]
    chunks = [(r[k : k + 256], o) for r, o in ((rows[known[rows]], others[~known[others]]), (rows[~known[rows]], others)) for k in range(0, len(r), 256)]
    for r, o in chunks:
        i, j = np.nonzero(x[r] @ x[o].T >= threshold)
        i, j = r[i], o[j]
        if not two:
            i, j = i[i < j], j[i < j]
        else:
            i, j = i[ids[i] != ids[j]], j[ids[i] != ids[j]]
        edges_a.append(i)
        edges_b.append(j)
        for s in range(0, len(i), 50_000):
            a, b = i[s : s + 50_000], j[s : s + 50_000]
            ha, hb = held[a], held[b]
            first = np.ones(len(a), bool)  # no leaf before this one holds both
            for k in range(ha.shape[1]):
                v = ha[:, k : k + 1]
                first &= ~((v >= 0) & (v < leaf) & (hb == v)).any(1)
            np.add.at(count, a[first], number[b[first]])
            np.add.at(count, b[first], number[a[first]])
    a, b = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in (edges_a, edges_b))
    linked = np.zeros(len(ids), bool)
    linked[a] = linked[b] = True
    root = _roots(len(ids), a, b)
    return pa.table({"id": ids[linked], "links": count[linked], "root": ids[root[linked]]})


def links(classes: DataFrame, forest: Forest, dim: int, threshold: float = COSINE) -> DataFrame:
    """(id, links, root) rows of classes (id, n, label, embedding): partial counts of linked vectors and links to a root, one row for each class and block pair with a link."""
    shared = classes.sparkSession.sparkContext.broadcast(forest)  # at most TREES * 2**DEEPEST nodes of 10 bytes

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, leaf = shared.value.leaves(_unit(b.column(3), dim))
            order = np.lexsort([leaf, rows])
            leaf = leaf[order]
            bounds = np.searchsorted(rows[order], np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(leaf, pa.int64()))], names=["id", "n", "label", "embedding", "leaves"])

    indexed = materialise(mapped(classes.select("id", "n", "label", "embedding"), index, "id long, n long, label string, embedding array<double>, leaves array<long>"), "leaves")
    rows = indexed.select("*", F.explode("leaves").alias("leaf"))
    sizes = rows.groupBy("label", "leaf").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = rows.join(sizes, ["label", "leaf"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "leaf"), F.col("blocks").cast("long")).cast("int"))
    # Block pairs: a row meets every block of its leaf, as the left side of later blocks and the right side of earlier ones.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = own.select("id", "n", "label", "leaf", "leaves", "embedding", "block", other).select(
        "id", "n", "label", "leaf", "leaves", "embedding", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("block") != F.col("other")).alias("two"),
    )
    bounded(classes.sparkSession)
    return pairs.groupBy("label", "leaf", "i", "j").applyInArrow(lambda t: _compare(t, threshold), "id long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    can = F.coalesce(usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    keyed = v.select("vec_id", F.when(can, F.xxhash64("label", "embedding")).alias("h1"), F.when(can, F.xxhash64("embedding", "label", F.lit(1))).alias("h2"), F.when(can, F.col("label")).alias("label"), F.when(can, F.col("embedding")).alias("embedding"))
    # Classes of equal vectors, by a 128-bit key.
    classes = materialise(keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")), "classes")
    found = None
    for r in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect():  # vectors of one length are the rule
        dim = r["dim"]
        part = classes.where(F.size("embedding") == dim)
        most = part.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        chance = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
        sample = part.where(chance < min(1.0, SAMPLE / r["n"])).limit(2 * SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
        x = _unit(sample, dim) if len(sample) else np.zeros((0, dim))
        got = links(part, plant(x[np.lexsort(x.T)], most, dim, threshold=threshold), dim, threshold)
        found = got if found is None else found.union(got)
    if found is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found, "found")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    united = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("h1", "h2", "id", "n").join(counted, "id", "left").join(united, "id", "left")
    per_class = materialise(of_class.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")), "per-class")
    out = keyed.select("vec_id", "h1", "h2").join(per_class, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op9_embedding_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

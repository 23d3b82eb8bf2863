"""Stencils worked on tile by tile: halo exchange, computation in the padded tile, crop and stitch.

A frame is cut into cubes of C^3 points. Each cube sends the parts that its 26 neighbours need, a
halo of so many points, with wrap-around; a padded tile is put together by one shuffle of (C + 2
halo)^3 points a group. The stencil then looks into the padded tile only, and what it gives for the
cube's own points is the result. With a halo as wide as the stencil that equals the stencil of
the whole frame at every point; where the halo is narrower, what lies beyond counts as 0, as a padded network would have it.

Defined cases: a halo wider than a cube is refused; a frame that lacks a cube gives no tiles that need it; null
values make null results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import FIELD4, with_
from ..registry import query
from ..sources.chunks import cubes
from . import separable as S

#: Offsets (z, y, x) and weights.
LAPLACE = {(0, 0, 0): -6.0} | {tuple(s if i == a else 0 for i in range(3)): 1.0 for a in range(3) for s in (-1, 1)}
BOX = {o: 1.0 for o in product((-1, 0, 1), repeat=3)}
KEYS = ["case", "seed", "ord", "ch"]


def _slabs(c: int, halo: int):
    """For each neighbour (z, y, x): places in a cube that it needs, and where they lie in its padded tile."""
    p = c + 2 * halo
    # Seen from the neighbour in direction +1, a cube is what lies before it: its last points are that one's first.
    own = {0: [(i, i + halo) for i in range(c)], 1: [(i, i - c + halo) for i in range(c - halo, c)], -1: [(i, i + c + halo) for i in range(halo)]}
    for d in product((-1, 0, 1), repeat=3):
        axes = [own[s] for s in d]
        pairs = [((z[0] * c + y[0]) * c + x[0], (z[1] * p + y[1]) * p + x[1]) for z, y, x in product(*axes)]
        if pairs:
            yield d, pairs


def padded(tiles: DataFrame, n: int, c: int, halo: int) -> DataFrame:
    """(keys, chunk, values: (c + 2 halo)^3) of cubes (keys, chunk, values: c^3)."""
    if not 0 <= halo <= c:
        raise ValueError("a halo is at most as wide as a cube")
    m = n // c
    at = [F.floor(F.col("chunk") / (m * m)), F.floor(F.col("chunk") / m) % m, F.col("chunk") % m]
    # With few cubes on an axis several neighbours are the same cube, which gets one part.
    slabs: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for d, pairs in _slabs(c, halo):
        slabs.setdefault(tuple(s % m for s in d), []).extend(pairs)
    sent, places = [], []
    for d, pairs in slabs.items():
        z, y, x = (F.pmod(a + s, F.lit(m)) for a, s in zip(at, d, strict=True))
        part = F.transform(F.array(*(F.lit(i) for i, _ in pairs)), lambda i: F.get("values", i))
        sent.append(F.struct(((z * m + y) * m + x).cast("int").alias("chunk"), F.lit(len(sent)).alias("slab"), part.alias("part")))
        places += [j for _, j in pairs]
    moved = tiles.select(*KEYS, F.inline(F.array(*sent)))
    g = moved.groupBy(*KEYS, "chunk").agg(F.sort_array(F.collect_list(F.struct("slab", "part"))).alias("slabs")).where(F.size("slabs") == len(sent))
    # The order of the slabs says where their points lie.
    order = F.array(*(F.lit(int(i)) for i in np.argsort(places)))
    return g.select(*KEYS, "chunk", F.flatten("slabs.part").alias("points")).select(*KEYS, "chunk", F.transform(order, lambda i: F.get("points", i)).alias("values"))


def stencils(planes: DataFrame, n: int, c: int, halo: int, weights: dict[str, dict[tuple[int, int, int], float]]) -> DataFrame:
    """(keys, z, y, x) and for each name the weighted sum of each point's neighbours, by tiles of planes (keys, z, values). All stencils look into the same padded tile."""
    p, m = c + 2 * halo, n // c
    tiles = padded(cubes(planes, n, c), n, c, halo).select(*KEYS, "chunk", F.col("values").cast("array<double>").alias("values"))
    own = np.indices((c, c, c)).reshape(3, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 2**18 // p**3 + 1) for x in batches for i in range(0, x.num_rows, 2**18 // p**3 + 1)):
            flat = b.column(len(KEYS) + 1).flatten()
            v, there = (x.to_numpy(zero_copy_only=False).reshape(-1, p**3) for x in (flat.fill_null(0.0), flat.is_valid()))
            out = b.columns[: len(KEYS) + 1]
            for w in weights.values():
                total, known = np.zeros((b.num_rows, c**3)), np.ones((b.num_rows, c**3), bool)
                for offset, factor in sorted(w.items()):
                    at = own + halo + np.array(offset)[:, None]
                    inside = ((at >= 0) & (at < p)).all(0)
                    place = np.ravel_multi_index(at[:, inside], (p, p, p))
                    total[:, inside] += v[:, place] * factor
                    known[:, inside] &= there[:, place]
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * c**3, pa.int32()), pa.array(total.ravel(), mask=~known.ravel())))
            yield pa.RecordBatch.from_arrays(out, names=[*KEYS, "chunk", *weights])

    kept = [*KEYS, "chunk"]
    types = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in tiles.select(*kept).schema), *(f"{name} array<double>" for name in weights)])
    points = tiles.mapInArrow(run, types).select(*kept, F.posexplode(F.arrays_zip(*weights)).alias("i", "v"))
    i, chunk = F.col("i"), F.col("chunk")
    z, y, x = F.floor(chunk / (m * m)) * c + F.floor(i / (c * c)), F.floor(chunk / m) % m * c + F.floor(i / c) % c, chunk % m * c + i % c
    return points.select(*KEYS, z.cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"), *(F.col(f"v.{name}").alias(name) for name in weights))


def stencil(planes: DataFrame, n: int, c: int, halo: int, weights: dict[tuple[int, int, int], float]) -> DataFrame:
    """(keys, z, y, x, value) of one stencil."""
    return stencils(planes, n, c, halo, {"value": weights})


# --- queries


def _planes(spark, sf_dir, n: int) -> DataFrame:
    return S.planes_of(spark, sf_dir, n).select(F.lit("c").alias("case"), F.lit(0).alias("seed"), F.col("frame").cast("int").alias("ord"), "ch", "z", "values")


_F8 = """w8 AS (SELECT CAST(vec_id // 32 AS INTEGER) AS frame, CAST((vec_id // 8) % 4 AS INTEGER) AS ch, CAST(vec_id % 8 AS INTEGER) AS z, CAST((pos - 1) // 8 AS INTEGER) AS y, CAST((pos - 1) % 8 AS INTEGER) AS x,
    CAST(floor(CAST(embedding[pos] AS DOUBLE) * 1e6 + 0.5) AS BIGINT) AS q FROM embeddings, unnest(range(1, 65)) AS u(pos)),
  f8 AS (SELECT * FROM w8 QUALIFY count(*) OVER (PARTITION BY frame, ch) = 512)"""


def _around(table: str, n: int) -> str:
    """The sum over the six neighbours less six times the point, and over all 27."""
    wrap = " AND ".join(f"(b.{a} - a.{a} + {n + 1}) % {n} < 3" for a in "zyx")
    near = " + ".join(f"CAST(b.{a} <> a.{a} AS INTEGER)" for a in "zyx")
    return f"SELECT a.frame, a.ch, a.z, a.y, a.x, CAST(sum(CASE {near} WHEN 0 THEN -6 * b.q WHEN 1 THEN b.q ELSE 0 END) AS BIGINT) AS laplace, CAST(sum(b.q) AS BIGINT) AS box FROM {table} a JOIN {table} b ON b.frame = a.frame AND b.ch = a.ch AND {wrap} GROUP BY ALL"


def _both(spark, sf_dir, n: int, c: int) -> DataFrame:
    d = stencils(_planes(spark, sf_dir, n), n, c, 1, {"laplace": LAPLACE, "box": BOX})
    return d.select(F.col("ord").alias("frame"), "ch", "z", "y", "x", F.col("laplace").cast("long").alias("laplace"), F.col("box").cast("long").alias("box"))


@query("tile_stencil_n8", f"WITH {_F8} {_around('f8', 8)}")
def tile_stencil_n8(spark, sf_dir):
    """Two stencils by tiles of 4^3 points with a halo of one, stitched."""
    return _both(spark, sf_dir, 8, 4)


@query("tile_stencil_n4", with_(FIELD4, "f4 AS (SELECT CAST(frame AS INTEGER) AS frame, ch, z, y, x, q FROM field4)", rest=_around("f4", 4)))
def tile_stencil_n4(spark, sf_dir):
    """The same by tiles of 2^3 points, whose halo is half a tile."""
    return _both(spark, sf_dir, 4, 2)

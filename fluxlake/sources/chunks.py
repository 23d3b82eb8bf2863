"""A chunked frame store and reads of periodic sub-boxes from it.

A frame of N x N x N points is kept as cubes of C x C x C points, a row for each channel and cube,
in Parquet partitioned by case, seed and chunk (the cube's number, x fastest), and sorted by
ordinal in each file. A box is turned into the numbers of the cubes that it touches, on
each axis with wrap-around, so other cubes' folders are never listed into a scan, and row groups
of other ordinals are passed over by their statistics. Points outside the box are cut off within each
cube's array before anything is exploded or shuffled.

Defined cases: a box may begin anywhere, negative origins included, and wraps on every axis; a box
larger than the frame is refused, as is a store whose attributes do not say that it is complete;
a frame that lacks a channel or cube gives points of those it has, and no packed box; null values
stay null; an empty store has no rows.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import table
from ..operators.separable import planes_of
from ..registry import query
from .stores import shared_path

FRAMES = "ord int, ch int, values array<double>, case string, seed int, chunk int"


def cubes(planes: DataFrame, n: int, c: int) -> DataFrame:
    """(case, seed, ord, ch, chunk, values) of planes (case, seed, ord, ch, z, values: n x n). A group holds c tiles of c x c points."""
    if n % c:
        raise ValueError("cubes must fill the frame")
    m = n // c
    tile = lambda y, x: F.transform(F.sequence(F.lit(0), F.lit(c * c - 1)), lambda i: F.element_at("values", ((y * c + F.floor(i / c)) * n + x * c + i % c + 1).cast("int")))
    keys = ["case", "seed", "ord", "ch"]
    tiles = planes.select(*keys, F.floor(F.col("z") / c).cast("int").alias("cz"), (F.col("z") % c).alias("dz"), F.explode(F.array(*(F.struct(F.lit(y * m + x).alias("at"), tile(y, x).alias("tile")) for y, x in product(range(m), repeat=2)))).alias("t"))
    chunk = (F.col("cz") * m * m + F.col("t.at")).cast("int")
    packed = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("dz", "t.tile"))), lambda s: s["tile"]))
    return tiles.groupBy(*keys, chunk.alias("chunk")).agg(packed.alias("values")).where(F.size("values") == c**3)


def write_chunks(planes: DataFrame, path: str, n: int, c: int, channels: list[str]) -> None:
    """The store of planes (case, seed, ord, ch, z, values); its attributes, with the completion mark, last."""
    rows = cubes(planes, n, c).select("ord", "ch", "values", "case", "seed", "chunk")
    # A partition's rows meet in a few tasks: files are large, and hot partitions are dealt into several.
    rows.hint("rebalance", "case", "seed", "chunk").sortWithinPartitions("case", "seed", "chunk", "ord", "ch").write.partitionBy("case", "seed", "chunk").parquet(f"{path}/frames")
    planes.sparkSession.createDataFrame([(True, n, c, channels)], "complete boolean, n int, c int, channels array<string>").coalesce(1).write.parquet(f"{path}/attrs")


class ChunkStore:
    """A complete store at a path."""

    def __init__(self, spark: SparkSession, path: str):
        try:
            self.attrs = spark.read.parquet(f"{path}/attrs").first()
        except Exception as e:
            raise ValueError(f"the store at {path} has no attributes") from e
        if self.attrs is None or not self.attrs["complete"]:
            raise ValueError(f"the store at {path} is not complete")
        self.spark, self.path, self.n, self.c, self.channels = spark, path, self.attrs["n"], self.attrs["c"], self.attrs["channels"]

    def rows(self) -> DataFrame:
        return self.spark.read.schema(FRAMES).parquet(f"{self.path}/frames")

    def touched(self, origin: tuple[int, int, int], size: tuple[int, int, int]) -> list[int]:
        """Numbers of the cubes that a periodic box touches."""
        if any(not 0 < s <= self.n for s in size):
            raise ValueError(f"a box of {size} does not fit into {self.n} points an axis")
        m = self.n // self.c
        axes = [sorted({(o + i) % self.n // self.c for i in range(s)}) for o, s in zip(origin, size, strict=True)]
        return [z * m * m + y * m + x for z, y, x in product(*axes)]

    def cropped(self, rows: DataFrame, origin: list[Column], size: tuple[int, int, int]) -> DataFrame:
        """Rows with `cut`: of each cube the points in the box, (place in the box in C order, value)."""
        n, c, m = self.n, self.c, self.n // self.c
        shift = lambda i, d, per, o: F.pmod(F.floor(F.col("chunk") / (per * per if d == 0 else per if d == 1 else 1)) % m * c + F.floor(i / (c * c if d == 0 else c if d == 1 else 1)) % c - o, F.lit(n))

        def placed(value: Column, i: Column) -> Column:
            z, y, x = (shift(i, d, m, o) for d, o in enumerate(origin))
            inside = (z < size[0]) & (y < size[1]) & (x < size[2])
            return F.struct(F.when(inside, (z * size[1] + y) * size[2] + x).cast("int").alias("at"), value.alias("value"))

        return rows.withColumn("cut", F.filter(F.transform("values", placed), lambda s: s["at"].isNotNull())).drop("values")

    def box(self, origin: tuple[int, int, int], size: tuple[int, int, int], case: str | None = None, seeds: list[int] | None = None, ords: list[int] | None = None) -> DataFrame:
        """(case, seed, ord, ch, z, y, x, value) of a box, coordinates within it. Only the cubes it touches are opened."""
        rows = self.rows().where(F.col("chunk").isin(self.touched(origin, size)))
        for column, asked in (("case", None if case is None else [case]), ("seed", seeds), ("ord", ords)):
            if asked is not None:
                rows = rows.where(F.col(column).isin(asked))
        cut = self.cropped(rows, [F.lit(o) for o in origin], size).select("case", "seed", "ord", "ch", F.explode("cut").alias("p"))
        at = F.col("p.at")
        return cut.select("case", "seed", "ord", "ch", F.floor(at / (size[1] * size[2])).cast("int").alias("z"), (F.floor(at / size[2]) % size[1]).cast("int").alias("y"), (at % size[2]).cast("int").alias("x"), "p.value")

    def frame(self, case: str, seed: int, ordinal: int) -> DataFrame:
        """All points of one frame."""
        return self.box((0, 0, 0), (self.n,) * 3, case, [seed], [ordinal])

    def patches(self, requests: DataFrame, size: tuple[int, int, int]) -> DataFrame:
        """A packed box for each request (case, seed, ord, oz, oy, ox) and channel: the request's columns, ch and values in C order. Requests meet cubes in an equi-join on frame and cube; a patch that lacks a point is left out."""
        self.touched((0, 0, 0), size)
        n, c, m = self.n, self.c, self.n // self.c
        on = lambda o, s: F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(s - 1)), lambda i: F.floor(F.pmod(F.col(o) + i, F.lit(n)) / c).cast("int")))
        z, y, x = (on(o, s) for o, s in zip(("oz", "oy", "ox"), size, strict=True))
        numbers = F.flatten(F.flatten(F.transform(z, lambda a: F.transform(y, lambda b: F.transform(x, lambda d: a * m * m + b * m + d)))))
        asked = requests.select("case", "seed", "ord", "oz", "oy", "ox").distinct().withColumn("chunk", F.explode(numbers))
        met = self.cropped(self.rows().join(asked, ["case", "seed", "ord", "chunk"]), [F.col(o) for o in ("oz", "oy", "ox")], size)
        boxes = met.groupBy("case", "seed", "ord", "oz", "oy", "ox", "ch").agg(F.sort_array(F.flatten(F.collect_list("cut"))).alias("cut")).where(F.size("cut") == size[0] * size[1] * size[2])
        return boxes.withColumn("values", F.transform("cut", lambda s: s["value"])).drop("cut")


# --- queries: frames of 8 points an axis from `embeddings`, in cubes of 4


def _store(spark, sf_dir) -> ChunkStore:
    path = shared_path(spark, "chunks")
    p = planes_of(spark, sf_dir, 8).select(F.lit("c").alias("case"), (F.col("frame") % 5).cast("int").alias("seed"), F.floor(F.col("frame") / 5).cast("int").alias("ord"), "ch", "z", "values")
    write_chunks(p, path, 8, 4, ["u", "v", "w", "p"])
    return ChunkStore(spark, path)


# Cubes that lack planes are not written.
_F8 = """whole AS (SELECT vec_id // 32 % 5 AS seed, vec_id // 32 // 5 AS ord, CAST((vec_id // 8) % 4 AS INTEGER) AS ch, CAST(vec_id % 8 AS INTEGER) AS z, CAST((pos - 1) // 8 AS INTEGER) AS y, CAST((pos - 1) % 8 AS INTEGER) AS x,
    CAST(floor(CAST(embedding[pos] AS DOUBLE) * 1e6 + 0.5) AS BIGINT) AS q FROM embeddings, unnest(range(1, 65)) AS u(pos)),
  f8 AS (SELECT * FROM whole QUALIFY count(*) OVER (PARTITION BY seed, ord, ch, z // 4) = 256)"""
_BOX = "(z - ({0}) + 16) % 8 AS z, (y - ({1}) + 16) % 8 AS y, (x - ({2}) + 16) % 8 AS x"


@query("chunk_box_wrapped", f"WITH {_F8}, b AS (SELECT seed, ord, ch, {_BOX.format(6, -1, 5)}, q FROM f8) SELECT CAST(seed AS INTEGER) AS seed, CAST(ord AS INTEGER) AS ord, ch, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, q FROM b WHERE z < 4 AND y < 3 AND x < 5")
def chunk_box_wrapped(spark, sf_dir):
    """A box that wraps on all three axes, of every frame."""
    return _store(spark, sf_dir).box((6, -1, 5), (4, 3, 5)).select("seed", "ord", "ch", "z", "y", "x", F.col("value").cast("long").alias("q"))


@query("chunk_frames_of_seed", f"WITH {_F8} SELECT CAST(ord AS INTEGER) AS ord, ch, z, y, x, q FROM f8 WHERE seed = 2")
def chunk_frames_of_seed(spark, sf_dir):
    """All frames of one seed; the other seeds' folders are not read."""
    s = _store(spark, sf_dir)
    return s.box((0, 0, 0), (8, 8, 8), "c", [2]).select("ord", "ch", "z", "y", "x", F.col("value").cast("long").alias("q"))


@query("chunk_patches", f"""WITH {_F8}, r AS (SELECT DISTINCT vec_id // 32 % 5 AS seed, vec_id // 32 // 5 AS ord, CAST(vec_id % 11 - 2 AS INTEGER) AS oz, CAST(vec_id % 7 AS INTEGER) AS oy, CAST(vec_id % 13 AS INTEGER) AS ox FROM embeddings WHERE label % 3 = 0),
  b AS (SELECT r.*, ch, {_BOX.format("oz", "oy", "ox").replace("+ 16", "+ 32")}, q FROM r JOIN f8 USING (seed, ord))
  SELECT CAST(seed AS INTEGER) AS seed, CAST(ord AS INTEGER) AS ord, oz, oy, ox, ch, CAST(sum(q) AS BIGINT) AS total, CAST(sum(q * ((z * 3 + y) * 3 + x + 1)) AS BIGINT) AS placed FROM b WHERE z < 3 AND y < 3 AND x < 3 GROUP BY ALL HAVING count(*) = 27""")
def chunk_patches(spark, sf_dir):
    """Boxes of 3 x 3 x 3 points at many origins, by an equi-join with the frames they ask for; a weighted sum shows every point's place."""
    e = table(spark, sf_dir, "embeddings").where("label % 3 = 0")
    v = F.col("vec_id")
    frame = F.floor(v / 32)
    asked = e.select(F.lit("c").alias("case"), (frame % 5).cast("int").alias("seed"), F.floor(frame / 5).cast("int").alias("ord"), (v % 11 - 2).cast("int").alias("oz"), (v % 7).cast("int").alias("oy"), (v % 13).cast("int").alias("ox"))
    p = _store(spark, sf_dir).patches(asked, (3, 3, 3))
    placed = F.aggregate(F.transform("values", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return p.select("seed", "ord", "oz", "oy", "ox", "ch", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"), placed.cast("long").alias("placed"))

"""Splits, slices, samples, windows and patches: all pure metadata, keyed by (case, seed, ordinal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import FIELD4, PER_SEED, RUN_TS, field4, per_seed, run_ts, with_
from ..model import q
from ..registry import query


def split_by_ic(manifest: DataFrame, train: int = 6, val: int = 1) -> DataFrame:
    """Whole trajectories by sorted seed: the first to train, the next to val, all others to test; `degraded` if a case leaves val or test empty."""
    r = F.row_number().over(Window.partitionBy("case").orderBy("seed"))
    part = F.when(F.col("r") <= train, "train").when(F.col("r") <= train + val, "val").otherwise("test")
    rows = manifest.withColumn("r", r)
    n = manifest.groupBy("case").agg(F.count("*").alias("n"))
    return rows.join(n, "case").select("case", "seed", "frames", part.alias("part"), (F.col("n") <= train + val).alias("degraded"))


_R = 'r AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY seed) AS r, count(*) OVER (PARTITION BY "case") AS n FROM per_seed)'
_PART = "CASE WHEN r <= 6 THEN 'train' WHEN r <= 7 THEN 'val' ELSE 'test' END"


@query("split_by_ic", with_(PER_SEED, _R, rest=f'SELECT "case", seed, frames, {_PART} AS part, n <= 7 AS degraded FROM r'))
def q_split_by_ic(spark, sf_dir):
    return split_by_ic(per_seed(spark, sf_dir))


@query("split_summary", with_(PER_SEED, _R, rest=f'SELECT coalesce("case", \'TOTAL\') AS "case", {_PART} AS part, count(*) AS seeds, CAST(sum(frames) AS BIGINT) AS frames FROM r GROUP BY GROUPING SETS (("case", {_PART}), ({_PART}))'))
def split_summary(spark, sf_dir):
    """Seeds and frames of each part by case, and the totals, as a rollup."""
    s = split_by_ic(per_seed(spark, sf_dir)).rollup("part", "case").agg(F.count("*").alias("seeds"), F.sum("frames").alias("frames"))
    return s.where("part is not null").select(F.coalesce("case", F.lit("TOTAL")).alias("case"), "part", "seeds", "frames")


@query("split_degraded", with_(PER_SEED, _R, rest='SELECT "case", count(*) AS n FROM r WHERE r <= 7 AND seed < 7 GROUP BY "case"'))
def split_degraded(spark, sf_dir):
    """Cases with too few seeds for a test part, of a manifest cut to seven seeds."""
    d = split_by_ic(per_seed(spark, sf_dir).where("seed < 7"))
    return d.where("degraded").groupBy("case").agg(F.count("*").alias("n"))


def split_cases(manifest: DataFrame, train: list[str], test: list[str], excluded: list[str] = ()) -> DataFrame:
    """Whole-case split: training cases by seed into train and val, unseen cases to test; cases in neither list are left out, listed ones in `excluded` marked."""
    s = split_by_ic(manifest)
    where = F.when(F.col("case").isin(*excluded), "excluded") if excluded else F.when(F.lit(False), "")
    part = where.when(F.col("case").isin(*train), F.when(F.col("part") == "test", "val").otherwise(F.col("part"))).when(F.col("case").isin(*test), "test")
    return s.select("case", "seed", part.alias("part")).where("part is not null")


def _sql_cases(train: str, test: str, excluded: str = "''") -> str:
    return with_(PER_SEED, _R, rest=f"""SELECT * FROM (SELECT "case", seed, CASE WHEN "case" IN ({excluded}) THEN 'excluded' WHEN "case" IN ({train}) THEN CASE WHEN r <= 6 THEN 'train' ELSE 'val' END
  WHEN "case" IN ({test}) THEN 'test' END AS part FROM r) WHERE part IS NOT NULL""")


@query("split_ood", _sql_cases("'AUTOMOBILE', 'BUILDING', 'FURNITURE'", "'HOUSEHOLD', 'MACHINERY'"))
def split_ood(spark, sf_dir):
    return split_cases(per_seed(spark, sf_dir), ["AUTOMOBILE", "BUILDING", "FURNITURE"], ["HOUSEHOLD", "MACHINERY"])


@query("split_g3", _sql_cases("'AUTOMOBILE', 'BUILDING'", "'FURNITURE'"))
def split_g3(spark, sf_dir):
    """Forcing scales seen in training against one unseen."""
    return split_cases(per_seed(spark, sf_dir), ["AUTOMOBILE", "BUILDING"], ["FURNITURE"])


@query("split_g4", _sql_cases("'AUTOMOBILE', 'FURNITURE'", "'HOUSEHOLD'", "'BUILDING'"))
def split_g4(spark, sf_dir):
    """Forced cases to decaying ones, some forced cases excluded."""
    return split_cases(per_seed(spark, sf_dir), ["AUTOMOBILE", "FURNITURE"], ["HOUSEHOLD"], ["BUILDING"])


@query("split_g5", _sql_cases("'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD'", "'MACHINERY'"))
def split_g5(spark, sf_dir):
    """Isotropic cases to one with other physics."""
    return split_cases(per_seed(spark, sf_dir), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"], ["MACHINERY"])


def zscore(column: str, key: str) -> Column:
    """z within the key's rows: population deviation of the known values, 1 if that is 0; unknown values, and keys with fewer than two known, give 0."""
    w = Window.partitionBy(key)
    sd = F.stddev_pop(column).over(w)
    z = (F.col(column) - F.avg(column).over(w)) / F.when(sd == 0, 1.0).otherwise(sd)
    return F.when(F.count(column).over(w) < 2, 0.0).otherwise(F.coalesce(z, F.lit(0.0)))


def quality(manifest: DataFrame) -> DataFrame:
    """Composite z-score of resolution (good) and drift (bad), rounded to a billionth so that ranks do not hang on the last bit."""
    return manifest.withColumn("qq", q(zscore("k_max_eta", "case") - 0.5 * zscore("drift", "case"), 1e9))


_Z = """z AS (SELECT *, CASE WHEN count(k_max_eta) OVER w < 2 THEN 0 ELSE coalesce((k_max_eta - avg(k_max_eta) OVER w) / CASE WHEN stddev_pop(k_max_eta) OVER w = 0 THEN 1 ELSE stddev_pop(k_max_eta) OVER w END, 0) END AS z1,
  CASE WHEN count(drift) OVER w < 2 THEN 0 ELSE coalesce((drift - avg(drift) OVER w) / CASE WHEN stddev_pop(drift) OVER w = 0 THEN 1 ELSE stddev_pop(drift) OVER w END, 0) END AS z2
  FROM per_seed WINDOW w AS (PARTITION BY "case")),
qq AS (SELECT *, CAST(floor((z1 - 0.5 * z2) * 1e9 + 0.5) AS BIGINT) AS qq FROM z),
p AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY qq DESC, seed) AS rank FROM qq)"""


def slice_quality(manifest: DataFrame, train: int = 3, val: int = 1, test: int = 3) -> DataFrame:
    """The best trajectories of each case by quality, ties by seed: train, then val, then test."""
    r = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("qq"), "seed"))
    ranked = quality(manifest).withColumn("rank", r).where(F.col("rank") <= train + val + test)
    return ranked.select("case", "seed", "rank", F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + val, "val").otherwise("test").alias("part"))


@query("slice_quality", with_(PER_SEED, _Z, rest="""SELECT "case", seed, CAST(rank AS INTEGER) AS rank, CASE WHEN rank <= 3 THEN 'train' WHEN rank <= 4 THEN 'val' ELSE 'test' END AS part FROM p WHERE rank <= 7"""))
def q_slice_quality(spark, sf_dir):
    return slice_quality(per_seed(spark, sf_dir))


@query("slice_pool", with_(PER_SEED, """f AS (SELECT "case", count(*) FILTER (frames >= 60) AS n_full, count(*) FILTER (frames >= 40) AS n_usable FROM per_seed GROUP BY "case")""",
       rest="""SELECT "case", seed, CASE WHEN n_full >= 7 THEN 'full' WHEN n_usable >= 7 THEN 'usable' ELSE 'all' END AS pool FROM per_seed JOIN f USING ("case") WHERE CASE WHEN n_full >= 7 THEN frames >= 60 WHEN n_usable >= 7 THEN frames >= 40 ELSE TRUE END"""))
def slice_pool(spark, sf_dir):
    """The pool a case draws from: full runs if there are enough, else usable ones, else all."""
    m = per_seed(spark, sf_dir)
    n = m.groupBy("case").agg(F.count_if(F.col("frames") >= 60).alias("n_full"), F.count_if(F.col("frames") >= 40).alias("n_usable"))
    pool = F.when(F.col("n_full") >= 7, "full").when(F.col("n_usable") >= 7, "usable").otherwise("all")
    least = F.when(F.col("pool") == "full", 60).when(F.col("pool") == "usable", 40).otherwise(0)
    return m.join(n, "case").withColumn("pool", pool).where(F.col("frames") >= least).select("case", "seed", "pool")


@query("slice_live_terms", with_(PER_SEED, _Z, rest="""SELECT "case", max(abs(z1)) > 1e-12 AS k_max_eta, max(abs(z2)) > 1e-12 AS drift FROM z GROUP BY "case" """))
def slice_live_terms(spark, sf_dir):
    """Quality terms that tell any trajectories apart."""
    z = per_seed(spark, sf_dir).select("case", zscore("k_max_eta", "case").alias("a"), zscore("drift", "case").alias("b"))
    return z.groupBy("case").agg((F.max(F.abs("a")) > 1e-12).alias("k_max_eta"), (F.max(F.abs("b")) > 1e-12).alias("drift"))


@query("slice_disjoint", with_(PER_SEED, rest='SELECT "case", 0::BIGINT AS shared FROM per_seed GROUP BY "case"'))
def slice_disjoint(spark, sf_dir):
    """Trajectories in more than one part: none."""
    s = slice_quality(per_seed(spark, sf_dir))
    n = s.groupBy("case", "seed").agg(F.count_distinct("part").alias("n"))
    return n.groupBy("case").agg(F.count_if(F.col("n") > 1).alias("shared"))


@query("slice_regression_guard", with_(PER_SEED, rest='SELECT DISTINCT "case" FROM per_seed WHERE "case" NOT IN (SELECT "case" FROM per_seed GROUP BY "case" HAVING max(seed) >= 15 AND min(frames) >= 8)'))
def slice_regression_guard(spark, sf_dir):
    """Cases scored before that a new slice would lose (an anti join)."""
    m = per_seed(spark, sf_dir)
    new = m.groupBy("case").agg(F.max("seed").alias("s"), F.min("frames").alias("f")).where("s >= 15 and f >= 8")
    return m.select("case").distinct().join(new, "case", "left_anti")


def windows(frames: DataFrame, need: int, stride: int) -> DataFrame:
    """Starts of sliding windows of `need` frames, every `stride` frames, that fit into their seed."""
    n = frames.groupBy("seed").agg(F.max("ord").alias("last"))
    return frames.join(n, "seed").where((F.col("ord") % stride == 0) & (F.col("ord") + need - 1 <= F.col("last"))).select("seed", F.col("ord").alias("start"))


_WIN = "n AS (SELECT seed, max(ord) AS last FROM run_ts GROUP BY seed), win AS (SELECT seed, ord AS start FROM run_ts JOIN n USING (seed) WHERE ord % 8 = 0 AND ord + 20 <= last)"


@query("win_sliding", with_(RUN_TS, _WIN, rest="SELECT seed, start FROM win"))
def win_sliding(spark, sf_dir):
    return windows(run_ts(spark, sf_dir), 21, 8)


@query("win_valid_no_splice", with_(RUN_TS, _WIN, "d AS (SELECT seed, ord, t_us - lag(t_us) OVER (PARTITION BY seed ORDER BY ord) AS dt FROM run_ts)", "m AS (SELECT median(dt) AS med FROM d)",
       rest="SELECT win.seed, start FROM win JOIN d ON d.seed = win.seed AND d.ord BETWEEN start + 1 AND start + 20, m GROUP BY win.seed, start, med HAVING max(dt) <= 3 * med"))
def win_valid_no_splice(spark, sf_dir):
    """Windows without a step longer than three times the case's median step."""
    r = run_ts(spark, sf_dir)
    w = Window.partitionBy("seed").orderBy("ord")
    d = r.withColumn("dt", F.col("t_us") - F.lag("t_us").over(w))
    ahead = d.withColumn("longest", F.max("dt").over(w.rowsBetween(1, 20)))
    med = d.agg(F.median("dt").alias("med"))
    fits = windows(r, 21, 8).withColumnRenamed("start", "ord")
    return ahead.join(fits, ["seed", "ord"]).crossJoin(F.broadcast(med)).where("longest <= 3 * med").select("seed", F.col("ord").alias("start"))


@query("win_pairs", with_(RUN_TS, rest="SELECT seed, ord, lead(ord) OVER (PARTITION BY seed ORDER BY ord) AS next, c, lead(c) OVER (PARTITION BY seed ORDER BY ord) AS c_next FROM run_ts QUALIFY next IS NOT NULL"))
def win_pairs(spark, sf_dir):
    w = Window.partitionBy("seed").orderBy("ord")
    return run_ts(spark, sf_dir).select("seed", "ord", F.lead("ord").over(w).alias("next"), "c", F.lead("c").over(w).alias("c_next")).where("next is not null")


@query("win_collect", with_(RUN_TS, rest="SELECT seed, start, CAST(sum(c) AS BIGINT) AS c_sum, count(*) AS n FROM (SELECT r.seed, r.ord AS start, s.c FROM run_ts r JOIN run_ts s ON s.seed = r.seed AND s.ord BETWEEN r.ord AND r.ord + 4 WHERE r.ord % 5 = 0) GROUP BY ALL HAVING count(*) = 5"))
def win_collect(spark, sf_dir):
    """Window samples as arrays of the frames themselves."""
    w = Window.partitionBy("seed").orderBy("ord").rowsBetween(0, 4)
    s = run_ts(spark, sf_dir).select("seed", F.col("ord").alias("start"), F.collect_list("c").over(w).alias("cs")).where("start % 5 = 0 and size(cs) = 5")
    return s.select("seed", "start", F.aggregate("cs", F.lit(0).cast("long"), lambda a, x: a + x).alias("c_sum"), F.size("cs").cast("long").alias("n"))


@query("win_first_n_base", with_(RUN_TS, rest="SELECT seed, start, patch FROM (SELECT seed, ord AS start, dense_rank() OVER (ORDER BY seed, ord) AS r FROM run_ts WHERE ord % 8 = 0) s, range(0, 8) AS g(patch) WHERE r <= 51"))
def win_first_n_base(spark, sf_dir):
    """The first 51 distinct base samples with all their patches: top-k first, patches after."""
    base = run_ts(spark, sf_dir).where("ord % 8 = 0").orderBy("seed", "ord").limit(51)
    return base.select("seed", F.col("ord").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<long>")).alias("patch"))


def equidistant(frames: DataFrame, m: int) -> DataFrame:
    """linspace(0, n - 1, min(m, n)), truncated, of each seed."""
    n = frames.groupBy("seed").agg(F.count("*").alias("n"))
    k = F.least(F.col("n"), F.lit(m))
    i = n.select("seed", "n", k.alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("i"))
    at = F.when(F.col("k") == 1, 0).when(F.col("i") == F.col("k") - 1, F.col("n") - 1).otherwise((F.col("i") * ((F.col("n") - 1) / (F.col("k") - 1))).cast("long"))
    return i.select("seed", at.cast("long").alias("ord"))


@query("pick_equidistant", with_(RUN_TS, rest="SELECT seed, CAST(CASE WHEN i = 4 THEN n - 1 ELSE trunc(i * ((n - 1)::DOUBLE / 4)) END AS BIGINT) AS ord FROM (SELECT seed, count(*) AS n FROM run_ts GROUP BY seed), range(0, 5) AS g(i)"))
def pick_equidistant(spark, sf_dir):
    return equidistant(run_ts(spark, sf_dir), 5)


@query("pick_strided", with_(RUN_TS, "n AS (SELECT seed, count(*) AS n FROM run_ts GROUP BY seed)", rest="SELECT seed, ord FROM run_ts JOIN n USING (seed) WHERE ord % greatest(1, n // 8) = 0 AND ord // greatest(1, n // 8) < 8"))
def pick_strided(spark, sf_dir):
    r = run_ts(spark, sf_dir)
    n = r.groupBy("seed").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 8)).alias("step"))
    return r.join(n, "seed").where("ord % step = 0 and ord < 8 * step").select("seed", "ord")


def patches(spark, n: int, p: int) -> DataFrame:
    """Patch ids of a cubic grid and their origins."""
    g = n // p
    i = spark.range(g * g * g)
    at = lambda d: (F.floor(F.col("id") / d) % g * p).cast("int")
    return i.select(F.col("id").alias("patch"), at(g * g).alias("z0"), at(g).alias("y0"), at(1).alias("x0"))


@query("crop_periodic", with_(FIELD4, rest="SELECT frame, CAST((z + 4 - 3) % 4 AS INTEGER) AS dz, CAST((y + 4 - 2) % 4 AS INTEGER) AS dy, x AS dx, q FROM field4 WHERE ch = 0 AND (z + 4 - 3) % 4 < 2 AND (y + 4 - 2) % 4 < 2 AND x < 2"))
def crop_periodic(spark, sf_dir):
    """A 2x2x2 crop at (3, 2, 0) of each field, which wraps round."""
    d = lambda c, o: F.pmod(F.col(c) - o, F.lit(4)).cast("int")
    f = field4(spark, sf_dir).where("ch = 0").select("frame", d("z", 3).alias("dz"), d("y", 2).alias("dy"), d("x", 0).alias("dx"), "q")
    return f.where("dz < 2 and dy < 2 and dx < 2")


@query("tile_stitch", with_(FIELD4, rest="SELECT frame, ch, CAST(sum(q) AS BIGINT) AS total, count(*) AS n FROM field4 GROUP BY ALL"))
def tile_stitch(spark, sf_dir):
    """Fields cut into eight tiles, worked on by tile and stitched: every point once."""
    f = field4(spark, sf_dir)
    tile = (F.floor(F.col("z") / 2) * 4 + F.floor(F.col("y") / 2) * 2 + F.floor(F.col("x") / 2)).cast("int")
    tiles = f.groupBy("frame", "ch", tile.alias("tile")).agg(F.sum("q").alias("q"), F.count("*").alias("n"))
    return tiles.groupBy("frame", "ch").agg(F.sum("q").alias("total"), F.sum("n").alias("n"))


@query("halo_tiles", with_(FIELD4, rest="SELECT tile, count(*) AS n, CAST(sum(q) AS BIGINT) AS total FROM (SELECT t.tile, f.q FROM field4 f, range(0, 8) AS t(tile) WHERE ch = 0 AND (z - 2 * (tile // 4) + 5) % 4 < 4 AND (y - 2 * (tile // 2 % 2) + 5) % 4 < 4 AND (x - 2 * (tile % 2) + 5) % 4 < 4) GROUP BY tile"))
def halo_tiles(spark, sf_dir):
    """Each tile of two with a halo of one on every side (on a box of four that is the whole box), by exploding a point to the tiles it touches."""
    touch = lambda c: F.array_distinct(F.transform(F.array(*(F.lit(d) for d in (-1, 0, 1))), lambda d: F.floor(F.pmod(F.col(c) + d, F.lit(4)) / 2).cast("int")))
    f = field4(spark, sf_dir).where("ch = 0").select("q", F.explode(touch("z")).alias("a"), "y", "x").select("q", "a", F.explode(touch("y")).alias("b"), "x").select("q", "a", "b", F.explode(touch("x")).alias("c"))
    return f.groupBy((F.col("a") * 4 + F.col("b") * 2 + F.col("c")).cast("long").alias("tile")).agg(F.count("*").alias("n"), F.sum("q").alias("total"))


def keep_mask(seed: Column, ord_: Column, patch: Column, point: Column, rate: float = 0.05) -> Column:
    """A deterministic mask by identity, not by storage row: a linear congruence of (seed, ordinal, patch) and the point."""
    key = (seed.cast("long") * 1000003 + ord_.cast("long") * 1009 + patch).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    return F.pmod((key * 69069 + point.cast("long") * 1103515245 + 12345), F.lit(2147483648)) % 1000 < int(rate * 1000)


@query("keep_mask", with_(FIELD4, rest="SELECT frame, CAST(z * 16 + y * 4 + x AS INTEGER) AS point, q FROM field4 WHERE ch = 0 AND (((((frame % 5) * 1000003 + frame * 1009 + 3) & 2147483647) * 69069 + (z * 16 + y * 4 + x)::BIGINT * 1103515245 + 12345) % 2147483648) % 1000 < 50"))
def q_keep_mask(spark, sf_dir):
    point = (F.col("z") * 16 + F.col("y") * 4 + F.col("x")).cast("int")
    f = field4(spark, sf_dir).where("ch = 0").withColumn("point", point)
    return f.where(keep_mask(F.col("frame") % 5, F.col("frame"), F.lit(3), F.col("point"))).select("frame", "point", "q")


@query("seed_duplicates", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.embedding = b.embedding")
def seed_duplicates(spark, sf_dir):
    """Trajectories whose first frames are equal, found by hash and then compared."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.xxhash64("embedding").alias("h"))
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.vec_id") < F.col("b.vec_id"))).where(F.col("a.embedding") == F.col("b.embedding")).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"))


@query("shuffle_drop_last_all", with_(RUN_TS, rest="SELECT seed, batch, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT seed, event_id, (row_number() OVER (PARTITION BY seed ORDER BY (event_id * 1103515245 + 12345) % 2147483648, event_id) - 1) // 64 AS batch FROM run_ts) GROUP BY seed, batch HAVING count(*) = 64"))
def shuffle_drop_last_all(spark, sf_dir):
    """Every seed's samples shuffled in batches of its own."""
    key = F.pmod(F.col("event_id") * 1103515245 + 12345, F.lit(2147483648))
    batch = F.floor((F.row_number().over(Window.partitionBy("seed").orderBy(key, "event_id")) - 1) / 64).cast("long")
    return run_ts(spark, sf_dir).select("seed", "event_id", batch.alias("batch")).groupBy("seed", "batch").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).where("n = 64")


@query("split_chronological", "SELECT o_orderkey, CASE WHEN r <= 139 THEN 'train' WHEN r <= 169 THEN 'val' ELSE 'test' END AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 200")
def split_chronological(spark, sf_dir):
    """The first 200 rows in time: 139 to train, 30 to val, 31 to test."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderdate", "o_orderkey").limit(200)
    r = F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey"))
    return o.withColumn("r", r).select("o_orderkey", F.when(F.col("r") <= 139, "train").when(F.col("r") <= 169, "val").otherwise("test").alias("part"))


@query("experiment_dedup", "SELECT p_brand, p_size, p_partkey AS kept, alias_count FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY p_brand, p_size) - 1 AS alias_count FROM part) WHERE r = 1")
def experiment_dedup(spark, sf_dir):
    """Experiments with one key are aliases of the first."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("kept"), (F.count("*") - 1).alias("alias_count"))


@query("train_frames", with_(PER_SEED, _R, rest='SELECT "case", greatest(1, CAST(sum(coalesce(CASE WHEN seed % 3 > 0 THEN frames END, 150)) AS BIGINT)) AS frames FROM r WHERE r <= 6 GROUP BY "case"'))
def train_frames(spark, sf_dir):
    """Frames of the training seeds; an unknown count is 150."""
    s = split_by_ic(per_seed(spark, sf_dir)).where("part = 'train'")
    return s.groupBy("case").agg(F.greatest(F.lit(1).cast("long"), F.sum(F.coalesce(F.when(F.col("seed") % 3 > 0, F.col("frames")), F.lit(150)))).alias("frames"))

"""Moments, pooled isotropy and the frozen normaliser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import SAMPLES4, samples4, with_
from ..model import q
from ..registry import query


def moments(df: DataFrame, keys: list[str], scale: float = 1e6) -> DataFrame:
    """Second moments of u, v, w by key; whole-number inputs are summed exactly and scaled once at the end."""
    s = lambda a, b: (F.sum(F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")).cast("double") / F.count("*") / (scale * scale))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(s(a, b).alias(f"{a}{b}") for a, b in ("uu", "vv", "ww", "uv", "uw", "vw")))


def pool(df: DataFrame, weight: str = "n") -> DataFrame:
    """Weighted means of signed moments: pooled first, made absolute later."""
    return df.agg(F.sum(weight).alias("n"), *((F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(c) for c in ("uu", "vv", "ww", "uv", "uw", "vw")))


def isotropy(df: DataFrame) -> DataFrame:
    """comp and cross, in percent, of moment rows."""
    k2 = (F.col("uu") + F.col("vv") + F.col("ww")) / 2
    comp = 100 * F.greatest(*(F.abs(3 * F.col(c) / (2 * k2) - 1) for c in ("uu", "vv", "ww")))
    cross = 100 * F.greatest(*(F.abs(F.col(c)) for c in ("uv", "uw", "vw"))) / (2 * k2 / 3)
    return df.withColumn("comp", comp).withColumn("cross", cross)


def verdict(ok: Column) -> Column:
    return F.when(ok, "pass").otherwise("**FAIL**")


_MOMENTS = """m AS (SELECT {keys} count(*) AS n, {cols} FROM samples4 {group})"""


def _sql_moments(keys: str) -> str:
    cols = ", ".join(f"CAST(sum(CAST({a} AS HUGEINT) * {b}) AS DOUBLE) / count(*) / (1e6 * 1e6) AS {a}{b}" for a, b in ("uu", "vv", "ww", "uv", "uw", "vw"))
    return _MOMENTS.format(keys=keys and keys + ",", cols=cols, group=keys and f"GROUP BY {keys}")


_ISO = """100 * greatest(abs(3 * uu / (uu + vv + ww) - 1), abs(3 * vv / (uu + vv + ww) - 1), abs(3 * ww / (uu + vv + ww) - 1)) AS comp,
  100 * greatest(abs(uv), abs(uw), abs(vw)) / ((uu + vv + ww) / 3) AS cross_"""
_POOL = "pooled AS (SELECT sum(n) AS n, " + ", ".join(f"sum(n * {c}) / sum(n) AS {c}" for c in ("uu", "vv", "ww", "uv", "uw", "vw")) + " FROM m)"
_Q = "CAST(floor({0} * 1e6 + 0.5) AS BIGINT)"


@query("iso_per_seed", with_(SAMPLES4, _sql_moments("seed"), rest=f"SELECT seed, n, {_Q.format('comp')} AS comp_q, {_Q.format('cross_')} AS cross_q FROM (SELECT *, {_ISO} FROM m)"))
def iso_per_seed(spark, sf_dir):
    return isotropy(moments(samples4(spark, sf_dir), ["seed"])).select("seed", "n", q("comp").alias("comp_q"), q("cross").alias("cross_q"))


@query(
    "iso_pool_verdict",
    with_(SAMPLES4, _sql_moments("seed"), _POOL, rest=f"""SELECT CAST(n AS BIGINT) AS n, {_Q.format('comp')} AS comp_q, {_Q.format('cross_')} AS cross_q,
  CASE WHEN comp <= 5 AND cross_ <= 2 THEN 'pass' ELSE '**FAIL**' END AS verdict FROM (SELECT *, {_ISO} FROM pooled)"""),
)
def iso_pool_verdict(spark, sf_dir):
    i = isotropy(pool(moments(samples4(spark, sf_dir), ["seed"])))
    return i.select("n", q("comp").alias("comp_q"), q("cross").alias("cross_q"), verdict((F.col("comp") <= 5) & (F.col("cross") <= 2)).alias("verdict"))


def sign_balance(df: DataFrame, column: str) -> DataFrame:
    """Whether at least three tenths of the rows lie on either side of zero."""
    pos, neg = F.count_if(F.col(column) > 0), F.count_if(F.col(column) < 0)
    return df.agg(pos.alias("pos"), neg.alias("neg"), (F.least(pos, neg) >= 0.3 * F.count("*")).alias("balanced"))


@query(
    "iso_sign_balance",
    with_(SAMPLES4, _sql_moments("seed"), rest="SELECT count(*) FILTER (d > 0) AS pos, count(*) FILTER (d < 0) AS neg, least(count(*) FILTER (d > 0), count(*) FILTER (d < 0)) >= 0.3 * count(*) AS balanced FROM (SELECT uv - avg(uv) OVER () AS d FROM m)"),
)
def iso_sign_balance(spark, sf_dir):
    m = moments(samples4(spark, sf_dir), ["seed"])
    mean = m.agg(F.avg("uv").alias("mean"))
    return sign_balance(m.crossJoin(F.broadcast(mean)).select((F.col("uv") - F.col("mean")).alias("d")), "d")


@query(
    "iso_seed_scan",
    with_(SAMPLES4, _sql_moments("seed"), "c AS (SELECT row_number() OVER (ORDER BY seed) AS n_seed, sum(n) OVER o AS n, " + ", ".join(f"sum(n * {c}) OVER o / sum(n) OVER o AS {c}" for c in ("uu", "vv", "ww", "uv", "uw", "vw")) + " FROM m WINDOW o AS (ORDER BY seed ROWS UNBOUNDED PRECEDING))",
          rest=f"SELECT n_seed, {_Q.format('comp')} AS comp_q, {_Q.format('cross_')} AS cross_q FROM (SELECT *, {_ISO} FROM c) WHERE n_seed IN (1, 2, 4, 6, 8)"),
)
def iso_seed_scan(spark, sf_dir):
    """Pooled isotropy of the first 1, 2, 4, ... seeds: a running sum over the few seed rows."""
    m = moments(samples4(spark, sf_dir), ["seed"])
    w = Window.orderBy("seed").rowsBetween(Window.unboundedPreceding, 0)
    c = m.select(F.row_number().over(Window.orderBy("seed")).cast("long").alias("n_seed"), *((F.sum(F.col("n") * F.col(c)).over(w) / F.sum("n").over(w)).alias(c) for c in ("uu", "vv", "ww", "uv", "uw", "vw")))
    return isotropy(c.where(F.col("n_seed").isin(1, 2, 4, 6, 8))).select("n_seed", q("comp").alias("comp_q"), q("cross").alias("cross_q"))


def fit(df: DataFrame, groups: dict[str, list[str]], scale: float = 1e6) -> DataFrame:
    """The frozen normaliser: n, vmin, vmax, mean, std (population) and absmax of each group of channels, pooled jointly."""
    pairs = [(g, c) for g, cs in groups.items() for c in cs]
    long = df.select(F.inline(F.array(*(F.struct(F.lit(g).alias("grp"), F.col(c).alias("x")) for g, c in pairs))))
    d = F.col("x").cast("decimal(19,0)")
    s = long.groupBy("grp").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(d).alias("s1"), F.sum(d * d).alias("s2"))
    return normaliser(s, scale)


def normaliser(sums: DataFrame, scale: float = 1e6) -> DataFrame:
    n, s1, s2 = F.col("n").cast("double"), F.col("s1").cast("double"), F.col("s2").cast("double")
    var = F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))
    return sums.select("grp", "n", (F.col("lo") / scale).alias("vmin"), (F.col("hi") / scale).alias("vmax"), (s1 / n / scale).alias("mean"), (F.sqrt(var) / scale).alias("std"), (F.greatest(F.abs("lo"), F.abs("hi")) / scale).alias("absmax"))


GROUPS = {"velocity": ["u", "v", "w"], "pressure": ["p"]}
_LONG = "long AS (SELECT 'velocity' AS grp, u AS x, seed FROM samples4 UNION ALL SELECT 'velocity', v, seed FROM samples4 UNION ALL SELECT 'velocity', w, seed FROM samples4 UNION ALL SELECT 'pressure', p, seed FROM samples4)"


def _sums(where: str = "") -> str:
    return f"sums AS (SELECT grp, count(*) AS n, min(x) AS lo, max(x) AS hi, CAST(sum(CAST(x AS HUGEINT)) AS DOUBLE) AS s1, CAST(sum(CAST(x AS HUGEINT) * x) AS DOUBLE) AS s2 FROM long {where} GROUP BY grp)"


_STATS = "stats AS (SELECT grp, n, lo / 1e6 AS vmin, hi / 1e6 AS vmax, s1 / n / 1e6 AS mean, sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0)) / 1e6 AS std, greatest(abs(lo), abs(hi)) / 1e6 AS absmax FROM sums)"
_SHOW = "SELECT grp, n, " + ", ".join(f"CAST(floor({c} * 1000 + 0.5) AS BIGINT) AS {c}_q" for c in ("vmin", "vmax", "mean", "std", "absmax")) + " FROM stats"


def _show(stats: DataFrame) -> DataFrame:
    return stats.select("grp", "n", *(q(c, 1000).alias(f"{c}_q") for c in ("vmin", "vmax", "mean", "std", "absmax")))


@query("norm_fit", with_(SAMPLES4, _LONG, _sums(), _STATS, rest=_SHOW))
def norm_fit(spark, sf_dir):
    return _show(fit(samples4(spark, sf_dir), GROUPS))


@query("norm_train_only", with_(SAMPLES4, _LONG, _sums("WHERE seed IN (0, 1, 2)"), _STATS, rest=_SHOW))
def norm_train_only(spark, sf_dir):
    """Fitted on the frames of training seeds alone (a semi join)."""
    train = spark.createDataFrame([(0,), (1,), (2,)], "seed long")
    return _show(fit(samples4(spark, sf_dir).join(F.broadcast(train), "seed", "left_semi"), GROUPS))


@query("norm_merge_chunks", with_(SAMPLES4, _LONG, _sums(), _STATS, rest=_SHOW))
def norm_merge_chunks(spark, sf_dir):
    """Partial statistics by chunk, merged: the same as one pass."""
    long = samples4(spark, sf_dir).select("seed", F.inline(F.array(*(F.struct(F.lit(g).alias("grp"), F.col(c).alias("x")) for g, cs in GROUPS.items() for c in cs))))
    d = F.col("x").cast("decimal(19,0)")
    part = long.groupBy("grp", "seed").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(d).alias("s1"), F.sum(d * d).alias("s2"))
    return _show(normaliser(part.groupBy("grp").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))))


def apply(x: Column, stats: str, mode: str) -> Column:
    """Forward affine map of a channel by a stats row: minmax x/absmax, standardize (x-mean)/std; scales under 1e-30 count as that."""
    s = lambda c: F.col(f"{stats}.{c}")
    least = lambda c: F.greatest(c, F.lit(1e-30))
    return x / least(s("absmax")) if mode == "minmax" else (x - s("mean")) / least(s("std"))


def invert(x: Column, stats: str, mode: str) -> Column:
    s = lambda c: F.col(f"{stats}.{c}")
    least = lambda c: F.greatest(c, F.lit(1e-30))
    return x * least(s("absmax")) if mode == "minmax" else x * least(s("std")) + s("mean")


def _with_stats(spark, sf_dir) -> DataFrame:
    """Samples next to the two tiny stats rows."""
    s = samples4(spark, sf_dir)
    stats = fit(s, GROUPS).select("grp", F.struct("absmax", "mean", "std").alias("st")).groupBy().agg(
        F.first(F.when(F.col("grp") == "velocity", F.col("st")), True).alias("sv"), F.first(F.when(F.col("grp") == "pressure", F.col("st")), True).alias("sp")
    )
    return s.crossJoin(F.broadcast(stats))


_BOTH = "v AS (SELECT * FROM stats WHERE grp = 'velocity'), pr AS (SELECT * FROM stats WHERE grp = 'pressure')"


@query(
    "norm_apply",
    with_(SAMPLES4, _LONG, _sums(), _STATS, _BOTH, rest="""SELECT seed, count(*) AS n, CAST(sum(CAST(floor(u / 1e6 / v.absmax * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS u_minmax, CAST(sum(CAST(floor((u / 1e6 - v.mean) / v.std * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS u_std,
  CAST(sum(CAST(floor(p / 1e6 / pr.absmax * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS p_minmax FROM samples4 s, v, pr GROUP BY seed""".replace("FROM samples4 s", "FROM (SELECT seed, u, samples4.p FROM samples4) s")),
)
def norm_apply(spark, sf_dir):
    u, p = F.col("u") / 1e6, F.col("p") / 1e6
    return _with_stats(spark, sf_dir).groupBy("seed").agg(
        F.count("*").alias("n"), F.sum(q(apply(u, "sv", "minmax"))).alias("u_minmax"), F.sum(q(apply(u, "sv", "standardize"))).alias("u_std"), F.sum(q(apply(p, "sp", "minmax"))).alias("p_minmax")
    )


@query("norm_inverse_roundtrip", "SELECT count(*) AS n, 0::BIGINT AS off FROM lineitem")
def norm_inverse_roundtrip(spark, sf_dir):
    """Rows that the inverse of the forward map moves by more than rounding: none."""
    u, p = F.col("u") / 1e6, F.col("p") / 1e6
    d = _with_stats(spark, sf_dir)
    far = lambda x, s, m: F.abs(invert(apply(x, s, m), s, m) - x) > 1e-6
    return d.agg(F.count("*").alias("n"), F.count_if(far(u, "sv", "standardize") | far(p, "sp", "minmax")).alias("off"))


def scalar_channel_scale(minmax_scale: Column, absmax: Column, vmin: Column, vmax: Column) -> Column:
    """Scale of a fifth channel: the first known of its records; 0 counts as 1."""
    s = F.coalesce(minmax_scale, absmax, F.greatest(F.abs(vmin), F.abs(vmax)))
    return F.when(s == 0, F.lit(1.0)).otherwise(s)


@query(
    "norm_scalar_channel",
    """SELECT s_suppkey, CAST(floor(CASE WHEN s = 0 THEN 1 ELSE s END * 100 + 0.5) AS BIGINT) AS scale_q FROM (SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END,
  CASE WHEN s_suppkey % 3 = 1 THEN 0.0 END, greatest(abs(s_acctbal), abs(s_acctbal - 500))) AS s FROM supplier)""",
)
def norm_scalar_channel(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k, b = F.col("s_suppkey") % 3, F.col("s_acctbal")
    return s.select("s_suppkey", q(scalar_channel_scale(F.when(k == 0, b), F.when(k == 1, F.lit(0.0)), b, b - 500), 100).alias("scale_q"))

"""Generic relational surface on the star tables: joins, grouping sets, set operations, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import q
from ..registry import query


def t(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("gen_join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def gen_join_inner(spark, sf_dir):
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    return o.where("o_totalprice > 300000").join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("gen_join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def gen_join_left(spark, sf_dir):
    """Pre-aggregated before the join: the shuffle carries one row a customer."""
    n = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = t(spark, sf_dir, "customer")
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("gen_join_right", "SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON s_nationkey = n_nationkey AND n_regionkey = 1")
def gen_join_right(spark, sf_dir):
    n, s = t(spark, sf_dir, "nation").where("n_regionkey = 1"), t(spark, sf_dir, "supplier")
    return n.join(s, n.n_nationkey == s.s_nationkey, "right").select("s_suppkey", "n_name")


@query("gen_join_full_all", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def gen_join_full_all(spark, sf_dir):
    """Both tables whole."""
    s, c = t(spark, sf_dir, "supplier"), t(spark, sf_dir, "customer")
    return s.join(c, s.s_suppkey == c.c_custkey, "full").select("s_suppkey", "c_custkey")


@query("gen_join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def gen_join_semi(spark, sf_dir):
    o = t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("gen_join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def gen_join_anti(spark, sf_dir):
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("gen_join_cross", "SELECT r_name, n_name FROM region, nation")
def gen_join_cross(spark, sf_dir):
    return t(spark, sf_dir, "region").crossJoin(F.broadcast(t(spark, sf_dir, "nation"))).select("r_name", "n_name")


def range_join(points: DataFrame, ranges: DataFrame, x: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points within [lo, hi], by buckets: a range is in every bucket that it touches, a point in one, so the join is on equal keys."""
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    p = points.withColumn("_b", F.floor(F.col(x) / width))
    return p.join(r, "_b").where(F.col(x).between(F.col(lo), F.col(hi))).drop("_b")


@query("gen_join_range", "SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_partkey BETWEEN s_suppkey * 17 AND s_suppkey * 17 + 9")
def gen_join_range(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 17).alias("lo"), (F.col("s_suppkey") * 17 + 9).alias("hi"))
    return range_join(t(spark, sf_dir, "part").select("p_partkey"), s, "p_partkey", "lo", "hi", 16).select("p_partkey", "s_suppkey")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the right value last known at its time: both sides in one sorted pass, no pairs."""
    rows = left.withColumns({"_v": F.lit(None).cast(dict(right.dtypes)[value]), "_l": F.lit(1)}).unionByName(right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_l")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_l").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last("_v", True).over(w)).where("_l = 1").drop("_v", "_l")


@query("gen_join_asof", "SELECT e.event_id, p.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON p.user_id = e.user_id AND p.ts <= e.ts WHERE e.event_type = 'click'")
def gen_join_asof(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), p, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


_AGG = "count(*) AS n, CAST(sum(CAST(floor(l_quantity + 0.5) AS BIGINT)) AS BIGINT) AS qty"


def _grouped(g):
    return g.agg(F.count("*").alias("n"), F.sum(q("l_quantity", 1)).alias("qty"))


@query("gen_rollup", f"SELECT l_returnflag, l_linestatus, {_AGG} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def gen_rollup(spark, sf_dir):
    return _grouped(t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus"))


@query("gen_cube", f"SELECT l_returnflag, l_linestatus, {_AGG} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def gen_cube(spark, sf_dir):
    return _grouped(t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus"))


@query("gen_gsets", f"SELECT l_returnflag, l_linenumber, {_AGG} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())")
def gen_gsets(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return _grouped(li.groupingSets([[F.col("l_returnflag")], [F.col("l_linenumber")], []], F.col("l_returnflag"), F.col("l_linenumber"))).select("l_returnflag", "l_linenumber", "n", "qty")


@query("gen_pivot", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high FROM orders GROUP BY o_orderstatus")
def gen_pivot(spark, sf_dir):
    p = t(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH"]).agg(F.count(F.lit(1)))
    return p.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("2-HIGH", F.lit(0)).alias("high"))


@query("gen_unpivot_all", "SELECT l_orderkey, l_linenumber, k, CAST(floor(v * 100 + 0.5) AS BIGINT) AS v_q FROM (SELECT l_orderkey, l_linenumber, 'discount' AS k, l_discount AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem)")
def gen_unpivot_all(spark, sf_dir):
    """Every line."""
    return _rates(t(spark, sf_dir, "lineitem"))


def _rates(lines: DataFrame) -> DataFrame:
    li = lines.select("l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return li.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "k", "v").select("l_orderkey", "l_linenumber", "k", q("v", 100).alias("v_q"))


@query("gen_union", "SELECT c_nationkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def gen_union(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src")), t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("src"))
    return c.unionByName(s, allowMissingColumns=True)


@query("gen_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def gen_intersect(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, sf_dir, "supplier").select("s_nationkey"))


@query("gen_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def gen_except(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(t(spark, sf_dir, "orders").select("o_custkey"))


@query("gen_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
def gen_distinct(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_brand", "p_size").distinct()


@query("gen_rank_family", "SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS nt, CAST(floor(percent_rank() OVER w * 1e6 + 0.5) AS BIGINT) AS pr, CAST(floor(cume_dist() OVER w * 1e6 + 0.5) AS BIGINT) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def gen_rank_family(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    n = F.ntile(4).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), n.alias("nt"), q(F.percent_rank().over(w)).alias("pr"), q(F.cume_dist().over(w)).alias("cd"))


@query("gen_window_frames", "SELECT o_orderkey, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders")
def gen_window_frames(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t(spark, sf_dir, "orders").select("o_orderkey", F.sum(q("o_totalprice", 100)).over(w.rowsBetween(-2, 1)).alias("s"), F.nth_value("o_orderkey", 2).over(all_).alias("second"))


@query("gen_top_k", "SELECT o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def gen_top_k(spark, sf_dir):
    return t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", q("o_totalprice", 100).alias("cents"))


@query("gen_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")
def gen_offset(spark, sf_dir):
    return t(spark, sf_dir, "customer").orderBy("c_custkey").offset(20).limit(10).select("c_custkey")


@query("gen_subquery_scalar", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > (SELECT avg(l_quantity) FROM lineitem)")
def gen_subquery_scalar(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return li.crossJoin(F.broadcast(li.agg(F.avg("l_quantity").alias("m")))).where("l_quantity > m").agg(F.count("*").alias("n"))


@query("gen_agg_stats", "SELECT l_returnflag, CAST(floor(stddev_pop(l_quantity) * 1e6 + 0.5) AS BIGINT) AS sp, CAST(floor(stddev_samp(l_quantity) * 1e6 + 0.5) AS BIGINT) AS ss, CAST(floor(corr(l_quantity, l_extendedprice) * 1e6 + 0.5) AS BIGINT) AS c, CAST(median(l_quantity) AS BIGINT) AS m, count(DISTINCT l_suppkey) AS d, bool_or(l_tax > 0.07) AS b, mode(l_linenumber) AS mo FROM lineitem GROUP BY l_returnflag")
def gen_agg_stats(spark, sf_dir):
    g = t(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return g.agg(q(F.stddev_pop("l_quantity")).alias("sp"), q(F.stddev_samp("l_quantity")).alias("ss"), q(F.corr("l_quantity", "l_extendedprice")).alias("c"), F.median("l_quantity").cast("long").alias("m"), F.count_distinct("l_suppkey").alias("d"), F.bool_or(F.col("l_tax") > 0.07).alias("b"), F.mode("l_linenumber").alias("mo"))


@query("gen_approx_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, TRUE AS near FROM lineitem GROUP BY l_returnflag")
def gen_approx_distinct(spark, sf_dir):
    """Distinct parts, and whether the sketch's estimate lies within five standard errors of 2 % of them."""
    exact, about = F.count("l_partkey"), F.approx_count_distinct("l_partkey", 0.02)
    # A sketch takes no notice of repeats. Beside an exact distinct count there would be one sketch for each part.
    return t(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(exact.alias("parts"), (F.abs(about - exact) <= 0.1 * exact).alias("near"))


@query("gen_pricing_summary", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(floor(l_quantity + 0.5) AS BIGINT)) AS BIGINT) AS qty, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * (100 - CAST(floor(l_discount * 100 + 0.5) AS BIGINT))) AS BIGINT) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def gen_pricing_summary(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02'"))
    disc = q("l_extendedprice", 100) * (100 - q("l_discount", 100))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(q("l_quantity", 1)).alias("qty"), F.sum(disc).alias("disc"), F.count("*").alias("n"))

"""Scalar function families: numbers, strings, dates, JSON, maps, arrays, hashes; and vectorised functions of the user's own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..model import q
from ..registry import query


def t(spark, sf_dir, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("gen_math", "SELECT s_suppkey, CAST(floor(sqrt(abs(s_acctbal)) * 1e6 + 0.5) AS BIGINT) AS a, CAST(floor(ln(abs(s_acctbal) + 1) * 1e6 + 0.5) AS BIGINT) AS b, CAST(sign(s_acctbal) AS INTEGER) AS c, CAST(round_even(s_acctbal / 10, 0) AS BIGINT) AS d, CAST(trunc(s_acctbal) AS BIGINT) AS e, CAST(floor(sin(s_suppkey) * 1e6 + 0.5) AS BIGINT) AS f FROM supplier")
def gen_math(spark, sf_dir):
    x = F.col("s_acctbal")
    return t(spark, sf_dir, "supplier").select("s_suppkey", q(F.sqrt(F.abs(x))).alias("a"), q(F.log(F.abs(x) + 1)).alias("b"), F.sign(x).cast("int").alias("c"), F.bround(x / 10, 0).cast("long").alias("d"), x.cast("long").alias("e"), q(F.sin("s_suppkey")).alias("f"))


@query("gen_string", "SELECT c_custkey, upper(c_mktsegment) AS u, split_part(c_name, '#', 2) AS tail, regexp_extract(c_name, '([0-9]+)$', 1) AS digits, starts_with(c_name, 'Customer#0000001') AS s, replace(c_mktsegment, 'U', '_') AS r, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS l, length(c_name)::INTEGER AS n FROM customer")
def gen_string(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(
        "c_custkey", F.upper("c_mktsegment").alias("u"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"), F.regexp_extract("c_name", "([0-9]+)$", 1).alias("digits"), F.startswith("c_name", F.lit("Customer#0000001")).alias("s"),
        F.replace("c_mktsegment", F.lit("U"), F.lit("_")).alias("r"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("l"), F.length("c_name").alias("n"),
    )


@query("gen_seed_name", "SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(s, '_pool(\\d+)$', 1), '') AS INTEGER), 0) AS seed FROM (SELECT p_partkey, 'case' || CASE WHEN p_partkey % 3 > 0 THEN '_pool' || p_partkey ELSE '' END AS s FROM part)")
def gen_seed_name(spark, sf_dir):
    """A pool's true number from its name; the base run is 0."""
    s = F.concat(F.lit("case"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("_pool"), F.col("p_partkey").cast("string"))).otherwise(""))
    return t(spark, sf_dir, "part").select(
        "p_partkey", s.alias("s")
    ).select("p_partkey", F.coalesce(F.nullif(F.regexp_extract("s", r"_pool(\d+)$", 1), F.lit("")).try_cast("int"), F.lit(0)).alias("seed"))


@query("gen_date", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS INTEGER) AS d, strftime(o_orderdate, '%Y-%m-%d') AS s, CAST(date_trunc('month', o_orderdate) AS DATE) AS mo FROM orders")
def gen_date(spark, sf_dir):
    d = F.col("o_orderdate")
    return t(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.datediff(d, F.to_date(F.lit("1992-01-01"))).alias("d"), F.date_format(d, "yyyy-MM-dd").alias("s"), F.to_date(F.date_trunc("month", d)).alias("mo"))


@query("gen_json", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props))::INTEGER AS n FROM events")
def gen_json(spark, sf_dir):
    m = F.from_json("props", "map<string,string>")
    return t(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", F.element_at(F.map_values("m"), 1).alias("first_value"), F.size("m").alias("n"))


@query("gen_map", "SELECT n_regionkey, count(*) AS n, sum(CASE WHEN n_name = 'CANADA' THEN n_nationkey END)::BIGINT AS canada FROM nation GROUP BY n_regionkey")
def gen_map(spark, sf_dir):
    m = t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return m.select("n_regionkey", F.size("m").cast("long").alias("n"), F.try_element_at("m", F.lit("CANADA")).cast("long").alias("canada"))


@query("gen_array", "SELECT vec_id, len(embedding)::INTEGER AS n, CAST(floor(list_sum([x::DOUBLE for x in embedding]) * 1e4 + 0.5) AS BIGINT) AS s, len([x for x in embedding if x > 0])::INTEGER AS pos, CAST(floor(list_max(embedding)::DOUBLE * 1e6 + 0.5) AS BIGINT) AS mx FROM embeddings")
def gen_array(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    return t(spark, sf_dir, "embeddings").select("vec_id", F.size(e).alias("n"), q(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 1e4).alias("s"), F.size(F.filter(e, lambda x: x > 0)).alias("pos"), q(F.array_max(e)).alias("mx"))


@query("gen_hash", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
def gen_hash(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"))


@query("gen_udf", "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity * 2 + 1 + 0.5) AS BIGINT) AS y FROM lineitem")
def gen_udf(spark, sf_dir):
    """A vectorised function on Arrow batches."""

    @F.pandas_udf("double")
    def affine(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q(affine("l_quantity"), 1).alias("y"))


@query("gen_udtf", "SELECT n_nationkey, i, n_nationkey * i AS prod FROM (SELECT n_nationkey::BIGINT AS n_nationkey FROM nation), range(0, 3) AS g(i)")
def gen_udtf(spark, sf_dir):
    """A table function as a generator expression."""
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>")).alias("i"))
    return n.withColumn("prod", F.col("n_nationkey") * F.col("i"))


@query("gen_format", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '—' ELSE format('{:.2f}', s_acctbal) END AS shown FROM supplier")
def gen_format(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, "—").otherwise(F.format_string("%.2f", "s_acctbal")).alias("shown"))


@query("gen_config_defaults", "SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, CASE WHEN p_size % 3 = 0 THEN 1000 END, 64)::INTEGER AS n FROM part")
def gen_config_defaults(spark, sf_dir):
    """Command line over file over default; absent keys keep the default and unknown ones are dropped."""
    cli, js = F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.to_json(F.struct(F.when(F.col("p_size") % 3 == 0, 1000).alias("n"), F.lit(1).alias("unknown")))
    return t(spark, sf_dir, "part").select("p_partkey", F.coalesce(cli, F.from_json(js, "n int")["n"], F.lit(64)).alias("n"))


@query("storage_estimate", "SELECT p_partkey, (p_size::BIGINT * 64 * 64 * 64 * 4 * 4 + 10 * 64 * 64 * 33 * 3 * 16)::BIGINT AS bytes FROM part")
def storage_estimate(spark, sf_dir):
    n = F.col("p_size").cast("long")
    return t(spark, sf_dir, "part").select("p_partkey", (n * 64**3 * 4 * 4 + 10 * 64 * 64 * 33 * 3 * 16).alias("bytes"))


@query("fm_interp", "SELECT vec_id, i AS step, CAST(floor(((1 - i / 4.0) * embedding[1]::DOUBLE + i / 4.0 * embedding[2]::DOUBLE) * 1e6 + 0.5) AS BIGINT) AS x_q FROM embeddings, range(0, 5) AS r(i)")
def fm_interp(spark, sf_dir):
    """x_t = (1 - t) z + t y at the Euler steps."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("z"), F.col("embedding")[1].cast("double").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>")).alias("step"))
    tt = F.col("step") / 4.0
    return e.select("vec_id", "step", q((1 - tt) * F.col("z") + tt * F.col("y")).alias("x_q"))

"""Releases a slice of a text table: splits that do not leak, refusals with their reason, a frozen normaliser, a manifest.

    python -m jobs.release_slice --config jobs/release_slice.json --documents IN/documents.parquet --labels IN/labels.parquet --output OUT

What a trajectory from one initial state is to an ensemble of simulations, a group of
copies is to a corpus: its members never fall into different splits. A group is all rows
whose texts are equal but for case (A-Z) and white space. Its split follows from a hash of
that text alone, so that rows which come later move no group that is there already. One row
stands for a group, that with the smallest id (null ids last; of equal ids the least text).

A group is refused, with the first reason that holds, if it has no words (`empty`), if its row
is shorter than `least_chars` (`short`), if a label of any of its rows is below `least_quality` (`quality`), or if
one is toxic and `release_toxic` is false (`toxic`). Unlabelled groups pass.

The output, in OUT:

* `data`, partitioned by split and lang: doc_id, text, source, n_chars, copies, reason, group (SHA-256 of the
  folded text); refused groups are in split `refused`, without their text;
* `norm`: for each language, and for all (`*`), rows, least, most, mean and deviation of n_chars of
  the split `train` only;
* `manifest`: groups, rows and characters of each split, language, source and reason;
* `state`: one row, whether the release is complete. It is false while the rest is being written, and
  `read_release` refuses such a release; a run that broke is mended by running it again.

Null languages and sources are kept as they are, an empty language becomes null; columns but
those named here are not read; an empty table gives an empty release.

A run replaces what is there; the same input and settings give the same release.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.operators.statistics import normaliser

from .common import command_line_session, config, logger

log = logger("release_slice")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Config:
    """splits: percent of the groups for each split, 100 in all."""

    splits: dict[str, int] = field(default_factory=lambda: {"train": 80, "val": 10, "test": 10})
    least_chars: int = 200
    least_quality: int = 1
    release_toxic: bool = False

    def __post_init__(self):
        if sum(self.splits.values()) != 100 or min(self.splits.values()) < 0 or "refused" in self.splits:
            raise ValueError("splits must share out 100 percent, and none is called refused")


def folded(text: Column) -> Column:
    """The text without differences in case (A-Z) and white space."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\t-\r ]+", " "))


def split_of(group: Column, splits: dict[str, int]) -> Column:
    """The split of a group by the leading digits of its hash."""
    place = F.conv(F.substring(group, 1, 7), 16, 10).cast("long") % 100
    out, upto = None, 0
    for name, percent in splits.items():
        upto += percent
        out = F.when(place < upto, name) if out is None else out.when(place < upto, name)
    return out


def slice_of(documents: DataFrame, labels: DataFrame, c: Config) -> DataFrame:
    """A row for each group. The texts are shuffled once for the groups, after copies within a partition are one row."""
    text = F.col("text")
    grouped = F.sha2(folded(text), 256)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text, "lang", "source")
    first = F.min_by(F.struct("doc_id", "text", "lang", "source"), F.struct(F.col("doc_id").isNull(), "doc_id", "text", "lang", "source"))
    groups = rows.withColumn("group", grouped).groupBy("group").agg(first.alias("row"), F.count("*").alias("copies"))
    # Labels meet ids and hashes only, and are one row a group before they meet the texts.
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    marked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), grouped.alias("group")).join(marked, "doc_id").groupBy("group").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    g = groups.join(marked, "group", "left").withColumn("n_chars", F.coalesce(F.length("row.text"), F.lit(0)).cast("long"))
    reason = (
        F.when(F.col("group") == F.sha2(F.lit(""), 256), "empty").when(F.col("n_chars") < c.least_chars, "short")
        .when(F.col("quality") < c.least_quality, "quality").when((F.col("toxic") > 0) & F.lit(not c.release_toxic), "toxic")
    )
    split = F.when(F.col("reason").isNull(), split_of(F.col("group"), c.splits)).otherwise("refused")
    g = g.withColumn("reason", reason).withColumn("split", split)
    return g.select("row.doc_id", F.when(F.col("reason").isNull(), F.col("row.text")).alias("text"), "row.source", "n_chars", "copies", "reason", "group", "split", "row.lang")


def norm_of(data: DataFrame) -> DataFrame:
    """The normaliser of n_chars on the training split, by language and for all."""
    x, d = F.col("n_chars"), F.col("n_chars").cast("decimal(19,0)")
    train = data.where("split = 'train'").select("n_chars", F.explode(F.array(F.coalesce("lang", F.lit("?")), F.lit("*"))).alias("grp"))
    return normaliser(train.groupBy("grp").agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(d).alias("s1"), F.sum(d * d).alias("s2")), 1.0).withColumnRenamed("grp", "lang")


def manifest_of(data: DataFrame) -> DataFrame:
    return data.groupBy("split", "lang", "source", "reason").agg(F.count("*").alias("groups"), F.sum("copies").alias("rows"), F.sum("n_chars").alias("chars"))


DATA = "doc_id long, text string, source string, n_chars long, copies long, reason string, group string, split string, lang string"


def _state(spark: SparkSession, output: str, complete: bool) -> None:
    spark.range(1).select(F.lit(complete).alias("complete")).coalesce(1).write.mode("overwrite").parquet(f"{output}/state")


def run(spark: SparkSession, documents: str, labels: str, output: str, c: Config | None = None) -> dict[str, int]:
    """Writes the release and returns what was read and written."""
    c = c or Config()
    _state(spark, output, False)
    out = slice_of(spark.read.parquet(documents), spark.read.parquet(labels), c)
    # Few partitions of the result hold most rows: they are dealt into files by size.
    out.hint("rebalance", "split", "lang").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("split", "lang").parquet(f"{output}/data")
    data = spark.read.schema(DATA).parquet(f"{output}/data")
    norm_of(data).coalesce(1).write.mode("overwrite").parquet(f"{output}/norm")
    manifest_of(data).coalesce(1).write.mode("overwrite").parquet(f"{output}/manifest")
    totals = data.agg(F.count("*").alias("groups"), F.sum("copies").alias("rows"), F.count_if(F.col("split") == "refused").alias("refused")).first()
    _state(spark, output, True)
    report = {"groups": totals["groups"], "rows": totals["rows"] or 0, "refused": totals["refused"]}
    log.info("read %s documents from %s and labels from %s", report["rows"], documents, labels)
    log.info("wrote %s groups, %s of them refused, to %s", report["groups"], report["refused"], output)
    if not report["groups"]:
        log.warning("%s has no rows", documents)
    return report


def read_release(spark: SparkSession, output: str, part: str = "data") -> DataFrame:
    """A part of a complete release; one that is not complete is refused."""
    if not spark.read.parquet(f"{output}/state").where("complete").count():
        raise ValueError(f"the release in {output} is not complete")
    return spark.read.schema(DATA).parquet(f"{output}/data") if part == "data" else spark.read.parquet(f"{output}/{part}")


def whole_output(spark: SparkSession, output: str) -> DataFrame:
    """All parts of a release as rows of one shape; statistics in whole thousandths."""
    none, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    thousandths = lambda x: F.floor(F.col(x) * 1000 + 0.5).cast("long")
    data = read_release(spark, output).select(F.lit("data").alias("part"), "split", "lang", "source", "reason", "doc_id", F.col("copies").alias("a"), F.col("n_chars").alias("b"), F.length("text").cast("long").alias("c"))
    norm = read_release(spark, output, "norm").select(F.lit("norm"), F.lit("train"), "lang", none, none, number, F.col("n").cast("long"), thousandths("mean"), thousandths("std"))
    manifest = read_release(spark, output, "manifest").select(F.lit("manifest"), "split", "lang", "source", "reason", number, "groups", "rows", "chars")
    return data.union(norm).union(manifest)


def job1_release_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxlake.sources.stores import shared_path

    output = shared_path(spark, "release")
    for _ in range(2):  # the second run replaces the first by the same
        run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", output)
    return whole_output(spark, output)


ORACLE = f"""WITH d AS (SELECT doc_id, text, lang, source, sha256(trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x09-\\x0D ]+', ' ', 'g'), ' ')) AS "group" FROM documents),
  m AS (SELECT "group", min(quality) AS quality, max(toxic) AS toxic FROM d JOIN labels USING (doc_id) GROUP BY "group"),
  g AS (SELECT "group", count(*) OVER (PARTITION BY "group") AS copies, doc_id, text, lang, source, coalesce(length(text), 0) AS n_chars FROM d
    QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY doc_id NULLS LAST, text, lang, source) = 1),
  r AS (SELECT g.*, CASE WHEN "group" = sha256('') THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN quality < 1 THEN 'quality' WHEN toxic > 0 THEN 'toxic' END AS reason, CAST('0x' || substr("group", 1, 7) AS BIGINT) % 100 AS place
    FROM g LEFT JOIN m USING ("group")),
  data AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN place < 80 THEN 'train' WHEN place < 90 THEN 'val' ELSE 'test' END AS split FROM r),
  t AS (SELECT n_chars AS x, unnest([coalesce(lang, '?'), '*']) AS lang FROM data WHERE split = 'train'),
  s AS (SELECT lang, count(*) AS n, CAST(sum(x) AS DOUBLE) AS s1, CAST(sum(CAST(x AS HUGEINT) * x) AS DOUBLE) AS s2 FROM t GROUP BY lang)
SELECT 'data' AS part, split, lang, source, reason, doc_id, copies AS a, n_chars AS b, CASE WHEN reason IS NULL THEN length(text) END AS c FROM data
UNION ALL SELECT 'norm', 'train', lang, NULL, NULL, NULL, n, CAST(floor(s1 / n * 1000 + 0.5) AS BIGINT), CAST(floor(sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0)) * 1000 + 0.5) AS BIGINT) FROM s
UNION ALL SELECT 'manifest', split, lang, source, reason, NULL, count(*), CAST(sum(copies) AS BIGINT), CAST(sum(n_chars) AS BIGINT) FROM data GROUP BY split, lang, source, reason"""


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "labels", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="JSON file with the settings of Config")
    a = p.parse_args(argv)
    spark = command_line_session("release_slice")
    try:
        run(spark, a.documents, a.labels, a.output, config(spark, Config, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

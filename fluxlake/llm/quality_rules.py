"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is a boolean column (true: the document is rejected). A bounded random
sample gives each rule's rejection rate and cost, in one aggregate: cost is counted as the
characters that a rule reads, so the order is the same in every run. Rules then run in
descending order of rejections per unit of cost, inside one CASE, which stops at the
first rule that rejects: what a later rule reads of the text is not computed then.
The order changes the time, never the verdict.

Statistics and verdict leave through a generator, which filters on them do not pass;
else each filter would compute them anew.

Defined cases: null or empty text has no words and fails the base rule; texts of any
length are judged whole; ties in the order keep the given order; repeated rows are
judged row by row; an empty table gives no rows; further columns, whatever their
names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample that orders the rules, at most twice as many.
SAMPLE_ROWS = 400

SPACE = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A rule and the work it takes on a row: characters it reads, 1 for a comparison of numbers that are there."""

    name: str
    rejects: Column
    work: Column | int = 1


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base statistics of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    at = lambda i: F.get("words", i)
    d = d.withColumn(
        "threes",
        F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))),
    )
    # Texts without a repeated window, nearly all, are done after one pass through a hash set.
    d = d.withColumn(
        "sorted",
        F.when(F.size(F.array_distinct("threes")) < F.size("threes"), F.array_sort(F.transform("threes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("threes")
    same = lambda x, k: F.coalesce(F.get("sorted", k)["h"] == x["h"], F.lit(False))
    where = F.array_sort(F.array_compact(F.transform("sorted", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))))
    covered = F.aggregate(
        where,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    d = d.withColumn("lines", lines)
    row = F.struct(
        "n_words",
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return d.select("doc_id", "text", F.inline(F.array(row)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Production thresholds, in whole numbers so that every engine agrees."""
    n = F.col("n_words")
    return [
        Rule("base", base_failed()),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("dup_lines", (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
        Rule("repeats", 100 * F.col("n_repeat_words") > 35 * n),
        Rule("capitals", 2 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > F.col("word_chars"), F.length("text")),
        Rule("shouting", 5 * F.regexp_count("text", F.lit("!!")).cast("long") > n, F.length("text")),
    ]


def measure(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, rejection rate, mean work on a row) on a sample, in one aggregate: counted work is the same in every run, where times are not."""
    work = lambda r: r.work if isinstance(r.work, Column) else F.lit(r.work)
    rates = [F.avg(F.coalesce(r.rejects, F.lit(False)).cast("int")).alias(f"rate_{i}") for i, r in enumerate(rules)]
    costs = [F.avg(work(r)).alias(f"cost_{i}") for i, r in enumerate(rules)]
    got = sample.agg(*rates, *costs).first()
    return [(r, got[f"rate_{i}"] or 0.0, max(1.0, float(got[f"cost_{i}"] or 0.0))) for i, r in enumerate(rules)]


def ordered(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules by rejections per cost; equal ones stay in their order."""
    return [r for r, rate, cost in sorted(measured, key=lambda x: -x[1] / x[2])]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does."""
    case = F.when(rules[0].rejects, F.lit(rules[0].name))
    for r in rules[1:]:
        case = case.when(r.rejects, F.lit(r.name))
    return case


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Statistics and verdict of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept."""
    rules = rules or default_rules()
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(1, docs.count()))  # of Parquet, a count reads no column
    few = docs.where(F.rand(17) < share).limit(2 * SAMPLE_ROWS)
    order = ordered(measure(with_statistics(few), rules))
    verdict = cascade(order).isNull()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    row = F.struct(*names, base_failed().alias("base_failed"), verdict.alias("kept"))
    return with_statistics(docs).select("doc_id", F.inline(F.array(row)))


def op1_quality_rules(spark, sf_dir):
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), tri AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c >= 2
), cov AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) AS k(j) GROUP BY rid
), s AS (
  SELECT doc_id, t, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > 3 * n_words
    OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR 100 * n_repeat_words > 35 * n_words
    OR 2 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > word_chars
    OR 5 * ((length(t) - length(replace(t, '!!', ''))) // 2) > n_words) AS kept
FROM b
"""

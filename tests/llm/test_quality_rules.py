import re
from collections import Counter

from pyspark.sql import functions as F

from fluxlake.llm import quality_rules as q


def plain(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    threes = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = set()
    for i in range(len(w) - 2):
        if threes[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_a_plain_version(edge, edge_rows):
    got = sorted(tuple(r) for r in q.quality_rules(edge).where("doc_id is not null").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted((r[0], *plain(r[1])) for r in edge_rows if r[0] is not None)


def test_oracle(same):
    same(q.op1_quality_rules, q.ORACLE)


def test_order_changes_nothing(documents):
    rules = q.default_rules()
    d = q.with_statistics(documents)
    a, b = (d.where(q.cascade(r).isNull()).agg(F.sum("doc_id")).first()[0] for r in (rules, rules[::-1]))
    assert a == b


def test_cascade_stops_at_the_first_rejection(spark):
    d = spark.range(10).withColumn("n_words", F.lit(0))
    rules = [q.Rule("first", F.col("id") >= 0), q.Rule("never", F.raise_error(F.lit("reached")).cast("boolean"))]
    assert {r[0] for r in d.select(q.cascade(rules)).collect()} == {"first"}


def test_empty(empty):
    assert q.quality_rules(empty).count() == 0


def test_no_python_on_the_way(documents):
    plan = q.quality_rules(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_the_order_follows_rejections_per_work_and_is_the_same_in_every_run(spark, documents):
    d = spark.createDataFrame([(i, "x" * 100) for i in range(10)], "doc_id long, text string").withColumn("n_words", F.col("doc_id"))
    rules = [q.Rule("dear", F.col("n_words") < 9, F.length("text")), q.Rule("rare", F.col("n_words") < 1), q.Rule("cheap", F.col("n_words") < 2)]
    assert [(r.name, rate, cost) for r, rate, cost in q.measure(d, rules)] == [("dear", 0.9, 100.0), ("rare", 0.1, 1.0), ("cheap", 0.2, 1.0)]
    assert [r.name for r in q.ordered(q.measure(d, rules))] == ["cheap", "rare", "dear"]
    s = q.with_statistics(documents)
    orders = {tuple(r.name for r in q.ordered(q.measure(s, q.default_rules()))) for _ in range(10)}
    assert len(orders) == 1
    assert [r.name for r in q.ordered(q.measure(s.limit(0), q.default_rules()))] == [r.name for r in q.default_rules()]

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxlake.llm import quality_gam as G


def test_features_match_a_plain_version():
    texts = ["One two  two\nOne two  two\n\nA, b! | # é", None, "", "x", "a b c a b c a b c"]
    x = G.features(pa.array(texts))
    for t, row in zip(texts, x, strict=True):
        w = (t or "").split()
        n, letters = max(1, len(w)), max(1, sum(len(v.encode()) for v in w))
        f = dict(zip(G.FEATURES, row, strict=True))
        assert f["log_words"] == pytest.approx(np.log1p(len(w)))
        assert f["word_length"] == pytest.approx(letters / n if w else 1)
        assert f["distinct_words"] == pytest.approx(len({v.lower() for v in w}) / n)
        threes = [tuple(v.lower() for v in w[i : i + 3]) for i in range(len(w) - 2)]
        assert f["repeated_threes"] == pytest.approx((len(threes) - len(set(threes))) / max(1, len(threes)))
        lines = [tuple(v.split()) for v in (t or "").lower().split("\n") if v.split()]
        assert f["repeated_lines"] == pytest.approx((len(lines) - len(set(lines))) / max(1, len(lines)))
        assert f["bars"] == pytest.approx((t or "").count("|") / n)


def test_tables_and_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (3000, len(G.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = G.train(x[:2000], y[:2000])
    assert (0, 1) in m.pairs
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(G.FEATURES)))
    m = G.train(x, (x[:, 2] > 0).astype(float))
    v = x[7]
    total = m.base + sum(m.tables[j][np.searchsorted(c, v[j], "right")] for j, c in enumerate(m.cuts))
    total += sum(t[np.searchsorted(m.pair_cuts[i], v[i], "right"), np.searchsorted(m.pair_cuts[j], v[j], "right")] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
    assert m.margin(v[None])[0] == pytest.approx(total)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = G.op5_quality_gam(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)] + [(None, 1), (3, None), (3, 1)], "doc_id long, quality int")
    m = G.fit(edge, labels)
    out = G.score(edge, m)
    assert out.count() == edge.count() and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert G.keep(edge, m).columns == edge.columns
    none = G.fit(empty, labels.limit(0))
    assert {r["score"] for r in G.score(edge, none).collect()} == {0.5}
    assert G.score(empty, none).count() == 0

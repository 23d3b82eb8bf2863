import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from fluxlake.llm import language_id as L


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    table = rng.uniform(-8, 0, (30, 3)).astype(np.float32)
    sizes = [0, 1, 7, 3, 6]
    rows = rng.integers(0, 30, sum(sizes))
    first = np.cumsum([0, *sizes])
    got = L.viterbi(table, rows, first)

    def value(r, path):
        return sum(table[i, p] for i, p in zip(r, path, strict=True)) - L.SWITCH * sum(a != b for a, b in itertools.pairwise(path))

    for a, b in itertools.pairwise(first):
        if b > a:
            best = max(value(rows[a:b], p) for p in itertools.product(range(3), repeat=int(b - a)))
            assert abs(value(rows[a:b], got[a:b].tolist()) - best) < 1e-4


def test_held_out_accuracy(spark, documents):
    out = L.op3_language_id(spark, "/root/testdata/sf0.01")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    acc = out.where("held_out").join(d, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert acc > 0.98


def test_spans_of_mixed_text(spark, documents):
    m = L.fit(documents)
    by = {r["lang"]: r["text"] for r in documents.where("lang in ('de', 'es') and length(text) between 600 and 3000").orderBy("doc_id").collect()}
    spans = L.spans_batch(m, [by["de"][:500] + " " + by["es"][:500]])[0]
    assert spans[0]["lang"] == "de" and spans[-1]["lang"] == "es" and len(spans) <= 4
    assert sum(s["n_words"] for s in spans) == len([w for w in L.words_of((by["de"][:500] + " " + by["es"][:500]).lower())])


def test_scripts_narrow_the_candidates():
    rng = random.Random(1)
    m = L.train([("ru", "привет мир как дела " * 20), ("en", "hello world how are you " * 20), ("ja", "こんにちは 世界 " * 20)])
    assert L.predict_batch(m, ["мир", "hello", "世界", "12 34", None, ""])[0] == ["ru", "en", "ja", "und", "und", "und"]
    assert rng


def test_edges(edge):
    m = L.fit(edge)
    got = {r["doc_id"]: r for r in L.predict(edge, m).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == "und" and got[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert L.predict(edge, m).count() == edge.count()
    assert L.keep(edge, m).columns == edge.columns


def test_without_training_rows(empty, edge):
    m = L.fit(empty)
    assert L.predict(empty, m).count() == 0
    assert {r["lang_pred"] for r in L.predict(edge, m).collect()} == {"und"}
    assert L.label_spans(edge, m).count() == edge.count()


def test_numerals_are_no_letters():
    assert L.words_of("½ ² ① ab½c 12 x_y é") == ["ab", "c", "x", "y", "é"]
    m = L.train([("de", "das ist ein kleiner satz"), ("en", "this is a small sentence")])
    assert L.predict_batch(m, ["½ ②", "③", None]) == (["und"] * 3, [0.0] * 3)

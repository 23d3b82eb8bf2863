"""The pipeline against a plain version of its stages, and its edges."""

import corpus_pipeline as pipeline
from fluxlake.llm import language_id, ngram_join, quality_gam, secret_scan
from fluxlake.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_documents(spark, sf_dir, documents):
    import test_ngram_join

    docs = documents.collect()
    m = language_id.fit(documents)
    names, scores = language_id.predict_batch(m, [r["text"] for r in docs])
    want = [r for r, n, s in zip(docs, names, scores, strict=True) if n != "und" and s >= 0.3]
    d = materialise(pipeline.language(spark, documents, sf_dir), "t")
    assert sorted(r["doc_id"] for r in d.collect()) == sorted(r["doc_id"] for r in want) and d.columns == COLUMNS

    import pyarrow as pa

    g = quality_gam.fit(d, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = g.score(quality_gam.features(pa.array([r["text"] for r in want]))) >= quality_gam.THRESHOLD
    want = [r for r, k in zip(want, good, strict=True) if k]
    d = materialise(pipeline.quality(spark, d, sf_dir), "t")
    assert sorted(r["doc_id"] for r in d.collect()) == sorted(r["doc_id"] for r in want) and d.columns == COLUMNS

    heads = {c for _, _, c in test_ngram_join.brute([(r["doc_id"], r["text"]) for r in want])}
    want = [r for r in want if r["doc_id"] in heads]
    d = materialise(pipeline.near_duplicates(spark, d, sf_dir), "t")
    assert sorted(r["doc_id"] for r in d.collect()) == sorted(heads) and d.columns == COLUMNS

    d = materialise(pipeline.secrets(spark, d, sf_dir), "t")
    assert {r["doc_id"] for r in d.collect()} == heads and d.columns == COLUMNS
    assert secret_scan.findings(d).count() == 0
    packed = pipeline.pack(spark, d, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == heads
    assert ngram_join.PERCENT == 80


def test_run(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_stages_on_edges(spark, sf_dir, edge, empty):
    for docs in (edge, empty):
        d = docs
        for _, stage in pipeline.STAGES[:-1]:
            d = materialise(stage(spark, d, sf_dir), "t")
            assert d.columns == docs.columns
        assert pipeline.STAGES[-1][1](spark, d, sf_dir).count() >= 0

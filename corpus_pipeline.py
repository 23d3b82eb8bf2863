"""A corpus pipeline of five stages over `documents`.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents. A document leaves when
its language is unknown, when its quality is low, or when one with a smaller id
is a near-duplicate; secrets in the texts left are replaced; what remains is
packed into sequences.

Defined cases: documents with null, empty or letterless text leave in the first
stage; texts of any length are read whole; of equal or near-equal texts the one with
the smallest id stays, of rows that repeat an id and its words one; a repeated id with
other words stays; null ids, languages and sources are kept as they are; further columns,
whatever their names, go along until the last stage; empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fluxlake.llm import language_id, ngram_join, packing, quality_gam, secret_scan
from fluxlake.llm.common import discard, materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep(docs, language_id.fit(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_gam.keep(docs, quality_gam.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), added=True)


STAGES = [
    ("language_id", language),
    ("quality_gam", quality),
    ("ngram_join", near_duplicates),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: Language models, boosted tables, forests and a tokenizer are beyond SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

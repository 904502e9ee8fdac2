"""Corpus pipeline: from raw documents to token ids.

Every stage works on all rows that the one before it kept.  All but the last
return the columns of ``documents``.  Stages have no SQL form; tests compare
each with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgsieve.llm.common import scratch, table
from msgsieve.llm.decontaminate import clean_documents
from msgsieve.llm.mixing import mixed_documents
from msgsieve.llm.ngram_join import keep_one_of_each
from msgsieve.llm.token_store import read_store, write_store
from msgsieve.llm.toxicity import drop_toxic, fit_toxicity, learnable
from msgsieve.session import prepare, ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    labels = table(prepare(ship(spark)), sf_dir, "labels").where(learnable(F.col("doc_id")))
    return drop_toxic(docs, fit_toxicity(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five words, the smallest id stays."""
    prepare(ship(spark))
    return keep_one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage like a benchmark item go."""
    return clean_documents(docs, table(prepare(ship(spark)), sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    prepare(ship(spark))
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written to a store and read back: one row per document."""
    path = scratch(prepare(ship(spark)), "token-store")
    write_store(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    return read_store(spark, path)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix), ("token_ids", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

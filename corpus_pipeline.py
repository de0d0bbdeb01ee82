"""Corpus pipeline: language ID, toxicity, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's docs.

Defined results: rows whose text is null or has no letter go in the first stage; a corpus in which no row has a lang
keeps all others; rows that repeat a doc_id, or have none, are taken one by one; of equal texts one row stays, that of the least doc_id;
other columns of the documents go with their rows up to the last stage, which gives the packing's own columns alone; an empty
table gives no row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sonorel.llm import common, langid, ngram_join, packing, toxicity


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, and those that no learned language has a majority for, go."""
    return langid.keep_identified(docs, langid.train(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near duplicates: five-word n-grams, Jaccard 0.8."""
    return ngram_join.keep_one_of_each(docs, n=5, threshold=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where in which training sequence each document, or each piece of a long one, goes; lengths are token ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: Learned models and a sequential packing: not SQL. Tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

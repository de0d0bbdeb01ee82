"""Registered queries of the corpus operators: thin wrappers that apply each operator, with production
parameters, to its whole table and shape the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorel.llm import ann, bpe, chat, collocations, common, fingerprints, html_extract, langid, ngram_join, packing, resample, simhash, token_files, toxicity
from sonorel.llm.oracle import ORACLES  # noqa: F401


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(common.table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(common.table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(common.table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), memo=token_files.MEMO)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_messages(common.table(spark, sf_dir, "conversations"))


def chat_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls derived from the conversations, which hold none: every answer calls a tool with itself and the result of the
    answer after the next one, and its result lies before its call."""
    rows = common.table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    answers, at = rows.filter("role = 'assistant'"), lambda k: F.concat(F.lit("c"), F.col("turn") + k)
    args = F.struct(F.col("text").alias("query"), (F.col("turn") % 3).alias("limit"), F.create_map(F.lit("$result"), at(2)).alias("after"))
    call = F.to_json(F.struct(F.col("text").alias("content"), F.array(F.struct(at(0).alias("id"), F.lit("search").alias("name"), args.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(at(0).alias("tool_call_id"), F.col("text").alias("content")))
    calls = answers.select("conv_id", (F.col("turn") * 2 + 1).alias("turn"), "role", call.alias("text"))
    results = answers.select("conv_id", (F.col("turn") * 2).alias("turn"), F.lit("tool").alias("role"), result.alias("text"))
    others = rows.filter("role <> 'assistant'").select("conv_id", (F.col("turn") * 2).alias("turn"), "role", "text")
    search = chat.TOOLS["search"] | {"properties": chat.TOOLS["search"]["properties"] | {"after": True}}
    return chat.format_messages(calls.union(results).union(others), {"search": search})


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(common.table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_html": op2_html,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_files": op6_token_files,
    "op7_packing": op7_packing,
    "op8_ann": op8_ann,
    "op9_chat": op9_chat,
    "chat_calls": chat_calls,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_simhash": op12_simhash,
    "op13_resample": op13_resample,
}

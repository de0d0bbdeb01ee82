"""Persisted catalogues: posting tables clustered by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonorel.operators.matching import stop_hashes


def save_index(references: DataFrame, table: str, buckets: int, max_postings: int | None = None, key: str = "hash") -> None:
    """Write postings bucketed and sorted by their hash, so votes are joined without shuffling the catalogue; hashes
    over ``max_postings`` are left out."""
    kept = references if max_postings is None else stop_hashes(references, max_postings)
    kept.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)


def load_index(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)

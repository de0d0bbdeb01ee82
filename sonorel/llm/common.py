"""Helpers shared by the corpus operators: shared storage, tables, size-checked joins, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes of row data; beyond it Spark shuffles.
BROADCAST_BYTES = 16 << 20
#: A key of more than one in so many rows is a heavy one.
HEAVY = 1000
#: Bytes of text from which a pass over Arrow batches sends on what it has made of them.
PIECE_BYTES = 1 << 20

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the session names none (tests, a laptop) a temporary local folder is made.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="sonorel-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader of it: cuts the lineage,
    is computed once, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """All rows of ``batches`` in their order, in slices of little more than ``PIECE_BYTES`` of the string ``column``, or one
    row: what a worker holds, and sends in one batch, then doesn't grow with the thousands of rows of Spark's batches."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE_BYTES)) + 1).tolist(), b.num_rows]
        for at, to in zip(cuts, cuts[1:]):
            yield b.slice(at, to - at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are sure to fit ``limit``; else ``df`` for a
    shuffled join. Give a materialised table: it is counted."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def semi_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(small_side(keys, 24), key, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(small_side(keys, 24), key, "left_anti")


def counted_join(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, total: int, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``per_key``, which has one row a key and, in its column ``count``, how many
    of the ``total`` rows have the key, without sending a frequent key's rows to one task.

    Keys of more than one in ``HEAVY`` rows number fewer than ``HEAVY``, whatever the input: these are broadcast, and
    their rows take a key that nothing else has, dealt by the columns ``spread``, through the shuffle of the others.
    """
    frequent = F.col(count) * HEAVY > total
    new = [c for c in per_key.columns if c not in keys]
    heavy = per_key.filter(frequent).select(*keys, *[F.col(c).alias(f"heavy_{c}") for c in new])
    salt = F.when(F.col(f"heavy_{count}").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(HEAVY)))
    tagged = rows.join(F.broadcast(heavy), keys, "left").withColumn("salt", salt.cast("int"))
    light = per_key.filter(~frequent).withColumn("salt", F.lit(0))
    out = tagged.join(light, [*keys, "salt"], "left")
    if how == "inner":
        out = out.filter(F.col(count).isNotNull() | F.col(f"heavy_{count}").isNotNull())
    return out.select(*rows.columns, *[F.coalesce(f"heavy_{c}", c).alias(c) for c in new])


def numbered(df: DataFrame, key: str, name: str = "row") -> DataFrame:
    """``df`` with a long ``name`` that no two rows share: ``key`` (a long) if it is one, else a number given in a written copy."""
    repeated = df.groupBy(key).agg(F.count("*").alias("c")).filter(F.col(key).isNull() | (F.col("c") > 1))
    if repeated.isEmpty():
        return df.withColumn(name, F.col(key))
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Least reachable node of each node of ``edges`` (columns ``a``, ``b``: long, not null).

    Alternates large-star and small-star steps until the edges stop changing; each step is two
    aggregations with map-side combining over the edges alone, and is written to the shared folder,
    so lineage stays short. Nodes of many edges are joined by broadcast. Returns ``node``, ``component`` for every node
    that has an edge.
    """
    cur = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        name,
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first())

    seen = state(cur)
    while True:
        total = seen[0]
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")).withColumn("m", F.least("a", "m"))
        large = counted_join(both, least, ["a"], "c", 2 * total, ["b"]).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        small = (
            counted_join(large, least, ["a"], "c", large.count(), ["b"])
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                        F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")),
                    )
                ).alias("e")
            )
            .select("e.*")
            .filter("a <> b")
            .distinct()
        )
        nxt = materialize(small, name)
        now = state(nxt)
        if now == seen:
            break
        seen, cur = now, nxt
    return nxt.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        nxt.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

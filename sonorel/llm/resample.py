"""Target-distribution importance resampling: documents drawn in proportion to how much likelier their word runs are in a
target corpus.

1. Each piece of some texts becomes one row of packed uint16 buckets, with doc_ids and offsets, written to the shared folder.
2. Counts: every stream is sorted and run-length encoded, and a task sends one count a bucket at most; Spark adds them up.
3. Gains of the buckets (at most 65 536, so their size is bounded) go to all tasks; a second pass over the streams, not the texts,
   gathers them and sums each document's with ``np.add.reduceat``.
4. Scores with noise by doc_id (Gumbel, so the highest are a draw without replacement) are sorted by ranges over all
   tasks; a document's rank is its place in its range after the sizes of the ranges before.

Defined results: null texts and texts without a word have no features, weight 0 and, like all texts of fewer than
``least_words`` words, no rank; rows of a repeated doc_id are taken one by one, in any order among themselves; rows without a doc_id
have no score and no rank; equal scores go by the smaller doc_id; an empty table gives no row, an empty target gives each bucket
the gain of an absent one; other columns are ignored. A very long text is a stream of its own.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonorel.llm import common

RUN = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42

#: Letters in lower case, digits and all bytes beyond ASCII stay; whatever else is a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def buckets(flat: list[bytes], lens: np.ndarray, run: int = RUN, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all runs of 1 to ``run`` words, document by document, as uint16; how many each document has) of the words of
    some documents, which have ``lens`` words."""
    size = len(flat)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(size)  # words from here to the document's end
    behind = [b" " + w for w in flat]
    sums = list(map(crc32, flat))
    out = np.zeros((size, run), np.uint16)
    for k in range(run):
        if k:  # a run's checksum goes on from that of its first words; runs over a document's end are dropped below
            sums = list(map(crc32, behind[k:], sums))
        out[: len(sums), k] = np.array(sums, np.int64) % n
    held = left[:, None] > np.arange(run)
    per_word = held.sum(axis=1)
    ends = np.concatenate([[0], np.cumsum(per_word)])
    at = np.concatenate([[0], np.cumsum(lens)])
    return out[held], np.diff(ends[at])


def streams(docs: DataFrame, run: int = RUN, n: int = BUCKETS) -> DataFrame:
    """doc_ids, n_words, sizes (features of each), buckets: a row for about a megabyte of text; written."""
    if not 0 < n <= 1 << 16:
        raise ValueError("buckets are 16 bits wide")

    def make(batches):
        for b in common.pieces(batches):
            flat, lens = [], []
            for t in b.column("text").to_pylist():
                w = words(t)
                flat += w
                lens.append(len(w))
            packed, sizes = buckets(flat, np.array(lens, np.int64), run, n)
            row = [pa.array([x], k) for x, k in ((b.column("doc_id").to_pylist(), pa.list_(pa.int64())), (lens, pa.list_(pa.int64())), (sizes, pa.list_(pa.int64())), (packed.astype("<u2").tobytes(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(row, names=["doc_ids", "n_words", "sizes", "buckets"])

    schema = "doc_ids array<bigint>, n_words array<bigint>, sizes array<bigint>, buckets binary"
    return common.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, schema), "streams")


def counts(packed: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the streams."""

    def run(batches):
        total = np.zeros(n, np.int64)
        for b in batches:
            for s in b.column("buckets"):
                x = np.sort(np.frombuffer(s.as_buffer(), "<u2"))
                starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
                total[x[starts]] += np.diff(np.append(starts, len(x)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "c"])

    out = np.zeros(n, np.int64)
    rows = packed.select("buckets").mapInArrow(run, "bucket bigint, c bigint").groupBy("bucket").agg(F.sum("c").alias("c"))
    for r in rows.collect():  # one row a bucket
        out[r.bucket] = r.c
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, each count plus one, rounded down."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight"""

    def run(batches):
        for b in batches:
            for ids, n_words, sizes, s in zip(*[b.column(c) for c in ("doc_ids", "n_words", "sizes", "buckets")], strict=True):
                sizes = sizes.values.to_numpy()
                sums = np.zeros(len(sizes), np.int64)
                some = np.flatnonzero(sizes)
                if len(some):
                    starts = (np.cumsum(sizes) - sizes)[some]
                    sums[some] = np.add.reduceat(gain[np.frombuffer(s.as_buffer(), "<u2")], starts)
                yield pa.RecordBatch.from_arrays([ids.values, n_words.values, pa.array(sizes), pa.array(sums)], names=["doc_id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, run: int = RUN, n: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every row of ``docs`` (doc_id, text), towards the texts of
    ``target`` (text)."""
    packed = streams(docs, run, n)
    gain = gains(counts(packed, n), counts(streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), run, n), n))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rated = common.materialize(weights(packed, gain).withColumn("score", F.col("weight") + noise), "scores")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    quota = rated.filter(able).count() * percent // 100
    # rows in order over all tasks: their number says the range's number and the place in it
    ordered = rated.filter(able).orderBy(F.desc("score"), "doc_id").withColumn("at", F.monotonically_increasing_id())
    ordered = common.materialize(ordered.select("doc_id", "n_features", "weight", "score", "at"), "ordered")
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("c"))  # one row a range
    bases = sizes.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("base"))
    ordered = ordered.join(F.broadcast(bases), "part")
    rank = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = ordered.select("doc_id", "n_features", "weight", "score", F.when(rank <= quota, rank).alias("rank"))
    return drawn.union(rated.filter(~F.coalesce(able, F.lit(False))).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))

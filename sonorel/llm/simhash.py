"""SimHash near duplicates by anchor points: every fingerprint goes to all words of a covering code within the covering radius
plus the threshold, and fingerprints are compared per anchor.

The code is two Golay codes of 23 bits side by side, on the fingerprint's lowest 46 bits: 2^24 anchors, covering radius 6.
Two fingerprints that differ in at most 2 of 64 bits do so in those 46 too; the anchor next to one of them is within 6 of
it and within 8 of the other, so both are there. A fingerprint has 78 anchors on average and 1 519 at most.

Equal fingerprints are one row before that. Anchors are counted with map-side combining; one that more than ``CROWD``
different fingerprints share isn't compared pair by pair: its members are put under every bit string within one bit of
them, where any two are within 2 bits of each other and two within 2 bits always meet, so each string's members link to
the least of them (at most 65). That is exact, has no pairs, and no key of more than 65 rows. Links give the components.

Defined results: null, empty and word-free texts have fingerprint zero and link like any other; texts shorter than three
words have one shingle, the whole sequence; rows that repeat a doc_id, or have none, are taken one by one; a component is
named after its least doc_id (null if none of its rows has one); ties don't matter, as no order does; other columns are
ignored; an empty table gives no row. A very long text is hashed in slices of its shingles.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorel.llm import common

WORDS = 3
SEED = 42
THRESHOLD = 2
#: Different fingerprints of an anchor beyond which they aren't compared pair by pair.
CROWD = 256
#: Shingles whose bits are added at once.
SLICE = 1 << 15
#: Different fingerprints whose anchors a task makes.
ANCHORED = 10_000
#: Generator polynomial of the Golay code of 23 bits (a fixed value), its length, dimension and covering radius.
POLYNOMIAL, LENGTH, DIMENSION, RADIUS = 0b101011100011, 23, 12, 3


def fingerprint(text: str | None, n: int = WORDS, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = min(n, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    starts, ends = starts[: len(words) - n + 1], ends[n - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), SLICE):
        some = [joined[a:z] for a, z in zip(starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist(), strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(seed)), np.dtype("<u8"), len(some))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for b in common.pieces(batches):
            fp = np.array([fingerprint(t, n, seed) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainder of each word, as a polynomial over two elements, by the code's: what tells how it lies to the code."""
    out = words.copy()
    for bit in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        out ^= np.where((out >> bit) & 1 > 0, POLYNOMIAL << (bit - (LENGTH - DIMENSION)), 0)
    return out


@lru_cache(maxsize=2)
def _errors(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns of up to ``most`` bits, ordered by remainder and weight; start of each remainder and weight among them)"""
    words = np.arange(1 << LENGTH)
    weight = np.bitwise_count(words)
    words, weight = words[weight <= most], weight[weight <= most].astype(np.int64)
    key = _remainders(words) * (most + 1) + weight
    order = np.argsort(key, kind="stable")
    return words[order], np.searchsorted(key[order], np.arange((most + 1 << LENGTH - DIMENSION) + 1))


def anchors_of(fp: int, threshold: int = THRESHOLD) -> np.ndarray:
    """All words of the code within its covering radius plus ``threshold`` of the fingerprint."""
    most = 2 * RADIUS + threshold
    patterns, starts = _errors(most)
    low, high = fp & (1 << LENGTH) - 1, fp >> LENGTH & (1 << LENGTH) - 1
    (a, b) = (int(s) * (most + 1) for s in _remainders(np.array([low, high])))
    out = []
    for w in range(most + 1):
        first = patterns[starts[a + w] : starts[a + w + 1]]
        if len(first):
            second = patterns[starts[b] : starts[b + most - w + 1]]
            out.append(((high ^ second)[None] << LENGTH | (low ^ first)[:, None]).ravel())
    return np.concatenate(out)


def _anchored(distinct: DataFrame, threshold: int) -> DataFrame:
    """anchor, fp"""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                fps = b.column("fp").slice(at, 1000).to_pylist()
                found = [anchors_of(fp & (1 << 64) - 1, threshold) for fp in fps]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(fps, [len(x) for x in found]))], names=["anchor", "fp"])

    tasks = distinct.count() // ANCHORED + 1  # fingerprints are small and their anchors aren't
    return distinct.select("fp").repartition(tasks).mapInArrow(run, "anchor bigint, fp bigint")


def _near(anchored: DataFrame, threshold: int) -> DataFrame:
    """a, b: fingerprints of one anchor within ``threshold`` bits. Rows come sorted by anchor, ``CROWD`` of each at most."""

    def linked(anchor: np.ndarray, fp: np.ndarray):
        found, step = [], 1
        while len(anchor) > step and (same := anchor[step:] == anchor[:-step]).any():
            at = np.flatnonzero(same)
            at = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= threshold]
            found.append(np.stack([fp[at], fp[at + step]]))
            step += 1
        return np.sort(np.concatenate(found, axis=1), axis=0) if found else np.empty((2, 0), np.int64)

    def run(batches):
        rest = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in (x for x in batches if x.num_rows):
            anchor, fp = (np.concatenate([r, b.column(c).to_numpy()]) for r, c in zip(rest, ("anchor", "fp"), strict=True))
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            rest = anchor[cut:], fp[cut:]
            pairs = linked(anchor[:cut], fp[:cut])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
        pairs = linked(*rest)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return anchored.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "a bigint, b bigint").distinct()


def _crowded(fps: DataFrame, threshold: int) -> DataFrame:
    """a, b: links that join whatever is within the threshold among ``fps``: under each bit string, to the least of those
    within a bit of it (2), or to that string itself if it is one of them (1)."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    balls = fps.select("fp", F.explode(F.concat(F.array("fp"), bits)).alias("centre"))
    groups = balls.groupBy("centre").agg(F.collect_list("fp").alias("s")).filter(F.size("s") > 1)  # 65 at most
    if threshold == 1:
        groups = groups.filter(F.array_contains("s", F.col("centre")))
    return groups.select(F.explode("s").alias("a"), (F.col("centre") if threshold == 1 else F.array_min("s")).alias("b")).filter("a <> b").distinct()


def links(distinct: DataFrame, threshold: int = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """a, b: links among the different fingerprints ``fp``; their components are those of all pairs within the threshold."""
    if not 1 <= threshold <= THRESHOLD:
        raise ValueError("crowded anchors are split for thresholds of 1 and 2")
    anchored = common.materialize(_anchored(distinct, threshold), "anchors")
    full = common.materialize(anchored.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") > crowd).select("anchor"), "crowded")
    near = _near(common.anti_join(anchored, full, "anchor"), threshold)
    if full.isEmpty():
        return near
    members = common.materialize(common.semi_join(anchored, full, "anchor").select("fp").distinct(), "crowds")
    return near.union(_crowded(members, threshold))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text)."""
    rows = common.materialize(fingerprints(docs), "fingerprints")
    distinct = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    joined = common.connected_components(links(distinct, threshold), "simhash").withColumnRenamed("node", "fp")
    of_fp = distinct.join(common.small_side(common.materialize(joined, "joined"), 24), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = of_fp.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    named = common.counted_join(of_fp, first, ["component"], "c", distinct.count(), spread=["fp"]).select("fp", "copies", "component_id")
    named = common.materialize(named, "named")
    found = common.counted_join(rows, named, ["fp"], "copies", rows.count(), spread=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

All of it is column expressions, without Python on the executors:

* a text's words are runs of anything but ASCII white space, with A-Z in lower case; its shingles are five
  words in a row (the whole sequence, if it has fewer), hashed once to 64 bits;
* the top bits of a hash name its bin; the least hash of a bin is its value. One marker per bin is sorted in
  with the hashes, so the first entry of each bin, in order, is its value or shows that it is empty;
* an empty bin takes over the value of the first non-empty bin among its own random probes (optimal
  densification); if all of ``PROBES`` are empty, of that non-empty bin that a hash of both ranks first;
* of each value, hashed with its bin's number so that bins that share a value agree or differ independently,
  the low-order ``BITS`` bits are kept and packed into 64-bit words, written as hexadecimal.

The likeness of two fingerprints is the share of equal bins, corrected for the 2^-BITS that agree by chance.

Defined results: null is fingerprinted as the empty text; texts without words have the empty fingerprint, of
likeness 1 to one another and 0 to all others; equal texts have equal fingerprints; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorel.llm import common

WORDS = 5
BIN_BITS = 9
BINS = 1 << BIN_BITS
BITS = 4
PER_WORD = 64 // BITS
PROBES = 12
#: Documents that a bucket of consecutive ids should hold, about.
BUCKET_ROWS = 128

_VALUE_BITS = 64 - BIN_BITS
_VALUE_MASK = (1 << _VALUE_BITS) - 1


def probe_table(seed: int = 5) -> list[int]:
    """``PROBES`` random bins for each bin."""
    return np.random.default_rng(seed).integers(0, BINS, BINS * PROBES).tolist()


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with column ``out``: the packed fingerprint of column ``text``, array<bigint>; empty without words.

    Each step is a column of its own, for what a lambda refers to must not be computed anew per element.
    """
    w, n, s, d, m = (f"__{out}_{x}" for x in "wnsdm")
    keep = [c for c in df.columns if c != out]
    word = lambda i: F.get(F.col(w), i)
    step = df.select(*keep, F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda x: F.xxhash64(x)).alias(w)).withColumn(n, F.size(w))
    shingles = F.when(
        F.col(n) >= WORDS,
        F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - WORDS, F.lit(0))), lambda i: F.xxhash64(*[word(i + k) for k in range(WORDS)])),
    ).otherwise(F.array(F.xxhash64(F.col(w))))
    # bins in the order of signed integers; the marker is the largest value of its bin
    low = -(1 << (BIN_BITS - 1))
    marks = F.transform(F.sequence(F.lit(low), F.lit(low + BINS - 1)), lambda i: F.shiftleft(i.cast("bigint"), _VALUE_BITS).bitwiseOR(F.lit(_VALUE_MASK)))
    step = step.withColumn(s, F.sort_array(F.concat(shingles, marks)))
    first = F.filter(F.col(s), lambda x, i: (i == 0) | (F.shiftright(x, _VALUE_BITS) != F.shiftright(F.get(F.col(s), i - 1), _VALUE_BITS)))
    # values of the bins, null where empty
    step = step.select(*keep, n, first.alias(s))
    value = F.transform(F.col(s), lambda x: F.when(x.bitwiseAND(F.lit(_VALUE_MASK)) != _VALUE_MASK, x))
    step = step.select(*keep, n, value.alias(d)).withColumn(m, F.filter(F.col(d), lambda x: x.isNotNull()))
    probes = F.lit(np.array(probe_table(), np.int32))
    at = lambda i, a: F.get(F.col(d), F.get(probes, i * PROBES + a))
    # the non-empty bin that a hash of (this bin, that bin) ranks first
    ranked = lambda i: F.array_min(
        F.transform(F.col(m), lambda x: F.struct(F.xxhash64(i, F.shiftright(x, _VALUE_BITS)).alias("h"), x.alias("x")))
    ).getField("x")
    dense = F.transform(F.col(d), lambda x, i: F.coalesce(x, *[at(i, a) for a in range(PROBES)], F.when(F.size(m) > 0, ranked(i))))
    step = step.select(*keep, n, dense.alias(d))
    bits = (1 << BITS) - 1

    def pack(i: Column) -> Column:
        got = F.lit(0).cast("bigint")
        for k in range(PER_WORD):
            mixed = F.xxhash64(F.get(F.col(d), i * PER_WORD + k), i * PER_WORD + k)
            got = got.bitwiseOR(F.shiftleft(mixed.bitwiseAND(F.lit(bits)), BITS * k))
        return got

    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), pack)
    return step.select(*keep, F.when(F.col(n) > 0, packed).otherwise(F.array().cast("array<bigint>")).alias(out))


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1."""
    mask = sum(1 << (BITS * k) for k in range(PER_WORD))
    signed = mask - (1 << 64) if mask >= 1 << 63 else mask

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (1, 2):  # any of a bin's bits, in its lowest
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(signed)))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    equal = 1 - apart.cast("double") / BINS
    chance = 2.0**-BITS
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), (equal - chance) / (1 - chance)))
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fp``: the packed fingerprint of ``text``."""
    return with_fingerprint(docs, "text", "fp")


def _next_bucket(buckets: DataFrame) -> DataFrame:
    """bucket, next: the next larger bucket that holds rows, after the last the first. Neighbours are found
    within groups of 4096 buckets, then between groups, so no task gets more than a small share of them."""
    group = F.shiftright("bucket", 12)
    inner = buckets.select("bucket", group.alias("g")).withColumn("next", F.lead("bucket").over(Window.partitionBy("g").orderBy("bucket")))
    firsts = buckets.groupBy(group.alias("g")).agg(F.min("bucket").alias("first"))
    w = Window.orderBy("g")
    after = firsts.select("g", F.coalesce(F.lead("first").over(w), F.first("first").over(w)).alias("after"))
    return inner.join(after, "g").select("bucket", F.coalesce("next", "after").alias("next"))


def with_next(docs: DataFrame, prepare: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """``prepare(docs)`` (doc_id, ...) with ``next_<c>`` for each of ``columns``: those of the document that follows
    in ascending doc_id, after the last the first. Rows that repeat a doc_id follow one another, ordered by the
    given columns; rows without a doc_id have no next document (nulls).

    One shuffle deals the rows by ranges of their id, and within a range a window finds the next row. The last
    row of a range gets the first row of the range after it; those first rows, one a range, are picked by id.
    """
    rows = prepare(docs)
    some = docs.select("doc_id").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in columns]
    if not some.n:
        return rows.select("*", *nothing)
    width = max(1, -(-(some.hi - some.lo + 1) * BUCKET_ROWS // some.n))
    bucket = F.coalesce(F.floor((F.col("doc_id").cast("double") - float(some.lo)) / F.lit(float(width))).cast("long"), F.lit(0).cast("long"))
    known = docs.filter(F.col("doc_id").isNotNull())
    buckets = common.materialize(known.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.min("doc_id").alias("doc_id")), "buckets")
    wanted = _next_bucket(buckets.select("bucket")).join(buckets.withColumnRenamed("bucket", "next"), "next").select("doc_id", "bucket")
    wanted = common.small_side(common.materialize(wanted, "first-ids"), 32)
    firsts = prepare(known.join(wanted, "doc_id")).groupBy("bucket").agg(F.min(F.struct(*columns)).alias("first"))
    w = Window.partitionBy("bucket").orderBy("doc_id", *columns)
    plain = rows.columns
    inner = prepare(known).withColumn("bucket", bucket).select("*", F.lead("doc_id").over(w).alias("__after"), *[F.lead(c).over(w).alias(f"__{c}") for c in columns])
    after = [F.when(F.col("__after").isNull(), F.col(f"first.{c}")).otherwise(F.col(f"__{c}")).alias(f"next_{c}") for c in columns]
    return inner.join(firsts, "bucket").select(*plain, *after).union(rows.filter(F.col("doc_id").isNull()).select("*", *nothing))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last half replaced by the beginning of the next
    document), and their likeness to each other and to the next document's."""
    rows = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fingerprint, ["text", "fp"])
    text, after = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", "fp", "next_fp", n.cast("long").alias("n_chars"), F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half)).alias("edited"))
    rows = with_fingerprint(rows.withColumn("edited_sha256", F.sha2(F.col("edited"), 256)), "edited", "edited_fp")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        F.coalesce(likeness(F.col("fp"), F.col("next_fp")), F.lit(0.0)).alias("near_next"),
    )

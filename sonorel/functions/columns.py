"""Scalar functions as Spark column expressions: they stay in the JVM and in the plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

C = Column


def _dot(a: C, b: C) -> C:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def window_value(kind: str, k: C, n: int | C) -> C:
    """k-th point of the periodic window of n points."""
    if not isinstance(n, C) and n <= 1:
        return F.lit(1.0)
    x = F.lit(2 * math.pi) * k / n
    if kind == "hann":
        v = 0.5 - 0.5 * F.cos(x)
    elif kind == "hamming":
        v = 0.54 - 0.46 * F.cos(x)
    else:
        v = 0.42 - 0.5 * F.cos(x) + 0.08 * F.cos(2 * x)
    return F.when(n <= 1, 1.0).otherwise(v) if isinstance(n, C) else v


def make_window(kind: str, n: int) -> C:
    """The window as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: window_value(kind, k, n)) if n > 0 else F.array().cast("array<double>")


def n_frames(n: C, n_fft: int, hop: int, center: bool) -> C:
    whole = F.floor(n / hop) + 1 if center else F.when(n < n_fft, 0).otherwise(F.floor((n - n_fft) / hop) + 1)
    return F.when(n == 0, 0).otherwise(whole).cast("bigint")


def power_to_db(p: C, floor: float = 1e-12) -> C:
    return 10 * F.log10(F.greatest(p, F.lit(floor)))


def resample_linear(x: C, from_rate: int, to_rate: int) -> C:
    if from_rate <= 0 or to_rate <= 0:
        raise ValueError("sample rates must be positive")
    if from_rate == to_rate:
        return x
    n = F.size(x)
    out = F.ceil(n * F.lit(to_rate).cast("bigint") / from_rate).cast("int")

    def at(k: C) -> C:
        pos = k * F.lit(from_rate / to_rate)
        i = F.floor(pos).cast("int")
        frac = pos - i
        return F.get(x, F.least(i, n - 1)) * (1 - frac) + F.get(x, F.least(i + 1, n - 1)) * frac

    return F.when(n == 0, F.slice(x, 1, 0).cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(out - 1, F.lit(0))), at))


def hz_to_mel(hz: C, scale: str) -> C:
    if scale == "htk":
        return 2595 * F.log10(1 + hz / 700)
    # fixed values of the Slaney scale
    return F.when(hz < 1000, hz * 3 / 200).otherwise(15 + F.log(hz / 1000) / 0.06875197)


def l2_normalize(v: C) -> C:
    norm = F.sqrt(_dot(v, v))
    return F.when(norm > 1e-12, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: C, b: C) -> C:
    return _dot(a, b)


def cosine(a: C, b: C, assume_normalized: bool = True) -> C:
    if assume_normalized:
        return _dot(a, b)
    na, nb = F.sqrt(_dot(a, a)), F.sqrt(_dot(b, b))
    return F.when((na < 1e-12) | (nb < 1e-12), 0.0).otherwise(_dot(a, b) / (na * nb))


def quantise_freq(f: C) -> C:
    return F.greatest(f - 1, F.lit(0)).cast("bigint")


def wang_hash(fa: C, fb: C, dt: C) -> C:
    low = lambda f: quantise_freq(f).bitwiseAND(F.lit(511).cast("bigint"))
    clamped = F.greatest(F.lit(1), F.least(dt, F.lit(16383))).cast("bigint")
    return F.shiftleft(low(fa), 23).bitwiseOR(F.shiftleft(low(fb), 14)).bitwiseOR(clamped)


def panako_hash(fa: C, fb: C, fc: C, ma: C, mb: C, mc: C, ta: C, tb: C, tc: C) -> C:
    sign = F.when(fb >= fa, 1).otherwise(0) + F.when(fc >= fb, 2).otherwise(0)
    order = F.when((ma >= mb) & (ma >= mc), 0).when(mb >= mc, 1).otherwise(2)
    beta = F.greatest(F.lit(0), F.least(F.lit(31), F.floor((tc - tb) / F.greatest(tc - ta, F.lit(1)) * 31 + 0.5)))
    byte = lambda d: F.pmod(F.greatest(F.lit(-127), F.least(F.lit(127), d)), F.lit(256)).cast("bigint")
    parts = [(sign, 30), (order, 28), (beta, 23), (byte(fb - fa), 15), (byte(fc - fb), 7)]
    out = F.lit(0).cast("bigint")
    for v, shift in parts:
        out = out.bitwiseOR(F.shiftleft(v.cast("bigint"), shift))
    return out


def bit_error(a: C, b: C) -> C:
    """Differing bits of two codes."""
    return F.bit_count(a.bitwiseXOR(b)).cast("bigint")


def overlap_at(q: C, r: C, delta: C) -> C:
    """Frames that overlap when the query is shifted by delta."""
    inside = F.when(delta >= 0, F.least(q, r - delta)).otherwise(F.least(q + delta, r))
    return F.greatest(inside, F.lit(0)).cast("bigint")


def flip_masks(flips: int) -> list[int]:
    """Masks of the codes that differ in up to ``flips`` (0, 1, 2) bits: exact, single flips, double flips."""
    one = [1 << i for i in range(32)]
    two = [one[i] | one[j] for i in range(32) for j in range(i + 1, 32)]
    return [0, *(one if flips >= 1 else []), *(two if flips >= 2 else [])]


def fps_compatible(a: C, b: C) -> C:
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    return F.coalesce(sound(a) & sound(b) & (F.abs(a - b) / F.greatest(a, b) <= 1e-3), F.lit(False))


def clamp_score(x: C) -> C:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def prominence(peak: C, total: C, bins: C) -> C:
    """Peak over one plus the mean of the other bins; 0 for a peak of 0."""
    rest = (total - peak) / F.greatest(bins - 1, F.lit(1))
    return F.when(peak == 0, 0.0).otherwise(peak / (rest + 1))


def offset(frames: C, fps: C) -> C:
    """struct<frames, ms>; half milliseconds go away from zero."""
    return F.struct(frames.cast("bigint").alias("frames"), F.round(frames * 1000 / fps).cast("bigint").alias("ms"))


def non_finite(samples: C) -> C:
    return F.exists(samples, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def sanitized(samples: C) -> C:
    return F.transform(samples, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x))


def truncated(samples: C, most: int) -> C:
    return F.slice(samples, 1, most)


def downmix(interleaved: C, channels: int) -> C:
    """Mean over the channels of each frame; what is left of a broken last frame is dropped."""
    n = F.floor(F.size(interleaved) / channels).cast("int")
    mean = lambda i: sum((F.get(interleaved, i * channels + k) for k in range(1, channels)), F.get(interleaved, i * channels)) / channels
    return F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), mean))


def jaccard(a: C, b: C) -> C:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def bit_similarity(a: C, b: C) -> C:
    """Share of equal bits over the common length of two arrays of codes."""
    n = F.least(F.size(a), F.size(b))
    wrong = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), bit_error), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return F.when(n == 0, 0.0).otherwise(1 - wrong / (32 * n))


def register(spark: SparkSession) -> None:
    """SQL names of the scalar helpers, as SQL functions (they are inlined into the plan)."""
    for ddl in (
        "sonorel_bit_error(a BIGINT, b BIGINT) RETURNS BIGINT RETURN cast(bit_count(a ^ b) AS BIGINT)",
        "sonorel_wang_hash(fa BIGINT, fb BIGINT, dt BIGINT) RETURNS BIGINT RETURN shiftleft(greatest(fa - 1, 0L) & 511L, 23) | shiftleft(greatest(fb - 1, 0L) & 511L, 14) | greatest(1L, least(dt, 16383L))",
        "sonorel_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {ddl}")

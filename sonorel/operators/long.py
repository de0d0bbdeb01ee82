"""Extraction from recordings of any length, kept as blocks of samples: segments with halos, one task a segment.

blocks: recording_id, sample_rate, at (number of the first sample), samples

A segment owns whole seconds, so that it closes them by itself: the strongest peaks of a second are chosen where all its
frames are. Beyond the frames it owns it gets, on both sides, the frames of the peak neighbourhood, and behind them those of the
target zone up to the end of that zone's last second: every owned anchor sees all its targets, and every seam is computed
from the same samples as in a single pass. Halos are made again in both segments that they belong to, so nothing is
exchanged later: blocks are shuffled once, to the segments that they reach into. Output equals that of
``spectral.extract_*``, whose limits on samples and hashes guard one row's memory and aren't needed here.

Recording-wide faults (values, rate, length, gaps or overlaps between blocks, in this order) are found by one map-side combined
aggregation; such a recording gives one row with the error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorel import errors
from sonorel.configs import Haitsma, Panako, Wang
from sonorel.functions import kernels as K
from sonorel.operators import spectral
from sonorel.schemas import ERROR
from sonorel.sources import shared

#: Seconds that a segment owns.
SEGMENT = 60


def blocks_of(recordings: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` samples of recordings that are one row each."""
    at = F.sequence(F.lit(0), F.greatest(F.size("samples") - 1, F.lit(0)), F.lit(size))
    cut = recordings.filter("samples IS NOT NULL").select("recording_id", "sample_rate", "samples", F.explode(at).alias("at"))
    return cut.select("recording_id", "sample_rate", F.col("at").cast("long").alias("at"), F.slice("samples", F.col("at") + 1, F.lit(size)).alias("samples"))


def _first_frame(second: int, fps: float) -> int:
    return math.ceil(second * fps)


class _Plan:
    """Which frames and samples the segments of a configuration own and need."""

    def __init__(self, cfg, seconds: int):
        self.cfg, self.seconds, self.fps = cfg, seconds, cfg.frames_per_sec
        if isinstance(cfg, Haitsma):
            self.before, self.behind = 0, 1  # a code compares a frame with the next
        else:
            self.reach = cfg.target_zone_t - isinstance(cfg, Panako)
            self.before = cfg.neighborhood

    def owned(self, k: int) -> tuple[int, int]:
        return _first_frame(k * self.seconds, self.fps), _first_frame((k + 1) * self.seconds, self.fps)

    def needed(self, k: int) -> tuple[int, int]:
        """Frames from and to, the latter excluded; they may lie beyond the recording."""
        lo, hi = self.owned(k)
        if isinstance(self.cfg, Haitsma):
            return lo, hi + self.behind
        last = math.floor((hi - 1 + self.reach) / self.fps)  # second of the farthest target
        return max(0, lo - self.before), _first_frame(last + 1, self.fps) + self.before

    def samples(self, k: int) -> tuple[int, int]:
        lo, hi = self.needed(k)
        return lo * self.cfg.stft.hop, (hi - 1) * self.cfg.stft.hop + self.cfg.stft.n_fft

    def segments(self, at: int, n: int) -> range:
        """Segments that need some of the samples at .. at + n - 1."""
        width = self.seconds * self.fps * self.cfg.stft.hop
        first = max(0, int(at / width) - 2 - int((self.samples(0)[1] - width) / width))
        while self.samples(first)[1] <= at:
            first += 1
        last = int((at + n) / width) + 2
        while last > first and self.samples(last)[0] >= at + n:
            last -= 1
        return range(first, last + 1)


def _landmarks(x: np.ndarray, k: int, plan: _Plan) -> list[np.ndarray]:
    cfg, (start, end), (lo, hi) = plan.cfg, plan.needed(k), plan.owned(k)
    db = K.decibels(spectral.spectrum(x, cfg))[: end - start]
    t, f, mag = K.peaks(db, cfg.neighborhood, cfg.neighborhood, cfg.min_anchor_mag_db, 0, plan.fps)
    t = t + start
    # whole seconds only: of frames before the owned ones, and of the last frames, the neighbourhood may be cut
    keep = (t >= lo) & (t < end - cfg.neighborhood)
    t, f, mag = K.strongest(t[keep], f[keep], mag[keep], cfg.peaks_per_sec, plan.fps)
    if isinstance(cfg, Panako):
        a, b, c = K.landmark_triples(t, f, mag, cfg.target_zone_t, cfg.target_zone_f, cfg.fan_out)
        own = t[a] < hi
        a, b, c = a[own], b[own], c[own]
        return [K.panako_hash((f[a], f[b], f[c]), (mag[a], mag[b], mag[c]), (t[a], t[b], t[c])), t[a], t[b], t[c]]
    a, b = K.landmark_pairs(t, f, mag, cfg.target_zone_t, cfg.target_zone_f, cfg.fan_out)
    own = t[a] < hi
    a, b = a[own], b[own]
    return [K.wang_hash(f[a], f[b], t[b] - t[a]), t[a]]


def _codes(x: np.ndarray, k: int, plan: _Plan) -> list[np.ndarray]:
    codes = spectral.haitsma_frames_of(x, plan.cfg)[1][: plan.owned(k)[1] - plan.owned(k)[0]]
    return [np.arange(len(codes)) + plan.owned(k)[0], codes]


def faults(blocks: DataFrame, cfg) -> DataFrame:
    """recording_id, error of the recordings that can't be used."""
    bad = F.array_position(F.transform("samples", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), True)
    n = F.sum(F.size("samples").cast("long"))
    got = blocks.groupBy("recording_id").agg(
        n.alias("n"), F.min(F.when(bad > 0, F.col("at") + bad - 1)).alias("bad"), F.min(F.coalesce("sample_rate", F.lit(-1))).alias("least"), F.max("sample_rate").alias("most"), F.min("at").alias("start"), F.max(F.col("at") + F.size("samples")).alias("end"),
        F.bit_xor(F.when(F.col("at") > 0, F.xxhash64("at")).otherwise(0).bitwiseXOR(F.xxhash64(F.col("at") + F.size("samples")))).bitwiseXOR(F.xxhash64(F.max(F.col("at") + F.size("samples")))).alias("seams"),
    )
    rate = F.when(F.col("least") != cfg.sample_rate, F.col("least")).otherwise(F.col("most"))
    tell = lambda code, detail: F.struct(F.lit(code).alias("code"), detail.alias("detail"))
    error = (
        F.when(F.col("bad").isNotNull(), tell(errors.NON_FINITE, F.format_string("sample %d", "bad")))
        .when(rate != cfg.sample_rate, tell(errors.BAD_RATE, F.format_string("%d Hz", rate)))
        .when(F.col("n") < cfg.min_samples, tell(errors.TOO_SHORT, F.format_string("%d samples", "n")))
        # blocks fit if each end but the last is a start: then these cancel out
        .when((F.col("start") != 0) | (F.col("end") != F.col("n")) | (F.col("seams") != 0), tell(errors.BAD_IO, F.lit("blocks leave gaps or overlap")))
    )
    return got.select("recording_id", error.alias("error")).filter("error IS NOT NULL")


def _extract(blocks: DataFrame, cfg, fields: list[str], make, seconds: int) -> DataFrame:
    if seconds < 1:
        raise errors.ConfigError("a segment owns at least one second")
    plan = _Plan(cfg, seconds)
    some = blocks.select(F.col("recording_id").cast("string"), F.col("sample_rate").cast("int"), F.col("at").cast("long"), F.col("samples").cast("array<float>")).filter("size(samples) > 0 OR at = 0")
    bad = shared.written(faults(some, cfg), "faults")
    good = some.join(shared.broadcast_if_small(bad.select("recording_id"), 64), "recording_id", "left_anti")

    def deal(batches):
        """Every block's share of each segment that needs some of it."""
        for b in batches:
            for rid, at, s in zip(b.column("recording_id"), b.column("at").to_pylist(), b.column("samples"), strict=True):
                x = s.values
                for k in plan.segments(at, len(x)):
                    lo, hi = plan.samples(k)
                    first, last = max(lo, at), min(hi, at + len(x))
                    if first < last:
                        part = pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), x.slice(first - at, last - first))
                        yield pa.RecordBatch.from_arrays([pa.array([rid.as_py()], pa.string()), pa.array([k]), pa.array([first]), part], names=["recording_id", "segment", "at", "samples"])

    def extract(key, table):
        table = table.sort_by("at")
        x = table.column("samples").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        cols = [np.asarray(c, np.int64) for c in make(x, key[1].as_py(), plan)]
        n = len(cols[0])
        return pa.table([pa.array([key[0].as_py()] * n, pa.string()), *map(pa.array, cols), pa.array([None] * n, spectral._ERROR)], names=["recording_id", *fields, "error"])

    schema = "recording_id string, " + "".join(f"{f} bigint, " for f in fields) + f"error {ERROR}"
    dealt = good.select("recording_id", "at", "samples").mapInArrow(deal, "recording_id string, segment bigint, at bigint, samples array<float>")
    found = dealt.groupBy("recording_id", "segment").applyInArrow(extract, schema)
    failed = bad.select("recording_id", *[F.lit(None).cast("long").alias(f) for f in fields], "error")
    return found.union(failed)


def extract_wang(blocks: DataFrame, cfg: Wang = Wang(), seconds: int = SEGMENT) -> DataFrame:
    """recording_id, hash, t_anchor, error"""
    return _extract(blocks, cfg, ["hash", "t_anchor"], _landmarks, seconds)


def extract_panako(blocks: DataFrame, cfg: Panako = Panako(), seconds: int = SEGMENT) -> DataFrame:
    """recording_id, hash, t_anchor, t_b, t_c, error"""
    return _extract(blocks, cfg, ["hash", "t_anchor", "t_b", "t_c"], _landmarks, seconds)


def extract_haitsma(blocks: DataFrame, cfg: Haitsma = Haitsma(), seconds: int = SEGMENT) -> DataFrame:
    """recording_id, pos, frame, error"""
    return _extract(blocks, cfg, ["pos", "frame"], _codes, seconds)

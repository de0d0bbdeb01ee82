"""Spectral front-ends over ``recordings`` (recording_id, sample_rate, samples): one Arrow pass per recording.

Rows that can't be used carry an ``error`` struct and no data, so one bad recording never fails a job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorel import errors
from sonorel.configs import Haitsma, Landmarks, Mel, Panako, Stft, Wang
from sonorel.functions import kernels as K
from sonorel.schemas import ERROR

_ERROR = pa.struct([("code", pa.string()), ("detail", pa.string())])


def fault(x: np.ndarray | None, rate: int | None, cfg) -> tuple[str, str] | None:
    """The first thing wrong with a recording: values, size, rate, length, in this order."""
    if x is None:
        return errors.TOO_SHORT, "no samples"
    bad = np.nonzero(~np.isfinite(x))[0]
    if len(bad):
        return errors.NON_FINITE, f"sample {bad[0]}"
    if cfg.max_input_samples is not None and len(x) > cfg.max_input_samples:
        return errors.TOO_LARGE, f"{len(x)} samples"
    if rate != cfg.sample_rate:
        return errors.BAD_RATE, f"{rate} Hz"
    if len(x) < cfg.min_samples:
        return errors.TOO_SHORT, f"{len(x)} samples"
    return None


def _samples(batch: pa.RecordBatch):
    for s in batch.column("samples"):
        yield None if not s.is_valid else s.values.to_numpy(zero_copy_only=False)


def power_rows(recordings: DataFrame, cfg: Stft, as_float32: bool = False) -> DataFrame:
    """recording_id, t, power: one row per frame, an array over bins."""
    kind = np.float32 if as_float32 else np.float64
    width = "float" if as_float32 else "double"

    def run(batches):
        for b in batches:
            for rid, x in zip(b.column("recording_id"), _samples(b), strict=True):
                p = K.power(np.zeros(0, kind) if x is None else x.astype(kind), cfg)
                for lo in range(0, len(p), 4096):
                    part = p[lo : lo + 4096]
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * cfg.n_bins), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([rid.as_py()] * len(part), pa.string()), pa.array(np.arange(lo, lo + len(part))), values], names=["recording_id", "t", "power"])

    return recordings.select(F.col("recording_id").cast("string"), "samples").mapInArrow(run, f"recording_id string, t bigint, power array<{width}>")


def frame_power(frames: DataFrame, cfg: Stft) -> DataFrame:
    """recording_id, power, error of single frames (recording_id, samples) of the transform's length; others, and null ones,
    have an error."""

    def run(batches):
        for b in batches:
            out = []
            for x in _samples(b):
                try:
                    out.append((K.frame_power(np.zeros(0) if x is None else x.astype(np.float64), cfg), None))
                except ValueError as e:
                    out.append((None, {"code": errors.BAD_FRAME, "detail": str(e)}))
            yield pa.RecordBatch.from_arrays([b.column("recording_id"), pa.array([o[0] for o in out], pa.list_(pa.float64())), pa.array([o[1] for o in out], _ERROR)], names=["recording_id", "power", "error"])

    return frames.select(F.col("recording_id").cast("string"), "samples").mapInArrow(run, f"recording_id string, power array<double>, error {ERROR}")


def power_long(rows: DataFrame) -> DataFrame:
    """Long form of ``power_rows``: recording_id, t, f, v."""
    return rows.select("recording_id", "t", F.posexplode("power").alias("f", "v")).withColumn("f", F.col("f").cast("bigint"))


def log_mel_rows(recordings: DataFrame, stft: Stft, mel: Mel) -> DataFrame:
    """recording_id, t, mel: log10 of mel-filtered power, one row per frame."""

    def run(batches):
        weights = K.mel_weights(mel)
        for b in batches:
            for rid, x in zip(b.column("recording_id"), _samples(b), strict=True):
                m = K.log_mel(K.power(np.zeros(0) if x is None else x.astype(np.float64), stft), weights)
                yield pa.RecordBatch.from_arrays([pa.array([rid.as_py()] * len(m), pa.string()), pa.array(np.arange(len(m))), pa.array(list(m), pa.list_(pa.float64()))], names=["recording_id", "t", "mel"])

    return recordings.select(F.col("recording_id").cast("string"), "samples").mapInArrow(run, "recording_id string, t bigint, mel array<double>")


def mel_weight_rows(options: DataFrame, scale: str = "slaney") -> DataFrame:
    """key, mel, f, weight: the weights that aren't 0 of the filters that each row (key, n_mels, n_fft, sample_rate) asks for."""

    def run(batches):
        for b in batches:
            for key, *o in zip(*[b.column(c).to_pylist() for c in ("key", "n_mels", "n_fft", "sample_rate")], strict=True):
                w = K.mel_weights(Mel(*o, scale=scale))
                mel, f = np.nonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(mel), pa.int64()), pa.array(mel), pa.array(f), pa.array(w[mel, f])], names=["key", "mel", "f", "weight"])

    some = options.select(F.col("key").cast("long"), *[F.col(c).cast("int") for c in ("n_mels", "n_fft", "sample_rate")])
    return some.mapInArrow(run, "key bigint, mel bigint, f bigint, weight double")


def resampled(recordings: DataFrame, rate: int, quality: dict | None = None) -> DataFrame:
    """Recordings at another rate, by windowed sinc; rows at that rate pass through."""

    def run(batches):
        for b in batches:
            out = []
            for r, x in zip(b.column("sample_rate"), _samples(b), strict=True):
                out.append(None if x is None or not r.as_py() or r.as_py() <= 0 else K.resample_sinc(x.astype(np.float32), r.as_py(), rate, **(quality or {})))
            yield pa.RecordBatch.from_arrays([b.column("recording_id"), pa.array([rate] * len(out), pa.int32()), pa.array(out, pa.list_(pa.float32()))], names=["recording_id", "sample_rate", "samples"])

    return recordings.select(F.col("recording_id").cast("string"), F.col("sample_rate").cast("int"), F.col("samples").cast("array<float>")).mapInArrow(run, "recording_id string, sample_rate int, samples array<float>")


def _extract(recordings: DataFrame, cfg, hashes_of, fields: list[str]) -> DataFrame:
    """recording_id, error, and one row per hash; a failed recording gives one row with the error."""

    def run(batches):
        for b in batches:
            for rid, rate, x in zip(b.column("recording_id"), b.column("sample_rate"), _samples(b), strict=True):
                wrong = fault(x, rate.as_py(), cfg)
                cols = None if wrong else hashes_of(x.astype(np.float32))
                most = getattr(cfg, "max_hashes", None)
                if cols is not None and most is not None and len(cols[0]) > most:
                    wrong, cols = (errors.TOO_LARGE, f"{len(cols[0])} hashes"), None
                if wrong:
                    arrays = [pa.array([rid.as_py()], pa.string()), *[pa.array([None], pa.int64()) for _ in fields], pa.array([{"code": wrong[0], "detail": wrong[1]}], _ERROR)]
                else:
                    n = len(cols[0])
                    arrays = [pa.array([rid.as_py()] * n, pa.string()), *[pa.array(np.asarray(c, np.int64)) for c in cols], pa.array([None] * n, _ERROR)]
                yield pa.RecordBatch.from_arrays(arrays, names=["recording_id", *fields, "error"])

    some = recordings.select(F.col("recording_id").cast("string"), F.col("sample_rate").cast("int"), F.col("samples").cast("array<float>"))
    return some.mapInArrow(run, "recording_id string, " + "".join(f"{f} bigint, " for f in fields) + f"error {ERROR}")


def spectrum(x: np.ndarray, cfg) -> np.ndarray:
    """Power of single-precision samples in double precision: in single precision peaks that differ in the seventh digit are one."""
    return K.power(x.astype(np.float64), cfg.stft)


def _peaks(x: np.ndarray, cfg: Landmarks):
    db = K.decibels(spectrum(x, cfg))
    return K.peaks(db, cfg.neighborhood, cfg.neighborhood, cfg.min_anchor_mag_db, cfg.peaks_per_sec, cfg.frames_per_sec)


def wang_hashes_of(x: np.ndarray, cfg: Wang):
    t, f, mag = _peaks(x, cfg)
    a, b = K.landmark_pairs(t, f, mag, cfg.target_zone_t, cfg.target_zone_f, cfg.fan_out)
    h, ta = K.wang_hash(f[a], f[b], t[b] - t[a]), t[a]
    order = np.lexsort((h, ta))
    return h[order], ta[order]


def panako_hashes_of(x: np.ndarray, cfg: Panako):
    t, f, mag = _peaks(x, cfg)
    a, b, c = K.landmark_triples(t, f, mag, cfg.target_zone_t, cfg.target_zone_f, cfg.fan_out)
    h = K.panako_hash((f[a], f[b], f[c]), (mag[a], mag[b], mag[c]), (t[a], t[b], t[c]))
    order = np.lexsort((h, t[c], t[b], t[a]))
    return h[order], t[a][order], t[b][order], t[c][order]


def haitsma_frames_of(x: np.ndarray, cfg: Haitsma):
    band = K.band_of_bin(cfg.fmin, cfg.fmax, cfg.sample_rate, cfg.stft.n_fft, cfg.bands)
    codes = K.frame_codes(K.band_energies(spectrum(x, cfg), band, cfg.bands))
    return np.arange(len(codes)), codes


def extract_wang(recordings: DataFrame, cfg: Wang = Wang()) -> DataFrame:
    return _extract(recordings, cfg, lambda x: wang_hashes_of(x, cfg), ["hash", "t_anchor"])


def extract_panako(recordings: DataFrame, cfg: Panako = Panako()) -> DataFrame:
    return _extract(recordings, cfg, lambda x: panako_hashes_of(x, cfg), ["hash", "t_anchor", "t_b", "t_c"])


def extract_haitsma(recordings: DataFrame, cfg: Haitsma = Haitsma()) -> DataFrame:
    return _extract(recordings, cfg, lambda x: haitsma_frames_of(x, cfg), ["pos", "frame"])

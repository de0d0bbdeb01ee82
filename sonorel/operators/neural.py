"""Neural embeddings and watermark detection: a user's ONNX model inside Arrow batches, one session per worker."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorel import errors
from sonorel.configs import Embedder, Stft, Watermark
from sonorel.functions import kernels as K
from sonorel.schemas import ERROR, WATERMARKS

_ERROR = pa.struct([("code", pa.string()), ("detail", pa.string())])
_sessions: dict[str, object] = {}


def session(model: str):
    """The ONNX session of a model file, shipped with the job (``addArtifact`` or a shared folder)."""
    if model not in _sessions:
        try:
            import onnxruntime
        except ImportError as e:
            raise errors.ConfigError("onnxruntime is not installed") from e
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        _sessions[model] = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
    return _sessions[model]


def onnx_embedding(model: str):
    """Callable from log-mel batches [n, mels, frames] to vectors."""

    def run(batch: np.ndarray) -> np.ndarray:
        s = session(model)
        out = s.run(None, {s.get_inputs()[0].name: batch.astype(np.float32)})[0]
        return np.asarray(out).reshape(len(batch), -1)

    return run


#: Weights that a network read from a table may have: they go to every task. Larger ones are model files.
MOST_WEIGHTS = 1 << 24


class DenseNetwork:
    """Callable on log-mel batches [n, mels, frames]: their means over frames go through layers (weights [units, inputs], biases)
    with rectifiers between them, in double precision. With ``digits``, outputs are rounded."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]], digits: int | None = None):
        for (a, _), (b, _) in zip(layers, layers[1:]):
            if b.shape[1] != len(a):
                raise errors.ConfigError(f"a layer of {b.shape[1]} inputs follows one of {len(a)} units")
        self.layers, self.digits = layers, digits

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        x = np.asarray(batch, np.float64).mean(axis=2)
        for k, (w, b) in enumerate(self.layers):
            x = (np.maximum(x, 0) if k else x) @ w.T + b
        return x if self.digits is None else np.round(x, self.digits)


def network(units: DataFrame, digits: int | None = None) -> DenseNetwork:
    """The network of a table: layer, unit, weights (one for each unit of the layer before, in their order), bias.
    ConfigError if the table is empty, holds nulls or layers that don't fit, or has more weights than ``MOST_WEIGHTS``."""
    rows = units.select(F.col("layer").cast("int").alias("layer"), F.col("unit").cast("long").alias("unit"), F.col("weights").cast("array<double>").alias("weights"), F.col("bias").cast("double").alias("bias"))
    unsound = F.col("layer").isNull() | F.col("unit").isNull() | F.col("bias").isNull() | F.coalesce(F.exists("weights", lambda w: w.isNull()), F.lit(True))
    n, bad = rows.agg(F.sum(F.size("weights") + 1), F.count_if(unsound)).first()
    if not n or bad or n > MOST_WEIGHTS:
        raise errors.ConfigError(f"{n or 0} weights" if not bad else f"{bad} units hold nulls")
    layers: dict[int, list] = {}
    for r in rows.orderBy("layer", "unit").collect():  # checked above
        layers.setdefault(r.layer, []).append(r)
    if any(len({len(r.weights) for r in v}) > 1 for v in layers.values()):
        raise errors.ConfigError("units of one layer have different numbers of weights")
    return DenseNetwork([(np.array([r.weights for r in v]), np.array([r.bias for r in v])) for v in layers.values()], digits)


def windows_to_vectors(x: np.ndarray, cfg: Embedder, model) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window in samples, its vector): full windows only; the tail is dropped."""
    w, h = cfg.window_samples, cfg.hop_samples
    starts = np.arange(0, len(x) - w + 1, h)
    stft, weights = Stft(cfg.n_fft, cfg.hop, cfg.window, center=False), K.mel_weights(cfg.mel)
    out = []
    for lo in range(0, len(starts), cfg.batch_size):
        mels = np.stack([K.log_mel(K.power(x[s : s + w].astype(np.float64), stft), weights).T for s in starts[lo : lo + cfg.batch_size]])
        v = np.asarray(model(mels), np.float32)
        if cfg.l2_normalize:
            n = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.where(n > 1e-12, v / np.maximum(n, 1e-30), v)
        out.append(v)
    return starts, np.concatenate(out) if out else np.empty((0, 0), np.float32)


def _wrong(x, rate, cfg, least: int) -> tuple[str, str] | None:
    if rate != cfg.sample_rate:
        return errors.BAD_RATE, f"{rate} Hz"
    n = 0 if x is None else len(x)
    if cfg.max_input_samples is not None and n > cfg.max_input_samples:
        return errors.TOO_LARGE, f"{n} samples"
    if isinstance(cfg, Watermark) and n == 0:
        return errors.TOO_SHORT, "no samples"
    bad = np.nonzero(~np.isfinite(x))[0] if n else []
    if len(bad):
        return errors.NON_FINITE, f"sample {bad[0]}"
    return (errors.TOO_SHORT, f"{n} samples") if n < least else None


def _rows(b: pa.RecordBatch):
    for rid, rate, s in zip(b.column("recording_id"), b.column("sample_rate"), b.column("samples"), strict=True):
        yield rid.as_py(), rate.as_py(), s.values.to_numpy(zero_copy_only=False).astype(np.float32) if s.is_valid else None


def embed(recordings: DataFrame, cfg: Embedder, model) -> DataFrame:
    """recording_id, idx, t_ms, vector, error. model: an ONNX file's path, or a callable on log-mel batches."""
    apply = onnx_embedding(model) if isinstance(model, str) else model

    def run(batches):
        for b in batches:
            for rid, rate, x in _rows(b):
                wrong = _wrong(x, rate, cfg, cfg.window_samples)
                starts, v = (np.empty(0, np.int64), []) if wrong else windows_to_vectors(x, cfg, apply)
                n = len(starts)
                cols = [[rid] * n, list(range(n)), [int(s) * 1000 // cfg.sample_rate for s in starts], [list(map(float, y)) for y in v], [None] * n]
                if wrong:
                    cols = [[rid], [None], [None], [None], [{"code": wrong[0], "detail": wrong[1]}]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float32()), _ERROR]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["recording_id", "idx", "t_ms", "vector", "error"])

    some = recordings.select(F.col("recording_id").cast("string"), F.col("sample_rate").cast("int"), F.col("samples").cast("array<float>"))
    return some.mapInArrow(run, f"recording_id string, idx bigint, t_ms bigint, vector array<float>, error {ERROR}")


def watermark_result(scores: np.ndarray, logits: np.ndarray, cfg: Watermark) -> tuple[bool, float, int, np.ndarray]:
    """(detected, confidence, message, localization) from a model's two outputs."""
    scores, logits = np.ravel(scores).astype(np.float32), np.ravel(logits)
    confidence = float(scores.mean()) if len(scores) else 0.0
    message = sum(1 << i for i in range(cfg.message_bits) if logits[i] >= 0) if len(logits) >= cfg.message_bits else 0
    return confidence > cfg.threshold, confidence, message, scores


def detect_watermarks(recordings: DataFrame, cfg: Watermark, model) -> DataFrame:
    """One row per recording. model: an ONNX file's path, or a callable on [1, 1, n] samples giving two outputs."""

    def apply(x):
        if not isinstance(model, str):
            return model(x)
        s = session(model)
        return s.run(None, {s.get_inputs()[0].name: x})

    def run(batches):
        for b in batches:
            out = []
            for rid, rate, x in _rows(b):
                wrong = _wrong(x, rate, cfg, 1)
                got = (None, None, None, None)
                if not wrong:
                    y = apply(x[None, None])
                    if len(y) < 2:
                        wrong = (errors.BAD_INFERENCE, f"{len(y)} outputs")
                    else:
                        d, c, m, s = watermark_result(y[0], y[1], cfg)
                        got = (d, c, m, s.tolist())
                out.append((rid, *got, {"code": wrong[0], "detail": wrong[1]} if wrong else None))
            kinds = [pa.string(), pa.bool_(), pa.float32(), pa.int64(), pa.list_(pa.float32()), _ERROR]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["recording_id", "detected", "confidence", "message", "localization", "error"])

    some = recordings.select(F.col("recording_id").cast("string"), F.col("sample_rate").cast("int"), F.col("samples").cast("array<float>"))
    return some.mapInArrow(run, WATERMARKS)

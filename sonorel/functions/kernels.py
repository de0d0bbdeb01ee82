"""Numeric kernels of the Arrow front-ends: windows, STFT, resampling, mel filters, sliding maxima."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from sonorel.configs import Mel, Stft

DB_FLOOR = 1e-12
LOG_MEL_FLOOR = 1e-10


def window(kind: str, n: int) -> np.ndarray:
    """Periodic window of n points."""
    if n <= 1:
        return np.ones(n)
    x = 2 * np.pi * np.arange(n) / n
    if kind == "hann":
        return 0.5 - 0.5 * np.cos(x)
    if kind == "hamming":
        return 0.54 - 0.46 * np.cos(x)
    return 0.42 - 0.5 * np.cos(x) + 0.08 * np.cos(2 * x)


def frames(x: np.ndarray, cfg: Stft) -> np.ndarray:
    """Overlapping frames; centred ones reach over the edges by reflection."""
    n = cfg.n_frames(len(x))
    if n == 0:
        return np.empty((0, cfg.n_fft), x.dtype)
    if cfg.center:
        pad = cfg.n_fft // 2
        at = np.arange(-pad, len(x) + pad)
        period = 2 * (len(x) - 1)
        at = np.abs((at + (period // 2 if period else 0)) % period - period // 2) if period else np.zeros_like(at)
        x = x[at]
        need = (n - 1) * cfg.hop + cfg.n_fft
        x = np.pad(x, (0, max(0, need - len(x))))
    return np.lib.stride_tricks.sliding_window_view(x, cfg.n_fft)[:: cfg.hop][:n]


def power(x: np.ndarray, cfg: Stft, block: int = 2048) -> np.ndarray:
    """Power spectrogram, frames x bins, in the type of ``x``; unnormalised."""
    f, w = frames(x, cfg), window(cfg.window, cfg.n_fft).astype(x.dtype)
    out = np.empty((len(f), cfg.n_bins), x.dtype)
    for lo in range(0, len(f), block):  # bounded scratch
        z = np.fft.rfft(f[lo : lo + block] * w, axis=1)
        out[lo : lo + block] = z.real**2 + z.imag**2
    return out


def frame_power(frame: np.ndarray, cfg: Stft) -> np.ndarray:
    """Power of a single frame, which isn't centred and must have the length of the transform."""
    if len(frame) != cfg.n_fft:
        raise ValueError(f"a frame of {len(frame)} samples for a transform of {cfg.n_fft}")
    z = np.fft.rfft(frame * window(cfg.window, cfg.n_fft).astype(frame.dtype))
    return z.real**2 + z.imag**2


def decibels(p: np.ndarray, floor: float = DB_FLOOR) -> np.ndarray:
    return (10 * np.log10(np.maximum(p, p.dtype.type(floor)))).astype(p.dtype)


def resample_linear(x: np.ndarray, from_rate: int, to_rate: int) -> np.ndarray:
    if from_rate <= 0 or to_rate <= 0:
        raise ValueError("sample rates must be positive")
    if from_rate == to_rate or not len(x):
        return x.copy()
    pos = np.arange(-(-len(x) * to_rate // from_rate)) * (from_rate / to_rate)
    i = np.floor(pos).astype(np.int64)
    frac = (pos - i).astype(x.dtype)
    last = len(x) - 1
    return x[np.minimum(i, last)] * (1 - frac) + x[np.minimum(i + 1, last)] * frac


@lru_cache(maxsize=16)
def sinc_kernels(from_rate: int, to_rate: int, half_taps: int, beta: float, steps: int) -> np.ndarray:
    """Kaiser-windowed sinc of each fractional step, scaled so that step 0 passes a constant unchanged."""
    cutoff = min(from_rate, to_rate) / from_rate
    at = np.arange(-half_taps, half_taps + 1)[None] - (np.arange(steps) / steps)[:, None]
    inside = np.clip(1 - (at / half_taps) ** 2, 0, None)
    k = cutoff * np.sinc(cutoff * at) * np.where(np.abs(at) <= half_taps, np.i0(beta * np.sqrt(inside)) / np.i0(beta), 0.0)
    return k / k[0].sum()


def resample_sinc(x: np.ndarray, from_rate: int, to_rate: int, half_taps: int = 32, beta: float = 8.6, steps: int = 256, block: int = 1 << 16) -> np.ndarray:
    if from_rate <= 0 or to_rate <= 0 or half_taps < 1 or steps < 1:
        raise ValueError("rates, taps and steps must be positive")
    if from_rate == to_rate or not len(x):
        return x.copy()
    table = sinc_kernels(from_rate, to_rate, half_taps, beta, steps)
    padded = np.pad(x.astype(np.float64), half_taps)
    taps = np.arange(2 * half_taps + 1)
    n = -(-len(x) * to_rate // from_rate)
    out = np.empty(n, x.dtype)
    for lo in range(0, n, block):
        pos = np.arange(lo, min(n, lo + block)) * (from_rate / to_rate)
        i = np.floor(pos).astype(np.int64)
        step = np.minimum(((pos - i) * steps).astype(np.int64), steps - 1)
        out[lo : lo + len(pos)] = np.einsum("ij,ij->i", padded[np.minimum(i[:, None] + taps, len(padded) - 1)], table[step])
    return out


def _each(f: Callable[[float], float], x: np.ndarray) -> np.ndarray:
    """``f`` of every number. Numpy's own vector functions differ between processors in the last bit, which tells whether an edge
    lies on a bin; the C library's don't."""
    return np.array([f(v) for v in x.ravel().tolist()], np.float64).reshape(x.shape)


def hz_to_mel(hz, scale: str):
    hz = np.asarray(hz, np.float64)
    if scale == "htk":
        return 2595 * _each(math.log10, 1 + hz / 700)
    # fixed values of the Slaney scale: linear below 1 kHz, then logarithmic
    return np.where(hz < 1000, hz * 3 / 200, 15 + _each(math.log, np.maximum(hz, 1e-9) / 1000) / 0.06875197)


def mel_to_hz(mel, scale: str):
    mel = np.asarray(mel, np.float64)
    if scale == "htk":
        return 700 * (_each(lambda v: math.pow(10, v), mel / 2595) - 1)
    return np.where(mel < 15, mel * 200 / 3, 1000 * _each(math.exp, 0.06875197 * (mel - 15)))


def mel_weights(cfg: Mel) -> np.ndarray:
    """Triangular filters of unit area, mels x bins."""
    lo, hi = hz_to_mel(cfg.fmin, cfg.scale), hz_to_mel(cfg.fmax, cfg.scale)
    edge = mel_to_hz(lo + (hi - lo) * np.arange(cfg.n_mels + 2) / (cfg.n_mels + 1), cfg.scale)
    left, mid, right = edge[:-2, None], edge[1:-1, None], edge[2:, None]
    f = np.arange(cfg.n_fft // 2 + 1)[None] * (cfg.sample_rate / cfg.n_fft)
    up, down = (f - left) / np.maximum(mid - left, 1e-10), (right - f) / np.maximum(right - mid, 1e-10)
    return np.where((f > left) & (f < right), np.where(f <= mid, up, down), 0.0) * 2 / np.maximum(right - left, 1e-10)


def log_mel(p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.log10(p @ weights.T.astype(p.dtype) + p.dtype.type(LOG_MEL_FLOOR))


def sliding_max(x: np.ndarray, half: int, axis: int) -> np.ndarray:
    """Maximum over [i - half, i + half], cut at the edges, by doubling: log2(window) passes."""
    if half <= 0 or not x.size:
        return x.copy()
    pad = [(0, 0)] * x.ndim
    pad[axis] = (half, half)
    y = np.pad(x, pad, constant_values=-np.inf)
    n, have, width = x.shape[axis], 1, 2 * half + 1
    cut = lambda a, lo, hi: a[tuple(slice(lo, hi) if k == axis else slice(None) for k in range(a.ndim))]
    while have * 2 <= width:
        size = y.shape[axis]
        y = np.maximum(cut(y, 0, size - have), cut(y, have, size))
        have *= 2
    return np.maximum(cut(y, 0, n), cut(y, width - have, width - have + n))


def peaks(db: np.ndarray, half_t: int, half_f: int, floor: float, per_second: int, fps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, f, magnitude) of cells that are above the floor and the maximum of their neighbourhood, at most
    ``per_second`` in each second (0: all), ordered by time and bin."""
    high = sliding_max(sliding_max(db, half_f, 1), half_t, 0)
    t, f = np.nonzero((db > floor) & (db >= high))
    return strongest(t, f, db[t, f], per_second, fps)


def strongest(t: np.ndarray, f: np.ndarray, mag: np.ndarray, per_second: int, fps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strongest ``per_second`` peaks (0: all) of each second, ties to the earlier and lower; their order is kept."""
    if per_second and len(t):
        second = np.floor(t / fps).astype(np.int64)
        order = np.lexsort((f, t, -mag, second))
        s = second[order]
        rank = np.arange(len(s)) - np.searchsorted(s, s)
        keep = np.sort(order[rank < per_second])
        t, f, mag = t[keep], f[keep], mag[keep]
    return t, f, mag


def band_of_bin(fmin: float, fmax: float, rate: int, n_fft: int, bands: int) -> np.ndarray:
    """Band of each bin, -1 outside: bands between bands + 1 edges spaced evenly in log frequency."""
    edges = fmin * (fmax / fmin) ** (np.arange(bands + 1) / bands)
    f = np.arange(n_fft // 2 + 1) * (rate / n_fft)
    band = np.searchsorted(edges, f, "right") - 1
    return np.where((f < edges[0]) | (f >= edges[-1]), -1, band)


def band_energies(p: np.ndarray, band: np.ndarray, bands: int) -> np.ndarray:
    member = (band[:, None] == np.arange(bands)[None]).astype(p.dtype)
    return p @ member


def frame_codes(energies: np.ndarray) -> np.ndarray:
    """Sign bits of the change, from one frame to the next, of the differences of neighbouring bands; the
    lowest band is the highest bit."""
    d = np.diff(-energies, axis=1)
    bits = (d[1:] - d[:-1]) > 0
    n = bits.shape[1]
    return (bits.astype(np.int64) << np.arange(n - 1, -1, -1)).sum(axis=1)


def _targets(t, f, mag, zone_t: int, zone_f: int, most: int):
    """(anchor, target) indices of peaks ordered by (t, f): for each anchor its strongest ``most`` targets with 1 <= dt <= zone_t
    and |df| <= zone_f, ties to the earlier and lower; ordered by anchor and strength.

    Works on slices of anchors whose candidates are some 64 thousand in all."""
    lo, hi = np.searchsorted(t, t + 1), np.searchsorted(t, t + zone_t, "right")
    sizes = hi - lo
    out_a, out_b, at, ends = [], [], 0, np.cumsum(sizes)
    while at < len(t):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 16), "right")))
        n = sizes[at:to]
        a = np.repeat(np.arange(at, to), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + lo[a]
        near = np.abs(f[b] - f[a]) <= zone_f
        a, b = a[near], b[near]
        order = np.lexsort((-mag[b], a))  # stable: peaks are in the order of their ties already
        a, b = a[order], b[order]
        first = np.searchsorted(a, a)
        keep = np.arange(len(a)) - first < most
        out_a.append(a[keep])
        out_b.append(b[keep])
        at = to
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def landmark_pairs(t, f, mag, zone_t: int, zone_f: int, fan_out: int):
    """(anchor, target) indices of peaks ordered by (t, f): for each anchor its strongest targets in the zone
    1 <= dt <= zone_t, |df| <= zone_f, ties to the earlier and lower."""
    return _targets(t, f, mag, zone_t, zone_f, fan_out)


def landmark_triples(t, f, mag, zone_t: int, zone_f: int, fan_out: int, most: int | None = None):
    """(anchor, b, c) indices: pairs of targets, c behind b in (t, f) order, of the largest summed magnitude, ties to the
    earlier and lower. Of an anchor's targets only the strongest ``most`` (None: all) count, ties to the earlier and lower.

    Only targets as strong as the strongest fan_out + 1 can be in the best fan_out sums; each of them is paired with those
    behind it, step by step.
    """
    a, b = _targets(t, f, mag, zone_t - 1, zone_f - 1, len(t) if most is None else most)
    mag = mag.astype(np.float32)  # sums are those of single precision
    if not len(a):
        return np.empty((3, 0), np.int64)
    first = np.searchsorted(a, a)
    last = np.searchsorted(a, a, "right") - 1
    keep = mag[b] >= mag[b[np.minimum(first + fan_out, last)]]  # with the ties of the weakest
    a, b = a[keep], b[keep]
    order = np.lexsort((b, a))  # by time and bin
    a, b = a[order], b[order]
    out, step = [], 1
    while len(a) > step and (same := a[step:] == a[:-step]).any():
        i = np.flatnonzero(same)
        out.append(np.stack([a[i], b[i], b[i + step]]))
        step += 1
    if not out:
        return np.empty((3, 0), np.int64)
    a, b, c = np.concatenate(out, axis=1)
    order = np.lexsort((c, b, -(mag[b] + mag[c]), a))
    a, b, c = a[order], b[order], c[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < fan_out
    return np.stack([a[keep], b[keep], c[keep]])


def wang_hash(fa, fb, dt):
    q = lambda x: np.maximum(np.asarray(x, np.int64) - 1, 0)
    return ((q(fa) & 511) << 23) | ((q(fb) & 511) << 14) | np.clip(dt, 1, 16383)


def panako_hash(f, mag, t):
    """Hash of triples; each argument holds arrays for a, b, c."""
    (fa, fb, fc), (ma, mb, mc), (ta, tb, tc) = f, mag, t
    sign = (fb >= fa).astype(np.int64) | ((fc >= fb).astype(np.int64) << 1)
    order = np.where((ma >= mb) & (ma >= mc), 0, np.where(mb >= mc, 1, 2))
    beta = np.clip(np.floor((tc - tb) / np.maximum(tc - ta, 1) * 31 + 0.5), 0, 31).astype(np.int64)
    d = lambda x: np.clip(x, -127, 127) & 0xFF
    return (sign << 30) | (order << 28) | (beta << 23) | (d(fb - fa) << 15) | (d(fc - fb) << 7)

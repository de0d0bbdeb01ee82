"""Options of all operators, with their bounds.

Search windows and counts outside their bounds are moved to the nearest bound; what can't be mended raises
``ConfigError`` at construction.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from sonorel.errors import ConfigError


def _clamp(x, lo, hi):
    return min(max(x, lo), hi)


@dataclass(frozen=True)
class Stft:
    n_fft: int = 1024
    hop: int | None = None  # a quarter of n_fft
    window: str = "hann"
    center: bool = True

    def __post_init__(self):
        if self.n_fft <= 0 or self.n_fft & (self.n_fft - 1):
            raise ConfigError("n_fft must be a power of two")
        if self.hop is None:
            object.__setattr__(self, "hop", max(1, self.n_fft // 4))
        if not 0 < self.hop <= self.n_fft:
            raise ConfigError("hop must lie in (0, n_fft]")
        if self.window not in ("hann", "hamming", "blackman"):
            raise ConfigError(f"unknown window {self.window}")

    @property
    def n_bins(self) -> int:
        return self.n_fft // 2 + 1

    def n_frames(self, n: int) -> int:
        if n == 0:
            return 0
        if self.center:
            return 1 + n // self.hop
        return 0 if n < self.n_fft else 1 + (n - self.n_fft) // self.hop


@dataclass(frozen=True)
class PeakPicking:
    neighborhood_t: int = 7
    neighborhood_f: int = 7
    min_magnitude_db: float = 1e-3
    min_magnitude_linear: float | None = None
    target_per_sec: int = 30


@dataclass(frozen=True)
class Landmarks:
    """Options that both landmark extractors share."""

    fan_out: int = 10
    target_zone_t: int = 63
    target_zone_f: int = 64
    peaks_per_sec: int = 30
    min_anchor_mag_db: float = -50.0
    max_input_samples: int | None = 14_400_000
    max_hashes: int | None = 500_000
    max_pending_anchors: int | None = None
    max_push_samples: int | None = None

    sample_rate = 8000
    stft = Stft(1024, 128, "hann", center=False)
    neighborhood = 15
    frames_per_sec = 62.5
    min_samples = 16_000

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("fan_out", _clamp(self.fan_out, 1, 64))
        put("target_zone_t", _clamp(self.target_zone_t, 1, 512))
        put("target_zone_f", _clamp(self.target_zone_f, 1, 512))
        put("peaks_per_sec", min(self.peaks_per_sec, 500))
        put("min_anchor_mag_db", _clamp(self.min_anchor_mag_db if math.isfinite(self.min_anchor_mag_db) else -50.0, -200.0, 0.0))
        for k in ("max_input_samples", "max_hashes", "max_pending_anchors", "max_push_samples"):
            if getattr(self, k) == 0:
                put(k, 1)


class Wang(Landmarks):
    algorithm = "wang-v1"


@dataclass(frozen=True)
class Panako(Landmarks):
    fan_out: int = 5
    target_zone_t: int = 96
    target_zone_f: int = 96

    algorithm = "panako-v2"


@dataclass(frozen=True)
class Haitsma:
    fmin: float = 300.0
    fmax: float = 2000.0
    max_input_samples: int | None = 9_000_000
    max_push_samples: int | None = None

    algorithm = "haitsma-v1"
    sample_rate = 5000
    stft = Stft(2048, 64, "hann", center=False)
    frames_per_sec = 78.125
    min_samples = 10_000
    bands = 33

    def __post_init__(self):
        if not (self.fmin > 0 and self.fmax > self.fmin and self.fmax < self.sample_rate / 2):
            raise ConfigError("need 0 < fmin < fmax < half the sample rate")


@dataclass(frozen=True)
class WangMatch:
    offset_tolerance_frames: int = 1
    min_votes: int = 5
    min_score: float = 0.15
    min_prominence: float = 5.0
    max_postings_per_hash: int = 100


@dataclass(frozen=True)
class PanakoMatch:
    scale_min: float = 0.80
    scale_max: float = 1.25
    scale_bins: int = 24
    offset_tolerance_frames: int = 1
    min_votes: int = 5
    min_score: float = 0.15
    min_prominence: float = 5.0
    max_postings_per_hash: int = 100
    ransac_refine: bool = True
    refine_lines: int = 512  # pairs of votes up to which all of them are candidate lines

    def normalized(self) -> PanakoMatch:
        """A grid that can't be used is replaced by the default one."""
        cfg = self if self.scale_bins > 0 else replace(self, scale_bins=24)
        sound = math.isfinite(cfg.scale_min) and math.isfinite(cfg.scale_max) and cfg.scale_max > cfg.scale_min
        return cfg if sound else replace(cfg, scale_min=0.80, scale_max=1.25)


@dataclass(frozen=True)
class HaitsmaMatch:
    max_ber: float = 0.35
    min_overlap_frames: int = 256
    use_lut: bool = True
    probe_bit_flips: int = 0
    lut_frames: int = 512  # references up to so many frames are rated at every lag
    alignments: int = 8  # of a pair, that an index query verifies


@dataclass(frozen=True)
class NeuralMatch:
    min_cosine: float = 0.80
    aggregation: str = "sliding_max"  # or "global", "dtw"
    assume_normalized: bool = True


@dataclass(frozen=True)
class Mel:
    n_mels: int = 128
    n_fft: int = 1024
    sample_rate: int = 16_000
    fmin: float = 0.0
    fmax: float | None = None
    scale: str = "slaney"

    def __post_init__(self):
        if self.fmax is None:
            object.__setattr__(self, "fmax", self.sample_rate / 2)
        if self.n_mels <= 0 or self.n_fft < 2 or self.n_fft % 2 or self.sample_rate <= 0:
            raise ConfigError("n_mels, n_fft and sample_rate must be positive, n_fft even")
        if self.fmin < 0 or self.fmin >= self.fmax:
            raise ConfigError("need 0 <= fmin < fmax")
        if self.scale not in ("slaney", "htk"):
            raise ConfigError(f"unknown mel scale {self.scale}")


@dataclass(frozen=True)
class Embedder:
    sample_rate: int = 16_000
    n_fft: int = 1024
    hop: int = 320
    n_mels: int = 128
    fmin: float = 0.0
    fmax: float | None = None
    scale: str = "slaney"
    window: str = "hann"
    window_secs: float = 1.0
    hop_secs: float = 1.0
    l2_normalize: bool = True
    max_input_samples: int | None = None
    batch_size: int = 1

    algorithm = "neural-onnx-v0"

    def __post_init__(self):
        if self.n_fft > 1 << 20 or self.n_mels > 8192 or self.window_secs > 3600:
            raise ConfigError("n_fft, n_mels or window_secs is too large")
        Stft(self.n_fft, self.hop, self.window)
        self.mel  # noqa: B018
        w, h = self.window_samples, self.hop_samples
        if not 0 < h <= w or w < self.n_fft or self.batch_size < 1:
            raise ConfigError("need n_fft <= window, 0 < hop <= window and batch_size >= 1")
        if self.n_mels * (1 + w // self.hop) > 1 << 28:
            raise ConfigError("one window has too many mel cells")

    @property
    def mel(self) -> Mel:
        return Mel(self.n_mels, self.n_fft, self.sample_rate, self.fmin, self.fmax, self.scale)

    @property
    def window_samples(self) -> int:
        return round(self.window_secs * self.sample_rate)

    @property
    def hop_samples(self) -> int:
        return round(self.hop_secs * self.sample_rate)


@dataclass(frozen=True)
class Watermark:
    message_bits: int = 16
    threshold: float = 0.5
    sample_rate: int = 16_000
    max_input_samples: int | None = None

    def __post_init__(self):
        if not 0 <= self.message_bits <= 32 or not 0 <= self.threshold <= 1:
            raise ConfigError("need 0 <= message_bits <= 32 and 0 <= threshold <= 1")


@dataclass(frozen=True)
class DecodeLimits:
    max_bytes: int = 0  # 0: no limit
    max_samples: int | None = None
    integrity_mode: bool = False
    timeout: float | None = None

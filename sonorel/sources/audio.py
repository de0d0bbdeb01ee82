"""Audio files as recordings. Decoders are looked up by a file's content; WAV and AIFF are built in."""

from __future__ import annotations

import struct
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorel import errors
from sonorel.configs import DecodeLimits
from sonorel.functions import kernels as K
from sonorel.schemas import ERROR
from sonorel.sources import formats as f
from sonorel.sources.formats import DecodeError

#: name -> (does it know these first bytes, decoder to (interleaved float32, channels, rate))
DECODERS: dict[str, tuple[Callable[[bytes], bool], Callable]] = {}


def decoder(name: str, knows: Callable[[bytes], bool]):
    def add(f):
        DECODERS[name] = (knows, f)
        return f

    return add


@decoder("wav", lambda head: head[:4] == b"RIFF" and head[8:12] == b"WAVE")
def decode_wav(data: bytes, limits: DecodeLimits = DecodeLimits(), clock=time.monotonic):
    """PCM of 8, 16, 24 or 32 bits, 32 or 64-bit floats, mu-law, A-law and IMA ADPCM. A data chunk that is cut off gives what
    there is, or, in integrity mode, an error; so does a packet that can't be decoded."""
    clock, fmt = f.Clock(limits, clock), None
    for name, at, size in f.chunks(data, "little", clock):
        if name == b"fmt ":
            fmt = data[at : at + min(size, 40)]
        elif name == b"data":
            break
    else:
        raise DecodeError(errors.BAD_IO, "no data chunk")
    if fmt is None or len(fmt) < 16:
        raise DecodeError(errors.BAD_IO, "no format chunk")
    kind, channels, rate, _, align, bits = struct.unpack("<HHIIHH", fmt[:16])
    if kind == 0xFFFE and len(fmt) >= 26:
        kind = struct.unpack("<H", fmt[24:26])[0]
    if channels == 0:
        raise DecodeError(errors.BAD_CHANNELS, "0 channels")
    raw = f.content(data, at, size, limits)
    if (kind, bits) == (0x11, 4):
        return f.ima_adpcm(raw, align, channels, limits, clock), channels, rate
    if (kind, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64), (6, 8), (7, 8)}:
        raise DecodeError(errors.BAD_IO, f"format {kind} with {bits} bits")
    return _samples(raw, {1: "int", 3: "float", 6: "alaw", 7: "ulaw"}[kind], bits, channels, "little", limits), channels, rate


def _samples(raw: bytes, kind: str, bits: int, channels: int, order: str, limits: DecodeLimits) -> np.ndarray:
    frame = -(-bits // 8) * channels
    raw = raw[: f.within(len(raw) // frame, limits) * frame]
    if kind == "int":
        return f.pcm(raw, bits, order, unsigned=bits == 8 and order == "little")
    return f.floats(raw, bits, order) if kind == "float" else f.a_law(raw) if kind == "alaw" else f.mu_law(raw)


#: Compression of an AIFF-C file -> (kind, byte order, bits that it fixes).
_AIFC = {b"NONE": ("int", "big", 0), b"twos": ("int", "big", 0), b"sowt": ("int", "little", 0), b"in24": ("int", "big", 24), b"in32": ("int", "big", 32), b"fl32": ("float", "big", 32), b"fl64": ("float", "big", 64), b"ulaw": ("ulaw", "big", 8), b"alaw": ("alaw", "big", 8)}


@decoder("aiff", lambda head: head[:4] == b"FORM" and head[8:12] in (b"AIFF", b"AIFC"))
def decode_aiff(data: bytes, limits: DecodeLimits = DecodeLimits(), clock=time.monotonic):
    """AIFF, and AIFF-C with PCM of either byte order, floats, mu-law or A-law; chunks in any order. A sound chunk that is cut
    off, or has fewer frames than stated, gives what there is, or, in integrity mode, an error."""
    common = sound = None
    for name, at, size in f.chunks(data, "big", f.Clock(limits, clock)):
        if name == b"COMM":
            common = data[at : at + min(size, 22)]
        elif name == b"SSND":
            sound = at, size
    if common is None or len(common) < 18 or sound is None or sound[1] < 8:
        raise DecodeError(errors.BAD_IO, "no common chunk" if common is None or len(common) < 18 else "no sound chunk")
    channels, frames, bits, exponent, mantissa = struct.unpack(">HIHHQ", common[:18])
    packed = common[18:22] if data[8:12] == b"AIFC" else b"NONE"
    rate = round(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)) if exponent < 16383 + 31 else 0
    if channels == 0:
        raise DecodeError(errors.BAD_CHANNELS, "0 channels")
    kind, order, fixed = _AIFC.get(packed.upper() if packed.upper() == b"NONE" else packed.lower(), ("", "", 0))
    bits = fixed or bits
    if not kind or not 1 <= bits <= 64 or (kind == "int" and bits > 32):
        raise DecodeError(errors.BAD_IO, f"format {packed!r} with {bits} bits")
    raw = f.content(data, sound[0], sound[1], limits)
    raw = raw[8 + int.from_bytes(raw[:4], "big") :]
    size = frames * channels * -(-bits // 8)
    return _samples(f.content(raw, 0, size, limits), kind, bits if kind != "int" else -(-bits // 8) * 8, channels, order if bits > 8 else "big", limits), channels, rate


def decode_to_mono(data: bytes, limits: DecodeLimits = DecodeLimits(), rate: int | None = None) -> tuple[np.ndarray, int]:
    """Mean of the channels, at the file's own rate or at ``rate``."""
    if rate is not None and rate <= 0:
        raise DecodeError(errors.BAD_RATE, f"{rate} Hz")
    if limits.max_bytes and len(data) > limits.max_bytes:
        raise DecodeError(errors.TOO_LARGE, f"{len(data)} bytes")
    found = next((d for knows, d in DECODERS.values() if knows(data[:64])), None)
    if found is None:
        raise DecodeError(errors.BAD_IO, "no decoder knows this format")
    x, channels, own = found(data, limits)
    if own <= 0:
        raise DecodeError(errors.BAD_RATE, f"{own} Hz")
    mono = x.reshape(-1, channels).mean(axis=1, dtype=np.float32)
    if rate is None or rate == own:
        return mono, own
    projected = -(-len(mono) * rate // own)
    if limits.max_samples is not None and projected > limits.max_samples:
        raise DecodeError(errors.TOO_LARGE, f"{projected} samples after resampling")
    return K.resample_sinc(mono, own, rate), rate


def decode(files: DataFrame, rate: int | None = None, limits: DecodeLimits = DecodeLimits()) -> DataFrame:
    """recording_id, sample_rate, samples, error of a table (path, content) of whole files."""
    schema = f"recording_id string, sample_rate int, samples array<float>, error {ERROR}"
    kind = pa.struct([("code", pa.string()), ("detail", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for p, c in zip(b.column("path"), b.column("content"), strict=True):
                try:
                    x, r = decode_to_mono(c.as_py() or b"", limits, rate)
                    out.append((p.as_py(), r, x, None))
                except DecodeError as e:
                    out.append((p.as_py(), None, None, {"code": e.code, "detail": str(e)}))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.float32())), pa.array(cols[3], kind)], names=["recording_id", "sample_rate", "samples", "error"])

    return files.select("path", "content").mapInArrow(run, schema)


def read_audio(spark: SparkSession, path: str, rate: int | None = None, limits: DecodeLimits = DecodeLimits(), pattern: str | None = None) -> DataFrame:
    """recording_id (the path), sample_rate, samples, error. Files over ``max_bytes`` are told by their length before
    their content is read."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    fits = files.filter(F.col("length") <= limits.max_bytes) if limits.max_bytes else files
    good = decode(fits, rate, limits)
    if not limits.max_bytes:
        return good
    over = files.filter(F.col("length") > limits.max_bytes)
    error = F.struct(F.lit(errors.TOO_LARGE).alias("code"), F.concat(F.col("length").cast("string"), F.lit(" bytes")).alias("detail"))
    return good.union(over.select(F.col("path"), F.lit(None).cast("int"), F.lit(None).cast("array<float>"), error))

"""Binary fingerprint blobs: an 18-byte header and fixed-size little-endian records.

header: magic (8 bytes), version (u8), algorithm (u8), count (u32), frames per second (f32)
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonorel import __version__, errors

# fixed values of this engine's own format
MAGIC = b"SONOREL\0"
VERSION = 1
HEADER = 18
ALGORITHMS = {"wang-v1": 0, "panako-v2": 1, "haitsma-v1": 2}
RATES = {0: 8000, 1: 8000, 2: 5000}
#: Bytes of blobs that a task sends on together.
BATCH_BYTES = 1 << 20

FIELDS = {"wang-v1": ["hash", "t_anchor"], "panako-v2": ["hash", "t_anchor", "t_b", "t_c"], "haitsma-v1": ["frame"]}
_NAMES = {v: k for k, v in ALGORITHMS.items()}


def envelope(n: int, algorithm: str, fps: float) -> bytes:
    """Header of a blob of ``n`` records."""
    return MAGIC + struct.pack("<BBIf", VERSION, ALGORITHMS[algorithm], n, fps)


def pack(records: np.ndarray, algorithm: str, fps: float) -> bytes:
    """records: rows x fields of unsigned 32-bit values."""
    return envelope(len(records), algorithm, fps) + np.ascontiguousarray(records, "<u4").tobytes()


def header(blob: bytes, expected: str | None = None) -> tuple[str, int, float]:
    """(algorithm, count, fps); ValueError on the first thing that is wrong."""
    if len(blob) < HEADER:
        raise ValueError(f"{len(blob)} bytes are no header")
    if blob[:8] != MAGIC:
        raise ValueError("wrong magic")
    version, alg, count, fps = struct.unpack("<BBIf", blob[8:HEADER])
    if version != VERSION:
        raise ValueError(f"version {version}")
    if expected is not None and alg != ALGORITHMS[expected]:
        raise ValueError(f"algorithm {alg} instead of {ALGORITHMS[expected]}")
    if not (np.isfinite(fps) and fps > 0):
        raise ValueError(f"{fps} frames per second")
    if alg not in _NAMES:
        raise ValueError(f"unknown algorithm {alg}")
    return _NAMES[alg], count, fps


def unpack(blob: bytes, algorithm: str) -> tuple[np.ndarray, float]:
    """(records, fps); bytes behind the records are ignored."""
    _, count, fps = header(blob, algorithm)
    width = len(FIELDS[algorithm])
    if len(blob) - HEADER < 4 * width * count:
        raise ValueError(f"{len(blob) - HEADER} bytes hold no {count} records")
    return np.frombuffer(blob, "<u4", width * count, HEADER).reshape(count, width), fps


def write_blobs(hashes: DataFrame, algorithm: str, fps: float) -> DataFrame:
    """recording_id, blob from a hash table, one recording a blob, in canonical order.

    Spark deals and sorts the rows; a task packs the recordings of a batch together, and holds one that goes on in the next."""
    cols = FIELDS[algorithm]
    order = {"wang-v1": ["t_anchor", "hash"], "panako-v2": ["t_anchor", "t_b", "t_c", "hash"], "haitsma-v1": ["pos"]}[algorithm]

    def made(done: list[tuple[str | None, bytes]]) -> pa.RecordBatch:
        ids, packed = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(packed, pa.binary())], names=["recording_id", "blob"])

    def run(batches):
        done, size, last, parts, n = [], 0, None, [], 0
        for b in batches:
            records = np.column_stack([pc.fill_null(b.column(c), 0).to_numpy(zero_copy_only=False) for c in cols]).astype("<u4")
            runs, at = pc.run_end_encode(b.column("recording_id")), 0
            for rid, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if n and rid != last:
                    done.append((last, envelope(n, algorithm, fps) + b"".join(parts)))
                    size, parts, n = size + len(done[-1][1]), [], 0
                    if size >= BATCH_BYTES:
                        yield made(done)
                        done, size = [], 0
                last, n = rid, n + end - at
                parts.append(records[at:end].tobytes())
                at = end
        if n:
            yield made([*done, (last, envelope(n, algorithm, fps) + b"".join(parts))])

    rows = hashes.select(F.col("recording_id").cast("string"), *[F.col(c).cast("long") if c in cols else c for c in dict.fromkeys([*cols, *order])])
    dealt = rows.repartition("recording_id").sortWithinPartitions("recording_id", *[F.asc_nulls_last(c) for c in order])
    return dealt.select("recording_id", *cols).mapInArrow(run, "recording_id string, blob binary")


def read_blobs(blobs: DataFrame, algorithm: str) -> DataFrame:
    """Hash rows of a table (recording_id, blob); what can't be read gives one row with an error."""
    cols = ["pos", "frame"] if algorithm == "haitsma-v1" else FIELDS[algorithm]
    schema = "recording_id string, " + "".join(f"{c} bigint, " for c in cols) + "fps float, error string"

    def run(batches):
        for b in batches:
            for rid, blob in zip(b.column(0), b.column(1), strict=True):
                try:
                    rows, fps = unpack(blob.as_py() or b"", algorithm)
                    rows = rows.astype(np.int64)
                    if algorithm == "haitsma-v1":
                        rows = np.column_stack([np.arange(len(rows)), rows])
                    n, wrong = len(rows), None
                except ValueError as e:
                    rows, n, fps, wrong = [[None] * len(cols)], 1, None, f"{errors.BAD_BLOB}: {e}"
                values = list(zip(*rows, strict=True)) if n else [[] for _ in cols]
                arrays = [pa.array([rid.as_py()] * n, pa.string()), *[pa.array(list(v), pa.int64()) for v in values], pa.array([fps] * n, pa.float32()), pa.array([wrong] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["recording_id", *cols, "fps", "error"])

    return blobs.select(F.col("recording_id").cast("string"), "blob").mapInArrow(run, schema)


def _le(blob: Column, at: int, n: int) -> Column:
    """Little-endian unsigned integer of a blob, as an expression."""
    return F.conv(F.concat(*[F.hex(F.substring(blob, at + n - i, 1)) for i in range(n)]), 16, 10).cast("bigint")


def peek(blobs: DataFrame) -> DataFrame:
    """Envelope of each blob as expressions on its first 18 bytes; the payload isn't touched.

    Adds algorithm, version, sample_rate, hash_count, frames_per_sec and error."""
    b = F.substring("blob", 1, HEADER)
    alg, bits = _le(b, 9, 1), _le(b, 14, 4)
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit(0x7FFFFF))
    negative = F.shiftright(bits, 31) == 1
    size = F.when(exponent == 0, fraction * 2.0**-149).otherwise((1 + fraction / float(1 << 23)) * F.pow(F.lit(2.0), exponent - 127))
    name = F.when(alg == 0, "wang-v1").when(alg == 1, "panako-v2").when(alg == 2, "haitsma-v1")
    error = (
        F.when(F.col("blob").isNull() | (F.length("blob") < HEADER), "short")
        .when(F.hex(F.substring(b, 1, 8)) != MAGIC.hex().upper(), "magic")
        .when(_le(b, 8, 1) != VERSION, "version")
        .when((exponent == 255) | negative | ((exponent == 0) & (fraction == 0)), "frame rate")
        .when(name.isNull(), "algorithm")
    )
    ok = error.isNull()
    return blobs.select(
        "*",
        F.when(ok, name).alias("algorithm"),
        F.when(ok, F.lit(__version__)).alias("version"),
        F.when(ok, F.when(alg == 2, 5000).otherwise(8000)).alias("sample_rate"),
        F.when(ok, _le(b, 10, 4)).alias("hash_count"),
        F.when(ok, size).alias("frames_per_sec"),
        error.alias("error"),
    )

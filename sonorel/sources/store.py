"""Fingerprint blobs as a Spark data source: ``spark.read.format("fingerprints")`` and ``df.write.format("fingerprints")``.

A store is a folder. A writing task appends blobs to container files; a commit names its files in a manifest, and only what
a manifest names is read, so files of failed or repeated tasks are never seen. Reading is planned from the manifests alone: a
partition is a range of entries of a file, found through the offsets at the file's end. With ``read``, filters on what a header
says (recording_id, algorithm, hash_count, frames_per_sec) are taken over by the reader: a rejected blob's records are neither
read nor decoded.

    container: entries (u32 id length, u32 blob length, id, blob), u64 offset of each entry, u64 number of entries

Rows to write: recording_id, blob. Rows that are read: one a record, ``hash`` and ``t_anchor`` (of frame codes: code and
position), ``t_b`` and ``t_c`` (else null); with the option ``blobs`` one a blob. A blob without a sound header is written and
gives an error row. Nulls: a null id is kept apart from an empty one, a null blob is an empty one. Any file system that pyarrow can
reach will do; all tasks must see it.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from sonorel import errors
from sonorel.sources import blobs

NAME = "fingerprints"
#: Bytes from which a task begins another container, and entries of a partition.
CONTAINER, ENTRIES = 128 << 20, 10_000
#: Bytes of blobs whose rows a reader sends on together.
TOGETHER = 1 << 18
#: Id length of a null id.
NULL_ID = 0xFFFFFFFF

HEADER_COLUMNS = "recording_id string, algorithm string, hash_count bigint, frames_per_sec double, error string"
_HEADER = [("recording_id", pa.string()), ("algorithm", pa.string()), ("hash_count", pa.int64()), ("frames_per_sec", pa.float64()), ("error", pa.string())]
_RECORD = [(c, pa.int64()) for c in ("hash", "t_anchor", "t_b", "t_c")]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Files(WriterCommitMessage):
    names: list[tuple[str, int]]  # container, entries


class BlobWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Files:
        where, base = _open(self.path)
        where.create_dir(base)
        done, out, offsets, name = [], None, [], ""

        def close():
            out.write(np.array(offsets, "<u8").tobytes() + struct.pack("<Q", len(offsets)))
            out.close()
            done.append((name, len(offsets)))

        for r in rows:
            if out is None:
                name, offsets = f"{uuid.uuid4().hex}.blobs", []
                out = where.open_output_stream(f"{base}/{name}")
            rid, blob = None if r.recording_id is None else str(r.recording_id).encode(), bytes(r.blob or b"")
            offsets.append(out.tell())
            out.write(struct.pack("<II", NULL_ID if rid is None else len(rid), len(blob)) + (rid or b"") + blob)
            if out.tell() >= CONTAINER:
                close()
                out = None
        if out is not None:
            close()
        return Files(done)

    def commit(self, messages: list[Files | None]) -> None:
        where, base = _open(self.path)
        where.create_dir(base)
        before = _manifests(where, base) if self.overwrite else []
        files = [f for m in messages if m is not None for f in m.names]
        hidden, shown = f"{base}/.{uuid.uuid4().hex}", f"{base}/{uuid.uuid4().hex}.manifest"
        with where.open_output_stream(hidden) as out:
            out.write(json.dumps(files).encode())
        where.move(hidden, shown)
        for m in before:
            old = _files(where, m)
            where.delete_file(m)
            for name, _ in old:
                where.delete_file(f"{base}/{name}")

    def abort(self, messages: list[Files | None]) -> None:
        where, base = _open(self.path)
        for name, _ in (f for m in messages if m is not None for f in m.names):
            where.delete_file(f"{base}/{name}")


def _manifests(where: fs.FileSystem, base: str) -> list[str]:
    found = where.get_file_info(fs.FileSelector(base))
    return sorted(f.path for f in found if f.path.endswith(".manifest"))


def _files(where: fs.FileSystem, manifest: str) -> list[tuple[str, int]]:
    with where.open_input_stream(manifest) as f:
        return [tuple(x) for x in json.loads(f.read())]


@dataclass
class Entries(InputPartition):
    name: str
    first: int
    last: int
    total: int


_TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    EqualNullSafe: lambda x, v: x == v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
    In: lambda x, v: x is not None and x in v,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    IsNotNull: lambda x, v: x is not None,
}


class BlobReader(DataSourceReader):
    def __init__(self, path: str, whole: bool):
        self.path, self.whole, self.tests = path, whole, []

    def partitions(self) -> list[Entries]:
        where, base = _open(self.path)
        files = sorted(f for m in _manifests(where, base) for f in _files(where, m))
        return [Entries(name, at, min(n, at + ENTRIES), n) for name, n in files for at in range(0, n, ENTRIES)]

    def read(self, part: Entries) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        where, base = _open(self.path)
        with where.open_input_file(f"{base}/{part.name}") as f:
            offsets = np.frombuffer(f.read_at(8 * (part.last - part.first), f.size() - 8 - 8 * (part.total - part.first)), "<u8").tolist()
            heads, found, size = [], [], 0
            for at in offsets:
                n_id, n = struct.unpack("<II", f.read_at(8, at))
                start = at + 8 + (0 if n_id == NULL_ID else n_id)
                rid = None if n_id == NULL_ID else f.read_at(n_id, at + 8).decode()
                head = {"recording_id": rid, "algorithm": None, "hash_count": None, "frames_per_sec": None, "error": None}
                try:
                    head["algorithm"], head["hash_count"], fps = blobs.header(f.read_at(min(n, blobs.HEADER), start))
                    head["frames_per_sec"] = float(fps)
                except ValueError as e:
                    head["error"] = f"{errors.BAD_BLOB}: {e}"
                if all(_TESTS[kind](head[c], v) for c, kind, v in self.tests):
                    heads.append(head)
                    found.append(f.read_at(n, start) if self.whole else self._records(head, lambda: f.read_at(n, start)))
                    size += n
                    if size >= TOGETHER or len(heads) >= ENTRIES:
                        yield self._rows(heads, found)
                        heads, found, size = [], [], 0
            if heads:
                yield self._rows(heads, found)

    @staticmethod
    def _records(head: dict, blob) -> np.ndarray | None:
        """Records of a blob, or none and an error in its head."""
        if head["error"] is None:
            try:
                records = blobs.unpack(blob(), head["algorithm"])[0].astype(np.int64)
                return np.column_stack([records[:, 0], np.arange(len(records))]) if head["algorithm"] == "haitsma-v1" else records
            except ValueError as e:
                head["error"] = f"{errors.BAD_BLOB}: {e}"
        return None

    def _rows(self, heads: list[dict], found: list) -> pa.RecordBatch:
        if self.whole:
            kinds, n, extra = [("blob", pa.binary())], np.ones(len(heads), np.int64), [pa.array(found, pa.binary())]
        else:
            kinds, n = _RECORD, np.array([1 if r is None else len(r) for r in found])
            width = np.repeat([0 if r is None else r.shape[1] for r in found], n)
            values = np.zeros((len(width), len(_RECORD)), np.int64)
            for r, end, k in zip(found, np.cumsum(n).tolist(), n.tolist(), strict=True):
                if r is not None:
                    values[end - k : end, : r.shape[1]] = r
            extra = [pa.array(values[:, i], pa.int64(), mask=width <= i) for i in range(len(_RECORD))]
        blob = pa.array(np.repeat(np.arange(len(heads)), n))
        arrays = [pa.array([h[c] for h in heads], k).take(blob) for c, k in _HEADER] + extra
        return pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in _HEADER + kinds])


class FilteringReader(BlobReader):
    """A reader that takes over tests of header columns."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {name for name, _ in _HEADER}
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in known:
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f


class Fingerprints(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _whole(self) -> bool:
        return str(self.options.get("blobs", "false")).lower() == "true"

    def schema(self) -> str:
        return HEADER_COLUMNS + (", blob binary" if self._whole() else ", hash bigint, t_anchor bigint, t_b bigint, t_c bigint")

    def reader(self, schema) -> BlobReader:
        filtering = str(self.options.get("filters", "false")).lower() == "true"
        return (FilteringReader if filtering else BlobReader)(self.options["path"], self._whole())

    def writer(self, schema, overwrite: bool) -> BlobWriter:
        return BlobWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(Fingerprints)


def read(spark: SparkSession, path: str, condition: str | Column, whole: bool = False) -> DataFrame:
    """Rows of a store that meet ``condition``, whose tests of header columns the reader takes over.

    Spark remembers what a table's reader has taken over even when the same table is queried again without that filter, so readers
    take over nothing unless the option ``filters`` is set: here, for a table that is never seen without the condition."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("blobs", whole).option("filters", True).load(path).filter(condition)

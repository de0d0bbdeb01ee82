"""The blob data source and the table function."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

from sonorel.configs import Wang
from sonorel.functions import tables
from sonorel.operators import spectral
from sonorel.sources import blobs, store


def hashes(spark, n=6, rows=30):
    return spark.createDataFrame([(f"r{i}", 1000 * i + k, k) for i in range(n) for k in range(rows + i)], "recording_id string, hash long, t_anchor long")


@pytest.fixture
def saved(spark, tmp_path):
    store.register(spark)
    path = str(tmp_path / "store")
    table = blobs.write_blobs(hashes(spark), "wang-v1", 62.5)
    odd = spark.createDataFrame([(None, bytearray(blobs.pack([[7, 8]], "wang-v1", 1.0))), ("", bytearray(b"junk")), ("null", None)], "recording_id string, blob binary")
    table.repartition(3).write.format(store.NAME).mode("append").save(path)
    odd.coalesce(1).write.format(store.NAME).mode("append").save("file://" + path)
    return path


def test_round_trip(spark, saved):
    got = spark.read.format(store.NAME).load(saved)
    good = got.filter("error IS NULL AND recording_id IS NOT NULL").select("recording_id", "hash", "t_anchor")
    assert good.exceptAll(hashes(spark)).count() == 0 and good.count() == hashes(spark).count()
    assert got.filter("hash_count > 33").groupBy("recording_id").count().count() == 2  # the same table with and without filters
    odd = {(r.recording_id, r.algorithm, r.hash_count, r.hash, r.t_anchor, r.error) for r in got.filter("recording_id IS NULL OR error IS NOT NULL").collect()}
    assert odd == {(None, "wang-v1", 1, 7, 8, None), ("", None, None, None, None, "Deserialize: 4 bytes are no header"), ("null", None, None, None, None, "Deserialize: 0 bytes are no header")}
    whole = spark.read.format(store.NAME).option("blobs", True).load(saved)
    assert {(r.recording_id, bytes(r.blob)) for r in whole.filter("error IS NULL AND recording_id IS NOT NULL").collect()} == {(r.recording_id, bytes(r.blob)) for r in blobs.write_blobs(hashes(spark), "wang-v1", 62.5).collect()}


def test_filters_reach_the_headers(spark, saved, monkeypatch):
    """Rejected blobs are never decoded; what the reader can't test is left to Spark."""
    seen, unpack = [], blobs.unpack
    monkeypatch.setattr(blobs, "unpack", lambda blob, algorithm: seen.append(len(blob)) or unpack(blob, algorithm))
    reader = store.FilteringReader(saved, False)
    left = list(reader.pushFilters([GreaterThan(("hash_count",), 33), EqualTo(("algorithm",), "wang-v1"), GreaterThan(("hash",), 0), StringContains(("recording_id",), "r")]))
    assert left == [GreaterThan(("hash",), 0), StringContains(("recording_id",), "r")]
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert sorted(b.num_rows for b in rows) == [34, 35] and len(seen) == 2
    got = store.read(spark, saved, "hash_count > 33 AND recording_id LIKE 'r%' AND hash % 2 = 0")
    assert got.count() == sum(1 for i in (4, 5) for k in range(30 + i) if k % 2 == 0)
    assert "hash_count > " not in got._jdf.queryExecution().executedPlan().toString()  # taken over
    assert got.filter("recording_id = 'r5'").count() == 18 and got.count() == 35


def test_partitions_are_ranges_of_entries(saved, monkeypatch):
    monkeypatch.setattr(store, "ENTRIES", 1)
    reader = store.BlobReader(saved, True)
    parts = reader.partitions()
    assert len(parts) == 9 and all(p.last == p.first + 1 for p in parts)
    assert sorted(str(b.column("recording_id")[0]) for p in parts for b in reader.read(p)) == sorted(["None", "", "null", *(f"r{i}" for i in range(6))])


def test_only_committed_files_are_read(spark, saved, tmp_path):
    class Row:
        recording_id, blob = "x", b"never"

    files = store.BlobWriter(saved, False).write(iter([Row()]))
    reading = lambda: spark.read.format(store.NAME).load(saved)
    assert reading().filter("recording_id = 'x'").count() == 0
    store.BlobWriter(saved, False).abort([files, None])
    assert not (tmp_path / "store" / files.names[0][0]).exists()
    blobs.write_blobs(hashes(spark, 2), "wang-v1", 62.5).write.format(store.NAME).mode("overwrite").save(saved)
    assert {r.recording_id for r in reading().collect()} == {"r0", "r1"}
    assert len(list((tmp_path / "store").glob("*.manifest"))) == 1
    empty = spark.createDataFrame([], "recording_id string, blob binary")
    empty.write.format(store.NAME).mode("overwrite").save(saved)
    assert reading().count() == 0


def test_table_function(spark):
    tables.register(spark, {"wang": Wang(peaks_per_sec=5)})
    import numpy as np

    x = np.random.default_rng(1).standard_normal(24_000).astype(np.float32)
    r = spark.createDataFrame([("a", 8000, x.tolist()), ("b", 44100, x.tolist()), ("c", 8000, None), ("d", 8000, [None] * 20_000)], "recording_id string, sample_rate int, samples array<float>")
    call = lambda k: spark.sql(f"SELECT r.recording_id, f.* FROM {{r}} r, LATERAL extract_fingerprint(r.samples, r.sample_rate, '{k}') f", r=r)
    got = call("wang")
    assert got.columns == ["recording_id", "hash", "t_anchor", "error"] and call("panako").columns[1:5] == ["hash", "t_anchor", "t_b", "t_c"]
    want = spectral.extract_wang(r.filter("recording_id = 'a'"), Wang(peaks_per_sec=5)).select("recording_id", "hash", "t_anchor")
    rows = got.filter("error IS NULL").select("recording_id", "hash", "t_anchor")
    assert rows.count() == want.count() > 5 and rows.exceptAll(want).count() == 0
    assert {(r.recording_id, r.error) for r in got.filter("error IS NOT NULL").collect()} == {("b", "UnsupportedSampleRate"), ("c", "AudioTooShort"), ("d", "NonFiniteSample")}
    with pytest.raises(AnalysisException, match="algorithm must be one of"):
        call("other")

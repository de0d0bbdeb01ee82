"""Blobs are packed and read many at a time."""

import pytest

from sonorel.sources import blobs, store


@pytest.fixture
def few_rows_at_a_time(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, old)


def test_recordings_are_packed_across_batches(spark, few_rows_at_a_time, monkeypatch):
    rows = [(rid, (37 * k) % 11 + 2**31, k % 5, k) for rid, n in ((None, 9), ("", 3), ("a", 1), ("b", 30), ("c", 2)) for k in range(n)]
    table = spark.createDataFrame(rows, "recording_id string, hash long, t_anchor long, pos long").repartition(4)
    made = blobs.write_blobs(table, "wang-v1", 62.5)
    got = [(r.recording_id, bytes(r.blob)) for r in made.collect()]
    want = {rid: blobs.pack([(h, t) for t, h in sorted((t, h) for i, h, t, _ in rows if i == rid)], "wang-v1", 62.5) for rid in {r[0] for r in rows}}
    assert len(got) == len(want) and dict(got) == want
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()  # a call of Python for each recording
    codes = blobs.write_blobs(table.withColumnRenamed("hash", "frame"), "haitsma-v1", 62.5)
    want = {rid: blobs.pack([[h] for i, h, _, _ in rows if i == rid], "haitsma-v1", 62.5) for rid in want}
    assert {r.recording_id: bytes(r.blob) for r in codes.collect()} == want
    assert blobs.write_blobs(table.limit(0), "wang-v1", 62.5).count() == 0


@pytest.mark.parametrize("most", [1 << 18, 100, 1])
def test_small_blobs_are_read_together(tmp_path, monkeypatch, most):
    class Row:
        def __init__(self, recording_id, blob):
            self.recording_id, self.blob = recording_id, blob

    monkeypatch.setattr(store, "TOGETHER", most)
    rows = [Row(f"r{i}", blobs.pack([(i, k, k + 1, k + 2)[: 1 if kind == "haitsma-v1" else 2 if kind == "wang-v1" else 4] for k in range(i % 4 + 1)], kind, 62.5)) for i in range(30) for kind in (["wang-v1", "panako-v2", "haitsma-v1"][i % 3],)]
    rows[7:7] = [Row(None, b"junk"), Row("cut", rows[0].blob[:20]), Row("", None), Row("none", blobs.pack([], "wang-v1", 62.5)[: blobs.HEADER])]
    writer = store.BlobWriter(str(tmp_path), False)
    writer.commit([writer.write(iter(rows))])
    reader = store.BlobReader(str(tmp_path), False)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    got = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    want = []
    for r in rows:
        try:
            name, n, fps = blobs.header(r.blob or b"")
            head = (r.recording_id, name, n, fps)
            records = blobs.unpack(r.blob, name)[0].tolist()
            want += [(*head, None, *(x + [k] if name == "haitsma-v1" else x), *[None] * (4 - len(x) - (name == "haitsma-v1"))) for k, x in enumerate(records)]
        except ValueError as e:
            head = (r.recording_id, "wang-v1", 1, 62.5) if r.recording_id == "cut" else (r.recording_id, None, None, None)
            want.append((*head, f"Deserialize: {e}", None, None, None, None))
    assert got == want
    assert len(batches) == 1 if most > 100 else len(batches) > 1
    whole = store.BlobReader(str(tmp_path), True)
    assert [(r["recording_id"], r["blob"]) for p in whole.partitions() for b in whole.read(p) for r in b.to_pylist()] == [(r.recording_id, r.blob or b"") for r in rows]

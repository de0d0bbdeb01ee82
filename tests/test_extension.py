from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from sonorel.configs import PanakoMatch
from sonorel.errors import ConfigError
from sonorel.operators import matching as M
from sonorel.operators import neural, progress
from sonorel.operators.extension import Fingerprinter, Matcher, StreamingFingerprinter, catalogue_pairs
from sonorel.plans.frontends import WANG
from sonorel.sources import index, signals
from sonorel.streaming.extractors import HashProcessor, LandmarkStream

SF = "/root/testdata/sf0.001"


def test_own_extractor(spark):
    class Peaks(Fingerprinter):
        name, sample_rate, fields = "peaks", 8000, ("at",)

        def extract(self, samples):
            return [np.nonzero(samples > 0.9)[0]]

    df = spark.createDataFrame([("a", 8000, [0.0, 1.0, 0.5, 1.0]), ("b", 1, [1.0])], "recording_id string, sample_rate int, samples array<float>")
    rows = Peaks().apply(df).collect()
    assert [(r.recording_id, r.at) for r in rows if r.error is None] == [("a", 1), ("a", 3)] and len(rows) == 3


def test_progress_rises_from_0_to_1(spark):
    told = []
    slow = spark.range(0, 400_000, 1, 64).mapInPandas(lambda p: p, "id long")
    assert progress.with_progress(spark, slow.count, told.append, 0.02) == 400_000
    assert told[0] == 0 and told[-1] == 1 and all(a < b for a, b in zip(told, told[1:])) and all(x <= progress.NEARLY for x in told[:-1])


def test_progress_of_failures(spark):
    told = []
    with pytest.raises(ZeroDivisionError):
        progress.with_progress(spark, lambda: 1 // 0, told.append)
    assert told == [0]

    def stop(x):
        if x:
            raise KeyError("enough")

    class Tracker:
        def getJobIdsForGroup(self, group):  # noqa: N802
            return [1, 2]

        def getJobInfo(self, job):  # noqa: N802
            return SimpleNamespace(stageIds=[10 * job, 10 * job + 1]) if job == 1 else None

        def getStageInfo(self, stage):  # noqa: N802
            return SimpleNamespace(numTasks=8, numCompletedTasks=2) if stage == 10 else None

    assert progress.share_done(Tracker(), "g") == 0.25
    with pytest.raises(KeyError):
        progress.with_progress(spark, lambda: 1, stop)


def test_callbacks_get_what_lists_hold():
    x = np.sin(np.arange(4000) ** 1.5 / 90).astype(np.float32) * 100
    a, b, got = LandmarkStream(WANG), LandmarkStream(WANG), []
    want = [f for k in range(0, 4000, 333) for f in a.push(x[k : k + 333])] + a.flush()
    n = sum(b.push_with(x[k : k + 333], got.append) for k in range(0, 4000, 333)) + b.flush_with(got.append)
    assert got == want and n == len(want) > 10


def test_networks_from_tables(spark):
    schema = "layer int, unit long, weights array<double>, bias double"
    net = neural.network(spark.createDataFrame([(1, 0, [1.0, -1.0], 0.5), (0, 1, [0.0, -2.0, 1.0], 0.0), (0, 0, [1.0, 1.0, 1.0], -1.0)], schema))
    mels = np.array([[[0.0, 2.0], [1.0, 1.0], [5.0, 3.0]], [[0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]])
    assert net(mels).tolist() == [[5.0 - 2.0 + 0.5], [0.5]]  # means 1, 1, 4: 5 and 2; then none, cut at 0
    for rows in ([], [(0, 0, [1.0, None], 0.0)], [(0, 0, None, 0.0)], [(0, 0, [1.0], None)], [(0, 0, [1.0], 0.0), (0, 1, [1.0, 2.0], 0.0)], [(0, 0, [1.0], 0.0), (1, 0, [1.0, 2.0], 0.0)]):
        with pytest.raises(ConfigError):
            neural.network(spark.createDataFrame(rows, schema))


def test_own_matcher(spark):
    class Overlap(Matcher):
        def match_one(self, query, reference):
            n = len(set(query["hash"]) & set(reference["hash"]))
            return {"is_match": n > 30, "votes": n, "score": n / max(1, len(query))}

    q, r = signals.hash_queries(spark, SF), signals.hash_stream(spark, SF)
    rows = Overlap().apply(catalogue_pairs(q, r), q, r).collect()
    assert len(rows) == 100 and {(x.query_id, x.ref_id) for x in rows if x.is_match} == {(str(i), str(i)) for i in range(10)}


def test_bucketed_index_needs_no_shuffle_of_the_catalogue(spark):
    q, r = signals.hash_queries(spark, SF), signals.hash_stream(spark, SF)
    index.save_index(r, "catalogue", 4, max_postings=100)
    stored = index.load_index(spark, "catalogue")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    votes = M.wang_votes(q, stored)
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert votes.count() == M.wang_votes(q, M.stop_hashes(r, 100)).count()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("DROP TABLE catalogue")


class Count(StreamingFingerprinter):
    """Numbers its chunks."""

    def __init__(self):
        self.n = 0

    def push(self, samples):
        self.n += 1
        return [(self.n, len(samples), 0, None, None)]

    def flush(self):
        return [(-1, self.n, 0, None, None)]


class Value:
    def __init__(self):
        self.value, self.writes = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None


class Map(dict):
    """Map state; counts what is read and written."""

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value
        self.writes = getattr(self, "writes", 0) + 1

    def removeKey(self, key):
        del self[key]


class Store:
    """States and timers of one key, and its clock."""

    def __init__(self, now=1000):
        self.states, self.timers, self.now = {}, [], now

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def getMapState(self, name, key_schema, value_schema):
        return self.states.setdefault(name, Map())

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def empty(self):
        return not any(s.exists() if isinstance(s, Value) else s for s in self.states.values())


def pusher(p, store, event_time=None):
    def push(*rows):
        frame = pd.DataFrame([(r[0], None if r[1] is None else [0.0] * r[1], r[2], len(r) > 3 and r[3] == "reset") for r in rows], columns=["seq", "samples", "eos", "reset"])
        if event_time:
            frame[event_time] = [pd.Timestamp(1000 * r[0], unit="ms") for r in rows]
        (out,) = p.handleInputRows(("s",), iter([frame]), store)
        return [x if isinstance(x, str) else int(x) for x in out["error"].where(out["error"].notna(), out["t_ms"])]

    return push


def expire(p, store):
    store.timers.clear()
    return [x if isinstance(x, str) else int(x) for out in p.handleExpiredTimer(("s",), store, None) for x in out["error"].where(out["error"].notna(), out["t_ms"])]


def test_stream_state_of_own_extractor():
    store, p = Store(), HashProcessor(Count, max_gap=64, patience_ms=50)
    p.init(store)
    push = pusher(p, store)
    assert push((1, 2, False), (0, 3, False), (0, 9, False)) == [1, 2] and not store.timers
    assert push((4, 1, True)) == push((3, 1, False)) == [] and store.timers == [1050]  # chunk 2 is missing
    assert expire(p, store) == ["chunks 2 to 2 are missing", 3, 4, -1]
    assert store.timers == [1050] and push((2, 1, False)) == []  # too late, the stream has ended
    assert expire(p, store) == [] and store.empty()


def test_a_batch_touches_what_comes_and_what_is_due():
    """However many chunks wait: nothing of them is read or written again."""
    store, p = Store(), HashProcessor(Count, max_gap=10**6)
    p.init(store)
    push = pusher(p, store)
    assert push(*[(k, 1, False) for k in range(1, 500)]) == []
    early, blob = store.states["early"], store.states["extractor"]
    assert early.writes == len(early) == 499 and len(blob.value[0]) < 200
    assert push((600, 1, False), (7, 1, False)) == [] and early.writes == 500 and len(early) == 500
    assert push((0, 1, False)) == list(range(1, 501)) and early.writes == 500 and list(early) == [(600,)]
    assert push((501, 1, False), (500, 1, True)) == [501, -1] and not early and not blob.exists()


def test_a_reset_starts_the_stream_over():
    store, p = Store(), HashProcessor(Count)
    p.init(store)
    push = pusher(p, store)
    assert push((0, 1, False), (1, 1, False)) == [1, 2]
    assert push((3, 1, True), (2, 1, False, "reset")) == [1, 2, -1]


class Brittle(Count):
    def push(self, samples):
        if len(samples) == 13:
            raise ValueError("thirteen")
        return super().push(samples)


def test_one_streams_failure_is_its_row():
    store, p = Store(), HashProcessor(Brittle)
    p.init(store)
    push = pusher(p, store)
    assert push((0, 1, False), (1, 13, False), (2, 1, False)) == [1, "ValueError: thirteen", 1]
    assert push((3, 13, True)) == ["ValueError: thirteen"] and push((4, 1, False)) == []


def test_silent_streams_are_flushed_by_event_time():
    store, p = Store(), HashProcessor(Count, patience_ms=500, event_time="at")
    p.init(store)
    push = pusher(p, store, "at")
    assert push((0, 1, False)) == [1] and store.timers == [500]
    assert push((1, 1, False), (3, 1, False)) == [2] and store.timers == [3500]
    assert push((0, 1, False)) == [] and store.timers == [3500]  # an old copy doesn't bring the end nearer
    assert expire(p, store) == ["chunks 2 to 2 are missing", 3, -1] and store.empty()
    assert push((0, 1, False), (1, 1, True)) == [1, 2, -1] and not store.empty() and push((0, 1, False)) == []
    assert expire(p, store) == [] and store.empty()


def test_fitted_line(spark):
    """Pairs of few and of many votes against plain enumeration of the candidates; pairs without a candidate give nothing."""
    cfg, rng, pairs = PanakoMatch(), np.random.default_rng(3), {}
    for n in (2, 9, 30, 33, 200):  # up to 32 all pairs of votes are tried
        tq = np.sort(rng.choice(5000, n, replace=False)).astype(float)
        tr = np.round(1.05 * tq + 70)
        lost = rng.random(n) < 0.3
        lost[:2] = False
        tr[lost] = rng.integers(0, 5000, lost.sum())
        pairs[n] = tq, tr
    none = {-1: ([1.0], [1.0]), -2: ([4.0, 4.0], [1.0, 9.0]), -3: ([0.0, 1.0], [0.0, 90.0])}
    rows = [(k, 7, i, float(a), float(b)) for k, (x, y) in (pairs | none).items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    votes = spark.createDataFrame(rows, "query_id int, ref_id int, qi int, tq double, tr double")
    got = {r.query_id: r for r in M.fitted_lines(votes, cfg).collect()}
    assert set(got) == set(pairs)
    for n, (tq, tr) in pairs.items():
        ahead = range(1, n) if n * (n - 1) / 2 <= cfg.refine_lines else [1 << p for p in range(12)]
        best = None
        for i in range(n):
            for j in (i + a for a in ahead if i + a < n):
                x = (tr[j] - tr[i]) / (tq[j] - tq[i])
                if cfg.scale_min <= x <= cfg.scale_max:
                    d = np.abs(tr - (x * tq + (tr[i] - x * tq[i])))
                    rank = (-(d <= 2).sum(), round(d[d <= 2].mean(), 9), i, j, x, tr[i] - x * tq[i])
                    best = min(best or rank, rank)
        assert (got[n].inliers, got[n]["scale"], got[n]["shift"]) == (-best[0], best[4], best[5])
        assert n == 2 or abs(got[n]["scale"] - 1.05) < 0.02 and got[n].inliers >= (np.abs(tr - (1.05 * tq + 70)) <= 1).sum()

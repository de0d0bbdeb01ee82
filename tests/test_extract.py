"""Front-ends on synthetic audio: invariants, errors, and streaming against batch."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonorel import errors
from sonorel.configs import Embedder, Haitsma, Mel, Panako, Stft, Wang, WangMatch, Watermark
from sonorel.functions import kernels as K
from sonorel.operators import landmarks as L
from sonorel.operators import matching as M
from sonorel.operators import neural as N
from sonorel.operators import spectral as S
from sonorel.streaming.extractors import EmbeddingStream, HaitsmaStream, LandmarkStream, RunningMax


def audio(seconds: float, rate: int = 8000, seed: int = 1) -> np.ndarray:
    """Tones that change every quarter of a second, with noise."""
    rng = np.random.default_rng(seed)
    n = int(seconds * rate)
    t = np.arange(n) / rate
    f = np.repeat(rng.uniform(200, rate / 2 - 300, (n // (rate // 4) + 1, 3)), rate // 4, axis=0)[:n]
    return (0.3 * np.sin(2 * np.pi * f * t[:, None]).sum(axis=1) + 0.02 * rng.standard_normal(n)).astype(np.float32)


def recordings(spark, *rows):
    return spark.createDataFrame([(i, r, x if x is None else [float(v) for v in x]) for i, r, x in rows], "recording_id string, sample_rate int, samples array<float>")


def test_stft_against_definition():
    x = np.random.default_rng(0).standard_normal(100)
    cfg = Stft(16, 4, "hamming", center=True)
    p = K.power(x, cfg)
    assert p.shape == (cfg.n_frames(100), 9)
    padded = np.pad(x, 8, mode="reflect")
    frame = padded[5 * 4 : 5 * 4 + 16] * K.window("hamming", 16)
    k = np.arange(16)
    want = [abs((frame * np.exp(-2j * np.pi * f * k / 16)).sum()) ** 2 for f in range(9)]
    assert np.allclose(p[5], want)


@given(st.integers(1, 40), st.integers(1, 30), st.integers(0, 12), st.integers(0, 1))
@settings(max_examples=40, deadline=None)
def test_sliding_max(rows, cols, half, axis):
    x = np.random.default_rng(rows * 31 + cols).standard_normal((rows, cols))
    got = K.sliding_max(x, half, axis)
    for i in range(x.shape[axis]):
        lo, hi = max(0, i - half), i + half + 1
        want = (x[lo:hi] if axis == 0 else x[:, lo:hi]).max(axis=axis)
        assert (got.take(i, axis=axis) == want).all()


def test_resamplers():
    x = np.sin(2 * np.pi * 300 * np.arange(4000) / 8000).astype(np.float32)
    for f in (K.resample_linear, K.resample_sinc):
        y = f(x, 8000, 5000)
        assert len(y) == 2500
        want = np.sin(2 * np.pi * 300 * np.arange(2500) / 5000)
        assert np.abs(y - want)[100:-100].max() < (0.02 if f is K.resample_linear else 0.01)
        assert (f(x, 8000, 8000) == x).all() and len(f(x[:0], 8000, 5000)) == 0
        with pytest.raises(ValueError):
            f(x, 0, 5000)
    assert np.allclose(K.resample_sinc(np.ones(500, np.float32), 8000, 4000)[40:-40], 1, atol=1e-3)


def test_mel_filters():
    w = K.mel_weights(Mel(20, 512, 16000))
    assert w.shape == (20, 257) and (w >= 0).all() and (w.sum(axis=1) > 0).all()
    silence = K.log_mel(np.zeros((3, 257)), w)
    assert np.allclose(silence, -10)


def test_batch_extractors_and_errors(spark):
    x = audio(4)
    df = recordings(spark, ("a", 8000, x), ("silence", 8000, np.zeros(20000)), ("short", 8000, x[:100]), ("rate", 44100, x), ("nan", 8000, [1.0, float("nan")] * 9000), ("null", 8000, None))
    for f in (S.extract_wang, S.extract_panako):
        rows = f(df).collect()
        by = {}
        for r in rows:
            by.setdefault(r.recording_id, []).append(r)
        assert len(by["a"]) > 50 and all(r.error is None for r in by["a"])
        assert "silence" not in by
        assert {k: v[0].error.code for k, v in by.items() if k != "a"} == {"short": errors.TOO_SHORT, "rate": errors.BAD_RATE, "nan": errors.NON_FINITE, "null": errors.TOO_SHORT}
        keys = [(r.t_anchor, r.hash) if f is S.extract_wang else (r.t_anchor, r.t_b, r.t_c, r.hash) for r in by["a"]]
        assert keys == sorted(keys) and all(0 <= r.hash < 1 << 32 for r in by["a"])
    frames = S.extract_haitsma(recordings(spark, ("s", 5000, np.zeros(20000)))).collect()
    assert len(frames) == Haitsma.stft.n_frames(20000) - 1 and {r.frame for r in frames} == {0}
    over = S.extract_wang(df.filter("recording_id = 'a'"), Wang(max_hashes=10)).collect()
    assert [r.error.code for r in over] == [errors.TOO_LARGE]


def test_sql_landmarks_equal_the_arrow_front_end(spark):
    x = audio(3, seed=4)
    df = recordings(spark, ("a", 8000, x))
    for cfg, front, pairs in ((Wang(), S.extract_wang, L.wang_hashes), (Panako(), S.extract_panako, L.panako_hashes)):
        t, f, mag = S._peaks(x, cfg)
        peaks = spark.createDataFrame([("a", int(a), int(b), float(c)) for a, b, c in zip(t, f, mag)], "recording_id string, t bigint, f bigint, mag float")
        want = sorted(r[1:-1] for r in front(df, cfg).collect())
        got = sorted(r[1:] for r in pairs(peaks, cfg.target_zone_t, cfg.target_zone_f, cfg.fan_out).collect())
        assert got == want


def test_clip_is_found_with_its_offset(spark):
    x, y = audio(12, seed=2), audio(12, seed=3)
    start = 4 * 8000
    refs = S.extract_wang(recordings(spark, ("x", 8000, x), ("y", 8000, y))).selectExpr("recording_id AS ref_id", "hash", "t_anchor AS t")
    query = S.extract_wang(recordings(spark, ("q", 8000, x[start : start + 4 * 8000]), ("other", 8000, audio(4, seed=9)))).selectExpr("recording_id AS query_id", "t_anchor AS t", "hash", "row_number() OVER (PARTITION BY recording_id ORDER BY t_anchor, hash) - 1 AS qi")
    for f in (M.wang_index_query, M.wang_match_dense):
        (r,) = f(query, refs).collect()
        assert (r.query_id, r.ref_id, r.offset_frames, r.offset_ms) == ("q", "x", start // 128, start // 128 * 16)
        assert r.score > 0.5
    assert M.wang_index_query(query, refs, WangMatch(min_votes=10**6)).count() == 0


CHUNKS = st.lists(st.integers(1, 5000), min_size=1, max_size=12)


def stream(ex, x, sizes):
    out, at, i = [], 0, 0
    while at < len(x):
        n = sizes[i % len(sizes)]
        out += ex.push(x[at : at + n])
        at, i = at + n, i + 1
    return out + ex.flush()


@given(CHUNKS, st.integers(0, 5))
@settings(max_examples=12, deadline=None)
def test_streaming_equals_batch(sizes, seed):
    x = audio(3.3, seed=seed)
    x[6000:15000] *= seed % 2  # a silent stretch
    for cfg, batch in ((Wang(), S.wang_hashes_of), (Panako(), S.panako_hashes_of)):
        got = stream(LandmarkStream(cfg), x, sizes)
        want = [tuple(map(int, r)) for r in zip(*batch(x, cfg))]
        assert sorted(tuple(v for v in g[1:] if v is not None) for g in got) == sorted(want)
        assert all(g[0] == g[2] * 16 for g in got)


@given(CHUNKS)
@settings(max_examples=8, deadline=None)
def test_streaming_codes_equal_batch(sizes):
    x = audio(3, 5000)
    got = stream(HaitsmaStream(), x, sizes)
    pos, codes = S.haitsma_frames_of(x, Haitsma())
    assert [(g[2], g[1]) for g in got] == list(zip(pos.tolist(), codes.tolist()))
    assert got[5][0] == int((got[5][2] + 1) * 12.8)


@given(st.integers(0, 4), st.lists(st.integers(0, 9), max_size=12), st.integers(0, 2**32 - 1))
@settings(max_examples=80, deadline=None)
def test_running_maximum(half, sizes, seed):
    """Row by row, in chunks of any size, with a flush that can be repeated."""
    x = np.random.default_rng(seed).standard_normal((sum(sizes), 3)).astype(np.float32)
    m, at, got = RunningMax(half, 3), 0, []
    for n in sizes:
        got += m.push(x[at : at + n])
        at += n
        assert len(got) == max(0, at - half)
    got += m.flush() + m.flush()
    assert len(got) == len(x) and all((g == x[max(0, i - half) : i + half + 1].max(axis=0)).all() for i, g in enumerate(got))


@given(st.integers(0, 2**32 - 1), st.integers(1, 4), st.booleans())
@settings(max_examples=60, deadline=None)
def test_landmarks_against_enumeration(seed, fan_out, capped):
    """Pairs and triples, with many equal magnitudes, and the cap on the targets that a stream keeps for an anchor."""
    rng = np.random.default_rng(seed)
    cells = sorted({(int(a), int(b)) for a, b in rng.integers(0, (30, 12), (60, 2))})
    t, f = np.array(cells).T
    mag = rng.integers(0, 6, len(t)).astype(np.float32)
    pairs, triples = [], []
    for i in range(len(t)):
        key = lambda j: (-mag[j], t[j], f[j])
        pairs += [(i, j) for j in sorted((j for j in range(len(t)) if 1 <= t[j] - t[i] <= 9 and abs(f[j] - f[i]) <= 5), key=key)[:fan_out]]
        kept = []
        for j in range(len(t)):  # one after the other; the weakest and latest goes
            if 1 <= t[j] - t[i] < 9 and abs(f[j] - f[i]) < 5:
                kept.append(j)
                if capped and len(kept) > 2 * fan_out:
                    kept.remove(max(kept, key=key))
        sums = sorted(((-(mag[b] + mag[c]), b, c) for x, b in enumerate(kept) for c in kept[x + 1 :]))
        triples += [(i, b, c) for _, b, c in sums[:fan_out]]
    a, b = K.landmark_pairs(t, f, mag, 9, 5, fan_out)
    assert list(zip(a.tolist(), b.tolist())) == pairs
    got = K.landmark_triples(t, f, mag, 9, 5, fan_out, 2 * fan_out if capped else None)
    assert list(map(tuple, got.T.tolist())) == triples


def test_a_failing_window_gives_one_error_row():
    """It is tried again with the next push; windows before and behind it are right."""
    tried = []

    def model(w):
        tried.append(int(w[0]))
        if w[0] == 4:
            raise RuntimeError("no")
        return w[:1]

    cfg = Embedder(sample_rate=8, n_fft=2, hop=1, n_mels=1, window_secs=0.5, hop_secs=0.25)
    s = EmbeddingStream(cfg, model)
    got = s.push(np.arange(9))
    assert [(t, v.tolist(), e) for t, v, e in got] == [(0, [0], None), (250, [2], None)] and len(s.carry) == 5 and tried == [0, 2, 4]
    got = s.push(np.arange(9, 13))
    assert [(t, v if v is None else v.tolist(), e) for t, v, e in got] == [(500, None, "Inference: no"), (750, [6], None), (1000, [8], None)] and tried == [0, 2, 4, 4, 6, 8]
    last = EmbeddingStream(cfg, model)
    assert last.push(np.arange(4, 8)) == [] and [e for *_, e in last.flush()] == ["Inference: no"] and last.flush() == []


def test_latency():
    assert LandmarkStream(Wang()).latency_ms() == 2256 and LandmarkStream(Panako()).latency_ms() == 2784
    assert HaitsmaStream().latency_ms() == 409


def test_structured_streaming(spark, tmp_path):
    from sonorel.streaming.extractors import stream_hashes

    x = audio(3, seed=7)
    parts = [x[i : i + 4000] for i in range(0, len(x), 4000)]
    rows = [("s", i, [float(v) for v in p], i == len(parts) - 1) for i, p in enumerate(parts)]
    schema = "stream_id string, seq bigint, samples array<float>, eos boolean"
    for k, order in enumerate(([1, 0], [2, 3, 3], list(range(4, len(rows))))):  # out of order, with a repeat
        spark.createDataFrame([rows[i] for i in order], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_hashes(chunks).writeStream.format("memory").queryName("hashes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted((r["hash"], r["t_anchor"]) for r in spark.sql("SELECT * FROM hashes").collect())
    assert got == sorted(tuple(map(int, r)) for r in zip(*S.wang_hashes_of(x, Wang())))


def test_embedder(spark):
    _model = lambda batch: batch.mean(axis=2)
    cfg = Embedder(n_fft=256, hop=128, n_mels=8, window_secs=0.25, hop_secs=0.25, batch_size=3)
    x = audio(2, 16000)
    rows = N.embed(recordings(spark, ("a", 16000, x), ("b", 8000, x)), cfg, _model).collect()
    good = [r for r in rows if r.error is None]
    assert [r.t_ms for r in good] == [i * 250 for i in range(8)] and abs(np.linalg.norm(good[0].vector) - 1) < 1e-5
    assert [r.error.code for r in rows if r.error] == [errors.BAD_RATE]
    s = EmbeddingStream(cfg, lambda w: N.windows_to_vectors(w, cfg, _model)[1][0])
    got = s.push(x[:5000]) + s.push(x[5000:])
    assert [(t, e) for t, _, e in got] == [(r.t_ms, None) for r in good] and np.allclose([v for _, v, _ in got], [r.vector for r in good], atol=1e-5)


def test_watermarks(spark):
    model = lambda x: (np.full(x.shape[-1], 0.75), np.array([1.0, -1.0, 0.0] + [-1.0] * 13))
    rows = N.detect_watermarks(recordings(spark, ("a", 16000, audio(1, 16000)), ("e", 16000, []), ("r", 8000, [0.0])), Watermark(), model).collect()
    by = {r.recording_id: r for r in rows}
    assert by["a"].detected and by["a"].message == 0b101 and abs(by["a"].confidence - 0.75) < 1e-6
    assert by["e"].error.code == errors.TOO_SHORT and by["r"].error.code == errors.BAD_RATE
    assert N.watermark_result(np.array([0.5]), np.array([1.0]), Watermark())[:3] == (False, 0.5, 0)


def test_configs():
    assert Wang(fan_out=0, target_zone_t=9999, peaks_per_sec=900).fan_out == 1
    assert Wang(target_zone_t=9999).target_zone_t == 512 and Wang(max_hashes=0).max_hashes == 1
    for bad in (lambda: Stft(1000), lambda: Stft(16, 17), lambda: Mel(0), lambda: Mel(fmin=-1), lambda: Haitsma(fmin=0), lambda: Watermark(threshold=2), lambda: Embedder(window_secs=0.01)):
        with pytest.raises(errors.ConfigError):
            bad()

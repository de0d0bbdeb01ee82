"""What the last digits decide: near ties of peaks, edges of filters that lie on a bin, clips of sequences that are too short."""

import duckdb
import numpy as np

from sonorel.configs import Mel
from sonorel.functions import kernels as K
from sonorel.operators import long
from sonorel.operators import neural as N
from sonorel.operators import spectral as S
from sonorel.plans import frontends, registry
from sonorel.streaming.extractors import LandmarkStream


def test_peaks_that_differ_in_the_eighth_digit(spark):
    x = np.zeros(160, np.float32)
    x[24], x[56] = 100, np.nextafter(np.float32(100), np.float32(200))
    cfg = frontends.SmallWang(fan_out=3, target_zone_t=20, target_zone_f=6, peaks_per_sec=1, min_anchor_mag_db=-100.0)
    assert S._peaks(x, cfg)[0].tolist() == [6]
    stream = LandmarkStream(cfg)
    stream.push(x)
    stream._detect(stream.high.flush())
    stream._close(None)
    assert stream.closed[:, 0].tolist() == [6]
    # the later one is also the target of an anchor that may have only one
    x[8] = 300
    one = frontends.SmallWang(fan_out=1, target_zone_t=20, target_zone_f=1, peaks_per_sec=0, min_anchor_mag_db=-100.0)
    h, t = S.wang_hashes_of(x, one)
    assert set(h[t == 0] & 16383) == {6}
    r = spark.createDataFrame([("a", 8000, [float(v) for v in x])], "recording_id string, sample_rate int, samples array<float>")
    got = long.extract_wang(long.blocks_of(r, 50), one, 1).collect()
    assert sorted((v.hash, v.t_anchor) for v in got) == sorted(zip(h.tolist(), t.tolist()))


def test_models_get_double_precision():
    seen = []
    N.windows_to_vectors(np.ones(64, np.float32), frontends.EMBEDDER, lambda b: seen.append(b.dtype) or b.argmax(axis=1))
    assert seen == [np.float64]


def test_filters_do_not_hang_on_the_processor(monkeypatch):
    want = {(scale, rate): K.mel_weights(Mel(6, 16, rate, scale=scale)) for scale in ("htk", "slaney") for rate in range(8000, 16500, 500)}
    for name in ("log10", "log", "exp"):  # as other processors round them
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda x, plain=plain: np.nextafter(plain(x), np.inf))
    for (scale, rate), w in want.items():
        assert (K.mel_weights(Mel(6, 16, rate, scale=scale)) == w).all()


def test_sliding_over_short_sequences(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("vec_id < 580")
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    n = e.groupBy(registry.G._sequence()).count()
    assert n.filter("count < 8").count() and n.filter("count BETWEEN 8 AND 10").count()
    got = registry.neural_sliding(spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES['neural_sliding']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))

"""Extraction by segments with halos against the single pass over whole recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorel import errors
from sonorel.configs import Haitsma, Panako, Wang
from sonorel.operators import long, spectral


def music(seconds, rate, seed):
    rng = np.random.default_rng(seed)
    n = seconds * rate
    f = np.repeat(rng.uniform(200, 2000, (seconds * 4, 3)), rate // 4, axis=0)[:n]
    return (0.3 * np.sin(2 * np.pi * f * (np.arange(n) / rate)[:, None]).sum(axis=1) + 0.02 * rng.standard_normal(n)).astype(np.float32)


def recordings(spark, lengths, rate):
    rows = [(str(i), rate, music(s, rate, i)[: s * rate - 37 * i].tolist()) for i, s in enumerate(lengths)]
    return spark.createDataFrame(rows, "recording_id string, sample_rate int, samples array<float>")


@pytest.mark.parametrize(("cfg", "rate", "name"), [(Wang(max_input_samples=None, max_hashes=None), 8000, "extract_wang"), (Panako(max_input_samples=None, max_hashes=None), 8000, "extract_panako"), (Haitsma(max_input_samples=None), 5000, "extract_haitsma")])
def test_segments_equal_the_single_pass(spark, cfg, rate, name):
    """At the real configurations, with blocks and segments that don't fit each other."""
    r = recordings(spark, [100, 3, 47], rate).persist()
    whole = getattr(spectral, name)(r, cfg)
    for size, seconds in ((10_007, 7), (400_000, 60)):
        got = getattr(long, name)(long.blocks_of(r, size).repartition(5), cfg, seconds)
        assert got.count() == whole.count() > 1000
        assert got.exceptAll(whole).count() == 0
    few, many = (getattr(long, name)(long.blocks_of(r, 400_000), cfg, s).groupBy("recording_id").count().count() for s in (60, 7))
    assert few == many == 3


def test_a_long_recording_is_many_segments():
    """Two hours: every segment needs a bounded stretch, each frame is owned once, and blocks go only where they are needed."""
    for cfg in (Wang(), Panako(), Haitsma()):
        plan = long._Plan(cfg, 60)
        n = 7200 * cfg.sample_rate
        owned = [plan.owned(k) for k in range(121)]
        assert all(a[1] == b[0] for a, b in zip(owned, owned[1:]))
        assert max(hi - lo for lo, hi in map(plan.samples, range(121))) < 66 * cfg.sample_rate
        for at in [*range(0, n, 999_983), 0, 1, n - 1]:
            for size in (1, 40_000):
                want = [k for k in range(121) if plan.samples(k)[0] < at + size and plan.samples(k)[1] > at]
                assert list(plan.segments(at, size)) == want


def test_faults(spark):
    r = recordings(spark, [3] * 6, 8000)
    b = long.blocks_of(r, 5000)
    k = F.col("recording_id")
    nan = F.transform("samples", lambda x, i: F.when(i == 7, F.lit(float("nan"))).otherwise(x))
    b = b.withColumn("samples", F.when((k == "1") & (F.col("at") == 10_000), nan).otherwise(F.col("samples")))
    b = b.withColumn("sample_rate", F.when((k == "2") & (F.col("at") == 5000), 44100).otherwise(F.col("sample_rate")))
    b = b.filter((k != "3") | (F.col("at") != 5000)).filter((k != "4") | (F.col("at") < 10_000)).union(b.filter((k == "5") & (F.col("at") == 5000)))
    got = {(x.recording_id, x.error.code, x.error.detail) for x in long.extract_wang(b).filter("error IS NOT NULL").collect()}
    assert got == {("1", errors.NON_FINITE, "sample 10007"), ("2", errors.BAD_RATE, "44100 Hz"), ("3", errors.BAD_IO, "blocks leave gaps or overlap"), ("4", errors.TOO_SHORT, "10000 samples"), ("5", errors.BAD_IO, "blocks leave gaps or overlap")}
    assert long.extract_wang(b.filter("false")).collect() == []
    with pytest.raises(errors.ConfigError):
        long.extract_wang(b, seconds=0)

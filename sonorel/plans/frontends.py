"""Registered queries of the front-ends, batch and streaming, of decoding, blobs and extension points, with their
DuckDB oracles. Options are small ones that fit the derived recordings."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorel.configs import DecodeLimits, Embedder, Haitsma, Panako, Stft, Wang, Watermark
from sonorel.errors import ConfigError
from sonorel.functions import columns as C
from sonorel.operators import extension as X
from sonorel.operators import long
from sonorel.operators import neural as N
from sonorel.operators import spectral as S
from sonorel.operators.lags import shared_counts
from sonorel.operators.progress import with_progress
from sonorel.plans import oracles as O
from sonorel.functions import tables
from sonorel.sources import audio, blobs, shared, store
from sonorel.sources import signals as G
from sonorel.sources.formats import IMA_MOVES, IMA_STEPS
from sonorel.streaming import extractors as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


class SmallWang(Wang):
    stft = Stft(16, 8, "hann", center=False)
    neighborhood = 2
    frames_per_sec = 10.0
    min_samples = 16


class SmallPanako(Panako):
    stft = Stft(16, 8, "hann", center=False)
    neighborhood = 2
    frames_per_sec = 10.0
    min_samples = 16


class SmallHaitsma(Haitsma):
    sample_rate = 8000
    stft = Stft(64, 16, "hann", center=False)
    frames_per_sec = 500.0
    min_samples = 16


WANG = SmallWang(fan_out=3, target_zone_t=20, target_zone_f=6, peaks_per_sec=4, min_anchor_mag_db=0.0)
PANAKO = SmallPanako(fan_out=3, target_zone_t=21, target_zone_f=7, peaks_per_sec=4, min_anchor_mag_db=0.0)
HAITSMA = SmallHaitsma()
EMBEDDER = Embedder(sample_rate=8000, n_fft=16, hop=8, n_mels=6, window_secs=0.008, hop_secs=0.004, l2_normalize=False, batch_size=4)


def strongest_mel(batch: np.ndarray) -> np.ndarray:
    """A model without weights: the strongest mel band of each frame."""
    return batch.argmax(axis=1)


# --- spectra and extraction ----------------------------------------------------------------------------------


@query
def stft_centered(spark, sf_dir):
    rows = S.power_long(S.power_rows(G.recordings(spark, sf_dir), Stft(16, 4, "hamming", center=True)))
    return rows.withColumn("v", F.round("v", 3))


@query
def frame_power(spark, sf_dir):
    """Single frames; of ten recordings one (7) has a frame that is a sample short."""
    r = G.recordings(spark, sf_dir)
    n = F.when(F.col("recording_id") % 10 == 7, 15).otherwise(16)
    got = S.frame_power(r.select("recording_id", F.slice("samples", F.lit(1), n).alias("samples")), Stft(16, 8, "hann", center=False))
    p = got.select("recording_id", F.posexplode_outer("power").alias("f", "v"), "error.code")
    return p.select("recording_id", F.col("f").cast("bigint").alias("f"), F.round("v", 3).alias("v"), "code")


@query
def frame_counts(spark, sf_dir):
    n = (F.col("s_suppkey") * 37) % 3000
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", n.cast("bigint").alias("n"))
    return s.select("s_suppkey", C.n_frames(F.col("n"), 1024, 128, False).alias("inside"), C.n_frames(F.col("n"), 1024, 256, True).alias("centered"))


@query
def push_limit(spark, sf_dir):
    bad = F.transform("samples", lambda x, i: F.when((i == 60) & (F.col("recording_id").cast("int") % 10 < 5), F.lit(float("nan"))).otherwise(x))
    r = G.recordings(spark, sf_dir).select("recording_id", C.truncated(bad, 50).alias("head"), bad.alias("whole"))
    return r.select("recording_id", F.size("head").cast("bigint").alias("n"), C.non_finite(F.col("head")).alias("head_bad"), C.non_finite(F.col("whole")).alias("whole_bad"))


@query
def extract_wang(spark, sf_dir):
    return S.extract_wang(G.recordings(spark, sf_dir), WANG).select("recording_id", "hash", "t_anchor", "error.code")


@query
def extract_panako(spark, sf_dir):
    return S.extract_panako(G.recordings(spark, sf_dir), PANAKO).select("recording_id", "hash", "t_anchor", "t_b", "t_c", "error.code")


@query
def extract_haitsma(spark, sf_dir):
    return S.extract_haitsma(G.recordings(spark, sf_dir), HAITSMA).select("recording_id", "pos", "frame", "error.code")


@query
def extract_errors(spark, sf_dir):
    """Every tenth of the recordings' defects: missing, cut short, wrong rate, one value that is no number, too long, too many hashes."""
    r, k = G.recordings(spark, sf_dir), F.col("recording_id").cast("int") % 10
    nan = F.transform("samples", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x))
    samples = F.when(k == 0, None).when(k == 1, F.slice("samples", 1, 15)).when(k == 2, nan).otherwise(F.col("samples"))
    broken = r.filter(k <= 5).select("recording_id", F.when(k == 3, 44100).otherwise(8000).alias("sample_rate"), samples.alias("samples"))
    limits = {k: v for k, v in WANG.__dict__.items() if not k.startswith("max_")}
    some = S.extract_wang(broken.filter(k < 4), WANG)
    some = some.union(S.extract_wang(broken.filter(k == 4), SmallWang(**limits, max_input_samples=20)))
    some = some.union(S.extract_wang(broken.filter(k == 5), SmallWang(**limits, max_hashes=1)))
    return some.filter("error IS NOT NULL").select("recording_id", F.col("error.code").alias("code"), "hash")


def _long_blocks(spark, sf_dir):
    """Blocks of uneven length against the segments; of ten recordings one lacks a block (3) and one has another rate (4)."""
    b = long.blocks_of(G.long_recordings(spark, sf_dir), 217)
    k = F.col("recording_id") % 10
    return b.filter((k != 3) | (F.col("at") != 217)).withColumn("sample_rate", F.when(k == 4, 16000).otherwise(F.col("sample_rate")))


@query
def extract_wang_long(spark, sf_dir):
    return long.extract_wang(_long_blocks(spark, sf_dir), WANG, 3).select("recording_id", "hash", "t_anchor", "error.code")


@query
def extract_panako_long(spark, sf_dir):
    return long.extract_panako(_long_blocks(spark, sf_dir), PANAKO, 5).select("recording_id", "hash", "t_anchor", "t_b", "t_c", "error.code")


@query
def extract_haitsma_long(spark, sf_dir):
    return long.extract_haitsma(_long_blocks(spark, sf_dir), HAITSMA, 1).select("recording_id", "pos", "frame", "error.code")


@query
def extract_sql(spark, sf_dir):
    """Extraction called from SQL, as a table function whose columns follow from its argument."""
    tables.register(spark, {"wang": WANG, "panako": PANAKO})
    r = G.recordings(spark, sf_dir)
    call = "SELECT r.recording_id, f.* FROM {r} r, LATERAL extract_fingerprint(r.samples, r.sample_rate, '%s') f"
    wang, panako = (spark.sql(call % k, r=r) for k in ("wang", "panako"))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("t_b", "t_c")]
    return wang.select("recording_id", F.lit("wang").alias("algorithm"), "hash", "t_anchor", *none, "error").union(panako.select("recording_id", F.lit("panako"), "hash", "t_anchor", "t_b", "t_c", "error"))


@query
def extract_progress(spark, sf_dir):
    """Hashes of each recording, and what a callback was told while they were extracted."""
    told: list[float] = []
    got = with_progress(spark, lambda: shared.written(S.extract_wang(G.recordings(spark, sf_dir), WANG), "progress"), told.append, 0.05)
    rising = all(a < b for a, b in zip(told, told[1:]))
    return got.filter("error IS NULL").groupBy("recording_id").agg(F.count("hash").alias("hashes")).select("recording_id", "hashes", F.lit(told[0]).alias("first"), F.lit(told[-1]).alias("last"), F.lit(rising).alias("rising"))


# --- streams -------------------------------------------------------------------------------------------------

CHUNK = 37


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, seq, samples, eos: the recordings in chunks, every fifth of which comes twice."""
    r = G.recordings(spark, sf_dir).select(F.col("recording_id").alias("stream_id"), F.transform("samples", lambda v: v.cast("float")).alias("x"))
    last = F.floor((F.size("x") - 1) / CHUNK).cast("bigint")
    cut = r.select("stream_id", "x", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("seq"))
    cut = cut.select("stream_id", "seq", F.slice("x", (F.col("seq") * CHUNK + 1).cast("int"), CHUNK).alias("samples"), (F.col("seq") == F.col("last")).alias("eos"))
    return cut.union(cut.filter("seq % 5 = 0"))


def streamed(spark: SparkSession, sf_dir: str, transform: Callable[[DataFrame], DataFrame], name: str, files: int = 2, tables: list[DataFrame] | None = None, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Result of a streaming query over the chunks, or the given ``tables`` of chunks one after the other, each of which lies in four
    files in no order; so many make a batch. With ``each`` a callback gets every batch and says what is kept of it."""
    base = shared.new_path(spark, name)
    for some in tables or [chunks(spark, sf_dir)]:
        some.repartition(4, "seq").write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(some.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    out = transform(source)
    for k, v in wanted.items():
        spark.conf.set(k, v)
    # a batch that is delivered again after a failure overwrites what its callback kept of it
    deliver = lambda df, batch: each(df).write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
    sink = out.writeStream.foreachBatch(deliver) if each else out.writeStream.format("parquet").option("path", f"{base}/out")
    try:  # a query takes the options it starts with
        running = sink.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    running.awaitTermination()
    return spark.read.parquet(f"{base}/out") if each else spark.read.schema(out.schema).parquet(f"{base}/out")


MANY = 1 << 30  # chunks that may wait: none is missing, only late


@query
def stream_wang(spark, sf_dir):
    return streamed(spark, sf_dir, lambda c: E.stream_hashes(c, WANG, MANY), "wang").select("stream_id", "t_ms", "hash", "t_anchor", "error")


@query
def stream_callbacks(spark, sf_dir):
    """Hashes delivered to a callback, batch by batch, which keeps their number."""
    count = lambda df: df.filter("error IS NULL").groupBy("stream_id").agg(F.count("hash").alias("hashes"))
    got = streamed(spark, sf_dir, lambda c: E.stream_hashes(c, WANG, MANY), "callbacks", each=count)
    return got.groupBy("stream_id").agg(F.sum("hashes").alias("hashes"))


@query
def stream_panako(spark, sf_dir):
    return streamed(spark, sf_dir, lambda c: E.stream_hashes(c, PANAKO, MANY), "panako").drop("t_ms")


DENSE_PANAKO = SmallPanako(fan_out=1, target_zone_t=21, target_zone_f=7, peaks_per_sec=0, min_anchor_mag_db=0.0)


@query
def stream_target_cap(spark, sf_dir):
    """All peaks of a dense stream count, and an anchor keeps its strongest 2 * fan_out targets."""
    return streamed(spark, sf_dir, lambda c: E.stream_hashes(c, DENSE_PANAKO, MANY), "dense").select("stream_id", "hash", "t_anchor", "t_b", "t_c", "error")


@query
def stream_haitsma(spark, sf_dir):
    return streamed(spark, sf_dir, lambda c: E.stream_hashes(c, HAITSMA, MANY), "haitsma").select("stream_id", F.col("t_anchor").alias("pos"), F.col("hash").alias("frame"), "t_ms", "error")


@query
def stream_gap(spark, sf_dir):
    """A chunk that never comes is told once more than ``max_gap`` later ones wait."""
    gone = lambda c: E.stream_hashes(c.filter("stream_id % 10 <> 3 OR seq <> 1"), WANG, 0)
    return streamed(spark, sf_dir, gone, "gap", 4).filter("error IS NOT NULL").select("stream_id", "error", "hash")


def _timed_chunks(spark, sf_dir):
    """Chunks with a time each, a second apart; of ten streams one has no end mark (6) and one lacks its second chunk (3)."""
    some = chunks(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    k = F.col("stream_id") % 10
    return some.filter((k != 3) | (F.col("seq") != 1)).withColumn("eos", F.col("eos") & (k != 6))


@query
def stream_by_time(spark, sf_dir):
    """Streams that fall silent are flushed, and gaps told, when the watermark has left them behind: here by a chunk of a later
    stream."""
    run = lambda c: E.stream_hashes(c.withWatermark("at", "1 hour"), WANG, MANY, 60_000, "at")
    some = _timed_chunks(spark, sf_dir)
    later = spark.createDataFrame([("later", 0, [0.0], False)], "stream_id string, seq long, samples array<float>, eos boolean").withColumn("at", F.timestamp_seconds(F.lit(1_800_000_000)))
    return streamed(spark, sf_dir, run, "time", 4, [some, later]).select("stream_id", "hash", "t_anchor", "error")


def argmax_or_fail(batch: np.ndarray) -> np.ndarray:
    """``strongest_mel``, but for windows whose first band starts low."""
    if batch[0, 0, 0] < 3:
        raise ArithmeticError("too low")
    return strongest_mel(batch)


@query
def stream_failures(spark, sf_dir):
    """Windows on which the model fails are rows with an error; the streams go on."""
    got = streamed(spark, sf_dir, lambda c: E.stream_embeddings(c, EMBEDDER, argmax_or_fail, MANY), "failures")
    return got.select("stream_id", "t_ms", "error", F.aggregate("vector", F.lit(0).cast("bigint"), lambda s, v: s * 7 + v.cast("bigint")).alias("digest"))


@query
def stream_reset(spark, sf_dir):
    """Every stream starts over with its second chunk."""
    reset = lambda c: E.stream_hashes(c.withColumn("reset", F.col("seq") == 1), HAITSMA, MANY)
    return streamed(spark, sf_dir, reset, "reset").select("stream_id", F.col("t_anchor").alias("pos"), F.col("hash").alias("frame"), "error")


def _vectors(df: DataFrame, key: str) -> DataFrame:
    v = df.select(key, "t_ms", F.posexplode("vector").alias("frame", "band"))
    return v.select(key, "t_ms", F.col("frame").cast("bigint").alias("frame"), F.col("band").cast("bigint").alias("band"))


@query
def neural_embed(spark, sf_dir):
    return _vectors(N.embed(G.recordings(spark, sf_dir), EMBEDDER, strongest_mel), "recording_id")


def label_network(spark, sf_dir) -> N.DenseNetwork:
    """Two layers of weights from the means of all vectors of a label: a hidden unit for each label, and four outputs."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("label IS NOT NULL")
    means = e.groupBy("label").agg(F.array([50 * F.avg(F.get("embedding", F.lit(k)).cast("double")) for k in range(11)]).alias("m"))
    hidden = means.select(F.lit(0).alias("layer"), F.col("label").cast("long").alias("unit"), F.slice("m", 1, 6).alias("weights"), F.get("m", F.lit(6)).alias("bias"))
    columns = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("label", "m"))), lambda x: x.m).alias("m")).select("m", F.explode(F.array([F.lit(u) for u in range(4)])).alias("u"))
    outputs = columns.select(F.lit(1), F.col("u").cast("long"), F.transform("m", lambda x: F.get(x, F.col("u") + 7)), F.col("u").cast("double"))
    return N.network(hidden.union(outputs), digits=2)


@query
def neural_network(spark, sf_dir):
    got = N.embed(G.recordings(spark, sf_dir), EMBEDDER, label_network(spark, sf_dir))
    v = got.select("recording_id", "t_ms", F.posexplode("vector").alias("unit", "v"))
    return v.select("recording_id", "t_ms", F.col("unit").cast("bigint").alias("unit"), (F.round(F.col("v").cast("double"), 2) + 0.0).alias("v"))


@query
def stream_embeddings(spark, sf_dir):
    return _vectors(streamed(spark, sf_dir, lambda c: E.stream_embeddings(c, EMBEDDER, strongest_mel, MANY), "embeddings"), "stream_id")


def loud_and_signs(x: np.ndarray) -> list[np.ndarray]:
    """A model without weights: which samples are above 40, and the first eight less 30."""
    return [(x > 40).astype(np.float32), x.ravel()[:8] - 30]


@query
def watermarks(spark, sf_dir):
    got = N.detect_watermarks(G.recordings(spark, sf_dir), Watermark(message_bits=8, threshold=0.42, sample_rate=8000), loud_and_signs)
    return got.select("recording_id", "detected", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), "message", F.size("localization").cast("bigint").alias("n"))


# --- files and blobs -----------------------------------------------------------------------------------------


def _wav(x: np.ndarray, channels: int) -> bytes:
    """16-bit WAV file of whole-number samples; the second channel is the first one's negative half."""
    pcm = np.column_stack([x, -(x // 2)]).astype("<i2").tobytes()
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", len(pcm))
    return b"RIFF" + struct.pack("<I", len(head) + len(pcm)) + head + pcm


def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content; of ten files one has no channels (1) and one is no audio (2)."""

    def run(batches):
        for b in batches:
            rows = [(i.as_py(), b"no audio" if i.as_py()[-1] == "2" else _wav(np.floor(s.values.to_numpy(zero_copy_only=False)).astype(np.int64), 0 if i.as_py()[-1] == "1" else 2)) for i, s in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "content"])

    return G.recordings(spark, sf_dir).select("recording_id", "samples").mapInArrow(run, "path string, content binary")


@query
def decode_mono(spark, sf_dir):
    got = audio.decode(wav_files(spark, sf_dir)).filter("error IS NULL").select("recording_id", "sample_rate", F.posexplode("samples").alias("t", "v"))
    return got.select("recording_id", "sample_rate", F.col("t").cast("bigint").alias("t"), F.col("v").cast("double").alias("v"))


def _coded(name: int, x: np.ndarray) -> bytes:
    """One channel of whole numbers as AIFF (0, 5), AIFF-C of the other byte order (1, 6), or as the codes of a WAV file in
    mu-law (2, 7), A-law (3, 8) or IMA ADPCM (4, 9): each 13 of them are a block, a value and its place and 12 bytes."""
    kind = name % 5
    if kind < 2:
        pcm = x.astype("<i2" if kind else ">i2").tobytes()
        common = struct.pack(">HIHHQ", 1, len(x), 16, 16383 + 12, 8000 << 51) + (b"sowt\x00\x00" if kind else b"")
        body = (b"AIFC" if kind else b"AIFF") + b"SSND" + struct.pack(">III", 8 + len(pcm), 0, 0) + pcm + b"COMM" + struct.pack(">I", len(common)) + common
        return b"FORM" + struct.pack(">I", len(body)) + body
    codes = b"".join(int(v).to_bytes(1, "little") if kind < 4 or k % 13 else struct.pack("<hBB", w, w % 100, 0) for k, (v, w) in enumerate(zip(x % 256, x.tolist(), strict=True)))
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, {2: 7, 3: 6, 4: 0x11}[kind], 1, 8000, 8000, 16 if kind == 4 else 1, 4 if kind == 4 else 8) + b"data" + struct.pack("<I", len(codes))
    return b"RIFF" + struct.pack("<I", len(head) + len(codes)) + head + codes


@query
def decode_formats(spark, sf_dir):
    """Files of other sample formats. Blocks of ADPCM that name no step are skipped; in integrity mode (9) they are errors."""

    def run(batches):
        for b in batches:
            files = [_coded(int(i.as_py()[-1]), np.floor(s.values.to_numpy(zero_copy_only=False)).astype(np.int64)) for i, s in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], names=["path", "content"])

    files = G.recordings(spark, sf_dir).select("recording_id", "samples").mapInArrow(run, "path string, content binary")
    got = audio.decode(files.filter("path % 10 <> 9")).union(audio.decode(files.filter("path % 10 = 9"), limits=DecodeLimits(integrity_mode=True)))
    got = got.select("recording_id", "sample_rate", F.posexplode_outer("samples").alias("t", "v"), "error.code")
    return got.select("recording_id", "sample_rate", F.col("t").cast("bigint").alias("t"), F.col("v").cast("double").alias("v"), "code")


@query
def decode_resampled(spark, sf_dir):
    """Decoding at another rate; of ten files one (8) has a limit that its own samples keep to and the resampled ones don't."""
    files = wav_files(spark, sf_dir).filter("path % 10 NOT IN (1, 2)")
    some = audio.decode(files.filter("path % 10 <> 8"), 5000).union(audio.decode(files.filter("path % 10 = 8"), 16000, DecodeLimits(max_samples=150)))
    got = some.select("recording_id", F.posexplode_outer("samples").alias("k", "v"), "error.code")
    return got.select("recording_id", F.col("k").cast("bigint").alias("k"), F.round(F.col("v").cast("double"), 8).alias("v"), "code")


@query
def decode_limited(spark, sf_dir):
    """Files over the limit of bytes are told by their length; their content isn't read."""
    base = shared.new_path(spark, "audio")

    def save(batches):
        where, path = store._open(base)
        where.create_dir(path)
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with where.open_output_stream(f"{path}/{name}.wav") as f:  # the same bytes if a task is run again
                    f.write(content)
            yield b.select(["path"])

    wav_files(spark, sf_dir).mapInArrow(save, "path string").count()
    got = audio.read_audio(spark, base, limits=DecodeLimits(max_bytes=400), pattern="*.wav")
    return got.select(F.regexp_extract("recording_id", r"(\d+)\.wav$", 1).alias("recording_id"), F.size("samples").cast("bigint").alias("n"), "error.code")


@query
def decode_errors(spark, sf_dir):
    files = wav_files(spark, sf_dir)
    some = audio.decode(files.filter("path % 10 < 5")).union(audio.decode(files.filter("path % 10 >= 5"), limits=DecodeLimits(max_samples=10)))
    return some.filter("error IS NOT NULL").select("recording_id", F.col("error.code").alias("code"))


def hash_blobs(spark, sf_dir):
    return blobs.write_blobs(G.hash_stream(spark, sf_dir).select(F.col("ref_id").alias("recording_id"), "hash", F.col("t").alias("t_anchor")), "wang-v1", 62.5)


@query
def blob_round_trip(spark, sf_dir):
    return blobs.read_blobs(hash_blobs(spark, sf_dir), "wang-v1").select("recording_id", "hash", "t_anchor", F.col("fps").cast("double").alias("fps"), "error")


@query
def canonical_order(spark, sf_dir):
    """Places of hashes in their blobs: by anchor, then by hash, however the table was dealt."""
    rows = blobs.read_blobs(hash_blobs(spark, sf_dir), "wang-v1").withColumn("at", F.monotonically_increasing_id())
    return rows.select("recording_id", "hash", "t_anchor", (F.row_number().over(Window.partitionBy("recording_id").orderBy("at")) - 1).cast("bigint").alias("place"))


@query
def option_bounds(spark, sf_dir):
    """What becomes of options out of bounds, which each supplier has some of: moved to a bound, or refused."""

    def run(batches):
        def accepted(make) -> bool:
            try:
                make()
            except ConfigError:
                return False
            return True

        for b in batches:
            rows = []
            for k in b.column(0).to_pylist():
                w = Wang(fan_out=k * 7 % 100, target_zone_t=k * 37 % 700, target_zone_f=k * 41 % 700, peaks_per_sec=k * 53 % 900, min_anchor_mag_db=float(k * 13 % 400 - 300), max_hashes=k % 3)
                stft = accepted(lambda: Stft(k % 40, k % 23))
                embedder = accepted(lambda: Embedder(sample_rate=1000, n_fft=64, hop=16, n_mels=k % 5 * 3000, window_secs=k % 7 / 50, hop_secs=k % 4 / 40))
                rows.append((k, w.fan_out, w.target_zone_t, w.target_zone_f, w.peaks_per_sec, w.min_anchor_mag_db, w.max_hashes, stft, embedder))
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.bool_(), pa.bool_()]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["s_suppkey", "fan_out", "zone_t", "zone_f", "peaks", "mag", "most", "stft", "embedder"])

    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    return s.mapInArrow(run, "s_suppkey bigint, fan_out bigint, zone_t bigint, zone_f bigint, peaks bigint, mag double, most bigint, stft boolean, embedder boolean")


@query
def blob_peek(spark, sf_dir):
    cut = F.when(F.col("recording_id") % 10 == 7, F.substring("blob", 1, 10)).otherwise(F.col("blob"))
    p = blobs.peek(hash_blobs(spark, sf_dir).withColumn("blob", cut))
    return p.select("recording_id", "algorithm", F.col("sample_rate").cast("bigint").alias("sample_rate"), "hash_count", F.col("frames_per_sec").cast("double").alias("frames_per_sec"), "error")


@query
def blob_store(spark, sf_dir):
    """Fingerprints of three kinds written to a store and read by what their headers say."""
    store.register(spark)
    path = shared.new_path(spark, "store")
    pairs = G.hash_stream(spark, sf_dir).select(F.col("ref_id").alias("recording_id"), "hash", F.col("t").alias("t_anchor"))
    codes = G.frame_codes(spark, sf_dir).select(F.col("ref_id").alias("recording_id"), "pos", "frame")
    triples = G.with_spans(G.hash_stream(spark, sf_dir)).select(F.col("ref_id").alias("recording_id"), "hash", F.col("t").alias("t_anchor"), (F.col("t") + 1).alias("t_b"), "t_c")
    for df, algorithm, fps in ((pairs, "wang-v1", 62.5), (triples, "panako-v2", 62.5), (codes, "haitsma-v1", 78.125)):
        blobs.write_blobs(df, algorithm, fps).write.format(store.NAME).mode("append").save(path)
    some = store.read(spark, path, "hash_count > 52 AND frames_per_sec > 60").filter("algorithm <> 'wang-v1' OR t_anchor < 30")
    return some.select("recording_id", "algorithm", "hash_count", "frames_per_sec", "hash", "t_anchor", "t_b", "t_c", "error")


# --- extension points ----------------------------------------------------------------------------------------


class Loud(X.Fingerprinter):
    """Places of samples above 100."""

    name, sample_rate, fields = "loud", 8000, ("at",)

    def extract(self, samples):
        return [np.nonzero(samples > 100)[0]]


class LoudStream(X.StreamingFingerprinter):
    def __init__(self):
        self.n = 0

    def push(self, samples):
        at = np.nonzero(samples > 100)[0] + self.n
        self.n += len(samples)
        return [(None, None, int(i), None, None) for i in at]

    def flush(self):
        return []


class SharedHashes(X.Matcher):
    """Votes are the different hashes that a query and a reference share."""

    gives = ("is_match", "votes")

    def prepare(self, rows):
        return np.unique(rows["hash"].to_numpy())

    def match_one(self, query, reference):
        n = len(np.intersect1d(query, reference, assume_unique=True))
        return {"is_match": n > 30, "votes": n}

    def match_many(self, queries, references):
        sides = [(np.repeat(np.arange(len(s)), [len(h) for h in s]), np.concatenate(s)) for s in (queries, references)]
        n = shared_counts(*sides[0], *sides[1], len(queries), len(references)).ravel()
        return {"is_match": n > 30, "votes": n}


@query
def own_fingerprinter(spark, sf_dir):
    return Loud().apply(G.recordings(spark, sf_dir)).select("recording_id", "at", "error.code")


@query
def own_stream(spark, sf_dir):
    return streamed(spark, sf_dir, lambda c: E.stream_hashes(c, LoudStream, MANY), "own").select("stream_id", F.col("t_anchor").alias("at"), "error")


@query
def own_matcher(spark, sf_dir):
    q, r = G.stated(G.hash_queries(spark, sf_dir)), G.hash_stream(spark, sf_dir)
    return SharedHashes().apply_all(q.select("query_id", "hash"), r.select("ref_id", "hash")).select("query_id", "ref_id", "is_match", "votes")


# --- oracles -------------------------------------------------------------------------------------------------


def _exact(sql: str) -> str:
    """The landmark SQL on single-precision samples, with unrounded magnitudes and a floor of 0 dB."""
    sql = sql.replace("value AS v FROM tracks", "value::FLOAT::DOUBLE AS v FROM tracks")
    return sql.replace("round(10 * log10(greatest(v, 1e-12::DOUBLE)), 3)", "10 * log10(greatest(v, 1e-12::DOUBLE))").replace("v > 20", "v > 0")


def _wang(key: str, more: str) -> str:
    return f"WITH {_exact(O.PAIRS)} SELECT recording_id AS {key}, {O.WHASH} AS hash, ta AS t_anchor, {more} FROM pr"


def _panako(key: str, error: str) -> str:
    return f"WITH {_exact(O.TRIPLES)} SELECT recording_id AS {key}, {O.PHASH} AS hash, ta AS t_anchor, tb AS t_b, tc AS t_c, NULL::VARCHAR AS {error} FROM tr"


_HAITSMA = (
    _exact(O.SAMPLES)
    + """, win AS (SELECT k, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / 64) AS w FROM range(64) g(k)),
edge AS (SELECT b, 300 * power(2000 / 300::DOUBLE, b / 33::DOUBLE) AS lo, 300 * power(2000 / 300::DOUBLE, (b + 1) / 33::DOUBLE) AS hi FROM range(33) g(b)),
bin AS (SELECT f, b FROM range(33) g(f) JOIN edge ON f * 125 >= lo AND f * 125 < hi),
fr AS (SELECT n.track, i AS t FROM n, range(0, CASE WHEN n.n < 64 THEN 0 ELSE 1 + (n.n - 64) // 16 END) g(i)),
dft AS (SELECT fr.track, fr.t, f, b, sum(v * w * cos(2 * pi() * f * k / 64)) AS re, sum(v * w * sin(2 * pi() * f * k / 64)) AS im
        FROM fr JOIN win ON TRUE JOIN x ON x.track = fr.track AND x.t = fr.t * 16 + k JOIN bin ON TRUE GROUP BY ALL),
be AS (SELECT fr.track, fr.t, edge.b, coalesce(sum(re * re + im * im), 0) AS e FROM fr JOIN edge ON TRUE LEFT JOIN dft ON dft.track = fr.track AND dft.t = fr.t AND dft.b = edge.b GROUP BY ALL),
df AS (SELECT a.track, a.t, a.b, a.e - c.e AS d FROM be a JOIN be c ON a.track = c.track AND a.t = c.t AND c.b = a.b + 1),
pv AS (SELECT *, lag(d) OVER (PARTITION BY track, b ORDER BY t) AS p FROM df),
codes AS (SELECT track::VARCHAR AS id, t - 1 AS pos, sum(CASE WHEN d - p > 0 THEN 1::BIGINT << (31 - b) ELSE 0 END)::BIGINT AS frame FROM pv WHERE p IS NOT NULL GROUP BY ALL)"""
)
_CENTERED = (
    O.SAMPLES
    + """, win AS (SELECT k, 0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * k / 16) AS w FROM range(16) g(k)),
fr AS (SELECT n.track, n.n, i AS t FROM n, range(0, 1 + n.n // 4) g(i)),
pts AS (SELECT track, t, k, w, CASE WHEN abs(t * 4 + k - 8) > n - 1 THEN 2 * (n - 1) - abs(t * 4 + k - 8) ELSE abs(t * 4 + k - 8) END AS i FROM fr, win),
dft AS (SELECT pts.track, pts.t, f, sum(v * w * cos(2 * pi() * f * k / 16)) AS re, sum(v * w * sin(2 * pi() * f * k / 16)) AS im FROM pts JOIN x ON x.track = pts.track AND x.t = i JOIN range(9) g(f) ON TRUE GROUP BY ALL)"""
)
_MEL_BANDS = (
    f"{_exact(O.DFT)}, {O._mel_table('slaney')}, lm AS (SELECT recording_id, t, mel, sum(v * weight) AS v FROM p JOIN w USING (f) GROUP BY ALL), "
    "top AS (SELECT recording_id, t, arg_max(mel, v) AS band, max(log10(v + 1e-10::DOUBLE)) FILTER (mel = 0) AS low FROM lm GROUP BY ALL), starts AS (SELECT track::VARCHAR AS recording_id, i FROM n, range(0, CASE WHEN n < 64 THEN 0 ELSE 1 + (n - 64) // 32 END) g(i))"
)
_MEL = (
    f"WITH {_MEL_BANDS} "
    "SELECT recording_id AS {key}, i * 4 AS t_ms, t - i * 4 AS frame, band FROM starts JOIN top USING (recording_id) WHERE t BETWEEN i * 4 AND i * 4 + 6"
)

_LONG = "tracks AS (SELECT l_suppkey // 10 AS track, row_number() OVER (PARTITION BY l_suppkey // 10 ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS t, 0 AS a, l_extendedprice AS value FROM lineitem)"


def _long(sql: str, columns: str) -> str:
    """The SQL of a single pass over the long recordings, with the two that fail."""
    nulls = ", ".join(f"NULL AS {c}" for c in columns.split())
    return f"SELECT * FROM ({sql.replace(O.TRACKS, _LONG)}) WHERE recording_id::BIGINT % 10 NOT IN (3, 4) UNION ALL SELECT DISTINCT (l_suppkey // 10)::VARCHAR, {nulls}, CASE WHEN l_suppkey // 10 % 10 = 3 THEN 'Io' ELSE 'UnsupportedSampleRate' END FROM lineitem WHERE l_suppkey // 10 % 10 IN (3, 4)"


_CUT = (
    O.TRACKS.replace("tracks AS (", "uncut AS (", 1)
    + ", tracks AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY t) - 1 AS t, a, value FROM uncut WHERE track % 10 <> 3 OR t // 37 <> 1)"
)
# every stream as two: its first chunk, and the rest
_RESET = (
    f"WITH {_HAITSMA} SELECT id[2:] AS stream_id, pos, frame, NULL::VARCHAR AS error FROM codes".replace(
        O.TRACKS, O.TRACKS.replace("tracks AS (", "uncut AS (", 1) + ", tracks AS (SELECT (CASE WHEN t < 37 THEN 'a' ELSE 'b' END) || track AS track, CASE WHEN t < 37 THEN t ELSE t - 37 END AS t, a, value FROM uncut)"
    )
)


_DECODED = f"WITH {O.RESAMPLE}".replace("v::FLOAT::DOUBLE * h", "(floor(v) - floor(floor(v) / 2)) / 65536::DOUBLE * h").replace(", 4) + 0", ", 8) + 0")
# to 16 000 Hz, for the streams that stay within the limit
_UPSAMPLED = (
    f"SELECT recording_id, k, v, NULL::VARCHAR AS code FROM ({_DECODED}) WHERE recording_id::BIGINT % 10 = 8 AND (SELECT count(*) FROM tracks WHERE track = recording_id::BIGINT) * 2 <= 150".replace("(8000 / 5000::DOUBLE)", "0.5::DOUBLE").replace("(n * 5000 + 7999) // 8000", "n * 2").replace("0.625::DOUBLE * place", "place")
    + " UNION ALL SELECT track::VARCHAR, NULL, NULL, 'InputTooLarge' FROM tracks WHERE track % 10 = 8 GROUP BY track HAVING count(*) * 2 > 150"
)


_FORMATS = f"""WITH RECURSIVE {O.TRACKS},
whole AS (SELECT track, t, floor(value)::BIGINT AS w, floor(value)::BIGINT & 255 AS c, 255 - (floor(value)::BIGINT & 255) AS u, xor(floor(value)::BIGINT & 255, 85) AS a FROM tracks),
plain AS (SELECT track, t, CASE WHEN track % 5 < 2 THEN w
    WHEN track % 5 = 2 THEN (CASE WHEN u & 128 > 0 THEN -1 ELSE 1 END) * (((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132)
    ELSE (CASE WHEN a & 128 > 0 THEN 1 ELSE -1 END) * (CASE WHEN a & 112 = 0 THEN ((a & 15) << 4) + 8 ELSE (((a & 15) << 4) + 264) << ((a >> 4 & 7) - 1) END) END / 32768::DOUBLE AS v
  FROM whole WHERE track % 5 <> 4),
blocks AS (SELECT track, t // 13 AS b, arg_min(w, t) AS w, arg_min(w, t) % 100 AS place, count(*) - 1 AS n FROM whole WHERE track % 5 = 4 GROUP BY ALL),
bad AS (SELECT track FROM blocks WHERE track % 10 = 9 GROUP BY track HAVING max(place) > 88 OR max(n % 4) > 0),
codes AS (SELECT x.track, b, 2 * (t % 13 - 1) + h AS s, c >> (4 * h) & 15 AS code FROM whole x JOIN blocks ON x.track = blocks.track AND t // 13 = b, range(2) g(h) WHERE t % 13 BETWEEN 1 AND n // 4 * 4),
ima AS (SELECT track, b, 0::BIGINT AS s, w, place FROM blocks WHERE place <= 88 AND track NOT IN (FROM bad)
  UNION ALL SELECT track, b, s + 1, greatest(-32768, least(32767, w + (CASE WHEN code & 8 > 0 THEN -1 ELSE 1 END) * ((step >> 3) + (code & 1) * (step >> 2) + (code >> 1 & 1) * (step >> 1) + (code >> 2 & 1) * step))),
    greatest(0, least(88, place + {list(IMA_MOVES)}[(code & 7) + 1]))
  FROM (SELECT ima.*, code, {list(IMA_STEPS)}[place + 1] AS step FROM ima JOIN codes USING (track, b, s)))
SELECT track::VARCHAR AS recording_id, 8000::INTEGER AS sample_rate, t, v, NULL::VARCHAR AS code FROM plain
UNION ALL SELECT track::VARCHAR, 8000, row_number() OVER (PARTITION BY track ORDER BY b, s) - 1, w / 32768::DOUBLE, NULL FROM ima
UNION ALL SELECT track::VARCHAR, NULL, NULL, NULL, 'Io' FROM bad"""

ORACLES: dict[str, str] = {
    "extract_wang_long": _long(_wang("recording_id", "NULL::VARCHAR AS code"), "hash t_anchor"),
    "extract_panako_long": _long(_panako("recording_id", "code"), "hash t_anchor t_b t_c"),
    "extract_haitsma_long": _long(f"WITH {_HAITSMA} SELECT id AS recording_id, pos, frame, NULL::VARCHAR AS code FROM codes", "pos frame"),
    "stft_centered": f"WITH {_CENTERED} SELECT track::VARCHAR AS recording_id, t, f, round(re * re + im * im, 3) AS v FROM dft",
    "frame_counts": "SELECT s_suppkey, CASE WHEN n < 1024 THEN 0 ELSE 1 + (n - 1024) // 128 END::BIGINT AS inside, CASE WHEN n = 0 THEN 0 ELSE 1 + n // 256 END::BIGINT AS centered FROM (SELECT s_suppkey, s_suppkey * 37 % 3000 AS n FROM supplier)",
    "push_limit": f"WITH {O.TRACKS} SELECT track::VARCHAR AS recording_id, least(count(*), 50)::BIGINT AS n, false AS head_bad, track % 10 < 5 AND count(*) > 60 AS whole_bad FROM tracks GROUP BY track",
    "extract_wang": _wang("recording_id", "NULL::VARCHAR AS code"),
    "extract_panako": _panako("recording_id", "code"),
    "extract_haitsma": f"WITH {_HAITSMA} SELECT id AS recording_id, pos, frame, NULL::VARCHAR AS code FROM codes",
    "extract_errors": f"WITH {_exact(O.PAIRS)} SELECT DISTINCT track::VARCHAR AS recording_id, CASE track % 10 WHEN 0 THEN 'AudioTooShort' WHEN 1 THEN 'AudioTooShort' WHEN 2 THEN 'NonFiniteSample' WHEN 3 THEN 'UnsupportedSampleRate' ELSE 'InputTooLarge' END AS code, NULL::BIGINT AS hash "
    "FROM tracks WHERE track % 10 <= 4 UNION ALL SELECT recording_id, 'InputTooLarge', NULL FROM pr WHERE recording_id::BIGINT % 10 = 5 GROUP BY recording_id HAVING count(*) > 1",
    "stream_wang": _wang("stream_id", "ta AS t_ms, NULL::VARCHAR AS error"),
    "stream_callbacks": f"SELECT stream_id, count(hash) AS hashes FROM ({_wang('stream_id', 'NULL::VARCHAR AS error')}) GROUP BY ALL",
    "stream_panako": _panako("stream_id", "error"),
    "stream_haitsma": f"WITH {_HAITSMA} SELECT id AS stream_id, pos, frame, (pos + 1) * 2 AS t_ms, NULL::VARCHAR AS error FROM codes",
    # a second chunk that is the last one leaves nothing that waits behind it
    "stream_gap": f"WITH {O.TRACKS} SELECT track::VARCHAR AS stream_id, 'chunks 1 to 1 are missing' AS error, NULL::BIGINT AS hash FROM tracks WHERE track % 10 = 3 GROUP BY track HAVING count(*) > 74",
    # without its second chunk, a stream is what is left of it
    "stream_by_time": _wang("stream_id", "NULL::VARCHAR AS error").replace(O.TRACKS, _CUT) + " UNION ALL SELECT track::VARCHAR, NULL, NULL, 'chunks 1 to 1 are missing' FROM (SELECT user_id // 15 * 10 + user_id % 10 AS track FROM events) WHERE track % 10 = 3 GROUP BY track HAVING count(*) > 74",
    "stream_failures": f"WITH {_MEL_BANDS}, spans AS (SELECT recording_id, i * 4 AS t_ms, list(band ORDER BY t) AS bands, arg_min(low, t) AS low FROM starts JOIN top USING (recording_id) WHERE t BETWEEN i * 4 AND i * 4 + 6 GROUP BY ALL) "
    "SELECT recording_id AS stream_id, t_ms, CASE WHEN low < 3 THEN 'Inference: too low' END AS error, CASE WHEN low >= 3 THEN list_reduce([0] || bands, lambda s, v: s * 7 + v)::BIGINT END AS digest FROM spans",
    "stream_reset": _RESET,
    "neural_embed": _MEL.replace("{key}", "recording_id"),
    "neural_network": f"""WITH {_MEL_BANDS}, m AS (SELECT recording_id, i, mel, avg(log10(v + 1e-10::DOUBLE)) AS x FROM starts JOIN lm USING (recording_id) WHERE t BETWEEN i * 4 AND i * 4 + 6 GROUP BY ALL),
        means AS (SELECT label, k, 50 * avg(embedding[k + 1]::DOUBLE) AS w FROM embeddings, range(11) g(k) WHERE label IS NOT NULL GROUP BY ALL),
        hidden AS (SELECT recording_id, i, label, greatest(0, sum(x * means.w) + any_value(b.w)) AS h FROM m JOIN means ON k = mel JOIN (SELECT label, w FROM means WHERE k = 6) b USING (label) GROUP BY ALL)
        SELECT recording_id, i * 4 AS t_ms, k - 7 AS unit, round(sum(h * w) + k - 7, 2) + 0.0::DOUBLE AS v FROM hidden JOIN means USING (label) WHERE k >= 7 GROUP BY recording_id, i, k""",
    "extract_progress": f"SELECT recording_id, count(hash) AS hashes, 0::DOUBLE AS first, 1::DOUBLE AS last, TRUE AS rising FROM ({_wang('recording_id', 'NULL::VARCHAR AS error')}) GROUP BY ALL",
    "stream_embeddings": _MEL.replace("{key}", "stream_id"),
    "watermarks": f"WITH {O.TRACKS}, w AS (SELECT track, avg(CASE WHEN value::FLOAT > 40 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN t < 8 AND value::FLOAT >= 30 THEN 1 << t::INTEGER ELSE 0 END)::BIGINT AS m, count(*) AS n FROM tracks GROUP BY track) "
    "SELECT track::VARCHAR AS recording_id, c::FLOAT > 0.42 AS detected, round(c::FLOAT::DOUBLE, 4) AS confidence, m AS message, n FROM w",
    "decode_mono": f"WITH {O.TRACKS} SELECT track::VARCHAR AS recording_id, 8000::INTEGER AS sample_rate, t, (floor(value) - floor(floor(value) / 2)) / 65536::DOUBLE AS v FROM tracks WHERE track % 10 NOT IN (1, 2)",
    "decode_errors": f"WITH {O.TRACKS} SELECT DISTINCT track::VARCHAR AS recording_id, CASE track % 10 WHEN 1 THEN 'UnsupportedChannels' WHEN 2 THEN 'Io' ELSE 'InputTooLarge' END AS code FROM tracks WHERE track % 10 IN (1, 2) OR track % 10 >= 5",
    "blob_round_trip": f"WITH {O.HASHES} SELECT ref_id::VARCHAR AS recording_id, hash, t AS t_anchor, 62.5::DOUBLE AS fps, NULL::VARCHAR AS error FROM r",
    "frame_power": f"WITH {O.DFT} SELECT recording_id, f, round(v, 3) AS v, NULL::VARCHAR AS code FROM p WHERE t = 0 AND recording_id::BIGINT % 10 <> 7 UNION ALL SELECT DISTINCT track::VARCHAR, NULL, NULL, 'Config' FROM tracks WHERE track % 10 = 7",
    "stream_target_cap": _panako("stream_id", "error").replace("QUALIFY row_number() OVER (PARTITION BY recording_id, floor(t / 10::DOUBLE) ORDER BY mag DESC, t, f) <= 4", "")
    .replace("AND abs(b.f - a.f) < 7)", "AND abs(b.f - a.f) < 7 QUALIFY row_number() OVER (PARTITION BY a.recording_id, a.t, a.f ORDER BY b.mag DESC, b.t, b.f) <= 2)").replace("x.tb, x.fb, y.tb, y.fb) <= 3", "x.tb, x.fb, y.tb, y.fb) <= 1"),
    "decode_resampled": f"WITH {O.TRACKS} SELECT recording_id, k, v, NULL::VARCHAR AS code FROM ({_DECODED}) WHERE recording_id::BIGINT % 10 NOT IN (1, 2, 8) UNION ALL {_UPSAMPLED}",
    "decode_formats": _FORMATS,
    "decode_limited": f"WITH {O.TRACKS}, n AS (SELECT track, count(*) AS n FROM tracks GROUP BY track) SELECT track::VARCHAR AS recording_id, CASE WHEN track % 10 NOT IN (1, 2) AND 44 + 4 * n <= 400 THEN n END AS n, "
    "CASE WHEN track % 10 = 2 THEN 'Io' WHEN 44 + 4 * n > 400 THEN 'InputTooLarge' WHEN track % 10 = 1 THEN 'UnsupportedChannels' END AS code FROM n",
    "canonical_order": f"WITH {O.HASHES} SELECT ref_id::VARCHAR AS recording_id, hash, t AS t_anchor, row_number() OVER (PARTITION BY ref_id ORDER BY t, hash) - 1 AS place FROM r",
    "option_bounds": "SELECT k AS s_suppkey, greatest(1, least(64, k * 7 % 100)) AS fan_out, greatest(1, least(512, k * 37 % 700)) AS zone_t, greatest(1, least(512, k * 41 % 700)) AS zone_f, least(500, k * 53 % 900) AS peaks, "
    "greatest(-200, least(0, k * 13 % 400 - 300))::DOUBLE AS mag, greatest(1, k % 3) AS most, bit_count(k % 40) = 1 AND k % 23 BETWEEN 1 AND k % 40 AS stft, "
    "k % 5 IN (1, 2) AND k % 7 * 20 >= 64 AND k % 4 > 0 AND k % 4 * 25 <= k % 7 * 20 AS embedder FROM (SELECT s_suppkey AS k FROM supplier)",
    "blob_store": f"WITH {O.HASHES}, {O.CODES}, stored AS (SELECT ref_id, 'wang-v1' AS algorithm, 62.5::DOUBLE AS fps, hash, t AS t_anchor, NULL AS t_b, NULL AS t_c FROM r UNION ALL SELECT ref_id, 'panako-v2', 62.5, hash, t, t + 1, t + 2 + hash % 4 FROM r "
    "UNION ALL SELECT ref_id, 'haitsma-v1', 78.125, frame, pos, NULL, NULL FROM codes), counted AS (SELECT *, count(*) OVER (PARTITION BY ref_id, algorithm) AS hash_count FROM stored) "
    "SELECT ref_id::VARCHAR AS recording_id, algorithm, hash_count, fps AS frames_per_sec, hash, t_anchor, t_b, t_c, NULL::VARCHAR AS error FROM counted WHERE hash_count > 52 AND (algorithm <> 'wang-v1' OR t_anchor < 30)",
    "multiset_equality": f"WITH {_exact(O.PAIRS)} SELECT 0::BIGINT AS missing, 0::BIGINT AS extra, count(*) AS rows FROM pr",
    "extract_sql": f"SELECT recording_id, 'wang' AS algorithm, hash, t_anchor, NULL::BIGINT AS t_b, NULL::BIGINT AS t_c, error FROM ({_wang('recording_id', 'NULL::VARCHAR AS error')}) UNION ALL SELECT recording_id, 'panako', hash, t_anchor, t_b, t_c, error FROM ({_panako('recording_id', 'error')})",
    "blob_peek": f"WITH {O.HASHES} SELECT ref_id::VARCHAR AS recording_id, CASE WHEN ref_id % 10 <> 7 THEN 'wang-v1' END AS algorithm, CASE WHEN ref_id % 10 <> 7 THEN 8000 END::BIGINT AS sample_rate, CASE WHEN ref_id % 10 <> 7 THEN count(*) END AS hash_count, "
    "CASE WHEN ref_id % 10 <> 7 THEN 62.5 END::DOUBLE AS frames_per_sec, CASE WHEN ref_id % 10 = 7 THEN 'short' END AS error FROM r GROUP BY ref_id",
    "own_fingerprinter": f"WITH {O.TRACKS} SELECT track::VARCHAR AS recording_id, t AS at, NULL::VARCHAR AS code FROM tracks WHERE value::FLOAT > 100",
    "own_stream": f"WITH {O.TRACKS} SELECT track::VARCHAR AS stream_id, t AS at, NULL::VARCHAR AS error FROM tracks WHERE value::FLOAT > 100",
    "own_matcher": f"WITH {O.HASHES}, s AS (SELECT query_id, ref_id, count(DISTINCT hash) AS n FROM q JOIN r USING (hash) GROUP BY ALL) "
    "SELECT a.query_id::VARCHAR AS query_id, b.ref_id::VARCHAR AS ref_id, coalesce(n, 0) > 30 AS is_match, coalesce(n, 0) AS votes FROM (SELECT DISTINCT query_id FROM q WHERE query_id % 5 = 0) a CROSS JOIN (SELECT DISTINCT ref_id FROM r) b LEFT JOIN s USING (query_id, ref_id)",
}

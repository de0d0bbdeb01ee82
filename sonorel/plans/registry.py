"""All registered queries of the engine's own operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorel.configs import HaitsmaMatch, Mel, NeuralMatch, PanakoMatch, Stft, WangMatch
from sonorel.functions import columns as C
from sonorel.functions import kernels as K
from sonorel.operators import landmarks as L
from sonorel.operators import matching as M
from sonorel.operators import spectral as S
from sonorel.plans import frontends
from sonorel.plans.oracles import ORACLES as TABLE_ORACLES
from sonorel.sources import blobs, index, shared
from sonorel.sources import signals as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(frontends.QUERIES)
ORACLES = TABLE_ORACLES | frontends.ORACLES

SMALL = Stft(16, 8, "hann", center=False)
SMALL_MEL = Mel(n_mels=6, n_fft=16, sample_rate=8000)
SHORT = HaitsmaMatch(min_overlap_frames=16)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _matches(df: DataFrame) -> DataFrame:
    return rounded(df, score=6, prominence=6, time_scale=6)


def _window(kind: str) -> Query:
    """Each supplier's window, of a size of its own."""

    def run(spark, sf_dir):
        n = (F.col("s_suppkey") % 61 + 4).cast("int")
        s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", n.alias("n"))
        s = s.select("s_suppkey", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        return s.select("s_suppkey", F.col("k").cast("bigint").alias("k"), F.round(C.window_value(kind, F.col("k"), F.col("n")), 9).alias("w"))

    return run


for _kind in ("hann", "hamming", "blackman"):
    QUERIES[f"window_{_kind}"] = _window(_kind)


# --- spectra -------------------------------------------------------------------------------------------------


def _power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.power_long(S.power_rows(G.recordings(spark, sf_dir), SMALL))


def _db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _power(spark, sf_dir).withColumn("v", F.round(C.power_to_db(F.col("v")), 3))


@query
def stft_power(spark, sf_dir):
    return rounded(_power(spark, sf_dir), v=3)


@query
def stft_magnitude(spark, sf_dir):
    return _power(spark, sf_dir).withColumn("v", F.round(F.sqrt("v"), 3))


@query
def stft_db(spark, sf_dir):
    return _db(spark, sf_dir)


@query
def resample_linear(spark, sf_dir):
    r = G.recordings(spark, sf_dir).select("recording_id", F.posexplode(C.resample_linear(F.col("samples"), 8000, 5000)).alias("k", "v"))
    return r.select("recording_id", F.col("k").cast("bigint").alias("k"), F.round("v", 6).alias("v"))


@query
def resample_sinc(spark, sf_dir):
    r = S.resampled(G.recordings(spark, sf_dir), 5000)
    return r.select("recording_id", F.posexplode("samples").alias("k", "v")).select("recording_id", F.col("k").cast("bigint").alias("k"), F.round(F.col("v").cast("double"), 4).alias("v"))


def _mel_table(spark: SparkSession, sf_dir: str, scale: str) -> DataFrame:
    """Each supplier's mel filters, for a sample rate of its own."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    o = s.select(F.col("s_suppkey").alias("key"), F.lit(6).alias("n_mels"), F.lit(16).alias("n_fft"), (8000 + 500 * (F.col("s_suppkey") % 17)).alias("sample_rate"))
    return rounded(S.mel_weight_rows(o, scale), weight=9)


@query
def mel_filterbank(spark, sf_dir):
    return _mel_table(spark, sf_dir, "slaney")


@query
def mel_filterbank_htk(spark, sf_dir):
    return _mel_table(spark, sf_dir, "htk")


@query
def log_mel(spark, sf_dir):
    rows = S.log_mel_rows(G.recordings(spark, sf_dir), SMALL, SMALL_MEL)
    return rows.select("recording_id", "t", F.posexplode("mel").alias("mel", "v")).select("recording_id", "t", F.col("mel").cast("bigint").alias("mel"), F.round("v", 6).alias("v"))


# --- peaks and landmarks -------------------------------------------------------------------------------------


def _peaks(spark, sf_dir):
    return L.cap_per_second(L.pick_peaks(_db(spark, sf_dir), 2, 2, 20.0), 4, 10.0)


@query
def rolling_max_2d(spark, sf_dir):
    return L.rolling_max_2d(_db(spark, sf_dir), 2, 2)


@query
def peak_pick(spark, sf_dir):
    return L.pick_peaks(_db(spark, sf_dir), 2, 2, 20.0)


@query
def peak_cap_per_second(spark, sf_dir):
    return _peaks(spark, sf_dir)


@query
def wang_pairs(spark, sf_dir):
    return L.wang_pairs(_peaks(spark, sf_dir), 20, 6, 3).drop("hash")


@query
def wang_hash(spark, sf_dir):
    return L.wang_hashes(_peaks(spark, sf_dir), 20, 6, 3)


@query
def panako_triplets(spark, sf_dir):
    return L.panako_triplets(_peaks(spark, sf_dir), 21, 7, 3).drop("hash")


@query
def panako_hash(spark, sf_dir):
    return L.panako_hashes(_peaks(spark, sf_dir), 21, 7, 3)


def _bands(spark):
    band = K.band_of_bin(200.0, 3900.0, 8000, 16, 4)
    return spark.createDataFrame([(f, int(b)) for f, b in enumerate(band) if b >= 0], "f bigint, band bigint")


@query
def haitsma_bands(spark, sf_dir):
    return rounded(L.haitsma_bands(_power(spark, sf_dir), _bands(spark)), e=3)


@query
def haitsma_frames(spark, sf_dir):
    return L.haitsma_frames(L.haitsma_bands(_power(spark, sf_dir), _bands(spark)), bits=3)


# --- matching ------------------------------------------------------------------------------------------------


def _hashes(spark, sf_dir):
    return G.hash_queries(spark, sf_dir), G.hash_stream(spark, sf_dir)


def _written_hashes(spark, sf_dir):
    """The same, written once, for operators that read them many times: the tracks' windows aren't computed again for each."""
    r = shared.written(G.hash_stream(spark, sf_dir), "hashes")
    return G.hash_clips(r), r


def _triples(spark, sf_dir):
    return tuple(G.with_spans(x) for x in _hashes(spark, sf_dir))


def _codes(spark, sf_dir):
    codes = G.frame_codes(spark, sf_dir)
    return G.code_queries(codes), codes


def _vectors(spark, sf_dir):
    s = G.embedding_sequences(spark, sf_dir)
    return G.embedding_queries(s), s


@query
def stop_hash(spark, sf_dir):
    return M.stop_hashes(G.hash_stream(spark, sf_dir), 100).select("ref_id", "t", "hash")


@query
def wang_votes(spark, sf_dir):
    q, r = _hashes(spark, sf_dir)
    return M.wang_votes(q, M.stop_hashes(r, 100)).groupBy("query_id", "ref_id", "delta").agg(F.count("*").alias("c"))


@query
def wang_match_dense(spark, sf_dir):
    return _matches(M.wang_match_dense(*_written_hashes(spark, sf_dir)))


@query
def wang_index_query(spark, sf_dir):
    return _matches(M.wang_index_query(*_hashes(spark, sf_dir)))


@query
def stored_index_query(spark, sf_dir):
    """The same against a catalogue stored bucketed by hash."""
    q, r = _hashes(spark, sf_dir)
    name = f"catalogue_{uuid.uuid4().hex}"
    index.save_index(r, name, 8, max_postings=WangMatch().max_postings_per_hash)
    return _matches(M.wang_index_query(q, index.load_index(spark, name)))


@query
def match_ranked(spark, sf_dir):
    q, r = _written_hashes(spark, sf_dir)
    q = G.stated(q)
    return _matches(M.match_ranked(M.wang_match_dense(q, r), q, r))


@query
def match_best(spark, sf_dir):
    return _matches(M.match_best(M.wang_index_query(*_hashes(spark, sf_dir))))


@query
def panako_votes(spark, sf_dir):
    q, r = _triples(spark, sf_dir)
    return M.panako_votes(q, M.stop_hashes(r, 100)).groupBy("query_id", "ref_id", "s_bin", "off").agg(F.count("*").alias("c"))


@query
def panako_index_query(spark, sf_dir):
    return _matches(M.panako_index_query(*_triples(spark, sf_dir)))


@query
def panako_match(spark, sf_dir):
    return _matches(M.panako_match(*_triples(spark, sf_dir), PanakoMatch()))


@query
def haitsma_candidates(spark, sf_dir):
    return M.haitsma_candidates(*_codes(spark, sf_dir), SHORT).select("query_id", "ref_id", "delta", "hits", "overlap")


@query
def haitsma_ber(spark, sf_dir):
    q, r = _codes(spark, sf_dir)
    return M.haitsma_ber(M.haitsma_candidates(q, r, SHORT), q, r).select("query_id", "ref_id", "delta", "overlap", "wrong")


@query
def haitsma_probe_flips(spark, sf_dir):
    return M.haitsma_candidates(*_codes(spark, sf_dir), HaitsmaMatch(min_overlap_frames=16, probe_bit_flips=1)).select("query_id", "ref_id", "delta", "hits")


@query
def haitsma_index_query(spark, sf_dir):
    return _matches(M.haitsma_index_query(*_codes(spark, sf_dir), SHORT))


@query
def haitsma_match(spark, sf_dir):
    return _matches(M.haitsma_match(*_codes(spark, sf_dir), SHORT))


@query
def neural_global(spark, sf_dir):
    return _matches(M.neural_global(*_vectors(spark, sf_dir)))


@query
def neural_sliding(spark, sf_dir):
    return _matches(M.neural_sliding(*G.whole_clips(*_vectors(spark, sf_dir))))


@query
def neural_dtw(spark, sf_dir):
    return _matches(M.neural_dtw(*_vectors(spark, sf_dir), NeuralMatch(aggregation="dtw")))


@query
def neural_dtw_matches(spark, sf_dir):
    return _matches(M.neural_dtw_matches(*_vectors(spark, sf_dir), NeuralMatch(aggregation="dtw", min_cosine=0.15)))


# --- scalar functions ----------------------------------------------------------------------------------------


@query
def l2_normalize(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.posexplode(C.l2_normalize(F.col("embedding"))).alias("k", "x")).select("vec_id", F.col("k").cast("bigint").alias("k"), F.round("x", 9).alias("x"))


@query
def centroid(spark, sf_dir):
    c = M.centroids(G.embedding_sequences(spark, sf_dir), "ref_id")
    return c.select("ref_id", F.posexplode("centroid").alias("k", "x")).select("ref_id", F.col("k").cast("bigint").alias("k"), F.round("x", 6).alias("x"))


@query
def jaccard(spark, sf_dir):
    return M.jaccards(G.hash_stream(spark, sf_dir), 9)


@query
def bit_similarity(spark, sf_dir):
    return rounded(M.bit_similarities(G.frame_codes(spark, sf_dir)), similarity=9)


@query
def fps_compat(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    fps = lambda k: F.lit(62.5) + F.col(k) * 0.01
    a = s.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + F.col("s_nationkey")).alias("b"))
    return a.join(s.select(F.col("s_suppkey").alias("b")), "b").select("a", "b", C.fps_compatible(fps("a"), fps("b")).alias("ok"))


@query
def sanitize_pcm(spark, sf_dir):
    bad = F.transform("samples", lambda x, i: F.when(i % 7 == 0, F.lit(math.nan)).when(i % 7 == 3, F.lit(math.inf)).otherwise(x))
    r = G.recordings(spark, sf_dir).select("recording_id", F.posexplode(C.sanitized(bad)).alias("t", "v"))
    return r.select("recording_id", F.col("t").cast("bigint").alias("t"), "v")


@query
def downmix(spark, sf_dir):
    r = G.recordings(spark, sf_dir).select("recording_id", F.posexplode(C.downmix(F.col("samples"), 2)).alias("t", "v"))
    return r.select("recording_id", F.col("t").cast("bigint").alias("t"), F.round("v", 9).alias("v"))


@query
def envelope(spark, sf_dir):
    """What the headers of the stored fingerprints say."""
    p = blobs.peek(frontends.hash_blobs(spark, sf_dir)).filter("error IS NULL")
    return p.select(F.col("recording_id").cast("bigint").alias("ref_id"), "algorithm", "sample_rate", F.col("frames_per_sec").cast("double").alias("frames_per_sec"), "hash_count")


@query
def overlap(spark, sf_dir):
    return M.haitsma_all_alignments(*_codes(spark, sf_dir), HaitsmaMatch(min_overlap_frames=0)).select("query_id", "ref_id", "delta", "overlap")


@query
def multiset_equality(spark, sf_dir):
    """Hashes of the Arrow front-end against those of the landmark operators over spectrograms: two ways to one multiset."""
    r = G.recordings(spark, sf_dir).select("recording_id", "sample_rate", F.col("samples").cast("array<float>").alias("samples"))
    db = S.power_long(S.power_rows(r, SMALL)).withColumn("v", C.power_to_db(F.col("v")))
    peaks = L.cap_per_second(L.pick_peaks(db, 2, 2, 0.0), 4, 10.0)
    return M.multiset_difference(S.extract_wang(r, frontends.WANG).select("recording_id", "hash", "t_anchor"), L.wang_hashes(peaks, 20, 6, 3))


@query
def time_offset(spark, sf_dir):
    return G.hash_stream(spark, sf_dir).select("ref_id", "t", C.offset(F.col("t") - 500, F.lit(78.125)).getField("ms").alias("ms"))

"""Language identification by error-correcting output codes.

Every language gets a binary codeword. For each bit a linear classifier over hashed byte n-grams is
trained; a text's bit margins are compared with all codewords under a loss, each bit weighted by how
well it did in training, and the nearest codeword wins. A small gap to the second is flagged.

Defined results: null texts and texts without a letter are ``und`` with score 0; repeated rows get equal
results; extra columns of the input are ignored; an empty training set gives ``und`` everywhere.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonorel.llm import common

ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 16
#: Labelled rows used for training, at most, for each language: those with the smallest hash of their id.
MAX_ROWS_PER_LANGUAGE = 1500
#: Share of the decoder's weight below which a text's language counts as not told.
MAJORITY = 0.5
#: Bytes of a text taken at a time; longer texts are scored piece by piece.
PIECE = 1 << 17

_MIX = np.uint64(0x9E3779B97F4A7C15)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k x bits matrix of +1/-1. Up to six languages: the exhaustive code; more: the random dense code
    with the largest least distance of 200 tries."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 6:
        cols = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and min(c) < 0]
        return np.array(cols, np.float32).T.copy()
    bits = int(np.ceil(10 * np.log2(k)))
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.float32), (k, bits))
        if (abs(m.sum(0)) == k).any():
            continue
        d = ((bits - m @ m.T) / 2 + np.eye(k) * bits).min()
        if d > far:
            best, far = m, d
    return best


def ngram_buckets(raw: bytes, n: int) -> np.ndarray:
    """Bucket of each byte n-gram, in place."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    m = len(a) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    code = np.full(m, n, np.uint64)
    for i in range(n):
        code = (code << np.uint64(8)) | a[i : m + i]
    return ((code * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def prepared(text: str) -> bytes:
    """Lower case, runs of anything but letters as one blank."""
    return b" " + re.sub(r"[\W\d_]+", " ", text.lower()).strip().encode() + b" "


def pieces(raw: bytes):
    """Pieces that overlap so that each n-gram of the longest order occurs in just one."""
    step = PIECE
    for at in range(0, max(1, len(raw)), step):
        yield raw[at : at + step + max(ORDERS) - 1], step


def histogram(raw: bytes) -> np.ndarray:
    """n-gram counts of a whole text, orders x buckets."""
    out = np.zeros((len(ORDERS), 1 << BUCKET_BITS), np.int64)
    for piece, step in pieces(raw):
        for j, n in enumerate(ORDERS):
            out[j] += np.bincount(ngram_buckets(piece[: step + n - 1], n), minlength=1 << BUCKET_BITS)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # orders x buckets x bits, float32
    bit_weight: np.ndarray  # bits
    scale: float

    def margins(self, text: str) -> np.ndarray:
        raw = prepared(text)
        total, n_all = np.zeros(self.code.shape[1]), 0
        for piece, step in pieces(raw):
            for j, n in enumerate(ORDERS):
                at = ngram_buckets(piece[: step + n - 1], n)
                total += self.weights[j].take(at, axis=0).sum(axis=0, dtype=np.float64)
            n_all += min(step, len(piece))
        # evidence grows with the text's length up to a point: neighbouring n-grams overlap
        return self.scale * total / max(n_all, 1) * np.sqrt(min(n_all, 400))

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)"""
        if text is None or not self.languages or not has_letter(text):
            return "und", 0.0, True
        return self.nearest(self.margins(text))

    def identified(self, text: str | None) -> bool:
        if text is None or not has_letter(text):
            return False
        return not self.languages or self.decide(text)[1] > MAJORITY

    def nearest(self, f: np.ndarray) -> tuple[str, float, bool]:
        f = np.clip(f, -8, 8)
        loss = (np.log1p(np.exp(-self.code * f)) * self.bit_weight).sum(axis=1) / self.bit_weight.sum()
        p = np.exp(-(loss - loss.min()) * self.code.shape[1])
        p /= p.sum()
        order = np.argsort(loss, kind="stable")
        best = float(p[order[0]])
        second = float(p[order[1]]) if len(order) > 1 else 0.0
        return self.languages[order[0]], best, best - second < 0.2


def fit(rows: list[tuple[str, str]], smoothing: float = 0.5) -> LanguageModel:
    """Train from (text, language) rows. Each bit's classifier weighs an n-gram by the log-odds of its frequency in
    the languages on either side of the bit; bits count by their training error."""
    rows = [(t, l) for t, l in rows if t is not None and l is not None and has_letter(t)]
    languages = sorted({l for _, l in rows})
    code = codewords(len(languages))
    bits = code.shape[1]
    size = 1 << BUCKET_BITS
    if not languages:
        return LanguageModel([], code, np.zeros((len(ORDERS), size, 1), np.float32), np.ones(1), 1.0)
    counts = np.zeros((len(languages), len(ORDERS), size))
    for t, l in rows:
        h = histogram(prepared(t))
        counts[languages.index(l)] += h / max(1, h[0].sum())  # each text has equal weight
    p = counts + smoothing * counts.sum() / counts.size
    p /= p.sum(axis=2, keepdims=True)
    w = np.zeros((len(ORDERS), size, bits), np.float32)
    for b in range(bits):
        pos, neg = p[code[:, b] > 0].mean(0), p[code[:, b] < 0].mean(0) if (code[:, b] < 0).any() else p.mean(0)
        w[:, :, b] = np.clip(np.log(pos / neg), -4, 4)
    model = LanguageModel(languages, code, w, np.ones(bits), 1.0)
    m = np.array([model.margins(t) for t, _ in rows])
    y = code[[languages.index(l) for _, l in rows]]
    model.scale = float(3.0 / max(1e-9, np.median(np.abs(m))))
    error = ((m * y) <= 0).mean(axis=0)
    model.bit_weight = np.log((1 - error + 0.01) / (error + 0.01)).clip(0.1)
    return model


def training_rows(docs: DataFrame, folds: int = 5, per_language: int = MAX_ROWS_PER_LANGUAGE) -> DataFrame:
    """(text, lang) of the bounded training sample: rows whose crc32(doc_id) mod ``folds`` is not 0."""
    from pyspark.sql import Window

    d = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != 0))
    # a hash threshold for each language leaves little more than the sample, whatever the input's size
    share = {r["lang"]: min(1.0, 1.5 * per_language / r["count"]) for r in d.groupBy("lang").count().collect()}
    if not share:
        return d.select("text", "lang")
    h = F.xxhash64(F.col("doc_id").cast("string"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    ids = d.select("doc_id", "lang", h.alias("h")).filter(F.pmod(h, F.lit(1 << 30)) < limit * (1 << 30))
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = ids.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_language).select("doc_id")
    return d.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("text", "lang")


def train(docs: DataFrame, folds: int = 5, per_language: int = MAX_ROWS_PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``per_language`` whole texts of each language; the driver holds that sample alone."""
    return fit([(r[0], r[1]) for r in training_rows(docs, folds, per_language).toLocalIterator()])


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("ambiguous", T.BooleanType()),
    ]
)


def predict(docs: DataFrame, model: LanguageModel, folds: int = 5) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text): language, score from 0 to 1, ambiguity flag."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.decide(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                names=SCHEMA.names,
            )

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of ``docs``, all columns, but those without a letter (null and empty ones too) and those for which no learned
    language has more than ``MAJORITY`` of the decoder's weight. If nothing was learned, as from a corpus without labels,
    no language speaks against a text and all rows with a letter stay. Repeated rows are taken one by one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in common.pieces(batches):
            keep = [m.identified(t.as_py()) for t in b.column("text")]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

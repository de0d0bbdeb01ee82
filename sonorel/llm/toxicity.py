"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens and their stems (word beginnings of 3 to 9 letters) get log-odds between toxic and clean labelled
texts under an informative Dirichlet prior (the whole training corpus' frequencies). A token scores as its
strongest known form, less one standard error; tokens without clear evidence get a small negative score,
so long clean stretches cost something. A linear-time scan finds every maximal scoring segment. Segment scores
are put on one scale by extreme-value (Karlin-Altschul) statistics, their evidence above chance is
summed, and a logistic link fitted on the training texts turns the sum into a probability.

Defined results: null or empty texts have no segment and get the score of "no evidence"; repeated rows get
equal scores; if no label can be learned, every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorel.llm import common

#: Labelled documents used for training, at most: those with the smallest hash of their id.
MAX_TRAINING_ROWS = 12_000
#: Weight of the prior, in tokens; of a small training set a share.
PRIOR_TOKENS, PRIOR_SHARE = 2_000.0, 0.02
MIN_Z = 4.0
MIN_LOG_ODDS = 2.0
THRESHOLD = 0.7

STEMS = range(3, 10)
#: Tokens whose scores a worker remembers before it starts anew.
MEMO = 100_000

_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@dataclass
class ToxicModel:
    weight: dict[str, float]  # of tokens, and of stems as "stem*"
    other: float  # score of every token outside ``weight``
    lam: float
    log_k: float
    slope: float
    intercept: float
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def token_weight(self, token: str) -> float:
        """0 for a token without evidence."""
        w = self.weight
        return max([w.get(token, 0.0), *(w.get(token[:n] + "*", 0.0) for n in STEMS if n <= len(token))])

    def segments(self, toks: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments [from, to) with their scores."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for t in set(toks).difference(memo):
            memo[t] = self.token_weight(t)
        hits = [(i, s) for i, s in enumerate(map(memo.__getitem__, toks)) if s]
        return maximal_segments(hits, self.other)

    def evidence(self, toks: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
        """Evidence above chance of all segments, and the segments, scored in nats of E-value."""
        found = self.segments(toks)
        if not found:
            return 0.0, []
        # E = K n exp(-lambda S) segments that good are expected by chance in n clean tokens
        chance = self.log_k + np.log(max(len(toks), 1))
        out = [(a, b, self.lam * s - chance) for a, b, s in found]
        return float(sum(np.logaddexp(0.0, x) for _, _, x in out)), out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        if not self.weight:
            return 0.0, []
        e, found = self.evidence(tokens(text) if text else [])
        return float(1 / (1 + np.exp(-(self.intercept + self.slope * np.log1p(e))))), found


def maximal_segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment of a sequence that scores ``other`` (< 0) but at ``hits`` (position,
    score > 0), in time linear in the hits: candidates are kept on a list, and each new positive run is
    merged to the left while the cumulative sums say so."""
    if not hits:
        return []
    # candidates: (from, to, sum before, sum after, the nearest earlier one with a lower sum before, or -1)
    cand: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, 0
    for pos, s in hits:
        total += other * (pos - at)
        left, right, a, b = total, total + s, pos, pos + 1
        total, at = right, pos + 1
        j = len(cand) - 1
        while j >= 0 and cand[j][2] >= left:
            j = cand[j][4]  # those between have sums at least as high
        while j >= 0 and cand[j][3] < right:
            a, _, left, _, before = cand[j]
            del cand[j:]
            j = before
        cand.append((a, b, left, right, j))
    return [(a, b, r - l) for a, b, l, r, _ in cand]


def training_ids(labels: DataFrame, folds: int = 3, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, toxic of the bounded training sample: labelled rows with crc32(doc_id) mod ``folds`` other
    than 1. Conflicting labels of one document count as toxic."""
    rows = labels.filter(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != 1))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    h = F.xxhash64(F.col("doc_id").cast("string"))
    # a hash threshold leaves little more than the sample, whatever the input's size
    share = min(1.0, 1.5 * max_rows / max(1, rows.count()))
    return rows.filter(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(h, "doc_id").limit(max_rows)


def _token_counts(batches):
    """Per partition: for each token the toxic and the clean documents that hold it (a token that one text
    repeats a hundred times says no more than one that it holds once)."""
    count: Counter = Counter()
    for b in batches:
        for text, toxic in zip(b.column("text"), b.column("toxic"), strict=True):
            count.update((t, toxic.as_py()) for t in set(tokens(text.as_py() or "")))
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in count], pa.string()), pa.array([v if k[1] else 0 for k, v in count.items()], pa.int64()), pa.array([0 if k[1] else v for k, v in count.items()], pa.int64())],
        names=["token", "toxic", "clean"],
    )


def solve_lambda(scores: np.ndarray, p: np.ndarray) -> float:
    """Positive root of sum p exp(lambda s) = 1, for scores of negative mean."""
    lo, hi = 0.0, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while f(hi) < 0 and hi < 1e3:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, max_rows: int = MAX_TRAINING_ROWS) -> ToxicModel:
    """Fit on whole texts of at most ``max_rows`` labelled documents. The token table is aggregated on the
    executors; the driver gets the tokens with evidence and one number a training document, both bounded by the sample."""
    none = ToxicModel({}, -0.1, 1.0, 0.0, 1.0, 0.0)
    ids = training_ids(labels, folds, max_rows).collect()  # at most max_rows pairs of numbers
    if len({r.toxic for r in ids}) < 2:
        return none
    spark = docs.sparkSession
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int")), "doc_id"
    )
    table = (
        sample.mapInArrow(_token_counts, "token string, toxic long, clean long")
        .groupBy("token")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .persist()
    )
    n1, n0 = table.agg(F.sum("toxic"), F.sum("clean")).first()
    if not n1 or not n0:
        table.unpersist()
        return none
    stems = F.array(*[F.when(F.length("token") >= n, F.concat(F.substring("token", 1, n), F.lit("*"))) for n in STEMS])
    forms = (
        table.select(F.explode(F.filter(F.concat(F.array("token"), stems), lambda x: x.isNotNull())).alias("token"), "toxic", "clean")
        .groupBy("token")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter("toxic > 0")
    )
    prior = min(PRIOR_TOKENS, PRIOR_SHARE * (n1 + n0))
    a = F.lit(prior / float(n1 + n0)) * (F.col("toxic") + F.col("clean"))
    d = F.log((F.col("toxic") + a) / (F.lit(n1 + prior) - F.col("toxic") - a)) - F.log((F.col("clean") + a) / (F.lit(n0 + prior) - F.col("clean") - a))
    se = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    best = forms.select("token", "toxic", "clean", d.alias("d"), se.alias("se")).filter((F.col("d") >= MIN_Z * F.col("se")) & (F.col("d") > MIN_LOG_ODDS)).collect()
    # what whole tokens score, to know how scores fall in clean text
    weight = {r.token: float(r.d - r.se) for r in best}
    probe = spark.sparkContext.broadcast(ToxicModel(weight, -0.1, 1.0, 0.0, 1.0, 0.0))

    def weigh(batches):
        for b in batches:
            w = [probe.value.token_weight(t.as_py()) for t in b.column("token")]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.float64()), b.column("toxic"), b.column("clean")], names=["s", "toxic", "clean"])

    spread = table.mapInArrow(weigh, "s double, toxic long, clean long").groupBy("s").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    table.unpersist()
    return fit_link(weight, spread, sample) if weight else none


def fit_link(weight: dict[str, float], spread, sample: DataFrame) -> ToxicModel:
    """Calibrate ``weight``. spread: rows (s, toxic, clean), the tokens of each label that score s."""
    n1, n0 = sum(r.toxic for r in spread), sum(r.clean for r in spread)
    hits = [r for r in spread if r.s > 0]
    hit1, hit0 = sum(r.toxic for r in hits), sum(r.clean for r in hits)
    # tokens without evidence: what their absence from the toxic vocabulary says, at least a small cost
    other = min(-0.02, float(np.log(max(1 - hit1 / n1, 1e-6) / max(1 - hit0 / n0, 1e-6))))
    scores = np.array([other, *(r.s for r in hits)])
    p = np.array([max(n0 - hit0, 1.0), *(r.clean + 0.5 for r in hits)])
    p /= p.sum()
    if (p * scores).sum() >= 0:
        other = scores[0] = float(-1.1 * (p[1:] * scores[1:]).sum() / p[0])
    lam = solve_lambda(scores, p)
    model = ToxicModel(weight, other, lam, 0.0, 1.0, 0.0)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def best_of(batches):
        m = shared.value
        for b in batches:
            rows = [(t.as_py(), y.as_py()) for t, y in zip(b.column("text"), b.column("toxic"), strict=True)]
            toks = [tokens(t or "") for t, _ in rows]
            segs = [[s * m.lam for _, _, s in m.segments(t)] for t in toks]
            yield pa.RecordBatch.from_arrays([pa.array([y for _, y in rows], pa.int32()), pa.array([len(t) for t in toks], pa.int64()), pa.array(segs, pa.list_(pa.float64()))], names=["toxic", "n", "segs"])

    rows = sample.mapInArrow(best_of, "toxic int, n long, segs array<double>").collect()
    # location of the chance maximum: the exponential tail of clean texts' best segments
    tail = [max(r.segs) - np.log(max(r.n, 1)) for r in rows if not r.toxic and r.segs]
    clean = sum(1 for r in rows if not r.toxic)
    if tail:
        model.log_k = float(np.median(tail) + np.log(len(tail) / max(clean, 1)))
    x = np.array([np.log1p(sum(np.logaddexp(0.0, s - model.log_k - np.log(max(r.n, 1))) for s in r.segs)) for r in rows])
    y = np.array([float(r.toxic) for r in rows])
    model.slope, model.intercept = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """One-variable logistic regression by damped Newton steps; the slope is never negative."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_segments int, worst_from int, worst_to int, worst_evidence double"


def score(docs: DataFrame, model: ToxicModel, folds: int = 3, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: score, decision, and the worst passage as a token span."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.score(t.as_py()) for t in b.column(2)]
            worst = [max(s, key=lambda x: x[2]) if s else (None, None, None) for _, s in got]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([g[0] for g in got], pa.float64()),
                    pa.array([int(g[0] >= threshold) for g in got], pa.int32()),
                    pa.array([len(g[1]) for g in got], pa.int32()),
                    pa.array([x[0] for x in worst], pa.int32()),
                    pa.array([x[1] for x in worst], pa.int32()),
                    pa.array([x[2] for x in worst], pa.float64()),
                ],
                names=["doc_id", "held_out", "score", "predicted", "n_segments", "worst_from", "worst_to", "worst_evidence"],
            )

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in common.pieces(batches):
            yield b.filter(pa.array([m.score(t.as_py())[0] < threshold for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

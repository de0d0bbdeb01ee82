"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every row is indexed: unit vectors are projected on Gaussian (2-stable) directions and cut into slots of
equal width; a table's bucket is the tuple of its slots. A query visits, in each table, the buckets that
come from its own by moving some slots by one, in the order of estimated success (the sum of squared
distances to the slot borders crossed), and the candidates of all tables are merged and ranked again by the
exact measure in double precision.

The index is built block by block where the rows lie, so vectors are never shuffled; a hot bucket is just
a longer list in its block, and each block sends its best few per query to the merge. Queries are a stated
set, taken to the executors in blocks of bounded size.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do
rows without an id; vectors of different lengths are never compared; rows that repeat an id and vector count
once, and rows with the query's id are its own. With fewer candidates than ``k``, all are returned:
queries that find fewer than ``k`` in their buckets are compared with every vector of their length.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonorel.llm import common


@dataclass(frozen=True)
class Params:
    tables: int = 8
    projections: int = 6
    width: float = 1.6  # of a slot, for unit vectors
    probes: int = 60  # buckets visited in each table
    seed: int = 11
    block_rows: int = 16_384
    query_block: int = 16_384


class Tables:
    """Directions and shifts, equal on every executor: they come from the seed alone."""

    def __init__(self, dim: int, p: Params):
        rng = np.random.default_rng([p.seed, dim])
        self.p = p
        self.a = rng.standard_normal((p.tables, dim, p.projections))
        self.b = rng.uniform(0, p.width, (p.tables, p.projections))
        # perturbations: every way to move slots by -1, 0 or +1, and the matrix that sums their costs
        self.moves = np.array(list(itertools.product((-1, 0, 1), repeat=p.projections)), np.int64)
        self.cost = np.concatenate([self.moves == -1, self.moves == 1], axis=1).T.astype(np.float64)
        self.radix = np.array([1 << (8 * i) for i in range(p.projections)], np.int64)

    def slots(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        y = (x @ self.a[t] + self.b[t]) / self.p.width
        s = np.floor(y)
        return s.astype(np.int64), y - s

    def keys(self, x: np.ndarray, t: int) -> np.ndarray:
        return (self.slots(x, t)[0] + 128) @ self.radix

    def probe_keys(self, x: np.ndarray, t: int) -> np.ndarray:
        """Buckets to visit for each query, by estimated success."""
        s, part = self.slots(x, t)
        cost = np.concatenate([part, 1 - part], axis=1) ** 2 @ self.cost
        n = min(self.p.probes, cost.shape[1])
        order = np.argsort(cost, axis=1, kind="stable")[:, :n]
        return ((s + 128) @ self.radix)[:, None] + (self.moves @ self.radix)[order]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, tables: Tables | None):
    """(query_id, vec_id, cosine) of the k best candidates of each query in this block; without tables all are candidates."""
    qu, xu = unit(q), unit(x)
    q_norm, x_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    candidate = np.full((len(q), len(x)), tables is None)
    for t in range(tables.p.tables if tables else 0):
        buckets, bucket_of = np.unique(tables.keys(xu, t), return_inverse=True)
        probes = tables.probe_keys(qu, t)
        at = np.minimum(np.searchsorted(buckets, probes), len(buckets) - 1)
        visited = np.zeros((len(q), len(buckets)), bool)
        row, col = np.nonzero(buckets[at] == probes)
        visited[row, at[row, col]] = True
        candidate |= visited[:, bucket_of]
    out_q, out_v, out_s = [], [], []
    for i in range(len(q)):
        c = np.nonzero(candidate[i] & (ids != q_ids[i]))[0]
        if not len(c):
            continue
        score = x[c] @ q[i] / (x_norm[c] * q_norm[i])
        if len(c) > 4 * k:  # the rest can't be among the best: all ties of the k-th stay
            c, score = (v[score >= np.partition(score, len(c) - k)[len(c) - k]] for v in (c, score))
        order = np.lexsort((ids[c], -score))
        v, s = ids[c][order], score[order]
        first = np.ones(len(v), bool)
        first[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
        v, s = v[first][:k], s[first][:k]
        out_q.append(np.full(len(v), q_ids[i]))
        out_v.append(v)
        out_s.append(s)
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def usable(rows: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    sound = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    some = F.exists(e, lambda v: v != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.coalesce(sound & some, F.lit(False)))


def search(rows: DataFrame, is_query, k: int = 5, params: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query.

    rows: vec_id, embedding. is_query: condition on those columns that states the query set.
    """
    spark = rows.sparkSession
    vectors = usable(rows)
    queries = vectors.filter(is_query)
    n = queries.count()
    blocks = max(1, -(-n // params.query_block))
    columns = "query_id long, vec_id long, score double"
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(some: DataFrame) -> DataFrame:
        return some.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct()

    def by_length(part: DataFrame) -> dict:
        sets = {}
        for r in part.distinct().collect():  # a stated set, of bounded size
            sets.setdefault(len(r.embedding), []).append((r.vec_id, r.embedding))
        return {d: (np.array([i for i, _ in v], np.int64), np.array([e for _, e in v], np.float64)) for d, v in sets.items()}

    def block_of(b: int, some: DataFrame) -> DataFrame:
        return some if blocks == 1 else some.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)

    found = None
    for b in range(blocks):
        shared = spark.sparkContext.broadcast(by_length(block_of(b, queries)))
        local = vectors.mapInArrow(_searcher(shared, k, params), columns)
        found = local if found is None else found.union(local)
    found = common.materialize(best(found), "neighbours")
    # who found too few is compared with all
    full = common.materialize(found.groupBy("query_id").agg(F.max("rank").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id")), "full")
    poor = common.materialize(common.anti_join(queries, full, "vec_id"), "poor")
    if poor.isEmpty():
        return found
    rest = None
    for b in range(blocks):
        shared = spark.sparkContext.broadcast(by_length(block_of(b, poor)))
        local = vectors.mapInArrow(_searcher(shared, k, params, False), columns)
        rest = local if rest is None else rest.union(local)
    return common.semi_join(found, full.withColumnRenamed("vec_id", "query_id"), "query_id").union(best(rest))


def _searcher(shared, k: int, params: Params, hashed: bool = True):
    def answer(dim: int, ids: list, vecs: list):
        q_ids, q = shared.value[dim]
        x, i = np.concatenate(vecs), np.concatenate(ids)
        tables = Tables(dim, params) if hashed else None
        for at in range(0, len(q), 512):
            a, b, s = search_block(q_ids[at : at + 512], q[at : at + 512], i, x, k, tables)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["query_id", "vec_id", "score"])

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            ids, col = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            sizes = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                if dim not in shared.value:
                    continue
                at = np.nonzero(sizes == dim)[0]
                x = flat[starts[at][:, None] + np.arange(dim)[None]]
                for lo in range(0, len(at), params.block_rows):
                    h = held.setdefault(dim, ([], []))
                    h[0].append(ids[at][lo : lo + params.block_rows])
                    h[1].append(x[lo : lo + params.block_rows])
                    if sum(map(len, h[0])) >= params.block_rows:
                        yield from answer(dim, *held.pop(dim))
        for dim, h in held.items():
            yield from answer(dim, *h)

    return run

"""Extension points: extractors, streaming extractors and matchers of one's own."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorel.operators import spectral
from sonorel.operators.lags import PAIR, cells, meet
from sonorel.streaming.callbacks import Callbacks


class Fingerprinter(ABC):
    """A batch extractor: integer columns from the samples of one recording."""

    name: str
    sample_rate: int
    min_samples: int = 0
    max_input_samples: int | None = None
    fields: Sequence[str]

    @abstractmethod
    def extract(self, samples: np.ndarray) -> Sequence[np.ndarray]:
        """One array per field, all of one length."""

    def apply(self, recordings: DataFrame) -> DataFrame:
        """recording_id, the fields, error: one recording's failure is one row."""
        return spectral._extract(recordings, self, self.extract, list(self.fields))


class StreamingFingerprinter(Callbacks, ABC):
    """A streaming extractor; instances must pickle, for they are the state kept between batches."""

    @abstractmethod
    def push(self, samples: np.ndarray) -> list[tuple]:
        """(t_ms, hash, t_anchor, t_b, t_c) of what is ready."""

    @abstractmethod
    def flush(self) -> list[tuple]:
        """What is left at the end of the stream."""

    def latency_ms(self) -> int:
        return 0


RESULT = "query_id string, ref_id string, is_match boolean, score double, votes long, prominence double, offset_frames long, offset_ms long, time_scale double"


_KINDS = {"is_match": pa.bool_(), "score": pa.float64(), "votes": pa.int64(), "prominence": pa.float64(), "offset_frames": pa.int64(), "offset_ms": pa.int64(), "time_scale": pa.float64()}


#: The result of no match.
NONE = {"is_match": False, "score": 0.0, "votes": 0, "prominence": 0.0, "offset_frames": 0, "offset_ms": 0, "time_scale": 1.0}


class Matcher(ABC):
    """A 1:1 matcher over the rows of one query and one reference."""

    #: Result columns that ``match_many`` returns; the others are those of ``NONE`` in ``apply_all``.
    gives: Sequence[str] = tuple(_KINDS)

    @abstractmethod
    def match_one(self, query: pd.DataFrame, reference: pd.DataFrame) -> dict:
        """is_match, score, votes, prominence, offset_frames, offset_ms, time_scale"""

    def prepare(self, rows: pd.DataFrame):
        """What ``match_one`` gets of a query or a reference, made once for all pairs of it in a task: its rows, unless redefined."""
        return rows

    def _result(self, query, reference) -> dict:
        return NONE | self.match_one(query, reference)

    def match_many(self, queries: list, references: list) -> dict:
        """Arrays of the result columns ``gives`` for all queries with all references, those of the first query first: one pair after another,
        unless redefined."""
        rows = [self._result(q, r) for q in queries for r in references]
        return {c: [row[c] for row in rows] for c in self.gives}

    def apply_all(self, queries: DataFrame, references: DataFrame) -> DataFrame:
        """Match every query with every reference: blocks of some hundred of each meet in a task, and packed blocks are sent once to
        each group of the other side instead of rows to each pair."""

        def prepared(t: pa.Table) -> tuple[pa.Array, list]:
            key = next(k for k in PAIR if k in t.column_names)
            got = {str(k): self.prepare(v) for k, v in t.to_pandas().groupby(key, sort=False)}
            return pa.array(got, pa.string()), list(got.values())

        def run(x: tuple[pa.Array, list], y: tuple[pa.Array, list], same: bool) -> pa.Table:
            (a, qs), (b, rs) = x, y
            got = self.match_many(qs, rs)
            ids = [a.take(pa.array(np.repeat(np.arange(len(a)), len(b)))), pa.chunked_array([b] * len(a), pa.string()).combine_chunks()]
            return pa.table([*ids, *[pa.array(got[c], _KINDS[c]) for c in self.gives]], names=[*PAIR, *self.gives])

        kinds = {k: t for k, t in (c.split(" ") for c in RESULT.split(", "))}
        met = cells(queries, references, run, ", ".join(f"{c} {kinds[c]}" for c in [*PAIR, *self.gives]), prepare=prepared)
        # columns that are the same for all pairs don't come from Python
        return met.select(*PAIR, *[F.col(c) if c in self.gives else F.lit(NONE[c]).cast(kinds[c]).alias(c) for c in _KINDS])

    def apply(self, pairs: DataFrame, queries: DataFrame, references: DataFrame) -> DataFrame:
        """Match the stated ``pairs`` (query_id, ref_id): each pair's rows meet in one task."""

        def run(key, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            got = self._result(self.prepare(q), self.prepare(r))
            return pd.DataFrame([{"query_id": str(key[0]), "ref_id": str(key[1]), **got}])

        key = ["query_id", "ref_id"]
        q, r = pairs.select(*key).join(queries, "query_id"), pairs.select(*key).join(references, "ref_id")
        # toDF gives both sides columns of their own, also where they come from one table
        return q.toDF(*q.columns).groupBy(*key).cogroup(r.toDF(*r.columns).groupBy(*key)).applyInPandas(run, RESULT)


def catalogue_pairs(queries: DataFrame, references: DataFrame) -> DataFrame:
    """Every stated query with every reference of a catalogue: one row a pair, no hashes."""
    return meet(queries.select("query_id").distinct(), references.select("ref_id").distinct(), ["ref_id"])

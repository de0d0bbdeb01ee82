"""Streaming extractors: chunks of samples in, hashes out, with the same result as the batch extractors.

The extractors are plain objects whose state is small arrays; ``stream_hashes`` runs one per stream id inside
Structured Streaming. A second of audio is closed, and its strongest peaks are chosen, once every frame of it
has its full neighbourhood; an anchor is sent once all seconds that its target zone reaches into are closed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sonorel import errors
from sonorel.configs import Embedder, Haitsma, Panako, Wang
from sonorel.functions import kernels as K
from sonorel.operators import neural, spectral
from sonorel.streaming.callbacks import Callbacks


class FrameStream(Callbacks):
    """Turns pushed samples into frames of one STFT; keeps what the next frame needs."""

    def __init__(self, cfg):
        self.cfg, self.carry, self.frames = cfg, np.empty(0, np.float32), 0

    def reset(self) -> None:
        """Start a new stream with the same options."""
        self.__init__(self.cfg)

    def power(self, samples) -> tuple[int, np.ndarray]:
        """(number of the first new frame, power of the new frames)"""
        x = np.asarray(samples, np.float32)
        if self.cfg.max_push_samples is not None:
            x = x[: self.cfg.max_push_samples]
        self.carry = np.concatenate([self.carry, np.where(np.isfinite(x), x, np.float32(0))])
        p, first = spectral.spectrum(self.carry, self.cfg), self.frames
        self.carry = self.carry[len(p) * self.cfg.stft.hop :]
        self.frames += len(p)
        return first, p


class RunningMax:
    """Maximum over the rows within ``half`` of each row, one row at a time: rows are kept in blocks as long as the window, and
    a window is the end of one block and the start of the next, whose maxima are at hand. Three comparisons a cell, whatever
    the size of the chunks; rows before the first and behind the last don't exist."""

    def __init__(self, half: int, bins: int):
        self.half, self.width, self.n = half, 2 * half + 1, 0
        self.rows = np.full((self.width, bins), -np.inf)  # of the block that is being filled
        self.ends = self.rows.copy()  # of the block before: maxima from each row to its end
        self.start = None  # maximum of the block so far
        for _ in range(half):
            self._push(np.full(bins, -np.inf))

    def _push(self, row: np.ndarray) -> np.ndarray | None:
        at = self.n % self.width
        self.rows[at] = row
        self.start = row if at == 0 else np.maximum(self.start, row)
        self.n += 1
        out = None
        if self.n >= self.width:
            first = self.n % self.width  # of the window, in its block
            out = self.start if first == 0 else np.maximum(self.ends[first], self.start)
        if at == self.width - 1:
            self.ends = np.maximum.accumulate(self.rows[::-1], axis=0)[::-1]
        return out

    def push(self, rows: np.ndarray) -> list[np.ndarray]:
        """Maxima of the rows whose window is complete now, in order."""
        return [m for m in map(self._push, rows) if m is not None]

    def flush(self) -> list[np.ndarray]:
        """Maxima of the last rows. Called again, it gives nothing."""
        behind, self.half = self.half, 0
        return self.push(np.full((behind, self.rows.shape[1]), -np.inf))


class LandmarkStream(FrameStream):
    """Streaming form of the landmark extractors."""

    def __init__(self, cfg: Wang | Panako):
        super().__init__(cfg)
        self.rows = np.empty((0, cfg.stft.n_bins))  # frames whose peaks aren't known, in decibels
        self.high = RunningMax(cfg.neighborhood, cfg.stft.n_bins)
        self.ripe = 0  # frames whose peaks are known
        self.open = self._none()  # peaks of seconds that aren't closed
        self.closed = self._none()  # peaks that may still be targets or anchors
        self.sent = -1  # anchors up to this frame and bin are sent
        self.sent_f = -1
        self.reach = cfg.target_zone_t - isinstance(cfg, Panako)

    @staticmethod
    def _none():
        return np.empty((0, 3))  # t, f, magnitude

    def latency_ms(self) -> int:
        c = self.cfg
        return int((c.target_zone_t + c.neighborhood + np.ceil(c.frames_per_sec)) * 1000 / c.frames_per_sec)

    def push(self, samples) -> list[tuple]:
        first, p = self.power(samples)
        if len(p):
            db = K.decibels(p)
            self.rows = np.concatenate([self.rows, db])
            self._detect(self.high.push(K.sliding_max(db, self.cfg.neighborhood, 1)))
        second = int(np.floor((self.ripe - 1) / self.cfg.frames_per_sec)) if self.ripe else 0
        self._close(second)
        return self._send(second)

    def flush(self) -> list[tuple]:
        self._detect(self.high.flush())
        self._close(None)
        return self._send(None)

    def _detect(self, high: list[np.ndarray]) -> None:
        """Find the peaks of the next frames, whose neighbourhoods' maxima are known."""
        n = len(high)
        if n:
            db = self.rows[:n]
            t, f = np.nonzero((db > self.cfg.min_anchor_mag_db) & (db >= np.stack(high)))
            self.open = np.concatenate([self.open, np.stack([t + self.ripe, f, db[t, f]], axis=1)])
            self.rows, self.ripe = self.rows[n:], self.ripe + n

    def _close(self, second: int | None) -> None:
        """Choose the strongest peaks of every second before ``second`` (None: of all)."""
        s = np.floor(self.open[:, 0] / self.cfg.frames_per_sec)
        now = np.ones(len(s), bool) if second is None else s < second
        for one in np.unique(s[now]):
            p = self.open[s == one]
            p = p[np.lexsort((p[:, 1], p[:, 0], -p[:, 2]))[: self.cfg.peaks_per_sec or None]]
            self.closed = np.concatenate([self.closed, p[np.lexsort((p[:, 1], p[:, 0]))]])
        self.open = self.open[~now]
        most = self.cfg.max_pending_anchors
        if most is not None and len(self.closed):
            waiting = self._waiting()
            if waiting.sum() > most:  # the oldest anchors go unsent
                last = self.closed[np.nonzero(waiting)[0][-most - 1]]
                self.sent, self.sent_f = int(last[0]), int(last[1])

    def _waiting(self) -> np.ndarray:
        t, f = self.closed[:, 0], self.closed[:, 1]
        return (t > self.sent) | ((t == self.sent) & (f > self.sent_f))

    def _send(self, second: int | None) -> list[tuple]:
        if not len(self.closed):
            return []
        ready = self._waiting()
        if second is not None:
            ready &= np.floor((self.closed[:, 0] + self.reach) / self.cfg.frames_per_sec) < second
        out = self._hashes(ready)
        if ready.any():
            last = self.closed[np.nonzero(ready)[0][-1]]
            self.sent, self.sent_f = int(last[0]), int(last[1])
        waiting = self._waiting()
        self.closed = self.closed[waiting]
        return out

    def _hashes(self, ready: np.ndarray) -> list[tuple]:
        c = self.cfg
        t, f, mag = self.closed[:, 0].astype(np.int64), self.closed[:, 1].astype(np.int64), self.closed[:, 2]
        ms = lambda frame: int(frame * c.stft.hop * 1000 // c.sample_rate)
        if isinstance(c, Panako):
            a, b, d = K.landmark_triples(t, f, mag, c.target_zone_t, c.target_zone_f, c.fan_out, 2 * c.fan_out)
            keep = ready[a]
            a, b, d = a[keep], b[keep], d[keep]
            h = K.panako_hash((f[a], f[b], f[d]), (mag[a], mag[b], mag[d]), (t[a], t[b], t[d]))
            return [(ms(x), *map(int, r)) for x, r in zip(t[a], zip(h, t[a], t[b], t[d], strict=True), strict=True)]
        a, b = K.landmark_pairs(t, f, mag, c.target_zone_t, c.target_zone_f, c.fan_out)
        keep = ready[a]
        a, b = a[keep], b[keep]
        return [(ms(x), int(h), int(x), None, None) for h, x in zip(K.wang_hash(f[a], f[b], t[b] - t[a]), t[a], strict=True)]


class HaitsmaStream(FrameStream):
    """Streaming form of the frame-code extractor."""

    def __init__(self, cfg: Haitsma = Haitsma()):
        super().__init__(cfg)
        self.band = K.band_of_bin(cfg.fmin, cfg.fmax, cfg.sample_rate, cfg.stft.n_fft, cfg.bands)
        self.before = np.empty((0, cfg.bands))

    def latency_ms(self) -> int:
        return self.cfg.stft.n_fft * 1000 // self.cfg.sample_rate

    def push(self, samples) -> list[tuple]:
        first, p = self.power(samples)
        if not len(p):
            return []
        e = np.concatenate([self.before, K.band_energies(p, self.band, self.cfg.bands)])
        start = first - len(self.before)
        self.before = e[-1:]
        return [(int((start + i + 1) * self.cfg.stft.hop * 1000 // self.cfg.sample_rate), int(h), start + i, None, None) for i, h in enumerate(K.frame_codes(e))]

    def flush(self) -> list[tuple]:
        return []


class EmbeddingStream(Callbacks):
    """Streaming form of the embedder: every full window gives a vector; a rest goes at the end. A window that the model fails
    on stays and is tried again with the next push, ``retries`` times; then it gives a row with the error, and the stream goes on
    behind it."""

    def __init__(self, cfg: Embedder, model, retries: int = 1):
        self.cfg, self.model, self.retries = cfg, model, retries
        self.carry, self.consumed, self.failed = np.empty(0, np.float32), 0, 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"model": None}  # what is kept between batches has no model

    def reset(self) -> None:
        self.__init__(self.cfg, self.model, self.retries)

    def latency_ms(self) -> int:
        return round(self.cfg.window_secs * 1000)

    def push(self, samples, last: bool = False) -> list[tuple[int, np.ndarray | None, str | None]]:
        x = np.asarray(samples, np.float32)
        self.carry = np.concatenate([self.carry, np.where(np.isfinite(x), x, np.float32(0))])
        out, w, h = [], self.cfg.window_samples, self.cfg.hop_samples
        while len(self.carry) >= w:
            vector = error = None
            try:
                vector = self.model(self.carry[:w])
            except Exception as e:  # noqa: BLE001 - whatever a model raises is its window's failure
                self.failed += 1
                if self.failed <= self.retries and not last:
                    break
                error = f"{errors.BAD_INFERENCE}: {e}"
            out.append((self.consumed * 1000 // self.cfg.sample_rate, vector, error))
            self.carry, self.consumed, self.failed = self.carry[h:], self.consumed + h, 0
        return out

    def flush(self) -> list:
        out = self.push([], last=True)
        self.carry = np.empty(0, np.float32)
        return out


def extractor(cfg):
    """The streaming extractor of a configuration, or what a factory of one's own gives."""
    if callable(cfg):
        return cfg()
    return HaitsmaStream(cfg) if isinstance(cfg, Haitsma) else LandmarkStream(cfg)


#: Chunks that wait beside a stream's extractor, and their bytes; with more than either all go under keys of their own.
FEW, FEW_BYTES = 16, 1 << 16

OUT = "stream_id string, t_ms bigint, hash bigint, t_anchor bigint, t_b bigint, t_c bigint, error string"


class HashProcessor(StatefulProcessor):
    """Keyed state: the extractor, whose size its options bound, with the number of the next chunk and up to ``FEW`` small chunks that
    came early; and, once more wait, each of those under its own key, of which a batch touches only those that come or become due.
    Every access to a state is a round trip between processes and costs more than what is done with it, so what a batch needs of a
    stream in order, or nearly so, lies in one place. Chunks may come in any order and more than
    once. A gap is reported and skipped when more than ``max_gap`` chunks wait behind it or, given a ``patience_ms``, when no
    chunk has come for so long.

    Time is that of processing or, given an ``event_time`` column with a watermark, that of the chunks: then a stream that the
    watermark has left ``patience_ms`` behind is flushed as well, and nothing is kept of it; chunks older than the watermark are dropped by
    Spark, so late copies can't start it anew. Of a stream that ended with its end mark a mark is kept that ignores late copies;
    it goes after the same patience. A chunk with a true ``reset`` (an optional column) starts the stream over before its
    samples; what was pending is dropped. An extractor that raises gives one row with the error and starts over with the next chunk."""

    columns = OUT

    def __init__(self, cfg, max_gap: int = 64, patience_ms: int | None = None, event_time: str | None = None):
        self.cfg, self.max_gap, self.patience_ms, self.event_time = cfg, max_gap, patience_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("extractor", "blob binary, due bigint, waiting bigint, few binary")
        self.ended = handle.getValueState("ended", "mark boolean")
        self.early = handle.getMapState("early", "seq bigint", "samples binary, eos boolean, reset boolean")  # little-endian floats

    def _load(self, blob: bytes | None):
        return extractor(self.cfg) if blob is None else pickle.loads(blob)

    def _pushed(self, key, ex, chunk, out: list):
        """The extractor after one chunk (None behind the last), whose rows go to ``out``."""
        samples, eos, reset = chunk
        if reset:
            ex = extractor(self.cfg)
        try:
            got = ex.push(samples) if samples is not None else []
            if eos:
                got = got + ex.flush()
        except Exception as e:  # noqa: BLE001 - one stream's failure is a row of that stream
            got, ex = [], extractor(self.cfg)
            out.append((key[0], *self._empty(), f"{type(e).__name__}: {e}"))
        wide = len(self._fields()) - 1
        out += [(key[0], *g, *[None] * (wide - len(g))) for g in got]
        return None if eos else ex

    def _fields(self) -> list[list[str]]:
        return [c.split() for c in self.columns.split(", ")]

    def _empty(self) -> list[None]:
        return [None] * (len(self._fields()) - 2)

    def _advance(self, key, came: dict, give_up: bool, close: bool = False):
        """Rows of all chunks that are due, of those that ``came`` now and those that waited; whether the stream has ended. With
        ``close`` it ends here and leaves no mark."""
        held = self.state.get()
        if held is None and self.ended.get() is not None:
            return [], True
        blob, due, waiting, few = held or (None, 0, 0, None)  # waiting: under keys of their own
        ex, out, keyed = self._load(blob), [], waiting > 0
        few = pickle.loads(few) if few is not None else {}
        came = few | {k: v for k, v in came.items() if k >= due and k not in few and not (waiting and self.early.containsKey((k,)))}
        while ex is not None and (came or waiting):
            if due in came:
                chunk = came.pop(due)
            elif waiting and self.early.containsKey((due,)):
                samples, eos, reset = self.early.getValue((due,))
                self.early.removeKey((due,))
                waiting, chunk = waiting - 1, (None if samples is None else np.frombuffer(samples, "<f4"), eos, reset)
            elif len(came) + waiting > self.max_gap or give_up:
                then = min([*came, *(k[0] for k in self.early.keys())] if waiting else came)
                out.append((key[0], *self._empty(), f"chunks {due} to {then - 1} are missing"))
                due = then
                continue
            else:
                break
            due += 1
            ex = self._pushed(key, ex, chunk, out)
        if ex is not None and close:
            self._pushed(key, ex, (None, True, False), out)
        if ex is None or close:
            if blob is not None:
                self.state.clear()
            if keyed:
                self.early.clear()
            if not close:
                self.ended.update((True,))
            return out, True
        if waiting or len(came) > FEW or sum(x.nbytes for x, _, _ in came.values() if x is not None) > FEW_BYTES:
            for k, (samples, eos, reset) in came.items():
                self.early.updateValue((k,), (None if samples is None else samples.astype("<f4").tobytes(), eos, reset))
            waiting, came = waiting + len(came), {}
        self.state.update((pickle.dumps(ex), int(due), int(waiting), pickle.dumps(came) if came else None))
        self._waits = bool(waiting or came)
        return out, False

    def _rows(self, out: list) -> Iterator[pd.DataFrame]:
        """What Spark takes for the rows of a stream."""
        frame = pd.DataFrame(out, columns=[name for name, _ in self._fields()])
        yield frame.astype({name: "Int64" for name, kind in self._fields() if kind == "bigint"})

    @staticmethod
    def _chunks(rows: Iterator[pd.DataFrame], at: str | None) -> Iterator[tuple]:
        """seq, samples, eos, reset and time of each row that Spark brings."""
        for pdf in rows:
            resets = pdf["reset"] if "reset" in pdf else [False] * len(pdf)
            yield from zip(pdf["seq"], pdf["samples"], pdf["eos"], resets, pdf["seq"] if at is None else pdf[at], strict=True)

    def _timer(self, when: int | None) -> None:
        for t in list(self.handle.listTimers()):
            if when is None or self.event_time is None or t < when:
                self.handle.deleteTimer(t)
            else:
                when = None  # a later one is set
        if when is not None:
            self.handle.registerTimer(int(when))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        came, last = {}, 0
        for seq, samples, eos, reset, at in self._chunks(rows, self.event_time):
            came.setdefault(int(seq), (None if samples is None else np.asarray(samples, np.float32), bool(eos), bool(reset)))
            if self.event_time is not None:
                last = max(last, int(at.timestamp() * 1000))
        out, ended = self._advance(key, came, False)
        if self.event_time is not None:
            self._timer(last + self.patience_ms)
        elif self.patience_ms is not None:
            waits = ended or self._waits
            self._timer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms if waits else None)
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.ended.get() is not None:
            self.ended.clear()
            return
        if not self.state.exists():
            return
        # by event time it has been silent for too long
        out, ended = self._advance(key, {}, True, self.event_time is not None)
        if self.event_time is None and ended:
            self._timer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield from self._rows(out)

    def close(self) -> None:
        pass


def _whole(x) -> int | None:
    """A whole number of any kind; None for a missing one."""
    if x is None or type(x) is int:
        return x
    if pd.isna(x):
        return None
    if x != int(x):
        raise ValueError(f"{x} is no whole number")
    return int(x)


class RowsOf:
    """Rows instead of data frames on both sides of a processor: a frame costs more than all else that is done for a stream with
    few chunks in a batch."""

    @staticmethod
    def _chunks(rows: Iterator[Row], at: str | None) -> Iterator[tuple]:
        for r in rows:
            when: datetime | None = r[at] if at else None
            if when is not None and when.tzinfo is None:
                when = when.replace(tzinfo=timezone.utc)
            yield r["seq"], r["samples"], r["eos"], "reset" in r.__fields__ and r["reset"], when

    def _rows(self, out: list) -> Iterator[Row]:
        row = Row(*(name for name, _ in self._fields()))
        whole = [kind == "bigint" for _, kind in self._fields()]
        for values in out:
            yield row(*(_whole(v) if w else v for v, w in zip(values, whole, strict=True)))


class EmbeddingProcessor(HashProcessor):
    """The same with an embedder; the model stays out of the state."""

    columns = "stream_id string, t_ms bigint, vector array<float>, error string"

    def __init__(self, cfg: Embedder, model, max_gap: int = 64, patience_ms: int | None = None, event_time: str | None = None):
        super().__init__(lambda: EmbeddingStream(cfg, self.model), max_gap, patience_ms, event_time)
        self.model = model

    def _load(self, blob: bytes | None):
        ex = super()._load(blob)
        ex.model = self.model
        return ex


class HashRows(RowsOf, HashProcessor):
    pass


class EmbeddingRows(RowsOf, EmbeddingProcessor):
    pass


def _transformed(chunks: DataFrame, processor: HashRows | EmbeddingRows) -> DataFrame:
    if processor.event_time is not None and processor.patience_ms is None:
        raise errors.ConfigError("event time needs a patience_ms")
    mode = "None" if processor.patience_ms is None else "ProcessingTime" if processor.event_time is None else "EventTime"
    return chunks.groupBy("stream_id").transformWithState(statefulProcessor=processor, outputStructType=processor.columns, outputMode="Append", timeMode=mode)


def stream_embeddings(chunks: DataFrame, cfg: Embedder, model, max_gap: int = 64, patience_ms: int | None = None, event_time: str | None = None) -> DataFrame:
    """stream_id, t_ms, vector, error: a vector of every full window of each stream. model: as ``neural.embed`` takes it."""
    apply = neural.onnx_embedding(model) if isinstance(model, str) else model
    return _transformed(chunks, EmbeddingRows(cfg, lambda window: neural.windows_to_vectors(window, cfg, apply)[1][0], max_gap, patience_ms, event_time))


def stream_hashes(chunks: DataFrame, cfg=Wang(), max_gap: int = 64, patience_ms: int | None = None, event_time: str | None = None) -> DataFrame:
    """chunks: a streaming table (stream_id, seq, samples, eos [, reset] [, an event time]). Needs the RocksDB state store. ``cfg``
    may be a callable that gives an ``extension.StreamingFingerprinter`` of one's own, of a class that the executors can import. With
    ``patience_ms`` and no ``event_time`` the query has timers of processing time and runs batches without data, so it needs a
    trigger that doesn't end by itself; ``event_time`` names a column that has a watermark."""
    return _transformed(chunks, HashRows(cfg, max_gap, patience_ms, event_time))

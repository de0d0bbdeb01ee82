"""Phrase collocation mining: merged count-min sketches, an exact second pass over what they leave, scores, subsumption.

1. Every task counts the runs of 1 to ``longest`` words of its pieces in a count-min sketch of two rows, by hashes of
   language and words; equal runs of some megabytes of text are one update. Sketches are summed cell by cell in a tree of
   ``FAN`` at a time, one block of cells in memory. A cell never holds less than the true count of a run it belongs to, so
   a run with a cell under ``min_count`` is rare for sure: one bit a cell says so.
2. The second pass counts exactly, as words and not hashes, the runs that both bits let through and whose shorter runs
   passed. Whatever reaches ``min_count`` is among them; what the sketch let through wrongly is dropped by its count.
3. All parts of a frequent phrase are at least as frequent, so each cut finds its two parts in the same table. Products
   are decimals of 38 digits: 1000 * a * n and l * r are exact below that.
4. A phrase inside a longer candidate with the same count is inside one that is longer by a single word with that count
   too (counts fall as runs grow), so only a candidate's two runs of one word less are looked up.

The sketch has a cell for every ``min_count`` bytes of text, up to ``WIDTH``: that is 13 GB of text at ``MIN_COUNT``. A cell stops
at ``min_count``, so it takes a byte there: a task holds 256 MB at most, and the two bit rows, broadcast to all tasks, take 32 MB at
most. Beyond that width it lets more through (the results stay exact, the second pass counts more): give a larger ``min_count``
with a larger corpus. The tables of frequent phrases grow with the corpus and are joined by shuffles
unless they are counted and small.

Defined results: null and empty texts hold no word; a null lang is ``und``, as is a lang of that name; rows of repeated
or null doc_id count each; other columns are ignored; an empty table gives no row. A text longer than ``PART_BYTES`` is
worked on in parts that end at a piece's end, so only a single piece must fit in memory. Equal scores and counts are
ordered by the bytes of the phrase, and equal cuts by the shorter first part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonorel.llm import common

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: Cells of a sketch's row at most, and of a block of them.
WIDTH, BLOCK = 1 << 27, 1 << 16
ROWS = 2
#: Sketches that one step of merging sums.
FAN = 64
#: Bytes of text that are counted before they are added to the sketch or sent on.
PART_BYTES = 2 << 20

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_M1, _M2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M1
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(31))


def _parts(data: bytes):
    """``data`` in parts of PART_BYTES or little more, cut at line ends only."""
    at = 0
    while len(data) - at > PART_BYTES and (cut := data.find(b"\n", at + PART_BYTES)) >= 0:
        yield data[at:cut]
        at = cut
    yield data[at:] if at else data


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _grouped(key: np.ndarray):
    """(number of each entry's value, place of one entry of each value, count of each value)"""
    order = np.argsort(key)
    s = key[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    number = np.empty(len(key), np.int64)
    counts = np.diff(np.append(starts, len(key)))
    number[order] = np.repeat(np.arange(len(starts)), counts)
    return number, order[starts], counts


class Runs:
    """All different runs of words of some pieces of text, level by level of their length."""

    def __init__(self, texts: list[tuple[str, bytes]]):
        """texts: (language, folded bytes)"""
        self.flat: list[bytes] = []
        lens, langs, names = [], [], _Numbers()
        for lang, data in texts:
            k = names[lang]
            for piece in data.split(b"\n"):
                if w := piece.split():
                    self.flat += w
                    lens.append(len(w))
                    langs.append(k)
        self.langs, n = list(names), len(self.flat)
        vocabulary = _Numbers()
        word = np.fromiter(map(vocabulary.__getitem__, self.flat), np.int64, n)
        lens = np.array(lens, np.int64)
        self.left = np.repeat(np.cumsum(lens), lens) - np.arange(n)  # words from here to the piece's end
        self.lang = np.repeat(np.array(langs, np.int64), lens)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
        of_lang = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in self.langs], np.uint64)
        self.at = np.arange(n)
        self.size = 1
        if n:
            self.number, rep, self.counts = _grouped(self.lang * len(vocabulary) + word)
            self.rep = rep
            self.first = self.number, _mixed(of_lang[self.lang[rep]] * _M2 + hashes[word[rep]])
            self.hash = self.first[1]

    def longer(self, kept: np.ndarray | None) -> bool:
        """Go on to the runs longer by a word, of those whose number is ``kept`` (None: all) only; False if there are none."""
        n = len(self.flat)
        ids = np.full(n + 1, -1)
        ids[self.at] = self.number if kept is None else np.where(kept[self.number], self.number, -1)
        at = self.at[(self.left[self.at] > self.size) & (ids[self.at] >= 0)]
        at = at[ids[at + 1] >= 0] if self.size > 1 or kept is not None else at
        if not len(at):
            return False
        word, of_word = self.first
        last = word[at + self.size]
        self.number, rep, self.counts = _grouped(ids[at] * len(of_word) + last)
        self.hash = _mixed(self.hash[ids[at[rep]]] * _M1 + of_word[last[rep]])
        self.at, self.rep, self.size = at, at[rep], self.size + 1
        return True


def _runs(batches):
    """Runs of some megabytes of the texts of batches (lang, text) at a time."""
    some, size = [], 0
    for b in common.pieces(batches):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            if not text:
                continue
            for data in _parts(text.encode().translate(_FOLD)):
                some.append((lang, data))
                size += len(data)
                if size >= PART_BYTES:
                    yield Runs(some)
                    some, size = [], 0
    if some:
        yield Runs(some)


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return (hashes >> np.uint64(32 * row)).astype(np.int64) & (width - 1)


def width_for(size: int, min_count: int) -> int:
    """Cells of a row for so many bytes of text."""
    width = BLOCK
    while width < WIDTH and width * max(1, min_count) < size:
        width *= 2
    return width


def _kind(most: int) -> type:
    """The least type that holds counts up to ``most``."""
    return next(t for t in (np.uint8, np.uint16, np.uint32) if most <= np.iinfo(t).max or t is np.uint32)


def _add(table: np.ndarray, cells: np.ndarray, counts: np.ndarray, most: int) -> None:
    """Add counts to cells, which may repeat; cells stop at ``most``."""
    both = (cells << 32) | np.minimum(counts, most)
    both.sort()
    cell = both >> 32
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    at, sums = cell[starts], np.add.reduceat(both & 0xFFFFFFFF, starts)
    table[at] = np.minimum(table[at] + sums, most)


def _summed(rows: DataFrame, most: int) -> DataFrame:
    """Sums, up to ``most``, of the blocks (row, block, part, cells) of equal row, block and part // FAN."""
    schema, kind = "row int, block int, part int, cells binary", _kind(most)

    def run(batches):
        key, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in key], pa.array([total.astype(kind).tobytes()], pa.binary())], names=["row", "block", "part", "cells"])

        for b in batches:
            for i in range(b.num_rows):
                now = tuple(b.column(c)[i].as_py() for c in ("row", "block", "part"))
                cells = np.frombuffer(b.column("cells")[i].as_buffer(), kind).astype(np.int64)
                if now == key:
                    total = np.minimum(total + cells, most)
                else:
                    if key is not None:
                        yield done()
                    key, total = now, cells
        if key is not None:
            yield done()

    keys = ["row", "block", "part"]
    up = rows.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
    return up.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def sketch(docs: DataFrame, width: int, longest: int = LONGEST, most: int = MIN_COUNT) -> DataFrame:
    """row, block, cells: the merged sketch of all runs of the texts (lang, text), by blocks of cells that stop at ``most``."""
    most = max(1, min(most, 2**32 - 1))
    kind = _kind(most)

    def run(batches):
        table = np.zeros((ROWS, width), kind)
        for runs in _runs(batches):
            more = bool(runs.flat)
            while more:
                for row in range(ROWS):
                    _add(table[row], _cells(runs.hash, row, width), runs.counts, most)
                more = runs.size < longest and runs.longer(None)
        part = TaskContext.get().partitionId()
        for row in range(ROWS):
            for at in range(0, width, BLOCK):
                cells = table[row, at : at + BLOCK]
                if cells.any():
                    yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in (row, at // BLOCK, part)], pa.array([cells.tobytes()], pa.binary())], names=["row", "block", "part", "cells"])

    merged = common.materialize(_summed(docs.mapInArrow(run, "row int, block int, part int, cells binary"), most), "sketch")
    while merged.agg(F.max("part")).first()[0]:
        merged = common.materialize(_summed(merged, most), "sketch")
    return merged.select("row", "block", "cells")


def frequent_bits(cells: DataFrame, width: int, least: int) -> np.ndarray:
    """Whether each cell of a sketch up to ``least`` holds as much, packed, a row each: ROWS * width / 8 bytes."""
    most = max(1, min(least, 2**32 - 1))

    def run(batches):
        for b in batches:
            bits = [np.packbits(np.frombuffer(c.as_buffer(), _kind(most)) >= most).tobytes() for c in b.column("cells")]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("block"), pa.array(bits, pa.binary())], names=["row", "block", "bits"])

    out = np.zeros((ROWS, width // 8), np.uint8)
    for r in cells.mapInArrow(run, "row int, block int, bits binary").toLocalIterator():
        at = r.block * BLOCK // 8
        out[r.row, at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def _counted(docs: DataFrame, bits: np.ndarray, width: int, longest: int) -> DataFrame:
    """lang, phrase, c: counts of the runs that the bits let through, several rows a run; phrase null: all words of lang."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def passed(hashes: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashes), bool)
        for row in range(ROWS):
            cell = _cells(hashes, row, width)
            ok &= (shared.value[row, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
        return ok

    def run(batches):
        for runs in _runs(batches):
            flat, langs = runs.flat, runs.langs
            n = np.bincount(runs.lang, minlength=len(langs))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([None] * len(langs), pa.string()), pa.array(n)], names=["lang", "phrase", "c"])
            more = bool(flat)
            while more:
                kept = passed(runs.hash)
                rep, size = runs.rep[kept], runs.size
                at = rep.tolist()
                phrases = [flat[i] for i in at] if size == 1 else [b" ".join(flat[i : i + size]) for i in at]
                lang = pa.DictionaryArray.from_arrays(pa.array(runs.lang[rep], pa.int32()), pa.array(langs, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang, pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(runs.counts[kept])], names=["lang", "phrase", "c"])
                more = size < longest and runs.longer(kept)

    return docs.mapInArrow(run, "lang string, phrase string, c bigint")


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, f of all runs of 1 to ``longest`` words that occur ``min_count`` times or more, and the number of all
    words of each lang with a null phrase; written."""
    some = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = width_for(size, min_count)
    # a task's sketch goes through the shuffle: tasks have several times its bytes of text if there is enough of it
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // (4 * ROWS * width))
    bits = frequent_bits(sketch(some.coalesce(tasks), width, longest, min_count), width, min_count)
    counts = _counted(some, bits, width, longest).groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
    return common.materialize(counts.filter((F.col("f") >= min_count) | F.col("phrase").isNull()), "frequent")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each lang of ``docs`` (lang, text)."""
    found = frequent(docs, min_count, longest)
    # a row of the table of frequent phrases takes some 64 bytes in a broadcast
    known = common.small_side(found.filter("phrase IS NOT NULL"), 64)
    words = F.split("phrase", " ")
    phrases = found.filter("phrase IS NOT NULL").select("lang", "phrase", F.col("f").alias("a"), words.alias("w")).filter(F.size("w") > 1)
    shorter = F.array(F.array_join(F.slice("w", 1, F.size("w") - 1), " "), F.array_join(F.slice("w", 2, F.size("w") - 1), " "))
    inside = phrases.filter(F.size("w") > 2).select("lang", F.explode(shorter).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    side = lambda key, value: known.select("lang", F.col("phrase").alias(key), F.col("f").alias(value))
    total = common.small_side(common.materialize(found.filter("phrase IS NULL").select("lang", F.col("f").alias("n")), "words"), 64)
    rated = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(total, "lang")
    wide = lambda c: f"cast({c} AS decimal(19, 0))"
    rated = rated.withColumn("score", F.expr(f"(cast({wide('a')} * {wide('n')} AS decimal(38, 0)) * 1000) div ({wide('l')} * {wide('r')})"))
    best = rated.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

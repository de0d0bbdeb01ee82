"""Token ids as flat binary files with 64-bit document offsets.

Documents are dealt out by ranges of their id, sorted, and encoded; each partition writes one pair of files:

* ``NNNNNN.bin``: the ids of its documents, one after the other, little-endian unsigned integers of 16 bits
  where the vocabulary allows it, else 32;
* ``NNNNNN.idx``: its documents' offsets, n + 1 little-endian unsigned 64-bit integers counted in ids, then
  their n doc_ids as 64-bit integers.

A manifest of one row a partition gives counts, and prefix sums over it the base of every partition, so any
document's place in the whole stream is its partition's base plus its own offset. Readers map the files
into memory. A task writes under a name of its own and renames, so one that is run again does no harm.

Defined results: null is encoded as the empty text; rows that repeat a doc_id follow one another, ordered by
text; rows without a doc_id come first; an empty table gives no partitions and no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorel.llm import common

#: Chunks of text (a run of ASCII white space and what follows) a worker remembers before it starts anew.
MEMO = 700_000
#: The same where only numbers of ids are wanted, beside stages that need the executor's memory.
COUNTER_MEMO = 150_000
#: Chunks given to the library in one go: what it returns takes some hundred bytes an id.
LEARNED = 20_000
#: Characters of text that are cut together: of each distinct chunk in them one is looked up.
GROUP = 1 << 19

_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
# A word in ASCII or Latin-1 letters and ASCII punctuation behind it (none that starts a contraction).
_WORD_AND_MARKS = re.compile(r"((?:\0|\n)?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]+)")
# Stands between the chunks of a text; it is one of ``_ODD``.
_SEAM = "\x1f"
# Texts without these can be cut at each blank and line end.
_RUNS = ("  ", "\n ", " \n", "\n\n", "\t", "\r", "\v", "\f")
# White space or what some engine takes for it beyond the ASCII kinds, and NUL: texts with it aren't cut into chunks.
_ODD = re.compile("[\0\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f-\u2064\u3000\ufeff]")


class ChunkEncoder:
    """The library's ids, each distinct chunk encoded once.

    The byte-level pattern never joins what lies on both sides of a run of ASCII white space, and the run goes
    with what follows; so a text's ids are those of its chunks. Texts with other white space or with a special
    token's text are given to the library whole.
    """

    limit: int | None = None  # of the memo; None: ``MEMO``

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        vocab = self.lib.get_vocab()
        self.leads = np.zeros(max(vocab.values()) + 1, bool)  # ids whose text starts with a blank
        self.leads[[i for token, i in vocab.items() if token[0] == "\u0120"]] = True
        self.leading = not any(" " in s for s in self.special)
        # a blank and ASCII letters are one piece of the pattern and their own letters in the vocabulary: the model alone gives the same ids
        pre = json.loads(self.lib.to_str())["pre_tokenizer"] or {}
        alone = self.lib.normalizer is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        self.model = self.lib.model if alone else None
        self.memo: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Many short texts in one go. Where each is a blank and a word, the id that holds the blank is a word's first; elsewhere a
        special token between two of them keeps them apart and marks the seam."""
        if self.leading and all(c[:1] == " " < c[1:2] for c in chunks):
            ids = np.array(self.lib.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, self.kind)
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) == len(chunks):
                starts = (starts * self.kind.itemsize).tolist()
                return self._parts(ids.tobytes(), starts, [*starts[1:], ids.nbytes])
        if not self.special:
            return self._ids(chunks)
        seam, width = self.special[0], self.kind.itemsize
        ids = np.array(self.lib.encode_batch_fast([seam.join(chunks)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.append(np.flatnonzero(ids == self.lib.token_to_id(seam)), len(ids))
        starts = np.append(0, ends[:-1] + 1)
        return self._parts(ids.tobytes(), (starts * width).tolist(), (ends * width).tolist())

    @staticmethod
    def _parts(raw: bytes, starts: list[int], ends: list[int]) -> list[bytes]:
        return [raw[a:z] for a, z in zip(starts, ends, strict=True)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Words of ASCII letters that stand behind a blank."""
        return [np.array([t.id for t in self.model.tokenize(f"\u0120{w}")], self.kind).tobytes() for w in words]

    @staticmethod
    def _cut(text: str) -> str:
        """Chunks of a text, as memo keys with seams between them: a chunk that starts with a blank goes without it, the first after a NUL."""
        if any(x in text for x in _RUNS):
            cs = _CHUNK.findall(text)
            return _SEAM.join([f"\0{cs[0]}", *[c[1:] if c[0] == " " and c[1:2] != "\n" else c if c[0] == "\n" else f"\0{c}" for c in cs[1:]]])
        return "\0" + text.replace("\n", f"{_SEAM}\n").replace(" ", _SEAM)

    @staticmethod
    def _chunk(key: str) -> str:
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else f" {key}"

    def _learn(self, keys: set[str]) -> None:
        """Put chunks into the memo. A word and the punctuation behind it are encoded apart, as the pattern does."""
        parts = {k: (m[1], f"\0{m[2]}") for k in keys if not k[-1:].isalpha() and (m := _WORD_AND_MARKS.fullmatch(k))}
        new = keys.difference(parts).union(x for p in parts.values() for x in p).difference(self.memo)
        plain = [k for k in new if k.isascii() and k.isalpha()] if self.model else []
        self.memo.update(zip(plain, self._word_ids(plain), strict=True))
        new.difference_update(plain)
        words = [k for k in new if k[:1] > " "]
        for order in (words, list(new.difference(words))):
            for at in range(0, len(order), LEARNED):
                some = order[at : at + LEARNED]
                self.memo.update(zip(some, self._chunk_ids([self._chunk(k) for k in some]), strict=True))
        get = self.memo.__getitem__
        self.memo.update((k, get(word) + get(marks)) for k, (word, marks) in parts.items())

    def _forget(self, used: set[str], most: int) -> None:
        """Keep ``most`` chunks: of those in use, then of the others, the newest."""
        keep, rest = [k for k in self.memo if k in used][-most:], [k for k in self.memo if k not in used]
        self.memo = {k: self.memo[k] for k in rest[max(0, len(rest) - most + len(keep)) :] + keep}

    def release(self) -> None:
        """Give the memo's memory back: Spark's workers outlive their stage and would hold it beside the next ones."""
        self.memo = {}
        common.give_back()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        whole = [bool(_ODD.search(t)) or any(s in t for s in self.special) for t in texts]
        cut = pc.split_pattern(pa.array([self._cut(t) for t, w in zip(texts, whole, strict=True) if not w], pa.large_string()), _SEAM)
        distinct = cut.values.dictionary_encode()
        keys = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.memo) > (most := self.limit or MEMO):  # those go that are older and not in use
            self._forget(set(keys), most // 2)
        found = list(map(self.memo.get, keys))
        holes = [i for i, v in enumerate(found) if v is None]
        if holes:
            self._learn({keys[i] for i in holes})
            for i in holes:
                found[i] = self.memo[keys[i]]
        together = iter(self._together(found, distinct.indices.to_numpy(), cut.offsets.to_numpy()) if len(cut) else [])
        rest = iter(self._ids([t for t, w in zip(texts, whole, strict=True) if w]) if any(whole) else [])
        return [next(rest if w else together) for w in whole]

    def _together(self, found: list[bytes], chunks: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text, whose chunks (places in ``found``) are those from its offset to the next."""
        got, ends = list(map(found.__getitem__, chunks.tolist())), offsets.tolist()
        return [b"".join(got[a:z]) for a, z in zip(ends, ends[1:])]


class ChunkCounter(ChunkEncoder):
    """Numbers of ids instead of the ids."""

    limit = COUNTER_MEMO

    def _ids(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, raw: bytes, starts: list[int], ends: list[int]) -> list[int]:
        width = self.kind.itemsize
        return [(z - a) // width for a, z in zip(starts, ends, strict=True)]

    def _word_ids(self, words: list[str]) -> list[int]:
        return [len(self.model.tokenize(f"\u0120{w}")) for w in words]

    def _together(self, found: list[int], chunks: np.ndarray, offsets: np.ndarray) -> list[int]:
        return np.add.reduceat(np.array(found, np.int64)[chunks], offsets[:-1]).tolist()


_loaded: dict[tuple[str, type], ChunkEncoder] = {}


def encoder(path: str, kind: type[ChunkEncoder] = ChunkEncoder) -> ChunkEncoder:
    if (path, kind) not in _loaded:
        _loaded[path, kind] = kind(path)
    return _loaded[path, kind]


def local_path(uri: str) -> str:
    """Place of a shared folder in the file system; other stores have no memory-mapped files."""
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a shared file system, not {u.scheme}")
    return unquote(u.path) if u.scheme else uri


def shard_name(part: int) -> str:
    return f"{part:06d}"


MANIFEST = "part int, n_docs long, n_tokens long, width int"


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str, partitions: int) -> list[tuple[int, int, int, int]]:
    """Write the files of ``docs`` (doc_id, text) into ``folder``; returns the manifest, one row a partition."""
    where = local_path(folder)

    def run(batches):
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        own = Path(where) / f".{shard_name(part)}-{uuid.uuid4().hex}"
        end = np.array([end_id], enc.kind).tobytes()
        offsets, ids, at = [0], [], 0
        own.parent.mkdir(parents=True, exist_ok=True)
        with open(f"{own}.bin", "wb") as out:
            for b in batches:
                texts = [t.as_py() or "" for t in b.column("text")]
                ids += [i.as_py() for i in b.column("doc_id")]
                group, size = [], 0
                for k, t in enumerate(texts):
                    group.append(t)
                    size += len(t)
                    if size >= GROUP or k == len(texts) - 1:
                        for raw in enc.encode_batch(group):
                            out.write(raw)
                            out.write(end)
                            at += len(raw) // enc.kind.itemsize + 1
                            offsets.append(at)
                        group, size = [], 0
        if not ids:
            os.remove(f"{own}.bin")
            return
        with open(f"{own}.idx", "wb") as out:
            out.write(np.array(offsets, "<u8").tobytes())
            out.write(np.array([i if i is not None else np.iinfo(np.int64).min for i in ids], "<i8").tobytes())
        for kind in ("bin", "idx"):
            os.replace(f"{own}.{kind}", Path(where) / f"{shard_name(part)}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([at], pa.int64()), pa.array([enc.kind.itemsize], pa.int32())], names=["part", "n_docs", "n_tokens", "width"])

    # the hash splits a doc_id that very many rows repeat
    h = F.xxhash64("text")
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions, F.col("doc_id"), h).sortWithinPartitions("doc_id", h, "text")
    rows = ranged.mapInArrow(run, MANIFEST).collect()  # one short row a partition
    return sorted(tuple(r) for r in rows)


class Shard:
    """A partition's files, mapped into memory."""

    def __init__(self, folder: str, part: int, width: int):
        stem = Path(local_path(folder)) / shard_name(part)
        head = np.memmap(f"{stem}.idx", "<u8", "r")
        n = (len(head) - 1) // 2
        self.offsets = head[: n + 1]
        self.doc_ids = head[n + 1 :].view("<i8")
        self.ids = np.memmap(f"{stem}.bin", f"<u{width}", "r")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, i: int) -> np.ndarray:
        return self.ids[int(self.offsets[i]) : int(self.offsets[i + 1])]


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, folder: str, manifest: list[tuple[int, int, int, int]], rows_at_once: int = 4096) -> DataFrame:
    """Each document's place in the whole stream and a digest of its ids, read back from the files."""
    base, slices = 0, []
    for part, n_docs, n_tokens, width in manifest:
        slices += [(part, width, base, lo, min(lo + rows_at_once, n_docs)) for lo in range(0, n_docs, rows_at_once)]
        base += n_tokens

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                s = Shard(folder, r["part"], r["width"])
                lo, hi = r["lo"], r["hi"]
                crc = [zlib.crc32(s.document(i).astype("<u4").tobytes()) for i in range(lo, hi)]
                none = np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if d == none else d for d in s.doc_ids[lo:hi].tolist()], pa.int64()),
                        pa.array(r["base"] + s.offsets[lo:hi].astype(np.int64)),
                        pa.array(np.diff(s.offsets[lo : hi + 1].astype(np.int64))),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    frame = spark.createDataFrame(slices, "part int, width int, base long, lo long, hi long")
    return frame.repartition(max(1, min(len(slices), 4 * spark.sparkContext.defaultParallelism + len(manifest)))).mapInArrow(run, READ)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` into a new folder of the shared place and read it back."""
    spark = docs.sparkSession
    folder = common.new_path(spark, "tokens")
    manifest = write(docs, tokenizer, end_id, folder, max(1, docs.rdd.getNumPartitions()))  # as many files as the input has splits
    return read(spark, folder, manifest)

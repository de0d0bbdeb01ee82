"""BPE encoding and decoding by speculate and verify.

A greedy longest match proposes the tokens of every new word. A proposal is right if each token encodes as
itself and every adjacent pair is compatible, i.e. merging the pair's text alone gives back just this pair;
pairs are packed into integers and checked against a table in one vectorised look-up per batch. Only words
that fail go through exact merging. Words repeat, so results are kept in a bounded memo.

The vocabulary is that of a byte-level BPE with an end-of-word mark, lower-cased and NFC-normalised, whose
white space is dropped; its file's path is a parameter. What is a letter and how it is lowered is left to the library's
own normaliser and splitter, which see each distinct chunk (text between ASCII white space) once: no normalisation or
word reaches over a blank.

Defined results: null is encoded as the empty text (no ids, empty decoding); repeated rows get equal results;
special tokens in a text become their ids, as the library does; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

END = "</w>"
#: Words and chunks a worker remembers before it starts anew.
MEMO = 600_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): r for r, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.vocab))
        self.letters = byte_letters()
        self.table = str.maketrans({i: c for i, c in enumerate(self.letters)})
        self.normalizer = Tokenizer.from_file(path).normalizer
        splits = [x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        pattern = splits[0]["pattern"]["Regex"]
        self.splitter = pre_tokenizers.Split(Regex(pattern), splits[0]["behavior"].lower(), splits[0]["invert"])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.self_encoding: dict[int, bool] = {}
        self.good = np.empty(0, np.uint64)  # sorted packed pairs known to be compatible
        self.bad = np.empty(0, np.uint64)
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[bytes, tuple[bytes, str]] = {}
        self.verified = self.merged = 0

    # --- words -----------------------------------------------------------------------------------------

    def symbols(self, word: str) -> list[str]:
        s = list(word.encode().decode("latin-1").translate(self.table))
        s[-1] += END
        return s

    def merge(self, s: list[str]) -> list[str]:
        """Exact merging: the pair of least rank, leftmost first, until none is left."""
        s, rank = list(s), self.rank
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if s[i] is None or j >= n or rank.get((s[i], s[j])) != r:
                continue  # one of the pair has been merged since
            s[i] += s[j]
            s[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((s[i], s[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank.get((s[h], s[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in s if x is not None]

    def split_symbols(self, text: str) -> list[str]:
        """Single letters of a token's text, the end mark kept with the last."""
        if text.endswith(END) and len(text) > len(END):
            s = list(text[: -len(END)])
            s[-1] += END
            return s
        return list(text)

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match, or None if some letter has no token."""
        body = "".join(self.symbols(word))
        out, at, vocab = [], 0, self.vocab
        while at < len(body):
            if body.startswith(END, at):
                return None  # the mark can't stand alone
            for n in range(min(self.longest, len(body) - at), 0, -1):
                if (i := vocab.get(body[at : at + n])) is not None:
                    out.append(i)
                    at += n
                    break
            else:
                return None
        return out

    def encodes_itself(self, i: int) -> bool:
        if (known := self.self_encoding.get(i)) is None:
            known = self.self_encoding[i] = self.merge(self.split_symbols(self.names[i])) == [self.names[i]]
        return known

    def compatible(self, packed: np.ndarray) -> np.ndarray:
        """Which packed pairs (left << 32 | right) hold; pairs not met before are merged once and kept."""
        fresh = np.unique(packed[~(within(packed, self.good) | within(packed, self.bad))])
        if len(fresh):
            ok = np.empty(len(fresh), bool)
            for j, p in enumerate(fresh.tolist()):
                a, b = self.names[p >> 32], self.names[p & 0xFFFFFFFF]
                ok[j] = self.merge(self.split_symbols(a) + self.split_symbols(b)) == [a, b]
            self.good = np.union1d(self.good, fresh[ok])
            self.bad = np.union1d(self.bad, fresh[~ok])
        return within(packed, self.good)

    def encode_words(self, words: list[str]) -> None:
        """Put every word into the memo."""
        drafts = [self.propose(w) for w in words]
        sizes = np.array([len(d) if d else 0 for d in drafts])
        flat = np.array([i for d in drafts if d for i in d], np.uint64)
        owner = np.repeat(np.arange(len(words)), sizes)
        ok = sizes > 0
        if len(flat):
            own = np.array([self.encodes_itself(int(i)) for i in np.unique(flat)])
            ok[owner[~own[np.searchsorted(np.unique(flat), flat)]]] = False
            same = owner[1:] == owner[:-1]
            pairs = ((flat[:-1] << np.uint64(32)) | flat[1:])[same]
            if len(pairs):
                ok[owner[1:][same][~self.compatible(pairs)]] = False
        for w, d, good in zip(words, drafts, ok.tolist(), strict=True):
            if not good:
                d = [self.vocab[t] for t in self.merge(self.symbols(w)) if t in self.vocab]
                self.merged += 1
            else:
                self.verified += 1
            self.words[w] = tuple(d)

    # --- texts -----------------------------------------------------------------------------------------

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk as the library normalises and splits it."""
        chunk = chunk.lower() if chunk.isascii() else self.normalizer.normalize_str(chunk)
        if chunk.isascii() and chunk.isalpha():
            return [chunk]
        return [w for w, _ in self.splitter.pre_tokenize_str(chunk)]

    def know(self, chunks: set[bytes]) -> None:
        """Put chunks (texts without ASCII white space) into the memo."""
        if len(self.words) > MEMO:
            self.words.clear()
        split = {c: self.split(c.decode()) for c in chunks}
        fresh = list({w for ws in split.values() for w in ws}.difference(self.words))
        if fresh:
            self.encode_words(fresh)
        for c, ws in split.items():
            ids = [i for w in ws for i in self.words[w]]
            self.chunks[c] = (np.array(ids, "<u4").tobytes(), " ".join(map(self.names.__getitem__, ids)))

    def segments(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut and "<|" in text else [text]

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        split = [[s if s in self.special else (s.lower() if s.isascii() else s).encode().split() for s in self.segments(t)] for t in texts]
        needed = {c for t in split for s in t if not isinstance(s, str) for c in s}
        missing = needed.difference(self.chunks)
        if len(self.chunks) + len(missing) > MEMO:
            self.chunks.clear()
            missing = needed
        if missing:
            self.know(missing)
        out, memo = [], self.chunks
        for t in split:
            ids, words = [], []
            for s in t:
                if isinstance(s, str):
                    ids.append(np.array([self.special[s]], "<u4").tobytes())
                    words.append(s)
                else:
                    got = [memo[c] for c in s]
                    ids += [g[0] for g in got]
                    words += [g[1] for g in got if g[1]]
            out.append((b"".join(ids), " ".join(words)))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0][0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, the form the vocabulary's file (which names no decoder) asks for."""
        return " ".join(map(self.names.__getitem__, ids))


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One encoder a worker and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def texts_in_groups(column: pa.Array, most: int = 4 << 20):
    """Texts (null: empty) in lists of bounded size."""
    group, size = [], 0
    for t in column:
        t = t.as_py() or ""
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode each row's whole text, decode the ids again, and return digests of both."""

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            got = [x for g in texts_in_groups(b.column(1)) for x in bpe.encode_batch(g)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in got]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in got]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids themselves."""

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            got = [np.frombuffer(i, "<u4").astype(np.int64) for g in texts_in_groups(b.column(1)) for i, _ in bpe.encode_batch(g)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<long>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(i.as_py() or []) for i in b.column(1)], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

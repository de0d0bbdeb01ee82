"""Best-fit packing of documents into training sequences of several permitted lengths.

Pieces (documents, those over the longest sequence cut into pieces) are taken from the longest down. Each goes
into the open sequence with the least room that still holds it. If none does, a new one is opened, of the
length that costs least for each token it can be expected to hold from what is left to pack; at the end every
sequence shrinks to the shortest permitted length that holds its contents.

Lengths are token counts of whole texts under a tokenizer file. They are dealt evenly into shards of bounded size and every shard is packed by itself: what is lost is at
most the open ends of one shard, and texts are never shuffled, only (doc_id, length).

Defined results: every row gives one piece or more; null and empty texts are one token long (the end mark each
document gets); rows that repeat a document are packed each; rows without a doc_id keep a null one; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorel.llm import common

SHARD_ROWS = 20_000


@dataclass(frozen=True)
class Lengths:
    """Permitted sequence lengths and what one sequence of each costs."""

    permitted: tuple[int, ...] = (512, 1024, 2048, 4096)
    fixed: float = 64.0  # of every sequence
    quadratic: float = 1 / 32768  # of attention

    def cost(self, c: int) -> float:
        return self.fixed + c + self.quadratic * c * c

    def opened(self, piece: int, left: int) -> int:
        """Length of the sequence to open for a piece when ``left`` tokens, this piece with them, remain."""
        return min((c for c in sorted(self.permitted) if c >= piece), key=lambda c: (self.cost(c) / min(c, left), -c))

    def shrunk(self, content: int) -> int:
        return min(c for c in self.permitted if c >= content)


def pieces(length: int, longest: int) -> list[int]:
    """Lengths of the pieces of a document: full ones, then the rest."""
    full, rest = divmod(length, longest)
    return [longest] * full + ([rest] if rest else [])


def best_fit(sizes: np.ndarray, lengths: Lengths = Lengths()) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin of each piece, its offset there, final length of each bin). sizes: from the longest down."""
    top = max(lengths.permitted)
    stacks: list[list[int]] = [[] for _ in range(top + 1)]  # open bins by the room they have
    room_set = 0  # bit r: some open bin has room r
    room: list[int] = []
    held: list[int] = []
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    left = int(sizes.sum())
    for i, size in enumerate(sizes.tolist()):
        fits = room_set >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = stacks[r].pop()
            if not stacks[r]:
                room_set &= ~(1 << r)
        else:
            b = len(room)
            room.append(lengths.opened(size, left))
            held.append(0)
            r = room[b]
        where[i], offset[i] = b, held[b]
        held[b] += size
        room[b] = r - size
        if room[b]:
            stacks[room[b]].append(b)
            room_set |= 1 << room[b]
        left -= size
    return where, offset, [lengths.shrunk(h) for h in held]


def pack_rows(doc_ids: np.ndarray, row: np.ndarray, n: np.ndarray, lengths: Lengths = Lengths()) -> pd.DataFrame:
    """Pack one shard: documents with their row numbers (which tell repeated rows apart) and lengths."""
    top = max(lengths.permitted)
    count = -(-n // top)
    at = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n[at] - piece * top, top)
    order = np.lexsort((piece, row[at], -size))
    where, offset, final = best_fit(size[order], lengths)
    at, piece, size = at[order], piece[order], size[order]
    return pd.DataFrame({"doc_id": doc_ids[at], "piece": piece, "start": piece * top, "length": size, "bin": where, "capacity": np.array(final, np.int64)[where] if len(final) else where, "offset": offset})


def token_lengths(docs: DataFrame, tokenizer: str | None, memo: int | None = None) -> DataFrame:
    """doc_id, n: ids of each whole text under a byte-level tokenizer file (None: white-space words), with the
    end mark. ``memo``: chunks a worker remembers (None: as many as leave room for other stages)."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if tokenizer is None:
        words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        return some.select("doc_id", (F.size(words) + 1).cast("long").alias("n"))
    from sonorel.llm import bpe, token_files

    def run(batches):
        counter = token_files.encoder(tokenizer, token_files.ChunkCounter)
        counter.limit = memo or token_files.COUNTER_MEMO
        for b in batches:
            n = [x + 1 for g in bpe.texts_in_groups(b.column(1), token_files.GROUP) for x in counter.encode_batch(g)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n"])
        counter.release()

    return some.mapInArrow(run, "doc_id long, n long")


def pack(lengths_table: DataFrame, lengths: Lengths = Lengths(), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, piece, start, length, bin_id, capacity, offset for a written table (doc_id, n)."""
    shards = max(1, -(-lengths_table.count() // shard_rows))
    # a written table's rows keep their numbers; hashed, these fill the shards evenly whatever the ids and partitions are
    numbered = lengths_table.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def run(key, table):
        got = pack_rows(np.arange(table.num_rows), table["row"].to_numpy(), table["n"].to_numpy(), lengths)
        ids = table["doc_id"].combine_chunks().take(pa.array(got.pop("doc_id").to_numpy()))
        base = key[0].as_py() << 32
        return pa.table(
            {
                "doc_id": ids,
                "piece": pa.array(got["piece"], pa.int32()),
                "start": pa.array(got["start"], pa.int64()),
                "length": pa.array(got["length"], pa.int32()),
                "bin_id": pa.array(base + got["bin"], pa.int64()),
                "capacity": pa.array(got["capacity"], pa.int32()),
                "offset": pa.array(got["offset"], pa.int32()),
            }
        )

    return numbered.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length int, bin_id long, capacity int, offset int")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, lengths: Lengths = Lengths(), memo: int | None = None) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text)."""
    return pack(common.materialize(token_lengths(docs, tokenizer, memo), "lengths"), lengths)

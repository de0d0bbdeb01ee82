"""N-gram Jaccard self-join and its connected components, without enumerating the pairs of a group of copies.

A document is the set of its distinct word n-grams; two link when 100 |A n B| >= 90 |A u B| (by default).

1. Equal sets are one class from here on, represented by its least row.
2. A sieve without loss. At high thresholds (``BY_PARTS``): in each class of set sizes the hash space is cut into more
   parts than two linked sets of such sizes can differ in, so linked sets agree on whole parts. A part holds several
   n-grams, so sets agree by chance in no corpus, however large. At lower ones parts would hold too few: a set of n that
   links with anything shares at least ``needed(n)`` of its n-grams with one partner, so, in the order of hashes, the
   first n - needed(n) + l of both sets have l in common. Sets that meet none in their parts, or too few in their
   first n-grams, link with nothing and go. Of what is left all n-grams are counted; sets with fewer than
   ``needed(n)`` n-grams that any other one has go too.
3. T-occurrence search as in DivideSkip: a set's n-grams are ordered by the length of their inverted lists; the
   T - 1 longest lists are set aside, the others are merged (a join on the n-gram), and the candidates so found are
   probed in all lists, which gives the exact overlap. Each list's first member is tried before; pairs that are
   connected already aren't looked at again.
4. Groups of near copies would make long lists of everything: whoever has long lists among its short ones belongs to
   the longest of them, its hub. Hubs of at least ``HOT`` members are blocks, and the n-grams that more than half of them
   hold are the block's centre. Members near the centre are the block's own; all their possible partners (whoever
   shares a merged list with one of them) are looked at in the block, as differences from the centre. With
   s(x) = (|x| threshold slack) - (its differences), two members with s(x) + s(y) >= 0 link whatever their
   differences are; so all members that reach the largest s link to its holder, and only the others have to be
   searched for, in the inverted lists of differences: x and y link when they share at least T(x, y) > 0 of them.
   The lists of n-grams beyond the centre are short. The lists of centre n-grams that members lack are long; only who
   shares nothing beyond the centre has to be looked for there, which bounds both sizes.
5. Links give the components, over classes, then over documents.

No list is cut and no candidate is dropped; groups of any size are spread by their members, and n-grams, classes and
components that hold much of a table are joined by broadcast (``common.counted_join``).

Defined results: null and word-free texts have an empty set and link with nothing (they are their own
component); texts shorter than n words have their whole word sequence as one n-gram; rows that repeat a doc_id, or have
none, are taken one by one; a component is named after its least doc_id (null if none of its rows has one); extra
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorel.llm import common

WORDS = 3
THRESHOLD = 90  # of 100
#: Words whose hashes a worker remembers before it starts anew.
MEMO = 200_000
#: Members from which a group of near copies is searched as a block.
HOT = 64
#: Threshold from which sets are sieved by parts.
BY_PARTS = 88
#: A part that holds up to so many n-grams says little about its set.
POOR = 2

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text."""
    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z alone, splits at ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = _mix(out * _C[i % len(_C)] + h[i : len(h) - k + 1 + i] + np.uint64(i))
    return np.unique(out)


def needed(n: int, threshold: int) -> int:
    """N-grams that a set of n has in common with any set it links with, at least."""
    return -(-threshold * n // 100)


def sure(n: int, threshold: int) -> int:
    """N-grams that the first ones of a set of n have in common with those of any linked set that isn't smaller."""
    k = needed(n, threshold)
    return min(k, 1 + (n - k) // 3)


def first_ones(s: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """The n-grams of ``s`` (sorted hashes) among which linked sets meet: ``sure`` of the smaller set's size are in both."""
    n = len(s)
    return s[: n - needed(n, threshold) + sure(n, threshold)] if n else s


@lru_cache(maxsize=1 << 16)
def size_class(n: int, threshold: int) -> tuple[int, int]:
    """(class, largest size in it) of sets of n elements: sizes of linked sets lie in the same class or in
    neighbouring ones."""
    c, lo = 0, 1
    while True:
        hi = lo * 100 // threshold  # the largest size that can link with the smallest of this class
        if n <= hi:
            return c, hi
        c, lo = c + 1, hi + 1


def most_apart(total: int, threshold: int) -> int:
    """Largest difference of two linked sets whose sizes sum to ``total``."""
    return total * (100 - threshold) // (100 + threshold)


def part_keys(s: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Keys on which two linked, different sets are sure to meet, for set ``s`` (sorted hashes).

    A pair is looked for in the class of its larger set, so each set gets keys for its own class and the next.
    A class has k + 1 + spare parts, k the most that linked sets of it differ in; they agree on spare + 1
    parts at least. Parts with few n-grams are left out, unless a set has more than ``spare`` such.
    """
    out = []
    c, hi = size_class(len(s), threshold)
    for klass, largest in ((c, hi), (c + 1, (hi + 1) * 100 // threshold)):
        apart = most_apart(2 * largest, threshold)
        if apart == 0:
            continue  # only equal sets link
        spare = apart // 8
        parts = apart + 1 + spare
        part = ((s >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        count = np.bincount(part, minlength=parts)
        order = np.argsort(part, kind="stable")
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(s[order]), dtype=np.uint64)])
        ends = np.cumsum(count)
        key = _mix(_mix(total[ends] - total[ends - count] + np.uint64(klass)) + np.arange(parts, dtype=np.uint64) + count.astype(np.uint64) * _C[1])
        poor = count <= POOR
        out.append(key if poor.sum() > spare else key[~poor])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def meeting_keys(s: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, int]:
    """Keys of set ``s`` for the sieve, and how many of these it has in common with any linked, different set, at least."""
    if threshold >= BY_PARTS:
        return part_keys(s, threshold), 1
    return first_ones(s, threshold), sure(needed(len(s), threshold), threshold)


def _sets(rows: DataFrame, n: int, threshold: int) -> DataFrame:
    """row, doc_id, n_shingles, set hash (two longs), meeting keys, and how many of these a partner has at least."""

    def run(batches):
        for b in common.pieces(batches):
            size, h1, h2, keys, least = [], [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), n)
                size.append(len(s))
                with np.errstate(over="ignore"):
                    h1.append(int(_mix(s).sum(dtype=np.uint64)))
                    h2.append(int(_mix(s * _C[2] + _C[3]).sum(dtype=np.uint64)))
                k, some = meeting_keys(s, threshold)
                keys.append(k.view(np.int64))
                least.append(some)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(size, pa.int64()),
                    pa.array(np.array(h1, np.uint64).view(np.int64)),
                    pa.array(np.array(h2, np.uint64).view(np.int64)),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(least, pa.int64()),
                ],
                names=["row", "doc_id", "n_shingles", "h1", "h2", "keys", "least"],
            )

    return rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "row long, doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, least long"
    )


def _grams(rows: DataFrame, n: int) -> DataFrame:
    """row and all its n-grams."""

    def run(batches):
        for b in common.pieces(batches):
            got = [shingles(t.as_py(), n).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], names=["row", "grams"])

    return rows.select("row", "text").mapInArrow(run, "row long, grams array<long>")


def _unfold(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, F.explode(column)).drop(column)


def _shared(rows: DataFrame, total: int) -> DataFrame:
    """Rows (row, g, ...) whose n-gram occurs in more than one row, with the number ``f`` of these."""
    lengths = rows.groupBy("g").agg(F.count("*").alias("f")).filter("f > 1")
    return common.counted_join(rows, lengths, ["g"], "f", total, spread=["row"])


def _candidates(rows: DataFrame, sets: DataFrame, n: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Of the rows that may link at all: their n-grams (row, grams), and the lists they're to be merged from
    (g, f, row, n): each row's n-grams but for its T - 1 longest lists, where others have them too."""
    total = sets.agg(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    held = _shared(_unfold(sets.select("row", "least", "keys"), "keys", "g"), total).groupBy("row", "least").agg(F.count("*").alias("c"))
    some = common.materialize(held.filter("c >= least").select("row"), "met")
    grams = common.materialize(_grams(common.semi_join(rows, some, "row"), n), "grams")
    size = F.size("grams").cast("long")
    total = grams.agg(F.sum(size)).first()[0] or 0
    flat = grams.select("row", size.alias("n"), F.explode("grams").alias("g"))
    by_row = _shared(flat, total).groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("f", "g"))).alias("held"))  # of one set: no longer than it
    least = F.expr(f"({threshold} * n + 99) div 100")
    live = by_row.filter(F.size("held") >= least).select("row", "n", F.explode(F.slice("held", 1, (F.size("held") - least + 1).cast("int"))).alias("x"))
    live = common.materialize(live.select("row", "n", F.col("x.g").alias("g")), "live")
    lists = common.materialize(_shared(live, live.count()), "lists")
    return grams, lists


def _blocks(grams: DataFrame, lists: DataFrame, threshold: int) -> DataFrame | None:
    """Differences (block, row, own, n, p: size of the centre, more, less) of the members of blocks and of their possible
    partners, or None without any block."""
    hubs = lists.filter(F.col("f") >= HOT).groupBy("row").agg(F.max(F.struct("f", "g")).alias("x")).select("row", F.col("x.g").alias("hub"))
    hubs = common.materialize(hubs, "hubs")
    sizes = common.materialize(hubs.groupBy("hub").agg(F.count("*").alias("m")).filter(F.col("m") >= HOT), "hub-sizes")
    if sizes.isEmpty():
        return None
    hubs = hubs.join(common.small_side(sizes, 24), "hub")
    centre = (
        grams.join(common.small_side(common.materialize(hubs, "hub-members"), 32), "row")
        .select("hub", "m", F.explode("grams").alias("g"))
        .groupBy("hub", "m", "g")
        .agg(F.count("*").alias("c"))
        .filter("2 * c > m")
        .groupBy("hub", "m")
        .agg(F.sort_array(F.collect_list("g")).alias("centre"))  # at most twice the mean size of the block's sets
    )
    centre = common.materialize(centre, "centres")
    # a hub near a larger one is part of its block: they are compared with the largest that has one of their least n-grams
    probe = _unfold(centre.withColumn("few", F.slice("centre", 1, 8)), "few", "g")
    leaders = probe.groupBy("g").agg(F.max(F.struct("m", "hub")).alias("x")).select("g", F.col("x.hub").alias("to"), F.col("x.m").alias("m_to"))
    near = probe.join(leaders, "g").filter(F.struct("m_to", "to") > F.struct("m", "hub")).select("hub", "to", "m_to").distinct()
    near = near.join(centre.select("hub", "centre"), "hub").join(centre.select(F.col("hub").alias("to"), F.col("centre").alias("other")), "to")
    near = near.filter(2 * F.size(F.array_intersect("centre", "other")) > F.size(F.array_union("centre", "other")))
    near = common.materialize(near.groupBy("hub").agg(F.max(F.struct("m_to", "to")).alias("x")).select("hub", F.col("x.to").alias("to")), "near-hubs")
    moved = near.join(near.select(F.col("hub").alias("to")), "to", "left_anti")  # a hub that moves itself takes none in
    block = sizes.select("hub").join(moved, "hub", "left").select("hub", F.coalesce("to", "hub").alias("block"))
    own = common.materialize(hubs.select("hub", "row").join(common.small_side(common.materialize(block, "hub-blocks"), 24), "hub").select("row", "block"), "members")
    centre = centre.select(F.col("hub").alias("block"), "centre")
    centre_bytes = centre.agg(F.sum(F.size("centre").cast("long") * 8 + 64)).first()[0]

    def differences(members: DataFrame) -> DataFrame:
        of = grams.join(common.small_side(members, 24), "row")
        c = F.broadcast(centre) if centre_bytes <= common.BROADCAST_BYTES else centre
        return of.join(c, "block").select(
            "block",
            "row",
            F.size("grams").cast("long").alias("n"),
            F.size("centre").cast("long").alias("p"),
            F.array_except("grams", "centre").alias("more"),
            F.array_except("centre", "grams").alias("less"),
        )

    d = (F.size("more") + F.size("less")).cast("long")
    # a block's own are near its centre (Jaccard one half); who isn't is searched for like all others
    inner = common.materialize(differences(own).filter(3 * d <= F.col("n") + F.col("p")), "own")
    reach = inner.groupBy("block").agg(F.max(d).alias("d"), F.max("n").alias("n_max"), F.min("n").alias("n_min"))
    reach = common.materialize(reach, "reach")
    owned = common.materialize(inner.select("row", "block"), "owned")
    of_own = lists.select("row", "g").join(common.small_side(owned, 24), "row").select("g", "block").distinct()
    fits = (100 * F.col("n") >= threshold * F.col("n_min")) & (threshold * F.col("n") <= 100 * F.col("n_max"))
    partners = (
        lists.select("row", "n", "g")
        .join(common.small_side(common.materialize(of_own, "own-lists"), 24), "g")
        .select("row", "n", "block")
        .distinct()
        .join(common.small_side(reach, 40), "block")
        .filter(fits)
        .select("row", "block")
        .join(common.small_side(owned, 24), ["row", "block"], "left_anti")
    )
    # |x ^ centre| <= |x ^ y| + |y ^ centre|
    far = (100 + threshold) * (d - F.col("d")) > (100 - threshold) * (F.col("n") + F.col("n_max"))
    outer = differences(common.materialize(partners, "partners")).join(common.small_side(reach, 40), "block").filter(~far).drop("d", "n_max", "n_min")
    return common.materialize(inner.withColumn("own", F.lit(True)).unionByName(outer.withColumn("own", F.lit(False))), "differences")


def _links_in_blocks(diffs: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that connect what the block's own members are connected with in each block: one link to a common
    partner where many link alike, every link else."""
    # a link is (100 + t) |x ^ y| <= (100 - t) (|x| + |y|)
    diffs = diffs.withColumn("s", (100 - threshold) * F.col("n") - (100 + threshold) * (F.size("more") + F.size("less")).cast("long"))
    star = diffs.groupBy("block").agg(F.max(F.struct(F.col("s"), (-F.col("row")).alias("star"))).alias("x"), F.min("n").alias("n_min")).select("block", F.col("x.s").alias("s_max"), (-F.col("x.star")).alias("star"), "n_min")
    rows = diffs.join(common.small_side(common.materialize(star, "stars"), 56), "block")
    core = F.col("s") + F.col("s_max") >= 0
    certain = rows.filter(core & (F.col("row") != F.col("star"))).select(F.col("row").alias("a"), F.col("star").alias("b"))

    # overlap of differences that a link needs: 2 (100 + t) overlap >= -(s(x) + s(y))
    def overlap(s: Column) -> Column:
        return F.ceil(-s / F.lit(2.0 * (100 + threshold)))

    loose = rows.filter(~core).withColumn("t", overlap(F.col("s") + F.col("s_max"))).filter(F.size("more") + F.size("less") >= F.col("t"))
    side = lambda df, k, *cols: df.select("block", "g", F.col("row").alias(k), F.col("s").alias(f"s{k}"), F.col("own").alias(f"own{k}"), *cols)

    def search(some: DataFrame, others: DataFrame, column: str, least: Column, *cols: str) -> tuple[DataFrame, DataFrame]:
        """Inverted lists of ``column``: of every member of ``some`` all but its ``least`` - 1 longest lists (a partner
        with ``least`` in common is in one of the rest), and the lists of ``others`` to look in."""
        lists = _unfold(others.select("block", "row", "s", "own", *cols, column), column, "g")
        lengths = lists.groupBy("block", "g").agg(F.count("*").alias("len")).filter("len > 1")
        of = _unfold(some.select("block", "row", "s", "own", *cols, (F.size(column) - least + 1).alias("keep"), column), column, "g").join(lengths, ["block", "g"], "left")
        w = Window.partitionBy("block", "row").orderBy(F.coalesce("len", F.lit(1)), "g")
        short = of.withColumn("r", F.row_number().over(w)).filter((F.col("r") <= F.col("keep")) & F.col("len").isNotNull())
        named = lambda k: [F.col(c).alias(f"{c}{k}") for c in cols]
        return side(short, "x", *named("x")), side(lists, "y", *named("y"))

    other = (F.col("x") != F.col("y")) & (F.col("ownx") | F.col("owny"))
    # partners that share n-grams beyond the centre: at least t less those that x lacks
    x, y = search(loose, rows, "more", F.greatest(F.col("t") - F.size("less"), F.lit(1)))
    met = x.join(y, ["block", "g"]).filter(other).select("block", "x", "y", "sx", "sy")
    # partners that share none, so |x ^ y| >= |differences of x| + |y| - |centre|, and the same the other way round
    room = F.col("s") + (100 + threshold) * F.col("p")
    fits = F.col("room") >= 2 * threshold * F.col("n_min")
    small, lacking = rows.withColumn("room", room).filter(fits), loose.withColumn("room", room).filter(fits & (F.size("less") >= F.col("t")))
    x, y = search(lacking, small, "less", F.col("t"), "n", "room")
    both = x.join(y, ["block", "g"]).filter(other & (2 * threshold * F.col("ny") <= F.col("roomx")) & (2 * threshold * F.col("nx") <= F.col("roomy"))).select("block", "x", "y", "sx", "sy")
    found = met.union(both).distinct()
    # probe all lists: a candidate is in the list of g if g is one of its differences
    d = diffs.select("block", "row", F.concat("more", "less").alias("d"))
    probed = found.join(d.select("block", F.col("row").alias("x"), F.col("d").alias("dx")), ["block", "x"]).join(d.select("block", F.col("row").alias("y"), F.col("d").alias("dy")), ["block", "y"])
    searched = probed.filter(F.size(F.array_intersect("dx", "dy")) >= overlap(F.col("sx") + F.col("sy"))).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return certain.union(searched)


def _probe(pairs: DataFrame, grams: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) that link."""
    g = lambda k: grams.select(F.col("row").alias(k), F.col("grams").alias(f"g{k}"))
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(g("a"), "a").join(g("b"), "b").filter((100 + threshold) * both >= threshold * (F.size("ga") + F.size("gb"))).select("a", "b")


def _connected(grams: DataFrame, lists: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """node, component of whatever links among ``grams`` (row, grams: distinct sets), looked for in ``lists`` (see
    ``_candidates``)."""
    diffs = _blocks(grams, lists, threshold)
    links = None
    rest = lists.select("row", "n", "g")
    if diffs is not None:
        links = common.materialize(_links_in_blocks(diffs, threshold), "block-links")
        owned = common.materialize(diffs.filter("own").select("row"), "owned-rows")
        rest = common.materialize(common.anti_join(rest, owned, "row"), "rest")  # all partners of the others are in their blocks
    fits = lambda n1, n2: (100 * F.least(n1, n2) >= threshold * F.greatest(n1, n2))
    first = rest.groupBy("g").agg(F.min(F.struct("row", "n")).alias("x"), F.count("*").alias("f")).filter("f > 1").select("g", F.col("x.row").alias("b"), F.col("x.n").alias("nb"), "f")
    tried = common.counted_join(rest, first, ["g"], "f", rest.count(), spread=["row"]).filter(F.col("row") != F.col("b"))
    tried = common.materialize(tried.filter(fits(F.col("n"), F.col("nb"))).select(F.col("row").alias("a"), "b").distinct(), "firsts")
    known = _probe(tried, grams, threshold)
    known = common.materialize(known if links is None else known.union(links), "known")
    parts = common.materialize(common.connected_components(known, "parts"), "parts")
    rest = common.materialize(rest.join(common.small_side(parts.withColumnRenamed("node", "row"), 24), "row", "left").select("row", "n", "g", F.coalesce("component", "row").alias("part")), "parted")
    # lists all of whose members are connected are done
    open_ = rest.groupBy("g").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("g")
    rest = rest.join(open_, "g", "left_semi")
    x, y = (rest.select("g", *[F.col(c).alias(f"{c}{k}") for c in ("row", "n", "part")]) for k in "xy")
    pairs = x.join(y, "g").filter((F.col("rowx") < F.col("rowy")) & (F.col("partx") != F.col("party")) & fits(F.col("nx"), F.col("ny")))
    pairs = pairs.select(F.col("rowx").alias("a"), F.col("rowy").alias("b")).distinct()
    pairs = common.materialize(pairs.join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"), "pairs")
    if pairs.isEmpty():
        return parts
    links = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_probe(pairs, grams, threshold))
    return common.materialize(common.connected_components(links, "components"), "components")


def _components(rows: DataFrame, n: int, threshold: int) -> DataFrame:
    """row, doc_id, n_shingles, and row and doc_id (``kept_row``, ``kept_id``) of the first row, by doc_id, of its component."""
    sets = common.materialize(_sets(rows, n, threshold), "sets")
    known = sets.filter("n_shingles > 0")
    # classes of equal sets, by map-side combined aggregation
    classes = common.materialize(
        known.groupBy("n_shingles", "h1", "h2").agg(F.min("row").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("kept"), F.count("*").alias("copies")), "classes"
    )
    reps = classes.select(F.col("rep").alias("row"))
    joined = _connected(*_candidates(rows, common.semi_join(known, reps, "row"), n, threshold), threshold).withColumnRenamed("node", "rep")
    of_class = classes.join(common.small_side(joined, 24), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    first = of_class.groupBy("component").agg(F.min("kept").alias("kept"), F.count("*").alias("c"))
    of_class = common.counted_join(of_class.drop("kept"), first, ["component"], "c", classes.count(), spread=["rep"])
    of_class = common.materialize(of_class.select("n_shingles", "h1", "h2", "copies", "kept"), "kept")
    # every row through its class
    found = common.counted_join(sets.drop("keys", "least"), of_class, ["n_shingles", "h1", "h2"], "copies", sets.count(), spread=["row"], how="left")
    return found.select(
        "row",
        "doc_id",
        "n_shingles",
        F.coalesce("kept.row", "row").alias("kept_row"),
        F.when(F.col("kept").isNotNull(), F.col("kept.doc_id")).otherwise(F.col("doc_id")).alias("kept_id"),
    )


def join(docs: DataFrame, n: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    rows = common.numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    return _components(rows, n, threshold).select("doc_id", "n_shingles", F.col("kept_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row, all columns, of each component of ``docs``: that of the least doc_id, of rows that repeat it any one; rows
    without a doc_id come last. Texts without words all stay."""
    rows = common.numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*docs.columns).alias("doc")), "doc_id")
    found = _components(rows.select("row", "doc_id", "doc.text"), n, threshold)
    gone = common.materialize(found.filter(F.col("row") != F.col("kept_row")).select("row"), "gone")
    return common.anti_join(rows, gone, "row").select("doc.*")

"""Collocations, SimHash near duplicates and importance resampling against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonorel.llm import collocations, common, oracle, queries, resample, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, phrase string, score double, fp string, rank int"


def lower(t):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or "")


def table(spark, rows):
    """documents with columns that clash with the operators' own"""
    return spark.createDataFrame([(i, t, lang, "s", "x", 1.5, "y", 7) for i, t, lang in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op11_collocations", "op13_resample"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(oracle.ORACLES[name])
    rows = lambda columns, found: sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in found)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


# --- collocations --------------------------------------------------------------------------------------------


def brute_phrases(docs, least, longest=5, top=2000):
    n, f = Counter(), Counter()
    for _, text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    some = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    out = defaultdict(list)
    for (lang, p), a in some.items():
        if any(x == lang and len(q) > len(p) and inside(p, q) and c >= a for (x, q), c in some.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])}


def mined(docs, *how):
    got = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.mine(docs, *how).collect()]
    assert len(got) == len(set(got))
    return set(got)


EDGES = [(1, None, "en"), (2, "", None), (3, " \t\n.,;", "en"), (None, "ONE two. one Two, ONE two", "en"), (4, "one two", None), (4, "one two", "und"), (5, "é É ß\x00x \x0b" * 5, "fr")]


def test_collocations_edges(spark):
    rng = np.random.default_rng(5)
    docs = [*EDGES, *((i, " ".join(rng.choice(list("abcde"), 40)) + rng.choice([".", "!", "\r"]) + " ".join(rng.choice(list("abc"), 30)), "en") for i in range(30))]
    assert mined(table(spark, docs), 3) == brute_phrases(docs, 3)
    assert mined(table(spark, docs), 2, 5, 4) == brute_phrases(docs, 2, top=4)
    assert mined(table(spark, EDGES).filter("false"), 3) == set()


def test_the_sketch_grows_with_the_text():
    assert all(collocations.width_for(size, 100) * 100 >= size for size in (10**8, 10**9, 6 * 10**9, 12 * 10**9))


def test_cells_stop_at_the_count_asked_for():
    rng = np.random.default_rng(0)
    for most, kind in ((100, np.uint8), (1000, np.uint16), (100_000, np.uint32)):
        table, want = np.zeros(64, collocations._kind(most)), np.zeros(64, np.int64)
        assert table.dtype == kind
        for _ in range(50):
            cells, counts = rng.integers(0, 64, 200), rng.integers(1, most, 200)
            cells[cells == 5] = 6
            collocations._add(table, cells, counts // 40 + 1, most)
            np.add.at(want, cells, counts // 40 + 1)
            assert (table == np.minimum(want, most)).all()


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 300) if x < 5000), "en") for i in range(20)]
    want = brute_phrases(docs, 3)
    monkeypatch.setattr(collocations, "BLOCK", 64)
    monkeypatch.setattr(collocations, "WIDTH", 64)
    monkeypatch.setattr(collocations, "FAN", 2)
    assert mined(table(spark, docs).repartition(7), 3) == want


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "PART_BYTES", 10)
    data = b"a b c\nd e f g h i j k l\nm\nn o\n"
    assert b"".join(collocations._parts(data)) == data and len(list(collocations._parts(data))) > 1


# --- SimHash -------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = [lower(x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, threshold=2):
    """Least position reachable for each fingerprint."""
    part = list(range(len(fps)))

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    x = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= threshold):
            a, b = find(i), find(int(j))
            part[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_on_the_table(spark):
    docs = sorted(common.table(spark, SF, "documents").select("doc_id", "text").collect())
    fps = [brute_fingerprint(r.text) for r in docs]
    want = {r.doc_id: (f"{fp:016x}", docs[k].doc_id) for r, fp, k in zip(docs, fps, brute_classes(fps), strict=True)}
    got = queries.op12_simhash(spark, SF).collect()
    assert len(got) == len(docs) and {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


@given(st.text(alphabet="abAB \t\n\x0b\xa0é", max_size=60))
@settings(max_examples=200, deadline=None)
def test_simhash_fingerprints(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_the_code_covers_all_strings():
    assert (np.bitwise_count(simhash._errors(8)[0]) <= 8).all()
    patterns, starts = simhash._errors(3)  # a perfect code: one word within 3 of any string
    assert len(patterns) == 1 << 11 and (np.diff(starts.reshape(-1)[:: 4]) == 1).all()


@given(st.integers(0, 2**64 - 1), st.integers(0, 63), st.integers(0, 63))
@settings(max_examples=100, deadline=None)
def test_near_fingerprints_share_an_anchor(fp, i, j):
    a, b = simhash.anchors_of(fp), simhash.anchors_of(fp ^ 1 << i ^ (1 << j if i != j else 0))
    assert len(set(a)) == len(a) and set(a) & set(b)
    low = fp & (1 << 46) - 1
    assert (np.bitwise_count(a ^ low) <= 8).all() and not simhash._remainders(np.concatenate([a & (1 << 23) - 1, a >> 23])).any()


@pytest.mark.parametrize(("threshold", "crowd"), [(2, 256), (2, 3), (1, 256), (1, 3)])
def test_links_join_what_is_near(spark, threshold, crowd):
    rng = np.random.default_rng(9)
    fps = {0, 1 << 63, *map(int, rng.integers(0, 2**64, 40, np.uint64))}
    for fp in list(fps)[:6]:
        fps |= {fp ^ int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64))) for k in rng.integers(1, 5, 60)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = common.connected_components(simhash.links(frame, threshold, crowd), "test").collect()
    component = dict(zip(signed, signed, strict=True)) | {r.node: r.component for r in found}
    got, want = defaultdict(set), defaultdict(set)
    for x, k in zip(signed, brute_classes(fps, threshold), strict=True):
        got[component[x]].add(x)
        want[k].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, want.values())) > 20


def test_simhash_edges(spark):
    rows = [(5, None, "en"), (9, "", None), (7, " \n", "en"), (None, "one two three", "en"), (3, "ONE two\tthree", "en"), (2, "long " * 70_000, "en"), (2, "other text that stands alone", "fr")]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows)).collect()), key=str)
    h = lambda t: f"{brute_fingerprint(t):016x}"
    want = [(5, "0" * 16, 5), (9, "0" * 16, 5), (7, "0" * 16, 5), (None, h("one two three"), 3), (3, h("one two three"), 3), (2, h("long long long"), 2), (2, h(rows[-1][1]), 2)]
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(table(spark, rows).filter("false")).collect() == []
    alone = simhash.near_duplicates(table(spark, [(None, "a b", "en")])).collect()
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)]


# --- resampling ----------------------------------------------------------------------------------------------


def brute_resample(docs, target):
    feats = lambda t: [" ".join(w[i : i + k]) for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    buckets = lambda t: [zlib.crc32(x.encode()) % 10000 for x in feats(t)]
    of, t = [(i, buckets(x), len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x)))) for i, x in docs], Counter()
    s = Counter(b for _, bs, _ in of for b in bs)
    for x in target:
        t.update(buckets(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in s}
    rows = []
    for i, bs, n in of:
        weight = sum(gain[b] for b in bs)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(bs), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def resampled(docs, target):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in resample.resample(docs, target).collect()), key=str)


def test_resampling_edges(spark):
    rng = np.random.default_rng(3)
    word = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 50, k))
    docs = [(None, word(30)), (1, None), (2, ""), (3, "-- !"), (4, "É\x80x A1b2, c"), (5, word(19)), (6, "a " * 40_000), *((10 + i, word(20 + i)) for i in range(80)), (90, word(25)), (90, word(26))]
    target = [None, "", word(40), word(50)]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id int, text string")
    frame = table(spark, [(i, x, "en") for i, x in docs])
    assert resampled(frame, t) == brute_resample(docs, target)
    assert resampled(frame, t.filter("false")) == brute_resample(docs, [])
    assert resampled(frame.filter("false"), t) == []


def test_ties_go_to_the_smaller_id(spark):
    """Equal scores over many ranges keep the order of ids, and ranks have no gap."""
    rows = spark.range(0, 4000, 1, 8).select(F.col("id").alias("doc_id"), F.lit("same words " * 12).alias("text"))
    got = resample.resample(rows, rows.limit(1).select("text")).filter("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 201))
    assert [(-r.score, r.doc_id) for r in got] == sorted((-r.score, r.doc_id) for r in got)

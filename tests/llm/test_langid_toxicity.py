import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sonorel.llm import common, langid, queries, toxicity

SF = "/root/testdata/sf0.1"
EDGE = [(1, None), (2, ""), (3, "   \n"), (4, "123 !? 456"), (5, "The the and of that it was with. " * 3000), (6, "The and"), (6, "The and"), (None, "The and of")]


def edge(spark):
    return spark.createDataFrame([(i, t, "x", "en") for i, t in EDGE], "doc_id long, text string, score string, lang string")


def test_codewords():
    for k in (2, 3, 4, 5, 6, 9, 20):
        c = langid.codewords(k)
        assert c.shape[0] == k and set(np.unique(c)) == {-1.0, 1.0}
        d = [(c[i] != c[j]).sum() for i in range(k) for j in range(i)]
        assert min(d) >= c.shape[1] // 4
    assert langid.codewords(4).shape == (4, 7)


@given(st.binary(max_size=400), st.integers(1, 60))
@settings(max_examples=40, deadline=None)
def test_pieces_cover_each_ngram_once(raw, size):
    old, langid.PIECE = langid.PIECE, size
    try:
        for n in langid.ORDERS:
            got = [x for p, step in langid.pieces(raw) for x in langid.ngram_buckets(p[: step + n - 1], n)]
            assert got == langid.ngram_buckets(raw, n).tolist()
    finally:
        langid.PIECE = old


def test_language_held_out_accuracy(spark):
    got = queries.op10_language_id(spark, SF).toPandas()
    docs = common.table(spark, SF, "documents").select("doc_id", "lang").toPandas()
    j = got.merge(docs, on="doc_id")
    assert len(j) == len(docs) and ((j.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)) == j.held_out).all()
    held = j[j.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.99 and j.score.between(0, 1).all()


def test_language_edge_cases(spark):
    rows = [("the and of with that was", "en"), ("der die und das nicht von", "de"), ("le la que les des un", "fr")] * 5
    model = langid.fit(rows)
    got = [(r.doc_id, r.lang_pred, r.score, r.held_out) for r in langid.predict(edge(spark), model).collect()]
    assert [g[1] for g in got] == ["und", "und", "und", "und", "en", "en", "en", "en"]
    assert got[5][:3] == got[6][:3] and got[7][3] is False
    assert langid.predict(edge(spark).limit(0), model).count() == 0
    assert [r.doc_id for r in langid.keep_identified(edge(spark), model).collect()] == [5, 6, 6, None]
    nothing = langid.train(edge(spark).limit(0))
    assert {r.lang_pred for r in langid.predict(edge(spark), nothing).collect()} == {"und"}


def brute_segments(scores):
    """All maximal scoring segments by their definition: take the best segment, then go on left and right of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    best = max(((total[j] - total[i], -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    a = -best[2]
    b = a - best[1]
    return [*brute_segments(scores[:a]), (a, b, best[0]), *[(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]]


@given(st.lists(st.one_of(st.none(), st.floats(0.13, 3)), max_size=30))
@settings(max_examples=200, deadline=None)
def test_maximal_segments(xs):
    other = -0.37
    hits = [(i, x) for i, x in enumerate(xs) if x is not None]
    got = toxicity.maximal_segments(hits, other)
    want = brute_segments([other if x is None else x for x in xs])
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_segment_scan_is_linear():
    for hits in ([(3 * i, 1.0 + i % 7) for i in range(100_000)], [(30 * i, 1.0 + i / 1e5) for i in range(100_000)], [(30 * i, 2.0 - i / 1e5) for i in range(100_000)]):
        start = time.process_time()
        assert toxicity.maximal_segments(hits, -1.9)
        assert time.process_time() - start < 5


def test_training_sample_counts_eligible_rows_only(spark):
    rows = [(i, None if i % 10 else i % 20 // 10, 1) for i in range(20_000)]
    labels = spark.createDataFrame(rows * 2, "doc_id long, toxic int, quality int")
    ok = [i for i, toxic, _ in rows if toxic is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    for most in (len(ok) - 1, len(ok), len(ok) + 1, 500):
        got = toxicity.training_ids(labels, max_rows=most).collect()
        assert len(got) == min(most, len(ok)) and {r.doc_id for r in got} <= set(ok)


def test_lambda_root():
    s, p = np.array([-1.0, 1.0]), np.array([0.7, 0.3])
    assert abs(toxicity.solve_lambda(s, p) - np.log(0.7 / 0.3)) < 1e-6


def test_toxicity_held_out(spark):
    got = queries.op3_toxicity(spark, SF).toPandas()
    labels = common.table(spark, SF, "labels").toPandas()
    assert ((got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)) == got.held_out).all()
    assert (got.predicted == (got.score >= 0.7)).all() and got.score.between(0, 1).all()
    j = got.merge(labels, on="doc_id")
    held = j[j.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.75 and held[held.toxic == 0].predicted.mean() < 0.01


def test_toxicity_edge_cases(spark):
    docs = [(i, ("idiot scum " if i % 2 else "") + "the and of with that was " * 5) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i, _ in docs] + [(3, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(frame, labels)
    got = toxicity.score(edge(spark), model).collect()
    assert len(got) == len(EDGE) and {r.predicted for r in got} == {0} and got[0].score == got[1].score
    hot = toxicity.score(spark.createDataFrame([(1, "the and scum idiot of")], "doc_id long, text string"), model).first()
    assert hot.predicted == 1 and (hot.worst_from, hot.worst_to) == (2, 4)
    assert [r.doc_id for r in toxicity.keep_clean(frame, model).collect()] == list(range(0, 200, 2))
    none = toxicity.train(frame, labels.limit(0))
    assert {r.score for r in toxicity.score(edge(spark), none).collect()} == {0.0}


def test_what_counts_as_identified():
    """Letters are needed and, once languages are known, a majority for one of them."""
    texts = [("the thing that was there and then", "en"), ("der hund und die katze sind dort", "de"), ("les chats sont dans la maison", "fr")]
    model, blank = langid.fit(texts * 5), langid.fit([])
    assert all(model.identified(t) and blank.identified(t) for t, _ in texts)
    assert not any(m.identified(t) for m in (model, blank) for t in (None, "", "12 -- !"))
    assert blank.identified("q") and model.decide("q")[1] <= langid.MAJORITY and not model.identified("q")

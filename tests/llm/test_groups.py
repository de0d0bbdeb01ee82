"""N-gram join, packing, nearest neighbours, chat formatting and the pipeline."""

import json
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sonorel.llm import ann, chat, common, langid, ngram_join, oracle, packing, queries, toxicity

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def words(t):
    return (t or "").translate({c: chr(c + 32) for c in range(65, 91)}).encode().split()


def grams(t, n=3):
    w = words(t)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(docs, n=3, threshold=90):
    sets = [(i, grams(t, n)) for i, t in docs]
    part = {i: i for i, _ in sets}

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                i_, j_ = find(i), find(j)
                part[max(i_, j_)] = min(i_, j_)
    return {i: (len(a), find(i)) for i, a in sets}


def check_join(rows, docs, *how):
    want = brute_components(docs, *how)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(docs)


def test_join_on_the_table(spark):
    check_join(queries.op5_ngram_join(spark, SF).collect(), [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()])


def copies(seed, n=160, base_words=120, edits=6):
    """Copies of a few texts with up to ``edits`` words replaced, and of mixtures of them: chains and stars."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    bases = [list(rng.choice(vocabulary, base_words + 10 * k)) for k in range(3)]
    docs = []
    for i in range(n):
        b = list(bases[rng.integers(0, 3)])
        if rng.random() < 0.2:
            b = b[: base_words // 2] + bases[rng.integers(0, 3)][base_words // 2 :]
        for _ in range(rng.integers(0, edits)):
            b[rng.integers(0, len(b))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            b = b + list(rng.choice(vocabulary, rng.integers(0, 8)))
        docs.append((int(i * 7 % 1000), " ".join(b)))
    return docs


def test_join_on_groups_of_near_copies(spark, monkeypatch):
    for seed, hot, how in ((0, 64, (3, 90)), (1, 6, (3, 90)), (2, 6, (5, 80)), (3, 2, (5, 80))):
        monkeypatch.setattr(ngram_join, "HOT", hot)  # lists that are long enough for blocks
        docs = copies(seed)
        check_join(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), *how).collect(), docs, *how)


def test_join_at_five_words_and_80_on_the_table(spark):
    docs = common.table(spark, SF2, "documents")
    check_join(ngram_join.join(docs, 5, 80).collect(), [(r.doc_id, r.text) for r in docs.collect()], 5, 80)


def test_search_finds_links_outside_the_core(spark, monkeypatch):
    """Two sub-groups of one block: the centre is that of the larger one."""
    monkeypatch.setattr(ngram_join, "HOT", 5)
    base = [f"a{i}" for i in range(200)]
    other = base[:190] + [f"b{i}" for i in range(10)]
    docs = [(i, " ".join(base)) for i in (50, 51)] + [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(1, 9)]
    docs += [(100 + k, " ".join([*other[: k * 9], f"y{k}", *other[k * 9 + 1 :]])) for k in range(1, 5)]
    check_join(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


@given(st.integers(1, 400), st.integers(0, 10**6), st.integers(0, 40), st.integers(0, 40), st.sampled_from([30, 80, 90]))
@settings(max_examples=300, deadline=None)
def test_linked_sets_meet_in_their_first_n_grams(n, seed, out, in_, threshold):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    b = np.unique(np.concatenate([a[min(out, len(a) - 1) :], rng.integers(0, 1 << 63, in_, dtype=np.uint64)]))
    if 100 * len(np.intersect1d(a, b)) >= threshold * len(np.union1d(a, b)):
        met = len(np.intersect1d(ngram_join.first_ones(a, threshold), ngram_join.first_ones(b, threshold)))
        assert met >= max(ngram_join.sure(ngram_join.needed(len(x), threshold), threshold) for x in (a, b)) > 0
        keys = [ngram_join.meeting_keys(x, threshold) for x in (a, b)]
        assert len(np.intersect1d(keys[0][0], keys[1][0])) >= max(keys[0][1], keys[1][1]) or len(a) == len(b) == len(np.union1d(a, b))


def test_join_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "one  TWO"), (8, "É a b"), (9, "é a b"), (10, "z " * 50000), (12, "z " * 60000)]
    frame = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, block string, n_shingles int")
    check_join(ngram_join.join(frame).collect(), docs)
    kept = [r.doc_id for r in ngram_join.keep_one_of_each(frame).collect()]
    assert sorted(kept) == [1, 2, 3, 4, 6, 8, 9, 10]
    twice = frame.union(frame.filter("doc_id = 4")).union(spark.createDataFrame([(None, "one", "x", 1)], frame.schema))
    rows = ngram_join.join(twice).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows if r.doc_id in (4, None)), key=str) == [(4, 4), (4, 4), (None, 4)]
    assert sorted(r.doc_id for r in ngram_join.keep_one_of_each(twice).collect()) == sorted(kept)
    assert ngram_join.join(frame.limit(0)).count() == 0 == ngram_join.keep_one_of_each(frame.limit(0)).count()


def test_join_takes_rows_that_repeat_an_id_one_by_one(spark):
    docs = [(7, "a b c d"), (7, "e f g h"), (3, "e f g h"), (7, "a b c d"), (None, "i j k l"), (None, "i j k l"), (9, "m n o"), (9, ""), (9, ""), (None, None)]
    frame = spark.createDataFrame([(t, i, k) for k, (i, t) in enumerate(docs)], "text string, doc_id long, row int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(frame).collect()), key=str)
    assert got == sorted([(7, 2, 7), (7, 2, 3), (3, 2, 3), (7, 2, 7), (None, 2, None), (None, 2, None), (9, 1, 9), (9, 0, 9), (9, 0, 9), (None, 0, None)], key=str)
    kept = ngram_join.keep_one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r.row for r in kept.collect()), key=int)[1:] == [2, *sorted(k for k in (4, 5) if k in {r.row for r in kept.collect()}), 6, 7, 8, 9]
    assert sorted(r.text or "" for r in kept.collect()) == ["", "", "", "a b c d", "e f g h", "i j k l", "m n o"]


def naive_best_fit(sizes, lengths):
    """The same rules, searching all open bins each time; of equal room, the one opened or used last."""
    bins, left, clock = [], sum(sizes), 0
    for s in sizes:
        open_ = [b for b in bins if b["room"] >= s]
        if open_:
            b = min(open_, key=lambda b: (b["room"], -b["clock"]))
        else:
            b = {"room": lengths.opened(s, left), "held": 0}
            bins.append(b)
        b["room"] -= s
        b["held"] += s
        b["clock"] = clock = clock + 1
        left -= s
    return [lengths.shrunk(b["held"]) for b in bins], [b["held"] for b in bins]


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=150, deadline=None)
def test_best_fit(sizes):
    lengths = packing.Lengths((16, 32, 64), 4.0, 1 / 256)
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    where, offset, final = packing.best_fit(sizes, lengths)
    want, held = naive_best_fit(sizes.tolist(), lengths)
    assert final == want and [int(sizes[where == b].sum()) for b in range(len(final))] == held
    for b in range(len(final)):
        at = np.argsort(offset[where == b])
        o, s = offset[where == b][at], sizes[where == b][at]
        assert o[0] == 0 and (o[1:] == np.cumsum(s)[:-1]).all()


def check_packing(rows, lengths):
    got, bins = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.bin_id, []).append(r)
    for d, n in lengths.items():
        ps = sorted(got.pop(d), key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and sum(p.length for p in ps) == n
        assert [p.start for p in ps] == np.cumsum([0, *[p.length for p in ps]])[:-1].tolist()
    assert not got
    for ps in bins.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        (c,) = {p.capacity for p in ps}
        assert c == packing.Lengths().shrunk(at)
    return sum(p.length for ps in bins.values() for p in ps) / sum(ps[0].capacity for ps in bins.values())


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(file)
    lib.no_truncation()
    tokens = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids) + 1
    docs = common.table(spark, SF2, "documents").collect()
    assert check_packing(queries.op7_packing(spark, SF2).collect(), {r.doc_id: tokens(r.text) for r in docs}) > 0.97
    some = [(1, None), (2, ""), (3, "w " * 10000), (4, "a b"), (None, "c")]
    frame = spark.createDataFrame(some, "doc_id long, text string")
    check_packing(packing.pack_documents(frame).collect(), {i: len(words(t)) + 1 for i, t in some})
    clashing = frame.selectExpr("*", "'x' AS row", "0 AS n", "'y' AS shard", "1 AS piece")
    check_packing(packing.pack_documents(clashing, file).collect(), {i: tokens(t) for i, t in some})
    assert packing.pack_documents(frame.union(frame)).count() == 2 * packing.pack_documents(frame).count()
    assert packing.pack_documents(frame.limit(0)).count() == 0
    lengths = common.materialize(spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") * 37 % 900 + 1).alias("n")), "lengths")
    check_packing(packing.pack(lengths, shard_rows=100).collect(), {i: i * 37 % 900 + 1 for i in range(500)})
    few = common.materialize(spark.range(4096).repartition(400).select(F.col("id").alias("doc_id"), F.lit(7).alias("n")), "lengths")
    rows = packing.pack(few, shard_rows=64).collect()  # ten rows a partition, 64 shards
    shards = np.bincount([r.bin_id >> 32 for r in rows], minlength=64)
    assert len(rows) == 4096 and shards.min() > 30 and shards.max() < 110


def brute_nearest(ids, x, q, k=5):
    s = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]]
    return [(int(ids[i]), float(s[i])) for i in order[:k]]


def test_nearest_neighbours(spark):
    rows = common.table(spark, "/root/testdata/sf0.1", "embeddings").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.op8_ann(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [i for i in ids if i % 50 == 0]
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        want = brute_nearest(ids, x, int(np.nonzero(ids == q)[0][0]))
        hits += len({f[1] for f in found} & {w[0] for w in want})
        for _, v, s in found:
            i, j = np.nonzero(ids == q)[0][0], np.nonzero(ids == v)[0][0]
            assert abs(s - x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])) < 1e-12
    assert hits >= 0.9 * 5 * len(got)


def test_nearest_edge_cases(spark):
    e = [1.0] + [0.0] * 7
    rows = [(0, e), (1, e), (2, [2.0] + [0.0] * 7), (3, e), (3, e), (4, None), (5, [0.0] * 8), (6, [float("nan")] + e[1:]), (7, [None] + e[1:]), (8, [1.0, 0.0]), (50, [float("inf")] + e[1:]), (None, e), (100, [1.0, 0.1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in ann.search(frame, F.col("vec_id") % 50 == 0).collect())
    assert got[:3] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0)] and len(got) == 4 and got[3][:3] == (100, 1, 8)
    assert ann.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_chat_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF2}/conversations.parquet'")
    want = c.sql(oracle.ORACLES["op9_chat"]).df()
    got = queries.op9_chat(spark, SF2)
    assert got.columns == list(want.columns)
    assert sorted(map(str, map(list, got.collect()))) == sorted(map(str, want.values.tolist()))


def call(i, name="search", **arguments):
    return {"id": i, "name": name, "arguments": arguments}


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", json.dumps({"content": "x", "tool_calls": [call("a", query="q"), call("b", query={"$result": "a"}, limit=0)]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"b": 1, "a": [1.5, "é"]}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})),
        (2, 0, "tool", json.dumps({"tool_call_id": "k", "content": "early"})),
        (2, 5, "assistant", json.dumps({"tool_calls": [{"id": "k", "function": {"name": "calculate", "arguments": '{"expression":"1+1"}'}}]})),
        (2, 6, "assistant", json.dumps({"tool_calls": [call("m", query={"$result": "k"})]})),
        (3, 0, "assistant", "{not json"),
        (3, 1, None, None),
        (3, 1, None, None),
        (4, 0, "assistant", json.dumps({"tool_calls": [call(None), call("u", name="none")]})),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, line string")
    got = {(r.conv_id, r.turn): r for r in chat.format_messages(frame).collect()}
    assert chat.format_messages(frame).count() == len(rows)
    assert got[1, 2].line == '{"content":"{\\"a\\":[1.5,\\"é\\"],\\"b\\":1}","role":"tool","tool_call_id":"a"}' and not got[1, 2].valid
    assert "cycle" in got[1, 1].problems and "not string" in got[1, 1].problems and "out of bounds" in got[1, 1].problems  # b needs the result of a beside it
    assert got[1, 3].problems == "result of no call"
    order = sorted((r.order_turn, r.order_step, r.turn) for k, r in got.items() if k[0] == 2)
    assert [t for *_, t in order] == [5, 0, 6] and got[2, 0].valid
    assert json.loads(got[2, 5].line)["tool_calls"] == [{"arguments": {"expression": "1+1"}, "id": "k", "name": "calculate"}]
    assert got[3, 0].line == '{"content":"{not json","role":"assistant"}' and got[3, 1].line == '{"content":"","role":""}'
    assert got[4, 0].problems == "call 0: no id; call 0: $.query: missing; call 1: unknown tool"
    assert chat.format_messages(frame.limit(0)).count() == 0


def test_hostile_chat_rows(spark):
    deep = "[" * 200_000
    nested = lambda k: '{"a":' * k + "1" + "}" * k
    texts = [deep, '{"tool_calls":' + deep, '{"tool_calls":[{"id":"a","name":"search","arguments":' + json.dumps(deep) + "}]}"]
    texts += ['{"tool_calls":[{"id":"a","name":["search"],"arguments":{}}]}', '{"tool_calls":[{"id":"a","name":{},"arguments":%s}]}' % nested(150), '{"tool_calls":[{"id":"a","arguments":%s}]}' % nested(5000)]
    texts += ['{"tool_calls":[{"id":"\\ud800","name":"search"}]}', '{"tool_calls":[{"id":"a","name":"search","arguments":"{\\"query\\":NaN}"},{"id":"b","name":"search","arguments":"1e999"}]}']
    for t in texts:
        chat.parse("assistant", t, chat.TOOLS)["line"].encode()
    last = chat.parse("assistant", texts[-1], chat.TOOLS)
    assert last["calls"] == ["a", "b"] and "call 0: arguments are no JSON" in last["problems"]
    assert chat.parse("assistant", texts[2], chat.TOOLS)["calls"] == ["a"]
    rows = [(1, k, "assistant", t) for k, t in enumerate(texts)] + [(None, 1, "tool", '{"tool_call_id":"a"}'), (1, None, "tool", '{"tool_call_id":"a"}'), (2, 0, "user", "long " * 400_000)]
    got = chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows) and {r.problems for r in got if r.conv_id is None or r.turn is None} == {""}


def kahn(n, edges):
    """Turns in the order of format_messages, by plain Python, and those on a cycle or behind one."""
    key = {}
    while fresh := [t for t in range(n) if t not in key and all(a in key for a, b in edges if b == t)]:
        for t in fresh:
            before = [key[a] for a, b in edges if b == t]
            most = max(before, default=(-1, 0))
            key[t] = (t, 0) if t > most[0] else (most[0], most[1] + 1)
    return {t: (*key.get(t, (t, 0)), t not in key) for t in range(n)}


def test_order_equals_a_plain_topological_sort(spark):
    rng, rows, want = random.Random(5), [], {}
    for conv in range(12):
        calls, answers = list(range(6)), list(range(6, 12))
        turns = list(range(12))
        rng.shuffle(turns)
        edges = set()
        for k in range(6):
            needs = [j for j in rng.sample(calls, rng.choice([0, 1, 2])) if j != k and (conv % 4 == 3 or j < k)]
            arguments = {"query": "q", "more": [{"$result": f"c{j}"} for j in needs]}
            rows.append((conv, turns[k], "assistant", json.dumps({"tool_calls": [{"id": f"c{k}", "name": "search", "arguments": arguments}]})))
            rows.append((conv, turns[answers[k]], "tool", json.dumps({"tool_call_id": f"c{k}", "content": "r"})))
            edges |= {(turns[k], turns[answers[k]]), *((turns[answers[j]], turns[k]) for j in needs)}
        want |= {(conv, t): v for t, v in kahn(12, edges).items()}
    got = chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.order_turn, r.order_step, "cycle" in r.problems) for r in got} == want


def test_chains_cycles_and_merges_are_placed_as_a_plain_sort_does(spark):
    rng, edges, want = random.Random(8), [], {}
    for conv in range(40):
        n = rng.choice([2, 5, 30, 60])
        turns = list(range(n))
        rng.shuffle(turns)
        some = {(turns[k - 1], turns[k]) for k in range(1, n) if rng.random() < 0.9}  # chains
        some |= {(turns[rng.randrange(k)], turns[k]) for k in range(1, n) if rng.random() < (0, 0.1, 0.4)[conv % 3]}  # merges
        if conv % 4 == 3:  # a cycle, with chains behind it
            some |= {(turns[n // 2], turns[n // 4])}
        some = {(a, b) for a, b in some if a != b}
        edges += [(conv, a, b) for a, b in some]
        want |= {(conv, t): v for t, v in kahn(n, some).items() if any(t in e for e in some)}
    got = chat._placed(spark.createDataFrame(edges, "conv_id long, before long, after long")).collect()
    assert {(r.conv_id, r.turn): (r.order_turn, r.order_step, r.cycle) for r in got} == want and len(got) == len(want)
    assert 5 < sum(c for *_, c in want.values()) < len(want) / 2


def test_a_chain_takes_as_many_rounds_as_its_length_has_digits(spark, monkeypatch):
    written, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: written.append(name) or write(df, name))
    edges = spark.range(1500).selectExpr("1L conv_id", "1500 - id before", "1499 - id after")
    got = {r.turn: (r.order_turn, r.order_step, r.cycle) for r in chat._placed(edges).collect()}
    assert got == {t: (1500, 1500 - t, False) for t in range(1501)} and len(written) <= 15


def test_derived_calls_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got, want = queries.chat_calls(spark, SF), con.sql(oracle.ORACLES["chat_calls"])
    rows = lambda columns, found: sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in found)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
    assert got.filter("order_step > 1").count() > 5 and got.filter("not valid").count() > 5


def test_boolean_schemas_and_large_integers():
    assert chat.faults({"a": [1]}, {"properties": {"a": True}}) == [] and chat.faults({"a": 1}, {"properties": {"a": False}}) == ["$.a: not allowed"]
    assert chat.faults([1, 2], {"items": False}) == ["$[0]: not allowed", "$[1]: not allowed"]
    text = '{"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "q", "limit": %s}}]}'
    assert chat.parse("assistant", text % ("9" * 4300), chat.TOOLS)["calls"] == ["a"]
    over = text % ("9" * 4301)
    assert chat.parse("assistant", over, chat.TOOLS)["calls"] == [] and json.loads(chat.parse("assistant", over, chat.TOOLS)["line"])["content"] == over
    assert '"limit":2' in chat.parse("assistant", '{"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "q", "limit": 1, "limit": 2}}]}', chat.TOOLS)["line"]


def test_schema_faults():
    s = {"type": "object", "properties": {"a": {"type": ["integer", "null"], "minimum": 2}, "b": {"type": "array", "items": {"enum": [1, 2]}, "maxItems": 2}}, "required": ["a"], "additionalProperties": False}
    assert chat.faults({"a": 3, "b": [1]}, s) == [] and chat.faults({"a": None}, s) == []
    assert chat.faults({"a": 1, "b": [3, 1, 2], "c": 0}, s) == ["$.a: out of bounds", "$.b[0]: not in enum", "$.b: 3 items", "$.c: unknown"]
    assert chat.faults([], s) == ["$: not object"] and chat.faults({"a": True}, s) == ["$.a: not ['integer', 'null']"]


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version on its own input."""
    docs = common.table(spark, SF2, "documents")
    columns = docs.columns
    seen = [{r.doc_id for r in docs.collect()}]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = common.materialize(stage(spark, docs, SF2), name)
        seen.append({r.doc_id for r in docs.collect()})
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.exceptAll(before).count() == 0
        if name == "language_id":
            model = langid.train(before)
            assert seen[-1] == {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "") and model.decide(r.text)[1] > 0.5}
        if name == "ngram_jaccard_join":
            want = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert seen[-1] == {i for i, (_, c) in want.items() if c == i}
        if name == "best_fit_packing":
            of = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            of.no_truncation(), of.no_padding()
            check_packing(docs.collect(), {r.doc_id: len(of.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()})
    assert seen[0] >= seen[1] > seen[2] > seen[3] == seen[4]
    assert corpus_pipeline.run(spark, SF2).count() == docs.count()


def stages(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.materialize(stage(spark, out[-1], SF), name))
    return out


def test_pipeline_keeps_a_corpus_without_labels(spark):
    docs = common.table(spark, SF, "documents").withColumn("lang", F.lit(None).cast("string"))
    found = stages(spark, docs)
    assert found[1].count() == docs.filter("text rlike '[a-zA-Z]'").count() and found[-1].count() > 100


def test_pipeline_edges(spark):
    """Null, empty and letterless texts, repeated and missing ids, equal texts, columns of the operators' own names, no row."""
    text = common.table(spark, SF, "documents").orderBy("doc_id").select("text", "lang").limit(8).collect()
    rows = [(i, r.text, r.lang) for i, r in enumerate(text)]
    rows += [(50, None, "en"), (51, "", "en"), (52, "-- 12 !!", None), (1, text[5].text + " and more words of its own that nobody else has", "en"), (None, text[6].text, None), (None, "Only this one has no number, the others have.", "en")]
    docs = spark.createDataFrame([(*r, "s", 1, 2, "x", 3.0, 4, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row long, component string, score double, h long, keep boolean")
    found = stages(spark, docs)
    assert all(d.columns == docs.columns for d in found[:-1])
    assert {r.doc_id for r in found[1].collect()} == {None, *range(8)} and found[1].count() == 11
    assert {r.text for r in found[3].collect()} <= {r.text for r in found[1].collect()} and found[3].filter("text = '%s'" % text[6].text.replace("'", "\\'")).count() == 1
    assert found[4].groupBy("doc_id").count().count() == len({r.doc_id for r in found[3].collect()})
    assert [d.count() for d in stages(spark, docs.filter("false"))] == [0] * 5


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=3, deadline=None)
def test_connected_components(pairs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    part = {}

    def find(a):
        part.setdefault(a, a)
        while part[a] != a:
            a = part[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = common.connected_components(spark.createDataFrame(pairs or [(0, 0)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in linked} and len(got) == len(linked)


def test_size_checked_joins(spark):
    keys = common.materialize(spark.range(5).withColumnRenamed("id", "k"), "keys")
    rows = spark.range(20).withColumnRenamed("id", "k")
    assert "Broadcast" in common.semi_join(rows, keys, "k")._jdf.queryExecution().toString()
    assert common.small_side(keys, 10**9) is keys
    assert common.anti_join(rows, keys, "k").count() == 15


def test_near_duplicate_stage_takes_five_words_and_80(spark):
    rng = np.random.default_rng(5)
    docs = [(1000, None), (1001, ""), (1002, "a b"), (1003, "A b")]
    for base in range(12):
        text = rng.integers(0, 5000, 150).astype(str).tolist()
        for edits in range(4):
            copy = list(text)
            for at in rng.choice(150, edits, replace=False):
                copy[at] = "x%d" % rng.integers(10**9)
            docs.append((len(docs), " ".join(copy)))

    def kept(n, threshold):
        sets = [(i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if (w := words(t)) else frozenset()) for i, t in docs]
        edges = [(i, j) for i, a in sets for j, b in sets if j < i and a and 100 * len(a & b) >= threshold * len(a | b)]
        least = {i: i for i, _ in sets}
        for _ in sets:
            for i, j in edges:
                least[i] = least[j] = min(least[i], least[j])
        return {i for i, k in least.items() if i == k}

    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()}
    assert got == kept(5, 80) and got < kept(3, 90)


def test_neighbours_fewer_than_k_are_all_returned(spark):
    x = np.random.default_rng(2).standard_normal((4, 64))
    rows = [(i, (s * v).tolist()) for i, (s, v) in enumerate([(1, x[0]), (-1, x[0]), (1, x[1]), (-1, x[1]), (1, x[2])])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 5).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(i, j) for i in range(5) for j in range(5) if i != j}
    assert sorted(r["rank"] for r in got) == sorted([1, 2, 3, 4] * 5)


def test_passes_send_small_batches_and_all_rows(spark):
    """What a pass makes of one of Spark's batches isn't held whole: workers share an executor's memory."""

    class Rows:
        sparkSession, schema = spark, None
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    rng = np.random.default_rng(11)
    texts = [None, "", "a", "x " * 1_500_000, *(" ".join(map("w{}".format, rng.integers(0, 5000, 330))) for _ in range(3000)), "", None]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["row", "doc_id", "text"])
    short = batch.select(["row", "text"])
    words = toxicity.ToxicModel({"17": 9.0}, -0.1, 1.0, 0.0, 1.0, 0.0)
    everyone, lettered = range(len(texts)), [i for i, t in enumerate(texts) if t and langid.has_letter(t)]
    for run, of, kept in (
        (ngram_join._sets(Rows(), 5, 80), batch, everyone),
        (ngram_join._grams(Rows(), 5), short, everyone),
        (langid.keep_identified(Rows(), langid.fit([])), batch, lettered),
        (toxicity.keep_clean(Rows(), words, 2.0), batch, everyone),
    ):
        got = list(run(iter([of, of.slice(0, 0), of.slice(0, 3)])))
        assert [r for b in got for r in b.column(0).to_pylist()] == [*kept, *(i for i in kept if i < 3)]
        assert max(b.num_rows for b in got) < 1500 and len(got) > 3
    grams = [g for b in ngram_join._grams(Rows(), 5)(iter([short])) for g in b.column(1).to_pylist()]
    assert grams == [ngram_join.shingles(t, 5).view(np.int64).tolist() for t in texts]

"""What a worker that counts token ids holds, and keeps."""

import public_tokenizers

from sonorel.llm import token_files


def test_counter_is_bounded_and_gives_its_memory_back(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(f"w{i}x{k}," for k in range(50)) for i in range(20)]
    want = [len(x) // 2 for x in token_files.ChunkEncoder(path).encode_batch(texts)]
    c = token_files.ChunkCounter(path)
    assert c.limit < token_files.MEMO
    c.limit, sizes, ask = 300, [], c._chunk_ids
    monkeypatch.setattr(token_files, "LEARNED", 64)
    monkeypatch.setattr(c, "_chunk_ids", lambda chunks: sizes.append(len(chunks)) or ask(chunks))
    assert [n for t in texts for n in c.encode_batch([t])] == want
    assert max(sizes) <= 64 and len(c.memo) <= 300 + 2 * 50 + 2
    c.release()
    assert not c.memo and c.encode_batch(texts) == want


def test_workers_keep_no_memo_after_their_task(spark):
    from sonorel.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.range(40, numPartitions=3).selectExpr("id AS doc_id", "concat('word', id, ' of ', id * 7) AS text")
    assert packing.token_lengths(docs, path).agg({"n": "count"}).first()[0] == 40

    def left(_):
        return [len(e.memo) for e in token_files._loaded.values()]

    assert not any(spark.sparkContext.parallelize(range(8), 8).mapPartitions(left).collect())


def test_chunks_in_use_outlive_newer_ones():
    c = token_files.ChunkCounter(public_tokenizers.path("byte_bpe_50k.json"))
    c.limit = 100
    often = " ".join(f"often{i}" for i in range(20))
    for k in range(40):
        c.encode_batch([f"{often} {' '.join(f'new{k}x{i}' for i in range(30))}"])
        assert all(f"often{i}" in c.memo for i in range(1, 20)) and len(c.memo) <= 100 + 52


def test_words_are_told_apart_by_their_blank(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = token_files.ChunkEncoder(path)
    asked, ask = [], e.lib.encode_batch_fast

    class Library:
        def __getattr__(self, name):
            return getattr(lib, name)

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return ask(texts, **options)

    lib, text = e.lib, "the naïve 北京 x1,y2 don't  two\n\nlines \t tab\n end Ġ \x01 " + e.lib.decode([300]) + " "
    want = [e._ids([t])[0] for t in (text, " ", "", f" {text}")]
    monkeypatch.setattr(e, "lib", Library())
    assert e.encode_batch([text, " ", "", f" {text}"]) == want
    assert any(" naïve" in t and not any(s in t for s in e.special) for t in asked)


def test_a_chunk_is_looked_up_once_in_a_group():
    class Memo(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["the same words, over and over. " * 200] * 3 + ["", " ", "Straße\n\nthe\tsame\x1fwords"]
    for kind in (token_files.ChunkEncoder, token_files.ChunkCounter):
        e = kind(path)
        e.memo = Memo()
        assert e.encode_batch(texts) == e._ids(texts)
        assert e.memo.asked <= 12


def test_words_of_letters_go_to_the_model_alone(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for kind in (token_files.ChunkEncoder, token_files.ChunkCounter):
        e = kind(path)
        asked, ask = [], e._word_ids
        monkeypatch.setattr(e, "_word_ids", lambda words: asked.extend(words) or ask(words))
        text = "don't Speculate naïve antidisestablishmentarian, x1 A I'll\nunder-way"
        assert e.encode_batch([text]) == e._ids([text])
        assert sorted(asked) == ["A", "Speculate", "antidisestablishmentarian"]

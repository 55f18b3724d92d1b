"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import bpe, op1_bpe_codec, op9_token_counts
from ledgerspark.llm.queries import tokenizer_file

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = ["", "a", " ", "  a", "\n's it's 's''s't", "don't DON'T we'll  we're\n\n x", "a<|endoftext|>b <|endoftext|>", "<|startoftext|>x", "½²x٣三", "Σας ΟΔΟΣ İx ﬁ é", "  x　y \t\nz  ", "x" * 3000, "ab" * 700 + "<|endoftext|>" * 3, "1234 56 7.8", "👍🏽👨‍👩‍👧 ok", "'re've 'll", "\r\n\r\n  '", "\x00\x00 a\x00"]


def texts() -> list[str]:
    rng = random.Random(1)
    alphabet = "ab'sdtrevlm  \n\t1２é三.!_ΣΟ<|"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_ids_are_the_library_s(name):
    lib, own = tokenizers.Tokenizer.from_file(tokenizer_file(name)), bpe.Tokenizer(tokenizer_file(name))
    sample = texts()
    want = [e.ids for e in lib.encode_batch(sample, add_special_tokens=False)]
    got = own.encode([t.encode() for t in sample])
    ends = np.concatenate([[0], np.cumsum(got.counts)])
    assert [got.ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == want
    assert own.count([t.encode() for t in sample]).tolist() == [len(w) for w in want]


def test_decoding_is_the_library_s():
    lib, own = tokenizers.Tokenizer.from_file(tokenizer_file(BYTE)), bpe.Tokenizer(tokenizer_file(BYTE))
    rng = random.Random(2)
    for ids in [[], [50256], *([rng.randrange(50257) for _ in range(rng.randint(1, 12))] for _ in range(300))]:
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_both_trees_agree():
    t = bpe.Tokenizer(tokenizer_file(BYTE))
    rng = random.Random(3)
    for _ in range(200):
        raw = bytes(rng.choice(b"aehnt rs") for _ in range(rng.randint(1, 60)))
        wide, _ = t.encode_pieces(np.frombuffer(raw + bytes(16), np.uint8), np.array([0]), np.array([len(raw)]))
        assert wide.tolist() == bpe.merge_one(t.inner[np.frombuffer(raw, np.uint8)].tolist(), t.pairs.plain, t.merged_list)


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    t = bpe.Tokenizer(tokenizer_file(BYTE))
    before = bpe.Tokenizer(tokenizer_file(BYTE))
    before.encode([b"zebra crossing"])
    for s in (b"one two three four five six seven", b"eight nine ten eleven twelve thirteen", b"one two"):
        assert t.encode([s]).ids.tolist() == before.encode([s]).ids.tolist()


def frame(spark, rows):
    return spark.createDataFrame(rows, "ids array<int>, doc_id long, text string, n_tokens string")


def test_frames(spark):
    docs = frame(spark, [([1], 1, "hello world", "x"), (None, None, None, None), ([2], 3, "", "y"), ([2], 3, "", "y"), (None, 4, "a" * 200_000, None)])
    coded = op1_bpe_codec.encode(docs, tokenizer_file(BYTE))
    back = op1_bpe_codec.decode(coded, tokenizer_file(BYTE))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    digests = {r.doc_id: r for r in op1_bpe_codec.round_trip_digests(docs, tokenizer_file(BYTE)).collect()}
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert (digests[None].n_tokens, digests[None].ids_sha256, digests[None].decoded_sha256) == (0, empty, empty)
    counted = op9_token_counts.count_tokens(docs, tokenizer_file(BYTE), limit=512).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in counted) == sorted((len((r.text or "").encode()), digests[r.doc_id].n_tokens) for r in docs.collect())
    for f in (op1_bpe_codec.round_trip_digests, op9_token_counts.count_tokens):
        assert f(docs.where("false"), tokenizer_file(BYTE)).collect() == []


def test_the_table_changes_no_count(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} and <|endoftext|> more words {i}") for i in range(50)], "doc_id long, text string")
    pieces = op9_token_counts.frequent_pieces(docs, tokenizer_file(BYTE), table=5)
    assert len(pieces) == 5
    own = bpe.Tokenizer(tokenizer_file(BYTE))
    got = {r.doc_id: r.n_tokens for r in op9_token_counts.count_tokens(docs, tokenizer_file(BYTE)).collect()}
    assert got == {r.doc_id: int(own.count([r.text.encode()])[0]) for r in docs.collect()}


#: Two pieces of sixteen bytes whose hashes are equal.
TWINS = ("judgemeanstatute", "baPHeYqgWhdHKqSx")


def test_pieces_with_equal_hashes_are_told_apart(spark):
    lib, path = tokenizers.Tokenizer.from_file(tokenizer_file(BYTE)), tokenizer_file(BYTE)
    ids = lambda t: lib.encode(t, add_special_tokens=False).ids
    a, b = TWINS
    raw = np.frombuffer((a + b).encode() + bytes(16), np.uint8)
    assert len(set(bpe.Tokenizer.hashes(raw, np.array([0, 16]), np.array([16, 16])).tolist())) == 1
    own = bpe.Tokenizer(path)
    # in one block, then across blocks through the cache, in both orders
    for block in ([f"{a}\n{b}", f"{b}\n{a}"], [b], [a, b], [f"{a} {a}\n{b}\n{b}"]):
        for tokenizer in (own, bpe.Tokenizer(path)):
            got = tokenizer.encode([t.encode() for t in block])
            assert [p.tolist() for p in np.split(got.ids, np.cumsum(got.counts)[:-1])] == [ids(t) for t in block]
            assert tokenizer.count([t.encode() for t in block]).tolist() == [len(ids(t)) for t in block]
    # and against the broadcast table, which knows one of them
    rows = [(n, f"{a}\n{a}\n{b}" if n < 5 else b) for n in range(10)]
    counted = op9_token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path)
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == {n: len(ids(t)) for n, t in rows}


def test_digests_are_the_library_s(spark):
    lib = tokenizers.Tokenizer.from_file(tokenizer_file(BYTE))
    rows = list(enumerate([*texts()[:120], None, "\n".join(TWINS), "long text " * 50_000]))
    got = op1_bpe_codec.round_trip_digests(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_file(BYTE))
    want = {}
    for n, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want[n] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == want

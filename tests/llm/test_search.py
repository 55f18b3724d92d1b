"""Near duplicates, top-k, secrets and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerspark.llm import graph, op4_simhash, op5_topk, op6_secrets


def brute_components(nodes, linked):
    least = {n: n for n in nodes}

    def find(n):
        while least[n] != n:
            n = least[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# -- components


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = brute_components({n for e in edges for n in e}, edges)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


# -- SimHash


def brute_print(text: str, k: int) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", "  \n", "One", "one TWO", "one two three", "a b c a b c a b c d", "Ünï code É x y", "w " * 70_000 + "z"])
def test_fingerprints(text):
    assert op4_simhash.fingerprint(text.encode(), 3) == brute_print(text, 3)


def test_spark_hashes_shingles_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] == int(np.uint64(xxhash.xxh64_intdigest(b"one two three", 42)).view(np.int64))


@pytest.mark.parametrize("distance,bucket", [(0, 32), (1, 32), (2, 32), (2, 0), (2, 3), (3, 32), (3, 0)])
def test_links_have_all_components(spark, distance, bucket):
    rng = random.Random(distance)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(rng.randint(0, 6)):
            other = base
            for _ in range(rng.randint(1, 4)):
                other ^= 1 << rng.randrange(64)
            prints.add(other)
    prints = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= distance]
    want = brute_components(prints, pairs)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {r.node % (1 << 64): r.component for r in graph.components(op4_simhash.links(nodes, distance, bucket), "a", "b").collect()}
    groups = {}
    for p in prints:
        groups.setdefault(found.get(p, ("alone", p)), set()).add(p)
    wanted = {}
    for p, c in want.items():
        wanted.setdefault(c, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_thresholds_follow_costs():
    assert op4_simhash.allot([{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 5, 1: 20}], 1) == (25, [0, 1])
    assert op4_simhash.allot([{-1: 0, 0: 5, 1: 50}] * 3, 0)[1] == [0, 0, 0]
    assert op4_simhash.allot([{0: 1}], 5)[1] == []


def test_correlated_bits_share_a_partition():
    c = np.eye(64)
    for a, b in ((0, 63), (1, 40)):
        c[a, b] = c[b, a] = 0.9
    groups = op4_simhash.group_bits(c, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} <= {21, 22}
    assert any({0, 63} <= set(g) for g in groups) and any({1, 40} <= set(g) for g in groups)


def test_near_duplicates(spark):
    rows = [(5, "a b c d"), (3, "A  b\nc d"), (9, None), (8, ""), (None, "a b c d"), (None, "lonely words here"), (4, "quite other words"), (4, "quite other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as component_id")
    got = [(r.doc_id, r.component_id) for r in op4_simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (None, 3), (None, None), (4, 4), (4, 4)], key=repr)
    assert op4_simhash.near_duplicates(docs.where("false")).collect() == []


def test_near_copies_go(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]
    near, far = list(base), list(base)
    for i in (40, 150):
        near[i] = word()
    for i in range(0, 300, 6):
        far[i] = word()
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (7, " ".join(base).upper()), (8, None), (9, ""), (None, " ".join(base)), (3, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as key", "1 as id", "2 as _copy_key", "3 as row", "4 as name", "5 as no")
    left = op4_simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 8]
    assert op4_simhash.drop_near_copies(docs.where("false")).collect() == []


def kept_by_brute_force(texts):
    """Least numbers of the components of all pairs of texts whose shingle sets reach 0.8."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    number = {}
    rows = [[number.setdefault(x, len(number)) for x in s] for s in sets]
    held = np.zeros((len(sets), len(number)), np.float32)
    for i, r in enumerate(rows):
        held[i, r] = 1
    common, size = held @ held.T, held.sum(1)
    least = np.arange(len(sets))
    near = common / (size[:, None] + size[None, :] - common) >= 0.8
    while True:
        step = np.array([least[near[i]].min() for i in range(len(sets))])
        if (step == least).all():
            return sorted(set(least.tolist()))
        least = step


def star(rng, words, copies, edits):
    """An original and copies, each with some words of its own in other places."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        text = list(base)
        for i in rng.sample(range(5, words - 5, 6), edits):
            text[i] = word()
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("copies,block,centred", [(2000, 512, 64), (150, 32, 10**9), (150, 512, 10**9)])
def test_an_original_and_its_copies_are_one_group(spark, monkeypatch, copies, block, centred):
    monkeypatch.setattr(op4_simhash, "BLOCK", block)
    monkeypatch.setattr(op4_simhash, "CENTRED", centred)
    rng = random.Random(3)
    # like the original to 0.82; below 0.8 with each other; the last ones are below 0.8 with the original, too
    texts = star(rng, 205, copies, 4) + star(rng, 205, 20, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in op4_simhash.drop_near_copies(docs).collect())
    assert got == kept_by_brute_force(texts)
    assert 0 in got and got[1] == copies + 1


# -- top-k


def brute_top(rows, k, queries):
    whole = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in whole:
        if queries(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in whole if c != q and len(w) == len(v))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,shard", [(2048, 16384), (2, 7), (1, 1)])
def test_top_k(spark, block, shard):
    rng = np.random.default_rng(8)
    rows = [(i, [round(float(x), 1) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (200, None), (300, [1.0, None, 2.0, 3.0]), (400, [float("nan")] * 4), (500, [float("inf")] * 4), (None, [1.0] * 4), (600, [1.0, 2.0]), (601, [2.0, 2.0]), (700, []), (701, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as id", "1 as score")
    got = op5_topk.top_k(frame, F.col("vec_id") % 10 == 0, k=5, query_block=block, shard=shard).collect()
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got)) == brute_top(rounded, 5, lambda q: q % 10 == 0)


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op5_topk.top_k(empty, F.lit(True)).collect() == []


def test_large_components_stay_exact():
    q = np.array([[2.0**40, 1.0]])
    ids, cand, score = op5_topk.tile_top(np.array([1]), q, np.array([2, 3]), np.array([[2.0**20, 1.0], [2.0**20, 2.0]]), 1)
    assert (ids.tolist(), cand.tolist(), score.tolist()) == ([1], [3], [2**60 + 2])
    # the product of a row with itself has no say
    ids, cand, score = op5_topk.tile_top(np.array([1]), np.array([[2.0**40, 0.0]]), np.array([1, 2]), np.array([[2.0**40, 0.0], [5.0, 1.0]]), 3)
    assert (ids.tolist(), cand.tolist(), score.tolist()) == ([1], [2], [5 * 2**40])
    with pytest.raises(OverflowError):
        op5_topk.tile_top(np.array([1]), q, np.array([2]), np.array([[2.0**40, 1.0]]), 1)


# -- secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(t):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return [sum(s[1] == i for s in spans) for i in range(3)], hashlib.sha256(text.encode()).hexdigest()


def test_secrets(spark):
    rng = random.Random(10)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAABCDEFGHIJ1234", "0123456789abcdef", "deadbeefdeadbeef0", "Zz+/", "é", "👍", "\n", "x" * 12, "---"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(400, None), (None, "token=0123456789abcdef0123"), (401, "secret: token : abcdefghijklmnop password=token=abcdefghijklmnop"), (402, "token=abcdefghijkl " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as trigram", "2 as kinds")
    got = {r.doc_id: r for r in op6_secrets.report(docs).collect()}
    for i, t in rows:
        counts, digest = brute_secrets(t or "")
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == counts and got[i].base_sha256 == digest, t
    assert op6_secrets.report(docs.where("false")).collect() == []
    clean = {r.doc_id: r.text for r in op6_secrets.redact(docs).collect()}
    assert clean[400] is None and clean[None] == "[SECRET]" and clean[402] == "[SECRET] " * 3000


def test_secrets_beside_columns_of_any_name(spark):
    docs = spark.sql("select 1 as doc_id, 'token=0123456789abcdef0123' as text, 'a' as secret_spans, 'b' as _secret_text, 'c' as row, 'd' as spans, 'e' as key, 'f' as kinds, map(1, 2) as place")
    assert [tuple(r) for r in op6_secrets.redact(docs).collect()] == [(1, "[SECRET]", "a", "b", "c", "d", "e", "f", {1: 2})]
    found = op6_secrets.find_secrets(docs)
    assert found.columns == ["doc_id", "text", "_secret_text", "row", "spans", "key", "kinds", "place", "secret_spans"] and len(found.first().secret_spans) == 2


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = [(i, f"text {i} " + "password=abcdefghijkl" * (i % 3 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, op6_secrets.report(docs).collect()))
    monkeypatch.setattr(op6_secrets, "FILTER_WORDS", 1)
    assert sorted(map(tuple, op6_secrets.report(docs).collect())) == want and sum(r[1] for r in want) == 67


def test_other_kinds(spark):
    texts = ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890-abc", "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 8, "ghp_short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",")} for r in op6_secrets.report(docs).collect()}
    assert "private_key" in kinds[0] and "git_token" in kinds[1] and "chat_token" in kinds[2] and "web_token" in kinds[3] and kinds[4] == {""}


def test_trigram_queries():
    assert op6_secrets.trigram_query(r"[0-9a-f]{16,}") is None
    assert op6_secrets.trigram_query(r"AKIA[A-Z0-9]{14,}") == [frozenset({"aki", "kia"})]
    assert op6_secrets.trigram_query(r"(abcd|xyz)q?") == [frozenset({"abc", "bcd"}), frozenset({"xyz"})]
    assert op6_secrets.trigram_query(r"(abcd|x.y)") is None
    assert op6_secrets.trigram_query(r"api_?key") == sorted([frozenset({"api", "pi_", "i_k", "_ke", "key"}), frozenset({"api", "pik", "ike", "key"})], key=sorted)


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").where("doc_id > 0")
    plan = op6_secrets.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hot_keys_join_the_same(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ledgerspark.llm import common

    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(900)] + [(99, 1000)], "k long, x long")
    groups = spark.createDataFrame([(k, f"g{k}") for k in range(7)], "k long, g string").join(rows.groupBy("k").agg(F.count("*").alias("n")), "k")
    want = sorted((k if i % 3 else 0, i, f"g{k if i % 3 else 0}") for i, k in ((i, i % 7) for i in range(900)))
    for least in (100, 1, 10**6):
        monkeypatch.setattr(common, "HOT_LEAST", least)
        got = common.spread_join(rows, groups, ["k"])
        assert got.columns == ["k", "x", "g"] and sorted(map(tuple, got.collect())) == want

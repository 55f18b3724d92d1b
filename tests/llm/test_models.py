"""The language model, the classifier and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import op2_hpylm, op8_toxicity


def words(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [*raw.split(), None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def test_tokens_and_contexts():
    h, counts = op2_hpylm.tokens([b"The cat", b"", b"\x0bTHE\x0cthe dog "])
    assert counts.tolist() == [3, 1, 4] and h[0] == h[4] == h[5] and h[2] == h[3] == h[7]
    frequent = np.sort(np.unique(h[[0]]))
    assert op2_hpylm.contexts(h, counts, frequent).tolist() == [0, 1, 1, 0, 0, 1, 1, 1]


def test_seating():
    rng = np.random.default_rng(1)
    c = np.array([0, 1, 2, 50, 100_000])
    t = op2_hpylm.seat(c, np.full(5, 2.0), 0.5, rng)
    assert t[0] == 0 and t[1] == 1 and 1 <= t[2] <= 2 and (t <= np.maximum(c, 0)).all() and 1 <= t[4] < 30
    # two customers of one dish: the second opens a table with probability a / (a + 1 - d)
    many = op2_hpylm.seat(np.full(20_000, 2), np.full(20_000, 2.0), 0.5, rng)
    assert abs((many == 2).mean() - 2 / 2.5) < 0.02


def summed_mean(c, a, d, most):
    """Mean tables of a dish from the sum over all seatings, in logarithms, up to ``most`` tables."""
    row = np.full(most + 1, -np.inf)
    row[0] = 0
    for n in range(c):
        stay = n - d * np.arange(most + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            row = np.logaddexp(np.append(-np.inf, row[:-1]), row + np.where(stay > 0, np.log(stay), -np.inf))
    w = row + np.arange(most + 1) * math.log(a)
    w = np.exp(w - w.max())
    return (w * np.arange(most + 1)).sum() / w.sum()


@pytest.mark.parametrize("customers,opening,discount", [(30, 5.0, 0.8), (30, 1.0, 0.5), (20, 0.05, 0.9), (5, 0.1, 0.8), (1000, 2.0, 0.5), (1000, 100.0, 0.5), (2000, 3.0, 0.7), (10_000, 100.0, 0.9), (3000, 400.0, 0.3)])
def test_seats_are_those_of_all_seatings(customers, opening, discount):
    rng, n = np.random.default_rng(1), 60_000 if customers <= 1000 else 20_000
    got = op2_hpylm.seat(np.full(n, customers), np.full(n, opening), discount, rng)
    want = summed_mean(customers, opening, discount, min(customers, 1500))
    assert abs(got.mean() / want - 1) < 0.01 and got.min() >= 1


def gibbs_one_by_one(train, tests, steps, burn):
    """Log10 of averaged predictions of ``tests``, from restaurants whose tables are all kept, reseating one customer at a time."""
    rng = random.Random(5)

    def stream(text):
        before = ""
        for w in words(text):
            yield before, w
            before = before if w is None else w

    customers = [pair for t in train for pair in stream(t)]
    counts = Counter(customers)
    served, known = Counter(w for _, w in counts), {w for _, w in customers}
    rate = lambda c: min(0.95, max(0.05, (one := sum(n == 1 for n in c.values())) / max(1, one + 2 * sum(n == 2 for n in c.values()))))
    d, d0, strength, root_strength = rate(counts), rate(served), op2_hpylm.STRENGTH, op2_hpylm.ROOT_STRENGTH
    child = {pair: [n] for pair, n in counts.items()}
    root = {w: [n] for w, n in served.items()}
    tables, of_context = Counter(u for u, _ in counts), Counter(u for u, _ in customers)

    def below(w):
        held, whole = root.get(w, []), root_strength + sum(tables.values())
        return (sum(held) - d0 * len(held) + (root_strength + d0 * sum(map(len, root.values()))) / (len(known) + 1)) / whole

    def leave(sizes):
        k = rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            del sizes[k]
            return True
        return False

    def join(sizes, discount, opening):
        k = rng.choices(range(len(sizes) + 1), [n - discount for n in sizes] + [opening])[0]
        if k == len(sizes):
            sizes.append(1)
            return True
        sizes[k] += 1
        return False

    asked, total = [list(stream(t)) for t in tests], [0.0] * sum(len(words(t)) for t in tests)
    for step in range(burn + steps):
        for u, w in customers:
            if leave(child[u, w]):
                tables[u] -= 1
                leave(root[w])
            if join(child[u, w], d, (strength + d * tables[u]) * below(w)):
                join(root[w], d0, (root_strength + d0 * sum(map(len, root.values()))) / (len(known) + 1))
                tables[u] += 1
        if step >= burn:
            for i, (u, w) in enumerate(pair for text in asked for pair in text):
                total[i] += (counts[u, w] - d * len(child.get((u, w), [])) + (strength + d * tables[u]) * below(w)) / (strength + of_context[u])
    logs, at = [], 0
    for text in asked:
        logs.append(sum(math.log10(x / steps) for x in total[at : at + len(text)]))
        at += len(text)
    return logs


def test_scores_are_those_of_gibbs_one_by_one(spark):
    rng = random.Random(8)
    follow = {"": "ab", "a": "bbc", "b": "ccad", "c": "a", "d": "ad"}
    rows = []
    for i in range(60):
        text, w = [], ""
        for _ in range(rng.randint(1, 12)):
            w = rng.choice(follow[w])
            text.append(w)
        rows.append((i, " ".join(text)))
    got = {r.doc_id: r.score for r in op2_hpylm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), burn=6, kept=40).collect()}
    tests = [t for i, t in rows if held(i)]
    want = dict(zip([i for i, _ in rows if held(i)], gibbs_one_by_one([t for i, t in rows if not held(i)], tests, 60, 20), strict=True))
    assert len(want) > 5 and abs(sum(got[i] for i in want) / sum(want.values()) - 1) < 0.01
    assert all(abs(got[i] / want[i] - 1) < 0.05 for i in want)


def test_every_preceding_word_is_a_context(spark, monkeypatch):
    # 200 words, equally frequent, each with two followers of its own: of 63 contexts most words would have none
    rng = random.Random(9)
    follow = {i: rng.sample(range(200), 2) for i in range(200)}
    rows = []
    for i in range(120):
        w, text = rng.randrange(200), []
        for _ in range(25):
            text.append(f"w{w}")
            w = rng.choice(follow[w])
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    tests = [t for i, t in rows if held(i)]
    want = dict(zip([i for i, _ in rows if held(i)], gibbs_one_by_one([t for i, t in rows if not held(i)], tests, 30, 10), strict=True))
    # all words, some or none are dealt by context, and contexts go as numbers or as hashes
    for hot, book in ((op2_hpylm.HOT, op2_hpylm.CONTEXTS), (5, 20), (0, 0)):
        monkeypatch.setattr(op2_hpylm, "HOT", hot)
        frequent = op2_hpylm.frequent_words
        monkeypatch.setattr(op2_hpylm, "frequent_words", lambda rows, book=book, frequent=frequent: frequent(rows, book))
        got = {r.doc_id: r for r in op2_hpylm.score(docs, burn=4, kept=8).collect()}
        monkeypatch.setattr(op2_hpylm, "frequent_words", frequent)
        assert all(abs(got[i].score / want[i] - 1) < 0.05 for i in want)
        assert abs(sum(got[i].score for i in want) / sum(want.values()) - 1) < 0.01
        assert sum(got[i].score for i in want) > 0.7 * sum(got[i].base_score for i in want)


def test_predictions_add_up():
    rng = np.random.default_rng(2)
    n_words, contexts = 40, op2_hpylm.CONTEXTS + 1
    word = np.repeat(np.arange(n_words), contexts).astype(np.int32)
    context = np.tile(np.arange(contexts), n_words).astype(np.int64)
    counts = rng.poisson(0.7, len(word)).astype(np.int64)
    counts[word == 0] += 1
    customers = np.bincount(context, counts, contexts).astype(np.int64)
    known = int((np.bincount(word, counts) > 0).sum())
    totals = op2_hpylm.Totals(known, int(counts.sum()), customers, 0.5, 0.5)
    for _ in range(4):
        *_, (tables, _, opened) = op2_hpylm.sweeps(3, context, word, counts, totals)
        totals.tables.append(np.bincount(context, tables, contexts).astype(np.int64))
        totals.opened.append(int(opened.sum()))
    p = op2_hpylm.predict(3, context, word, counts, totals, burn=1)
    seen = np.isin(word, np.flatnonzero(np.bincount(word, counts)))
    whole = np.bincount(context[seen], p[seen], contexts)
    # what is left in each context is the one unknown word's
    assert (whole < 1).all() and (whole > 0.5).all()
    of_unknown = []
    for i in range(2, 4):
        t, r = totals.tables[i], totals.opened[i]
        root = (op2_hpylm.ROOT_STRENGTH + 0.5 * r) / (op2_hpylm.ROOT_STRENGTH + t.sum()) / (known + 1)
        of_unknown.append((op2_hpylm.STRENGTH + 0.5 * t) / (op2_hpylm.STRENGTH + customers) * root)
    assert np.allclose(whole + np.mean(of_unknown, 0), 1)


def test_scores(spark):
    rng = random.Random(3)
    lines = {"a": ["red", "blue", "green"], "b": ["uno", "dos", "tres"]}
    rows = []
    for i in range(300):
        k = rng.choice("ab")
        rows.append((i, " ".join([f"lang{k}"] + [rng.choice(lines[k]) for _ in range(rng.randint(0, 30))])))
    rows += [(None, "red"), (300, None), (301, ""), (5, rows[5][1]), (302, "never seen before " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as chunk").repartition(3)
    got = op2_hpylm.score(docs).collect()
    seen = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(seen.values()), len(seen)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    for i, t in rows:
        r, w = by[i], words(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(seen[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
    test = [r for r in got if r.held_out and r.n_known == r.n_tokens]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert op2_hpylm.score(docs.where("false")).collect() == []


# -- toxicity


def corpus(n=600):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.15
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgling", "Zorgly", "qwaxer", "qwaxed", "uzzbrat"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = corpus()
    repeats = [(9002, rows[0][1])] * 3 + [rows[5][:2]] * 4
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (9000, ""), (9001, "zorgling " * 20_000), *repeats], "doc_id long, text string").selectExpr("*", "1 as score")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9000, None)], "doc_id long, toxic int")
    model = op8_toxicity.fit(docs, labels)
    assert all(any(w.startswith(p) for w in model.against) for p in ("zorg", "qwax", "uzzb"))
    got = {r.doc_id: r for r in op8_toxicity.score(docs, model).collect()}
    test = [(got[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == 1 and y == 0 for p, y in test) == 0 and sum(p == 1 for p, y in test if y) >= 0.95 * sum(y for _, y in test)
    assert got[None].predicted == got[9000].predicted == 0 and got[9001].predicted == 1 and 0 <= got[None].score <= 1
    kept = op8_toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert op8_toxicity.score(docs.where("false"), model).collect() == []


def test_repeated_ids_are_fitted_on_once(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = (op8_toxicity.fit(d, labels) for d in (docs, docs.union(docs).union(docs)))
    assert a.against == b.against and np.allclose(a.weights, b.weights)


def brute_posterior(m, ballot, given):
    yes, no = m.prior, 1 - m.prior
    for fired, p1, p0, share in zip(ballot, m.on_toxic, m.on_clean, m.share, strict=True):
        yes, no = (yes * p1 ** (1 / share), no * p0 ** (1 / share)) if fired else (yes, no)
    yes, no = (yes * m.given[0], no * m.given[1]) if given else (yes * (1 - m.given[0]), no * (1 - m.given[1]))
    return yes / (yes + no)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(6)
    truth = rng.random(6000) < 0.2
    on1, on0 = np.array([0.5, 0.4, 0.3, 0.2, 0.1, 0.2]), np.array([0.02, 0.05, 0.1, 0.2, 0.5, 0.7])
    votes = (rng.random((6000, 6)) < np.where(truth[:, None], on1, on0)).astype(np.int8)
    votes = np.hstack([votes, votes[:, :1], votes[:, :1]])  # two copies of a voter
    given = np.where(rng.random(6000) < 0.05, ~truth, truth).astype(int)
    m = op8_toxicity.label_model(votes, given, np.ones(6000), np.array([1, 1, 1, 1, -1, -1, 1, 1]), truth.mean())
    assert np.abs(m.on_toxic[:6] - on1).max() < 0.12 and np.abs(m.on_clean[:6] - on0).max() < 0.05
    assert np.allclose(m.share[[0, 6, 7]], 3, atol=0.1) and m.share[3] < 1.5
    assert abs(m.given[0] - 0.95) < 0.08 and abs(m.given[1] - 0.05) < 0.05
    post = m.posterior(votes.astype(float), given)
    assert all(math.isclose(post[i], brute_posterior(m, votes[i], given[i]), rel_tol=1e-9) for i in range(50))
    assert ((post > 0.5) == truth).mean() > 0.94


def test_linear_fit_is_the_minimum():
    rng = np.random.default_rng(7)
    x, weight = (rng.random((200, 4)) < 0.3).astype(float), rng.integers(1, 5, 200).astype(float)
    target = rng.random(200)
    w, b = op8_toxicity.fit_linear(x, weight, target)

    def loss(w, b):
        z = x @ w + b
        return (weight * (np.logaddexp(0, z) - target * z)).sum() + 0.0025 * (w @ w) + 0.0005 * b * b

    assert all(loss(w, b) <= loss(w + rng.normal(size=4) * 0.01, b + rng.normal() * 0.01) for _ in range(200))
    whole, often = op8_toxicity.fit_linear(np.repeat(x, weight.astype(int), 0), np.ones(int(weight.sum())), np.repeat(target, weight.astype(int)))
    assert np.allclose(w, whole) and math.isclose(b, often, rel_tol=1e-6)


def test_held_out_labels_are_not_read(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    same = [spark.createDataFrame([(i, 1 - y if flip and fold(i) else y) for i, _, y in rows], "doc_id long, toxic int") for flip in (False, True)]
    a, b = (op8_toxicity.fit(docs, x) for x in same)
    assert (a.against, a.favour) == (b.against, b.favour) and np.array_equal(a.weights, b.weights)


@pytest.mark.parametrize("label", [0, 1, None])
def test_labels_of_one_kind(spark, label):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, label) for i in range(20)], "doc_id long, toxic int")
    assert all(r.score < 0.01 and r.predicted == 0 for r in op8_toxicity.score(docs, op8_toxicity.fit(docs, labels)).collect())


# -- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    rows = corpus(150)
    long = [" ".join("".join(rng.choice("nopqrstuv") for _ in range(5)) for _ in range(200)) for _ in range(3)]
    extra = [(1000, long[0]), (1001, long[0]), (1002, long[0] + " tail"), (1003, long[1] + " token=abcdefghijklmnop1"), (1004, long[2])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + extra, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'src0' as source", "cast(length(text) as bigint) as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id for r in packed.collect()}
    assert kept == {i for i, _, y in rows if not y} | {1000, 1003, 1004}
    stage = dict(corpus_pipeline.STAGES)
    masked = stage["secrets"](spark, docs, str(tmp_path)).where("doc_id = 1003").first()
    assert masked.text.endswith(" [SECRET]") and masked.n_chars == len(masked.text)
    assert stage["near_dedup"](spark, docs, str(tmp_path)).where(F.col("doc_id").isin(1001, 1002)).isEmpty()


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, columns of other names, an empty table: by plain rules."""
    import corpus_pipeline

    rng = random.Random(6)
    fresh = lambda n: " ".join("".join(rng.choice("bcdfgklmnprst") for _ in range(6)) for _ in range(n))
    rows, base = corpus(150), fresh(300)
    long = fresh(60_000)
    # copies at 0.8 and more of their five-word shingles, and one below
    near, far = base + " tail end", base[: len(base) // 2] + " " + fresh(150)
    extra = [(2000, None), (2001, ""), (2002, "  \n"), (2003, base), (2004, base), (2004, base), (2005, near), (2006, far), (2007, long), (2008, long + " one more"), (None, fresh(50)), (2009, "one two"), (2010, "one two"), (2011, "token=abcdefghijklmnop12 " + fresh(80))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, stage string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", None) for i, t in [(i, t) for i, t, _ in rows] + extra], schema)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, None, None), (2000, 1, None)], "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    def alike(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b) if a | b else 1.0

    clean = [(i, t) for i, t, y in rows if not y] + extra
    sets, root = [shingles(t) for _, t in clean], list(range(len(clean)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(clean)):
        for b in range(a):
            if alike(sets[a], sets[b]) >= 0.8:
                root[find(a)] = find(b)
    groups = {}
    for n, (i, _) in enumerate(clean):
        groups.setdefault(find(n), []).append((i is None, i))
    want = sorted(min(g) for g in groups.values())
    got = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == want
    assert {r.doc_id: r.n for r in got}[2000] == 1  # the end token alone
    empty = str(tmp_path / "none")
    docs.where("false").write.parquet(f"{empty}/documents.parquet")
    labels.where("false").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []

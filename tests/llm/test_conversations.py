"""Chat formats and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import op11_chats, op12_repair

TEXTS = ["", "ok.", "\\", "</s>", "<\\/s>", "<</SYS>>\n\n[INST] x [/INST]", "a\nb\n", "é😀 <s", "[/INST", "<<ROLE>>r<</ROLE>>", "\\\\[INST]\\", " </s>", "<<s>>", "$0 $1", "<</TURN>>"]


def turns_digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


# -- formats


def chat_rows():
    rng = random.Random(3)
    rows = [(c, n, rng.choice(["user", "assistant", "system", "tool", "", "<</ROLE>>"]), rng.choice(TEXTS) + rng.choice(TEXTS)) for c in range(40) for n in range(rng.randint(1, 20))]
    rows += [(50, None, "user", "no number"), (50, 1, None, None), (50, 1, "assistant", "same turn"), (50, 1, "assistant", "same turn"), (None, 1, "user", "no id"), (None, 2, "assistant", "none")]
    return rows + [(60, 0, "assistant", "long <s> " * 200_000)] + [(61, n, "assistant", f"{n}") for n in range(70)]


def test_chats_are_read_back(spark):
    rows = chat_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1)).withColumn("node", F.lit("x"))
    got = {r.conv_id: r for r in op11_chats.report(frame).collect()}
    want = {}
    for c, n, r, t in sorted(rows + [(-1, 0, "user", op11_chats.TRIAL), (-1, 1, "assistant", op11_chats.TRIAL)], key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), turns_digest(turns)), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_texts_hold_no_control_string(spark):
    texts = ["".join(p) for p in itertools.product(TEXTS, repeat=2)]
    for text, code, back in spark.createDataFrame([(t,) for t in texts], "t string").select("t", op11_chats.escaped(F.col("t")).alias("e")).select("t", "e", op11_chats.unescaped(F.col("e"))).collect():
        assert back == text and not any(c in code for c in op11_chats.CONTROL)


def brute_paths(replies, keep):
    """tree -> the best leaves' paths, by walking up from every leaf."""
    nodes = {}
    for tree, node, parent, role, text, score in replies:
        if node is not None:
            nodes[tree, node] = min(nodes.get((tree, node), (10**9,)), (parent if parent is not None else -1, role, text, score or 0.0))
    out = {}
    parents = {(t, v[0]) for (t, n), v in nodes.items() if v[0] != n}
    for (tree, node) in nodes:
        if (tree, node) in parents:
            continue
        path, at = [], node
        while at is not None and at not in path:
            path.append(at)
            up = nodes[tree, at][0]
            at, last = (up if (tree, up) in nodes and up != at else None), at
            if at in path:
                path = []
                break
        if path:
            out.setdefault(tree, []).append((-sum(nodes[tree, n][3] for n in path), node, [nodes[tree, n][1:3] for n in reversed(path)]))
    return {t: [p for _, _, p in sorted(v)[:keep]] for t, v in out.items()}


@pytest.mark.parametrize("keep", [None, 1, 3])
def test_reply_trees(spark, keep):
    rng = random.Random(5)
    replies = [(t, n, rng.randrange(n) if n else None, rng.choice(["user", "assistant"]), f"{t}-{n}", rng.choice([None, 0.0, 1.0, -2.0, 0.5])) for t in range(12) for n in range(rng.randint(1, 40))]
    replies += [(20, n, 0 if n else None, "user", f"star {n}", 1.0) for n in range(300)]
    replies += [(21, 1, 1, "user", "own parent", 1.0), (21, 2, 9, "user", "orphan", 1.0), (22, 1, 2, "user", "cycle", 1.0), (22, 2, 1, "user", "cycle", 1.0), (22, 3, 2, "user", "below", 1.0), (23, None, 1, "user", "no id", 1.0)]
    replies += [(24, 0, None, "user", "b", 1.0), (24, 0, None, "user", "a", 1.0), (24, 1, 0, "assistant", "c", 0.0), (24, 1, 0, "assistant", "c", 0.0)]
    frame = spark.createDataFrame(replies, "tree long, node long, parent long, role string, text string, score double").withColumn("branch", F.lit(0))
    chats = op11_chats.format_replies(frame, keep)
    got = {}
    for r in chats.select("tree", "branch", op11_chats.turns_of(F.col("formatted")).alias("turns")).orderBy("tree", "branch").collect():
        got.setdefault(r.tree, []).append([tuple(t) for t in r.turns])
    assert got == brute_paths(replies, keep)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in op11_chats.report(none).collect()] == [-1]
    assert op12_repair.report(op12_repair.damaged(none)).collect() == []


def test_only_native(spark, sf):
    plan = op11_chats.report(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|MapPartitions", plan)


# -- repair


def brute_audit(rows):
    """The least (cost, audit) over all edits, and the repaired rows, from a search without layers: strings are kept whole."""
    seen, kinds = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        gone = not bare or (role, text) in seen
        kinds.append((gone, not gone and bare[-1] not in ".!?"))
        seen.add((role, text))
    best = {("", 0): (0, "", ())}
    for n, (role, text) in enumerate([*rows, (None, None)]):
        held = {}

        def put(key, value):
            if key not in held or value < held[key]:
                held[key] = value

        for (roles, _), (cost, audit, out) in best.items():
            for run in range(4):
                made = list(out)
                word = roles
                for _ in range(run):
                    word += "a" if word[-1:] == "u" else "u"
                    made.append(("user" if word[-1] == "u" else "assistant", ""))
                paid, said = cost + 5 * run, audit + "I" * run
                if n == len(rows):
                    if re.fullmatch("(s?(ua)+)?", word):
                        put("end", (paid, said, tuple(made)))
                    continue
                gone, cut = kinds[n]
                put((word, 0), (paid + 2, said + "D", tuple(made)))
                if not gone:
                    for letter, price, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                        longer = word + new[:1]
                        if len(longer) > len(word) and re.fullmatch("(s?(ua)*u?)?", longer):
                            put((longer, 0), (paid + price + 5 * cut, said + letter, (*made, (new, text))))
        best = held
    return best["end"]


def brute_report(rows):
    """What the query returns for one conversation's damaged rows (turn, role, text) in order."""
    seen, counts = set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            counts[fault] += 1
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = brute_audit([r[1:] for r in rows])
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def brute_damage(rows):
    out = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        held = out.setdefault(c, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def conversation_rows():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "usher", "", None]
    texts = ["One.", "Two!", "Three?", "cut", "", "  \n", "end. \t", " ", None, "One."]
    rows = [(c, n, rng.choice(roles[: 2 + c % 6]), rng.choice(texts) if rng.random() < 0.5 else f"Said {n}.") for c in range(400) for n in range(rng.randint(1, 9))]
    rows += [(900, rng.choice([None, 1, 1, 2, 5, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(8)]
    return rows + [(None, 3, "user", "a."), (None, 4, "assistant", "b."), (901, None, None, None), (902, 1, "user", "x. " * 300_000), (902, 2, "assistant", "y.")]


def test_repairs(spark):
    rows = conversation_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("live", F.lit("x"))
    got = {r[0]: tuple(r)[1:] for r in op12_repair.report(op12_repair.damaged(frame)).collect()}
    want = {c: brute_report(v) for c, v in brute_damage(rows).items()}
    assert got == want


def test_repaired_rows(spark):
    rows = conversation_rows()
    frame = op12_repair.undamaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {}
    for r in op12_repair.repair(frame).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = {c: list(brute_audit([r[1:] for r in sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))])[2]) for c, v in by.items()}
    assert got == {c: v for c, v in want.items() if v}


def test_every_short_conversation():
    kinds = [("user", "a."), ("assistant", "b."), ("system", "c."), ("tool", "d."), ("user", "cut"), ("system", "cut"), ("assistant", "")]
    for n in range(5):
        for pick in itertools.product(kinds, repeat=n):
            rows = [(i, r, t if not t or t == "cut" else f"{i}{t}") for i, (r, t) in enumerate(pick)]
            rows = [(i, r, f"{i} cut" if t == "cut" else t) for i, r, t in rows]
            c = op12_repair.Conversation(0, LAYERS)
            for turn, role, text in rows:
                bare = text.strip()
                c.add(turn, role, text, not bare, False, bool(bare) and bare[-1] != ".")
            cost, audit, _ = c.solve()
            assert (cost, audit) == brute_audit([r[1:] for r in rows])[:2], rows


LAYERS = op12_repair.Layers()


def test_long_conversations_wait_on_disk(monkeypatch):
    rows = [(i, ("user", "assistant", "system")[i * i % 3], f"{i}.") for i in range(3_000)]
    plain, spooled = op12_repair.Conversation(0, op12_repair.Layers()), op12_repair.Conversation(0, op12_repair.Layers())
    for r in rows:
        plain.add(*r, False, False, False)
    monkeypatch.setattr(op12_repair, "SPOOL", 1_000)
    for r in rows:
        spooled.add(*r, False, False, False)
    audit = plain.solve()[1]
    assert spooled.file and spooled.solve()[1] == audit and list(spooled.repaired(audit)) == list(plain.repaired(audit))
    assert len(plain.layers.steps) < 200

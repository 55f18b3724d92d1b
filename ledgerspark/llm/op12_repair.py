"""Operator 12: conversations repaired by the cheapest edits, with a rank-compressed dynamic program.

Every row is kept (0), given the role that its place asks for (1) or deleted (2); empty turns may be inserted anywhere (5).
Blank and repeated rows have to go, and an unfinished row that stays costs 5 more.  The result's role initials match
``(s?(ua)+)?``, and among the cheapest edits those whose audit (the initials D, I, K, R in order) sorts first are taken.

The program has a layer for each row and four states (nothing yet, after s, after u, after a).  One macro edit is a run of
up to two insertions and then the row's own edit: D, ID, IID, IIK, IIR, IK, IR, K, R, a prefix-free code in ASCII order.
So the audits of a layer are prefix-free too, and two of them compare as (rank of the parent's audit, macro): a state holds
its cost, its audit's rank in the layer, a parent state and a macro, and no strings.  Audits are read off the pointers in
the end.  Costs count from the layer's least and states that can't win are dropped, so few layers exist; each is computed
once for each kind of row, and a row of a conversation leaves one small integer.

Longer runs are never cheapest: two insertions in a row that lead back to a state can be left out.  From "after a" all goes
on as from "after s", and as from "nothing yet" but for a row s that is deleted for 2; hence the bounds in ``SLACK``.

Rows are dealt by conversation, sorted on disk if need be, and streamed.  Repeats are found before, in the same partitions.
A conversation's rows wait for its last one in memory, or in the task's own temporary file beyond ``SPOOL`` bytes, so a
conversation of any length takes 4 bytes of memory a row; that one task reads it all is in the nature of a hash over it.

Cases: a null id is a conversation of its own; null turns sort first and take no part in gaps; rows of equal turns sort by
role and text; null roles and texts count as one space; an empty role has no initial, so its row is given a role or goes;
conversations without rows have zeros, an empty audit and no turns; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a conversation's texts that wait in memory.
SPOOL = 16 << 20
#: White space, and what a finished text ends with.
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")

#: States, and what each can take next: (initial, state after it).
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
COST = {"D": 2, "I": 5, "K": 0, "R": 1}
UNFINISHED = 5
MACROS = sorted("I" * run + edit for run in range(3) for edit in "DKR")
#: Insertions that end a conversation in each state.
CLOSING = ("", "II", "I", "")
#: How much more than "after a" a state may cost and still win.
SLACK = {NOTHING: 2, AFTER_S: 0, AFTER_U: 5}

#: A layer: for each state (cost above the layer's least, rank of its audit) or None.
Layer = tuple[tuple[int, int] | None, ...]
FIRST: Layer = ((0, 0), None, None, None)


def inserted(state: int) -> int:
    """The state after an inserted turn."""
    return AFTER_A if state == AFTER_U else AFTER_U


def step(layer: Layer, initial: str, goes: bool, unfinished: bool) -> tuple[Layer, int, tuple]:
    """The next layer, the cost of its least, and for each state (parent state, macro)."""
    best: list[tuple[int, int, int, int] | None] = [None] * 4
    for state, held in enumerate(layer):
        if held is None:
            continue
        for code, macro in enumerate(MACROS):
            at, edit = state, macro[-1]
            if goes and edit != "D":
                continue
            for _ in macro[:-1]:
                at = inserted(at)
            if edit == "R":
                at = inserted(at)
            elif edit == "K":
                at = NEXT[at].get(initial)
                if at is None:
                    continue
            cost = held[0] + sum(COST[e] for e in macro) + UNFINISHED * (unfinished and edit != "D")
            found = (cost, held[1], code, state)
            if best[at] is None or found < best[at]:
                best[at] = found
    for state, slack in SLACK.items():
        if best[state] and best[AFTER_A] and best[state][0] > best[AFTER_A][0] + slack:
            best[state] = None
    least = min(b[0] for b in best if b)
    rank = {pair: i for i, pair in enumerate(sorted(b[1:3] for b in best if b))}
    return tuple(b and (b[0] - least, rank[b[1:3]]) for b in best), least, tuple(b and (b[3], MACROS[b[2]]) for b in best)


class Layers:
    """Layers met so far, and what each kind of row makes of them."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.steps: list[tuple[Layer, int, tuple]] = []

    def follow(self, layer: Layer, kind: tuple[str, bool, bool]) -> int:
        at = self.known.get((layer, kind))
        if at is None:
            at = self.known[layer, kind] = len(self.steps)
            self.steps.append(step(layer, *kind))
        return at


class Conversation:
    """A conversation as its rows come in."""

    def __init__(self, key, layers: Layers) -> None:
        self.key, self.layers, self.layer, self.cost = key, layers, FIRST, 0
        self.moves, self.rows, self.held, self.file = array("I"), [], 0, None
        self.first = self.last = self.initial = None
        self.turns = self.blank = self.repeated = self.unfinished = self.illegal = 0

    def add(self, turn, role: str, text: str, blank: bool, repeated: bool, unfinished: bool) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        unfinished = unfinished and not blank and not repeated
        self.blank, self.repeated, self.unfinished = self.blank + blank, self.repeated + (repeated and not blank), self.unfinished + unfinished
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        at = self.layers.follow(self.layer, (initial if initial in ("s", "u", "a") else "", blank or repeated, unfinished))
        self.layer, cost, _ = self.layers.steps[at]
        self.cost += cost
        self.moves.append(at)
        self.rows.append((turn, role, text))
        self.held += len(text) + len(role) + 100
        if self.held > SPOOL:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file, pickle.HIGHEST_PROTOCOL)
            self.rows, self.held = [], 0

    def solve(self) -> tuple[int, str, int]:
        """The least cost, its first audit, and the state before the closing insertions."""
        cost, _, state = min((held[0] + sum(COST[e] for e in CLOSING[s]), held[1], s) for s, held in enumerate(self.layer) if held)
        end, edits = state, []
        for at in reversed(self.moves):
            state, macro = self.layers.steps[at][2][state]
            edits.append(macro)
        return self.cost + cost, "".join(reversed(edits)) + CLOSING[end], end

    def originals(self) -> Iterator[tuple]:
        if self.file:
            self.file.seek(0)
            while True:
                try:
                    yield from pickle.load(self.file)
                except EOFError:
                    break
        yield from self.rows

    def repaired(self, audit: str) -> Iterator[tuple]:
        """(edit, turn, role, text) of the rows that the audit leaves."""
        rows, state = self.originals(), NOTHING
        for edit in audit:
            turn, role, text = (None, "", "") if edit == "I" else next(rows)
            if edit == "D":
                continue
            if edit == "K":
                state = NEXT[state][role[:1]]
            else:
                state = inserted(state)
                role = ROLE[state]
            yield edit, turn, role, text


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of ``conv_id:turn`` modulo 20; a dropped row stays as one that isn't ``live``."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    known = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return known.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("live"), F.explode(copies).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, live) with their faults, dealt by conversation and sorted by turn."""
    cut = F.rtrim(F.col("text"), F.lit(SPACE))
    own = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    seen = Window.partitionBy("conv_id", "live", "own").orderBy(F.asc_nulls_first("turn"))
    dealt = rows.select("conv_id", "turn", "role", "text", "live", (cut == "").alias("blank"), (~F.right(cut, F.lit(1)).isin(*ENDS)).alias("unfinished"), own.alias("own")).repartition("conv_id")
    marked = dealt.withColumn("repeated", F.row_number().over(seen) > 1).drop("own")
    return marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    layers, now = Layers(), None
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "live", "blank", "repeated", "unfinished")}
        for key, turn, role, text, live, *faults in zip(*columns.values(), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    yield now
                now = Conversation(key, layers)
            if live:
                now.add(turn, role, text, *faults)
    if now is not None:
        yield now


def _batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about so many bytes, 10,000 rows at most."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += sum(len(x) for x in row if isinstance(x, str)) + 100
        if total > size or len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _key_type(rows: DataFrame) -> tuple[str, pa.DataType]:
    kind = rows.schema["conv_id"].dataType.simpleString()
    return kind, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def report(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and a digest of the repaired turns, for each conversation of (conv_id, turn, role, text, live)."""
    kind, key = _key_type(rows)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", key), *((n, pa.int64()) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for c in _conversations(batches):
            cost, audit, _ = c.solve()
            digest, mark = hashlib.sha256(), b""
            for _, _, role, text in c.repaired(audit):
                digest.update(mark + f"{role}:{text}".encode())
                mark = b"\n"
            gaps = 0 if c.first is None else c.last - c.first + 1 - c.turns
            yield c.key, gaps, c.blank, c.repeated, c.unfinished, c.illegal, cost, audit, digest.hexdigest()

    columns = ", ".join(f"{n} long" for n in names)
    return ordered(rows).mapInArrow(lambda batches: _batches(schema, told(batches)), f"conv_id {kind}, {columns}, audit string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, turn, role, text); inserted turns have no turn number."""
    kind, key = _key_type(rows)
    schema = pa.schema([("conv_id", key), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for c in _conversations(batches):
            for place, row in enumerate(c.repaired(c.solve()[1])):
                yield c.key, place, *row

    return ordered(rows).mapInArrow(lambda batches: _batches(schema, mended(batches)), f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def undamaged(rows: DataFrame) -> DataFrame:
    """Conversations as they are, in the columns that ``report`` and ``repair`` take."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), F.lit(True).alias("live"))

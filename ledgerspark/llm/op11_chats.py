"""Operator 11: reply trees formatted as conversations, in DataFrame functions alone.

A reply table has a node for each message: (tree, node, parent, role, text, score).  Self-joins double the reach of every
node's pointer to an ancestor, round after round, and add up the scores on the way, so a tree that is d replies deep takes
log2(d) rounds of narrow rows.  Leaves are ranked within their tree by the sum of the scores from the root down, the
chosen ones' paths are enumerated by joins with the same pointers, and each path becomes one conversation.

The template: ``<s>[INST] user [/INST]``, `` assistant </s>``, ``<<SYS>>\\nsystem\\n<</SYS>>\\n\\n``, and
``<<ROLE>>role<</ROLE>>text<</TURN>>`` for any other role.  In texts and roles a backslash is doubled and a control string
gets one after its first character, so no text holds a control string; a backslash is undone with the character after it.
The loss mask is a list of spans of the formatted text that cover the assistant's texts, without the marks around them.

Cases: null roles and texts are empty; null scores are 0; a null tree is a tree of its own; nodes without an id are
dropped; of rows that repeat a node the least (parent, role, text, score) stays; a node whose parent is absent, null or
itself is a root; nodes on or below a cycle are on no path; equal scores go to the lesser leaf; an empty table gives none;
other columns are ignored, whatever their names.  A conversation is one row, so it has to fit a task, as does its longest
text; the rows of one tree are else spread by node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved

#: What stands before and after the text of a turn.
OPEN = {"user": "<s>[INST] ", "assistant": " ", "system": "<<SYS>>\n"}
CLOSE = {"user": " [/INST]", "assistant": " </s>", "system": "\n<</SYS>>\n\n"}
#: The same for other roles, with the role between the first two.
OTHER = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", *OTHER)
#: A backslash, or the first character of a control string.
MARKED = r"\\|<(?=/?s>|</?SYS>>|</?ROLE>>|</TURN>>)|\[(?=/?INST\])"
#: One turn of a formatted conversation.
TURN = r"(?s)<s>\[INST\] .*? \[/INST\]|<<SYS>>\n.*?\n<</SYS>>\n\n|<<ROLE>>.*?<</ROLE>>.*?<</TURN>>| .*? </s>"
OTHER_ROLE, OTHER_TEXT = r"(?s)^<<ROLE>>(.*?)<</ROLE>>", r"(?s)^<<ROLE>>.*?<</ROLE>>(.*)<</TURN>>\z"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, MARKED, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def as_replies(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees: each row answers the one before it by turn, null turns first."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.row_number().over(order).cast("long"))
    return placed.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _nodes(replies: DataFrame) -> DataFrame:
    """One row for each node, written."""
    rows = replies.where("node is not null").select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    first = Window.partitionBy("tree", "node").orderBy(F.asc_nulls_first("parent"), "role", "text", "score")
    return saved(rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth"), "replies")


def _same(a: str, b: str) -> Column:
    return F.col(f"a.tree").eqNullSafe(F.col("b.tree")) & (F.col(f"a.{a}") == F.col(f"b.{b}"))


def pointers(nodes: DataFrame) -> list[DataFrame]:
    """Tables of (tree, node, up, depth, score), one a round: ``up`` is the ancestor 2**round above, null past the root.

    Depth and score are those of the nodes from this one up to the one below ``up``.  In the last table ``up`` is null but
    for nodes on or below a cycle.
    """
    own = nodes.select("tree", "node", "parent", "score")
    answers = own.where("parent is not null and parent <> node")
    known = answers.alias("a").join(own.alias("b"), _same("parent", "node"), "left")
    first = known.select("a.tree", "a.node", F.col("b.node").alias("up"), F.lit(1).cast("long").alias("depth"), "a.score")
    roots = own.where("parent is null or parent = node").select("tree", "node", F.lit(None).cast(own.schema["node"].dataType).alias("up"), F.lit(1).cast("long").alias("depth"), "score")
    tables, reach = [saved(first.unionByName(roots), "pointers")], 1
    while True:
        now = tables[-1]
        rows, left = now.agg(F.count("*"), F.count("up")).first()
        if not left or reach > rows:
            return tables
        joined = now.where("up is not null").alias("a").join(now.alias("b"), _same("up", "node"))
        ahead = joined.select("a.tree", "a.node", "b.up", (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.score") + F.col("b.score")).alias("score"))
        tables.append(saved(ahead.unionByName(now.where("up is null")), "pointers"))
        reach *= 2


def branches(tables: list[DataFrame], keep: int | None = None) -> DataFrame:
    """(tree, leaf, branch, depth, score) of the chosen leaves, the best ``keep`` of each tree (all, if None); branches count from 1."""
    ups = tables[0].where("up is not null").select("tree", "up").distinct()
    whole = tables[-1].where("up is null")
    leaves = whole.alias("a").join(ups.alias("b"), _same("node", "up"), "left_anti").select("tree", F.col("node").alias("leaf"), "depth", "score")
    best = [F.desc("score"), F.asc("leaf")]
    if keep is not None:  # first within parts of a tree
        leaves = leaves.withColumn("part", F.pmod(F.xxhash64("leaf"), F.lit(64)))
        leaves = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*best))).where(F.col("branch") <= keep).drop("part")
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(*best)))
    return ranked if keep is None else ranked.where(F.col("branch") <= keep)


def paths(tables: list[DataFrame], chosen: DataFrame) -> DataFrame:
    """(tree, leaf, branch, step, node): the nodes from the root, at step 0, to each chosen leaf; written."""
    at = saved(chosen.select("tree", "leaf", "branch", "depth", F.lit(0).cast("long").alias("above"), F.col("leaf").alias("node")), "paths")
    for k, table in enumerate(tables):
        found = at.alias("a").join(table.where("up is not null").alias("b"), _same("node", "node"))
        further = found.select("a.tree", "a.leaf", "a.branch", "a.depth", (F.col("a.above") + 2**k).alias("above"), F.col("b.up").alias("node"))
        if k < len(tables) - 1:
            before, at = at, saved(at.unionByName(further), "paths")
            discard(before)
    return at.select("tree", "leaf", "branch", (F.col("depth") - 1 - F.col("above")).alias("step"), "node")


def _by_role(role: Column, known: dict[str, str], other: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, mark in known.items():
        out = out.when(role == name, F.lit(mark))
    return out.otherwise(other)


def format_paths(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(tree, leaf, branch, formatted, loss): a conversation for each path; loss: spans (start, length) in code points."""
    turns = steps.alias("a").join(nodes.alias("b"), _same("node", "node")).select("a.tree", "a.leaf", "a.branch", "a.step", "b.role", escaped(F.col("b.text")).alias("body"))
    turns = turns.withColumn("before", _by_role(F.col("role"), OPEN, F.concat(F.lit(OTHER[0]), escaped(F.col("role")), F.lit(OTHER[1])))).withColumn("after", _by_role(F.col("role"), CLOSE, F.lit(OTHER[2])))
    earlier = Window.partitionBy("tree", "leaf", "branch").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    width = F.length("before") + F.length("body") + F.length("after")
    placed = turns.withColumn("start", F.coalesce(F.sum(width).over(earlier), F.lit(0)) + F.length("before"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("int").alias("start"), F.length("body").alias("length")))
    rows = placed.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list(F.struct("step", F.concat("before", "body", "after").alias("piece"), span.alias("span")))).alias("rows"))
    return rows.select("tree", "leaf", "branch", F.array_join(F.col("rows.piece"), "").alias("formatted"), F.filter(F.col("rows.span"), lambda s: s.isNotNull()).alias("loss"))


def format_replies(replies: DataFrame, keep: int | None = None) -> DataFrame:
    """The best ``keep`` branches of every reply tree (all, if None), each as one formatted conversation with its loss mask."""
    nodes = _nodes(replies)
    tables = pointers(nodes)
    return format_paths(nodes, paths(tables, branches(tables, keep)))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation is made of."""

    def turn(t: Column) -> Column:
        role = F.when(F.startswith(t, F.lit("<s>")), F.lit("user")).when(F.startswith(t, F.lit(" ")), F.lit("assistant")).when(F.startswith(t, F.lit(OPEN["system"])), F.lit("system"))
        text = F.when(F.lit(False), F.lit(""))
        for name in OPEN:
            text = text.when(F.startswith(t, F.lit(OPEN[name])), F.substr(t, F.lit(len(OPEN[name]) + 1), F.length(t) - len(OPEN[name]) - len(CLOSE[name])))
        return F.struct(F.coalesce(role, unescaped(F.regexp_extract(t, OTHER_ROLE, 1))).alias("role"), unescaped(text.otherwise(F.regexp_extract(t, OTHER_TEXT, 1))).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["length"]))), "")


#: A conversation whose texts are control strings of the template.
TRIAL = "</s>[INST] ok [/INST]"


def report(rows: DataFrame) -> DataFrame:
    """Digests of all conversations, and of conversation -1 (a user and an assistant who say control strings), as read back."""
    kept = rows.select("conv_id", "turn", "role", "text")
    trial = rows.sparkSession.createDataFrame([(-1, 0, "user", TRIAL), (-1, 1, "assistant", TRIAL)], "conv_id long, turn long, role string, text string")
    chats = format_replies(as_replies(kept.unionByName(trial)))
    read = chats.select(F.col("tree").alias("conv_id"), "formatted", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def oracle() -> str:
    """The rows of ``report`` in DuckDB's SQL."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def width(text: str) -> str:
        return f"length({text}) + " + " + ".join(f"(length({text}) - length(replace({text}, {quoted(c)}, ''))) // {len(c)}" for c in ("\\", *CONTROL))

    marks = " ".join(f"WHEN '{r}' THEN {len(OPEN[r]) + len(CLOSE[r])}" for r in OPEN)
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {quoted(TRIAL)} UNION ALL SELECT -1, 1, 'assistant', {quoted(TRIAL)}
), sized AS (
  SELECT *, {width("text")} + CASE role {marks} ELSE {sum(map(len, OTHER))} + {width("role")} END AS wide,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(wide) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

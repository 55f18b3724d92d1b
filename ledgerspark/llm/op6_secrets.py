"""Operator 6: secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: alternatives of conjunctions of the trigrams that any match
must contain.  The inverted index holds postings (trigram, row key) for the trigrams that the rules ask for; postings
are intersected per conjunction, united per rule, and only the candidate rows are verified with the regex.  A rule
without mandatory trigrams (long hexadecimal runs) scans every row.

Spans are found natively: the text split by a rule's regex and the list of its matches alternate, so running sums of
their lengths give the places.  Offsets are in code points, ends exclusive.

Cases: null text is the empty text, which has no spans; an empty table gives an empty result; repeated rows and null
ids are kept row by row; several kinds may cover the same place; other columns are kept, whatever their names.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Alternatives that are followed while a regex is read; beyond it the strings read so far are kept as they are.
ALTERNATIVES = 32
#: Words of the bitmap of candidate keys: 8 MB of bits.
FILTER_WORDS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, and the least length of one group of a match."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)


def mandatory_strings(regex: str) -> list[list[str]]:
    """Alternatives of strings (lower case) that every match contains, for the parts of the regex that say so."""

    def read(items, held: list[list[str]]) -> list[list[str]]:
        # each alternative is a list of strings; its last one is still open to what follows
        for op, value in items:
            if op is sre.LITERAL:
                held = [[*a[:-1], a[-1] + chr(value).lower()] for a in held]
            elif op is sre.SUBPATTERN:
                held = read(value[-1], held)
            elif op is sre.BRANCH:
                held = [x for option in value[1] for x in read(option, held)]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] == 0 and value[1] == 1 and len(held) * 2 <= ALTERNATIVES:
                held = [*held, *read(value[2], held)]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                held = [[*a, ""] for a in read(value[2], held)]
            elif op is sre.IN and len(members := [v for o, v in value if o is sre.LITERAL]) == len(value) and len(held) * len(members) <= ALTERNATIVES:
                held = [[*a[:-1], a[-1] + chr(v).lower()] for a in held for v in members]
            else:
                held = [[*a, ""] for a in held]
        return held

    return read(sre_parser.parse(regex), [[""]])


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """The regex's query: any of these sets of trigrams, each set complete; None if nothing is mandatory."""
    clauses = {frozenset(s[i : i + 3] for s in alternative for i in range(len(s) - 2)) for alternative in mandatory_strings(regex)}
    if frozenset() in clauses:
        return None
    return sorted((c for c in clauses if not any(other < c for other in clauses)), key=sorted)


def candidates(texts: DataFrame, rules: tuple[Rule, ...], key_col: str, text_col: str) -> DataFrame:
    """Rows that may match the indexed rules: (key, rules array)."""
    spark = texts.sparkSession
    wanted = [(t, r.kind, i, len(clause)) for r in rules for i, clause in enumerate(trigram_query(r.regex) or []) for t in sorted(clause)]
    trigrams = sorted({w[0] for w in wanted})
    clauses = spark.createDataFrame(wanted, "trigram string, kind string, clause int, need int")
    low = texts.select(F.col(key_col), F.lower(F.col(text_col)).alias("low"))
    postings = low.select(key_col, F.explode(F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))).alias("trigram")).distinct()
    # the rules' clauses are a fixed handful of rows
    met = postings.join(F.broadcast(clauses), "trigram").groupBy(key_col, "kind", "clause", "need").agg(F.count("*").alias("have")).where("have = need")
    return met.groupBy(key_col).agg(F.collect_set("kind").alias("kinds"))


def spans_of(rule: Rule, rank: int, text: Column) -> Column:
    """Spans of one rule in a text: array of (start, rank, end, kind)."""
    regex = F.lit(rule.regex)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    checked = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(whole.alias("m"), checked.alias("g"), F.slice(F.split(text, rule.regex, -1), 1, F.greatest(F.size(whole), F.lit(0))).alias("before"))
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"
    none = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {kind})").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(rows, none, step, lambda acc: acc["found"])


def listed(spans: Column) -> Column:
    """Spans as text, kind:start:end joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], text_col: str) -> DataFrame:
    """(row, spans) of every row: the row as one struct, so that no helper can clash with its columns."""
    row, kinds = F.col("row"), F.col("kinds")
    text = F.coalesce(row[text_col], F.lit(""))
    plain = [c for c in docs.columns if not docs.schema[c].dataType.simpleString().startswith("map")]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("key", F.xxhash64(*(row[c] for c in plain)))
    indexed = tuple(r for r in rules if trigram_query(r.regex) is not None)
    found = saved(candidates(keyed.select("key", text.alias("text")), indexed, "key", "text"), "secret-candidates")
    # a bitmap of the candidates' keys, at most FILTER_WORDS rows: rows that it rules out need not meet the index
    place, bit = F.pmod(F.col("key"), F.lit(FILTER_WORDS)), F.shiftrightunsigned("key", 58).cast("int")
    words = found.select(place.alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits"))
    asked = keyed.withColumn("place", place).join(F.broadcast(words), "place", "left")
    may = F.coalesce(F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    met = asked.where(may).select("key", "row").join(found, "key", "left").select("row", "kinds")
    every = met.union(asked.where(~may).select("row", F.lit(None).cast("array<string>").alias("kinds")))
    spans = []
    for rank, rule in enumerate(rules):
        wanted = F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False)) if rule in indexed else F.lit(True)
        spans.append(F.when(wanted & F.rlike(text, F.lit(rule.regex)), spans_of(rule, rank, text)).otherwise(_none()))
    return every.select("row", *(s.alias(f"of_{i}") for i, s in enumerate(spans))).select("row", F.array_sort(F.concat(*(F.col(f"of_{i}") for i in range(len(rules))))).alias("spans"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text", spans_col: str = "secret_spans") -> DataFrame:
    """All columns of ``docs`` plus ``spans_col``: array of (start, rank, end, kind), by start, then rule.

    A column of that name in ``docs`` gives way to the spans.
    """
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != spans_col]
    return _scanned(docs, rules, text_col).select(*kept, F.col("spans").alias(spans_col))


def report(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: tuple[Rule, ...] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, digest of the base spans and all spans of every row."""
    found = find_secrets(docs.select(id_col, text_col), rules, text_col)
    spans = F.col("secret_spans")
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in base]
    plain = of(*(r.kind for r in base))
    return found.select(id_col, *counts, F.sha2(listed(plain), 256).alias("base_sha256"), listed(spans).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Documents with every secret replaced by a mark (spans that overlap share one); other columns stay as they are."""
    row, spans = F.col("row"), F.col("spans")
    text = F.coalesce(row[text_col], F.lit(""))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["done"]).otherwise(gap).alias("done"))

    clean = F.aggregate(spans, first, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
    masked = F.when(F.size(spans) > 0, clean).otherwise(row[text_col])
    return _scanned(docs, rules, text_col).select(*(masked.alias(c) if c == text_col else row[c].alias(c) for c in docs.columns))


def oracle(rules: tuple[Rule, ...] = BASE + MORE, base: tuple[Rule, ...] = BASE) -> str:
    """The report over ``documents`` in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for rank, r in enumerate(rules):
        parts.append(f"""
  SELECT rowid_, i AS nth, {rank} AS rank, {quote(r.kind)} AS kind, g[i] AS checked,
    coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS size, {r.least} AS least
  FROM (SELECT rowid_, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT rowid_, regexp_extract_all(t, {quote(r.regex)}, 0) AS m, regexp_extract_all(t, {quote(r.regex)}, {r.group}) AS g, regexp_split_to_array(t, {quote(r.regex)}) AS p FROM docs WHERE regexp_matches(t, {quote(r.regex)})))""")
    named = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT)"
    kinds = ", ".join(quote(r.kind) for r in base)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rowid_, doc_id, coalesce(text, '') AS t FROM documents),
hits AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE length(checked) >= least),
made AS (
  SELECT rowid_, {', '.join(f"count(*) FILTER (kind = {quote(r.kind)}) AS n_{r.kind}" for r in base)},
    string_agg({named}, ',' ORDER BY start, rank) FILTER (kind IN ({kinds})) AS plain,
    string_agg({named}, ',' ORDER BY start, rank) AS spans FROM hits GROUP BY rowid_)
SELECT d.doc_id, {', '.join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in base)},
  sha256(coalesce(plain, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN made USING (rowid_)
"""

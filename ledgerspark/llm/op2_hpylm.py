"""Operator 2: language-model scores from a hierarchical Pitman-Yor model.

Words are dishes.  The root restaurant has the unigram distribution over a uniform base (every training word and one
place for unknown ones); its children are context restaurants, one for every word that stands before another, however
rare, and one for text starts: a token's context is the word before it in its text.  All children share the root as
parent, so a table opened in a child seats a customer in the root.

Seating is sampled by Gibbs sweeps: every sweep reseats all customers of all dishes, given the parent's probabilities
and the restaurants' table totals of the sweep before.  The customers of a dish are seated as a block: their number of
tables is drawn from what all seatings of them weigh together, which is where reseating them one by one would end.  After
``BURN`` sweeps the predictive probabilities of ``KEPT`` sweeps are averaged.

Layout: a chunk (a run of texts of one task) deals its distinct (word, context) keys and its tokens by word hash to
shards, which count them, hold all contexts of a word and so know its root customers; the keys of the ``HOT`` most frequent words
are dealt by context too, and the root customers of these words are summed up like the other sums.  Totals of a context are summed up
by the context's owner, a shard as well, which has been told once who holds the context; a sweep sends tables to owners
and totals back, in the order of the names, without names.  Only a handful of sums comes to the driver.  At last shards
send every chunk the sums of its texts.  Counts cover all training rows; nothing is pruned.  Words are told apart by 58
bits of a hash.

Cases: null text is the empty text, which is one end token; null ids are in the fold of the empty string; without
training tokens the base is uniform and every word is unknown; repeated rows are learned from and scored row by row;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Tokenizer, blocks
from .common import SLICE, crc_bucket, release, saved, text_bytes

#: Frequent words whose contexts are dealt as numbers of two bytes; all other contexts are dealt as hashes.
CONTEXTS = 65_534
#: Most frequent words whose keys no single shard holds.
HOT = 1_024
BURN, KEPT = 2, 2
STRENGTH, ROOT_STRENGTH = 10.0, 10.0
#: Customers of a dish up to which the weights of all numbers of tables are summed up, and walks that are tried beyond.
EXACT, WALKS = 1024, 4
#: Bytes of text in a chunk, and frequent words that one task reports.
CHUNK, REPORTED = 8 << 20, 8_192
#: Shards for each task of the scan (rounded up to a power of two).
SHARDS_PER_TASK = 2

LOW, LOW_BITS, MIX = np.uint64(63), np.uint64(6), np.uint64(0x9E3779B97F4A7C15)
END = np.uint64(0x9D39247E33776D41)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts (the low six bits clear), an end token after each; tokens per text."""
    joined = b"\n".join(texts).lower() + b"\n"
    buf = np.frombuffer(joined + bytes(16), np.uint8)
    space = _SPACE[buf[: len(joined)]]
    first = np.flatnonzero(~space & np.append(True, space[:-1]))
    last = np.flatnonzero(space & np.append(False, ~space[:-1]))
    h = Tokenizer.hashes(buf, first, last - first) if len(first) else np.empty(0, np.uint64)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    words = np.diff(np.searchsorted(first, np.append(0, ends)))
    h = np.insert(h, np.cumsum(words), END)
    return h & ~LOW, words + 1


def contexts(h: np.ndarray, counts: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Context number of every token: the latest of the words ``frequent`` before it in its text, 0 if there is none; given
    all words, the word before it.  :func:`score` takes that by itself."""
    number = np.zeros(len(h), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        number = np.where(frequent[at] == h, at + 1, 0)
    place = np.where(number > 0, np.arange(len(h)), -1)
    latest = np.append(-1, np.maximum.accumulate(place)[:-1]) if len(h) else place
    start = np.repeat(np.cumsum(counts) - counts, counts)
    return np.where(latest >= start, number[np.maximum(latest, 0)], 0)


def log_stirling(most: int, discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) of a discount, for up to ``most`` customers and tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    for c in range(most):
        stay = np.log(np.maximum(c - discount * np.arange(most + 1), 0), out=np.full(most + 1, -np.inf), where=c - discount * np.arange(most + 1) > 0)
        out[c + 1] = np.logaddexp(np.append(-np.inf, out[c, :-1]), out[c] + stay)
    return out


@functools.lru_cache(maxsize=4)
def _stirling(discount: float) -> np.ndarray:
    return log_stirling(EXACT, discount)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers (Stirling's series from eight on)."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift -= np.log(x + i)
    y = x + 8
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)


def _walked(c: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator, average: bool = False) -> np.ndarray:
    """Tables after seating ``c`` customers, descending, in a restaurant of their own, one by one and then in groups of a
    sixteenth of those seated, each with one binomial draw at the odds of the group's middle customer; with ``average``
    the odds are those of the average walk, whatever this one does."""
    t, n, k = np.ones(len(c), np.int64), 1, strength
    while (live := int(np.searchsorted(-c, -n, "left"))):
        group = np.minimum(c[:live] - n, max(1, n // 16))
        half = (group - 1) / 2
        if average:
            weight = (k[:live] + discount) * ((n + half + k[:live]) / (1 + k[:live])) ** discount
        else:
            opens = (k[:live] + discount * t[:live]) / (k[:live] + n)
            weight = k[:live] + discount * (t[:live] + half * opens)
        t[:live] += rng.binomial(group, np.clip(weight / (k[:live] + n + half), 0, 1))
        n += max(1, n // 16)
    return t


def _seat_many(c: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of many customers, by rejection.

    A restaurant of its own with strength k has t tables with probability S(c, t) * k+d * k+2d * ..., so a walk through it
    is kept with a probability in proportion to a**t over that product, which is greatest where k + d * t is a.  The
    strength is the one at which walks end there on average.  Where ``WALKS`` walks are not kept (the walks spread much
    wider than what is asked for), customers open tables by themselves at the odds of the average walk.
    """
    low, high = np.full(len(c), -discount * (1 - 1e-9)), np.maximum(a, 1.0)
    for _ in range(60):
        k = (low + high) / 2
        ends = np.log(k + discount) + discount * (np.log(c + k) - np.log1p(k))
        low, high = np.where(ends < np.log(a), k, low), np.where(ends < np.log(a), high, k)
    k = (low + high) / 2

    def weight(t: np.ndarray, at: np.ndarray) -> np.ndarray:
        first = k[at] / discount + 1
        return (t - 1) * np.log(a[at] / discount) - _log_gamma(first + t - 1) + _log_gamma(first)

    peak = np.clip(np.floor((a - k) / discount), 1, c - 1)
    best = np.maximum(weight(peak, np.arange(len(c))), weight(peak + 1, np.arange(len(c))))
    out, todo = np.empty(len(c), np.int64), np.arange(len(c))
    for _ in range(WALKS):
        t = _walked(c[todo], k[todo], discount, rng)
        kept = np.log(rng.random(len(todo))) < weight(t.astype(float), todo) - best[todo]
        out[todo[kept]] = t[kept]
        todo = todo[~kept]
    out[todo] = _walked(c[todo], k[todo], discount, rng, average=True)
    return out


def seat(customers: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of every dish, drawn given all else: t tables of c customers have the weight S(c, t) * opening**t.

    Up to ``EXACT`` customers the weights are summed up; beyond, see :func:`_seat_many` (means within 1 % of the sums).
    """
    out = np.minimum(customers, 1).astype(np.int64)
    table = _stirling(discount)
    order = np.argsort(customers, kind="stable")
    sizes, starts = np.unique(customers[order], return_index=True)
    for c, rows in zip(sizes.tolist(), np.split(order, starts[1:]), strict=True):
        if c < 2 or c > EXACT:
            continue
        for part in np.array_split(rows, -(-len(rows) * c // 1_000_000)):
            w = table[c, 1 : c + 1] + np.arange(1, c + 1) * np.log(opening[part])[:, None]
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            out[part] = 1 + (w < rng.random(len(part))[:, None] * w[:, -1:]).sum(axis=1)
    many = order[int(np.searchsorted(customers[order], EXACT, "right")) :][::-1]
    if len(many):
        out[many] = _seat_many(customers[many], opening[many], discount, rng)
    return out


@dataclass
class Totals:
    """What restaurants know of each other; one more entry of the lists for every sweep done.

    A shard has those contexts in ``customers`` and ``tables`` that it holds; ``seated``, the root's customers, is the sum of
    ``tables`` where it is absent.
    """

    words: int
    tokens: int
    customers: np.ndarray
    discount: float
    root_discount: float
    tables: list[np.ndarray] = field(default_factory=list)  # of each context restaurant
    opened: list[int] = field(default_factory=list)  # in the root
    seated: list[int] = field(default_factory=list)
    #: Hot words, ascending, their customers, and their (customers, tables) in the root.
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    hot_counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    of_hot: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def root_customers(self, i: int) -> int:
        return self.seated[i] if self.seated else int(self.tables[i].sum())


def seatings(shard: int, context: np.ndarray, word: np.ndarray, counts: np.ndarray, alone: np.ndarray, totals: Totals, hot: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The states of :func:`sweeps` for the keys of two customers or more; ``alone``: keys of one customer for each word,
    which have one table always."""
    hot = np.full(len(alone), -1) if hot is None else hot
    at, of = np.flatnonzero(hot >= 0), hot[hot >= 0]
    tables = np.ones(len(word), np.int64)
    for i in range(len(totals.tables) + 1):
        if i:
            rng, of_context, of_root = np.random.Generator(np.random.PCG64([shard, i - 1])), totals.tables[i - 1], totals.opened[i - 1]
            if len(word):
                opening = (STRENGTH + totals.discount * of_context[context]) * root_probability(served, opened, totals.root_customers(i - 1), of_root, totals)[word]  # noqa: F821
                tables = seat(counts, opening, totals.discount, rng)
        served = alone + np.bincount(word, tables, len(alone)).astype(np.int64)
        if not i:
            opened = (served > 0).astype(np.int64)
        elif len(alone):
            opened = seat(served, np.full(len(alone), (ROOT_STRENGTH + totals.root_discount * of_root) / (totals.words + 1)), totals.root_discount, rng)
        if i < len(totals.of_hot):
            served[at], opened[at] = (x[of] for x in totals.of_hot[i])
        yield tables, served, opened


def sweeps(shard: int, context: np.ndarray, word: np.ndarray, counts: np.ndarray, totals: Totals, hot: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """States of a shard, one for each entry of the totals and one more: (tables of keys, root customers, root tables).

    ``hot``: each word's place among the hot words, or -1; what these have in the root is the shard's own part only in the
    last state, which the totals don't know yet.
    """
    size = int(word[-1]) + 1 if len(word) else 0
    several = np.flatnonzero(counts > 1)
    alone = np.bincount(word[counts == 1], minlength=size).astype(np.int64)
    for of_several, served, opened in seatings(shard, context[several], word[several], counts[several], alone, totals, hot):
        tables = (counts > 0).astype(np.int64)
        tables[several] = of_several
        yield tables, served, opened


def root_probability(served: np.ndarray, opened: np.ndarray, customers: int, tables: int, totals: Totals) -> np.ndarray:
    whole = ROOT_STRENGTH + customers
    return (served - totals.root_discount * opened) / whole + (ROOT_STRENGTH + totals.root_discount * tables) / whole / (totals.words + 1)


def predict(shard: int, context: np.ndarray, word: np.ndarray, counts: np.ndarray, totals: Totals, burn: int, hot: np.ndarray | None = None) -> np.ndarray:
    """Averaged predictive probability of every key of a shard."""
    total, kept = np.zeros(len(word)), 0
    for i, (tables, served, opened) in enumerate(sweeps(shard, context, word, counts, totals, hot)):
        if i <= burn or i >= len(totals.tables):
            continue
        of_context, of_root = totals.tables[i], totals.opened[i]
        root = root_probability(served, opened, totals.root_customers(i), of_root, totals)[word]
        whole = STRENGTH + totals.customers[context]
        total += (counts - totals.discount * tables) / whole + (STRENGTH + totals.discount * of_context[context]) / whole * root
        kept += 1
    return total / max(1, kept)


# -- chunks --------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Numbers of no sign in as few bytes each as the greatest takes, which the first byte tells; first bytes of all come
    first, then second ones, which are mostly 0 and compress well."""
    most = int(values.max()) if len(values) else 0
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([size]) + np.ascontiguousarray(values, f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel().astype(np.int64)


def _names(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(chunk number, ids, held out, tokens per text, word of every token) of runs of texts."""
    number = TaskContext.get().partitionId() << 20
    held: list[tuple] = []
    size = 0
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        texts = batch.column(2).to_pylist()
        for a, b in blocks(texts):
            h, counts = tokens(texts[a:b])
            held.append((batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False), counts, h))
            size += sum(map(len, texts[a:b]))
            if size >= CHUNK:
                yield number, pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
                held, size, number = [], 0, number + 1
    if held:
        yield number, pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[i] for x in held]) for i in (1, 2, 3))


def _ranges(names: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Where the names of each of ``1 << bits`` shards are among ascending ones."""
    if not bits:
        return [(0, len(names))]
    edges = np.append(np.searchsorted(names, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(names)).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def frequent_words(rows: DataFrame, count: int = CONTEXTS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent training words, ascending, and of those that are hot, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            texts = batch.column(0).to_pylist()
            for a, b in blocks(texts):
                h, n = np.unique(tokens(texts[a:b])[0], return_counts=True)
                top = np.argsort(-n, kind="stable")[: 2 * REPORTED]
                known, where = np.unique(np.concatenate([known, h[top]]), return_inverse=True)
                seen = np.bincount(where, np.concatenate([seen, n[top]])).astype(np.int64)
        top = np.argsort(-seen, kind="stable")[:REPORTED]
        yield pa.RecordBatch.from_arrays([pa.array(known[top].view(np.int64)), pa.array(seen[top])], names=["h", "n"])
        release()

    found = rows.where(~F.col("held_out")).select("text").mapInArrow(run, "h long, n long").where(F.col("h") != int((END & ~LOW).view(np.int64)))
    top = found.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(count).collect()
    found = np.array([r.h for r in top], np.int64).view(np.uint64)
    return np.sort(found), np.sort(np.append(END & ~LOW, found[: HOT - 1])) if HOT else found[:0]


def _places(names: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Places of names among ascending ones, or -1."""
    at = np.searchsorted(among, names)
    known = at < len(among)
    known[known] = among[at[known]] == names[known]
    return np.where(known, at, -1)


DEALT = "shard int, chunk long, held binary, names binary, sizes binary, codes binary, far binary, docs binary, lengths binary, stream binary, ids binary"


def _deal(rows: DataFrame, frequent: np.ndarray, hot: np.ndarray, bits: int) -> DataFrame:
    """Every chunk's part for each shard: its words, their contexts, and its tokens, text by text, as numbers of these keys.

    A context is 0 for a text start, 1 + its place in ``frequent``, or the greatest code, for which a hash stands in ``far``.
    The ids of a chunk's texts go with one of its parts.  Keys are dealt by word; those of a hot word by their context, and by
    both where that is hot as well.
    """
    shared = rows.sparkSession.sparkContext.broadcast((frequent, hot))
    names = [x.split()[0] for x in DEALT.split(", ")]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * (len(names) - 2)]

    def parts(number: int, ids: pa.Array, held: np.ndarray, counts: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        book, hot = shared.value
        words, word = np.unique(h, return_inverse=True)
        del h
        before = np.append(0, word[:-1] + 1)
        before[np.cumsum(counts) - counts] = 0
        word *= len(words) + 1
        word += before
        keys, where = np.unique(word, return_inverse=True)
        where = where.astype(np.int32)
        del word
        of_key, before = np.divmod(keys, len(words) + 1)
        del keys
        code = _places(words, book) + 1
        code[code == 0] = CONTEXTS + 1
        codes = np.where(before > 0, code[before - 1], 0)
        is_hot = _places(words, hot) >= 0
        by = words[of_key]
        context = np.where(before > 0, words[before - 1], np.uint64(0))
        both = is_hot[of_key] & ((before == 0) | is_hot[before - 1])
        by = np.where(is_hot[of_key], np.where(both, ((by >> LOW_BITS) ^ context) * MIX, context), by)
        of_shard = (by >> np.uint64(64 - bits) if bits else np.zeros(len(by))).astype(np.uint16 if bits <= 16 else np.int64)
        order = np.argsort(of_shard, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        where, of_key, before, codes = place[where], of_key[order], before[order], codes[order]
        cuts = np.append(0, np.cumsum(np.bincount(of_shard, minlength=1 << bits))).tolist()
        text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        of_token = of_shard[order][where]
        del by, context, both, place
        order = np.argsort(of_token, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(of_token, minlength=1 << bits))).tolist()
        listed = pa.BufferOutputStream()
        with pa.ipc.new_stream(listed, pa.schema([("ids", ids.type)])) as out:
            out.write_batch(pa.RecordBatch.from_arrays([ids], names=["ids"]))
        ids_at = int(of_token[0])  # texts have a token at least
        for s, (first, last) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if first == last:
                continue
            mine = order[ends[s] : ends[s + 1]]
            docs, lengths = np.unique(text[mine], return_counts=True)
            own, sizes = np.unique(of_key[first:last], return_counts=True)
            far = words[before[first:last][codes[first:last] == CONTEXTS + 1] - 1]
            values = [np.packbits(held).tobytes(), words[own].tobytes(), _pack(sizes), _pack(codes[first:last]), far.tobytes(), _pack(np.diff(docs, prepend=0)), _pack(lengths), _pack(where[mine] - first)]
            row = [s, number, *values, listed.getvalue().to_pybytes() if s == ids_at else None]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            yield from parts(*chunk)
            del chunk
            release()

    return rows.mapInArrow(run, DEALT)


# -- shards --------------------------------------------------------------------


def _same(shard: int) -> int:
    return shard


def _by_shard(records: RDD, bits: int) -> RDD:
    """Records (shard, value) with one partition for each shard, alike for all that are to meet."""
    return records.partitionBy(1 << bits, _same)


def _meet(*of_shards: RDD) -> RDD:
    """Records of several of these at their shard, none moved."""
    whole = of_shards[0]
    for more in of_shards[1:]:
        whole = whole.union(more)
    return whole


def _each(records: RDD, run: Callable[[Iterator], Iterator], stay: bool = False) -> RDD:
    """Apply a function of partitions, and give back what it took."""

    def whole(found: Iterator) -> Iterator:
        yield from run(found)
        release()

    return records.mapPartitions(whole, preservesPartitioning=stay)


def _by_key(records: Iterator[tuple[int, tuple]]) -> dict[int, dict[str, list]]:
    """Records (shard, (kind, ...)) of a partition by shard and kind, in order of what comes after the kind."""
    found: dict[int, dict[str, list]] = {}
    for shard, (kind, *rest) in records:
        found.setdefault(shard, {}).setdefault(kind, []).append(rest)
    for kinds in found.values():
        for rest in kinds.values():
            rest.sort(key=lambda x: x[0])
    return found


@dataclass
class Shard:
    """The keys of a shard, ascending by word and context, and the parts that they come from."""

    names: np.ndarray  # of contexts, ascending; 0 is the text start
    words: np.ndarray
    context: np.ndarray
    word: np.ndarray
    counts: np.ndarray
    parts: list[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # (part, places of its keys, docs, lengths, stream)


def _shard(dealt: list[list], frequent: np.ndarray) -> Shard:
    """Count the keys of one shard over all chunks."""
    book = np.concatenate([np.zeros(1, np.uint64), frequent, np.zeros(1, np.uint64)])
    words = np.unique(np.concatenate([_names(p[2]) for p in dealt]))
    places, befores = [], []
    for part in dealt:
        codes = _unpack(part[4])
        near = codes <= CONTEXTS
        before = book[np.where(near, codes, 0)]
        before[~near] = _names(part[5])
        befores.append(before)
        places.append(np.repeat(np.searchsorted(words, _names(part[2])), _unpack(part[3])))
    names, where = np.unique(np.concatenate(befores), return_inverse=True)
    whole, where = np.unique(np.concatenate(places) * len(names) + where, return_inverse=True)
    counts, parts, at = np.zeros(len(whole), np.int64), [], 0
    for part, n in zip(dealt, map(len, places), strict=True):
        mine, docs, lengths, stream = where[at : at + n], np.cumsum(_unpack(part[6])), _unpack(part[7]), _unpack(part[8])
        at += n
        held = np.unpackbits(np.frombuffer(part[1], np.uint8))[docs] > 0
        counts[mine] += np.bincount(stream[np.repeat(~held, lengths)], minlength=n)
        parts.append((part, mine, docs, lengths, stream))
    return Shard(names, words, whole % len(names), whole // len(names), counts, parts)


def _of_hot(hot: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of a shard's words for all hot words, 0 for those that it doesn't hold."""
    out = np.zeros(len(hot), np.int64)
    out[places[places >= 0]] = values[places >= 0]
    return out


def _first(records: Iterator[tuple[int, tuple]], frequent: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """What sweeps need of a shard: its contexts with their customers and keys of one customer, its words with theirs and
    their places among the hot ones, and the keys of two or more."""
    for shard, kinds in _by_key(records).items():
        s = _shard(kinds["dealt"], frequent)
        several, one = s.counts > 1, s.counts == 1
        places = _places(s.words, hot)
        of_word = np.bincount(s.word, s.counts > 0, len(s.words))[places < 0]
        sums = Counter(words=int((of_word > 0).sum()), tokens=int(s.counts.sum()), one=int(one.sum()), two=int((s.counts == 2).sum()), root_one=int((of_word == 1).sum()), root_two=int((of_word == 2).sum()))
        counts = _of_hot(hot, places, np.bincount(s.word, s.counts, len(s.words)))
        of_context = [np.bincount(s.context, s.counts, len(s.names)), np.bincount(s.context, one, len(s.names))]
        of_keys = [s.context[several], s.word[several], s.counts[several]]
        packed = [zlib.compress(_pack(x), 1) for x in (*of_context, np.bincount(s.word, one, len(s.words)), places + 1, *of_keys)]
        yield shard, ("first", s.names.tobytes(), packed, sums, counts)


def _read(first: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Names of contexts, and (their customers and keys of one customer, words' keys of one customer and places among the hot
    ones, contexts, words and counts of the other keys)."""
    customers, lone, of_words, places, *of_keys = (_unpack(zlib.decompress(x)) for x in first[1])
    return _names(first[0]), [customers, lone, of_words, places - 1, *of_keys]


def _own_totals(kinds: dict[str, list], totals: Totals) -> Totals:
    """The totals for the contexts of a shard, as their owners gave them."""
    get = lambda kind: np.concatenate([_unpack(x[1]) for x in kinds[kind]])
    least = get("tables 0")
    return replace(totals, customers=get("customers"), tables=[least, *(least + get(f"tables {i}") for i in range(1, len(totals.opened)))])


def _ask(records: Iterator[tuple[int, tuple]], hot: np.ndarray, bits: int) -> Iterator[tuple[int, tuple]]:
    """Tell owners the contexts of a shard, with their customers and first tables; owners have ranges of names."""
    for shard, kinds in _by_key(records).items():
        names, (customers, lone, of_words, places, context, word, _) = _read(kinds["first"][0])
        tables = lone + np.bincount(context, minlength=len(names))
        served = of_words + np.bincount(word, minlength=len(of_words))
        *_, sums, counts = kinds["first"][0]
        yield shard, ("sums", shard, sums + Counter(seated=int(served.sum()), opened=int((served[places < 0] > 0).sum())), np.stack([_of_hot(hot, places, served), counts]))
        for owner, (a, b) in enumerate(_ranges(names, bits)):
            if a < b:
                yield owner, ("names", shard, names[a:b].tobytes(), _pack(customers[a:b]), _pack(tables[a:b]))


def _sweep(records: Iterator[tuple[int, tuple]], totals: Totals, bits: int) -> Iterator[tuple[int, tuple]]:
    """Tell owners the tables after one more sweep that are beyond one for each key, in the order of the names."""
    for shard, kinds in _by_key(records).items():
        names, (_, _, of_words, places, context, word, counts) = _read(kinds["first"][0])
        *_, (tables, served, opened) = seatings(shard, context, word, counts, of_words, _own_totals(kinds, totals), places)
        yield shard, ("sums", shard, Counter(seated=int(served.sum()), opened=int(opened[places < 0].sum())), _of_hot(totals.hot, places, served)[None])
        of_context = np.bincount(context, tables - 1, len(names)).astype(np.int64)
        for owner, (a, b) in enumerate(_ranges(names, bits)):
            if a < b:
                yield owner, ("tables", shard, _pack(of_context[a:b]))


def _give(records: Iterator[tuple[int, tuple]], sweep: int) -> Iterator[tuple[int, tuple]]:
    """Sum up the tables of an owner's contexts, at first the customers too, and tell each shard those that it holds."""
    for owner, kinds in _by_key(records).items():
        if "names" not in kinds:
            continue
        held = [_names(x[1]) for x in kinds["names"]]
        names, where = np.unique(np.concatenate(held), return_inverse=True)
        ends = np.cumsum([len(x) for x in held])
        customers, tables = ([x[i] for x in kinds["names"]] for i in (2, 3))
        told = [("customers", customers), ("tables 0", tables)] if not sweep else [(f"tables {sweep}", [x[1] for x in kinds["tables"]])]
        for kind, values in told:
            sums = np.bincount(where, np.concatenate([_unpack(x) for x in values]), len(names)).astype(np.int64)[where]
            for (shard, *_), first, last in zip(kinds["names"], [0, *ends[:-1]], ends, strict=True):
                yield shard, (kind, owner, _pack(sums[first:last]))


def _sums(sent: RDD) -> tuple[Counter, np.ndarray]:
    """A fixed handful of sums over all shards, and those of hot words."""

    def run(records: Iterator[tuple[int, tuple]]) -> Iterator[tuple[Counter, np.ndarray | int]]:
        found = [value for _, value in records if value[0] == "sums"]
        yield sum((x[2] for x in found), Counter()), sum(x[3] for x in found)

    return sent.mapPartitions(run).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))


def fit(first: RDD, hot: np.ndarray, bits: int, burn: int = BURN, kept: int = KEPT) -> tuple[Totals, list[RDD]]:
    """Run the Gibbs sweeps: sums over all contexts, and the totals of each shard's contexts after every sweep."""
    rate = lambda one, two: min(0.95, max(0.05, one / max(1, one + 2 * two)))
    owners = _by_shard(_each(first, lambda r: _ask(r, hot, bits)), bits)
    s, of_hot = _sums(owners)
    served, counts = of_hot if np.ndim(of_hot) else np.zeros((2, len(hot)), np.int64)
    n = {f"root_{name}": s[f"root_{name}"] + int((served == k).sum()) for name, k in (("one", 1), ("two", 2))}
    opened = (served > 0).astype(np.int64)
    # at first every key has one table, so a hot word with customers in the root is a training word
    totals = Totals(s["words"] + int(opened.sum()), s["tokens"], np.empty(0, np.int64), rate(s["one"], s["two"]), rate(n["root_one"], n["root_two"]), opened=[s["opened"] + int(opened.sum())], seated=[s["seated"]], hot=hot, hot_counts=counts, of_hot=[(served, opened)])
    backs = [_by_shard(_each(owners, lambda r: _give(r, 0)), bits)]
    for i in range(1, burn + kept + 1):
        known = replace(totals, opened=[*totals.opened], seated=[*totals.seated], of_hot=[*totals.of_hot])
        sent = _by_shard(_each(_meet(first, *backs), lambda r, known=known: _sweep(r, known, bits)), bits)
        s, of_hot = _sums(sent)
        served = of_hot[0] if np.ndim(of_hot) else served
        if len(hot):
            opened = seat(served, np.full(len(hot), (ROOT_STRENGTH + totals.root_discount * totals.opened[-1]) / (totals.words + 1)), totals.root_discount, np.random.Generator(np.random.PCG64([1 << bits, i])))
        totals.of_hot.append((served, opened))
        totals.opened.append(s["opened"] + int(opened.sum()))
        totals.seated.append(s["seated"])
        backs.append(_by_shard(_each(_meet(owners, sent), lambda r, i=i: _give(r, i)), bits))
    return totals, backs


ANSWER = "chunk long, shard int, held binary, docs binary, lengths binary, known binary, base binary, score binary, ids binary"


def _answer(records: Iterator[tuple[int, tuple]], frequent: np.ndarray, totals: Totals, burn: int) -> Iterator[tuple]:
    """Sums of a shard's tokens for each text of each chunk."""
    for shard, kinds in _by_key(records).items():
        s = _shard(kinds["dealt"], frequent)
        places = _places(s.words, totals.hot)
        logs = np.log10(predict(shard, s.context, s.word, s.counts, _own_totals(kinds, totals), burn, places))
        of_word = np.bincount(s.word, s.counts, len(s.words))
        of_word[places >= 0] = totals.hot_counts[places[places >= 0]]
        base = np.log10((of_word + 0.5) / (totals.tokens + 0.5 * (totals.words + 1)))
        for part, mine, _, lengths, stream in s.parts:
            key = mine[stream]
            word, starts = s.word[key], np.cumsum(lengths) - lengths
            per_text = lambda values: np.add.reduceat(values, starts)  # noqa: B023, E731
            yield part[0], shard, bytes(part[1]), bytes(part[6]), bytes(part[7]), _pack(per_text((of_word[word] > 0).astype(np.int64))), per_text(base[word]).tobytes(), per_text(logs[key]).tobytes(), None if part[9] is None else bytes(part[9])


def score(docs: DataFrame, folds: int = 5, held: int = 1, burn: int = BURN, kept: int = KEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all texts: (id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    rows = docs.select(id_col, (crc_bucket(id_col, folds) == held).alias("held_out"), text_bytes(text_col).alias("text"))
    bits = max(0, (rows.rdd.getNumPartitions() * SHARDS_PER_TASK - 1).bit_length())
    frequent, hot = frequent_words(rows)
    book = spark.sparkContext.broadcast(frequent)
    dealt = _by_shard(_deal(rows, frequent, hot, bits).rdd.map(lambda r: (r[0], ("dealt", *r[1:]))), bits)
    first = _each(dealt, lambda r: _first(r, book.value, hot), stay=True).persist(StorageLevel.DISK_ONLY)
    totals, backs = fit(first, hot, bits, burn, kept)
    answers = spark.createDataFrame(_each(_meet(dealt, *backs), lambda r: _answer(r, book.value, totals, burn)), ANSWER, verifySchema=False)
    id_kind = rows.schema[id_col].dataType.simpleString()

    def meet(answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("shard")
        found = answers.column("ids").drop_null()
        ids = pa.ipc.open_stream(found[0].as_buffer()).read_all().column("ids").combine_chunks()
        n_tokens, n_known = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        base, whole = np.zeros(len(ids)), np.zeros(len(ids))
        for part in answers.select(["docs", "lengths", "known", "base", "score"]).to_pylist():
            mine = np.cumsum(_unpack(part["docs"]))
            n_tokens[mine] += _unpack(part["lengths"])
            n_known[mine] += _unpack(part["known"])
            base[mine] += np.frombuffer(part["base"], "<f8")
            whole[mine] += np.frombuffer(part["score"], "<f8")
        held = np.unpackbits(np.frombuffer(answers.column("held")[0].as_buffer(), np.uint8), count=len(ids)).astype(bool)
        return pa.table([ids, pa.array(held), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(ids), totals.tokens)), pa.array(base), pa.array(whole)], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    met = answers.groupBy("chunk").applyInArrow(meet, f"`{id_col}` {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = saved(met, "lm-scores")
    first.unpersist()
    return out

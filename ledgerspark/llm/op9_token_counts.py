"""Operator 9: token counts by a map-side two-tier lookup.

First pass, over all texts: every task keeps one bounded list of its heaviest pieces, a single row; the rows are merged
as a tree, ``FAN`` lists at a time, each merge as bounded as a list.  The heaviest pieces of the corpus become a compact
table (hash, length) of at most ``TABLE`` entries, which is broadcast.  Second pass: pieces found in the table get their
length from it, the others are encoded through the worker's cache.  No piece is a key of a shuffle.  What the table holds
changes speed, never a count.

Cases: null text is the empty text (0 bytes, 0 tokens); an empty table gives an empty result; repeated rows and null
ids are kept row by row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import map_batches, text_bytes

#: Entries of the broadcast table: ten bytes each, so 320 KB at most.
TABLE = 32_768
#: Pieces that one task reports, and their greatest length.
REPORTED, LONGEST = 4_096, 64
#: Lists that one task merges.
FAN = 64


class Heavy:
    """Counts of the heaviest pieces of a stream, in bounded space (the lightest are forgotten in between)."""

    def __init__(self, keep: int):
        self.keep = keep
        self.hash, self.count, self.piece = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, object)

    def add(self, hashes: np.ndarray, counts: np.ndarray, pieces: np.ndarray) -> None:
        both, where = np.unique(np.concatenate([self.hash, hashes]), return_inverse=True)
        total = np.bincount(where, np.concatenate([self.count, counts])).astype(np.int64)
        named = np.empty(len(both), object)
        named[where] = np.concatenate([self.piece, pieces])
        if len(both) > 4 * self.keep:
            top = np.sort(np.argpartition(-total, 2 * self.keep)[: 2 * self.keep])
            both, total, named = both[top], total[top], named[top]
        self.hash, self.count, self.piece = both, total, named

    def top(self) -> tuple[list[bytes], list[int]]:
        order = np.argsort(-self.count, kind="stable")[: self.keep]
        return self.piece[order].tolist(), self.count[order].tolist()


def frequent_pieces(docs: DataFrame, path: str, text_col: str = "text", table: int = TABLE, reported: int = REPORTED) -> list[bytes]:
    """The heaviest pieces of all texts, at most ``table`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, heavy = bpe.tokenizer(path), Heavy(reported)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in bpe.blocks(texts):
                parts, _, _ = t._segments(texts[a:b])
                buf, first, size, _ = t.pieces(parts)
                if not len(first):
                    continue
                uniq, where, inverse = t.distinct(buf, first, size)
                counts = np.bincount(inverse, minlength=len(uniq))
                short = np.flatnonzero((counts > 1) & (size[where] <= LONGEST))
                short = short[np.argsort(-counts[short], kind="stable")[: 2 * reported]]
                raw, f, s = buf.tobytes(), first[where[short]].tolist(), size[where[short]].tolist()
                pieces = np.empty(len(short), object)
                pieces[:] = [raw[i : i + n] for i, n in zip(f, s, strict=True)]
                heavy.add(uniq[short], counts[short], pieces)
        yield _one_row(*heavy.top())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for pieces, counts in zip(batch.column(0), batch.column(1), strict=True):
                for piece, n in zip(pieces.as_py(), counts.as_py(), strict=True):
                    total[piece] += n
            if len(total) > 4 * table:
                total = Counter(dict(_heaviest(total, 2 * table)))
        top = _heaviest(total, table)
        yield _one_row([p for p, _ in top], [n for _, n in top])

    schema = "pieces array<binary>, counts array<long>"
    lists = docs.select(text_bytes(text_col)).mapInArrow(run, schema)
    parts = lists.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN)
        # lists are dealt in turn, whole
        lists = lists.repartition(parts).mapInArrow(merge, schema)
    total: Counter[bytes] = Counter()
    for r in lists.collect():  # one row, as there is one task left
        total.update(dict(zip(map(bytes, r.pieces), r.counts, strict=True)))
    return [p for p, _ in _heaviest(total, table)]


def _heaviest(total: Counter[bytes], count: int) -> list[tuple[bytes, int]]:
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))[:count]


def _one_row(pieces: list[bytes], counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pieces], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))], names=["pieces", "counts"])


def length_table(pieces: list[bytes], path: str) -> tuple[np.ndarray, ...]:
    """Compact table of pieces: ascending keys, numbers of ids, sizes, and where in the last array their bytes are."""
    t = bpe.tokenizer(path)
    size = np.array([len(p) for p in pieces], np.int64)
    if not len(size):
        return np.empty(0, np.uint64), np.empty(0, np.uint16), size, size, np.zeros(16, np.uint8)
    first = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(pieces) + bytes(16), np.uint8)
    keys = t.keys(buf, first, size)
    order = np.argsort(keys)
    return keys[order], t.encode_pieces(buf, first, size)[1][order].astype(np.uint16), size[order], first[order], buf


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text: (id, n_bytes, n_tokens, over_limit)."""
    table = docs.sparkSession.sparkContext.broadcast(length_table(frequent_pieces(docs, path, text_col), path))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t, (known, lengths, sizes, at, raw) = bpe.tokenizer(path), table.value
        texts = batch.column(1).to_pylist()
        for a, b in bpe.blocks(texts):
            parts, owner, special = t._segments(texts[a:b])
            buf, first, size, per_text = t.pieces(parts)
            counts = np.zeros(len(parts), np.int64)
            if len(first):
                uniq, where, inverse = t.distinct(buf, first, size)
                slot = np.searchsorted(known, uniq)
                hit = slot < len(known)
                hit[hit] = known[slot[hit]] == uniq[hit]
                long = np.flatnonzero(hit & (uniq >= bpe.LONG))
                equal = sizes[slot[long]] == size[where[long]]
                equal[equal] = t.same(buf, first[where[long[equal]]], raw, at[slot[long[equal]]], size[where[long[equal]]])
                hit[long[~equal]] = False
                lens = np.empty(len(uniq), np.int64)
                lens[hit] = lengths[slot[hit]]
                rest = np.flatnonzero(~hit)
                lens[rest] = t.cached(uniq[rest], buf, first[where[rest]], size[where[rest]])[1]
                total = np.concatenate([[0], np.cumsum(lens[inverse])])
                counts = np.diff(total[np.concatenate([[0], np.cumsum(per_text)])])
            if owner is not None:
                counts[special >= 0] = 1
                counts = np.bincount(owner, counts, b - a).astype(np.int64)
            n_bytes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_bytes), pa.array(counts), pa.array(counts > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select(id_col, text_bytes(text_col)), rows, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")

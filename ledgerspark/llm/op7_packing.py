"""Operator 7: best-fit packing of tokenised documents into sequences of bounded length.

Bounded-space online best-fit: pieces are placed in order of arrival, each in the open bin that it fills best.  Open bins
are kept in a bitset keyed by free space, so the tightest bin that still takes a piece is one bit scan away.  At most
``OPEN`` bins are open; when no bin fits and all are open, the fullest closes first.  Only
(id, piece, start, length, checksum) rows are dealt out, in groups of about ``GROUP`` documents by a hash, whose order is
also that of arrival (so a task that is run again packs alike); pieces of full length fill a sequence alone.  A task
holds one batch of rows and the open bins.

Cases: null text is the empty text, a document of just its end token; an empty table gives an empty result; repeated
rows and null ids are packed row by row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_batches, text_bytes

CAPACITY, OPEN, GROUP = 4096, 64, 16_384


class BestFit:
    """Bounded-space best-fit over bins of one capacity."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.open, self.made, self.closed = 0, 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return got

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of this length."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            got = self._take(free)
        else:
            if self.open >= self.limit and length < self.capacity:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            got, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(got)
            self.bits |= 1 << left
            self.open += 1
        return got, self.capacity - free


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY, open_bins: int = OPEN) -> list[tuple[int, int]]:
    """(bin, offset) of every length, in order."""
    packer = BestFit(capacity, open_bins)
    return [packer.place(n) for n in lengths]


def cut_documents(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, end and cut documents: (id, piece, start, length, ids_crc32[, ids])."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = bpe.tokenizer(path)
        texts = batch.column(1).to_pylist()
        for a, b in bpe.blocks(texts):
            got = t.encode(texts[a:b])
            ids = np.insert(got.ids.astype("<u4"), np.cumsum(got.counts), end_id)
            size = got.counts + 1
            pieces = -(-size // capacity)
            owner = np.repeat(np.arange(b - a), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(size[owner] - start, capacity)
            edge = np.concatenate([[0], np.cumsum(length)])
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            columns = [batch.column(0).slice(a, b - a).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(edge.astype(np.int32), ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return map_batches(docs.select(id_col, text_bytes(text_col)), rows, schema)


def pack(pieces: DataFrame, documents: int, capacity: int = CAPACITY, open_bins: int = OPEN, group: int = GROUP, length_col: str = "length") -> DataFrame:
    """Add (sequence_id, offset) to rows with a length of 1 to ``capacity``; ``documents``: about how many rows."""
    names = [f.name for f in pieces.schema.fields]
    at = names.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            put = np.array([packer.place(n) for n in batch.column(at).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first + put[:, 0]), pa.array(put[:, 1])], names=[*names, "sequence_id", "offset"])

    row = F.struct(*(F.col(f"`{n}`") for n in names))
    dealt = pieces.select(row.alias("row"), F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    dealt = dealt.repartition(max(1, -(-documents // group)), "deal").sortWithinPartitions("deal")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.select("row.*", "deal").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack documents: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    return pack(cut_documents(docs, path, end_id, capacity, with_ids, id_col, text_col), docs.count(), capacity)

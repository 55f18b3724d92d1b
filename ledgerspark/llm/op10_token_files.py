"""Operator 10: token-id files coded by a static range asymmetric numeral system (rANS).

File format: a table of frames in ascending document order.  A frame holds the ids of consecutive documents, cut into
independent blocks of ``BLOCK`` ids; a block is coded by ``LANES`` interleaved coders that share one frequency table
of the whole corpus (``2**PRECISION`` slots).  The frame's header lists a checkpoint for every block (where its words
begin, how many ids it holds, their CRC-32), so that any block can be decoded alone and all blocks of a frame are
decoded side by side.  Frames are rows of a table written by Spark to shared storage, with the frequency table beside.

Cases: null text is the empty text, which has just the end id; null document ids come first; equal ids stand in the
order of their texts; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import map_batches, scratch, text_bytes

LANES, BLOCK, FRAME, PRECISION = 256, 65_536, 1 << 20, 20
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sIQ")  # mark, blocks, words
MARK = b"rAN1"


def shared_frequencies(symbols: np.ndarray, counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Slots of every symbol (ascending), in proportion to its count, one at least, ``2**precision`` together."""
    if not len(symbols):
        return np.empty(0, np.int64)
    total = int(counts.sum())
    slots = np.maximum(1, (counts.astype(object) * (1 << precision) // max(1, total)).astype(np.int64))
    if len(slots) > 1 << precision:
        raise ValueError("more symbols than slots")
    while (excess := int(slots.sum()) - (1 << precision)) != 0:
        if excess < 0:
            slots[int(np.argmax(counts))] -= excess
        else:
            big = np.argsort(-slots, kind="stable")
            cut = np.minimum(slots[big] - 1, -(-slots[big] * excess // int(slots.sum())))
            cut = np.minimum(cut, np.maximum(0, excess - (np.cumsum(cut) - cut)))
            slots[big] -= cut
    return slots


class Coder:
    """Encoder and decoder with one frequency table."""

    def __init__(self, symbols: np.ndarray, slots: np.ndarray):
        self.symbols = symbols.astype(np.int64)
        size = int(self.symbols.max(initial=0)) + 1
        self.freq, self.first = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[self.symbols] = slots.astype(np.uint64)
        self.first[self.symbols] = (np.cumsum(slots) - slots).astype(np.uint64)
        self.of_slot = np.repeat(self.symbols, slots).astype(np.int32)
        self.filler = int(self.symbols[np.argmax(slots)]) if len(slots) else 0

    def encode(self, ids: np.ndarray) -> bytes:
        """One frame of ids."""
        count = -(-len(ids) // BLOCK)
        if not count:
            return HEAD.pack(MARK, 0, 0)
        size = -(-len(ids) // count)  # blocks of a frame are alike but for the last one
        steps = -(-size // LANES)
        room = np.full((count, steps * LANES), self.filler, np.int64)
        for b in range(count):
            part = ids[b * size : (b + 1) * size]
            room[b, : len(part)] = part
        room = room.reshape(count, steps, LANES)
        state = np.full((count, LANES), LOW, np.uint64)
        words = np.empty((steps, count, LANES), np.uint32)
        sent = np.empty((steps, count, LANES), bool)
        shift, low_bits = np.uint64(63 - PRECISION), np.uint64(32)
        for step in range(steps - 1, -1, -1):
            s = room[:, step]
            f = self.freq[s]
            out = state >= (f << shift)
            words[step] = state.astype(np.uint32)
            sent[step] = out
            state = np.where(out, state >> low_bits, state)
            q = state // f
            state = (q << np.uint64(PRECISION)) + (state - q * f) + self.first[s]
        parts = [words[:, b][sent[:, b]] for b in range(count)]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        sizes = np.diff(np.append(np.arange(count) * size, len(ids)))
        sums = [zlib.crc32(ids[b * size : b * size + n].astype("<u4")) for b, n in enumerate(sizes.tolist())]
        index = np.array([offsets[:-1], sizes, sums], "<u8").T
        return b"".join([HEAD.pack(MARK, count, int(offsets[-1])), index.tobytes(), state.astype("<u8").tobytes(), np.concatenate(parts).astype("<u4").tobytes()])

    def decode(self, frame: bytes) -> np.ndarray:
        """The ids of a frame; a wrong mark, length or checksum raises."""
        mark, count, total = HEAD.unpack_from(frame)
        if mark != MARK or len(frame) != HEAD.size + count * (24 + 8 * LANES) + 4 * total:
            raise ValueError("not a frame of token ids, or cut short")
        if not count:
            return np.empty(0, np.int64)
        index = np.frombuffer(frame, "<u8", 3 * count, HEAD.size).reshape(count, 3).astype(np.int64)
        at = HEAD.size + 24 * count
        state = np.frombuffer(frame, "<u8", count * LANES, at).reshape(count, LANES).astype(np.uint64)
        words = np.append(np.frombuffer(frame, "<u4", total, at + 8 * LANES * count), np.uint32(0)).astype(np.uint64)
        sizes, place = index[:, 1], index[:, :1].copy()
        steps = -(-int(sizes.max()) // LANES)
        out = np.empty((count, steps, LANES), np.int32)
        mask = np.uint64((1 << PRECISION) - 1)
        for step in range(steps):
            slot = state & mask
            s = self.of_slot[slot]
            out[:, step] = s
            state = self.freq[s] * (state >> np.uint64(PRECISION)) + slot - self.first[s]
            short = state < LOW
            near = np.cumsum(short, axis=1)
            word = words[np.minimum(place + near - 1, total)]
            state = np.where(short, (state << np.uint64(32)) | word, state)
            place += near[:, -1:]
        if (state != LOW).any() or (place[:, 0] != np.append(index[1:, 0], total)).any():
            raise ValueError("the coders do not end where they began")
        flat = out.reshape(count, -1)
        ids = np.concatenate([flat[b, :n] for b, n in enumerate(sizes.tolist())])
        for b, n in enumerate(sizes.tolist()):
            if zlib.crc32(flat[b, :n].astype("<u4")) != index[b, 2]:
                raise ValueError(f"checksum of block {b} does not hold")
        return ids


FRAME_SCHEMA = "part int, seq int, n_docs long, n_ids long, doc_ids binary, null_ids binary, counts binary"


def _token_frames(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Documents in ascending order, tokenised, as frames of about ``FRAME`` ids (16 bits each where they fit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, seq = bpe.tokenizer(path), TaskContext.get().partitionId(), 0
        kind = "<u2" if max(t.size, end_id + 1) <= 65536 else "<u4"
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def frame() -> pa.RecordBatch:
            ids, counts, names, nulls = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [part, seq, len(counts), len(ids), names.astype("<i8").tobytes(), np.packbits(nulls).tobytes(), counts.astype("<u4").tobytes(), ids.astype(kind).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f) for x, f in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4], strict=True)], names=["part", "seq", "n_docs", "n_ids", "doc_ids", "null_ids", "counts", "ids"])

        size = 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, nulls = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for a, b in bpe.blocks(texts, 1 << 20):
                got = t.encode(texts[a:b])
                held.append((np.insert(got.ids.astype(np.uint32), np.cumsum(got.counts), end_id), got.counts + 1, names[a:b], nulls[a:b]))
                size += len(held[-1][0])
                if size >= FRAME:
                    yield frame()
                    held.clear()
                    seq, size = seq + 1, 0
        if held:
            yield frame()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    return rows.mapInArrow(run, FRAME_SCHEMA + ", ids binary")


def write_token_files(docs: DataFrame, target: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents to ``target`` (two tables: frames and frequencies)."""
    spark = docs.sparkSession
    staged = scratch(spark, "token-frames")
    _token_frames(docs, path, end_id, id_col, text_col).write.option("compression", "zstd").parquet(staged)
    frames = spark.read.parquet(staged)
    wide = max(bpe.tokenizer(path).size, end_id + 1) > 65536
    kind = "<u4" if wide else "<u2"

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                seen = np.bincount(np.frombuffer(raw.as_buffer(), kind))
                if len(seen) > len(total):
                    total = np.append(total, np.zeros(len(seen) - len(total), np.int64))
                total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["symbol", "n"])

    # the vocabulary bounds these rows
    counted = frames.select("ids").mapInArrow(tally, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow().sort_by("symbol")
    symbols, slots = counted.column("symbol").to_numpy(), shared_frequencies(counted.column("symbol").to_numpy(), counted.column("n").to_numpy())
    spark.createDataFrame(list(zip(symbols.tolist(), slots.tolist(), strict=True)), "symbol int, slots int").coalesce(1).write.parquet(f"{target}/frequencies")
    shared = spark.sparkContext.broadcast((symbols, slots))

    # ids before each frame: totals of the parts first (a row for each task of the sort), then within a part
    size = frames.select("part", "seq", "n_ids")
    before = size.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    start = size.join(before, "part").select("part", "seq", (F.col("before") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("start"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for i in range(batch.num_rows):
                coder = coder or Coder(*shared.value)
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), kind).astype(np.int64)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(n) for n in ("part", "seq", "n_docs", "n_ids", "doc_ids", "null_ids", "counts")), pa.array([coder.encode(ids)], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "doc_ids", "null_ids", "counts", "frame"])

    coded = frames.mapInArrow(code, FRAME_SCHEMA + ", frame binary")
    coded.write.option("compression", "zstd").parquet(f"{target}/frames")
    start.write.parquet(f"{target}/starts")


def read_token_files(spark: SparkSession, target: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: (doc_id, start, n_tokens, ids_crc32[, ids])."""
    table = spark.read.parquet(f"{target}/frequencies").toArrow().sort_by("symbol")
    shared = spark.sparkContext.broadcast((table.column("symbol").to_numpy(), table.column("slots").to_numpy()))
    starts = spark.read.parquet(f"{target}/starts")
    frames = spark.read.parquet(f"{target}/frames")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for i in range(batch.num_rows):
                coder = coder or Coder(*shared.value)
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                counts = np.frombuffer(row["counts"].as_buffer(), "<u4").astype(np.int64)
                ids = coder.decode(row["frame"].as_py()).astype("<u4")
                edge = np.concatenate([[0], np.cumsum(counts)])
                if edge[-1] != len(ids):
                    raise ValueError("the frame's ids and its documents don't agree")
                names = pa.array(np.frombuffer(row["doc_ids"].as_buffer(), "<i8"), mask=np.unpackbits(np.frombuffer(row["null_ids"].as_buffer(), np.uint8), count=len(counts)).astype(bool))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                columns = [names, pa.array(edge[:-1]), pa.array(counts), pa.array(crc, pa.int64()), pa.array(np.full(len(counts), row["part"].as_py(), np.int32)), pa.array(np.full(len(counts), row["seq"].as_py(), np.int32))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(edge.astype(np.int32), ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "inside", "n_tokens", "ids_crc32", "part", "seq", *["ids"] * with_ids])

    found = frames.mapInArrow(rows, "doc_id long, inside long, n_tokens long, ids_crc32 long, part int, seq int" + ", ids array<int>" * with_ids)
    joined = found.join(starts, ["part", "seq"])
    return joined.select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)

"""Operator 1: BPE encoding and decoding of whole texts (see :mod:`.bpe` for the method).

Cases: null text is the empty text (no ids, digest of nothing); an empty table gives an empty result; repeated rows
and null ids are kept row by row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import map_batches, text_bytes


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: (id, ids array<int>)."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        for a, b in bpe.blocks(texts):
            got = bpe.tokenizer(path).encode(texts[a:b])
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(got.counts)]).astype(np.int32), got.ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[id_col, "ids"])

    return map_batches(docs.select(id_col, text_bytes(text_col)), rows, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of every list of ids (null: empty): (id, text)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = bpe.tokenizer(path)
        texts = [t.decode(ids or []) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return map_batches(encoded.select(id_col, ids_col), rows, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest every text in one pass: (id, n_tokens, ids_sha256, decoded_sha256)."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = bpe.tokenizer(path)
        words, word_start, word_len = bpe.decimal_table(t.size)
        texts = batch.column(1).to_pylist()
        for a, b in bpe.blocks(texts):
            got = t.encode(texts[a:b])
            size = word_len[got.ids]
            listed = words[bpe.ragged(word_start[got.ids], size)].tobytes()
            bounds = np.concatenate([[0], np.cumsum(got.counts)])
            cut = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
            decoded, lens = t.decode_bytes(got.ids, got.counts)
            decoded = decoded.tobytes()
            ends = np.concatenate([[0], np.cumsum(lens)]).tolist()
            ids_sha = [hashlib.sha256(listed[i : max(i, j - 1)]).hexdigest() for i, j in zip(cut, cut[1:], strict=False)]
            text_sha = [hashlib.sha256(decoded[i:j].decode("utf-8", "replace").encode()).hexdigest() for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(got.counts), pa.array(ids_sha), pa.array(text_sha)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(id_col, text_bytes(text_col)), rows, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")

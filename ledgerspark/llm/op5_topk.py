"""Operator 5: exact top-k search by tiled matrix products.

Vectors become integers (``floor(scale * x)``), queries and candidates are dealt into blocks of ``TILE_BYTES`` of vectors,
so that a candidate is copied once for that many bytes of queries, and a tile is one query block against one shard: its
matrix products, ``STEP`` queries by ``STEP`` candidates at a time, then a partial selection per query that keeps every
candidate as good as the k-th.  The per-tile lists are merged as a tree, ``FAN`` shards at a time.

Scores are exact: products are summed in doubles while they stay below 2**53, in Python integers beyond it.  A score
among a tile's k best that no long can hold raises; those of a row with itself don't count.  Ties go to the smaller id.

Cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; vectors
are compared with those of their own length only; an empty vector scores 0 against other empty ones; repeated ids are
separate candidates, and a row is left out of its own query by its id; an empty table gives an empty result; fewer
candidates than k give all; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors in a query block or a shard, rows and columns of one matrix product, shards merged at once.
TILE_BYTES, STEP, FAN = 32 << 20, 2_048, 32
#: Candidates in a shard, at most.
SHARD = 16_384


def _matrix(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Integer vectors of one length, as doubles."""
    flat = vectors.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dim)


def tile_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best in one tile."""
    exact = not q.size or not c.size or float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53
    if not exact:
        q, c = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c))
    parts = [_block_top(q_ids[a : a + STEP], q[a : a + STEP], c_ids, c, k) for a in range(0, len(q_ids), STEP)]
    ids, cand, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
    if not exact and any(abs(x) >= 2**63 for x in score):
        raise OverflowError("a score does not fit a long")
    return ids, cand, score.astype(np.int64)


def _block_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one block of queries, with scores as the product gives them."""
    kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.result_type(q, c))
    for a in range(0, len(c_ids), STEP):
        ids = c_ids[a : a + STEP]
        scores = q @ c[a : a + STEP].T
        own = ids[None, :] == q_ids[:, None]
        scores[own] = -np.inf
        good = ~own
        if len(ids) > k:
            good &= scores >= np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None]
        at, col = np.nonzero(good)
        at, cand, score = (np.concatenate(x) for x in zip(kept, (at, ids[col], scores[at, col]), strict=True))
        order = np.lexsort((cand, _ranks(-score), at))
        at, cand, score = at[order], cand[order], score[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < k
        kept = at[best], cand[best], score[best]
    return q_ids[kept[0]], kept[1], kept[2]


def _ranks(values: np.ndarray) -> np.ndarray:
    """Numbers in the order of the values, which may be Python integers."""
    return np.unique(values, return_inverse=True)[1] if values.dtype == object else values


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int | None = None, shard: int | None = None) -> DataFrame:
    """The k best candidates of every query row: (query_id, rank, id, score)."""
    x = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    whole = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v"), is_query.alias("asks")).withColumn("dim", F.size("v"))
    counts = whole.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q"), F.coalesce(F.max("dim"), F.lit(0)).alias("dim")).first()
    fit = max(1, TILE_BYTES // max(1, 8 * counts.dim))
    query_block, shard = query_block or fit, shard or min(fit, SHARD)
    shards, blocks = max(1, -(-counts.n // shard)), max(1, -(-counts.q // query_block))
    row = F.xxhash64("id", F.monotonically_increasing_id())
    def side(p: str, frame: DataFrame, at: str, parts: int, other: str, others: int) -> DataFrame:
        # a row's own place is settled before the row is copied to its partners' places
        placed = frame.select(F.col("dim").alias(f"{p}_dim"), F.col("id").alias(f"{p}_id"), F.col("v").alias(f"{p}_v"), F.pmod(row, F.lit(parts)).cast("int").alias(f"{p}_{at}"))
        return placed.withColumn(f"{p}_{other}", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    candidates = side("c", whole, "shard", shards, "block", blocks)
    asked = side("q", whole.where("asks"), "block", blocks, "shard", shards)

    def tile(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        got = (np.empty(0, np.int64),) * 3
        if q.num_rows and c.num_rows:
            got = tile_top(q.column("q_id").to_numpy(), _matrix(q.column("q_v"), dim), c.column("c_id").to_numpy(), _matrix(c.column("c_v"), dim), k)
        return pa.table([*map(pa.array, got), pa.array(np.full(len(got[0]), key[1].as_py(), np.int32))], names=["query_id", id_col, "score", "shard"])

    keys = ("dim", "shard", "block")
    found = asked.groupBy(*(f"q_{n}" for n in keys)).cogroup(candidates.groupBy(*(f"c_{n}" for n in keys))).applyInArrow(tile, f"query_id long, `{id_col}` long, score long, shard int")
    best = [F.desc("score"), F.asc(id_col)]
    while shards > 1:
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*best))).where(F.col("rank") <= k)
        shards = -(-shards // FAN)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), id_col, "score")

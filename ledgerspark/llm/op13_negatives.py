"""Operator 13: hard negatives by vantage-point trees over norm-augmented vectors.

Vectors become integers (``floor(scale * x)``) and get one more component that brings all to the greatest norm R, so that the
inner product of an anchor q with a row falls with the distance: d**2 = |q|**2 + R**2 - 2 * score.  A window of scores is an
annulus of distances around the anchor, and the best negatives are the nearest rows of another label inside it.

Rows are dealt into shards of about ``SHARD``, each with a tree of its own that is built once and written: every node has a
vantage point and the ranges of distances of its inner and outer half, leaves have ``LEAF`` rows.  A tile is a block of
anchors against a shard.  For each anchor the nodes bound the distances of every leaf; leaves are visited nearest first, those
nearer than the annulus are passed over, and a window is done when the next leaf is beyond the annulus or beyond its k-th
row.  The lists of the shards are merged as a tree.  Bounds carry a margin for rounding and decide only what is visited;
scores are exact integers, and rows are tested by them, so results are those of a full comparison.

Positives are found the same way, by a window without ends over rows of the same label.  In vectors of many dimensions few
leaves are passed over; then the work is that of a product of all anchors with all rows.

Cases: rows without id or label, vectors that are null or hold a null or non-finite component take no part; vectors meet
those of their own length only; repeated ids are separate rows, and a row is left out of its own lists by its id; ties go
to the smaller id; fewer rows than asked for give all; an empty table, or one without anchors, gives none; a negative
positive score has an empty window; other columns are ignored, whatever their names.  Scores have to fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rows of a shard and of a leaf, bytes of vectors in a block of anchors, shards merged at once.
SHARD, LEAF, BLOCK_BYTES, FAN = 16_384, 256, 8 << 20, 32
#: Margin of a bound on scores, as a share of |q|**2 + R**2.
MARGIN = 1e-6


def _matrix(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dim)


def build(v: np.ndarray, radius2: float, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[int, list[float]]]]:
    """(leaf of every row, nodes in heap order as (vantage row, ranges of inner and outer distances))."""
    depth = max(0, int(np.log2(max(1, len(v) / leaf))))
    more = np.sqrt(np.maximum(0, radius2 - (v * v).sum(axis=1)))

    def far(p: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 * radius2 - 2 * (v[rows] @ v[p] + more[rows] * more[p])))

    parts, nodes = [np.arange(len(v))], []
    for _ in range(depth):
        halves = []
        for rows in parts:
            vantage = rows[np.argmax(far(rows[0], rows))]
            d = far(vantage, rows)
            order = np.argsort(d, kind="stable")
            inner, outer = np.array_split(order, 2)
            nodes.append((int(vantage), [d[inner].min(), d[inner].max(), d[outer].min(), d[outer].max()]))
            halves += [rows[inner], rows[outer]]
        parts = halves
    at = np.empty(len(v), np.int64)
    for n, rows in enumerate(parts):
        at[rows] = n
    return at, nodes


def bounds(q: np.ndarray, vantage: np.ndarray, ranges: np.ndarray, radius2: float) -> tuple[np.ndarray, np.ndarray]:
    """Greatest and least score that each query can have in each leaf, with a margin."""
    size = (q * q).sum(axis=1) + radius2
    near, far = np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
    first, count = 0, 1
    while first < len(vantage):
        d = np.sqrt(np.maximum(0, size[:, None] - 2 * (q @ vantage[first : first + count].T)))
        r = ranges[first : first + count]
        gap = [np.maximum(np.maximum(r[:, 2 * i] - d, d - r[:, 2 * i + 1]), near) for i in (0, 1)]
        reach = [np.minimum(d + r[:, 2 * i + 1], far) for i in (0, 1)]
        near, far = (np.stack(x, axis=2).reshape(len(q), -1) for x in (gap, reach))
        first, count = first + count, 2 * count
    margin = MARGIN * size[:, None] + 1
    return (size[:, None] - near**2) / 2 + margin, (size[:, None] - np.minimum(far, 1e150) ** 2) / 2 - margin


def search(tree: dict, q: np.ndarray, of: np.ndarray, own: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(window, row id, score) of each window's k best, and the number of (window, leaf) visits.

    A window belongs to query ``of``, takes scores from ``low`` to ``high`` and rows of the same label or of others, but none
    with the id ``own``.
    """
    v, ids, labels, cuts = tree["v"], tree["ids"], tree["labels"], tree["cuts"]
    top, least = bounds(q, tree["vantage"], tree["ranges"], tree["radius2"])
    order = np.argsort(-top, axis=1, kind="stable")
    exact = not q.size or not v.size or float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2**53
    if not exact:
        q, v = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, v))
    kth = np.full(len(of), -np.inf)
    kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.result_type(q, v))
    active, visits = np.arange(len(of)), 0
    for turn in range(order.shape[1]):
        leaf = order[of[active], turn]
        on = top[of[active], leaf] >= np.maximum(kth[active], low[active].astype(float))
        active, leaf = active[on], leaf[on]
        if not len(active):
            break
        inside = least[of[active], leaf] <= high[active].astype(float)
        meets, leaf = active[inside], leaf[inside]
        visits += len(meets)
        by = np.argsort(leaf, kind="stable")
        meets, leaf = meets[by], leaf[by]
        found = [kept]
        for part in np.split(np.arange(len(leaf)), np.nonzero(np.diff(leaf))[0] + 1):
            if not len(part):
                continue
            w, (a, b) = meets[part], cuts[leaf[part[0]] : leaf[part[0]] + 2]
            asked, place = np.unique(of[w], return_inverse=True)
            score = (q[asked] @ v[a:b].T)[place]
            good = (score >= low[w, None]) & (score <= high[w, None]) & (score >= kth[w, None]) & (ids[None, a:b] != own[w, None]) & ((labels[None, a:b] == label[w, None]) == same)
            at, col = np.nonzero(good)
            found.append((w[at], ids[a:b][col], score[at, col]))
        if len(found) > 1:
            win, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
            falling = np.unique(-score, return_inverse=True)[1] if score.dtype == object else -score
            by = np.lexsort((row, falling, win))
            win, row, score = win[by], row[by], score[by]
            nth = np.arange(len(win)) - np.searchsorted(win, win)
            kept = win[nth < k], row[nth < k], score[nth < k]
            full = nth == k - 1
            kth[win[full]] = score[full].astype(float) * (1 if exact else 1 - 1e-9 * np.sign(score[full].astype(float)))
    if not exact and any(abs(x) >= 2**63 for x in kept[2]):
        raise OverflowError("a score does not fit a long")
    return kept[0], kept[1], kept[2].astype(np.int64), visits


def _tree(table: pa.Table, dim: int, radius2: float) -> dict:
    """What ``search`` needs, from the written rows of a shard: nodes have negative places, rows the number of their leaf."""
    place = table.column("place").to_numpy()
    order = np.lexsort((table.column("id").to_numpy(), place))
    nodes, rows = order[place[order] < 0][::-1], order[place[order] >= 0]
    v = _matrix(table.column("v"), dim)
    leaves = place[rows]
    return {
        "v": v[rows],
        "ids": table.column("id").to_numpy()[rows],
        "labels": table.column("label").to_numpy()[rows],
        "cuts": np.searchsorted(leaves, np.arange(len(nodes) + 2)),
        "vantage": v[nodes],
        "ranges": np.array([table.column("ranges")[int(i)].as_py() for i in nodes]).reshape(len(nodes), 4),
        "radius2": radius2,
    }


class Index:
    """Shards of rows with their trees, in the shared folder."""

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int, is_anchor: Column, shard: int = SHARD, leaf: int = LEAF) -> None:
        x = F.col(vector_col)
        usable = F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
        whole = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"), is_anchor.alias("asks"))
        self.rows = saved(whole.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
        size = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
        stats = self.rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("anchors"), F.coalesce(F.max("dim"), F.lit(0)).alias("dim"), F.coalesce(F.max(size), F.lit(0.0)).alias("radius2")).first()
        self.shards, radius2 = max(1, -(-stats.n // shard)), float(stats.radius2)
        self.blocks, self.radius2 = max(1, -(-stats.anchors * 8 * max(1, stats.dim) // BLOCK_BYTES)), radius2
        place = F.pmod(F.xxhash64("row"), F.lit(self.shards)).cast("int")

        def grow(key: tuple, table: pa.Table) -> pa.Table:
            dim = key[0].as_py()
            v = _matrix(table.column("v"), dim)
            at, nodes = build(v, radius2, leaf)
            flat = np.concatenate([v, v[[p for p, _ in nodes]]]) if nodes else v
            n, m = len(v), len(nodes)
            return pa.table(
                {
                    "dim": np.full(n + m, dim, np.int32),
                    "shard": np.full(n + m, key[1].as_py(), np.int32),
                    "place": np.concatenate([at, -1 - np.arange(m)]).astype(np.int32),
                    "id": np.concatenate([table.column("id").to_numpy(), np.zeros(m, np.int64)]),
                    "label": np.concatenate([table.column("label").to_numpy(), np.zeros(m, np.int64)]),
                    "v": pa.ListArray.from_arrays(np.arange(n + m + 1, dtype=np.int32) * dim, flat.ravel()),
                    "ranges": pa.array([None] * n + [r for _, r in nodes], pa.list_(pa.float64())),
                }
            )

        dealt = self.rows.select("dim", place.alias("shard"), "id", "label", "v").groupBy("dim", "shard")
        self.trees = saved(dealt.applyInArrow(grow, "dim int, shard int, place int, id long, label long, v array<double>, ranges array<double>"), "trees")

    def best(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(row, window, id, score, rank) of each window's k best; asked: (dim, row, id, label, v, windows of (low, high))."""
        radius2, shards, blocks = self.radius2, self.shards, self.blocks
        places = asked.select(F.col("dim").alias("q_dim"), F.col("row").alias("q_row"), F.col("id").alias("q_id"), F.col("label").alias("q_label"), F.col("v").alias("q_v"), F.col("windows").alias("q_windows"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("q_block"))
        left = places.withColumn("q_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        right = self.trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def tile(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
            got = (np.empty(0, np.int64),) * 4
            if q.num_rows and c.num_rows:
                dim = key[0].as_py()
                windows = q.column("q_windows").to_pylist()
                of = np.repeat(np.arange(q.num_rows), [len(w) for w in windows])
                nth = np.concatenate([np.arange(len(w)) for w in windows])
                low, high = (np.array([np.nan if x[n] is None else x[n] for w in windows for x in w], object) for n in ("low", "high"))
                ends = [np.where([x == x for x in side], side, end) for side, end in ((low, -np.inf), (high, np.inf))]
                low, high = (e.astype(np.int64) if all(abs(x) < 2**62 for x in e) else e.astype(float) for e in ends)
                own, label = q.column("q_id").to_numpy()[of], q.column("q_label").to_numpy()[of]
                win, found, score, _ = search(_tree(c, dim, radius2), _matrix(q.column("q_v"), dim), of, own, label, low, high, same, k)
                got = q.column("q_row").to_numpy()[of[win]], nth[win], found, score
            return pa.table([pa.array(got[0]), pa.array(got[1].astype(np.int32)), pa.array(got[2]), pa.array(got[3]), pa.array(np.full(len(got[0]), key[1].as_py(), np.int32))], names=["row", "window", "id", "score", "shard"])

        lists = left.groupBy("q_dim", "q_shard", "q_block").cogroup(right.groupBy("dim", "shard", "block")).applyInArrow(tile, "row long, window int, id long, score long, shard int")
        order = [F.desc("score"), F.asc("id")]
        while shards > 1:
            shards = -(-shards // FAN)
            lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
            lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("row", "window", "shard").orderBy(*order))).where(F.col("rank") <= k)
        return lists.withColumn("rank", F.row_number().over(Window.partitionBy("row", "window").orderBy(*order)).cast("int")).where(F.col("rank") <= k).drop("shard")


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """For each anchor and positive the k best rows of other labels whose score is ``low`` to ``high`` percent of the positive's."""
    index = Index(vectors, id_col, vector_col, label, scale, is_anchor, shard, leaf)
    anchors = index.rows.where("asks").select("dim", "row", "id", "label", "v")
    ends = "array<struct<low: bigint, high: bigint>>"
    near = saved(index.best(anchors.withColumn("windows", F.expr(f"from_json('[{{}}]', '{ends}')")), True, positives), "positives")
    # ceil(low * score / 100) and floor(high * score / 100), in whole numbers
    whole = F.col("score").cast("decimal(38,0)")
    percent = lambda p, up: (F.ceil if up else F.floor)(whole * p / F.lit(100).cast("decimal(3,0)")).cast("long")
    ranked = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", percent(low, True).alias("low"), percent(high, False).alias("high")))).alias("found"))
    asked = anchors.join(ranked, "row")
    windows = F.transform("found", lambda f: F.struct(f["low"].alias("low"), f["high"].alias("high")))
    chosen = index.best(asked.withColumn("windows", windows).drop("found"), False, k)
    paired = near.select("row", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = chosen.select("row", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(paired, ["row", "window"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH whole AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.id AS anchor_id, c.id, q.label = c.label AS same, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.id % 50 = 0 AND c.id <> q.id AND len(q.v) = len(c.v)
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), found AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""

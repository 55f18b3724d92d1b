"""Operator 4: SimHash near-duplicates by generalised pigeonhole search.

Fingerprints: 64 bits, each set if it is set in over half of the XXH64 hashes of a text's word shingles.
Search: equal fingerprints are one node.  Bits that go together (by the correlation over all nodes) are grouped into
partitions; for every number of partitions, dynamic programming allots thresholds that may differ between partitions
and add up to ``distance - partitions + 1``, by candidate counts estimated from histograms of all nodes, and the
cheapest plan wins.  Nodes are indexed by each partition's bits, probed with all values within its threshold, and
candidates are verified on all 64 bits.  A bucket of more than ``BUCKET`` nodes is not paired up: its nodes meet at
midpoints instead (each node at every value within half the distance), which finds exactly the same links with a
number of rows that is linear in the nodes.

Cases: null text is the empty text; texts without words have fingerprint zero and are linked like any other; texts of
fewer words than a shingle count as one shingle; null ids are kept, and a component without any id has a null id;
repeated rows and ids are kept row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Tokenizer
from .common import discard, map_batches, release, saved, spread_join, text_bytes
from .graph import components

BITS, SEED = 64, 42
#: Nodes in a bucket that are compared pair by pair, at most.
BUCKET = 32
#: Buckets of the histograms from which candidate counts are estimated.
HISTOGRAM = 1024


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a text, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    count = max(1, len(words) - shingle + 1)
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    for a in range(0, count, 1 << 16):
        b = min(count, a + (1 << 16))
        h = np.fromiter((digest(joined[i : j - 1], SEED) for i, j in zip(starts[a:b], stops[a:b], strict=True)), ">u8", b - a)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=[id_col, "fp"])

    return map_batches(docs.select(id_col, text_bytes(text_col)), rows, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


# -- the plan ------------------------------------------------------------------


@dataclass(frozen=True)
class Partition:
    """A group of bit numbers and the distance within which it is probed (-1: not at all)."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def group_bits(correlation: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits in groups of like size, each bit beside those that it is most correlated with."""
    strength = np.abs(correlation) - np.eye(BITS) * np.abs(correlation)
    left, groups = set(range(BITS)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        seed = max(sorted(left), key=lambda b: strength[b, sorted(left)].sum())
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            near = max(sorted(left), key=lambda b: strength[b, group].sum())
            group.append(near)
            left.discard(near)
        groups.append(tuple(sorted(group)))
    return groups


def allot(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds, one a partition, that add up to the budget at the least cost (dynamic programming)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in options.items():
                if used + t not in step or cost + c < step[used + t][0]:
                    step[used + t] = (cost + c, [*chosen, t])
        best = step
    return best.get(budget, (float("inf"), []))


def _moments(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes, and the correlation of their bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            bits = np.hstack([bits, np.ones((len(bits), 1), np.float32)])
            total += bits.T @ bits
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j].astype(np.int64))], names=["i", "j", "n"])

    m = np.zeros((BITS + 1, BITS + 1))
    for r in nodes.select("fp").mapInArrow(rows, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        m[r.i, r.j] = r.n
    n = m[BITS, BITS]
    if not n:
        return 0, np.eye(BITS)
    mean = m[:BITS, BITS] / n
    cov = m[:BITS, :BITS] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return int(n), cov / np.outer(sd, sd)


def _collisions(nodes: DataFrame, masks: list[int], n: int) -> list[float]:
    """Estimated comparisons for every mask: ordered pairs (each node with itself included) that agree on it, or in a large
    bucket the rows of its midpoints.

    Nodes are counted by a hash of their masked bits.  What an entry has beyond an even share, if more than chance gives,
    is taken for one bucket.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(masks), HISTOGRAM), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, mask in enumerate(masks):
                x = (fp & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(32)
                total[k] += np.bincount(((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(54)).astype(np.int64), minlength=HISTOGRAM)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(total[k, b])], names=["k", "b", "n"])

    counted = nodes.select("fp").mapInArrow(rows, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n"))
    even = n * n / HISTOGRAM
    share = n / HISTOGRAM
    beyond = F.col("n").cast("double") - share
    pairs = F.when(beyond > BUCKET + 6 * share**0.5, share * share + beyond * (BITS + 1)).otherwise(F.col("n").cast("double") * F.col("n"))
    squares = {r.k: float(r.s) for r in counted.groupBy("k").agg(F.sum(pairs).alias("s")).collect()}
    return [max(float(n), (squares.get(k, 0.0) - even) / (1 - 1 / HISTOGRAM)) for k in range(len(masks))]


def make_plan(nodes: DataFrame, distance: int) -> list[Partition]:
    """Partitions with thresholds, the cheapest by probes and estimated candidates."""
    n, correlation = _moments(nodes)
    options = {m: group_bits(correlation, m) for m in range(1 + distance // 2, distance + 2)}
    groups = [g for m in options for g in options[m]]
    masks = [x for g in groups for x in (sum(1 << b for b in g), sum(1 << b for b in g[1:]))]
    found = _collisions(nodes, masks, n)
    agree = {g: (found[2 * i], found[2 * i + 1]) for i, g in enumerate(groups)}

    def cost(g: tuple[int, ...], t: int) -> float:
        if t < 0:
            return 0.0
        same, but_one = agree[g]
        values = sum(comb(len(g), k) for k in range(t + 1))
        return n * values + same + sum(comb(len(g), k) * max(0.0, but_one - same) for k in range(1, t + 1))

    plans = []
    for m, parts in options.items():
        total, chosen = allot([{t: cost(g, t) for t in range(-1, 2)} for g in parts], distance - m + 1)
        plans.append((total, m, [Partition(g, t) for g, t in zip(parts, chosen, strict=False) if t >= 0]))
    return min(plans, key=lambda p: p[:2])[2]


# -- the search ----------------------------------------------------------------


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _within(fp: Column, radius: int) -> Column:
    """All values that differ from a fingerprint in up to ``radius`` (0 to 2) bits."""
    flips = [0]
    if radius >= 1:
        flips += [1 << b for b in range(BITS)]
    if radius >= 2:
        flips += [1 << a | 1 << b for a in range(BITS) for b in range(a)]
    return F.transform(F.array(*(F.lit(_signed(x)) for x in flips)), lambda x: x.bitwiseXOR(fp))


def links(nodes: DataFrame, distance: int = 2, bucket: int = BUCKET, plan: list[Partition] | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints; their components are those of all pairs within the distance."""
    if not 0 <= distance <= 4:
        raise ValueError("distance must be 0 to 4")
    plan = make_plan(nodes, distance) if plan is None else plan
    fp = F.col("fp")
    keyed = [F.struct(F.lit(i).alias("part"), fp.bitwiseAND(F.lit(_signed(p.mask))).alias("key")) for i, p in enumerate(plan)]
    index = nodes.select("fp", F.explode(F.array(*keyed)).alias("k")).select(fp, "k.part", "k.key")
    probes = [F.struct(F.lit(i).alias("part"), fp.bitwiseAND(F.lit(_signed(p.mask))).bitwiseXOR(F.lit(_signed(flip))).alias("key"), F.lit(flip == 0).alias("own")) for i, p in enumerate(plan) for flip in ([0] + [1 << b for b in p.bits] * (p.threshold == 1))]
    # written, as several joins read them: else each would make them anew
    asked = saved(nodes.select("fp", F.explode(F.array(*probes)).alias("k")).select(fp, "k.part", "k.key", "k.own"), "probes")
    sizes = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    if all(p.threshold == 0 for p in plan):
        sizes = sizes.where("n > 1")
    hit = spread_join(asked, saved(sizes.withColumn("rows", F.col("n")), "bucket-sizes"), ["part", "key"], "rows")
    cold = hit.where((F.col("n") <= bucket) & (~F.col("own") | (F.col("n") > 1)))
    other = index.withColumnRenamed("fp", "other")
    near = cold.join(other, ["part", "key"]).where((fp < F.col("other")) & (_differ(fp, F.col("other")) <= distance)).select(fp.alias("a"), F.col("other").alias("b"))
    # large buckets: nodes within the distance share a midpoint, and each midpoint's nodes are linked to its least one
    hot = hit.where(F.col("n") > bucket).select("fp").distinct()
    low, high = distance // 2, distance - distance // 2
    met = hot.select(fp, F.explode(_within(fp, high)).alias("at"))
    if low == high:
        least = met.groupBy("at").agg(F.min("fp").alias("b"))
        far = met.join(least, "at").where("fp <> b").select(fp.alias("a"), "b")
    else:
        inner = hot.select(fp.alias("b"), F.explode(_within(fp, low)).alias("at"))
        far = met.join(inner, "at").where("fp < b or fp > b").select(fp.alias("a"), "b")
    return near.union(far)


def near_components(prints: DataFrame, distance: int = 2, id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component_id): the least id that is reachable over links, for every row of (id, fp)."""
    prints = saved(prints.select(id_col, "fp"), "fingerprints")
    nodes = saved(prints.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count("*").alias("n")), "nodes")
    joined = components(links(nodes.select("fp"), distance), "a", "b")
    named = nodes.join(joined, nodes["fp"] == joined["node"], "left").select(nodes["fp"], "least_id", "n", F.coalesce("component", nodes["fp"]).alias("component"))
    named = saved(named, "classes")
    least = saved(named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("nodes")), "least-ids")
    of_print = saved(spread_join(named, least, ["component"], "nodes").select("fp", "component_id", "n"), "print-classes")
    discard(nodes, named, least)
    return spread_join(prints, of_print, ["fp"]).select(id_col, "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    found = near_components(fingerprints(docs, shingle, id_col, text_col), distance, id_col)
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- near copies by resemblance -------------------------------------------------
#
# Two texts whose five-word shingles agree to 0.8 differ in 6 to 13 of 64 SimHash bits, which no partitioning of 64 bits
# can search without comparing nearly everything.  For a similarity threshold the SimHash links are therefore joined by
# candidates from bands of least shingle hashes, and every candidate is verified on whole shingle sets.

BANDS, BAND_ROWS = 20, 3
#: Texts and shingles in a block of a band that is compared with others as a whole, and columns of its matrices.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 20, 8192
#: Texts that a task turns into signatures or shingle sets at once.
TEXTS = 512
#: Texts above which a band meets the text in the middle of it before all its pairs are compared.
CENTRED = 64


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, ascending (of all its words, if they are fewer)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    buf = np.frombuffer(b"".join(words) + bytes(16), np.uint8)
    h = Tokenizer.hashes(buf, np.cumsum(size) - size, size)
    span = min(shingle, len(h))
    out = np.zeros(len(h) - span + 1, np.uint64)
    for i in range(span):
        out ^= h[i : i + len(out)]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> list[int]:
    """One key for each band: a hash of the least values of its permutations (none for an empty set)."""
    if not len(hashes):
        return []
    rng = np.random.Generator(np.random.PCG64(7))
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 4096):
        x = hashes[None, a : a + 4096] * factors[:, None]
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * np.uint64(0xD6E8FEB86659FD93)).min(1))
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for part in least.reshape(bands, rows).T:
        keys = (keys ^ part) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64).tolist()


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays without repeats; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with a < b of (key, hub)."""
    return pairs.where("key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def _compared(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b, alike): the similarity of every pair."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = lambda x: np.frombuffer(x.as_buffer(), "<u8")
        alike = [resemblance(read(x), read(y)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(alike, pa.float64())], names=["a", "b", "alike"])

    both = pairs.join(bags.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a").join(bags.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    return saved(map_batches(both.select("a", "b", "sa", "sb"), run, "a binary, b binary, alike double"), "compared")


def _between(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of keys as pairs of their components."""
    of = lambda c: classes.select(F.col("key").alias(c), F.col("component").alias(f"of_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))


def _merged(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(key, component) after links (a, b) between components."""
    joined = components(found, "a", "b").withColumnRenamed("component", "least")
    return saved(classes.join(joined, F.col("component") == F.col("node"), "left").select("key", F.coalesce("least", "component").alias("component")), "copy-classes")


def _open_members(rest: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``rest`` in bands that have more than one component, with component and the band's size.

    Of bands with the same texts one stays.
    """
    rows = rest.join(classes, "key")
    whole = rows.groupBy("band").agg(
        F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.xxhash64(F.lit(1), "key").cast("decimal(38,0)")).alias("s")
    )
    one = whole.where("low <> high").groupBy("n", "shingles", "x", "s").agg(F.min("band").alias("band"))
    return rows.join(one.select("band", "n", "shingles"), "band")


def linked_rows(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Whether each of ``left`` reaches the similarity with each of ``right`` (with those after it in ``left``, if None)."""
    sets = left if right is None else left + right
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    word, number, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # what only one of them has is in no intersection
    place = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[number]
    row = np.repeat(np.arange(len(sets)), size)[place >= 0]
    place = place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    a, b = (slice(None), slice(None)) if right is None else (slice(len(left)), slice(len(left), None))
    common = np.zeros((len(left), len(sets) if right is None else len(right)))
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        i, j = np.searchsorted(place, [low, low + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, int(place[-1]) + 1 - low)), np.float32)
        held[row[i:j], place[i:j] - low] = 1
        common += held[a] @ held[b].T
    good = common / (size[a][:, None] + size[b][None, :] - common) >= similarity
    return np.triu(good, 1) if right is None else good


def _all_pairs(members: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components, from all pairs of each band's ``members``.

    Large bands are cut into blocks, and every two blocks are compared by themselves, so that no task has a band as a
    whole.  Two blocks yield as many links as join what they join, not one for each pair.
    """
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1))
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), "blocks"))
    paired = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = paired.select("band", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "key", "component")
    # two blocks of one component are joined already
    mixed = units.groupBy("band", "i", "j").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "i", "j")
    rows = units.join(mixed, ["band", "i", "j"]).join(bags, "key").select("band", "i", "j", "block", "component", "shingles")

    def run(table: pa.Table) -> pa.Table:
        block, component = table.column("block").to_numpy(), np.array(table.column("component").to_pylist(), object)
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("shingles")]
        first, last = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        at, to = np.flatnonzero(block == first), np.flatnonzero(block == last)
        out = []
        if len(at) and len(to):
            good = linked_rows([sets[k] for k in at], None if first == last else [sets[k] for k in to], similarity)
            root: dict[bytes, bytes] = {}

            def find(x: bytes) -> bytes:
                while (y := root.get(x, x)) != x:
                    root[x] = x = root.get(y, y)
                return x

            for x, y in {(component[at[p]], component[to[q]]) for p, q in zip(*np.nonzero(good), strict=True)}:
                u, v = find(x), find(y)
                if u != v:
                    root[u] = v
                    out.append((x, y))
        del sets
        release()
        return pa.table([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])

    return rows.groupBy("band", "i", "j").applyInArrow(run, "a binary, b binary")


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of every group of like texts the one with the least id stays.

    Groups are components of links between texts whose shingle sets reach the similarity.  Null text is the empty
    text, and texts without words are alike; texts of fewer words than a shingle are one shingle; among rows of equal
    text and id one stays; null ids come last; an empty table gives an empty result; all columns are kept, whatever
    their names.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(F.unhex(F.md5(text_bytes(text_col))).alias("key"), F.col(id_col).alias("id"), row)
    source = rows.select("key", "id", text_bytes(F.col("row")[text_col]).alias("text"))

    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, batch.num_rows, TEXTS):
            part = batch.slice(a, TEXTS)
            texts = part.column(2).to_pylist()
            prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            sizes, bands = [], []
            for t in texts:
                found = shingle_hashes(t, shingle)
                sizes.append(len(found))
                bands.append(band_keys(found))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["key", "id", "fp", "size", "bands"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    signed = map_batches(source, sign, f"key binary, id {id_kind}, fp long, size long, bands array<long>")
    texts = saved(signed.groupBy("key").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("fp", "size", "bands"))), "signatures")

    prints = texts.groupBy("fp").agg(F.min("key").alias("hub"))
    same = texts.join(prints, "fp").select("key", "hub")
    linked = links(texts.select("fp").distinct(), distance)
    near = linked.join(prints.select(F.col("fp").alias("a"), F.col("hub").alias("key")), "a").join(prints.select(F.col("fp").alias("b"), "hub"), "b").select("key", "hub")
    banded = texts.select("key", "size", F.explode("bands").alias("band"))
    # first a band's texts meet four of them, its ends in two orders that do not depend on each other
    mixed = F.xxhash64("key")
    ends = F.array_distinct(F.array(F.min("key"), F.max("key"), F.min_by("key", mixed), F.max_by("key", mixed)))
    hubs = banded.groupBy("band").agg(ends.alias("hubs")).where(F.size("hubs") > 1)
    met = banded.join(hubs, "band").select("key", F.explode("hubs").alias("hub"))
    pairs = saved(_ordered(same.union(near).union(met)), "copy-pairs")

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, batch.num_rows, TEXTS):
            part = batch.slice(a, TEXTS)
            found = [shingle_hashes(t, shingle).astype("<u8").tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["key", "shingles"])

    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    asked = texts.join(ends, "key").select("key", "id")
    # one row for each text that takes part in a pair; copies of a text have other ids, so they are spread
    same_row = (source["key"] == asked["key"]) & source["id"].eqNullSafe(asked["id"])
    members = source.join(asked, same_row, "left_semi").select("key", "text")
    bags = saved(map_batches(members, sets, "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles")), "shingle-sets")

    alike = _compared(pairs, bags)
    good = F.col("alike") >= similarity
    classes = _merged(texts.select("key", F.col("key").alias("component")), alike.where(good))
    # all that a band has besides these four
    rest = saved(banded.join(hubs, "band").where(~F.array_contains("hubs", F.col("key"))).select("band", "key", "size", "hubs"), "band-rests")
    large = saved(_open_members(rest, classes).where(F.col("n") > CENTRED), "large-bands")
    if not large.isEmpty():
        # the text most like a large band's four stands near the middle of it: often one more meeting joins them all
        to_hub = large.select("band", "key", F.explode("hubs").alias("hub")).select("band", "key", F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b"))
        likeness = to_hub.join(alike, ["a", "b"]).groupBy("band", "key").agg(F.sum("alike").alias("alike"))
        centre = likeness.groupBy("band").agg(F.max_by("key", F.struct("alike", "key")).alias("hub"))
        more = _ordered(large.join(centre, "band").select("key", "hub"))
        classes = _merged(classes, _between(_compared(more, bags).where(good), classes))
    # then all of a band that are not known to be joined meet each other
    classes = _merged(classes, _all_pairs(_open_members(rest, classes), bags, similarity))
    named = texts.select("key", "id").join(classes, "key")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first")
    place = [F.col("key"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), F.col("id").isNull().alias("unnamed")]
    keepers = saved(named.groupBy("component").agg(first).select("first.key", "first.id").select(*place), "keepers")
    discard(texts, pairs, bags, alike, classes, rest, large)
    # repeated rows of one text and id are thinned where they are read
    at = Window.partitionBy("key", "name", "unnamed").orderBy(F.lit(1))
    one = rows.select(*place, "row").withColumn("no", F.row_number().over(at)).where("no = 1")
    kept = one.join(keepers, ["key", "name", "unnamed"], "left_semi")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))

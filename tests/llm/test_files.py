"""Packing, token files and media: round trips and damage."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerspark.llm import bpe, op3_media, op7_packing, op10_token_files
from ledgerspark.llm.queries import tokenizer_file

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


# -- packing


def test_best_fit_takes_the_tightest_bin():
    assert op7_packing.best_fit([6, 3, 4, 1, 5], 10) == [(0, 0), (0, 6), (1, 0), (0, 9), (1, 4)]


def test_the_fullest_bin_closes_first():
    # bins with 4 and 7 used are open; a third closes the fuller one, so the last piece cannot go there
    assert op7_packing.best_fit([7, 4, 8, 3], 10, open_bins=2) == [(0, 0), (1, 0), (2, 0), (1, 4)]


def listed_best_fit(sizes, capacity, open_bins):
    """Best-fit by scanning a list of open bins; the last made of equal ones is taken."""
    out, bins, made = [], [], 0  # bins: [free, number], in order of their last use
    for n in sizes:
        fits = [b for b in bins if b[0] >= n]
        if fits:
            got = min(reversed(fits), key=lambda b: b[0])
            bins.remove(got)
        else:
            if len(bins) >= open_bins and n < capacity:
                bins.remove(min(reversed(bins), key=lambda b: b[0]))
            got, made = [capacity, made], made + 1
        out.append((got[1], capacity - got[0]))
        if got[0] > n:
            bins.append([got[0] - n, got[1]])
    return out


@pytest.mark.parametrize("open_bins", [1, 5, 64])
def test_best_fit_is_that_of_a_list(open_bins):
    rng = random.Random(open_bins)
    sizes = [rng.randint(1, 100) for _ in range(2000)]
    assert op7_packing.best_fit(sizes, 100, open_bins) == listed_best_fit(sizes, 100, open_bins)


def test_the_bound_acts_at_its_default():
    rng = random.Random(4)
    sizes = [rng.randint(1, 4096) for _ in range(op7_packing.GROUP)]
    packer, used = op7_packing.BestFit(4096, op7_packing.OPEN), {}
    for n in sizes:
        b, at = packer.place(n)
        assert used.get(b, 0) == at and packer.open <= op7_packing.OPEN
        used[b] = at + n
        assert used[b] <= 4096
    assert packer.closed > 0 and len(used) <= sum(sizes) / 4096 * 1.06


def test_packed_documents(spark):
    t = bpe.Tokenizer(tokenizer_file(WORD))
    rows = [(i, "some words here " * (i % 9)) for i in range(60)] + [(60, "long " * 9000), (None, None), (61, ""), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as length", "1 as piece")
    got = op7_packing.pack_documents(docs, tokenizer_file(WORD), end_id=1, with_ids=True).collect()
    assert sum(r.length for r in got) == sum(int(t.count([(s or "").encode()])[0]) + 1 for _, s in rows)
    bins = {}
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted((r.piece, r.start) for r in got if r.doc_id == 60) == [(0, 0), (1, 4096), (2, 8192)]
    assert sorted(got, key=repr) == sorted(op7_packing.pack_documents(docs, tokenizer_file(WORD), end_id=1, with_ids=True).collect(), key=repr)
    assert op7_packing.pack_documents(docs.where("false"), tokenizer_file(WORD)).collect() == []


# -- token files


@pytest.mark.parametrize("n", [0, 1, 255, 257, 65_536, 65_537, 200_003])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(1.0, n) * 20).astype(np.int64) % 50_257
    symbols, counts = np.unique(np.append(ids, 7), return_counts=True)
    coder = op10_token_files.Coder(symbols, op10_token_files.shared_frequencies(symbols, counts))
    frame = coder.encode(ids)
    assert coder.decode(frame).tolist() == ids.tolist()
    if n > 60_000:
        entropy = -(counts / counts.sum() * np.log2(counts / counts.sum())).sum()
        assert len(frame) * 8 < n * entropy * 1.05 + 16 * 8 * 2048


def test_one_symbol():
    coder = op10_token_files.Coder(np.array([5]), op10_token_files.shared_frequencies(np.array([5]), np.array([3])))
    assert coder.decode(coder.encode(np.full(1000, 5))).tolist() == [5] * 1000


def test_damage_is_noticed():
    ids = np.arange(5000) % 300
    symbols, counts = np.unique(ids, return_counts=True)
    coder = op10_token_files.Coder(symbols, op10_token_files.shared_frequencies(symbols, counts))
    frame = bytearray(coder.encode(ids))
    frame[-3] ^= 1
    for bad in (bytes(frame), bytes(frame[:-4]), b"nope" + bytes(frame[4:])):
        with pytest.raises(ValueError):
            coder.decode(bad)


def test_frequencies_fill_all_slots():
    for counts in ([1], [1, 10**12], [3] * 1000, [1] * 999 + [10**9]):
        slots = op10_token_files.shared_frequencies(np.arange(len(counts)), np.array(counts))
        assert slots.sum() == 1 << op10_token_files.PRECISION and slots.min() >= 1


def test_files_in_document_order(spark, tmp_path):
    t = bpe.Tokenizer(tokenizer_file(BYTE))
    rows = [(i * 37 % 101, f"text number {i} " * (i % 5)) for i in range(101)] + [(None, None), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as part", "'s' as seq").repartition(5)
    op10_token_files.write_token_files(docs, str(tmp_path / "f"), tokenizer_file(BYTE), end_id=2)
    got = sorted(op10_token_files.read_token_files(spark, str(tmp_path / "f"), with_ids=True).collect(), key=lambda r: r.start)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and len(got) == 103
    at = 0
    want = sorted([*t.encode([(s or "").encode()]).ids.tolist(), 2] for _, s in rows)
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32
        at += r.n_tokens
    assert sorted(r.ids for r in got) == want
    op10_token_files.write_token_files(docs.where("false"), str(tmp_path / "e"), tokenizer_file(BYTE), end_id=2)
    assert op10_token_files.read_token_files(spark, str(tmp_path / "e")).collect() == []


# -- media


def test_images_round_trip():
    rng = np.random.default_rng(5)
    for height in (1, 2, 33, 500):
        samples = rng.integers(0, 256, (height, 64)).astype(np.uint8)
        assert (op3_media.read_png(op3_media.write_png(samples)) == samples).all()


def test_all_filters():
    rng = np.random.default_rng(6)
    want = rng.integers(0, 256, (40, 9)).astype(int)
    kinds = rng.integers(0, 5, 40)
    lines = np.zeros((40, 10), np.uint8)
    for y in range(40):
        lines[y, 0] = kinds[y]
        for x in range(9):
            a, b, c = want[y, x - 1] if x else 0, want[y - 1, x] if y else 0, want[y - 1, x - 1] if x and y else 0
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kinds[y]]
            lines[y, x + 1] = (want[y, x] - guess) % 256
    assert (op3_media._unfilter(lines) == want).all()


def test_bad_images_raise():
    data = op3_media.write_png(np.zeros((3, 64), np.uint8))
    flipped = bytearray(data)
    flipped[45] ^= 255
    for bad in (b"", data[:-1], data[:30], bytes(flipped), data[8:]):
        with pytest.raises(op3_media.BadImage):
            op3_media.read_png(bad)


def test_media_frames(spark):
    docs = spark.createDataFrame([(1, "hello"), (2, "hello"), (None, None), (3, ""), (4, "x" * 64), (5, "y" * 100_000)], "doc_id long, text string").selectExpr("*", "1 as media", "2 as n_bytes")
    got = {r.doc_id: r for r in op3_media.media_features(op3_media.to_media(docs)).collect()}
    assert got[1][1:] == got[2][1:] and got[None][1:] == got[3][1:]
    assert got[3].payload_bytes == 64 and got[4].payload_bytes == 64 and got[1].n_bytes == 5
    assert op3_media.to_media(docs.where("false")).collect() == []


def plain_png_rows(data):
    """Rows of an 8-bit grey PNG, sample by sample, from the format's description."""
    at, packed, size = 8, b"", None
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            size = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, (width, height), rows = zlib.decompress(packed), size, []
    for y in range(height):
        line, above, row = raw[y * (width + 1) : (y + 1) * (width + 1)], rows[-1] if rows else [0] * width, []
        for x in range(width):
            a, b = row[x - 1] if x else 0, above[x]
            row.append((line[1 + x] + (0, a, b)[line[0]]) % 256)
        rows.append(row)
    return rows


def plain_cosine_hash(rows):
    """The same hash by sums over samples: cell means on a 32 by 32 grid, cosine sums, bits above the median."""
    height, width = len(rows), len(rows[0])
    grid = []
    for i in range(32):
        low, high = i * height / 32, (i + 1) * height / 32
        cells = []
        for j in range(32):
            total = 0.0
            for y in range(int(low), min(height, int(np.ceil(high)) + 1)):
                share = max(0.0, min(high, y + 1) - max(low, y))
                total += share * sum(rows[y][j * width // 32 : (j + 1) * width // 32]) / (width // 32)
            cells.append(total / (high - low))
        grid.append(cells)
    wave = [[np.cos(np.pi * k * (2 * x + 1) / 64) for x in range(32)] for k in range(8)]
    low = [sum(wave[u][y] * wave[v][x] * grid[y][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return "".join("1" if c > middle else "0" for c in low), [abs(c - middle) for c in low]


def test_media_columns_are_those_of_plain_python(spark):
    rng = random.Random(12)
    texts = [None, "", "hello", "é😀" * 40, "x" * 64, "ab" * 32 + "c", "\x00\x01" * 70, "".join(chr(rng.randrange(32, 1200)) for _ in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {r.doc_id: bytes(r.media) for r in op3_media.to_media(docs).collect()}
    got = {r.doc_id: r for r in op3_media.media_features(op3_media.to_media(docs)).collect()}
    for n, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        rows = plain_png_rows(stored[n])
        assert bytes(v for row in rows for v in row) == payload
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored[n]), hashlib.sha256(stored[n]).hexdigest())
        assert tuple(got[n])[1:7] == want
        bits, gaps = plain_cosine_hash(rows)
        # bits whose coefficient is the median itself may fall to either side by rounding
        differ = [i for i, (a, b) in enumerate(zip(bits, f"{int(got[n].feature, 16):064b}", strict=True)) if a != b]
        assert all(gaps[i] < 1e-6 for i in differ), (n, differ)


def test_one_document_longer_than_a_frame(spark, tmp_path):
    text = " ".join(f"word{i % 977}" for i in range(400_000))
    docs = spark.createDataFrame([(1, "short"), (2, text), (3, None)], "doc_id long, text string")
    target = str(tmp_path / "files")
    op10_token_files.write_token_files(docs, target, tokenizer_file(BYTE), end_id=2)
    got = {r.doc_id: r for r in op10_token_files.read_token_files(spark, target).collect()}
    ids = bpe.tokenizer(tokenizer_file(BYTE)).encode([text.encode()]).ids.astype("<u4").tolist() + [2]
    assert got[2].n_tokens == len(ids) and got[2].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and got[3].start == got[2].start + len(ids)


def test_batches_are_worked_on_in_slices(spark):
    import pyarrow as pa

    from ledgerspark.llm.common import SLICE, map_batches

    def rows(batch):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([batch.num_rows] * batch.num_rows, pa.int64())], names=["id", "n"])

    got = map_batches(spark.range(0, 5_000, 1, 1), rows, "id long, n long").collect()
    assert sorted(r.id for r in got) == list(range(5_000)) and max(r.n for r in got) <= SLICE

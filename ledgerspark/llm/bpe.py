"""Byte-level BPE encoding and decoding of whole text columns.

The merge loop is a segment tree over adjacent pair ranks.  A leaf holds
``rank * width + position`` of the pair that starts there, so the root is the
leftmost pair of the lowest rank; a merge rewrites at most three leaves and
their paths, until the root holds no mergeable pair.  Many pieces of one width
are merged at once as numpy columns; very long pieces use the same tree over
plain lists.

Texts are split into pieces with array operations over the code points of a
block of documents; equal pieces of a block are encoded once, and a bounded
per-process cache keeps the encodings of pieces seen before.  Pieces are told
apart exactly: the key of one of up to seven bytes holds them all, a longer
one's is a hash, and behind equal hashes bytes are compared; pieces that only
share a hash are encoded by themselves.

Defined cases: a null text counts as the empty text, which has no ids; special
strings inside a text become their special id, as the tokenizer file says.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

#: A block of texts handled at once holds about so many bytes (or one text).
BLOCK_BYTES = 1 << 20
#: Pieces of more symbols than this are merged one by one.
WIDE = 512
#: Cached pieces per process; beyond it the cache starts anew.
CACHE_PIECES = 500_000
#: Keys of long pieces start here.
LONG = np.uint64(1 << 63)

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# The code points of Unicode's White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The clitics that the split patterns of both tokenizers name.
CLITICS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every (start, len), one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total, dtype=np.int64)


def sort_order(h: np.ndarray) -> np.ndarray:
    """Order that sorts hashes: their high bits are sorted with the positions packed below, which sorts plain
    integers; should high bits alone not settle it, an argsort does."""
    low = np.uint64(max(1, int(len(h) - 1).bit_length()))
    packed = np.sort((h >> low << low) | np.arange(len(h), dtype=np.uint64))
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    ranked = h[order]
    return order if (ranked[1:] >= ranked[:-1]).all() else np.argsort(h)


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 8
    if first < len(texts):
        yield first, len(texts)


class PairTable:
    """Open-addressing table from a pair of symbol ids to its merge rank."""

    def __init__(self, pairs: np.ndarray):
        self.bits = max(8, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, -1, np.int32)
        self.plain: dict[int, int] = {}
        packed = (pairs[:, 0].astype(np.int64) << 20) | pairs[:, 1]
        slots = self._slot(packed).tolist()
        mask = (1 << self.bits) - 1
        for rank, (key, slot) in enumerate(zip(packed.tolist(), slots, strict=True)):
            if key in self.plain:
                continue
            self.plain[key] = rank
            while self.keys[slot] != -1:
                slot = (slot + 1) & mask
            self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none (or a side is -1)."""
        keys = (left.astype(np.int64) << 20) | right.astype(np.int64)
        slots, mask = self._slot(keys), (1 << self.bits) - 1
        out, found = np.full(len(keys), -1, np.int32), self.keys[slots]
        hit = found == keys
        out[hit] = self.ranks[slots[hit]]
        left_over = np.flatnonzero(~hit & (found != -1))
        while len(left_over):
            slots[left_over] = (slots[left_over] + 1) & mask
            found = self.keys[slots[left_over]]
            hit = found == keys[left_over]
            out[left_over[hit]] = self.ranks[slots[left_over[hit]]]
            left_over = left_over[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = -1
        return out


def merge_columns(symbols: np.ndarray, pairs: PairTable, merged: np.ndarray) -> np.ndarray:
    """Merge all pieces of one width at once.

    ``symbols`` is (width, pieces), padded with -1; the result has the merged
    ids at the positions where they start and -1 elsewhere.
    """
    width, count = symbols.shape
    none = np.int64(1) << 40
    tree = np.full((2 * width, count), none, np.int64)
    at = np.arange(width, dtype=np.int64)
    for i in range(width - 1):
        rank = pairs.rank(symbols[i], symbols[i + 1])
        tree[width + i] = np.where(rank >= 0, rank.astype(np.int64) * width + i, none)
    for node in range(width - 1, 0, -1):
        np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
    after = np.repeat((at + 1)[:, None], count, 1)
    before = np.repeat((at - 1)[:, None], count, 1)
    flat, sym, nxt, prv = tree.reshape(-1), symbols.reshape(-1), after.reshape(-1), before.reshape(-1)
    live = np.flatnonzero(tree[1] < none)
    while len(live):
        root = tree[1][live]
        pos, rank = root & (width - 1), root // width
        gone = nxt[pos * count + live]
        follow = nxt[gone * count + live]
        sym[pos * count + live] = merged[rank]
        sym[gone * count + live] = -1
        nxt[pos * count + live] = follow
        inner = np.flatnonzero(follow < width)
        prv[follow[inner] * count + live[inner]] = pos[inner]
        back = prv[pos * count + live]
        # the three leaves that change: the merged place, its left neighbour, the place that went
        flat[(width + gone) * count + live] = none
        right = np.where(follow < width, sym[np.minimum(follow, width - 1) * count + live], -1)
        rank = pairs.rank(merged[root // width], right)
        flat[(width + pos) * count + live] = np.where(rank >= 0, rank.astype(np.int64) * width + pos, none)
        has = np.flatnonzero(back >= 0)
        rank = pairs.rank(sym[back[has] * count + live[has]], merged[root[has] // width])
        flat[(width + back[has]) * count + live[has]] = np.where(rank >= 0, rank.astype(np.int64) * width + back[has], none)
        one, two, three = (width + pos) >> 1, (width + gone) >> 1, (width + np.maximum(back, 0)) >> 1
        while one[0]:
            for node in (one, two, three):
                below = 2 * node * count + live
                flat[node * count + live] = np.minimum(flat[below], flat[below + count])
            one, two, three = one >> 1, two >> 1, three >> 1
        live = live[tree[1][live] < none]
    return symbols


def merge_one(symbols: list[int], pairs: dict[int, int], merged: list[int]) -> list[int]:
    """The same tree over lists, for one piece of any length."""
    n = len(symbols)
    width = 1 << max(1, (n - 1).bit_length())
    none = 1 << 62
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = pairs.get((symbols[i] << 20) | symbols[i + 1])
        if rank is not None:
            tree[width + i] = rank * width + i
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(leaf: int, value: int) -> None:
        node = width + leaf
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a < b else b
            if tree[node] == best:
                return
            tree[node] = best
            node >>= 1

    while tree[1] != none:
        rank, pos = divmod(tree[1], width)
        gone = nxt[pos]
        symbols[pos], symbols[gone] = merged[rank], -1
        nxt[pos] = nxt[gone]
        if nxt[pos] < n:
            prv[nxt[pos]] = pos
        put(gone, none)
        found = pairs.get((symbols[pos] << 20) | symbols[nxt[pos]]) if nxt[pos] < n else None
        put(pos, none if found is None else found * width + pos)
        back = prv[pos]
        if back >= 0:
            found = pairs.get((symbols[back] << 20) | symbols[pos])
            put(back, none if found is None else found * width + back)
    return [s for s in symbols if s >= 0]


class Encoded:
    """Ids of a block of texts: ``ids`` one after the other, ``counts`` per text."""

    __slots__ = ("ids", "counts")

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids, counts


class Tokenizer:
    """A tokenizer file of the byte-level BPE kind, with or without word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        self.word_ends = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.vocab = vocab
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        parts = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = PairTable(np.array([(vocab[a], vocab[b]) for a, b in parts], np.int64))
        self.merged = np.array([vocab[a + b] for a, b in parts], np.int64)
        self.merged_list = self.merged.tolist()
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.word_ends] for c in chars], np.int64)
        byte_of = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            end = self.word_ends and token.endswith(self.word_ends)
            body = token[: -len(self.word_ends)] if end else token
            pieces[i] = bytes(byte_of[c] for c in body) + (b" " if end else b"")
        for token, i in self.special.items():
            pieces[i] = token
        self.size = size
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.known_len = np.empty(0, np.int64)
        self.known_start = np.empty(0, np.int64)
        # sizes of pieces, and where the bytes of long ones are
        self.known_size, self.known_at = np.empty(0, np.int64), np.empty(0, np.int64)
        self.known_bytes = np.zeros(8, np.uint8)
        self.odd = 0
        self.known_ids = np.empty(0, np.uint16 if self.size < 65536 else np.uint32)

    # -- pieces ---------------------------------------------------------

    def _normal(self, text: bytes) -> bytes:
        if not self.word_ends:
            return text
        if text.isascii():
            return text.lower()
        # lower-casing here is by character, so a final sigma is no special case
        return unicodedata.normalize("NFC", text.decode("utf-8")).replace("Σ", "σ").lower().encode("utf-8")

    def pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Split texts: (padded bytes, piece starts, piece lengths, pieces per text)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = b"".join(texts)
        buf = np.frombuffer(joined + bytes(16), np.uint8)
        if not joined:
            return buf, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        ends = np.cumsum(sizes)
        body = buf[: len(joined)]
        if joined.isascii():
            code, where = body, None
            kind = char_classes()[:128][code]
        else:
            where = np.flatnonzero((body & 0xC0) != 0x80)
            code = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), np.uint32)
            kind = char_classes()[code]
        n = len(code)
        opens = np.zeros(n + 1, bool)  # first character of a text, and the end
        bounds = np.concatenate([[0], ends])
        opens[bounds if where is None else np.concatenate([np.searchsorted(where, bounds[:-1]), [n]])] = True
        change = opens.copy()
        change[1:n] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        starts = change[:n].copy()
        clitic = (code == 39) & change[:n]
        if self.word_ends:
            starts |= kind == NUMBER
            keep = ~space
        else:
            keep = None
            blank = code == 32
            # the last space of a run goes to what follows, unless its text ends there
            lone = space & change[1:] & ~opens[1:]
            starts |= lone
            glued = np.zeros(n, bool)
            glued[1:] = (lone & blank)[:-1]
            starts &= ~(glued & ~opens[:n])
            clitic &= ~glued
        for i in np.flatnonzero(clitic).tolist() if clitic.any() else ():
            tail = code[i + 1 : i + 3].tolist()
            for c in CLITICS:
                if tail[: len(c)] == [*map(ord, c)] and not opens[i + 1 : i + 1 + len(c)].any():
                    starts[i + 1 : i + 1 + len(c)] = False
                    if i + 1 + len(c) < n:
                        starts[i + 1 + len(c)] = True
                    break
        first = np.flatnonzero(starts)
        stop = np.append(first[1:], n)
        if keep is not None:
            kept = keep[first]
            first, stop = first[kept], stop[kept]
        if where is not None:
            where = np.append(where, len(joined))
            first, stop = where[first], where[stop]
        per_text = np.diff(np.searchsorted(first, np.concatenate([[0], ends])))
        return buf, first, stop - first, per_text

    @staticmethod
    def hashes(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """64-bit hash of every piece, eight bytes at a time."""
        words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
        h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sel, step = None, 0
        masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
        while True:
            f, s = (first, size) if sel is None else (first[sel], size[sel])
            v = words[f + step] & masks[np.minimum(s - step, 8)]
            x = (h if sel is None else h[sel]) ^ v
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            if sel is None:
                h = x
            else:
                h[sel] = x
            step += 8
            sel = np.flatnonzero(size > step) if sel is None else sel[size[sel] > step]
            if not len(sel):
                return h

    @classmethod
    def keys(cls, buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A key of every piece, never 0: of up to seven bytes one to one, of longer pieces a hash with the highest bit set."""
        words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
        size = size.astype(np.uint64)
        short = size <= 7
        x = words[first] & ((np.uint64(1) << np.uint64(8) * np.minimum(size, np.uint64(7))) - np.uint64(1)) | size << np.uint64(56)
        # steps that can be undone in 63 bits spread the keys
        x = x * np.uint64(0xD6E8FEB86659FD93) & (LONG - np.uint64(1))
        x ^= x >> np.uint64(32)
        x = x * np.uint64(0x9E3779B97F4A7C15) & (LONG - np.uint64(1))
        long = np.flatnonzero(~short)
        if len(long):
            x[long] = cls.hashes(buf, first[long], size[long].astype(np.int64)) | LONG
        return x

    @staticmethod
    def same(buf: np.ndarray, first: np.ndarray, other: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes of pieces of equal sizes are equal, eight at a time."""
        a, b = (np.ndarray((len(x) - 7,), "<u8", x, 0, (1,)) for x in (buf, other))
        masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
        equal, todo, step = np.ones(len(first), bool), np.arange(len(first)), 0
        while len(todo):
            differs = (a[first[todo] + step] ^ b[at[todo] + step]) & masks[np.minimum(size[todo] - step, 8)] != 0
            equal[todo[differs]] = False
            step += 8
            todo = todo[~differs & (size[todo] > step)]
        return equal

    # -- encoding -------------------------------------------------------

    def encode_pieces(self, buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces through the segment tree: (ids one after the other, ids per piece)."""
        counts = np.zeros(len(first), np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        todo = np.arange(len(first))
        width = 2
        while len(todo) and width <= WIDE:
            fit = size[todo] <= width
            group, todo = todo[fit], todo[~fit]
            for part in np.array_split(group, -(-len(group) * width // 400_000)) if len(group) else ():
                at = np.arange(width)[:, None]
                inside = at < size[part]
                raw = buf[np.minimum(first[part] + at, len(buf) - 1)]
                symbols = np.where(inside, np.where(at == size[part] - 1, self.last[raw], self.inner[raw]), -1)
                symbols = merge_columns(symbols, self.pairs, self.merged).T
                alive = symbols >= 0
                counts[part] = alive.sum(1)
                out.append((part, symbols[alive]))
            width *= 2
        for i in todo.tolist():
            raw = buf[first[i] : first[i] + size[i]]
            symbols = self.inner[raw].tolist()
            symbols[-1] = int(self.last[raw[-1]])
            ids = merge_one(symbols, self.pairs.plain, self.merged_list)
            counts[i] = len(ids)
            out.append((np.array([i]), np.array(ids, np.int64)))
        begin = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), self.known_ids.dtype)
        for part, ids in out:
            flat[ragged(begin[part], counts[part])] = ids
        return flat, counts

    def distinct(self, buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the distinct pieces, ascending; a place where each occurs; the distinct piece of every piece.

        Pieces that share their key with another piece follow with the key 0, each by itself.
        """
        h = self.keys(buf, first, size)
        order = sort_order(h)
        ranked = h[order]
        head = np.ones(len(h), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(head) - 1
        uniq, where = ranked[head], order[head]
        long = np.flatnonzero(h >= LONG)
        stands = where[inverse[long]]
        equal = size[long] == size[stands]
        equal[equal] = self.same(buf, first[long[equal]], buf, first[stands[equal]], size[long[equal]])
        if not equal.all():
            odd = long[~equal]
            inverse[odd] = len(uniq) + np.arange(len(odd))
            uniq, where = np.append(uniq, np.zeros(len(odd), np.uint64)), np.append(where, odd)
        return uniq, where, inverse

    def cached(self, uniq: np.ndarray, buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start in ``known_ids`` and number of ids of distinct pieces, after encoding those that the cache lacks."""
        if len(self.known) + self.odd + len(uniq) > CACHE_PIECES:
            self._forget()
        slot = np.searchsorted(self.known, uniq)
        hit = slot < len(self.known)
        hit[hit] = self.known[slot[hit]] == uniq[hit]
        new = ~hit & (uniq > 0)
        # behind the key of a long piece another one may be known
        long = np.flatnonzero(hit & (uniq >= LONG))
        at = slot[long]
        equal = self.known_size[at] == size[long]
        equal[equal] = self.same(buf, first[long[equal]], self.known_bytes, self.known_at[at[equal]], size[long[equal]])
        hit[long[~equal]] = False
        start, lens = np.empty(len(uniq), np.int64), np.empty(len(uniq), np.int64)
        start[hit], lens[hit] = self.known_start[slot[hit]], self.known_len[slot[hit]]
        missing = ~hit
        if missing.any():
            ids, counts = self.encode_pieces(buf, first[missing], size[missing])
            start[missing], lens[missing] = len(self.known_ids) + np.cumsum(counts) - counts, counts
            self.known_ids = np.concatenate([self.known_ids, ids])
            place = slot[new]
            kept = np.where(uniq[new] >= LONG, size[new], 0)
            self.known_start = np.insert(self.known_start, place, start[new])
            self.known_len = np.insert(self.known_len, place, lens[new])
            self.known_at = np.insert(self.known_at, place, len(self.known_bytes) - 8 + np.cumsum(kept) - kept)
            self.known_size = np.insert(self.known_size, place, size[new])
            self.known = np.insert(self.known, place, uniq[new])
            self.known_bytes = np.concatenate([self.known_bytes[:-8], buf[ragged(first[new], kept)], np.zeros(8, np.uint8)])
            self.odd += int(missing.sum() - new.sum())
        return start, lens

    def _segments(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray | None, np.ndarray | None]:
        """Texts, or where special strings occur the segments between them with their text's number."""
        if self.split_special is None or not any(s in t for t in texts for s in self.special):
            return [self._normal(t) for t in texts], None, None
        parts, owner, special = [], [], []
        for i, t in enumerate(texts):
            for k, part in enumerate(self.split_special.split(t)):
                parts.append(b"" if k % 2 else self._normal(part))
                owner.append(i)
                special.append(self.special[part] if k % 2 else -1)
        return parts, np.array(owner, np.int64), np.array(special, np.int64)

    def _run(self, texts: list[bytes], with_ids: bool) -> Encoded:
        parts, owner, special = self._segments(texts)
        buf, first, size, per_text = self.pieces(parts)
        if len(first):
            uniq, where, inverse = self.distinct(buf, first, size)
            start, found = self.cached(uniq, buf, first[where], size[where])
            lens = found[inverse]
            ids = self.known_ids[ragged(start[inverse], lens)] if with_ids else None
        else:
            lens, ids = np.empty(0, np.int64), np.empty(0, self.known_ids.dtype)
        total = np.concatenate([[0], np.cumsum(lens)])
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        counts = np.diff(total[bounds])
        if owner is not None:
            marks = np.flatnonzero(special >= 0)
            if with_ids:
                ids = np.insert(ids, (np.cumsum(counts) - counts)[marks], special[marks].astype(ids.dtype))
            counts[marks] = 1
            counts = np.bincount(owner, counts, len(texts)).astype(np.int64)
        return Encoded(ids, counts)

    def encode(self, texts: list[bytes]) -> Encoded:
        """Ids of every text (UTF-8)."""
        return self._run(texts, True)

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Number of ids of every text (UTF-8)."""
        return self._run(texts, False).counts

    # -- decoding -------------------------------------------------------

    def decode_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that ids stand for, one text after the other, and bytes per text."""
        size = self.piece_len[ids]
        flat = self.piece_bytes[ragged(self.piece_start[ids], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        return flat, np.diff(total[np.concatenate([[0], np.cumsum(counts)])])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        flat, _ = self.decode_bytes(np.asarray(ids, np.int64), np.array([len(ids)]))
        return flat.tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer of a file per process."""
    return Tokenizer(path)


@functools.lru_cache(maxsize=2)
def decimal_table(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of "0,", "1,", ... with their starts and lengths."""
    words = [b"%d," % i for i in range(size)]
    lens = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens, lens

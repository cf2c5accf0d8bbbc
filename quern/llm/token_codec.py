"""Token-ID output: an adaptive context-mixing range coder in independent blocks.

A file record holds whole documents in ascending id order: their ids and lengths,
the record's phrases and tables and blocks of ``BLOCK`` symbols.  A symbol is a
token id or a phrase: the ids of what stands between two spaces, where it occurs
``PHRASE_MIN`` times or more in the record.  Each block starts from the record's
tables and carries a CRC-32 of its symbols, so blocks are decoded and checked on
their own.  The phrases' ids are the first symbols of a record.

The record's tables are the counts of symbols (order 0), of successors of a
symbol (order 1, pairs seen ``PAIR_MIN`` times or more) and a likely successor for
each hashed pair of symbols (order 2).  Within a block, the order-2 successors and
their trust adapt, and so do the odds of "order 2 is right" (by trust and by how
well order 1 knows the last symbol, mixed).  The odds pick the order, the order's
counts pick the symbol, and both narrow one 64-bit range once a symbol.  All blocks
of a record advance in step as NumPy lanes: one array operation codes one symbol
of every block.

Null and empty texts have only the end id.  Rows that share an id stay separate
rows, ordered by text; a null id sorts first and stays null.  Ids that are not
integers are refused, since the files are in numeric order.  Other columns are
ignored; an empty table gives no rows.  Token ids must be below 2**32 and a
record may hold at most ``MOST_IDS`` different ones.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import shared_folder

MAGIC = b"TIDCM3"
BLOCK = 1024
SLOTS = 128  # order-2 contexts of a block, by hash
RECORD_IDS = 4_000_000  # a record closes with the document that reaches this
PAIR_MIN = 3
PHRASE_MIN = 4
MOST_PHRASES = 1 << 17
CHUNK = 16_000_000  # bytes of text that are split together
MOST_IDS = 1 << 19
ODDS, RATE = 12, 5  # bits of the odds between orders; how slowly the odds adapt
_LOW32, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)


# ------------------------------------------------------------------ tables of a record

def _scaled(counts: np.ndarray, group: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, sum of those before it in its group); each group g of the sorted ``group`` sums to 2**bits[g]."""
    if not len(counts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(at, len(counts)))
    room = np.int64(1) << bits[group[at]]
    total = np.add.reduceat(counts, at)
    freq = counts * np.repeat(room - size, size) // np.repeat(total, size) + 1
    spare = room - np.add.reduceat(freq, at)
    most = np.lexsort((-freq, group))[at]  # the greatest of each group takes what rounding left
    freq[most] += spare
    before = np.cumsum(freq) - freq
    return freq, before - np.repeat(before[at], size)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers, byte plane by byte plane, compressed."""
    planes = b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)
    return zlib.compress(planes, 6)


def _unpack(data: bytes, *sizes: int) -> list[np.ndarray]:
    planes, out, at = np.frombuffer(zlib.decompress(data), np.uint8), [], 0
    for n in sizes:
        out.append(np.ascontiguousarray(planes[at : at + 4 * n].reshape(4, n).T).reshape(-1).view("<u4").astype(np.int64))
        at += 4 * n
    return out


@dataclass
class Tables:
    """Ids are known by their rank among the record's ids."""

    ids: np.ndarray  # ascending
    counts: np.ndarray
    first: np.ndarray  # order 1: the id before,
    second: np.ndarray  # its successor
    pairs: np.ndarray  # and how often
    slots: np.ndarray  # order 2: rank * 4 + trust by slot

    def __post_init__(self) -> None:
        n = len(self.ids)
        self.bits = min(max(16, int(n).bit_length() + 2), 32 - ODDS)
        self.freq0, self.cum0 = _scaled(self.counts, np.zeros(n, np.int8), np.array([self.bits]))
        # An id with few successors takes few bits, so that the places of all fit a small look-up table.
        own = np.bincount(self.first, minlength=n)
        self.bits1 = np.where(own > 0, np.minimum(np.frexp(own)[1] + 3, self.bits), 0)
        self.freq1, self.cum1 = _scaled(self.pairs, self.first, self.bits1)
        self.key1 = self.first << 32 | self.second
        known = np.zeros(n, np.int64)
        np.add.at(known, self.first, self.pairs)
        share = known / np.maximum(self.counts, 1)
        self.level = np.digitize(share, (0.5, 0.8, 0.95)).astype(np.int64)  # how well order 1 knows an id
        of_level = [self.level == k for k in range(4)]
        #: Shares (of 65536) of "order 1 knows the successor" by level.
        self.knows = np.array([min(62000, int(known[x].sum()) * 65536 // max(1, int(self.counts[x].sum()))) for x in of_level], np.int64)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple["Tables", np.ndarray, np.ndarray]:
        """The tables of a record, its ids as ranks, and the place of each id and the one before in order 1, -1 if it isn't there."""
        seen = np.bincount(ids) if int(ids.max()) < 1 << 22 else None
        if seen is None:
            own, ranks, counts = np.unique(ids, return_inverse=True, return_counts=True)
        else:
            own = np.flatnonzero(seen)
            counts, place = seen[own], np.zeros(len(seen), np.int64)
            place[own] = np.arange(len(own))
            ranks = place[ids]
        if len(own) > MOST_IDS:
            raise ValueError(f"more than {MOST_IDS} different ids in a record")
        pair = ranks[:-1] * len(own) + ranks[1:]
        width = len(ranks).bit_length()
        if (len(own) ** 2).bit_length() + width < 64:  # sorting is faster than its order
            pair = np.sort(pair << width | np.arange(len(pair)))
            order, pair = pair & (1 << width) - 1, pair >> width
        else:
            order = np.argsort(pair)
            pair = pair[order]
        at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
        n = np.diff(at, append=len(pair))
        often = n >= PAIR_MIN
        entry = np.full(len(ranks), -1, np.int32)
        entry[order + 1] = np.repeat(np.where(often, np.cumsum(often) - 1, -1), n)
        pair, n = pair[at[often]], np.minimum(n[often], 0xFFFF)
        slots = np.zeros(SLOTS, np.int64)
        if len(ranks) > 2:
            key = _slot(ranks[:-2], ranks[1:-1]) * len(own) + ranks[2:]
            key, c = np.unique(key, return_counts=True)
            slot = key // len(own)
            at = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            slots[slot[at]] = np.maximum.reduceat(c * len(own) + key % len(own), at) % len(own) << 2  # the most frequent
        return cls(own, counts, pair // len(own), pair % len(own), n, slots), ranks, entry

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums before and frequencies, of 2**bits: ids of order 0, then the pairs of order 1."""
        up = self.bits - self.bits1[self.first]
        return tuple(np.concatenate([x, y << up]).astype(np.uint64) for x, y in ((self.cum0, self.cum1), (self.freq0, self.freq1)))

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index into ``ranges`` by place: order 0, then order 1 of each id; where those of an id begin, and how far its places shift."""
        n, room = len(self.ids), np.where(self.bits1 > 0, np.int64(1) << self.bits1, 0)
        found = np.concatenate([np.repeat(np.arange(n), self.freq0), np.repeat(n + np.arange(len(self.pairs)), self.freq1), [0]])
        return found, (1 << self.bits) + np.cumsum(room) - room, self.bits - self.bits1

    def dump(self) -> bytes:
        gap = np.diff(self.ids, prepend=0)
        flat = self.first * len(self.ids) + self.second
        step = np.diff(flat, prepend=0)
        body = _pack(gap, self.counts, step & 0xFFFFFFFF, step >> 32, self.pairs, self.slots)
        return struct.pack("<III", len(self.ids), len(self.pairs), len(body)) + body

    @classmethod
    def load(cls, data: bytes, at: int) -> tuple["Tables", int]:
        n, m, size = struct.unpack_from("<III", data, at)
        at += 12
        gap, counts, low, high, pairs, slots = _unpack(data[at : at + size], n, n, m, m, m, SLOTS)
        flat = np.cumsum(low | high << 32)
        return cls(np.cumsum(gap), counts, flat // max(n, 1), flat % max(n, 1), pairs, slots), at + size


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 0x9E3779B1 + b * 0x85EBCA77 >> 9) & (SLOTS - 1)


# ------------------------------------------------------------------ model of the lanes

class Mixer:
    """What adapts within a block: order-2 successors with their trust, and the odds that order 2 is right."""

    def __init__(self, lanes: int, tables: Tables):
        self.base = np.arange(lanes, dtype=np.int64) * SLOTS
        self.guess = np.tile(tables.slots.astype(np.int32), lanes)
        self.row = np.arange(lanes, dtype=np.int64) * 4
        # Odds (of 65536), by order 2's trust and by order 1's level.  They stay within 31 and 65504.
        self.by_trust = np.tile(np.array([4000, 20000, 36000, 52000], np.int64), lanes)
        self.by_level = np.tile(np.array([8000, 8000, 8000, 8000], np.int64), lanes)

    def predict(self, n: int, slot: np.ndarray, level: np.ndarray, knows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order-2 symbol of the first n lanes, and the shares of 2**ODDS of "it is right" and of "order 1 knows"."""
        self.at = self.base[:n] + slot
        self.entry = self.guess.take(self.at)
        self.trust = self.entry & 3
        self.t = self.row[:n] + self.trust
        self.l = self.row[:n] + level
        self.p_t, self.p_l = self.by_trust.take(self.t), self.by_level.take(self.l)
        q2 = (3 * self.p_t + self.p_l) >> 18 - ODDS
        q1 = np.maximum((((1 << ODDS) - 1 - q2) * knows) >> 16, 1)
        return self.entry >> 2, q2, q1

    def learn(self, ranks: np.ndarray, right: np.ndarray) -> None:
        """``right``: the lanes that order 2 got right."""
        new = np.where(self.trust > 0, self.entry - 1, ranks << 2)
        new[right] = self.entry[right] + (self.trust[right] < 3)
        self.guess[self.at] = new
        for odds, at, p in ((self.by_trust, self.t, self.p_t), (self.by_level, self.l, self.p_l)):
            p = p - (p >> RATE)
            p[right] += (65536 >> RATE) - 1
            odds[at] = p


def encode_blocks(ids: np.ndarray) -> tuple[Tables | None, list[bytes], list[int]]:
    """The record's tables, and payload and CRC-32 of each block of ``ids``."""
    if not len(ids):
        return None, [], []
    tables, ranks, entry = Tables.of(ids)
    lanes = -(-len(ids) // BLOCK)
    last = len(ids) - (lanes - 1) * BLOCK
    u = np.uint64

    def table(values: np.ndarray, kind) -> np.ndarray:
        out = np.zeros(lanes * BLOCK, kind)
        out[: len(values)] = values
        return np.ascontiguousarray(out.reshape(lanes, BLOCK).T)

    start = np.arange(0, len(ids), BLOCK)
    a, b = np.concatenate(([0], ranks[:-1])), np.concatenate(([0, 0], ranks[:-2]))[: len(ranks)]
    a[start], b[start] = 0, 0
    b[start[start + 1 < len(ids)] + 1] = 0
    # A block begins after rank 0, whatever the block before ends with.
    own = len(tables.ids)
    entry[start] = -1
    if len(tables.key1):
        e = np.minimum(np.searchsorted(tables.key1, ranks[start]), len(tables.key1) - 1)
        entry[start] = np.where(tables.key1[e] == ranks[start], e, -1)
    cum, freq = tables.ranges()
    x, place = table(ranks, np.int32), table(np.where(entry < 0, ranks, own + entry), np.int32)
    slot, level = table(_slot(b, a), np.int16), table(tables.level.astype(np.int8)[a], np.int8)
    del entry, a, b, ranks

    model, bits = Mixer(lanes, tables), u(tables.bits)
    low, rng = np.zeros(lanes, u), np.full(lanes, (1 << 64) - 1, u)
    width = BLOCK + 2
    out = np.zeros(lanes * width, u)  # 32-bit words; a carry may lift one above that
    pos = np.arange(lanes) * width
    for t in range(min(BLOCK, len(ids))):
        n = lanes if t < last else lanes - 1
        guess, q2, q1 = model.predict(n, slot[t, :n], level[t, :n], tables.knows.take(level[t, :n]))
        at, q = place[t, :n], q2 + q1
        k = at >= own
        right = np.flatnonzero(guess == x[t, :n])
        freq_a = np.where(k, q1, (1 << ODDS) - q)
        freq_a[right] = q2[right]
        r = rng[:n] >> u(ODDS)
        r_a = r * freq_a.view(u)
        r_b = r_a >> bits
        add = r * np.where(k, q2, q).view(u) + r_b * cum.take(at)
        add[right] = 0
        was = low[:n]
        now = was + add
        r = r_b * freq.take(at)
        r[right] = r_a[right]
        over = np.flatnonzero(now < was)
        if len(over):
            out[pos[over] - 1] += u(1)
        model.learn(x[t, :n], right)
        # A lane that isn't due writes a word that it writes over later.
        due = r <= _LOW32
        out[pos[:n]] = now >> _32
        pos[:n] += due
        shift = due.astype(u) << u(5)
        np.left_shift(now, shift, out=low[:n])
        np.left_shift(r, shift, out=rng[:n])
    # One more word names a number within the last range; the reader goes on with zeros.
    top = low + _LOW32
    over = np.flatnonzero(top < low)
    out[pos[over] - 1] += u(1)
    out[pos] = top >> _32
    out, pos = out.reshape(lanes, width), pos - np.arange(lanes) * width + 1
    out[np.arange(width) >= pos[:, None]] = 0
    while len(lift := np.flatnonzero((out > _LOW32).any(1))):
        lane, at = np.nonzero(out[lift] > _LOW32)
        out[lift[lane], at] -= u(1 << 32)
        out[lift[lane], at - 1] += u(1)
    words = out.astype("<u4")
    crcs = [zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)]
    return tables, [words[i, :n].tobytes() for i, n in enumerate(pos.tolist())], crcs


def decode_blocks(tables: Tables | None, payloads: list[bytes], crcs: list[int], total: int) -> np.ndarray:
    """The ids; raises ValueError where a block's checksum fails."""
    if not total or tables is None:
        return np.empty(0, np.uint32)
    lanes, u = len(payloads), np.uint64
    lens = np.array([len(p) // 4 for p in payloads], np.int64)
    # Two words of zeros follow each payload, and a reader goes no further.
    stops = np.cumsum(lens + 2)
    data = np.frombuffer(b"".join(p + bytes(8) for p in payloads), "<u4").astype(u)
    at, end = stops - lens - 2, stops - 1
    code = data[at] << _32 | data[at + 1]
    at = at + 2
    rng = np.full(lanes, (1 << 64) - 1, u)
    model, bits = Mixer(lanes, tables), u(tables.bits)
    whole = u((1 << tables.bits) - 1)
    found, begins, shifts = tables.places()
    cum, freq = tables.ranges()
    symbol = np.concatenate([np.arange(len(tables.ids)), tables.second])
    last = total - (lanes - 1) * BLOCK
    table = np.zeros((BLOCK, lanes), np.int32)
    a, b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for t in range(min(BLOCK, total)):
        n = lanes if t < last else lanes - 1
        before = a[:n]
        level = tables.level.take(before)
        guess, q2, q1 = model.predict(n, _slot(b[:n], before), level, tables.knows.take(level))
        r, c = rng[:n] >> u(ODDS), code[:n]
        q = q2 + q1
        r_2, r_1 = r * q2.view(u), r * q.view(u)
        k = c < r_1
        right = np.flatnonzero(c < r_2)
        r_b = r * np.where(k, q1, (1 << ODDS) - q).view(u) >> bits
        rest = c - np.where(k, r_2, r_1)
        place = np.minimum(rest // r_b, whole).view(np.int64)  # of no use where order 2 is right
        e = found.take(np.where(k, begins.take(before) + (place >> shifts.take(before)), place))
        x = symbol.take(e)
        rest -= r_b * cum.take(e)
        r_b *= freq.take(e)
        rest[right], r_b[right], x[right] = c[right], r_2[right], guess[right]
        model.learn(x, right)
        due = r_b <= _LOW32
        shift = due.astype(u) << u(5)
        fresh = data.take(np.minimum(at[:n], end[:n]))
        np.bitwise_or(rest << shift, np.where(due, fresh, u(0)), out=code[:n])
        np.left_shift(r_b, shift, out=rng[:n])
        at[:n] += due
        table[t, :n] = x
        b[:n], a[:n] = before, x
    ids = tables.ids[table.T.reshape(-1)[:total]].astype(np.uint32)
    for i, crc in enumerate(crcs):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i}: its checksum does not match")
    return ids


# ------------------------------------------------------------------ phrases

def _runs(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + len], one after the other."""
    ends = np.cumsum(lens)
    at = np.repeat(starts - (ends - lens), lens)
    at += np.arange(len(at))
    return flat.take(at)


@dataclass
class Phrases:
    """Symbol ``base + i`` stands for the i-th run of ids; symbols below ``base`` are ids."""

    base: int
    lens: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, parts: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> tuple["Phrases", np.ndarray]:
        """The phrases of a record and its symbols; ``parts`` are numbers of the runs that ``flat`` and ``lens`` hold."""
        starts = np.cumsum(lens) - lens
        seen = np.bincount(parts, minlength=len(lens))
        own = np.flatnonzero((seen >= PHRASE_MIN) & (lens > 1))
        if len(own) > MOST_PHRASES:
            own = np.sort(own[np.argsort(-seen[own], kind="stable")[:MOST_PHRASES]])
        base = int(flat.max()) + 1 if len(flat) else 0
        out = cls(base, lens[own], _runs(flat, starts[own], lens[own]))
        size = lens.copy()
        size[own], starts[own] = 1, len(flat) + np.arange(len(own))
        symbols = np.concatenate([flat, np.arange(base, base + len(own))])
        return out, _runs(symbols, starts[parts], size[parts])

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.lens):
            return symbols
        at = symbols.astype(np.int64) - self.base
        own = at >= 0
        starts, lens = np.arange(len(at)), np.ones(len(at), np.int64)
        at = at[own]
        starts[own], lens[own] = len(starts) + (np.cumsum(self.lens) - self.lens)[at], self.lens[at]
        return _runs(np.concatenate([symbols, self.flat.astype(symbols.dtype)]), starts, lens)



# ------------------------------------------------------------------ records

def pack(doc_ids: list[int | None], lengths: list[int], symbols: np.ndarray, phrases: Phrases | None = None) -> bytes:
    phrases = phrases or Phrases(0, np.empty(0, np.int64), np.empty(0, np.int64))
    symbols = np.concatenate([phrases.flat, symbols])  # the phrases' ids are coded as the texts' symbols are
    tables, payloads, crcs = encode_blocks(symbols)
    sizes = _pack(phrases.lens)
    has = np.array([d is not None for d in doc_ids], np.uint8)
    index = zlib.compress(has.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes(), 1)
    head = struct.pack("<6sIQIIQII", MAGIC, len(doc_ids), len(symbols), len(payloads), len(index), phrases.base, len(phrases.lens), len(sizes))
    blocks = np.array([[len(p), c] for p, c in zip(payloads, crcs, strict=True)], "<u4").tobytes()
    return b"".join([head, index, sizes, tables.dump() if tables else b"", blocks, *payloads])


def unpack(record: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    magic, n, total, k, size, base, m, more = struct.unpack_from("<6sIQIIQII", record)
    if magic != MAGIC:
        raise ValueError("not a token record")
    at = struct.calcsize("<6sIQIIQII")
    index = zlib.decompress(record[at : at + size])
    has, docs, lens = index[:n], np.frombuffer(index, "<i8", n, n), np.frombuffer(index, "<u4", n, 9 * n)
    at += size
    (sizes,) = _unpack(record[at : at + more], m)
    at += more
    tables, at = Tables.load(record, at) if k else (None, at)
    blocks = np.frombuffer(record, "<u4", 2 * k, at).reshape(-1, 2)
    at += 8 * k
    stops = at + np.cumsum(blocks[:, 0].astype(np.int64))
    payloads = [record[j - i : j] for i, j in zip(blocks[:, 0].tolist(), stops.tolist(), strict=True)]
    symbols, own = decode_blocks(tables, payloads, blocks[:, 1].tolist(), total), int(sizes.sum())
    ids = Phrases(base, sizes, symbols[:own]).ids(symbols[own:])
    return [d if h else None for d, h in zip(docs.tolist(), has, strict=True)], lens.tolist(), ids


# ------------------------------------------------------------------ Spark

_TOKENIZER: dict = {}


def tokenizer(path: str):
    if path not in _TOKENIZER:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has given the cores out
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZER[path] = t
    return _TOKENIZER[path]


class Ids:
    """Ids of texts: the tokenizers library encodes each distinct part (what stands between spaces, with its space) once.

    A single space before anything but white space always starts a piece, and
    byte-level BPE never merges across pieces, so a text's ids are those of its
    parts.  Parts are numbers; ``flat`` and ``lens`` hold the ids of each.  The first
    part of a text, and a text whose parts are not encoded apart, has a number that
    no other text shares; number 0 is the end id, then come ``marks``.
    """

    MEMO = 800_000
    GROUP = 64  # parts given to the library as one text

    def __init__(self, path: str, end_id: int):
        import regex

        self.t = tokenizer(path)
        self.names, self.numbers = pa.array([], pa.string()), np.empty(0, np.int64)  # of parts without their space; -1: white space follows it
        self.flat, self.lens, self.seen = np.array([end_id], np.int64), np.array([1], np.int64), np.array([0], np.int64)
        self.most = self.MEMO
        self.memo: dict[str, bytes] = {}
        #: Fixed value: the pieces that byte-level BPE never merges across.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.special = [a.content for a in self.t.get_added_tokens_decoder().values()]
        tokens = self.t.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(tokens.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for x, i in tokens.items() if x.startswith("\u0120")]] = True
        marks = self.by_pieces([",", "."])
        self.marks = dict(zip(",.", self.add(marks, np.array([len(x) for x in marks])).tolist(), strict=True))
        self.plain = np.isin(np.arange(256), list((string.ascii_letters + string.digits).encode()))

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.memo))
        if len(self.memo) > self.MEMO // 4:
            self.memo.clear()
            new = list(pieces)
        for p, e in zip(new, self.t.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.memo[p] = array("I", e.ids).tobytes()

    def by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        cut = [None if any(s in t for s in self.special) else self.pieces(t) for t in texts]  # the tokenizer cuts special tokens out first
        self.learn({p for ps in cut if ps for p in ps})
        return [
            np.array(self.t.encode(t, add_special_tokens=False).ids, np.int64) if ps is None else np.frombuffer(b"".join(map(self.memo.__getitem__, ps)), "<u4")
            for t, ps in zip(texts, cut, strict=True)
        ]

    def add(self, flat: list[np.ndarray], lens: np.ndarray) -> np.ndarray:
        """The numbers of runs of ids that are added."""
        first = len(self.lens)
        self.flat, self.lens = np.concatenate([self.flat, *flat]), np.concatenate([self.lens, lens])
        self.seen = np.concatenate([self.seen, np.zeros(len(lens), np.int64)])
        return np.arange(first, len(self.lens))

    def learn_parts(self, new: pa.Array) -> np.ndarray:
        """Numbers for distinct parts that have none."""
        size = pc.binary_length(new).to_numpy().astype(np.int64)
        data = np.frombuffer(b"\0\0" + pc.binary_join(pa.ListArray.from_arrays([0, len(new)], new), "")[0].as_buffer().to_pybytes(), np.uint8)
        stops = np.cumsum(size) + 2
        # White space begins with one of these bytes, and so do some letters.
        bad = (size == 0) | np.isin(np.append(data, 0)[stops - size], [*range(33), 0xC2, 0xE1, 0xE2, 0xE3])
        for i in np.flatnonzero(bad & (size > 0)).tolist():
            bad[i] = new[i].as_py()[0].isspace()
        # A comma or full stop that ends a part is a piece of its own.
        marked = ~bad & (size > 1) & np.isin(data[stops - 1], list(b",.")) & self.plain[data[stops - 2]]
        rest, ends = np.flatnonzero(~bad & ~marked), np.flatnonzero(marked)
        comma = data[stops[ends] - 1] == ord(",")
        stems = pc.utf8_slice_codeunits(new.take(pa.array(ends)), 0, -1).dictionary_encode()
        of_stem = np.full(len(stems.dictionary), -2)
        found = pc.fill_null(pc.index_in(self.names, value_set=stems.dictionary), -1).to_numpy()
        of_stem[found[found >= 0]] = self.numbers[found >= 0]
        spaced = pa.concat_arrays([new.take(pa.array(rest)), stems.dictionary.filter(pa.array(of_stem == -2))]).dictionary_encode()
        place, spaced = spaced.indices.to_numpy(), spaced.dictionary
        stops = np.minimum(np.arange(0, len(spaced) + self.GROUP, self.GROUP), len(spaced)).astype(np.int32)
        groups = pa.ListArray.from_arrays(stops, spaced)
        found, size = array("I"), []
        for e in self.t.encode_batch_fast([" " + g for g in pc.binary_join(groups, " ").to_pylist()], add_special_tokens=False):
            found.extend(e.ids)
            size.append(len(found))
        ids = np.array(found, np.int64)
        at = np.flatnonzero(self.opens[ids])  # each part has its own space and no other
        stops, n = np.array([0, *size]), np.diff(stops)
        good = np.diff(np.searchsorted(at, stops)) == n
        if good.all():
            flat, lens = [ids], np.diff(at, append=len(ids))
        else:
            flat, lens = [], []
            for g, i, j, ok in zip(groups, stops.tolist(), stops[1:].tolist(), good.tolist(), strict=True):
                if ok:
                    flat.append(ids[i:j])
                    lens.append(np.diff(at[slice(*np.searchsorted(at, [i, j]))], append=j))
                else:
                    apart = self.by_pieces([" " + c for c in g.as_py()])
                    flat.extend(apart)
                    lens.append(np.array([len(x) for x in apart]))
            lens = np.concatenate(lens)
        first, number = self.add(flat, lens), np.full(len(new), -1)
        number[rest] = first[place[: len(rest)]]
        of_stem[of_stem == -2] = first[place[len(rest) :]]
        if len(ends):
            runs = np.stack([of_stem[stems.indices.to_numpy()], np.where(comma, self.marks[","], self.marks["."])], 1)
            lens, starts = self.lens[runs], (np.cumsum(self.lens) - self.lens)[runs]
            number[ends] = self.add([_runs(self.flat, starts.ravel(), lens.ravel())], lens.sum(1))
        more = np.unique(place[len(rest) :])
        more = more[more >= len(rest)]  # stems that aren't parts so far
        self.names = pa.concat_arrays([self.names, new, spaced.take(pa.array(more))])
        self.numbers = np.concatenate([self.numbers, number, first[more]])
        return number

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of all texts (each with the end id), and how many each text has."""
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        known = len(self.names)
        words = pa.concat_arrays([self.names, split.flatten()]).dictionary_encode()  # the names are distinct, so they come first
        number = self.numbers
        if len(words.dictionary) > known:
            number = np.concatenate([number, self.learn_parts(pa.concat_arrays([words.dictionary[known:]]))])
        number = number[words.indices.to_numpy()[known:]]
        n = pc.list_value_length(split).to_numpy().astype(np.int64)
        start = np.cumsum(n) - n
        number[start] = 0
        odd = np.zeros(len(n), bool)
        if len(n):
            odd = np.minimum.reduceat(number, start) < 0
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        firsts = pc.list_element(split, 0).to_pylist()
        for i in np.flatnonzero(odd).tolist():
            firsts[i] = texts[i].as_py()
        own = self.by_pieces(firsts)
        keep = np.repeat(~odd, n)
        keep[start] = True
        number[start] = self.add(own, np.array([len(x) for x in own], np.int64))
        number, n = number[keep], np.where(odd, 1, n)
        number = np.insert(number, np.cumsum(n), 0)
        self.seen += np.bincount(number, minlength=len(self.seen))
        return number, n + 1

    def tidy(self, held: list[np.ndarray]) -> list[np.ndarray]:
        """Forgets parts when there are too many, but not those of ``held`` nor the most frequent; ``held`` by their new numbers."""
        if len(self.lens) <= self.most:
            return held
        keep = np.zeros(len(self.lens), bool)
        keep[: 1 + len(self.marks)] = True
        for x in held:
            keep[x] = True
        often = np.flatnonzero(self.seen > 1)
        keep[often[np.argsort(-self.seen[often], kind="stable")[: self.MEMO // 2]]] = True
        place = np.where(keep, np.cumsum(keep) - 1, -1)
        starts = np.cumsum(self.lens) - self.lens
        stay = (self.numbers >= 0) & keep[self.numbers]
        self.names, self.numbers = self.names.filter(pa.array(stay)), place[self.numbers[stay]]
        self.flat, self.lens, self.seen = _runs(self.flat, starts[keep], self.lens[keep]), self.lens[keep], self.seen[keep] >> 1
        self.most = max(self.MEMO, len(self.lens) + self.MEMO // 2)
        return [place[x] for x in held]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        self.tidy([])
        parts, n = self.parts(pa.array(texts, pa.string()))
        lens = self.lens[parts]
        flat = _runs(self.flat, (np.cumsum(self.lens) - self.lens)[parts], lens).astype("<u4").tobytes()
        stops = (4 * np.cumsum(lens))[np.cumsum(n) - 1].tolist()
        return [flat[i:j] for i, j in zip([0, *stops], stops)]


_IDS: dict = {}


def ids_of(path: str, end_id: int) -> Ids:
    """Parts stay known to a Python worker from task to task."""
    if (path, end_id) not in _IDS:
        _IDS[path, end_id] = Ids(path, end_id)
    return _IDS[path, end_id]


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``CHUNK`` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        till = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
        yield batch.slice(at, till - at)
        at = till


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", record_ids: int = RECORD_IDS) -> None:
    """Write the ids of ``docs`` in ascending id order to ``path``.

    Rows are (part, base, n_ids, record): the part's number in id order, the ids
    of the part before the record, the record's ids, its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, base = TaskContext.get().partitionId(), 0
        enc = ids_of(tokenizer_path, end_id)
        docs_, lens, held, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            phrases, symbols = Phrases.of(np.concatenate(held), enc.flat, enc.lens)
            record = pack(docs_, lens, symbols, phrases)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([base], pa.int64()), pa.array([total], pa.int64()), pa.array([record], pa.binary())], ["part", "base", "n_ids", "record"])

        for b in batches:
            for cut in _chunks(b):
                held = enc.tidy(held)
                parts, n = enc.parts(cut.column(1))
                own, stops = cut.column(0).to_pylist(), np.cumsum(n)
                ends = np.cumsum(enc.lens[parts])[stops - 1]  # ids up to the end of each document
                at = 0
                while at < len(own):
                    done = int(ends[at - 1]) if at else 0
                    till = min(len(own), int(np.searchsorted(ends, done + record_ids - total)) + 1)
                    docs_ += own[at:till]
                    lens += np.diff(ends[at:till], prepend=done).tolist()
                    held.append(parts[stops[at] - n[at] : stops[till - 1]])
                    total += int(ends[till - 1]) - done
                    at = till
                    if total >= record_ids:
                        yield close()
                        base += total
                        docs_, lens, held, total = [], [], [], 0
        if docs_:
            yield close()

    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be an integer column")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part int, base long, n_ids long, record binary").write.mode("errorifexists").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, ids) of the files at ``path``; ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, record in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs, lens, ids = unpack(record.as_py())
                stops = np.cumsum(np.array(lens, np.int64))
                begins = stops - lens
                flat = ids.astype("<u4").tobytes()
                for at in range(0, len(docs), 1000):
                    k = slice(at, at + 1000)
                    own = [flat[4 * i : 4 * j] for i, j in zip(begins[k].tolist(), stops[k].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[k], pa.int64()), pa.array(start + begins[k], pa.int64()), pa.array(own, pa.binary())], ["doc_id", "start", "ids"])

    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row per written part
    ahead, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        ahead[r["part"]], at = at, at + r["n"]
    first = spark.createDataFrame(list(ahead.items()) or [(0, 0)], "part int, ahead long")
    return files.join(F.broadcast(first), "part").select((F.col("ahead") + F.col("base")).alias("start"), "record").mapInArrow(run, "doc_id long, start long, ids binary")


def token_folder(spark, name: str = "tokens") -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``."""
    return shared_folder(spark, name)


def summary(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of ``read_tokens``'s rows."""
    return tokens.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

"""Substring dedup by level-wise doubling: passages that an earlier document has are cut out.

A window is ``window`` consecutive words of one document.  A word goes if it lies
in a window whose word sequence also starts in a document with a smaller id.
Windows are judged on the texts as given.

Levels have the lengths ``window`` / 2**k down to ``first`` or just above it.

1. Shortest length, all documents.  Any window of twice the length is represented
   by the least hash of the shorter windows in it, so about one window in thirteen
   travels and still no repeat is lost.  A hash that only one row has dies.
2. Next length.  Only windows whose representative is alive are hashed; those of
   one document alone die again.  The loop ends where nothing is alive or the
   length is ``window``: a longer repeat is covered by its windows of this length.
3. At the last length all candidates travel, with document and position; windows
   that do not belong to the smallest document of their group mark their words.

Texts move through one shuffle a level, by a 64-bit key of the row.  Entries move
as packed arrays by hash bucket.  A task settles its own entries first: of a window
that it sees in several documents only those of the smallest one travel, so a
passage that a third of all documents share costs one entry a task.  Equality rests
on 96 bits of hash at the last length; earlier lengths only choose candidates.

Words are runs without ASCII white space, unchanged.  Null and empty texts have
none; texts shorter than a window lose nothing; very long texts are read whole.
Ids must be integers; a null id counts as larger than any other.  Rows that share
an id are one document, so they cut nothing from each other.  An empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

WINDOW = 50
FIRST = 20  # a level shorter than this is not begun
CHUNK_WORDS = 400_000  # words hashed at once
HELD = 1_500_000  # entries that a task holds before it settles and sends them
LAST_ID = np.iinfo(np.int64).max
_MUL = np.uint64(0x9E3779B97F4A7C15)
Batches = Iterator[pa.RecordBatch]


def levels(window: int, first: int) -> list[int]:
    """Lengths from the shortest to ``window``, each twice the one before (or twice less one)."""
    out = [window]
    while out[0] > 1 and -(-out[0] // 2) >= first:
        out.insert(0, -(-out[0] // 2))
    return out if len(out) > 1 else [-(-window // 2), window]


# ------------------------------------------------------------------ hashes

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position, by doubling; ``h`` holds the hashes of the words."""
    if len(h) < length:
        return np.empty(0, np.uint64)
    have, out = 1, h
    while have < length:
        step = min(have, length - have)  # the second half overlaps the first where the length is no power of two
        out = _mix(out[: len(out) - step] * _MUL + out[step:])
        have += step
    return out


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` neighbours from each position."""
    have, out = 1, x
    while have < width and len(out):
        step = min(have, width - have)
        out = np.minimum(out[: max(len(out) - step, 0)], out[step:])
        have += step
    return out


def chunks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], np.ndarray, np.ndarray]]:
    """Word hashes of rows of (nid, row, text, ...): two lanes, the rows' numbers, starts and ends in the lanes."""
    texts = b.column(2)
    held, ends, rows = [], [], []
    size = 0
    for i in range(b.num_rows):
        words = (texts[i].as_py() or b"").split()
        if words:
            held.append(b"".join(map(xxhash.xxh3_128_digest, words)))
            rows.append(i)
            size += len(words)
            ends.append(size)
        if rows and (size >= CHUNK_WORDS or i == b.num_rows - 1):
            lanes = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2)
            end = np.array(ends, np.int64)
            yield lanes[:, 0].copy(), lanes[:, 1].copy(), rows, np.append(0, end[:-1]), end
            held, ends, rows, size = [], [], [], 0
    if rows:
        lanes = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2)
        end = np.array(ends, np.int64)
        yield lanes[:, 0].copy(), lanes[:, 1].copy(), rows, np.append(0, end[:-1]), end


def inside(start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of ``length`` words lies in one document, and the number of that document."""
    n = np.maximum(end - start - length + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[doc], doc


def alive_at(h: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int, alive: list) -> np.ndarray:
    """Which of the windows of ``length`` words at ``at`` have a representative in ``alive`` of their document."""
    half = -(-length // 2)
    least = least_of(window_hashes(h, half), length - half + 1)[at]
    new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))))  # one representative serves several windows
    salt = _mix(np.arange(len(alive), dtype=np.uint64) * _MUL)
    known = np.concatenate([np.array(a, np.int64).view(np.uint64) ^ salt[i] for i, a in enumerate(alive) if a is not None] or [np.empty(0, np.uint64)])
    return np.repeat(np.isin(least[new] ^ salt[doc[new]], known), np.diff(np.append(new, len(least))))


# ------------------------------------------------------------------ entries by bucket

ENTRY = np.dtype([("hash", "<u8"), ("check", "<u4"), ("nid", "<i8"), ("row", "<i8"), ("pos", "<i4")])
SAMPLE = np.dtype([("hash", "<u8"), ("row", "<i8")])
MARK = np.dtype([("row", "<i8"), ("nid", "<i8"), ("value", "<i8")])  # what is found, on its way to its row


def packed(entries: np.ndarray, key: str, buckets: int, found: bool) -> pa.RecordBatch:
    """One row a bucket of ``key``; the fields lie one after the other, which compresses better."""
    home = (entries[key].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    entries, home = entries[order], home[order]
    at = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1], [True]))) if len(home) else np.zeros(1, np.int64)
    blobs = [b"".join(np.ascontiguousarray(entries[f][i:j]).tobytes() for f in entries.dtype.names) for i, j in zip(at[:-1], at[1:])]
    return pa.RecordBatch.from_arrays([pa.array(home[at[:-1]], pa.int64()), pa.array(blobs, pa.binary()), pa.array([found] * len(blobs), pa.bool_())], ["bucket", "packed", "found"])


def unpacked(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    out = np.empty(sum(len(b) for b in blobs) // kind.itemsize, kind)
    at = 0
    for b in blobs:
        n, skip = len(b) // kind.itemsize, 0
        for f in kind.names:
            out[f][at : at + n] = np.frombuffer(b, kind[f], n, skip)
            skip += n * kind[f].itemsize
        at += n
    return out


def shared(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples whose hash several rows have, and one sample of each hash."""
    order = np.lexsort((e["row"], e["hash"]))
    e = e[order]
    first = np.concatenate(([True], e["hash"][1:] != e["hash"][:-1])) if len(e) else np.empty(0, bool)
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(e)))
    low, high = (e["row"][at], e["row"][at + size - 1]) if len(e) else (e["row"], e["row"])
    return e[np.repeat(low != high, size)], e[first]


def later(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a window that a smaller document has, and the entries of the smallest document."""
    e = e[np.lexsort((e["nid"], e["check"], e["hash"]))]
    new = np.concatenate(([True], (e["hash"][1:] != e["hash"][:-1]) | (e["check"][1:] != e["check"][:-1]))) if len(e) else np.empty(0, bool)
    at = np.flatnonzero(new)
    least = np.repeat(e["nid"][at], np.diff(np.append(at, len(e))))
    return e[e["nid"] > least], e[e["nid"] == least]


def marks_of(e: np.ndarray) -> np.ndarray:
    out = np.empty(len(e), MARK)
    out["row"] = e["row"]
    out["nid"], out["value"] = (e["nid"], e["pos"]) if "pos" in e.dtype.names else (0, e["hash"].view(np.int64))
    return out


def by_row(m: np.ndarray) -> pa.RecordBatch:
    """(row, found): the values of each row as one array of structs (nid, values)."""
    m = m[np.lexsort((m["value"], m["nid"], m["row"]))]
    new_row = np.concatenate(([True], m["row"][1:] != m["row"][:-1])) if len(m) else np.empty(0, bool)
    at = np.flatnonzero(new_row | np.concatenate(([True], m["nid"][1:] != m["nid"][:-1]))[: len(m)])
    values = pa.ListArray.from_arrays(pa.array(np.append(at, len(m)), pa.int32()), pa.array(m["value"], pa.int64()))
    structs = pa.StructArray.from_arrays([pa.array(m["nid"][at], pa.int64()), values], ["nid", "values"])
    rows = np.flatnonzero(new_row[at])
    return pa.RecordBatch.from_arrays([pa.array(m["row"][at[rows]], pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(rows, len(at)), pa.int32()), structs)], ["row", "found"])


def buckets_of(batches: Batches, kind: np.dtype) -> Iterator[np.ndarray]:
    """The entries of rows sorted by bucket, several whole buckets at a time."""
    held, size, last = [], 0, None
    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if bucket != last and size >= HELD:
                yield unpacked(held, kind)
                held, size = [], 0
            last = bucket
            held.append(blob)
            size += len(blob) // kind.itemsize
    if held:
        yield unpacked(held, kind)


def meet(rows: DataFrame, make: Callable[[Batches], Iterator[np.ndarray]], kind: np.dtype, split) -> DataFrame:
    """(row, found): entries that ``make`` yields meet by bucket; ``split`` tells what is found and what must travel.

    Both the task that makes entries and the one that holds their bucket apply
    ``split``; what is found goes to the bucket of its row and becomes one row there.
    """
    buckets = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Batches) -> Batches:
        held, size = [], 0

        def flush() -> Batches:
            got, go = split(np.concatenate(held))
            yield packed(go, "hash", buckets, False)
            yield packed(marks_of(got), "row", buckets, True)

        for e in make(batches):
            held.append(e)
            size += len(e)
            if size >= HELD:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def settle(batches: Batches) -> Batches:
        passed: list[pa.RecordBatch] = []

        def own() -> Batches:
            for b in batches:
                passed.append(b.filter(b.column(2)))
                yield b.filter(pc.invert(b.column(2)))

        for e in buckets_of(own(), kind):
            yield packed(marks_of(split(e)[0]), "row", buckets, True)
            yield from passed
            passed.clear()
        yield from passed

    def gather(batches: Batches) -> Batches:
        for m in buckets_of(batches, MARK):
            yield by_row(m)

    blobs = "bucket long, packed binary, found boolean"
    settled = rows.mapInArrow(send, blobs).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(settle, blobs)
    return settled.select("bucket", "packed").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "row long, found array<struct<nid: long, values: array<long>>>")


# ------------------------------------------------------------------ the operator

def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(nid, row, text as bytes) of every row; equal rows have equal keys."""
    nid = F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST_ID)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(nid.alias("nid"), F.xxhash64(nid, text).alias("row"), text.cast("binary").alias("text"))


def samples(length: int, following: int, first: bool) -> Callable[[Batches], Iterator[np.ndarray]]:
    """Representatives, among windows of ``length`` words, of the windows of ``following`` words whose shorter ones are all alive."""
    width = following - length + 1

    def make(batches: Batches) -> Iterator[np.ndarray]:
        for b in batches:
            for h, _, rows, start, end in chunks(b):
                at, doc = inside(start, end, following)
                if not len(at):
                    continue
                least = least_of(window_hashes(h, length), width)[at]
                keep = np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))
                if not first:
                    own, own_doc = inside(start, end, length)
                    ok = np.zeros(len(h), np.int64)
                    ok[own] = alive_at(h, own, own_doc, length, [b.column(3)[i].as_py() for i in rows])
                    dead = np.append(0, np.cumsum(1 - ok))
                    whole = dead[at + width] == dead[at]
                    keep = whole & (keep | np.concatenate(([True], ~whole[:-1])))
                out = np.empty(keep.sum(), SAMPLE)
                out["hash"], out["row"] = least[keep], b.column(1).to_numpy()[rows][doc[keep]]
                yield out

    return make


def windows(length: int) -> Callable[[Batches], Iterator[np.ndarray]]:
    """All windows of ``length`` words whose representative is alive."""

    def make(batches: Batches) -> Iterator[np.ndarray]:
        for b in batches:
            for h, h2, rows, start, end in chunks(b):
                at, doc = inside(start, end, length)
                if not len(at):
                    continue
                ok = alive_at(h, at, doc, length, [b.column(3)[i].as_py() for i in rows])
                at, doc = at[ok], doc[ok]
                out = np.empty(len(at), ENTRY)
                out["hash"], out["check"] = window_hashes(h, length)[at], (window_hashes(h2, length)[at] >> np.uint64(32)).astype(np.uint32)
                out["nid"], out["row"], out["pos"] = b.column(0).to_numpy()[rows][doc], b.column(1).to_numpy()[rows][doc], at - start[doc]
                yield out

    return make


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """(row, found): for the key of each row that has any, where windows begin that a smaller document has, as structs (nid, values)."""
    rows = _keyed(docs, id_col, text_col)
    lengths = levels(window, first)
    seen = rows
    for i, length in enumerate(lengths[:-1]):
        found = meet(seen, samples(length, lengths[i + 1], i == 0), SAMPLE, shared)
        seen = rows.join(found.select("row", F.flatten(F.transform("found", lambda x: x["values"])).alias("alive")), "row").select("nid", "row", "text", "alive")
    return meet(seen, windows(window), ENTRY, later)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: ``kept`` holds the words that stay, joined by one space."""
    kind = docs.schema[id_col].dataType.simpleString()
    # Only the key meets the marks; text moves once.
    marks = repeated_windows(docs, id_col, text_col, window, first)
    rows = _keyed(docs, id_col, text_col).join(marks, "row", "left").select("nid", "text", "found")

    def run(batches: Batches) -> Batches:
        for b in batches:
            n_words, n_removed, kept, ids = [], [], [], []
            for nid, text, found in zip(*(b.column(i) for i in range(3)), strict=True):
                words, nid = text.as_py().split(), nid.as_py()
                starts = [p for f in found.as_py() or [] if f["nid"] == nid for p in f["values"]]
                if starts:
                    edge = np.zeros(len(words) + window + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, np.add(starts, window), -1)
                    stay = np.cumsum(edge)[: len(words)] <= 0
                    n_removed.append(len(words) - int(stay.sum()))
                    kept.append(b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s]))
                else:
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                n_words.append(len(words))
                ids.append(None if nid == LAST_ID else nid)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    out = rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))

"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

1. Words are counted over all documents (per-partition counters, one shuffle).
2. The ``lexicon_size`` most frequent words are encoded once and compiled into a
   minimal acyclic automaton: states with equal right languages are shared, and
   each edge carries the number of words that sort before it, so the sum along
   a path is the word's number and indexes its ids (the transducer's output).
3. The automaton is one flat file below the shared checkpoint folder, sent with
   ``SparkContext.addFile`` and memory-mapped by each Python worker.
4. Workers look up the distinct words of a batch one byte column at a time;
   words outside the lexicon are merged exactly by rank, short ones of like
   length together and long ones with a heap (n log n in the word's length).

The pieces of a text never span white space, so a text's ids are those of its
white-space chunks in order; normalisation works chunk by chunk as well.
Null text counts as empty and gives no ids; repeated ids are separate rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from .common import shared_folder

LEXICON_SIZE = 65_536
#: Chunks that a worker remembers before it starts anew; bounds its memory.
MEMO = 400_000
NO_RANK = 1 << 30
LONG_WORD = 48  # bytes; longer words are merged one by one
MERGE_CELLS = 400_000  # bytes of words that are merged together


# ------------------------------------------------------------------ tokenizer

def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, as byte-level BPE vocabularies use."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Exact encoder of normalised words, and splitter of texts and chunks, from a tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.tokens = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string())
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(f"{pattern}|\n")  # a line end stands between chunks
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.spaces = regex.compile(r"[^\S\x1c-\x1f]+")
        # Merges by (left id, right id); a pair's rank is its place in the file.
        key = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank, self.pair_made = key[order], order.astype(np.int32), made[order]
        self.made_by_rank = made
        #: Ids of the single bytes: inside a word, then at its end.
        self.byte_ids = np.array([self.vocab[c] for c in self.alphabet] + [self.vocab[c + self.suffix] for c in self.alphabet], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``NO_RANK`` where they do not merge."""
        if not len(self.pair_key):
            return np.full(np.shape(left), NO_RANK, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NO_RANK)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word of any length: a heap of pairs over a linked list, n log n."""
        n = len(word)
        at = np.frombuffer(word, np.uint8).astype(np.int64)
        at[-1] += 256
        ids = self.byte_ids[at].tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        ranks = self.rank(self.byte_ids[at[:-1]], self.byte_ids[at[1:]]).tolist() if n > 1 else []
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < NO_RANK]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else -1
            if j < 0 or ids[j] != right:  # one of the two has merged since
                continue
            ids[i], ids[j], after[i] = int(self.made_by_rank[r]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0:
                    pair = (ids[a], ids[b])
                    if pair not in known:
                        known[pair] = int(self.rank(np.array(pair[:1]), np.array(pair[1:]))[0])
                    if known[pair] < NO_RANK:
                        heapq.heappush(heap, (known[pair], a, *pair))
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word; short words of like length advance together."""
        out: list[bytes] = [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lens > LONG_WORD).tolist():
            out[i] = array("I", self.merge(words[i])).tobytes()
        short = np.flatnonzero((lens > 0) & (lens <= LONG_WORD))
        short = short[np.argsort(lens[short], kind="stable")]
        while len(short):
            width = int(lens[short[0]]) + 2
            n = min(int(np.searchsorted(lens[short], width, "right")), max(1, MERGE_CELLS // width))
            part, short = short[:n], short[n:]
            for i, x in zip(part.tolist(), self._merge_rows([words[k] for k in part], lens[part]), strict=True):
                out[i] = x
        return out

    def _merge_rows(self, words: list[bytes], lens: np.ndarray) -> list[bytes]:
        n, width = len(words), int(lens.max())
        byte = np.zeros((n, width), np.int64)
        inside = np.arange(width) < lens[:, None]
        byte[inside] = np.frombuffer(b"".join(words), np.uint8)
        rows = np.arange(n)
        byte[rows, lens - 1] += 256
        ids = np.where(inside, self.byte_ids[byte], -1)
        rank = np.full((n, width), NO_RANK, np.int32)
        if width > 1:
            rank[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        after = np.tile(np.arange(1, width + 1), (n, 1))
        after[rows, lens - 1] = -1
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        while len(rows):
            i = rank[rows].argmin(1)  # the leftmost of equal ranks
            best = rank[rows, i]
            go = best < NO_RANK
            rows, i, best = rows[go], i[go], best[go]
            j = after[rows, i]
            far = after[rows, j]
            ids[rows, i], ids[rows, j], rank[rows, j], after[rows, i] = self.made_by_rank[best], -1, NO_RANK, far
            left = before[rows, i]
            has = far >= 0
            r, a, b = rows[has], i[has], far[has]
            before[r, b] = a
            rank[rows, i] = NO_RANK
            rank[r, a] = self.rank(ids[r, a], ids[r, b])
            has = left >= 0
            r, a, b = rows[has], left[has], i[has]
            rank[r, a] = self.rank(ids[r, a], ids[r, b])
        kept = ids >= 0
        flat, stops = ids[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def normal(self, text: str) -> str:
        """NFC, then each character's own lower case (a final sigma is not special)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunk_words(self, chunks: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct normalised words of ``chunks``; the word number and the chunk number of each word in order."""
        found = self.words.findall(self.normal("\n".join(chunks)))
        place: dict[str, int] = {"\n": 0}
        number = np.fromiter((place.setdefault(w, len(place)) for w in found), np.int64, len(found))
        ends = number == 0
        return [w.encode() for w in list(place)[1:]], number[~ends] - 1, np.cumsum(ends)[~ends]

    def chunks(self, text: str) -> list[str]:
        """White-space chunks; special tokens stand alone."""
        if "<|" in text and self.split_special and self.split_special.search(text):
            return [c for part in self.split_special.split(text) for c in ([part] if part in self.special else self.chunks_plain(part))]
        return self.chunks_plain(text)

    def chunks_plain(self, text: str) -> list[str]:
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # str.split takes these as spaces
            return [c for c in self.spaces.split(text) if c]
        return text.split()


# ------------------------------------------------------------------ automaton

def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Flat bytes of the minimal automaton of sorted, distinct (word, ids)."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append(key)
        return at

    path: list[list] = [[False, []]]  # open states along the last word: [final, edges]
    last, ids, offsets = b"", [], [0]
    for word, out in entries:
        common = len(os.path.commonprefix([last, word]))
        while len(path) - 1 > common:
            done = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        last = word
        ids += out
        offsets.append(len(ids))
    while len(path) > 1:
        done = freeze(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = freeze(path[0])

    words = [0] * len(states)  # words below each state; children come before parents
    keys, to, skip = [], [], []
    for s, (final, edges) in enumerate(states):
        n = int(final)
        for byte, target in edges:
            keys.append(s << 8 | byte)
            to.append(target)
            skip.append(n)
            n += words[target]
        words[s] = n
    order = np.argsort(np.array(keys, np.uint64), kind="stable")
    arrays = [
        np.array(keys, np.uint64)[order].astype(np.uint64),
        np.array(to, np.uint64)[order],
        np.array(skip, np.uint64)[order],
        np.array([f for f, _ in states], np.uint64),
        np.array(offsets, np.uint64),
        np.array(ids, np.uint64),
    ]
    head = np.array([root, *map(len, arrays)], np.uint64)
    return b"".join(a.tobytes() for a in [head, *arrays])


class Lexicon:
    """The memory-mapped automaton."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.file = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        flat = np.frombuffer(self.file, np.uint64)
        self.root, sizes, at, parts = int(flat[0]), flat[1:7], 7, []
        for n in map(int, sizes):
            parts.append(flat[at : at + n])
            at += n
        self.keys, self.to, self.skip, self.final, self.offsets, self.ids = parts

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon lacks it."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.keys):
            return out
        lens = np.fromiter(map(len, words), np.int64, len(words))
        buf = np.frombuffer(b"".join(words), np.uint8)
        start = np.concatenate(([0], np.cumsum(lens)[:-1]))
        alive = np.flatnonzero(lens > 0)
        state = np.full(len(alive), self.root, np.uint64)
        number = np.zeros(len(alive), np.int64)
        depth = 0
        while len(alive):
            key = state << np.uint64(8) | buf[start[alive] + depth].astype(np.uint64)
            e = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[e] == key
            alive, e, number = alive[ok], e[ok], number[ok]
            state, number, depth = self.to[e], number + self.skip[e].astype(np.int64), depth + 1
            ended = lens[alive] == depth
            hit = ended & (self.final[state] == 1)
            out[alive[hit]] = number[hit]
            alive, state, number = alive[~ended], state[~ended], number[~ended]
        return out

    def outputs(self, numbers: np.ndarray) -> list[bytes]:
        """Ids of the numbered words, each as little-endian unsigned 32-bit integers."""
        if not len(numbers):
            return []
        begin, end = self.offsets[numbers].astype(np.int64), self.offsets[numbers + 1].astype(np.int64)
        lens = end - begin
        upto = np.cumsum(lens)
        flat = self.ids[np.repeat(begin - (upto - lens), lens) + np.arange(upto[-1])].astype("<u4").tobytes()
        stops = (4 * upto).tolist()
        return [flat[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]


class Encoder:
    """Texts to ids: the lexicon for the words it has, exact merging for the rest."""

    def __init__(self, tokenizer_path: str, lexicon_path: str | None):
        self.bpe = WordBpe(tokenizer_path)
        self.lexicon = Lexicon(lexicon_path) if lexicon_path else None
        self.memo: dict[str, bytes] = {c: array("I", [i]).tobytes() for c, i in self.bpe.special.items()}
        self.fixed = dict(self.memo)

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        number = self.lexicon.numbers(words) if self.lexicon else np.full(len(words), -1)
        known, rare = np.flatnonzero(number >= 0), np.flatnonzero(number < 0).tolist()
        if len(known):
            for i, x in zip(known.tolist(), self.lexicon.outputs(number[known]), strict=True):
                out[i] = x
        for i, x in zip(rare, self.bpe.merge_many([words[i] for i in rare]), strict=True):
            out[i] = x
        return out

    def learn(self, chunks: set[str]) -> None:
        if len(self.memo) > MEMO:
            self.memo = dict(self.fixed)
        new = list(chunks.difference(self.memo))
        words, number, owner = self.bpe.chunk_words(new)
        ids = self.word_ids(words)
        each = list(map(ids.__getitem__, number.tolist()))
        at = np.searchsorted(owner, np.arange(len(new) + 1)).tolist()
        self.memo.update((c, each[i] if j == i + 1 else b"".join(each[i:j])) for c, i, j in zip(new, at, at[1:]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.bpe.chunks(t or "") for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.memo.__getitem__, cs)) for cs in split]

    def decode(self, ids: list[bytes]) -> pa.Array:
        """Without a decoder in the file, tokens are joined by spaces."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        stops = np.cumsum([0, *(len(x) // 4 for x in ids)])
        lists = pa.LargeListArray.from_arrays(stops, self.bpe.tokens.cast(pa.large_string()).take(pa.array(flat)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


# ------------------------------------------------------------------ Spark

_WORKER: dict[tuple, Encoder] = {}


def _encoder(tokenizer_path: str, name: str | None) -> Encoder:
    key = (tokenizer_path, name)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(tokenizer_path, SparkFiles.get(name) if name else None)
    return _WORKER[key]


def count_words(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; a word is its UTF-8 bytes after normalisation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = WordBpe(tokenizer_path), Counter()

        def emit() -> Iterator[pa.RecordBatch]:
            for c in bpe.special:
                seen.pop(c, None)
            if seen:
                words, number, owner = bpe.chunk_words(list(seen))
                n = np.bincount(number, np.fromiter(seen.values(), np.float64, len(seen))[owner], len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n)], ["word", "n"])
            seen.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(bpe.chunks(t or ""))
                if len(seen) > 400_000:
                    yield from emit()
        yield from emit()

    part = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text", size: int = LEXICON_SIZE) -> str:
    """Compile the ``size`` most frequent words and ship the file; its name for ``SparkFiles.get``.

    A histogram of the counts by eighths of a power of two (some hundred rows)
    gives the levels that fit whole.  The next level is filled up by count and
    then by hash, again through a histogram, so the room is used but for a
    four-thousandth of that level and no task sends more than its share of the words.
    """
    spark = docs.sparkSession
    level, part = F.floor(F.log2("n") * 8), F.pmod(F.xxhash64("word"), F.lit(4096))
    counts = count_words(docs, tokenizer_path, text_col).persist()

    def fit(rows: list, room: int) -> tuple[list, object]:
        """The leading rows (key.., c) that fit, and the one after them."""
        taken = []
        for r in rows:
            if r["c"] > room:
                return taken, r
            taken.append(r)
            room -= r["c"]
        return taken, None

    try:
        levels = counts.groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()
        whole, edge = fit(sorted(levels, key=lambda r: -r["b"]), size)
        keep = level >= whole[-1]["b"] if whole else F.lit(False)
        if edge is not None:
            own = counts.where(level == edge["b"]).groupBy("n", part.alias("h")).agg(F.count(F.lit(1)).alias("c")).collect()
            more, _ = fit(sorted(own, key=lambda r: (-r["n"], r["h"])), size - sum(r["c"] for r in whole))
            if more:
                n, h = more[-1]["n"], more[-1]["h"]
                keep = keep | ((level == edge["b"]) & ((F.col("n") > n) | ((F.col("n") == n) & (part <= h))))
        top = sorted(bytes(r["word"]) for r in counts.where(keep).select("word").collect())  # bounded by size
    finally:
        counts.unpersist()
    bpe = WordBpe(tokenizer_path)
    flat = compile_lexicon(zip(top, (np.frombuffer(x, "<u4").tolist() for x in bpe.merge_many(top))))
    name = f"lexicon-{hashlib.sha256(flat).hexdigest()[:32]}.bin"
    if not any(f.endswith(name) for f in spark.sparkContext.listFiles):  # an equal lexicon is shipped once
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark, 'lexicon')}/{name}")
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
        out.write(bytearray(flat))
        out.close()
        spark.sparkContext.addFile(place.toString())
    return name


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_size: int = LEXICON_SIZE) -> DataFrame:
    """Per document: doc_id, ids (little-endian unsigned 32-bit, binary), decoded (string)."""
    name = build_lexicon(docs, tokenizer_path, text_col, lexicon_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer_path, name)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # bounds what a worker holds of the outputs
                b = whole.slice(at, 256)
                ids = enc.encode(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), enc.decode(ids).cast(pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode_decode``'s rows."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )

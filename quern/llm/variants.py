"""Spelling variant grouping by a frequency-vector trie.

1. Words are counted in the tasks and summed by word.
2. A word is arranged by its counts of letters in each of ``GROUPS`` letter groups
   (code point modulo ``GROUPS``); successive counts are the levels of a trie and a
   leaf holds the words with the same counts.  One inserted letter is a surplus of one
   in a group, one deleted letter a deficit of one, one replaced letter at most one of
   each.  A depth-first search carries a budget of one surplus and one deficit.
3. The trie is spread over tasks.  Nodes with more than ``node_words`` words are
   opened, level by level, by counting words; what lies below an unopened node is
   one group.  A leaf that is still larger is cut into slices.  The search through
   the opened top tells in which groups a word has to look; inside a group
   the same search goes on to the leaves.
4. At a leaf only words that also share their first or last half are compared (one
   edit leaves one half as it is), then verified letter by letter.  Each group sums
   up per word what it found, so no pair of words is put out.
5. ``form`` is the most frequent near word if it is at least twice as frequent;
   frequencies at least double along forms, so roots are found by pointer doubling.

Texts are read whole; null texts have no words; a null id reads as an empty id in the
hash.  Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, so each
letter is one byte of Latin-1.  Rows that repeat count again.  An empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

GROUPS = 10
NODE_WORDS = 40_000
MOST_NODES = 20_000  # opened nodes at most: a node then holds more than this share of the words
HELD_WORDS = 300_000  # distinct words that a task holds before it sends their counts
PAIRS = 200_000  # pairs verified at once
Batches = Iterator[pa.RecordBatch]

#: Letters as they are, A-Z lower-cased, anything else a space; characters outside Latin-1 arrive as '?'.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


# ------------------------------------------------------------------ words

def runs(text: str | None) -> list[bytes]:
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def altered(run: bytes, prefix: int, every: int) -> bytes:
    """``run`` without one letter where ``every`` divides the checksum; ``prefix`` is the checksum of ``<id>:``."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, min_letters: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): words of at least ``min_letters`` letters that occur at least ``min_count`` times."""

    def count(batches: Batches) -> Batches:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: dict[bytes, int] = {}
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                prefix = crc32(f"{i or ''}:".encode())
                for run, n in Counter(runs(text.as_py())).items():
                    word = altered(run, prefix, every)
                    if len(word) >= min_letters:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield batch()
                    held.clear()
        yield batch()

    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ------------------------------------------------------------------ the trie

def letter_matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters from the left, letters from the right (zeros beyond a word) and lengths."""
    size = np.array([len(w) for w in words], np.int64)
    wide = int(size.max(initial=0))
    left = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
    right = np.frombuffer(b"".join(w[::-1].ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
    return left, right, size


def letter_counts(words: list[bytes]) -> np.ndarray:
    """Counts by letter group, one row a word."""
    flat = np.frombuffer(b"".join(words), np.uint8) % GROUPS
    home = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(home * GROUPS + flat, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int64)


class Trie:
    """Levels of (parent, count) keys; the node of a key is its place in the level."""

    BASE = 1 << 31

    def __init__(self, counts: np.ndarray):
        self.levels: list[np.ndarray] = []
        node = np.zeros(len(counts), np.int64)
        for c in counts.T:
            keys, node = np.unique(node * self.BASE + c, return_inverse=True)
            self.levels.append(keys)
        self.leaf = node

    def search(self, counts: np.ndarray, chunk: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) pairs with at most one surplus and one deficit, depth first in chunks of the frontier."""
        n = len(counts)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int8), np.zeros(n, np.int8))]
        while stack:
            level, q, node, surplus, deficit = stack.pop()
            if level == len(self.levels):
                yield q, node
                continue
            if len(q) > chunk:
                for i in range(0, len(q), chunk):
                    stack.append((level, *(x[i : i + chunk] for x in (q, node, surplus, deficit))))
                continue
            keys, parts = self.levels[level], []
            for step in (-1, 0, 1):
                ok = (surplus == 0) if step > 0 else (deficit == 0) if step < 0 else np.ones(len(q), bool)
                own = counts[q, level] + step
                ok &= own >= 0
                key = node[ok] * self.BASE + own[ok]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                parts.append((q[ok][hit], at[hit], surplus[ok][hit] + (step > 0), deficit[ok][hit] + (step < 0)))
            nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
            if len(nxt[0]):
                stack.append((level + 1, *nxt))


def one_edit(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[j] differ by exactly one inserted, deleted or replaced letter."""
    wide = min(a[0].shape[1], b[0].shape[1]) + 1
    pad = lambda m, k: np.pad(m[k][:, :wide], ((0, 0), (0, max(wide - m.shape[1], 0))))
    la, lb = a[2][i], b[2][j]
    left = pad(a[0], i) != pad(b[0], j)
    replaced = (la == lb) & (left.sum(1) == 1)
    right = pad(a[1], i) != pad(b[1], j)
    first = lambda m: np.where(m.any(1), m.argmax(1), wide)
    shifted = (np.abs(la - lb) == 1) & (first(left) + first(right) >= np.minimum(la, lb))
    return replaced | shifted


def halves(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the first and of the last letters of each word, half of its length of them; then half of one letter less."""
    out = []
    for less in (0, 1):
        cuts = [(len(w) - less) // 2 for w in words]
        heads = np.fromiter((hash(w[:k]) for w, k in zip(words, cuts, strict=True)), np.int64, len(words))
        tails = np.fromiter((hash(w[len(w) - k :]) for w, k in zip(words, cuts, strict=True)), np.int64, len(words))
        out.append((heads, tails))
    return out


def spread_leaf(leaf: np.ndarray) -> np.ndarray:
    return leaf * np.int64(0x1E3779B97F4A7C15)


def near_words(stored: list[bytes], n: np.ndarray, asking: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each asking word: number of near stored words, and n and place of the best one (0 and -1 if none).

    Long words are searched apart, so that the letter matrices stay narrow.
    """
    count, best_n, best = np.zeros(len(asking), np.int64), np.zeros(len(asking), np.int64), np.full(len(asking), -1)
    for low, high in ((0, 48), (48, 512), (512, 1 << 60)):
        ask = [k for k, w in enumerate(asking) if low < len(w) <= high]
        own = [k for k, w in enumerate(stored) if low <= len(w) <= high + 1]  # one letter more or less lies in the next class
        if not own or not ask:
            continue
        step = len(ask) if high < 1 << 60 else 16
        for i in range(0, len(ask), step):
            part = ask[i : i + step]
            c, bn, b = _near([stored[k] for k in own], n[own], [asking[k] for k in part])
            count[part], best_n[part] = c, bn
            best[part] = np.where(b >= 0, np.array(own)[b], -1)
    return count, best_n, best


def _near(stored: list[bytes], n: np.ndarray, asking: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    trie = Trie(letter_counts(stored))
    a, b = letter_matrix(asking), letter_matrix(stored)
    # Of near words with equal n the smallest in code-point order is best; Latin-1 bytes sort alike.
    by_rank = np.array(sorted(range(len(stored)), key=lambda k: (-n[k], stored[k])))
    rank = np.empty(len(stored), np.int64)
    rank[by_rank] = np.arange(len(stored))
    count, best = np.zeros(len(asking), np.int64), np.full(len(asking), len(stored), np.int64)
    # The half of a pair is half of its shorter word, so a stored word is filed under both lengths that this may be.
    files = []
    for keys in halves(stored):
        files.append([(k := h ^ spread_leaf(trie.leaf), np.argsort(k, kind="stable")) for h in keys])
    files = [[(k[o], o) for k, o in pair] for pair in files]
    length = np.zeros(trie.leaf.max(initial=-1) + 1, np.int64)
    length[trie.leaf] = b[2]
    ask = halves(asking)
    for q, leaf in trie.search(letter_counts(asking)):
        own, other = a[2][q], length[leaf]
        # The asking word's half is cut as for a shorter partner only if the partner is shorter, and the other way round.
        for pick, mine, theirs in ((own == other, 0, 0), (own < other, 0, 1), (own > other, 1, 0)):
            qs, ls = q[pick], leaf[pick]
            for side in (0, 1):
                keys, order = files[theirs][side]
                key = ask[mine][side][qs] ^ spread_leaf(ls)
                lo = np.searchsorted(keys, key, "left")
                has = keys[np.minimum(lo, len(keys) - 1)] == key
                qh, lo, key = qs[has], lo[has], key[has]
                hits = np.searchsorted(keys, key, "right") - lo
                for i, j in slices(hits):
                    h = hits[i:j]
                    qq = np.repeat(qh[i:j], h)
                    w = order[np.arange(h.sum()) - np.repeat(np.cumsum(h) - h, h) + np.repeat(lo[i:j], h)]
                    if side:  # pairs that share both halves came with the first
                        apart = ~same_head(a, qq, b, w, np.minimum(a[2][qq], b[2][w]) // 2)
                        qq, w = qq[apart], w[apart]
                    ok = one_edit(a, qq, b, w)
                    qq, w = qq[ok], w[ok]
                    count += np.bincount(qq, minlength=len(count))
                    np.minimum.at(best, qq, rank[w])
    found = best < len(stored)
    at = np.where(found, by_rank[np.where(found, best, 0)], -1)
    return count, np.where(found, n[at], 0), at


def same_head(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the first k letters are the same."""
    wide = min(a[0].shape[1], b[0].shape[1])
    diff = a[0][i][:, :wide] != b[0][j][:, :wide]
    return np.where(diff.any(1), diff.argmax(1), wide) >= k


def slices(hits: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``PAIRS`` hits each."""
    end = np.cumsum(hits)
    i = 0
    while i < len(hits):
        base = end[i - 1] if i else 0
        j = max(int(np.searchsorted(end, base + PAIRS, "right")), i + 1)
        if end[j - 1] > base:
            yield i, j
        i = j


# ------------------------------------------------------------------ the trie over tasks

def _prefix(words: list[str], depth: int) -> list[str]:
    counts = letter_counts([w.encode("latin-1") for w in words])[:, :depth]
    return [",".join(map(str, c)) for c in counts.tolist()]


def opened_nodes(words: DataFrame, node_words: int, most_nodes: int) -> tuple[set[str], dict[str, int]]:
    """Prefixes of counts that are opened, and slices of leaves that are still large; at most GROUPS x ``most_nodes`` of them."""
    total = words.count()
    limit = max(node_words, total // most_nodes)
    if total <= limit:
        return set(), {}
    opened, frontier = {""}, {""}
    for depth in range(1, GROUPS + 1):

        def inside(batches: Batches, depth: int = depth, frontier: frozenset = frozenset(frontier)) -> Batches:
            for b in batches:
                text = b.column(0).to_pylist()
                own = Counter(p for p, up in zip(_prefix(text, depth), _prefix(text, depth - 1), strict=True) if up in frontier)
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["prefix", "n"])

        large = words.select("word").mapInArrow(inside, "prefix string, n long").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > limit).collect()  # at most total / limit
        if depth == GROUPS:
            return opened, {r.prefix: -(-r.n // limit) for r in large}
        frontier = {r.prefix for r in large}
        opened |= frontier
        if not frontier:
            break
    return opened, {}


def homes(words: list[str], opened: set[str], cuts: dict[str, int]) -> tuple[list[list[str]], list[str]]:
    """For each word the groups it has to look in, and the one that it is kept in."""
    counts = letter_counts([w.encode("latin-1") for w in words]).tolist()
    look, kept = [], []
    for w, c in zip(words, counts, strict=True):
        out, stack = [], [("", 0, 0, 0, True)]
        while stack:
            prefix, depth, surplus, deficit, own = stack.pop()
            if prefix not in opened or depth == GROUPS:
                k = cuts.get(prefix, 1)
                out += [f"{prefix}/{s}" for s in range(k)]
                if own:
                    kept.append(f"{prefix}/{crc32(w.encode()) % k}")
                continue
            for step in (-1, 0, 1):
                s, d = surplus + (step > 0), deficit + (step < 0)
                if c[depth] + step >= 0 and s <= 1 and d <= 1:
                    down = f"{prefix},{c[depth] + step}" if depth else str(c[depth] + step)
                    stack.append((down, depth + 1, s, d, own and not step))
        look.append(out)
    return look, kept


def near(words: DataFrame, node_words: int = NODE_WORDS, most_nodes: int = MOST_NODES) -> DataFrame:
    """(word, n_near, form_n, form) of (word, n), for words with near words; ``form`` is the most frequent of them."""
    opened, cuts = opened_nodes(words, node_words, most_nodes)

    def deal(batches: Batches) -> Batches:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                text = part.column(0).to_pylist()
                look, kept = homes(text, opened, cuts)
                times = [len(x) for x in look]
                at = np.repeat(np.arange(len(text)), times)
                home = [h for x in look for h in x]
                store = pa.array([h == kept[k] for h, k in zip(home, at.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.string()), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), store], ["home", "word", "n", "store"])

    def search(part: pa.Table) -> pa.Table:
        words = part.column("word").to_pylist()
        asking = [w.encode("latin-1") for w in words]
        own = np.flatnonzero(part.column("store").to_numpy())
        n = part.column("n").to_numpy()[own]
        count, form_n, form = near_words([asking[k] for k in own.tolist()], n, asking)
        hit = np.flatnonzero(count)
        forms = [words[k] for k in own[form[hit]].tolist()] if len(own) else []
        return pa.table({"word": pa.array([words[k] for k in hit.tolist()], pa.string()), "n_near": count[hit], "form_n": form_n[hit], "form": pa.array(forms, pa.string())})

    dealt = words.mapInArrow(deal, "home string, word string, n long, store boolean")
    found = dealt.groupBy("home").applyInArrow(search, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms, by pointer doubling."""
    out = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        up = out.select(F.col("word").alias("w"), F.col("root").alias("up"))
        out = cut(out.join(up, F.col("root") == F.col("w"), "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        if out.where("moved").isEmpty():
            return out.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, min_letters: int = 5, min_count: int = 3, node_words: int = NODE_WORDS, most_nodes: int = MOST_NODES) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = cut(word_counts(docs, id_col, text_col, every, min_letters, min_count))
    found = words.join(near(words, node_words, most_nodes), "word", "left")
    good = F.col("form_n") >= 2 * F.col("n")
    rows = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    return rows.join(roots(rows.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))

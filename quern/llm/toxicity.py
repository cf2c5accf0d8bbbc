"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

Fitting (on at most ``sample`` labelled rows, taken by hash of the id): words and
word stems whose document frequency leans to toxic labels become the lexicon;
a logistic model over a few counts turns hits into a score.

Scoring: the lexicon is a trie; the union of its terms' Levenshtein automata is
walked as one lazily built DFA whose states are sets of (trie node, edits).  A
word is an exact hit, a disguised hit (digits or signs in place of letters,
drawn-out letters) or a misspelling, unless clean rows of the sample use that
word too.  A hit inside quotation marks or next to words of reporting counts as
quoted.  Every kind of hit has a fitted weight of its own.

Labels say little on misspelling and quotation, so the fit also sees altered
copies of toxic rows, weighed as much as these rows together: hits misspelt by one
edit and hits in disguise (still toxic), all hits quoted (not toxic) and every other
hit quoted (still toxic).

Null and empty texts have no hits and get the score of the bias; very long texts
are read whole; rows that repeat an id are scored each for itself, and equal texts
get equal scores; without labels every score is low and the same; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import collections
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labels import fold, hash_sample, one_label

SAMPLE = 20_000  # labelled rows to fit on, at most
WINDOW = 6  # words to each side
#: Quotation marks, reporting words, stand-ins for letters.
QUOTES = "\"“”„«»‹›'‘’`"
DOUBLE = "\"“”„«»"
REPORTING = frozenset("said says quote quoted quotes quoting wrote writes called term word words slur insult cited dit écrit cité sagte schrieb zitiert dijo escribió cita".split())
STAND_IN = str.maketrans("013457@$!|8", "oieastasiib")
FEATURES = ("exact", "disguised", "misspelt", "quoted", "exact_rate")
ALTERED = ("misspelt", "disguised", "quoted", "half quoted")
CROWD = 3  # clean words beside a term that take its edits away
MIXED = math.log(50)  # log odds below which a stem is also clean documents' own
MEMO = 300_000
NONE = (0, 0.0)


# ------------------------------------------------------------------ lexicon DFA

class FuzzyTrie:
    """Terms as a trie; ``find`` gives (term index, edits) or None for a word.

    A stem (``lowei*``) fits every word that starts with it and allows no edits;
    a whole word allows 1 edit from 5 letters and 2 from 8, unless it is ``crowded``.
    """

    def __init__(self, terms: list[tuple[str, bool, float]], crowded: frozenset[str] = frozenset()):
        self.child: list[dict[str, int]] = [{}]
        self.budget, self.word, self.stem = [0], {}, {}
        for i, (term, is_stem, _) in enumerate(terms):
            edits, node = 0 if is_stem or len(term) < 5 or term in crowded else 1 if len(term) < 8 else 2, 0
            self.budget[0] = max(self.budget[0], edits)
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.budget.append(0)
                node = self.child[node][c]
                self.budget[node] = max(self.budget[node], edits)  # most edits that a term below allows
            (self.stem if is_stem else self.word)[node] = (i, edits)
        self.clear()

    def clear(self) -> None:
        self.state_of: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """Number of the state with these least edits by node, closed under missing letters."""
        todo = list(least.items())
        while todo:
            node, e = todo.pop()
            for n in self.child[node].values():
                if e < self.budget[n] and least.get(n, 99) > e + 1:
                    least[n] = e + 1
                    todo.append((n, e + 1))
        key = frozenset(least.items())
        at = self.state_of.get(key)
        if at is None:
            at = self.state_of[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
        return at

    def _step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.budget[node] and e < least.get(node, 99):
                least[node] = e

        for node, e in self.sets[state]:
            put(node, e + 1)  # c is extra
            for letter, n in self.child[node].items():
                if letter == c:
                    if e < least.get(n, 99):
                        least[n] = e
                else:
                    put(n, e + 1)  # c stands for another letter
        at = self.next[state][c] = self._state(least)
        return at

    def find(self, word: str) -> tuple[int, int] | None:
        state, sets, nxt = self.start, self.sets, self.next
        for c in word:
            got = nxt[state].get(c)
            state = self._step(state, c) if got is None else got
            if not sets[state]:
                return None
            if self.stem:
                for node, e in sets[state]:
                    if e == 0 and node in self.stem:
                        return self.stem[node][0], 0
        fits = [(e, self.word[node][0]) for node, e in sets[state] if node in self.word and e <= self.word[node][1]]
        if not fits:
            return None
        e, i = min(fits)
        return i, e


@dataclass
class Model:
    terms: list[tuple[str, bool, float]]
    weights: list[float]
    bias: float
    ordinary: frozenset[str] = frozenset()  # words like a term that clean rows use
    crowded: frozenset[str] = frozenset()  # terms with ``CROWD`` or more of those beside them


def misspelt(word: str) -> str:
    """``word`` with one letter dropped, doubled, swapped or replaced, as a checksum of the word says."""
    h = zlib.crc32(word.encode())
    at = 1 + h // 4 % max(1, len(word) - 2)
    if h % 4 == 0:
        return word[:at] + word[at + 1 :]
    if h % 4 == 1:
        return word[:at] + "xqz"[h // 64 % 3] + word[at:]
    if h % 4 == 2:
        return word[: at - 1] + word[at] + word[at - 1] + word[at + 1 :] if len(word) >= 8 else word[:at] + word[at + 1 :]
    return word[:at] + "jvk"[h // 64 % 3] + word[at + 1 :]


def disguised(word: str) -> str:
    """``word`` with digits and signs for letters."""
    return word.translate(str.maketrans("oleasti", "0134571"))


def same_line(word: str) -> str:
    """``word`` with l as i: signs such as 1 stand for both."""
    return word.replace("l", "i")


def quotations(chunks: list[str]) -> set[int]:
    """Chunks inside quotations of any length: from a double mark that opens to the next that closes.

    A mark that is not closed opens nothing, and one that opens again begins anew.
    Single marks are too often apostrophes; ``Counter.quoted`` looks for those in its window.
    """
    inside: set[int] = set()
    start = None
    for at, c in enumerate(chunks):
        own = c.strip(".,;:!?()[]")
        if own[:1] in DOUBLE and own[:1]:
            start = at
        if own[-1:] in DOUBLE and own[-1:] and start is not None and (at > start or len(own) > 1):
            inside.update(range(start, at + 1))
            start = None
    return inside


class Counter:
    """Hits of texts, with what a worker remembers of chunks."""

    def __init__(self, terms: list[tuple[str, bool, float]], ordinary: frozenset[str] = frozenset(), crowded: frozenset[str] = frozenset()):
        self.trie, self.ordinary = FuzzyTrie(terms, crowded), ordinary
        self.folded = FuzzyTrie([(same_line(t), stem, o) for t, stem, o in terms])
        self.odds = [min(6.0, max(0.5, o)) for _, _, o in terms]
        self.memo: dict[str, tuple[int, float]] = {}

    def bare(self, chunk: str) -> str:
        return chunk.lower().strip(".,;:!?()[]{}<>…-–—_*#%&$/\\+=|~^" + QUOTES)

    def kind(self, chunk: str) -> tuple[int, float]:
        """(0 no hit, 1 exact, 2 disguised, 3 misspelt; the term's weight)."""
        word = self.bare(chunk)
        hit = self.trie.find(word)
        if hit and hit[1] == 0:
            return 1, self.odds[hit[0]]
        if not word.isalpha() or any(a == b == c for a, b, c in zip(word, word[1:], word[2:])):
            plain = word.translate(STAND_IN)
            tight = "".join(c for i, c in enumerate(plain) if i == 0 or c != plain[i - 1])
            for w in {plain, tight, "".join(filter(str.isalpha, plain))}:
                # Where a sign may be l or i, both are; else the word itself must fit.
                found = (self.folded.find(same_line(w)) if re.search("[1!|]", word) else self.trie.find(w)) if w != word else None
                if w and found and found[1] == 0:
                    return 2, self.odds[found[0]]
        return (3, self.odds[hit[0]]) if hit and word not in self.ordinary else NONE

    def kinds(self, chunks: list[str]) -> list[tuple[int, float]]:
        memo = self.memo
        if len(memo) > MEMO or len(self.trie.sets) > MEMO:
            memo.clear()
            self.trie.clear()
        for c in set(chunks).difference(memo):
            memo[c] = self.kind(c)
        return list(map(memo.__getitem__, chunks))

    def counts(self, chunks: list[str]) -> list[float]:
        count = [0.0, 0.0, 0.0, 0.0]
        inside = None
        for at, k in enumerate(self.kinds(chunks)):
            if k is not NONE:
                inside = quotations(chunks) if inside is None else inside
                count[0 if at in inside or self.quoted(chunks, at) else k[0]] += k[1]
        rate = 1000 * (count[1] + count[2]) / (len(chunks) + 50)
        return [math.log1p(count[1]), math.log1p(count[2]), math.log1p(count[3]), math.log1p(count[0]), math.log1p(rate)]

    def features(self, text: str | None) -> list[float]:
        return self.counts((text or "").split())

    def altered(self, text: str | None) -> list[list[float]]:
        """Features of the ``ALTERED`` copies of a text; none when it has no exact hit."""
        chunks = (text or "").split()
        hits = [i for i, k in enumerate(self.kinds(chunks)) if k[0] == 1]
        inside = quotations(chunks) if hits else ()
        hits = [i for i in hits if i not in inside and not self.quoted(chunks, i)]
        if not hits:
            return []

        def copy(change, every: int = 1) -> list[float]:
            out = list(chunks)
            for i in hits[::every]:
                out[i] = change(self.bare(chunks[i]))
            return self.counts(" ".join(out).split())

        quote = '\u201c{}\u201d'.format
        return [copy(misspelt), copy(disguised), copy(quote), copy(quote, 2)]

    def quoted(self, chunks: list[str], at: int) -> bool:
        """In its window, the word stands between quotation marks or beside a word of reporting."""
        own = chunks[at]
        if own[0] in QUOTES and own.rstrip(".,;:!?")[-1:] in QUOTES and len(own) > 2:
            return True
        before, after = chunks[max(0, at - WINDOW) : at], chunks[at + 1 : at + 1 + WINDOW]
        opened = own[0] in QUOTES or any(c[0] in QUOTES and c.rstrip(".,;:!?")[-1:] not in QUOTES for c in before)
        closed = own.rstrip(".,;:!?")[-1:] in QUOTES or any(c.rstrip(".,;:!?")[-1:] in QUOTES for c in after)
        if opened and closed:
            return True
        return any(c.lower().strip(".,;:!?" + QUOTES) in REPORTING for c in before[-3:] + after[:2])


# ------------------------------------------------------------------ fitting

def learn_terms(sample: DataFrame) -> tuple[list[tuple[str, bool, float]], frozenset[str], frozenset[str]]:
    """((term, is stem, log odds) ..., ordinary words, crowded terms): words and stems of ``sample`` (doc_id, text, y) that nearly all stand in toxic documents.

    Evidence is counted by distinct preceding words, so copies of one document
    do not add up.  A stem is the shortest prefix of 4 to 8 letters that leans
    clearly, over at least 3 words with several contexts each.  Ordinary words are
    those within a term's edits that two or more clean documents use; a term with
    several of them beside it, or under a stem that clean documents use, cannot be
    told from its neighbours and allows no edits.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,40}"), F.lit(0))
    pairs = F.transform(F.col("ws"), lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.get("ws", i - 1)).otherwise("").alias("before")))
    seen = sample.select("doc_id", "y", words.alias("ws")).select("doc_id", "y", F.explode(pairs).alias("x")).select("doc_id", "y", "x.w", "x.before").where(F.length("w") > 3)
    by_doc = seen.groupBy("w", "doc_id").agg(F.max("y").alias("y"), F.min("before").alias("before"))
    by_word = by_doc.groupBy("w").agg(F.sum(1 - F.col("y")).alias("b"), F.approx_count_distinct(F.when(F.col("y") == 1, F.col("before"))).alias("a"))
    by_word = by_word.where("a > 0 OR b > 0").persist()
    odds = F.log((F.col("a") + 0.5) / (F.col("b") + 0.5))
    clear = (F.col("a") + 0.5) / (F.col("a") + F.col("b") + 1) >= 0.8
    try:
        # Both lists are bounded by the sample: a word here stands in 8 contexts of it, a stem in 10.
        tops = by_word.where(clear & (F.col("a") >= 8)).select("w", "a", odds.alias("o")).collect()
        prefix = by_word.select("a", "b", F.length("w").alias("n"), "w", F.explode(F.sequence(F.lit(4), F.lit(8))).alias("k")).where("n > k").groupBy(F.col("w").substr(F.lit(1), F.col("k")).alias("p"))
        stems = prefix.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum((F.col("a") > 1).cast("int")).alias("often"))
        stems = stems.where(clear & (F.col("a") >= 10) & (F.col("often") >= 3)).select("p", "a", odds.alias("o")).collect()
        found: list[tuple[str, bool, float]] = []
        for r in sorted(stems, key=lambda r: (len(r.p), r.p)):
            if not any(r.p.startswith(t) for t, _, _ in found):
                found.append((r.p, True, r.o))
        terms = sorted(found + [(r.w, False, r.o) for r in tops])

        def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = FuzzyTrie(terms)
            for b in batches:
                hits = [(w, trie.find(w)) for w in b.column(0).to_pylist()]
                near = [(w, terms[h[0]][0]) for w, h in hits if h and h[1]]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in near], pa.string()), pa.array([t for _, t in near], pa.string())], ["w", "term"])

        near = by_word.where("b >= 2").select("w").mapInArrow(alike, "w string, term string").collect()  # words near a term, of the sample
    finally:
        by_word.unpersist()
    beside = collections.Counter(r.term for r in near)
    mixed = tuple(t for t, _, o in found if o < MIXED)  # stems that clean documents use as well
    crowded = frozenset(t for t, stem, _ in terms if not stem and (beside[t] >= CROWD or t.startswith(mixed)))
    return terms, frozenset(r.w for r in near), crowded


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights and bias by Newton's method; ``each`` is a row's weight."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    pen = ridge * each.sum() * np.diag([1.0] * x.shape[1] + [1e-6]) + 1e-9 * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(x1.T @ (x1 * (each * p * (1 - p))[:, None]) + pen, x1.T @ (each * (p - y)) + pen @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample_features(rows: DataFrame, *lexicon) -> list[tuple]:
    """(doc_id, y, features of the text, features of its altered copies) of a bounded sample, in an order of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*lexicon)
        for b in batches:
            ids, texts, y = b.columns
            own = [(counter.features(t), counter.altered(t) if k else []) for t, k in zip(texts.to_pylist(), y.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, y, pa.array([x for x, _ in own], pa.list_(pa.float64())), pa.array([a for _, a in own], pa.list_(pa.list_(pa.float64())))], ["doc_id", "y", "x", "more"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "text", "y").mapInArrow(run, f"doc_id {kind}, y int, x array<double>, more array<array<double>>").collect()
    return sorted((r.doc_id, r.y, r.x, r.more) for r in got)


def fit(docs: DataFrame, labels: DataFrame, train: F.Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of ``labels`` (doc_id, toxic) for which ``train`` holds."""
    y = one_label(labels, "toxic")
    ids = F.broadcast(hash_sample(y if train is None else y.where(train), sample, "toxic"))  # at most ``sample`` rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id").persist()
    try:
        terms, ordinary, crowded = learn_terms(rows)
        got = _sample_features(rows, terms, ordinary, crowded)
    finally:
        rows.unpersist()
    toxic = sum(r[1] for r in got)
    if not 0 < toxic < len(got):
        return Model(terms, [0.0] * len(FEATURES), math.log((toxic + 0.5) / (len(got) - toxic + 0.5)) if got else -3.0, ordinary, crowded)
    copies = [(x, 0 if kind == "quoted" else 1) for r in got for kind, x in zip(ALTERED, r[3]) if any(x)]  # one that shows no hit teaches nothing
    share = toxic / max(len(copies), 1)
    x = np.array([r[2] for r in got] + [c for c, _ in copies])
    target = np.array([r[1] for r in got] + [k for _, k in copies], float)
    w = _logistic(x, target, np.concatenate([np.ones(len(got)), np.full(len(copies), min(1.0, share))]))
    return Model(terms, w[:-1].tolist(), float(w[-1]), ordinary, crowded)


def _scorer(model: Model):
    """Texts to scores, within a task."""
    counter = Counter(model.terms, model.ordinary, model.crowded)
    weights = np.array(model.weights)

    def run(texts: list[str | None]) -> np.ndarray:
        x = np.array([counter.features(t) for t in texts]).reshape(-1, len(FEATURES))
        return 1 / (1 + np.exp(-np.clip((x * weights).sum(1) + model.bias, -500, 500)))

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train: F.Column | None = None) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their columns.

    A row goes or stays for its own text, so rows that share its id, or have none, do not matter.
    """
    model, at = fit(docs, labels, train), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at).cast(pa.string()).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learnt outside crc32(doc_id) mod 3 = 1."""
    model = fit(docs, labels, fold(F.col("doc_id"), 3) != 1)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

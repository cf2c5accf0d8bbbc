"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; unlabelled text is taken from all rows,
whatever their label, and labels of 0 are used nowhere.  The class prior is
estimated from both samples: unlabelled text is a mixture, so the share of it in
any region is at least the prior times the share of positives there, and the
least ratio over regions of a positive-against-unlabelled score bounds the prior
(mixture proportion estimation).  A small network then minimises the
non-negative unbiased risk

    pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)])

with the logistic loss; when the second term falls below zero, the step goes up
along it.  The fit takes bounded samples (``POSITIVES``, ``UNLABELLED``), chosen by
hash of the id and sorted, so neither partitioning nor row order changes a
score; scoring reads every text whole in Arrow batches.

Features are the shape of a text and hashed counts of its words.  Null and empty
texts have all-zero counts and are scored like any other; very long texts are
read whole; rows that repeat an id are scored each for itself and count together
in a sample; equal texts have equal scores; without positives or unlabelled text
every score is 0.5; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labels import fold, hash_sample, one_label

POSITIVES = 8_000
UNLABELLED = 16_000
STRANGE = re.compile(r"[^\w\s.,;:!?'\"()\-]")
SHAPE = 15
HASHED = 32  # buckets of word counts, each with a sign by hash
FEATURES = SHAPE + HASHED


def hashed_counts(count: Counter, total: int) -> list[float]:
    """Share of words by hash bucket and sign."""
    out = [0.0] * HASHED
    for w, n in count.items():
        h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        out[h % HASHED] += n if h & 1024 else -n
    return [v / total for v in out]


def text_features(text: str | None) -> list[float]:
    """Shape of a text (sizes, variety, repetition, case and signs) and its hashed words."""
    text = text or ""
    n = len(text)
    words = text.split()
    k = len(words)
    if not k:
        return [float(np.log1p(n)), *[0.0] * (FEATURES - 1)]
    count = Counter(words)
    top = count.most_common(1)[0][1]
    twice = sum(a == b for a, b in zip(words, words[1:]))
    lines = text.split("\n")
    signs = len(STRANGE.findall(text))
    upper = sum(map(str.isupper, words))
    return [
        float(np.log1p(n)),
        float(np.log1p(k)),
        len(count) / k,
        float(np.log(len(count)) / np.log(k + 1)) if k > 1 else 0.0,
        top / k,
        twice / k,
        min(1.0, signs / n * 10),
        upper / k,
        min(5.0, text.count("!") / k),
        min(5.0, text.count("|") / k),
        min(3.0, (text.count(".") + text.count(",")) / k),
        min(30.0, n / k) / 10,
        len(set(lines)) / len(lines),
        min(1.0, sum(n for w, n in count.items() if any(map(str.isdigit, w))) / k),
        min(1.0, sum(n for w, n in count.items() if n > 3 and len(w) > 4) / k),
        *hashed_counts(count, k),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, least_share: float = 0.3) -> float:
    """Share of positives in ``unl``: least ratio of shares above a threshold, with a margin of half a deviation.

    The ratio bounds the share from above, and its least value over noisy
    thresholds lies too low; the margin offsets that.  The score is a ridge logistic one of positives against unlabelled rows, fitted
    on every other row of both and read on the rest.
    """
    if len(pos) < 20 or len(unl) < 20:
        return 0.5
    mean, scale = unl.mean(0), unl.std(0) + 1e-6
    p, u = (np.clip((v - mean) / scale, -8, 8) for v in (pos, unl))
    x = np.hstack([np.vstack([p[::2], u[::2]]), np.ones((len(p[::2]) + len(u[::2]), 1))])
    y = np.concatenate([np.ones(len(p[::2])), np.zeros(len(u[::2]))])
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both samples weigh the same
    w, pen = np.zeros(x.shape[1]), 1e-3 * np.eye(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (each * q * (1 - q))[:, None]) + pen, x.T @ (each * (q - y)) + pen @ w)
    sp, su = (np.sort(v[1::2] @ w[:-1] + w[-1]) for v in (p, u))
    at = np.unique(np.quantile(sp, np.linspace(0, 1 - least_share, 60)))
    above = lambda s: 1 - np.searchsorted(s, at) / len(s)
    share_p, share_u = above(sp), above(su)
    margin = 0.5 * (np.sqrt(share_u * (1 - share_u) / len(su)) + np.sqrt(share_p * (1 - share_p) / len(sp)))
    return float(np.clip(((share_u + margin) / share_p).min(), 0.02, 0.98))


def forward(par: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer and probability."""
    h = np.tanh(x @ par[0] + par[1])
    return h, 1 / (1 + np.exp(-np.clip(h @ par[2] + par[3], -30, 30)))


def risk(par: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """(pi E_p[l(g)], E_u[l(-g)] - pi E_p[l(-g)]) with the logistic loss l(z) = log(1 + exp(-z))."""
    sp, su = forward(par, p)[1], forward(par, u)[1]
    return float(-prior * np.log(sp + 1e-12).mean()), float(-np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean())


def gradient(par: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> list[np.ndarray]:
    """Of the non-negative risk; where its second term is negative, of that term's negation."""
    (hp, sp), (hu, su) = forward(par, p), forward(par, u)

    def back(x: np.ndarray, dg: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        d = np.outer(dg, par[2]) * (1 - h * h)
        return [x.T @ d, d.sum(0), h.T @ dg, dg.sum(keepdims=True)]

    # d l(g)/dg = s - 1 and d l(-g)/dg = s
    second = [a + b for a, b in zip(back(u, su / len(su), hu), back(p, -prior * sp / len(sp), hp))]
    if risk(par, p, u, prior)[1] < 0:
        return [-g for g in second]
    return [a + b for a, b in zip(second, back(p, prior * (sp - 1) / len(sp), hp))]


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, batch: int = 1024, rate: float = 5e-3, seed: int = 7) -> Model:
    """Minimise the non-negative risk with Adam."""
    rng = np.random.default_rng(seed)
    mean, scale = unl.mean(0), unl.std(0) + 1e-6
    p_all, u_all = (np.clip((v - mean) / scale, -8, 8) for v in (pos, unl))
    d = pos.shape[1]
    par = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m1, m2, t = [np.zeros_like(v) for v in par], [np.zeros_like(v) for v in par], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(u_all)), max(1, len(u_all) // batch)):
            g = gradient(par, p_all[rng.integers(0, len(p_all), max(64, len(part) // 2))], u_all[part], prior)
            t += 1
            for i, gi in enumerate(g):
                gi = gi + 1e-4 * par[i]
                m1[i] = 0.9 * m1[i] + 0.1 * gi
                m2[i] = 0.999 * m2[i] + 0.001 * gi * gi
                par[i] = par[i] - rate * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, par[0], par[1], par[2], float(par[3][0]), prior)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(text_features, b.column(1).to_pylist()), pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, train: F.Column | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """The model, or None without positives or unlabelled text."""
    y = one_label(labels, "quality")
    y = y if train is None else y.where(train)
    pos = F.broadcast(hash_sample(y.where("y = 1").select("doc_id"), positives, "quality"))
    unl = F.broadcast(hash_sample(docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), unlabelled, "web"))

    def take(ids: DataFrame) -> np.ndarray:
        """Features of the rows of a bounded sample, in an order of their own."""
        rows = features(docs.join(ids, "doc_id")).collect()
        return np.array([r.x for r in sorted(rows, key=lambda r: (r.doc_id, r.x))])

    p, u = take(pos), take(unl)
    return fit_nnpu(p, u, estimate_prior(p, u)) if len(p) and len(u) else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row; 0.5 without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(list(map(text_features, b.column(1).to_pylist()))).reshape(-1, FEATURES)
            s = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learnt outside crc32(doc_id) mod 5 = 0."""
    model = fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

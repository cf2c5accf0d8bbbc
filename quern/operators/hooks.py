"""Extension points: named embedders, rerankers and tools, and sinks for streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

_REGISTRY: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, f: Callable) -> None:
    """Kinds: embedder (text Column -> vector Column), scorer (query, text -> score), tool (DataFrame -> DataFrame)."""
    if kind not in ("embedder", "scorer", "tool"):
        raise ValueError(f"no kind {kind}")
    _REGISTRY[kind, name] = f


def get(kind: str, name: str) -> Callable:
    try:
        return _REGISTRY[kind, name]
    except KeyError:
        raise KeyError(f"no {kind} named {name}; known: {sorted(n for k, n in _REGISTRY if k == kind)}") from None


def hashed_vectors(dimension: int = 64, prefix: str = "passage: ") -> Callable[[Column], Column]:
    """The default embedder: signed counts of hashed words at length 1, in Arrow batches."""

    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for t in texts:
                v = np.zeros(dimension)
                for w in (prefix + (t or "")).lower().split():
                    h = xxhash.xxh3_64_intdigest(w.encode())
                    v[h % dimension] += 1 if h >> 63 else -1
                out.append((v / max(np.linalg.norm(v), 1e-12)).astype(np.float32))
            yield pd.Series(out)

    return lambda text: pandas_udf(embed, "array<float>")(text)


register("embedder", "hashed", hashed_vectors())


def embed(docs: DataFrame, text_col: str, name: str = "hashed", out: str = "vector") -> DataFrame:
    return docs.withColumn(out, get("embedder", name)(F.col(text_col)))


def emit(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    """Hand each micro-batch to ``sink``; restarts go on from ``checkpoint``."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).start()

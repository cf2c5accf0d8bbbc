"""Chunks of texts: a sliding window on bytes with natural break points, and chunks of sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..config import EngineConfig

#: Break points from the strongest, with the bytes that stay before the break.
BREAKS = ((b"\n\n", 2), (b". ", 2), (b".\n", 2), (b"\n", 1), (b" ", 1))
REACH = 200
#: Rows that become Python objects at a time.
PIECE = 200


def _snap(data: bytes, at: int) -> int:
    """The character boundary at or before ``at``."""
    at = min(at, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def spans(data: bytes, size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Byte spans of the chunks; a tail of the overlap's size follows the chunk that reaches the end."""
    if len(data) <= size:
        return [(0, len(data))] if len(data) >= least else []
    out, start = [], 0
    while start < len(data):
        end = _snap(data, start + size)
        if end < len(data):
            low = _snap(data, max(end - REACH, start))
            for mark, keep in BREAKS:
                at = data.rfind(mark, low, end)
                if at >= 0:
                    end = at + keep
                    break
        if end - start >= least:
            out.append((start, end))
        step = end - start - overlap
        after = _snap(data, start + (step if step > 0 else end - start))
        start = after if after > start else end
    return out


def chunk_column(config: EngineConfig = EngineConfig()):
    """A pandas UDF text -> array<struct<index,text,start,stop>>."""

    @pandas_udf("array<struct<chunk_index:int,text:string,start:int,stop:int>>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for t in texts:
                data = (t or "").encode()
                out.append([(i, data[a:b].decode(), a, b) for i, (a, b) in enumerate(spans(data, config.chunk_size, config.chunk_overlap, config.min_chunk))])
            yield pd.Series(out)

    return cut


def heading(text: Column) -> Column:
    """The first line without its #s, when it starts with one."""
    return F.when(text.startswith("#"), F.trim(F.regexp_replace(F.split(text, "\n")[0], "^#+", "")))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title: Column | None = None, source: Column | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One row per chunk, with its offsets in bytes and its text in context."""
    title, source = F.lit("") if title is None else title, F.lit("") if source is None else source
    first = F.left(F.split(F.col(text_col), "\n\n")[0], F.lit(200))
    rows = docs.select(F.col(id_col).alias("doc_id"), title.alias("title"), source.alias("source"), first.alias("summary"), F.explode(chunk_column(config)(F.col(text_col))).alias("c")).select("doc_id", "title", "source", "summary", "c.*")
    head = heading(F.col("text"))
    section = F.coalesce(F.nullif(head, F.lit("")), F.col("summary"))
    context = F.concat(F.lit('Document: "'), "title", F.lit('". Source: '), "source", F.lit(". Section: "), section, F.lit(". "), "text")
    return rows.select("doc_id", "chunk_index", "text", "start", "stop", head.alias("heading"), context.alias("context"))


def packed_lines(lines: list[str], room: int) -> list[str]:
    """Lines in groups of at most ``room`` bytes with a line break after each; a longer line is a group of its own."""
    out, held, size = [], [], 0
    for x in lines:
        n = len(x.encode()) + 1
        if held and size + n > room:
            out.append("\n".join(held))
            held, size = [], 0
        held.append(x)
        size += n
    return [*out, "\n".join(held)] if held else out


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``PIECE`` rows, so that a task holds few rows as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, PIECE):
            yield b.slice(at, PIECE)


def section_chunks(sections: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Chunks of (doc_id, kind, page, heading, content, fields, headers, rows).

    Form fields become 'key: value' lines, tables Markdown rows under a repeated
    header; both are packed into groups of lines that fit a chunk, in one pass over
    the lines.  Text is labelled with its page and goes through the sliding window.
    Null rows and cells and empty fields are left out.
    """
    row = lambda cells: "| " + " | ".join(c for c in cells or [] if c is not None) + " |"

    def groups(kind: str, fields: list | None, headers: list | None, rows: list | None) -> list[str]:
        if kind == "form":
            return packed_lines([f"{f['k']}: {f['v']}" for f in fields or [] if f and f["k"] and f["v"]], 2 * config.chunk_size)
        head = f"{row(headers)}\n| {' | '.join('---' for _ in headers or [])} |\n"
        return [head + g for g in packed_lines([row(r) for r in rows or [] if r is not None], config.chunk_size - len(head.encode()))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            own = [groups(*x) for x in zip(*(b.column(i).to_pylist() for i in (1, 3, 4, 5)), strict=True)]
            at = pa.array(np.repeat(np.arange(len(own)), [len(g) for g in own]), pa.int64())
            texts = pa.array([t for g in own for t in g], pa.string())
            number = pa.array([i for g in own for i in range(len(g))], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), number, texts], ["doc_id", "kind", "page", "chunk_index", "text"])

    kinds = {c: sections.schema[c].dataType.simpleString() for c in ("doc_id", "page")}
    lined = sections.where(F.col("kind").isin("form", "table")).select("doc_id", "kind", "page", "fields", "headers", "rows")
    shaped = lined.mapInArrow(pack, f"doc_id {kinds['doc_id']}, kind string, page {kinds['page']}, chunk_index int, text string")
    label = F.when(F.col("page").isNotNull(), F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(": "))).otherwise("")

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            data = [(t or "").encode() for t in b.column(3).to_pylist()]
            own = [spans(x, config.chunk_size, config.chunk_overlap, config.min_chunk) for x in data]
            at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]), pa.int64())
            texts = pa.array([d[i:j].decode() for d, x in zip(data, own) for i, j in x], pa.string())
            number = pa.array([i for x in own for i in range(len(x))], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), number, texts], ["doc_id", "kind", "page", "chunk_index", "text"])

    plain = sections.where("kind = 'text'").select("doc_id", "kind", "page", "content").mapInArrow(slide, f"doc_id {kinds['doc_id']}, kind string, page {kinds['page']}, chunk_index int, text string")
    plain = plain.withColumn("text", F.concat(label, "text"))
    return shaped.unionByName(plain)

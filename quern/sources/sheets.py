"""Spreadsheets as rows, one partition a sheet, and reports as docx or xlsx files: Python data sources.

    spark.dataSource.register(Sheets); spark.dataSource.register(Reports)
    rows = spark.read.format("sheets").load(folder)          # path, sheet, name, row, cells
    lines.write.format("reports").option("kind", "xlsx").mode("append").save(folder)

``Sheets`` lists .xlsx files below the folder and their sheets on the driver (names only); a task
parses one sheet as a stream and yields rows that have a cell.  Empty cells between others are
empty strings.  A file that cannot be opened as a workbook is one row with its error.

``Reports`` writes one file a task: xlsx rows of all columns under a header, or docx paragraphs of
the column ``text`` (a line that starts with # is a heading).  A task writes below
``_pending``; the driver moves finished files in at the end and removes them if the job fails,
so a reader sees files of whole jobs only.  Paths are opened by URI with pyarrow.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .changes import _open as opened, listing

ROWS = "path string, sheet int, name string, row long, cells array<string>, error string"
BLOCK = 1000  # rows of a section


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _tag(t) == "t")


def _column(ref: str | None, last: int) -> int:
    """Column number of a cell reference such as AB12; the next one if there is none."""
    letters = re.match(r"[A-Z]+", ref or "")
    if not letters:
        return last + 1
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


class Workbook:
    def __init__(self, store, path: str):
        self.pack = zipfile.ZipFile(store.open_input_file(path))

    def sheets(self) -> list[tuple[int, str, str]]:
        """(number, name, part) in the workbook's order."""
        parts = {m: n for n in self.pack.namelist() for m in re.findall(r"^xl/(worksheets/[^/]+\.xml)$", n)}
        targets, names = {}, []
        if "xl/_rels/workbook.xml.rels" in self.pack.namelist():
            for _, e in iterparse(self.pack.open("xl/_rels/workbook.xml.rels")):
                if _tag(e) == "Relationship":
                    targets[e.get("Id")] = e.get("Target", "").removeprefix("/xl/")
        for _, e in iterparse(self.pack.open("xl/workbook.xml")):
            if _tag(e) == "sheet":
                names.append((e.get("name"), next((v for k, v in e.attrib.items() if k.endswith("}id")), None)))
        return [(i, name, parts[targets[r]]) for i, (name, r) in enumerate(names, 1) if targets.get(r) in parts]

    def strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.pack.namelist():
            return []
        out = []
        for _, e in iterparse(self.pack.open("xl/sharedStrings.xml")):
            if _tag(e) == "si":
                out.append(_text(e))
                e.clear()
        return out

    def rows(self, part: str) -> Iterator[tuple[int, list[str]]]:
        strings, at = self.strings(), 0
        for _, e in iterparse(self.pack.open(part)):
            if _tag(e) != "row":
                continue
            at = int(e.get("r") or at + 1)
            cells: list[str] = []
            for c in e:
                k = _column(c.get("r"), len(cells) - 1)
                value = next((v.text or "" for v in c if _tag(v) == "v"), "")
                value = strings[int(value)] if c.get("t") == "s" and value else _text(c) if c.get("t") == "inlineStr" else value
                cells += [""] * (k - len(cells)) + [value]
            if any(cells):
                yield at, cells
            e.clear()


@dataclass
class Sheet(InputPartition):
    path: str
    number: int
    name: str | None
    part: str | None
    error: str | None = None


class SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.folder)
        out: list[InputPartition] = []
        for path in sorted(listing(self.folder)):
            if path.lower().endswith(".xlsx"):
                try:
                    out += [Sheet(path, *s) for s in Workbook(store, f"{root}/{path}").sheets()]
                except Exception as e:  # a row with an error, not the end of the job
                    out.append(Sheet(path, 0, None, None, f"{type(e).__name__}: {e}"))
        return out or [Sheet("", 0, None, None)]

    def read(self, sheet: Sheet) -> Iterator[tuple]:
        if sheet.error:
            yield sheet.path, 0, None, None, None, sheet.error
        elif sheet.part:
            store, root = opened(self.folder)
            book = Workbook(store, f"{root}/{sheet.path}")
            for at, cells in book.rows(f"xl/{sheet.part.removeprefix('xl/')}"):
                yield sheet.path, sheet.number, sheet.name, at, cells, None


class Sheets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return SheetReader(self.options)


def table_sections(rows: DataFrame) -> DataFrame:
    """(doc_id, kind, page, caption, headers, rows): tables for ``section_chunks``, a section for each ``BLOCK`` rows under the sheet's first row.

    The caption is the sheet's name where the file has several sheets.
    """
    key = ["path", "sheet"]
    data = rows.where("cells IS NOT NULL")
    first = data.groupBy(*key).agg(F.min_by("cells", "row").alias("headers"), F.min("row").alias("first"), F.max("name").alias("name"))
    several = first.groupBy("path").agg(F.count(F.lit(1)).alias("sheets"))
    body = data.join(first.select(*key, "first"), key).where("row > first")
    blocks = body.groupBy(*key, F.floor(F.col("row") / BLOCK).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"))
    out = blocks.join(first, key).join(several, "path")
    return out.select(F.col("path").alias("doc_id"), F.lit("table").alias("kind"), F.col("sheet").alias("page"), F.when(F.col("sheets") > 1, F.col("name")).alias("caption"), "headers", "rows", "block")


def numeric_headers(rows: DataFrame) -> DataFrame:
    """(path, sheet, column, header): columns of which at least half of the data rows, and one, read as numbers."""
    key = ["path", "sheet"]
    data = rows.where("cells IS NOT NULL")
    first = data.groupBy(*key).agg(F.min_by("cells", "row").alias("headers"), F.min("row").alias("first"), (F.count(F.lit(1)) - 1).alias("n"))
    cells = data.join(first.select(*key, "first"), key).where("row > first").select(*key, F.posexplode("cells").alias("column", "cell"))
    good = cells.groupBy(*key, "column").agg(F.count(F.col("cell").try_cast("double")).alias("good"))
    return good.join(first, key).where((F.col("good") > 0) & (F.col("good") * 2 >= F.col("n")) & (F.col("column") < F.size("headers"))).select(*key, "column", F.get("headers", "column").alias("header"))


# ------------------------------------------------------------------ reports

def _pack(out, parts: dict[str, str], body: str, stream: Iterator[str]) -> None:
    """A zip with fixed ``parts`` and one part that is written as it comes."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
        with z.open(body, "w", force_zip64=True) as f:
            for piece in stream:
                f.write(piece.encode("utf-8", "replace"))


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_OFFICE = "http://schemas.openxmlformats.org"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\ud800-\udfff]")  # what XML 1.0 has no place for


def _plain(value) -> str:
    return escape(_CONTROL.sub("", "" if value is None else str(value)))


def _wrap(main: str, kind: str, more: dict[str, str]) -> dict[str, str]:
    types = "".join(f'<Override PartName="/{n}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for n, t in more.items())
    return {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_OFFICE}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_OFFICE}/package/2006/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument/2006/relationships/officeDocument" Target="{main}"/></Relationships>',
    }


def write_xlsx(out, columns: list[str], rows: Iterator[tuple]) -> None:
    def cell(v) -> str:
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{_plain(v)}</t></is></c>'

    def body() -> Iterator[str]:
        yield f'{_HEAD}<worksheet xmlns="{_OFFICE}/spreadsheetml/2006/main"><sheetData>'
        for r in ([columns], rows):
            for x in r:
                yield "<row>" + "".join(map(cell, x)) + "</row>"
        yield "</sheetData></worksheet>"

    parts = _wrap("xl/workbook.xml", "xlsx", {"xl/workbook.xml": "spreadsheetml.sheet.main", "xl/worksheets/sheet1.xml": "spreadsheetml.worksheet"})
    parts["xl/workbook.xml"] = f'{_HEAD}<workbook xmlns="{_OFFICE}/spreadsheetml/2006/main" xmlns:r="{_OFFICE}/officeDocument/2006/relationships"><sheets><sheet name="Report" sheetId="1" r:id="rId1"/></sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'{_HEAD}<Relationships xmlns="{_OFFICE}/package/2006/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
    _pack(out, parts, "xl/worksheets/sheet1.xml", body())


def write_docx(out, texts: Iterator[str | None]) -> None:
    def body() -> Iterator[str]:
        yield f'{_HEAD}<w:document xmlns:w="{_OFFICE}/wordprocessingml/2006/main"><w:body>'
        for text in texts:
            for line in (text or "").split("\n"):
                level = len(line) - len(line.lstrip("#"))
                style = f'<w:pPr><w:pStyle w:val="Heading{min(level, 6)}"/></w:pPr>' if level else ""
                yield f'<w:p>{style}<w:r><w:t xml:space="preserve">{_plain(line[level:].strip() if level else line)}</w:t></w:r></w:p>'
        yield "</w:body></w:document>"

    _pack(out, _wrap("word/document.xml", "docx", {"word/document.xml": "wordprocessingml.document.main"}), "word/document.xml", body())


@dataclass
class Written(WriterCommitMessage):
    name: str


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        self.path, self.kind, self.columns, self.overwrite = options["path"], options.get("kind", "xlsx"), columns, overwrite
        if self.kind not in ("xlsx", "docx"):
            raise ValueError("kind must be xlsx or docx")
        if self.kind == "docx" and "text" not in columns:
            raise ValueError("docx reports need a column text")
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, root = opened(self.path)
        store.create_dir(f"{root}/_pending/{self.job}", recursive=True)
        name = f"report-{self.job[:8]}-{uuid.uuid4().hex}.{self.kind}"
        with store.open_output_stream(f"{root}/_pending/{self.job}/{name}") as f:
            out = io.BufferedWriter(_Sink(f))
            if self.kind == "xlsx":
                write_xlsx(out, self.columns, (tuple(r) for r in rows))
            else:
                at = self.columns.index("text")
                write_docx(out, (r[at] for r in rows))
            out.flush()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        old = [p for p in listing(self.path) if p.endswith((".xlsx", ".docx"))] if self.overwrite else []
        for m in messages:
            if m is not None:
                store.move(f"{root}/_pending/{self.job}/{m.name}", f"{root}/{m.name}")
        for p in old:
            store.delete_file(f"{root}/{p}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = opened(self.path)
        if store.get_file_info(f"{root}/_pending/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_pending/{self.job}")


class _Sink(io.RawIOBase):
    """What zipfile and a buffer need of a stream that cannot seek."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)


class Reports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return "text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(self.options, schema.names, overwrite)

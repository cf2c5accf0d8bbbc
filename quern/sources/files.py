"""Folders of files: previews, supported types, and office documents as text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

#: Extensions by format.
FORMATS = {
    "PDF": "pdf", "Word": "doc docx odt rtf", "Spreadsheet": "xls xlsx xlsm xlsb ods csv tsv", "Presentation": "ppt pptx odp", "Text": "txt log", "Markdown": "md markdown mdx rst", "HTML": "html htm xhtml",
    "Code": "rs py js ts tsx jsx java go c h cpp hpp cs rb php swift kt scala sh bash sql r lua", "Data": "json jsonl yaml yml toml xml ini env",
}
BY_EXTENSION = {e: name for name, es in FORMATS.items() for e in es.split()}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def format_of(path: Column) -> Column:
    """The format by extension, else 'Other'."""
    table = F.create_map(*(F.lit(x) for kv in BY_EXTENSION.items() for x in kv))
    return F.coalesce(table[extension(path)], F.lit("Other"))


def supported(path: Column) -> Column:
    return extension(path).isin(*BY_EXTENSION)


def normal_path(path: Column, lower: bool = False) -> Column:
    p = F.translate(path, "\\", "/")
    return F.lower(p) if lower else p


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of a folder and those below; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def preview(files: DataFrame, seconds_each: float = 0.5) -> DataFrame:
    """Supported files, bytes and estimated seconds by format."""
    rows = files.where(supported(F.col("path"))).groupBy(format_of(F.col("path")).alias("format"))
    return rows.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).withColumn("seconds", F.col("files") * seconds_each)


def office_text(data: bytes, ext: str) -> str:
    """Text of docx, pptx and xlsx files: paragraphs, slides under a banner, rows of cells."""
    pack = zipfile.ZipFile(io.BytesIO(data))
    read = lambda n: pack.read(n).decode("utf-8", "replace")
    number = lambda n: int(re.findall(r"(\d+)\.xml$", n)[0])
    runs = lambda xml, tag: unescape("".join(re.findall(rf"<{tag}(?: [^>]*)?>([^<]*)</{tag}>", xml)))
    if ext == "docx":
        lines = (runs(p, "w:t") for p in re.split(r"</w:p>", read("word/document.xml")))
        return "\n".join(x for x in lines if x)
    if ext == "pptx":
        slides = sorted((n for n in pack.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
        texts = ("\n".join(x for x in (runs(p, "a:t") for p in re.split(r"</a:p>", read(n))) if x) for n in slides)
        return "\n\n".join(f"--- Slide {number(n)} ---\n{t}" for n, t in zip(slides, texts, strict=True) if t)
    if ext == "xlsx":
        shared = [runs(x, "t") for x in re.findall(r"<si>(.*?)</si>", read("xl/sharedStrings.xml"), re.S)] if "xl/sharedStrings.xml" in pack.namelist() else []
        sheets = sorted((n for n in pack.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=number)
        out = []
        for n in sheets:
            rows = []
            for row in re.findall(r"<row\b[^>]*>(.*?)</row>", read(n), re.S):
                cells = []
                for attrs, body in re.findall(r"<c\b([^>]*?)(?:/>|>(.*?)</c>)", row, re.S):
                    value = runs(body, "v") or runs(body, "t")
                    cells.append(shared[int(value)] if 't="s"' in attrs and value else value)
                if any(cells):
                    rows.append(" | ".join(cells))
            out += [f"=== Sheet {number(n)} ==="] * (len(sheets) > 1) + rows
        return "\n".join(out)
    raise ValueError(f"no reader for {ext}")


def _file_text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(path, content) to text; a file that cannot be read gives its error and no text."""
    for paths, contents in parts:
        out = []
        for path, data in zip(paths, contents, strict=True):
            ext = path.rsplit(".", 1)[-1].lower()
            try:
                out.append((office_text(data, ext) if ext in ("docx", "pptx", "xlsx") else data.decode("utf-8", "replace"), None))
            except Exception as e:  # one bad file is a row with an error, not the end of the job
                out.append((None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=["text", "error"])


def file_text(path: Column, content: Column) -> Column:
    return pandas_udf(_file_text, "struct<text:string,error:string>")(path, content)


def ingest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, format, length, text, error) of the supported files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(supported(F.col("path")))
    return files.select("path", format_of(F.col("path")).alias("format"), "length", file_text(F.col("path"), F.col("content")).alias("x")).select("path", "format", "length", "x.text", "x.error")


def numeric_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, numeric): at least half of all rows, and one, read as numbers."""
    n = F.count(F.lit(1))
    good = rows.agg(n.alias("n"), *(F.count(F.col(c).cast("string").try_cast("double")).alias(c) for c in columns))
    return good.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), ((F.col(c) > 0) & (F.col(c) * 2 >= F.col("n"))).alias("numeric")) for c in columns))).alias("x")).select("x.*")

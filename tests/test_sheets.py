import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.operators import chunking
from quern.sources import files, sheets as S


@pytest.fixture
def sources(spark):
    spark.dataSource.register(S.Sheets)
    spark.dataSource.register(S.Reports)
    return spark


def test_xlsx_written_and_read_again(sources, tmp_path):
    spark, folder = sources, f"file://{tmp_path}/r"
    rows = [(i, f"n & <{i}>", None if i % 3 else i / 4) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, name string, x double").repartition(3)
    df.write.format("reports").option("kind", "xlsx").mode("append").save(folder)
    got = spark.read.format("sheets").load(folder)
    assert got.select("path").distinct().count() == 3 and got.where("error IS NOT NULL").isEmpty()
    data = [tuple(r.cells) for r in got.where("row > 1").collect()]
    assert sorted(data, key=lambda r: int(r[0])) == [(str(i), n, "" if x is None else repr(x)) for i, n, x in rows]
    assert {(r.header) for r in S.numeric_headers(got).collect()} <= {"k", "x"} and {r.header for r in S.numeric_headers(got).collect()} >= {"k"}
    sections = S.table_sections(got)
    assert sections.agg(F.sum(F.size("rows"))).head()[0] == 50 and sections.select("headers").distinct().head().headers == ["k", "name", "x"]
    none = {"fields": "array<struct<k:string,v:string>>", "heading": "string", "content": "string"}
    chunks = chunking.section_chunks(sections.withColumns({n: F.lit(None).cast(t) for n, t in none.items()}))
    assert chunks.where(~F.col("text").startswith("| k | name | x |\n")).isEmpty() and chunks.count() >= 3
    df.limit(2).coalesce(1).write.format("reports").mode("overwrite").save(folder)
    assert spark.read.format("sheets").load(folder).where("row > 1").count() == 2


def test_docx_written_and_read_again(sources, tmp_path):
    spark, folder = sources, f"file://{tmp_path}/d"
    spark.createDataFrame([("# Title\nline one & two",), (None,), ("end\x01",)], "text string").coalesce(1).write.format("reports").option("kind", "docx").mode("append").save(folder)
    text = files.ingest(spark, folder).head().text
    assert text == "Title\nline one & two\nend"
    with pytest.raises(Exception):
        spark.range(1).write.format("reports").option("kind", "docx").mode("append").save(folder)


def test_a_failed_job_leaves_nothing(sources, tmp_path):
    spark, folder = sources, f"file://{tmp_path}/f"
    bad = spark.range(10, numPartitions=2).select(F.when(F.col("id") < 9, F.lit("x")).otherwise(F.raise_error(F.lit("no"))).alias("text"))
    with pytest.raises(Exception):
        bad.write.format("reports").mode("append").save(folder)
    assert S.listing(folder) == {} and spark.read.format("sheets").load(folder).count() == 0


def test_shared_strings_gaps_several_sheets_and_a_broken_file(sources, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="urn:x"><sheets><sheet name="B side" r:id="r2"/><sheet name="A" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>he</t><r><t>ad</t></r></si><si><t>v</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>7</v></c></row><row r="3"><c r="B3"/></row><row r="4"><c r="AA4" t="s"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    (tmp_path / "a.xlsx").write_bytes(data.getvalue())
    (tmp_path / "b.xlsx").write_bytes(b"not a zip")
    got = sources.read.format("sheets").load(f"file://{tmp_path}")
    assert got.rdd.getNumPartitions() == 3
    rows = sorted((r.path, r.sheet, r.name, r.row, r.cells) for r in got.where("error IS NULL").collect())
    assert rows == [("a.xlsx", 2, "A", 2, ["head", "", "7"]), ("a.xlsx", 2, "A", 4, [""] * 26 + ["v"])]
    assert [r.path for r in got.where("error IS NOT NULL").collect()] == ["b.xlsx"]

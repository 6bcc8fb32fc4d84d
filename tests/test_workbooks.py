"""Workbooks: what is written is read again, locks and choices are there, nothing half-done shows, and others' files are read."""

import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import workbooks

ODD = ["plain", "", None, " two  spaces ", "a<b>&\"'", "line\nfeed\ttab", "\r\n\x0b\x01 odd", "_x0041_ literal", "é 漢 \U0001f600", "n/a", "x" * 40_000]


def rows_of(n=40):
    return [(str(i), ODD[i % len(ODD)], ODD[(i * 7 + 3) % len(ODD)], [None, "n/a", "yes"][i % 3]) for i in range(n)]


SCHEMA = "id string, a string, b string, PC string"


def test_round_trip(spark, tmp_path):
    workbooks.register(spark)
    path = f"file://{tmp_path}/out"
    d = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    d.write.format("workbook").option("unlocked", "PC").option("choices", '{"PC": ["yes", "no"]}').option("rows", 5).mode("append").save(path)
    files = [p for p in (tmp_path / "out").iterdir()]
    assert len(files) >= 8 and all(p.suffix == ".xlsx" for p in files)
    assert sorted(map(tuple, spark.read.format("workbook").schema(SCHEMA).load(path).collect()), key=str) == sorted(rows_of(), key=str)
    # Other columns, in another order.
    assert sorted(r["b"] or "" for r in spark.read.format("workbook").schema("b string").load(path).collect()) == sorted(r[2] or "" for r in rows_of())
    cells = spark.read.format("workbook").option("cells", "true").load(path)
    got = {(r["name"], r["locked"]): r["n"] for r in cells.groupBy("name", "locked").agg(F.count("*").alias("n")).collect()}
    assert got[("PC", True)] == sum(r[3] == "n/a" for r in rows_of()) and got[("PC", False)] == sum(r[3] != "n/a" for r in rows_of())
    assert ("a", False) not in got and got[("a", True)] == sum(r[1] is not None for r in rows_of())
    with zipfile.ZipFile(files[0]) as z:
        assert z.testzip() is None
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    assert sheet.find(f"{{{workbooks.MAIN}}}sheetProtection").get("sheet") == "1"
    assert sheet.find(f".//{{{workbooks.MAIN}}}formula1").text == '"yes,no"'
    # Appended, and written anew.
    d.limit(4).write.format("workbook").mode("append").save(path)
    assert spark.read.format("workbook").schema(SCHEMA).load(path).count() == 44
    d.limit(4).write.format("workbook").mode("overwrite").save(path)
    assert spark.read.format("workbook").schema(SCHEMA).load(path).count() == 4
    d.limit(0).write.format("workbook").mode("overwrite").save(path)
    assert spark.read.format("workbook").schema(SCHEMA).load(path).count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    workbooks.register(spark)
    path = f"file://{tmp_path}/out"
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 35, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("workbook").mode("append").save(path)
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="no column"):
        spark.createDataFrame([("1",)], "id string").write.format("workbook").option("unlocked", "zz").mode("append").save(path)
    spark.createDataFrame([("1",)], "id string").write.format("workbook").mode("append").save(path)
    with pytest.raises(Exception, match="no column"):
        spark.read.format("workbook").schema("other string").load(path).collect()


def test_files_of_others(tmp_path):
    """Shared strings in runs, numbers, truth values, cells without a reference, and rows that are missing."""
    path = tmp_path / "other.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbooks.MAIN}"><si><t>id</t></si><si><r><t>la</t></r><r><t>bel</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{workbooks.MAIN}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="4"><c t="n"><v>7.5</v></c><c t="b"><v>1</v></c></row><row><c r="B5" t="str"><v>formula</v></c><c r="AB5"><v>3</v></c></row></sheetData></worksheet>')
    assert list(workbooks.cells(str(path))) == [(1, 0, "id", True), (1, 1, "label", True), (4, 0, "7.5", True), (4, 1, "1", True), (5, 1, "formula", True), (5, 27, "3", True)]
    assert [workbooks._number(workbooks._column(n)) for n in (0, 25, 26, 701, 702, 16383)] == [0, 25, 26, 701, 702, 16383]

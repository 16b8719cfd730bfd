"""Workbooks written by tasks and read back."""

import pathlib
import zipfile

import pytest
from pyspark.sql import functions as F

from pricebook.sources.workbook_writer import write_workbooks
from pricebook.sources.workbooks import read_workbook_rows

SCHEMA = "path string, sheet_no int, sheet string, row int, cells array<string>, other int"


def back(spark, folder):
    got = read_workbook_rows(spark, str(folder))
    name = F.regexp_extract("path", r"/out dir/(.*)$", 1)
    return sorted((r.p, r.sheet_no, r.sheet, r.row, r.cells, r.error) for r in got.withColumn("p", name).collect())


def test_round_trip(spark, tmp_path):
    out = tmp_path / "out dir"
    odd = ["", " a  b ", "<&\"'>", "é€漢😀", "x\r\ny\tz", None, "12,5", ""]
    rows = [("a/één.xlsx", 0, "Lot <1> & \"2\"", 3, odd, 1), ("a/één.xlsx", 0, "Lot <1> & \"2\"", 1, ["first"], 1), ("a/één.xlsx", 2, "Lot 2", 0, ["x", "y"], 1),
            ("a/één.xlsx", 2, "Lot 2", 1048575, ["last"], 1), ("b.xlsx", None, None, 0, ["bad \x07 char"], 1), ("b.xlsx", None, None, 4, None, 1),
            ("b.xlsx", None, None, 5, ["", ""], 1), ("c.xlsx", 0, "S", 0, ["é" * 200_000], 1)]
    done = write_workbooks(spark.createDataFrame(rows, SCHEMA).repartition(5), str(out))
    assert sorted(map(tuple, done.collect())) == [("a/één.xlsx", 2, 4), ("b.xlsx", 1, 3), ("c.xlsx", 1, 1)]
    assert back(spark, out) == sorted([
        ("a/één.xlsx", 0, "Lot <1> & \"2\"", 1, ["first"], None), ("a/één.xlsx", 0, "Lot <1> & \"2\"", 3, [c or "" for c in odd], None),
        ("a/één.xlsx", 1, "Lot 2", 0, ["x", "y"], None), ("a/één.xlsx", 1, "Lot 2", 1048575, ["last"], None),
        ("b.xlsx", 0, "Feuille", 0, ["bad � char"], None), ("c.xlsx", 0, "S", 0, ["é" * 200_000], None)])
    with zipfile.ZipFile(out / "b.xlsx") as z:
        assert z.testzip() is None and {"[Content_Types].xml", "_rels/.rels", "xl/workbook.xml"} <= set(z.namelist())


def test_one_workbook_over_many_batches(spark, tmp_path):
    rows = spark.range(60_000).select(F.lit("big.xlsx").alias("path"), (F.col("id") % 3).cast("int").alias("sheet_no"), (F.col("id") % 3).cast("string").alias("sheet"),
                                      F.floor(F.col("id") / 3).cast("int").alias("row"), F.array(F.col("id").cast("string")).alias("cells"))
    write_workbooks(rows.unionByName(rows.withColumn("path", F.lit("twin.xlsx"))), str(tmp_path / "out dir"))
    got = read_workbook_rows(spark, str(tmp_path / "out dir"))
    assert got.filter("error is null and cells[0] = cast(row * 3 + sheet_no as string)").count() == got.count() == 120_000


@pytest.mark.parametrize("rows", [[("a.xlsx", 0, "s", 0, ["x"], 1)] * 2, [("a.xlsx", 0, "s", 1048576, ["x"], 1)], [(None, 0, "s", 0, ["x"], 1)],
                                  [("a.xlsx", 0, "s", None, ["x"], 1)]])
def test_impossible_rows_leave_no_workbook(spark, tmp_path, rows):
    with pytest.raises(Exception, match="twice|more rows|has no"):
        write_workbooks(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out dir"))
    assert not list(pathlib.Path(tmp_path).rglob("*.xlsx"))


def test_written_again_and_empty(spark, tmp_path):
    out = str(tmp_path / "out dir")
    for text in ("old", "new"):
        write_workbooks(spark.createDataFrame([("a.xlsx", 0, "s", 0, [text], 1)], SCHEMA), out)
    assert back(spark, out) == [("a.xlsx", 0, "s", 0, ["new"], None)]
    assert write_workbooks(spark.createDataFrame([], SCHEMA), out).count() == 0

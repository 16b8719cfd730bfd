"""Workbooks to rows: binary files read by Spark, zip/XML decoded in Arrow batches."""

import functools
import gc
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.operators.scale import hash_id

MAX_SHEET_ROWS = 1048576        # row limit of the file format
WHOLE = 16 << 20                # bytes of XML up to which a sheet is parsed as one tree
ROW_SCHEMA = "path string, sheet_no int, sheet string, row int, cells array<string>, error string"
NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROW, C, T, V = (NS + x for x in ("row", "c", "t", "v"))
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@functools.lru_cache(4096)
def _column(ref):
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _texts(node):
    return "".join(t.text or "" for t in node.iter(T))


def _value(cell, shared):
    kind = cell.get("t")
    if kind == "inlineStr":
        # nearly always one text in one string
        if len(cell) == 1 and len(one := cell[0]) == 1 and one.tag != T and (t := one[0]).tag == T and not len(t):
            return t.text or ""
        return _texts(cell)
    v = cell.find(V)
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind in ("str", "e"):
        return v.text
    number = float(v.text)
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def _row_elements(z, part):
    """The row elements of a sheet: of the whole tree where it is small, else as they come."""
    if z.getinfo(part).file_size <= WHOLE:
        collects = gc.isenabled()
        gc.disable()                # a tree holds no cycles, but many objects to look through
        try:
            with z.open(part) as f:
                tree = ET.parse(f)
        except ET.ParseError:
            pass                    # the rows before the error are still wanted
        else:
            yield from tree.iter(ROW)
            return
        finally:
            if collects:
                gc.enable()
    with z.open(part) as f:
        for _, el in ET.iterparse(f):
            if el.tag == ROW:
                yield el
                el.clear()


def sheet_rows(content, max_rows=None):
    """(sheet number, sheet name, 0-based row, cells) of every filled row of an xlsx file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, el in ET.iterparse(f):
                    if el.tag == NS + "si":
                        shared.append(_texts(el))
                        el.clear()
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for no, s in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(NS + "sheet")):
            target = rels[s.get(REL)]
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
            row_no = -1
            for el in _row_elements(z, part):
                row_no = int(el.get("r")) - 1 if el.get("r") else row_no + 1
                if max_rows is not None and row_no >= max_rows:
                    break
                if row_no >= MAX_SHEET_ROWS:
                    raise ValueError(f"sheet {s.get('name')} has more rows than the file format allows")
                cells = []
                for c in el.iter(C):
                    at = _column(ref) if (ref := c.get("r")) else len(cells)
                    if at > len(cells):
                        cells.extend([""] * (at - len(cells)))
                    cells.append(_value(c, shared))
                if any(cells):
                    yield no, s.get("name"), row_no, cells


def _decode(max_rows, batch_rows=5000):
    types = {"path": pa.string(), "sheet_no": pa.int32(), "sheet": pa.string(), "row": pa.int32(), "cells": pa.list_(pa.string()), "error": pa.string()}

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.values())], names=list(types))

    def run(batches):
        for files in batches:
            for path, content in zip(files.column("path"), files.column("content")):
                path, content, out = path.as_py(), content.as_py(), []
                try:
                    if path.lower().endswith(".xls"):
                        raise ValueError("legacy .xls workbook is not supported")
                    for no, sheet, row, cells in sheet_rows(content, max_rows):
                        out.append((path, no, sheet, row, cells, None))
                        if len(out) >= batch_rows:
                            yield batch(out)
                            out = []
                except Exception as e:          # one unreadable file gives one error row
                    out.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
                if out:
                    yield batch(out)
    return run


def read_workbook_rows(spark, path, max_rows=None) -> DataFrame:
    """All sheets of all workbooks below a folder, one row per sheet row; unreadable files keep an error.

    A workbook is the unit of one task; which sizes are wanted is a rule of the listing, not of the reader.
    """
    return decode_workbooks(spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                            .option("pathGlobFilter", "*.{xlsx,xlsm,xls}").load(path), max_rows)


def decode_workbooks(files: DataFrame, max_rows=None) -> DataFrame:
    """The same for a table or stream of files (path, content)."""
    return files.select("path", "content").mapInArrow(_decode(max_rows), ROW_SCHEMA).withColumn("file_id", hash_id("path"))


def read_workbook_cells(spark, path, max_rows=None) -> DataFrame:
    """Long form of the filled cells: text and, where it is plain, its number."""
    from pricebook.functions.scalars import to_double
    r = read_workbook_rows(spark, path, max_rows).filter("error is null")
    return (r.select("file_id", "path", "sheet_no", "sheet", "row", F.posexplode("cells").alias("col", "text"))
            .filter("text <> ''").withColumn("num", to_double(F.col("text"))))

"""Rows to workbooks: the way back of ``workbooks.read_workbook_rows``.

Rows are brought together by workbook and sorted by sheet and row, then each task streams its workbooks one after the
other into the shared folder: memory holds one Arrow batch, whatever a workbook's size. A workbook is written beside its
place and moved there when complete, so a repeated task leaves the same files and readers never see half of one.
"""

import re
import uuid
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.operators.scale import staged
from pricebook.sources.workbooks import MAX_SHEET_ROWS

WRITTEN = "path string, sheets int, rows long"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006"
FORMAT = "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")     # characters that XML cannot hold


MARKED = re.compile("[&<>\r]|" + NOT_XML.pattern)
LEVEL, HELD = 1, 1 << 18        # compression and bytes held before they are compressed


def _text(value):
    if not value or not MARKED.search(value):
        return value or ""
    return escape(NOT_XML.sub("�", value or ""), {"\r": "&#13;"})


class _Workbook:
    """One workbook being written: sheets in order, each streamed into its part of the archive."""

    def __init__(self, store, path):
        self.store, self.path, self.draft = store, path, f"{path}.{uuid.uuid4().hex}.part"
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(self.draft)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED, compresslevel=LEVEL)
        self.names, self.part, self.rows, self.last = [], None, 0, -1
        self.held, self.size = [], 0

    def sheet(self, name):
        self._end_sheet()
        self.names.append(name)
        self.last = -1
        self.part = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
        self.part.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())

    def row(self, no, cells):
        if no >= MAX_SHEET_ROWS:
            raise ValueError(f"sheet {self.names[-1]} has more rows than the file format allows")
        if no <= self.last:
            raise ValueError(f"row {no} of sheet {self.names[-1]} of {self.path} stands twice or before the first row")
        self.last = no
        text = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{_text(c)}</t></is></c>' for c in cells)
        self.held.append(f'<row r="{no + 1}">{text}</row>')
        self.size += len(self.held[-1])
        self.rows += 1
        if self.size >= HELD:
            self._put()

    def _put(self):
        self.part.write("".join(self.held).encode())
        self.held, self.size = [], 0

    def _end_sheet(self):
        if self.part:
            self._put()
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()

    def close(self):
        self._end_sheet()
        no = range(1, len(self.names) + 1)
        kinds = [("/xl/workbook.xml", "sheet.main+xml")] + [(f"/xl/worksheets/sheet{i}.xml", "worksheet+xml") for i in no]
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{DOC}"><sheets>' + "".join(
                f'<sheet name={quoteattr(NOT_XML.sub("�", n))} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(no, self.names)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PKG}/relationships">' + "".join(
                f'<Relationship Id="rId{i}" Type="{DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in no) + "</Relationships>",
            "_rels/.rels": f'<Relationships xmlns="{PKG}/relationships"><Relationship Id="rId1" Type="{DOC}/officeDocument" '
                           'Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-'
                                   'package.relationships+xml"/>' + "".join(
                f'<Override PartName="{p}" ContentType="{FORMAT}.{k}"/>' for p, k in kinds) + "</Types>",
        }
        for name, xml in parts.items():
            self.zip.writestr(name, HEAD + xml)
        self.zip.close()
        self.out.close()
        self.store.move(self.draft, self.path)
        return self.path, len(self.names), self.rows


def _write(folder):
    def run(batches):
        remote = re.match(r"[a-z0-9]+://", folder) and not folder.startswith("file:")
        store, base = fs.FileSystem.from_uri(folder) if remote else (fs.LocalFileSystem(), re.sub(r"^file:/+", "/", folder))
        book, at, sheet = None, None, None
        for pdf in batches:
            done = []
            for path, no, name, row, cells in zip(pdf["path"], pdf["sheet_no"], pdf["sheet"], pdf["row"], pdf["cells"]):
                if path != at:
                    if book:
                        done.append((at, *book.close()[1:]))
                    book, at, sheet = _Workbook(store, f"{base}/{path}"), path, None
                if (no, name) != sheet:
                    book.sheet(name)
                    sheet = no, name
                book.row(row, cells)
            yield pd.DataFrame(done, columns=["path", "sheets", "rows"])
        if book:
            yield pd.DataFrame([(at, *book.close()[1:])], columns=["path", "sheets", "rows"])
    return run


def write_workbooks(rows: DataFrame, folder: str) -> DataFrame:
    """Write (path below ``folder``, sheet_no, sheet, row, cells) as workbooks; the table of those written.

    Every cell is a text cell. Null cells and null lists are empty; a character that XML cannot hold becomes U+FFFD;
    rows without a path or a row number raise; two rows at one place, or rows beyond the format's limit, raise too, and
    a workbook that raised is not there. ``folder`` is a path or URI that executors can write to (local, HDFS, S3).
    """
    need = [F.coalesce(c, F.raise_error(F.lit(f"a row has no {c}"))).alias(c) for c in ("path", "row")]
    cells = F.coalesce("cells", F.array().cast("array<string>"))
    r = rows.select(need[0], F.coalesce("sheet_no", F.lit(0)).cast("int").alias("sheet_no"),
                    F.coalesce("sheet", F.lit("Feuille")).alias("sheet"), need[1].cast("long").alias("row"), cells.alias("cells"))
    laid = r.repartition("path").sortWithinPartitions("path", "sheet_no", "sheet", "row")
    return staged(laid.mapInPandas(_write(folder), WRITTEN), "written-workbooks")

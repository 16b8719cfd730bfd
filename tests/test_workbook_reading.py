"""Sheets parsed as one tree give what parsing row by row gives, and rows before an error are kept."""

import io
import zipfile

import pytest

from pricebook.sources import workbook_writer as W
from pricebook.sources import workbooks as B

PARTS = {
    "xl/workbook.xml": f'<workbook xmlns="{W.MAIN}" xmlns:r="{W.DOC}"><sheets><sheet name="S" r:id="a"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{W.PKG}/relationships"><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>',
    "xl/sharedStrings.xml": f'<sst xmlns="{W.MAIN}"><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>',
}
ROWS = (
    '<row r="2"><c r="B2" t="s"><v>1</v></c><c r="D2"><v>2.50</v></c></row><row><c t="b"><v>1</v></c><c t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>'
    '<row r="9"><c r="A9" t="inlineStr"><is><t>x &amp; y</t></is></c><c r="AB9" t="str"><v>z</v></c></row><row r="10"><c/></row>'
)


def book(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in PARTS.items():
            z.writestr(name, xml)
        z.writestr("xl/worksheets/s.xml", f'<x:worksheet xmlns:x="{W.MAIN}" xmlns="{W.MAIN}"><sheetData>{rows}</sheetData></x:worksheet>')
    return out.getvalue()


@pytest.mark.parametrize("whole", [B.WHOLE, 0])
def test_rows_of_a_sheet(monkeypatch, whole):
    monkeypatch.setattr(B, "WHOLE", whole)
    trees = []
    monkeypatch.setattr(B.ET, "iterparse", lambda f, at=B.ET.iterparse: trees.append(f.name) or at(f))
    got = [r[2:] for r in B.sheet_rows(book(ROWS))]
    assert got == [(1, ["", "two", "", "2.5"]), (2, ["True", "ab"]), (8, ["x & y", *[""] * 26, "z"])]
    assert ("xl/worksheets/s.xml" in trees) == (whole == 0)
    assert [r[2] for r in B.sheet_rows(book(ROWS), 5)] == [1, 2]
    rows, seen = B.sheet_rows(book(ROWS + "<row><c></row>")), []
    with pytest.raises(B.ET.ParseError):
        for r in rows:
            seen.append(r[2])
    assert seen == [1, 2, 8]


def test_rows_are_written_in_blocks(tmp_path, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(W, "HELD", 1500)
    cells = [[f"a{i} < b & c", None, "d\re", "\x01", ""] for i in range(20)]
    pdf = pd.DataFrame({"path": ["k/1.xlsx"] * 20, "sheet_no": [0] * 12 + [1] * 8, "sheet": ["A"] * 12 + ["B"] * 8, "row": range(20), "cells": cells})
    puts = []
    monkeypatch.setattr(W._Workbook, "_put", lambda self, put=W._Workbook._put: puts.append(1) or put(self))
    done = pd.concat(W._write(str(tmp_path))(iter([pdf])))
    assert done.values.tolist() == [["k/1.xlsx", 2, 20]] and 2 < len(puts) < 20
    got = list(B.sheet_rows((tmp_path / "k/1.xlsx").read_bytes()))
    assert [(r[1], r[2]) for r in got] == [("A" if i < 12 else "B", i) for i in range(20)]
    assert [r[3] for r in got] == [[f"a{i} < b & c", "", "d\re", "\ufffd", ""] for i in range(20)]

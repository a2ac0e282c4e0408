"""Rows as files that other tools open: a JSON array or a spreadsheet for each document, as (doc_id, n, content) tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import questions

#: Rows of a sheet, its heading included, in the spreadsheet format.
MAX_ROWS = 1 << 20

_NS = "http://schemas.openxmlformats.org"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_NS}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="rId1" Type="{_NS}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="rId1" Type="{_NS}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
    f'<Relationship Id="rId2" Type="{_NS}/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    # cell styles: 0 plain, 1 heading (bold, white on blue, centred), 2 shaded
    "xl/styles.xml": f'<styleSheet xmlns="{_NS}/spreadsheetml/2006/main"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/></font></fonts>'
    '<fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF1E3A5F"/></patternFill></fill>'
    '<fill><patternFill patternType="solid"><fgColor rgb="FFF4F6F8"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="3"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center" vertical="center"/></xf><xf fillId="3" applyFill="1"/></cellXfs></styleSheet>',
}


def _cell(value: object, style: int) -> str:
    if value is None:
        return f'<c s="{style}"/>'
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c s="{style}"><v>{value}</v></c>'
    return f'<c s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(head: list[str], rows: Iterable[tuple], widths: list[int], sheet: str) -> bytes:
    """One sheet with a styled heading and every other row shaded; written row by row."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(zipfile.ZipInfo(name), text)
        z.writestr(
            zipfile.ZipInfo("xl/workbook.xml"),
            f'<workbook xmlns="{_NS}/spreadsheetml/2006/main" xmlns:r="{_NS}/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        sheet1 = zipfile.ZipInfo("xl/worksheets/sheet1.xml")  # without a time: equal rows give equal bytes
        sheet1.compress_type = zipfile.ZIP_DEFLATED
        with z.open(sheet1, "w") as f:
            cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
            f.write(f'<worksheet xmlns="{_NS}/spreadsheetml/2006/main"><cols>{cols}</cols><sheetData><row r="1" ht="22" customHeight="1">{"".join(_cell(h, 1) for h in head)}</row>'.encode())
            for r, row in enumerate(rows, 2):
                if r > MAX_ROWS:
                    raise ValueError(f"a sheet holds {MAX_ROWS} rows")
                f.write(f'<row r="{r}">{"".join(_cell(v, 0 if r % 2 else 2) for v in row)}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def kahoot_workbooks(rows: DataFrame) -> DataFrame:
    """(doc_id, n, content): a spreadsheet of each document's questions in order; rows as for questions.kahoot.

    The questions of one document are one task's work; more than a sheet holds is an error. No rows give no spreadsheet.
    """
    import pandas as pd

    table = questions.kahoot(rows)
    head = [c for c in table.columns if c not in ("doc_id", "ord")]

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        cells = pdf[head].astype(object).where(pdf[head].notna(), None).itertuples(index=False, name=None)
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "n": [len(pdf)], "content": [workbook(head, cells, [60, 30, 30, 30, 30, 18, 16], "Kahoot MCQ")]})

    return table.groupBy("doc_id").applyInPandas(make, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, n long, content binary")


def json_arrays(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, n, content): the named columns of each document's rows, by ord, as one JSON array. Nulls are written as null."""
    one = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    listed = F.array_sort(F.collect_list(F.struct("ord", one.alias("j"))))
    out = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), listed.alias("x"))
    return out.select("doc_id", "n", F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["j"]), ","), F.lit("]")).alias("content"))


def write_json(rows: DataFrame, path: str) -> None:
    """All rows as lines of JSON; nulls are written as null."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)

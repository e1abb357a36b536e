"""Sheets of Excel workbooks (xlsx): one task a sheet, rows read one after another from the archive.

A workbook is a zip archive of XML parts. The tasks first list the sheets of each workbook; the sheets are then dealt out,
and a task reads its sheet row by row. What it holds besides is the workbook's table of texts, which the format keeps apart.
"""

from __future__ import annotations

import datetime
import itertools
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from . import files

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Number formats of the file format that stand for dates and times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
#: Rows handed on at a time.
BATCH = 1000


def sheets(book: zipfile.ZipFile) -> list[str]:
    """The parts of a workbook's sheets, in their order."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    at = [rels[s.get(_REL)] for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
    return [x.lstrip("/") if x.startswith("/") else f"xl/{x}" for x in at]


def texts(book: zipfile.ZipFile) -> list[str]:
    """The workbook's shared texts."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, item in ElementTree.iterparse(f):
            if item.tag == f"{_MAIN}si":
                out.append(_text(item))
                item.clear()
    return out


def _text(item: ElementTree.Element) -> str:
    """The text of an item, its formatted pieces joined, without phonetic notes."""
    runs = [t.text or "" for t in item.findall(f"{_MAIN}t")] + [t.text or "" for r in item.findall(f"{_MAIN}r") for t in r.findall(f"{_MAIN}t")]
    return "".join(runs)


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """The numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode", "")) for x in root.iter(f"{_MAIN}numFmt")}
    dated = DATE_FORMATS | {k for k, code in own.items() if re.search("[ymdhs]", code, re.I) and code != "General"}
    cells = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in dated}


def _column(reference: str) -> int:
    """The number of a cell's column from 0 (B7 is 1)."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int], epoch: datetime.datetime):
    kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        inside = cell.find(f"{_MAIN}is")
        return _text(inside) if inside is not None else None
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text.strip() == "1"
    if kind != "n":  # text of a formula, an error, a date as text
        return v.text
    x = float(v.text)
    if int(cell.get("s", 0)) in dates:
        return str(epoch + datetime.timedelta(seconds=round(x * 86_400)))
    return int(x) if x.is_integer() and not re.search("[.eE]", v.text) else x


def rows_of(book: zipfile.ZipFile, part: str) -> Iterator[list]:
    """The values of each row of a sheet, gaps as None."""
    shared, dates = texts(book), date_styles(book)
    late = re.search(rb'date1904="(1|true)"', book.read("xl/workbook.xml"))
    epoch = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30)
    with book.open(part) as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{_MAIN}row":
                continue
            out: list = []
            for i, cell in enumerate(row.findall(f"{_MAIN}c")):
                at = _column(cell.get("r")) if cell.get("r") else i
                out += [None] * (at - len(out))
                out[at : at + 1] = [_value(cell, shared, dates, epoch)]
            row.clear()
            yield out


def records(book: zipfile.ZipFile, part: str) -> Iterator[str]:
    """The rows below a sheet's first as JSON objects under its names; a column without one is col<number>."""
    it = rows_of(book, part)
    top = [c if c is not None else f"col{i}" for i, c in enumerate(next(it, ()))]
    for r in it:
        if any(c is not None for c in r):
            names = top + [f"col{i}" for i in range(len(top), len(r))]
            yield json.dumps(dict(zip(map(str, names), r + [None] * (len(top) - len(r)))), ensure_ascii=False)


def read_sheets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_name, record_index, raw): the rows of every sheet of the workbooks, numbered over a workbook's sheets."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for p in b.column(0).to_pylist():
                with zipfile.ZipFile(files.opened(p, seek=True)) as book:
                    found += [(p, i, s) for i, s in enumerate(sheets(book))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["path", "sheet", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, sheet, part in zip(*(c.to_pylist() for c in b.columns)):
                with zipfile.ZipFile(files.opened(p, seek=True)) as book:
                    held, at = [], 0
                    for raw in records(book, part):
                        held.append(raw)
                        if len(held) == BATCH:
                            yield made(p, sheet, at, held)
                            held, at = [], at + BATCH
                    if held:
                        yield made(p, sheet, at, held)

    def made(p: str, sheet: int, at: int, held: list[str]) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([p] * n), pa.array([sheet] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array(held)], ["path", "sheet", "i", "raw"])

    listed = files.listed(spark, path).select("path").mapInArrow(plan, "path string, sheet int, part string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = listed.repartition(n, "path", "sheet").mapInArrow(read, "path string, sheet int, i bigint, raw string")
    rows = written(rows, "workbook-rows")
    before = F.sum("n").over(Window.partitionBy("path").orderBy("sheet").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("path", "sheet").agg(F.count("*").alias("n")).select("path", "sheet", F.coalesce(before, F.lit(0)).alias("start"))
    out = rows.join(starts, ["path", "sheet"])  # a row for each sheet on the right
    return out.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_name"), (F.col("i") + F.col("start")).alias("record_index"), "raw")


#: The parts of a workbook besides its sheets.
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def write_sheets(df: DataFrame, path: str, sheet_rows: int = 100_000) -> list[str]:
    """Writes the rows as workbooks below path, one for each task with a sheet for every sheet_rows rows, and names the files.

    A file of a task that was lost and run again is not among the names.
    """
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        first = next(rows, None)
        if first is None:
            return
        at, n = f"{path.rstrip('/')}/part-{uuid.uuid4().hex}.xlsx", 0
        head = "".join(_cell(c) for c in names)
        with files.created(at) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            rows = itertools.chain([first], rows)
            while chunk := list(itertools.islice(rows, sheet_rows)):
                with book.open(f"xl/worksheets/sheet{n}.xml", "w") as sheet:
                    sheet.write(f"<worksheet {_NS}><sheetData><row>{head}</row>".encode())
                    for r in chunk:
                        sheet.write(f"<row>{''.join(map(_cell, r))}</row>".encode())
                    sheet.write(b"</sheetData></worksheet>")
                n += 1
            sheets = range(n)
            book.writestr("xl/workbook.xml", f"<workbook {_NS}><sheets>{''.join(f'<sheet name="Sheet{i + 1}" sheetId="{i + 1}" r:id="r{i}"/>' for i in sheets)}</sheets></workbook>")
            book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{"".join(f"""<Relationship Id="r{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>""" for i in sheets)}</Relationships>')
            book.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="b" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in sheets)
            book.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        yield pa.RecordBatch.from_arrays([pa.array([at])], ["file"])

    return [r["file"] for r in df.mapInArrow(write, "file string").collect()]  # a name for each task


__all__ = ["read_sheets", "records", "rows_of", "sheets", "write_sheets"]

"""Files as tables of strings with their order: CSV and text, ZIP members, dBASE, XLSX.

Formats that Spark reads stay with Spark. For the rest a Python data source has
one partition per file, and a file is read as a stream of rows.
"""

from __future__ import annotations

import csv
import io
import os
import re
import struct
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = (".csv", ".txt", ".zip", ".dbf")
_SCHEMA = "path string, member string, file_ord int, row_ord long, fields map<string,string>"


def discover(paths: list[str]) -> list[str]:
    """Input files of files and folders, each folder's in order; a missing path is an error."""
    out: list[str] = []
    for path in paths:
        if os.path.isdir(path):
            out += sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.lower().endswith(SUFFIXES))
        elif os.path.exists(path):
            out.append(path)
        else:
            raise FileNotFoundError(f"no such input: {path}")
    return out


def dbf_rows(raw: bytes, encoding: str = "latin1"):
    """Rows of a dBASE file: deleted rows are left out, values stripped."""
    n, head, size = struct.unpack("<IHH", raw[4:12])
    fields, at = [], 32
    while at + 32 <= head and raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode(encoding, "ignore").strip(), raw[at + 16]))
        at += 32
    for k in range(n):
        row = raw[head + k * size : head + (k + 1) * size]
        if len(row) < size or row[:1] == b"*":
            continue
        values, start = {}, 1
        for name, width in fields:
            values[name] = row[start : start + width].decode(encoding, "ignore").replace("\0", "").strip()
            start += width
        yield values


def csv_rows(raw: bytes):
    """Rows of a CSV with a header, in UTF-8 with or without mark, else Latin-1."""
    for row in csv.DictReader(io.StringIO(decode(raw), newline="")):
        yield {(k or "").replace("﻿", ""): v or "" for k, v in row.items() if isinstance(v, str) or v is None}


def decode(raw: bytes) -> str:
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _code_page(name: str, files: dict[str, bytes]) -> str:
    page = next((b for f, b in files.items() if f.lower() == os.path.splitext(name)[0].lower() + ".cpg"), b"").decode("ascii", "ignore").strip()
    try:
        "".encode(page or "latin1")
    except LookupError:
        return "latin1"
    return page or "latin1"


def member_rows(path: str):
    """(member, row) of a file; a ZIP's text members first, then its dBASE members."""
    low = path.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(path) as archive:
            names = archive.namelist()
            pages = {f: archive.read(f) for f in names if f.lower().endswith(".cpg")}
            for name in (f for s in ((".csv", ".txt"), (".dbf",)) for f in names if f.lower().endswith(s)):
                raw = archive.read(name)
                for row in dbf_rows(raw, _code_page(name, pages)) if name.lower().endswith(".dbf") else csv_rows(raw):
                    yield name, row
        return
    with open(path, "rb") as f:
        raw = f.read()
    if low.endswith(".dbf"):
        page = os.path.splitext(path)[0] + ".cpg"
        pages = {page: open(page, "rb").read()} if os.path.exists(page) else {}
        rows = dbf_rows(raw, _code_page(path, pages))
    else:
        rows = (dict(zip(x[0], r)) for x in [sheet_rows(raw)] for r in x[1:] if x) if low.endswith(".xlsx") else csv_rows(raw)
    for row in rows:
        yield os.path.basename(path), row


class _File(InputPartition):
    def __init__(self, path: str, order: int):
        self.path, self.order = path, order


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p, i) for i, p in enumerate(self.paths)]

    def read(self, partition):
        for k, (member, row) in enumerate(member_rows(partition.path)):
            yield partition.path, member, partition.order, k, row


class AddressFiles(DataSource):
    """``spark.read.format("address_files").option("paths", "a;b")``."""

    @classmethod
    def name(cls):
        return "address_files"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return _Reader([p for p in self.options["paths"].split(";") if p])


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, member, file_ord, row_ord, fields of all rows of all files found."""
    found = discover(paths)
    if not found:
        return spark.createDataFrame([], _SCHEMA)
    spark.dataSource.register(AddressFiles)
    return spark.read.format("address_files").option("paths", ";".join(found)).load()


def columns(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The map of fields as columns; without ``names``, those of all rows, of which there must be few."""
    if names is None:
        names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("fields"))).distinct().collect())
    first, low = [], set()
    for n in names:  # names that differ in case alone are one column: the first given value
        if n.lower() not in low:
            low.add(n.lower())
            first.append((n, [m for m in names if m.lower() == n.lower()]))
    own = [F.coalesce(*(F.nullif(F.try_element_at("fields", F.lit(m)), F.lit("")) for m in same), F.lit("")).alias(n) for n, same in first if n not in ("file_ord", "row_ord")]
    return rows.select("file_ord", "row_ord", *own)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header through Spark's own reader, all strings, '' for null, order columns added."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    clean = raw.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.replace("﻿", "")) for c in raw.columns))
    return clean.withColumns({"file_ord": F.lit(0), "row_ord": F.monotonically_increasing_id()})


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column_index(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def sheet_rows(raw: bytes) -> list[list[str]]:
    """Cells of the first sheet of a workbook; gaps are ''."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = book.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: (len(n), n))
        out = []
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{_NS}row"):
            cells: list[str] = []
            for k, cell in enumerate(row.iter(f"{_NS}c")):
                at = _column_index(cell.get("r")) if cell.get("r") else k
                cells += [""] * (at + 1 - len(cells))
                value = cell.find(f"{_NS}v")
                if cell.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                elif value is not None:
                    cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text or ""
            out.append(cells)
        return out


def column_letters(index: int) -> str:
    """0 -> A, 26 -> AA."""
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_sheet(headers: list[str], rows) -> bytes:
    """A workbook of one sheet: bold header, inline strings. ``rows`` may be an iterator."""
    from xml.sax.saxutils import escape

    def line(k: int, values, style: str) -> str:
        cells = "".join(f'<c r="{column_letters(i)}{k}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(re.sub("[^\t\n\r -퟿-�]", "", str(x)))}</t></is></c>' for i, x in enumerate(values))
        return f'<row r="{k}">{cells}</row>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Results" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {ns}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in files.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet {ns}><sheetData>{line(1, headers, chr(32) + "s=" + chr(34) + "1" + chr(34))}'.encode())
            for k, row in enumerate(rows, 2):
                sheet.write(line(k, row, "").encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()

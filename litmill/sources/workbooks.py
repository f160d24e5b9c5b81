"""Label sheets as workbooks (Office Open XML), written and read with the standard library.

A sheet is a sample for a person to fill in; up to ``MOST_ROWS`` it is one workbook, written and read on the driver. A longer
one goes on in further workbooks beside it, which executors write and read."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from itertools import islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.operators.labels import EFFECTS, FIELDS, STUDY_DESIGNS, codebook
from litmill.session import expose_package
from litmill.sources.tables import with_row_ids

#: Rows of a workbook's sheet.
MOST_ROWS = 100_000
HEADER = ["pmid", "rater", "title", "abstract", *FIELDS, "notes"]
CHOICES = {"study_design": STUDY_DESIGNS, "effect_direction": EFFECTS} | {f: ["TRUE", "FALSE"] for f in ("has_control", "statistical_claim_present", "coi_disclosed_in_abstract")}
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _letters(n: int) -> str:
    """The name of the nth column, from 0."""
    name = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return name


def _clean(value) -> str:
    """Text without the control characters that XML has no form for."""
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", "" if value is None else str(value))


def _sheet_xml(header: list[str], rows: list, choices: dict[str, list[str]]) -> str:
    def row(n: int, cells: list) -> str:
        each = "".join(f'<c r="{_letters(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(_clean(c))}</t></is></c>' for i, c in enumerate(cells) if _clean(c) != "")
        return f'<row r="{n}">{each}</row>'

    body = "".join(row(n, list(cells)) for n, cells in enumerate([header, *rows], 1))
    lists = [
        f'<dataValidation type="list" allowBlank="1" showErrorMessage="1" sqref="{(c := _letters(header.index(name)))}2:{c}{len(rows) + 1}"><formula1>"{escape(",".join(values))}"</formula1></dataValidation>'
        for name, values in choices.items() if rows
    ]
    checks = f'<dataValidations count="{len(lists)}">{"".join(lists)}</dataValidations>' if lists else ""
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData>{checks}</worksheet>'


def workbook(sheets: dict[str, tuple[list[str], list, dict[str, list[str]]]]) -> bytes:
    """The file of sheets: name to (header, rows, choices of columns)."""
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(name)}" sheetId="{n}" r:id="r{n}"/>' for n, name in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{n}" Type="{REL}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>')
        for n, (header, rows, choices) in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{n}.xml", _sheet_xml(header, rows, choices))
    return out.getvalue()


def _book(path: str, n: int) -> str:
    """The path of the nth workbook of a sheet, from 0."""
    stem, kind = os.path.splitext(path)
    return f"{stem}.part{n + 1}{kind}" if n else path


def _books(path: str) -> list[str]:
    """The workbooks of a sheet, in order."""
    n = 1
    while os.path.exists(_book(path, n)):
        n += 1
    return [_book(path, k) for k in range(n)]


def _write(path: str, rows: list, book: tuple[list[str], list]) -> None:
    body = workbook({"labels": (HEADER, rows, CHOICES), "codebook": (*book, {})})
    with open(f"{path}.{os.getpid()}.new", "wb") as f:
        f.write(body)
    os.replace(f.name, path)


def write_sheet(sheet: DataFrame, path: str) -> int:
    """Writes a rater's sheet with lists of the allowed values, and the codebook as a second sheet; its rows. Each
    ``MOST_ROWS`` rows are a workbook; the second and later ones (``.part2``) lie beside the first, in a folder that the driver and
    all executors share."""
    rules = codebook(sheet.sparkSession)
    book, most, old = (rules.columns, [tuple(r) for r in rules.collect()]), MOST_ROWS, _books(path)
    order = [F.col("pmid").cast("long"), F.col("rater")]
    rows = sheet.select(*HEADER)
    n = rows.count()
    if n <= most:
        _write(path, rows.orderBy(*order).collect(), book)
    else:
        expose_package(sheet.sparkSession)

        def write(table: pa.Table) -> pa.Table:
            number = table.column("_book")[0].as_py()
            table = table.sort_by("_row")
            _write(_book(path, number), list(zip(*(table.column(c).to_pylist() for c in HEADER), strict=True)), book)
            return pa.table({"n": pa.array([table.num_rows], pa.int64())})

        dealt = with_row_ids(rows, [*order, *(F.col(c) for c in HEADER)], "_row").withColumn("_book", F.floor(F.col("_row") / most))
        n = sum(r.n for r in dealt.groupBy("_book").applyInArrow(write, "n long").collect())  # a row for each workbook
    for gone in old[max(1, -(-n // most)) :]:
        os.remove(gone)
    return n


def _cells(z: zipfile.ZipFile, name: str) -> Iterator[dict[int, str]]:
    """Cells of a sheet by column, row by row; strings may be inline, shared or the results of formulas."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{MAIN}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{{{MAIN}}}si")]
    above = []
    for event, row in ET.iterparse(z.open(name), ("start", "end")):
        if event == "start":
            above.append(row)
            continue
        above.pop()
        if row.tag != f"{{{MAIN}}}row":
            continue
        cells = {}
        for c in row.findall(f"{{{MAIN}}}c"):
            column = 0
            for letter in re.match("[A-Z]+", c.get("r", "A"))[0]:
                column = column * 26 + ord(letter) - 64
            value = c.find(f"{{{MAIN}}}v")
            if c.get("t") == "inlineStr":
                cells[column - 1] = "".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t"))
            elif value is not None and value.text is not None:
                cells[column - 1] = shared[int(value.text)] if c.get("t") == "s" else {"0": "FALSE", "1": "TRUE"}.get(value.text, value.text) if c.get("t") == "b" else value.text
        above[-1].clear()  # only the row at hand is held
        yield cells


def _body(path: str, header: list[str]) -> Iterator[tuple]:
    """The rows of a workbook's first sheet, wholly blank ones left out; ValueError if its header isn't the expected one."""
    with zipfile.ZipFile(path) as z:
        rows = _cells(z, "xl/worksheets/sheet1.xml")
        names = next(rows, {})
        first = [names.get(i, "") for i in range(max(names, default=-1) + 1)]
        if first != header:
            raise ValueError(f"expected the columns {header}, got {first}")
        yield from (tuple(r.get(i) for i in range(len(header))) for r in rows if any((v or "").strip() for v in r.values()))


def read_sheet(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """The first sheet as text columns, wholly blank rows left out, with those of the workbooks in which it goes on;
    ValueError if a header isn't the expected one."""
    header, books = header or HEADER, _books(path)
    kinds = ", ".join(f"`{c}` string" for c in header)
    if len(books) == 1:
        return spark.createDataFrame(list(_body(path, header)), kinds)
    for book in books:
        next(_body(book, header), None)
    expose_package(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (n for b in batches for n in b.column(0).to_pylist()):
            body = _body(books[number], header)
            while rows := list(islice(body, 2000)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], header)

    return spark.range(0, len(books), 1, len(books)).mapInArrow(read, kinds)

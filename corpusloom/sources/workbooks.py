"""Workbooks (xlsx) and archives: named sheets as rows of text, with a log of files that can't be read; a lossless writer.

Files are read where they lie (`binaryFile`, one task a file or more), so a folder of workbooks is spread over the cluster;
one workbook or archive has to fit a task, as neither format can be split.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Limits of the format.
MAX_TEXT, MAX_ROWS, MAX_COLUMNS = 32_767, 1_048_576, 16_384
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheets(data: bytes) -> dict[str, list[list[str | None]]]:
    """Sheets of a workbook as lists of rows of text; empty cells are null."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        held = set(z.namelist())
        strings: list[str] = []
        if "xl/sharedStrings.xml" in held:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                strings.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_REL)]
            rows: list[list[str | None]] = []
            for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_MAIN}row"):
                cells: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    value = cell.find(f"{_MAIN}v")
                    if cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is None or value.text is None:
                        text = None
                    else:
                        text = strings[int(value.text)] if cell.get("t") == "s" else value.text
                    cells.append(text)
                at = int(row.get("r")) - 1 if row.get("r") else len(rows)
                rows += [[] for _ in range(at - len(rows))]
                rows.append(cells)
            out[sheet.get("name")] = rows
        return out


def _files(spark: SparkSession, path: str, each) -> DataFrame:
    """file, name, at, cells, error: each(data) gives (name, rows) pairs; what fails is one row with its error."""
    schema = pa.schema([("file", pa.string()), ("name", pa.string()), ("at", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = [(file, name, i, cells, None) for name, found in each(data.as_py()) for i, cells in enumerate(found)]
                except Exception as e:  # noqa: BLE001  the file's failure is its result
                    rows = [(file, None, None, None, f"{type(e).__name__}: {e}")]
                for i in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 5000]), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, name string, at long, cells array<string>, error string")


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of the workbooks under path: file, name of the sheet, at (row from 0), cells; file and error.
    sheet: only sheets of that name."""
    found = _files(spark, path, lambda data: sheets(data).items())
    rows = found.where("error is null").drop("error")
    return rows.where(F.col("name") == sheet) if sheet else rows, found.where("error is not null").select("file", "error")


def read_archives(spark: SparkSession, path: str, pattern: str = r"\.csv$", others: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of the CSV members of ZIP files: of each the largest member whose name matches, or with others=True
    all the other matching ones."""

    def each(data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            members = sorted((m for m in z.infolist() if re.search(pattern, m.filename)), key=lambda m: (-m.file_size, m.filename))
            if not members:
                raise ValueError(f"no member matches {pattern}")
            for m in members[1:] if others else members[:1]:
                yield m.filename, list(csv.reader(io.StringIO(z.read(m).decode("utf-8-sig"))))

    found = _files(spark, path, each)
    return found.where("error is null").drop("error"), found.where("error is not null").select("file", "error")


def with_header(rows: DataFrame, columns: Sequence[str], header: int = 0) -> DataFrame:
    """file, name and the columns (by their names in each sheet's header row; one that it lacks is null) of the rows below
    it that are not empty. A sheet's header is joined to its rows, so sheets may differ in order and set of columns."""
    heads = rows.where(F.col("at") == header).select("file", "name", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("_head"))
    body = rows.where((F.col("at") > header) & F.exists("cells", lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))).join(heads, ["file", "name"])
    at = lambda c: F.array_position("_head", c).cast("int")
    return body.select("file", "name", "at", *[F.when(at(c) > 0, F.get("cells", at(c) - 1)).alias(c) for c in columns])


def cell_text(value) -> str | None:
    """A value as a cell's text: lists as JSON; what the format can't hold unchanged is an error."""
    if value is None:
        return None
    text = json.dumps(list(value), ensure_ascii=False) if isinstance(value, list | tuple) else str(value)
    if len(text) > MAX_TEXT or _CONTROL.search(text):
        raise ValueError("a cell can't be held by a workbook without loss")
    return text


def workbook_bytes(tables: dict[str, tuple[Sequence[str], Iterator]]) -> bytes:
    """A workbook of (columns, rows) by sheet; numbers as numbers, all else as text, so a leading = is no formula."""
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    def cell(value) -> str:
        if isinstance(value, int | float) and not isinstance(value, bool):
            return f"<c><v>{value!r}</v></c>"
        text = cell_text(value)
        return "<c/>" if text is None else f'<c t="inlineStr"><is><t xml:space="preserve">{esc(text)}</t></is></c>'

    out = io.BytesIO()
    names = list(tables)
    main, office, package = _MAIN[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        sheet_types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{sheet_types}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{esc(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        for i, name in enumerate(names, 1):
            columns, rows = tables[name]
            if len(columns) > MAX_COLUMNS:
                raise ValueError("more columns than a sheet holds")
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                f.write(("<row>" + "".join(map(cell, columns)) + "</row>").encode())
                for n, row in enumerate(rows, 2):
                    if n > MAX_ROWS:
                        raise ValueError("more rows than a sheet holds")
                    f.write(("<row>" + "".join(map(cell, row)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def write_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """DataFrames as sheets of one workbook, at most MAX_ROWS rows each, taken a partition at a time; the file appears
    under its name once it is whole."""
    data = workbook_bytes({n: (df.columns, df.toLocalIterator()) for n, df in tables.items()})
    spark = next(iter(tables.values())).sparkSession
    jvm = spark.sparkContext._jvm
    at, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".partial")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(temporary, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    fs.delete(at, False)
    if not fs.rename(temporary, at):
        raise OSError(f"{path} could not be put in place")

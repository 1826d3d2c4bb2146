"""Workbooks (``.xlsx``) as a Spark data source: ``spark.read.format("workbook")``.

One partition per file and sheet.  A task streams the XML of its sheet straight
out of the zip container and holds one row and one Arrow batch at a time (and
the workbook's distinct texts, once a kept column has one), so a folder of many
workbooks is read by many small tasks.  Only the columns of the schema are parsed; cells of other
columns are passed over.  A schema is required, as for every panel: types decide
how a cell is read (a number in a date column is a day serial of the workbook's
date system), and a cell that does not fit raises with its place.

Read options: ``path`` (file or folder, any URI that ``pyarrow.fs`` knows),
``sheets`` (``first``, the default; ``*``; or names divided by ``|``), ``header``
(row of the names, 1), ``seriesColumn`` with ``seriesFrom`` = ``sheet`` or
``file`` (the column is filled from the sheet's name or the file's, without its
extension, as the reference's files are one city each), ``badCells`` = ``raise``
(default) or ``null``.

Write options: ``path``, ``sheetColumn`` (rows of a value go to a sheet of that
name; rows of a task come sorted by it, or sheets continue in another file).
Tasks write under ``_temporary``; the commit moves the files of the committed
attempts, so a lost or repeated task leaves nothing to read.

Nulls are empty cells; ``#N/A`` is null, other error values are bad cells;
rows without any value are skipped; text in a number column is a bad cell unless
it is blank.  A sheet without rows gives none; a missing column raises.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import uuid
import zipfile
from dataclasses import dataclass
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BATCH_ROWS = 4096
SHEET_ROWS = 1_048_575          # rows of a sheet below its header (format limit)
BOOK_TEXTS = 1_000_000         # distinct texts of a workbook that is written
SHEET_NAME = 31                 # longest sheet name (format limit)

# Fixed names of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
CONTENT_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
SPREADSHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"

EPOCH_1900, EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)


class BadCell(ValueError):
    pass


def filesystem(uri: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), uri


def list_workbooks(uri: str) -> list[str]:
    """Paths of the workbooks in a folder (or the file itself), sorted;
    temporary and hidden ones (``_``, ``.``, ``~``) are none."""
    from pyarrow import fs
    system, path = filesystem(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    base = path.rstrip("/") + "/"
    inner = lambda p: p[len(base):] if p.startswith(base) else p
    return sorted(x.path for x in found if x.type == fs.FileType.File and x.path.lower().endswith(".xlsx")
                  and not any(part[:1] in "_.~" for part in inner(x.path).split("/")))


# ------------------------------------------------------------------ parsing
def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def sheet_parts(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], dt.datetime]:
    """(name, member) of each sheet in order, and the day of serial 0."""
    target = {}
    with book.open("xl/_rels/workbook.xml.rels") as f:
        for _, e in iterparse(f):
            if e.tag == f"{{{PACKAGE_RELS}}}Relationship":
                to = e.get("Target")
                target[e.get("Id")] = to.lstrip("/") if to.startswith("/") else f"xl/{to}"
    sheets, epoch = [], EPOCH_1900
    with book.open("xl/workbook.xml") as f:
        for _, e in iterparse(f):
            if e.tag == _tag("sheet"):
                sheets.append((e.get("name"), target[e.get(f"{{{OFFICE_RELS}}}id")]))
            elif e.tag == _tag("workbookPr") and e.get("date1904") in ("1", "true"):
                epoch = EPOCH_1904
    return sheets, epoch


def _text(e) -> str:
    """Text of an inline or shared string, phonetic hints left out."""
    return "".join(t.text or "" for part in e if part.tag in (_tag("t"), _tag("r"))
                   for t in ([part] if part.tag == _tag("t") else part.findall(_tag("t"))))


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            root = None
            for event, e in iterparse(f, ("start", "end")):
                if root is None:
                    root = e
                elif event == "end" and e.tag == _tag("si"):
                    out.append(_text(e))
                    root.clear()
    return out


def column_number(ref: str) -> int:
    """0 for ``A1``, 26 for ``AA7``."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


class Cells:
    """Values of a workbook's cells by the types of the schema."""

    def __init__(self, book: zipfile.ZipFile, epoch: dt.datetime):
        self.book, self.epoch, self._strings = book, epoch, None

    def string(self, index: str) -> str:
        if self._strings is None:       # read when the first one is needed
            self._strings = shared_strings(self.book)
        return self._strings[int(index)]

    def raw(self, cell) -> tuple[str, str | None]:
        """Kind (n, s, b, e, d) and text of a cell; None without a value."""
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            inside = cell.find(_tag("is"))
            return "s", None if inside is None else _text(inside)
        v = cell.find(_tag("v"))
        if v is None or v.text is None:
            return kind, None
        return ("s", self.string(v.text)) if kind == "s" else ("s", v.text) if kind == "str" else (kind, v.text)

    def value(self, cell, dtype: T.DataType):
        kind, text = self.raw(cell)
        if text is None or (kind == "e" and text == "#N/A"):
            return None
        if isinstance(dtype, T.StringType):
            if kind == "e":
                raise BadCell(text)
            return text if kind != "b" else "true" if text == "1" else "false"
        if kind == "s" and not text.strip():
            return None
        if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            day = self.moment(kind, text)
            return day.date() if isinstance(dtype, T.DateType) else \
                day.replace(tzinfo=dt.timezone.utc) if isinstance(dtype, T.TimestampType) else day
        if isinstance(dtype, T.BooleanType) and kind == "b":
            return text == "1"
        if kind != "n" or isinstance(dtype, T.BooleanType):
            raise BadCell(text)
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return float(text)
        if re.fullmatch(r"[+-]?\d+", text):
            return int(text)
        if not float(text).is_integer():
            raise BadCell(text)
        return int(float(text))

    def moment(self, kind: str, text: str) -> dt.datetime:
        if kind == "n":
            days = float(text)
            if not math.isfinite(days):
                raise BadCell(text)
            # whole milliseconds, as serials are doubles
            return self.epoch + dt.timedelta(days=math.floor(days), milliseconds=round(days % 1 * 86_400_000))
        if kind in ("s", "d"):
            try:
                return dt.datetime.fromisoformat(text.strip()).replace(tzinfo=None)
            except ValueError:
                pass
        raise BadCell(text)


def rows_of(f, header: int):
    """(row number, its cells by column number) of each row of a sheet's XML
    from row ``header`` on; one row is held at a time."""
    data, number = None, 0
    for event, e in iterparse(f, ("start", "end")):
        if event == "start":
            if e.tag == _tag("sheetData"):
                data = e
        elif e.tag == _tag("row") and data is not None:
            number = int(e.get("r") or number + 1)
            if number >= header:
                cells, at = {}, -1
                for c in e:
                    if c.tag == _tag("c"):
                        ref = c.get("r")
                        at = column_number(ref) if ref else at + 1
                        cells[at] = c
                yield number, cells
            data.clear()


def _has_value(cell) -> bool:
    return any(x.text for x in cell.iter() if x.tag in (_tag("v"), _tag("t")))


def read_sheet(source, sheet: str | None, fields: list[T.StructField], header: int = 1, bad: str = "raise",
               place: str = "", cells_type=Cells):
    """Number of rows and lists of values per field, a batch at a time, of one
    sheet (the first if ``sheet`` is None) of an open workbook file."""
    with zipfile.ZipFile(source) as book:
        parts, epoch = sheet_parts(book)
        found = [p for n, p in parts if n == sheet] if sheet is not None else [p for _, p in parts[:1]]
        if not found:
            raise ValueError(f"{place}: no sheet {sheet!r}")
        cells, places, rows, batch = cells_type(book, epoch), None, 0, [[] for _ in fields]
        with book.open(found[0]) as f:
            for number, row in rows_of(f, header):
                if places is None:
                    names: dict[str, int] = {}
                    for at, c in row.items():
                        name = cells.raw(c)[1]
                        if name is not None and names.setdefault(name, at) != at and any(x.name == name for x in fields):
                            raise ValueError(f"{place}: two columns {name!r}")
                    missing = [x.name for x in fields if x.name not in names]
                    if missing:
                        raise ValueError(f"{place}: missing columns {missing}")
                    places = [(names[x.name], x.dataType) for x in fields]
                    continue
                if not any(map(_has_value, row.values())):
                    continue
                for x, out, (at, dtype) in zip(fields, batch, places):
                    try:
                        out.append(cells.value(row[at], dtype) if at in row else None)
                    except ValueError as e:
                        if bad != "null":
                            raise BadCell(f"{place}, row {number}, column {x.name}: {e} does not fit {dtype.simpleString()}") from None
                        out.append(None)
                rows += 1
                if rows == BATCH_ROWS:
                    yield rows, batch
                    rows, batch = 0, [[] for _ in fields]
        if rows:
            yield rows, batch


# ------------------------------------------------------------------- source
@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str | None


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self):
        raise ValueError("workbooks are read with a schema: spark.read.schema(...)")

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, dict(self.options), overwrite)


def _option(options: dict, name: str, default: str) -> str:
    return next((v for k, v in options.items() if k.lower() == name.lower()), default)


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.uri = schema, options["path"]
        self.sheets = _option(options, "sheets", "first")
        self.header = int(_option(options, "header", "1"))
        self.series = _option(options, "seriesColumn", "")
        self.series_from = _option(options, "seriesFrom", "file")
        self.bad = _option(options, "badCells", "raise")
        self.fields = [f for f in schema.fields if f.name != self.series]

    def partitions(self):
        """A file and sheet each.  With ``*`` the planner reads the sheet names
        (a file's directory and its list of sheets, no data)."""
        from concurrent.futures import ThreadPoolExecutor
        files = list_workbooks(self.uri)
        if self.sheets == "first":
            return [Sheet(p, None) for p in files]
        if self.sheets != "*":
            return [Sheet(p, s) for p in files for s in self.sheets.split("|")]
        with ThreadPoolExecutor(16) as pool:
            return [Sheet(p, s) for p, names in zip(files, pool.map(self._names, files)) for s in names]

    def _open(self, path: str):
        return filesystem(self.uri)[0].open_input_file(path)

    def _names(self, path: str) -> list[str]:
        with self._open(path) as f, zipfile.ZipFile(f) as book:
            return [n for n, _ in sheet_parts(book)[0]]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema
        if not isinstance(partition, Sheet):        # a folder without workbooks
            return
        types = to_arrow_schema(self.schema)
        stem = re.sub(r"\.[^.]*$", "", partition.path.rsplit("/", 1)[-1])
        with self._open(partition.path) as f:
            sheet = partition.sheet
            if sheet is None and self.series and self.series_from == "sheet":
                sheet = self._names(partition.path)[0]
            name = sheet if self.series_from == "sheet" else stem
            for rows, batch in read_sheet(f, sheet, self.fields, self.header, self.bad, f"{partition.path} [{sheet or 'first sheet'}]"):
                values = dict(zip((x.name for x in self.fields), batch))
                yield pa.RecordBatch.from_arrays([pa.array(values.get(x.name, [name] * rows), x.type) for x in types], schema=types)


# -------------------------------------------------------------------- sink
@dataclass
class Written(WriterCommitMessage):
    files: list


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.overwrite = schema, overwrite
        self.uri = options["path"].rstrip("/")
        self.by = _option(options, "sheetColumn", "")
        if self.by and self.by not in schema.names:
            raise ValueError(f"no column {self.by!r}")
        self.fields = [f for f in schema.fields if f.name != self.by]
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        system, path = filesystem(self.uri)
        system.create_dir(f"{path}/_temporary/{self.job}", recursive=True)
        files, book = [], None
        for batch in iterator:
            names = batch.column(self.by).to_pylist() if self.by else ["data"] * batch.num_rows
            columns = [batch.column(f.name).to_pylist() for f in self.fields]
            for name, *values in zip(names, *columns):
                if book is None or not book.fits(name):
                    if book is not None:
                        book.close()
                    files.append(f"{uuid.uuid4().hex}.xlsx")
                    book = Book(system.open_output_stream(f"{path}/_temporary/{self.job}/{files[-1]}"), self.fields)
                book.add(name, values)
        if book is not None:
            book.close()
        return Written(files)

    def commit(self, messages):
        system, path = filesystem(self.uri)
        if self.overwrite:
            for old in list_workbooks(self.uri):
                system.delete_file(old)
        for m in messages:
            for name in m.files if m is not None else ():
                system.move(f"{path}/_temporary/{self.job}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs
        system, path = filesystem(self.uri)
        if system.get_file_info(f"{path}/_temporary/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/_temporary/{self.job}")


class Book:
    """A workbook that is written row by row."""

    def __init__(self, sink, fields: list[T.StructField]):
        self.sink, self.fields = sink, fields
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
        self.sheets: list[str] = []
        self.strings: dict[str, int] = {}
        self.out, self.rows = None, 0

    def fits(self, name) -> bool:
        return (self.rows < SHEET_ROWS if self.sheets and self.sheets[-1] == name else name not in self.sheets) and len(self.strings) < BOOK_TEXTS

    def add(self, name, values: list) -> None:
        if not self.sheets or self.sheets[-1] != name:
            if not name or len(name) > SHEET_NAME or re.search(r"[\[\]:*?/\\]", name):
                raise ValueError(f"{name!r} cannot name a sheet")
            self._end_sheet()
            self.sheets.append(name)
            self.out, self.rows = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w"), 0
            self._put(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'
                      f'<row r="1">{"".join(self._cell(f.name) for f in self.fields)}</row>')
        self.rows += 1
        self._put(f'<row r="{self.rows + 1}">{"".join(map(self._cell, values))}</row>')

    def _put(self, text: str) -> None:
        self.out.write(text.encode())

    def _cell(self, v) -> str:
        if v is None or (isinstance(v, float) and not math.isfinite(v)):
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, str):
            return f'<c t="s"><v>{self.strings.setdefault(v, len(self.strings))}</v></c>'
        if isinstance(v, dt.datetime):
            gone = v.replace(tzinfo=None) - EPOCH_1900
            return f'<c s="1"><v>{gone.days + (gone - dt.timedelta(days=gone.days)) / dt.timedelta(days=1)!r}</v></c>'
        if isinstance(v, dt.date):
            return f'<c s="1"><v>{(v - EPOCH_1900.date()).days}</v></c>'
        return f"<c><v>{v!r}</v></c>"

    def _end_sheet(self) -> None:
        if self.out is not None:
            self._put("</sheetData></worksheet>")
            self.out.close()
            self.out = None

    def close(self) -> None:
        self._end_sheet()
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        number = range(1, len(self.sheets) + 1)
        with self.zip.open("xl/sharedStrings.xml", "w") as f:
            f.write(f'{head}<sst xmlns="{MAIN}">'.encode())
            for s in self.strings:
                f.write(f'<si><t xml:space="preserve">{escape(s)}</t></si>'.encode())
            f.write(b"</sst>")
        sheets = "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(number, self.sheets))
        rels = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE_RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in number)
        n = len(self.sheets)
        rels += "".join(f'<Relationship Id="rId{n + i}" Type="{OFFICE_RELS}/{kind}" Target="{kind}.xml"/>' for i, kind in ((1, "sharedStrings"), (2, "styles")))
        parts = "".join(f'<Override PartName="/xl/{part}.xml" ContentType="{SPREADSHEET_TYPE}.{kind}+xml"/>' for part, kind in
                        [("workbook", "sheet.main"), ("sharedStrings", "sharedStrings"), ("styles", "styles"), *((f"worksheets/sheet{i}", "worksheet") for i in number)])
        font = '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        for name, body in (
            ("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE_RELS}"><workbookPr/><sheets>{sheets}</sheets></workbook>'),
            ("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE_RELS}">{rels}</Relationships>'),
            ("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{font}<cellXfs count="2"><xf/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>'),
            ("_rels/.rels", f'<Relationships xmlns="{PACKAGE_RELS}"><Relationship Id="rId1" Type="{OFFICE_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
            ("[Content_Types].xml", f'<Types xmlns="{CONTENT_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{parts}</Types>'),
        ):
            self.zip.writestr(name, head + body)
        self.zip.close()
        self.sink.close()


# ------------------------------------------------------------------ helpers
def register_workbooks(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(WorkbookSource)


def write_workbooks(df: DataFrame, path: str, by: str = "series", files: int | None = None) -> str:
    """Write a panel as a folder of workbooks with a sheet per value of ``by``;
    each of ``files`` tasks (all partitions unless given) writes one or more."""
    register_workbooks(df.sparkSession)
    if files:
        df = df.repartition(files)
    df.sortWithinPartitions(by).write.format("workbook").option("sheetColumn", by).mode("append").save(path)
    return path

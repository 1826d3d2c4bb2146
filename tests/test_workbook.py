"""Workbook source and sink: round trips, partitions, parsed columns, cell
kinds, bad cells."""

import datetime as dt
import glob
import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.sources import workbook as wb
from panelcast.sources.io import read_panel

FIELDS = [T.StructField("day", T.DateType()), T.StructField("x", T.DoubleType()), T.StructField("n", T.LongType()),
          T.StructField("s", T.StringType())]
SCHEMA = T.StructType([T.StructField("series", T.StringType()), *FIELDS])


def rows(n=40):
    return [(f"city {i % 3}", dt.date(2020, 1, 1) + dt.timedelta(days=i), None if i % 7 == 0 else i / 7, i - 5, ["<ä & \"b\">", "", None, " x "][i % 4]) for i in range(n)]


def hand_made(sheet: str, strings: str = "", names=("one",), props: str = "") -> io.BytesIO:
    """A workbook from the XML of its first sheet's rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        sheets = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{wb.MAIN}" xmlns:r="{wb.OFFICE_RELS}">{props}<sheets>{sheets}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Target="/xl/worksheets/s{i}.xml"/>' for i in range(len(names)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{wb.PACKAGE_RELS}">{rels}</Relationships>')
        z.writestr("xl/worksheets/s0.xml", f'<worksheet xmlns="{wb.MAIN}"><cols/><sheetData>{sheet}</sheetData><pageMargins/></worksheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{wb.MAIN}">{strings}</sst>')
    return out


def read(book, fields, **kw):
    return [r for n, batch in wb.read_sheet(book, kw.pop("sheet", None), fields, **kw) for r in (zip(*batch) if batch else [()] * n)]


def names(*cols):
    return f'<row r="1">{"".join(f"<c t=\"inlineStr\"><is><t>{c}</t></is></c>" for c in cols)}</row>'


def test_folder_round_trip(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    path = str(tmp_path / "books")
    wb.write_workbooks(df, path, files=4)
    files = glob.glob(path + "/*.xlsx")
    assert len(files) == 4 and not glob.glob(path + "/_temporary/*/*")
    back = read_panel(spark, path, SCHEMA, fmt="workbook", required=["series", "x"], keys=("series", "day"),
                      options={"sheets": "*", "seriesColumn": "series", "seriesFrom": "sheet"})
    # a workbook has no empty texts and nulls apart: both are empty cells or empty strings as written
    assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == rows()
    sheets = sum(len(wb.sheet_parts(zipfile.ZipFile(f))[0]) for f in files)
    assert back.rdd.getNumPartitions() == sheets > 4          # a partition for each file and sheet
    # one sheet by name; the first of each file
    one = read_panel(spark, path, SCHEMA, fmt="workbook", options={"sheets": "city 1", "seriesColumn": "series", "seriesFrom": "sheet"})
    assert {r.series for r in one.collect()} == {"city 1"} and one.count() == 13
    assert read_panel(spark, path, SCHEMA, fmt="workbook", options={"seriesColumn": "series"}).select("series").distinct().count() == 4


def test_only_wanted_columns_are_parsed(spark, tmp_path):
    path = str(tmp_path / "books")
    wb.write_workbooks(spark.createDataFrame(rows(), SCHEMA), path, files=1)
    parsed = []

    class Counting(wb.Cells):
        def value(self, cell, dtype):
            parsed.append(dtype)
            return super().value(cell, dtype)

        def string(self, index):
            return super().string(index)

    file = glob.glob(path + "/*.xlsx")[0]
    got = [v for _, (batch,) in wb.read_sheet(file, "city 0", [FIELDS[2]], cells_type=Counting) for v in batch]
    assert len(got) == 14 and parsed == [T.LongType()] * 14
    few = read_panel(spark, path, T.StructType([FIELDS[2]]), fmt="workbook", options={"sheets": "*"})
    assert few.columns == ["n"] and few.agg(F.sum("n")).first()[0] == sum(r[3] for r in rows())


def test_batches_and_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wb, "BATCH_ROWS", 3)
    monkeypatch.setattr(wb, "SHEET_ROWS", 6)
    sink = io.BytesIO()
    book = wb.Book(sink, FIELDS)
    done = 0
    for series, *values in sorted(rows(12), key=lambda r: r[0]):
        assert book.fits(series)
        book.add(series, values)
        done += 1
    assert not all(book.fits(s) for s in ("city 0", "city 1"))      # a sheet that ended is not taken up again
    sink.close = lambda: None
    book.close()
    assert done == 12
    sizes = [n for n, _ in wb.read_sheet(io.BytesIO(sink.getvalue()), "city 1", FIELDS)]
    assert sizes == [3, 1]


def test_cell_kinds():
    f = [T.StructField(c, t()) for c, t in (("d", T.DateType), ("t", T.TimestampNTZType), ("x", T.DoubleType), ("n", T.LongType), ("s", T.StringType), ("b", T.BooleanType))]
    sheet = names("d", "unused", "t", "x", "n", "s", "b") + \
        '<row r="2"><c r="A2"><v>43831</v></c><c r="B2" t="e"><v>#REF!</v></c><c r="C2"><v>43831.75</v></c><c r="D2"><v>1E-3</v></c><c r="E2"><v>12</v></c><c r="F2" t="s"><v>1</v></c><c r="G2" t="b"><v>1</v></c></row>' + \
        '<row r="3"><c r="A3" t="d"><v>2020-01-02</v></c><c r="D3" t="e"><v>#N/A</v></c><c r="E3"><v>3.0E0</v></c><c r="F3"><v>7</v></c></row>' + \
        '<row r="4"><c r="A4"/></row><row r="6"><c t="inlineStr"><is><t>2020-01-03</t></is></c><c/><c/><c t="s"><v>0</v></c></row>'
    strings = "<si><t> </t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>"
    assert read(hand_made(sheet, strings), f) == [
        (dt.date(2020, 1, 1), dt.datetime(2020, 1, 1, 18), 0.001, 12, "rich", True),
        (dt.date(2020, 1, 2), None, None, 3, "7", None), (dt.date(2020, 1, 3), None, None, None, None, None)]
    old = hand_made(names("d") + "<row><c><v>1</v></c></row>", props='<workbookPr date1904="1"/>')
    assert read(old, f[:1]) == [(dt.date(1904, 1, 2),)]
    assert [wb.column_number(x) for x in ("A1", "Z9", "AA10", "XFD1")] == [0, 25, 26, 16383]
    assert read(hand_made(names("x") + "<row><c><v>1</v></c></row><row><c><v>2</v></c></row>"), []) == [(), ()]


@pytest.mark.parametrize("cell, field", [('<c t="inlineStr"><is><t>n.a.</t></is></c>', FIELDS[1]), ("<c><v>1.5</v></c>", FIELDS[2]),
                                         ('<c t="e"><v>#DIV/0!</v></c>', FIELDS[1]), ('<c t="inlineStr"><is><t>31/12/2020</t></is></c>', FIELDS[0]),
                                         ('<c t="b"><v>1</v></c>', FIELDS[1])])
def test_a_bad_cell_raises_with_its_place(cell, field):
    sheet = names(field.name) + f'<row r="2"/><row r="9">{cell}</row>'
    with pytest.raises(wb.BadCell, match=f"here, row 9, column {field.name}"):
        read(hand_made(sheet), [field], place="here")
    assert read(hand_made(sheet), [field], bad="null") == [(None,)]


def test_headers():
    with pytest.raises(ValueError, match="missing columns"):
        read(hand_made(names("a")), [FIELDS[1]])
    with pytest.raises(ValueError, match="two columns"):
        read(hand_made(names("x", "x")), [FIELDS[1]])
    with pytest.raises(ValueError, match="no sheet"):
        read(hand_made(""), [FIELDS[1]], sheet="two")
    assert read(hand_made(names("a", "a", "x") + "<row><c/><c/><c><v>2</v></c></row>"), [FIELDS[1]]) == [(2.0,)]
    assert read(hand_made(""), [FIELDS[1]]) == []
    assert read(hand_made('<row r="1"><c t="inlineStr"><is><t>title</t></is></c></row><row r="3">' + names("x")[11:] + '<row r="4"><c><v>5</v></c></row>'), [FIELDS[1]], header=3) == [(5.0,)]


def test_spark_reports_the_bad_cell(spark, tmp_path):
    path = tmp_path / "bad"
    path.mkdir()
    (path / "b.xlsx").write_bytes(hand_made(names("x") + '<row r="2"><c t="inlineStr"><is><t>oops</t></is></c></row>').getvalue())
    schema = T.StructType([FIELDS[1]])
    with pytest.raises(Exception, match="oops does not fit double"):
        read_panel(spark, str(path), schema, fmt="workbook").collect()
    assert read_panel(spark, str(path), schema, fmt="workbook", options={"badCells": "null"}).collect()[0].x is None


def test_stray_files_are_not_read(spark, tmp_path):
    path = str(tmp_path / "books")
    df = spark.createDataFrame(rows(9), SCHEMA)
    wb.write_workbooks(df, path, files=2)
    (tmp_path / "books" / "_temporary" / "x").mkdir(parents=True)
    (tmp_path / "books" / "_temporary" / "x" / "lost.xlsx").write_bytes(b"half")
    (tmp_path / "books" / "~$open.xlsx").write_bytes(b"lock")
    options = {"sheets": "*", "seriesColumn": "series", "seriesFrom": "sheet"}
    assert read_panel(spark, path, SCHEMA, fmt="workbook", options=options).count() == 9
    # overwrite replaces the folder's workbooks, append adds to them
    w = df.sortWithinPartitions("series").coalesce(1).write.format("workbook").option("sheetColumn", "series")
    w.mode("append").save(path)
    assert read_panel(spark, path, SCHEMA, fmt="workbook", options=options).count() == 18
    w.mode("overwrite").save(path)
    assert read_panel(spark, path, SCHEMA, fmt="workbook", options=options).count() == 9


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert read_panel(spark, str(tmp_path), SCHEMA, fmt="workbook", options={"seriesColumn": "series"}).count() == 0
    with pytest.raises(Exception, match="schema"):
        read_panel(spark, str(tmp_path), fmt="workbook")


def test_a_value_that_cannot_name_a_sheet_raises(spark, tmp_path):
    bad = spark.createDataFrame([("a/b", None, 1.0, 1, "x")], SCHEMA)
    with pytest.raises(Exception, match="cannot name a sheet"):
        wb.write_workbooks(bad, str(tmp_path / "bad"))
    assert not glob.glob(str(tmp_path / "bad" / "*.xlsx"))

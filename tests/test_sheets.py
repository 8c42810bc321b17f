"""Header rows, sheets and workbook files."""

import io
import tracemalloc
import zipfile
from datetime import datetime
from itertools import islice

from pyspark.sql import functions as F

from gridloom.catalog.xlsx_writer import workbook_bytes
from gridloom.operators import headers as H
from gridloom.operators import profile
from gridloom.plans.autotype import auto_model
from gridloom.sources import workbook as W

SHEETS = {
    "Viajes": [["Fecha", "Cliente", "Valor"], ["2026-09-01", "ACME", 10.5], ["2026-09-02", "NORTE", 7]],
    "Vacia": [],
    "Titulada": [["Informe de ventas"], [], ["Generado", None], ["Producto", "Cantidad", "Precio"],
                 ["a", 1, 2.5], ["b", 2, 3.5], ["c", 3, 4.5]],
    "Numeros": [[1, 2, 3], [4, 5, 6], [7, 8, 9]],
    "Hueco": [["Cliente", None, "Total"], ["x", "y", 1], ["z", None, 2]],
    "Repetida": [["Nombre", "Nombre", "Nombre (2)", None], ["a", "b", 1, "extra"]],
    "Igual": [["a", "a"], ["b", "c"], ["d", "e"]],
    "Sola": [["Cliente"], ["ACME"]],
}


def write(folder, name="libro.xlsx", sheets=SHEETS, extra=None):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(workbook_bytes(sheets, extra))
    return str(folder)


def test_sheets_are_read_and_classified(spark, tmp_path):
    raw = W.read_workbooks(spark, write(tmp_path / "in"))
    grid = W.sheet_rows(raw)
    facts = H.sheet_facts(grid)
    named = H.headers(grid, facts)
    rows = H.data_rows(grid, named)
    sheets = {r.sheet_name: r for r in H.classify(facts, named, rows, W.truncated_sheets(raw)).collect()}
    assert {n: r.issue for n, r in sheets.items() if r.issue} == {"Vacia": "empty", "Numeros": "no_headers"}
    assert {n: r.header_row for n, r in sheets.items()} == {
        "Viajes": 0, "Vacia": None, "Titulada": 3, "Numeros": None, "Hueco": 0, "Repetida": 0,
        "Igual": 1, "Sola": 0}
    assert sheets["Titulada"].row_count == 3 and sheets["Viajes"].included and not sheets["Vacia"].included
    names = {r.sheet_index: r.names for r in named.collect()}
    assert names[4] == ["Cliente", "Columna 2", "Total"]
    assert names[5] == ["Nombre", "Nombre (3)", "Nombre (2)"]


def test_forced_header(spark, tmp_path):
    grid = W.sheet_rows(W.read_workbooks(spark, write(tmp_path / "in")))
    file = grid.first().file
    forced = spark.createDataFrame([(file, 3, 0), (file, 2, 1), (file, 0, 99)],
                                   "file string, sheet_index int, header_row bigint")
    facts = H.force_headers(H.sheet_facts(grid), grid, forced)
    found = {r.sheet_index: (r.header_row, r.out_of_bounds) for r in facts.collect()}
    assert found[3] == (0, False) and found[2] == (None, False) and found[0] == (None, True)
    names = {r.sheet_index: r.names for r in H.headers(grid, facts).collect()}
    assert names[3] == ["1", "2", "3"] and 2 not in names


def test_sheet_to_typed_table(spark, tmp_path):
    from gridloom.operators import entities as E

    grid = W.sheet_rows(W.read_workbooks(spark, write(tmp_path / "in")))
    named = H.headers(grid, H.sheet_facts(grid))
    rows = H.data_rows(grid, named)
    stats = profile.value_stats(H.long_rows(rows, H.headers(grid, H.sheet_facts(grid))))
    table = rows.where("sheet_index = 2").select(F.concat_ws("/", "file", "sheet_index").alias("t")).first().t
    entity = auto_model(profile.profiles(stats), table)
    assert [(f.name, f.type) for f in entity.fields] == [
        ("producto", "text"), ("cantidad", "integer"), ("precio", "decimal")]
    assert entity.display == "producto"
    names = named.where("sheet_index = 2").first().names
    sheet = H.sheet_table(rows, names, grid.first().file, 2)
    records = E.kept(E.import_entity(sheet, entity, "row_number")).orderBy("cantidad").collect()
    assert [(r.producto, r.cantidad, float(r.precio)) for r in records] == [
        ("a", 1, 2.5), ("b", 2, 3.5), ("c", 3, 4.5)]
    # The row people see in the sheet, titles included.
    assert records[0]["__source"].row == 5


def test_caps_and_bad_files(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, sheets={"a": [["h"], *[[i] for i in range(9)]], "b": [["x", "y", "z"]], "c": [["q"]]})
    (folder / "roto.xlsx").write_bytes(b"esto no es un libro")
    raw = W.read_workbooks(spark, str(folder), W.Limits(sheets=2, rows=5, columns=2))
    grid = W.sheet_rows(raw).where("row_index >= 0")
    assert grid.groupBy("sheet_name").count().orderBy("sheet_name").collect() == [("a", 5), ("b", 1)]
    assert grid.where("sheet_name = 'b'").first().cells[-1].s == "y"
    assert sorted(r.sheet_index for r in W.truncated_sheets(raw).collect()) == [0, 1, 2]
    bad = W.unreadable_files(raw).collect()
    assert len(bad) == 1 and bad[0].file.endswith("roto.xlsx")
    tiny = W.read_workbooks(spark, str(folder), W.Limits(unzipped_bytes=10))
    assert W.sheet_rows(tiny).count() == 0 and W.unreadable_files(tiny).count() == 2


SHEET_XML = """<worksheet xmlns="m"><sheetData>
<row r="1"><c r="A1" t="inlineStr"><is><t>Uni</t></is></c><c r="C1" t="s"><v>0</v></c></row>
<row r="3"><c r="A3" s="1"><v>46280.5</v></c><c r="B3" t="str"><f>A1&amp;"x"</f><v>fx</v></c>
<c r="C3" t="e"><v>#N/A</v></c><c r="D3" t="b"><v>1</v></c><c r="E3" s="2"><v>12.5</v></c>
<c r="F3"><f>1+1</f><v>2</v></c></row></sheetData>
<mergeCells count="2"><mergeCell ref="A1:B2"/><mergeCell ref="D3:D4"/></mergeCells></worksheet>"""
STYLES = """<styleSheet><numFmts><numFmt numFmtId="164" formatCode="[Red]#,##0.00&quot;d&quot;"/></numFmts>
<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>"""
STRINGS = "<sst><si><r><t>rico </t></r><r><t>texto</t></r><rPh><t>no</t></rPh></si></sst>"


def test_cell_kinds(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="H" r:id="a"/></sheets></workbook>')
        archive.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>')
        archive.writestr("xl/worksheets/s.xml", SHEET_XML)
        archive.writestr("xl/styles.xml", STYLES)
        archive.writestr("xl/sharedStrings.xml", STRINGS)
    (tmp_path / "k.xlsx").write_bytes(out.getvalue())
    cells = W.cells(W.sheet_rows(W.read_workbooks(spark, str(tmp_path)))).collect()
    got = {(c.row_index, c.col_index): next(v for v in (c.s, c.n, c.b, c.t) if v is not None) for c in cells}
    assert got == {
        (0, 0): "Uni", (0, 1): "Uni", (0, 2): "rico texto", (1, 0): "Uni", (1, 1): "Uni",
        (2, 0): datetime(2026, 9, 15, 12), (2, 1): "fx", (2, 3): True, (2, 4): 12.5, (2, 5): 2.0,
        (3, 3): True}


def test_a_header_far_down_is_found_where_it_is_looked_for(spark, tmp_path):
    rows = [[i, i + 1] for i in range(39)] + [["Producto", "Cantidad"], ["a", 1], ["b", 2]]
    grid = W.sheet_rows(W.read_workbooks(spark, write(tmp_path / "in", sheets={"Honda": rows})))
    assert [r.header_row for r in H.sheet_facts(grid).collect()] == [None]
    assert [r.header_row for r in H.sheet_facts(grid, scan_depth=50).collect()] == [39]
    for depth, issue, searched in ((25, H.NOT_WITHIN_DEPTH, 25), (50, None, None)):
        facts = H.sheet_facts(grid, scan_depth=depth)
        named = H.headers(grid, facts)
        sheet = H.classify(facts, named, H.data_rows(grid, named), scan_depth=depth).first()
        assert (sheet.issue, sheet.searched, sheet.included) == (issue, searched, issue is None)


def test_a_cell_that_cannot_be_read_is_blank():
    from gridloom.sources import xlsx

    sheet = """<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" s="1"><v>1e12</v></c>
    <c r="B1"><v>no</v></c><c r="C1" t="s"><v>9</v></c><c r="D1"><v>5</v></c></row></sheetData></worksheet>"""
    out = io.BytesIO(workbook_bytes({"a": []}, {
        "xl/worksheets/s.xml": sheet,
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'}))
    book = xlsx.open_book(out, W.Limits())
    assert list(book.rows("xl/worksheets/s.xml")) == [(1, [None, None, None, {"kind": "number", "n": 5.0}])]


def merged_sheet(*references, rows=""):
    """A workbook of one sheet with these merged ranges."""
    from gridloom.sources import xlsx

    merges = "".join(f'<mergeCell ref="{r}"/>' for r in references)
    sheet = f"<worksheet><sheetData>{rows}</sheetData><mergeCells>{merges}</mergeCells></worksheet>"
    out = io.BytesIO(workbook_bytes({"a": []}, {"xl/worksheets/s.xml": sheet}))
    return xlsx.open_book(out, W.Limits())


FIRST = '<row r="1"><c r="A1"><v>7</v></c><c r="C1"><v>8</v></c></row>'


def numbers_of(rows):
    return [(at, [cell and cell["n"] for cell in row]) for at, row in rows]


def test_merged_ranges_fill_rows_and_gaps():
    rows = FIRST + '<row r="5"><c r="B5"><v>9</v></c></row>'
    book = merged_sheet("A1:B2", "C1:C3", "B5:C5", "A7:A8", "B7:C7", rows=rows)
    assert numbers_of(book.rows("xl/worksheets/s.xml")) == [
        (1, [7, 7, 8]), (2, [7, 7, 8]), (3, [None, None, 8]), (5, [None, 9, 9]),
        (7, [None, None, None]), (8, [None])]


def test_a_merge_of_the_whole_sheet_costs_one_row_of_memory():
    book = merged_sheet("A1:XFD1048576", rows=FIRST)
    tracemalloc.start()
    rows = list(islice(((at, len(row), row[-1]) for at, row in book.rows("xl/worksheets/s.xml")), 200))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows[0] == (1, 16384, {"kind": "number", "n": 7.0}) and rows[-1][:2] == (200, 16384)
    assert peak < 20_000_000
    # Caps end the sweep and keep rows short.
    from gridloom.sources import xlsx
    capped = list(xlsx.sheet_rows("f", merged_book(book), 0, W.Limits(rows=3, columns=2)))
    assert [len(r["cells"]) for r in capped] == [2, 2, 2, 0] and capped[-1]["truncated"]


def merged_book(book):
    book.sheets = [("h", "xl/worksheets/s.xml")]
    return book


def test_rows_are_streamed_in_flat_memory():
    from gridloom.sources import xlsx

    peaks = []
    for count in (5_000, 30_000):
        out = io.BytesIO(workbook_bytes({"h": [[i, i * 2, i * 3] for i in range(count)]}))
        book = xlsx.open_book(out, W.Limits())
        tracemalloc.start()
        assert sum(1 for _ in book.rows("xl/worksheets/sheet1.xml")) == count
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    # Far less than the rows that were added.
    assert peaks[1] < peaks[0] + 500_000


def sheets_of(grid):
    rows = grid.where("row_index >= 0").collect()
    return sorted((r.file.rpartition("/")[2], r.sheet_name, r.row_index, str(r.cells)) for r in rows)


def test_one_book_is_read_by_a_task_per_sheet(spark, tmp_path):
    sheets = {f"h{i}": [["x", i], ["y", i * 2]] for i in range(20)}
    write(tmp_path / "in", sheets=sheets)
    (tmp_path / "in" / "roto.xlsx").write_bytes(b"esto no es un libro")
    (tmp_path / "in" / "otro.txt").write_bytes(b"otro")
    W.register(spark)
    grid = spark.read.format("workbook").load(str(tmp_path / "in"))
    assert grid.rdd.getNumPartitions() == 21
    assert sheets_of(grid) == sheets_of(W.read_workbooks(spark, str(tmp_path / "in")))
    assert [r.file.endswith("roto.xlsx") for r in W.unreadable_files(grid).collect()] == [True]
    one = spark.read.format("workbook").option("sheets", 3).option("rows", 1).load(f"file:{tmp_path}/in/libro.xlsx")
    assert len(sheets_of(one)) == 3 and W.truncated_sheets(one).count() == 20
    assert W.unreadable_files(spark.read.format("workbook").option("unzippedBytes", 10).load(str(tmp_path / "in"))).count() == 2


def test_a_damaged_book_leaves_no_rows(spark, tmp_path):
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 6000))
    cut = f"<worksheet><sheetData>{rows}"
    good = workbook_bytes({"bien": [[1], [2]]})
    (tmp_path / "bueno.xlsx").write_bytes(good)
    (tmp_path / "malo.xlsx").write_bytes(damaged(workbook_bytes({"bien": [[1], [2]], "mal": []}), cut))
    W.register(spark)
    for grid in (W.read_workbooks(spark, str(tmp_path)), spark.read.format("workbook").load(str(tmp_path))):
        assert {f for f, *_ in sheets_of(grid)} == {"bueno.xlsx", "malo.xlsx"}
        assert {f for f, *_ in sheets_of(W.sheet_rows(grid))} == {"bueno.xlsx"}
        assert [r.file.endswith("malo.xlsx") for r in W.unreadable_files(grid).collect()] == [True]


def damaged(content, sheet):
    """The book with its second sheet replaced."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, sheet if name.endswith("sheet2.xml") else old.read(name))
    return out.getvalue()


def test_rows_hold_something_where_they_have_a_width(spark):
    cell = "struct<kind:string,s:string,n:double,b:boolean,t:timestamp_ntz>"
    rows = [([None, ("text", " \u00a0", None, None, None)],), ([None, ("number", None, 0.0, None, None), ("text", "x", None, None, None)],),
            ([("number", None, None, None, None)],), ([],), (None,), ([(None, None, None, None, None)],)]
    cells = spark.createDataFrame(rows, f"cells array<{cell}>")
    got = cells.select((H.row_width("cells") > 0).alias("wide"), H.holds_something(F.col("cells")).alias("held")).collect()
    assert [r.held for r in got] == [False, True, False, False, None, False]
    assert all((r.wide or False) == (r.held or False) for r in got)

"""Header rows of sheets: find them, name the columns, classify the sheets.

A grid has one row per sheet row: ``file, sheet_index, sheet_name, row_index, cells`` where
``cells`` is an array of cell structs by column position. Cells of a row stay together, so rows
are never put back together from cells: numbers per sheet are aggregated and joined back, by
broadcast while the sheets are few. A sheet is capped in rows, so no sheet is a hot key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.cells import CELL_TYPE, TEXT, cell_of
from gridloom.functions.stages import staged
from gridloom.functions.text import header_key
from gridloom.operators.profile import LongCells, dealt

SHEET = ["file", "sheet_index"]
#: The slots of long cells that a sheet fills.
CELL_SLOTS = ("v_s", "v_n", "v_b", "v_t")
# How a header row is recognised.
SCAN_DEPTH = 25
MAX_HEADER_LENGTH = 80
# Names for gaps and issues of a sheet.
GAP_NAME = "Columna "
EMPTY, NO_HEADERS, TRUNCATED = "empty", "no_headers", "truncated"
#: No header in the rows that were searched, but the sheet goes on below them.
NOT_WITHIN_DEPTH = "no_headers_within_depth"


def _cell(column: Column):
    return cell_of(column, CELL_TYPE)


def _is_filled(cell: Column) -> Column:
    return cell.isNotNull() & ~F.coalesce(_cell(cell).blank, F.lit(True))


def filled(cells: Column) -> Column:
    """The cells of a row that hold something."""
    return F.filter(cells, _is_filled)


def row_width(cells: Column) -> Column:
    return F.size(filled(cells))


def holds_something(cells: Column) -> Column:
    """Whether the row has any width, which its first filled cell tells."""
    return F.exists(cells, _is_filled)


def _looks_like_header(cells: Column, max_length: int) -> Column:
    names = F.transform(filled(cells), lambda c: header_key(_cell(c).text))
    text = F.forall(
        filled(cells),
        lambda c: (c["kind"] == TEXT) & (F.length(_cell(c).text) <= max_length),
    )
    named = F.forall(names, lambda n: n != "")
    several = (F.size(F.array_distinct(names)) > 1) | (F.size(names) == 1)
    return (F.size(names) > 0) & text & named & several


def sheet_facts(
    grid: DataFrame, scan_depth: int = SCAN_DEPTH, max_length: int = MAX_HEADER_LENGTH
) -> DataFrame:
    """Per sheet: the header row found, or null, and the last row that holds something.

    The header is looked for in the first ``scan_depth`` rows, among cells of at most
    ``max_length`` characters.
    """
    scanned = F.col("row_index") < scan_depth
    # Below the rows that are searched it only matters whether there is any width.
    width = F.when(scanned, row_width(F.col("cells"))).otherwise(holds_something(F.col("cells")).cast("int"))
    facts = grid.withColumn("width", width).select(
        *SHEET,
        "sheet_name",
        "row_index",
        "width",
        F.when(
            scanned, F.when(_looks_like_header(F.col("cells"), max_length), F.col("width"))
        ).alias("fit"),
    )
    # The name belongs to the sheet; as a key it leaves only numbers to aggregate.
    sheets = facts.groupBy(*SHEET, "sheet_name").agg(
        F.max(F.when(scanned, F.col("width"))).alias("widest"),
        F.min(F.when(F.col("fit") >= 2, F.col("row_index"))).alias("wide_fit"),
        F.min(F.when(F.col("fit") >= 1, F.col("row_index"))).alias("any_fit"),
        F.max(F.when(F.col("width") > 0, F.col("row_index"))).alias("last_row"),
        F.max("row_index").alias("bottom"),
    )
    first = F.when(F.col("widest") >= 2, F.col("wide_fit")).otherwise(F.col("any_fit"))
    return sheets.select(
        *SHEET,
        "sheet_name",
        F.when(first < F.col("last_row"), first).alias("header_row"),
        "last_row",
        "bottom",
    )


def _unique_names(names: Column, keys: Column) -> Column:
    """Number repeated names, skipping numbers that would repeat another header.

    A header has a few hundred names at most, and only header rows get here.
    """

    def one(row_names, row_keys):
        given, used, out = set(row_keys), set(), []
        for name, key in zip(row_names, row_keys):
            number = 1
            chosen = key
            while chosen in used or (number > 1 and chosen in given):
                number += 1
                chosen = f"{key}_{number}".strip("_")
            used.add(chosen)
            out.append(name if number == 1 else f"{name} ({number})")
        return out

    @F.pandas_udf("array<string>")
    def unique(names: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([one(n, k) for n, k in zip(names, keys)])

    return unique(names, keys)


def headers(grid: DataFrame, facts: DataFrame) -> DataFrame:
    """Per sheet with a header row: the names of its columns in order."""
    at = facts.where(F.col("header_row").isNotNull()).select(*SHEET, "header_row")
    rows = grid.join(at, SHEET).where(F.col("row_index") == F.col("header_row"))
    texts = F.transform("cells", lambda c: F.coalesce(_cell(c).text, F.lit("")))
    # Positions up to the last cell that holds something.
    last = F.array_max(F.transform(F.col("texts"), lambda t, i: F.when(t != "", i + 1)))
    named = F.transform(
        F.slice("texts", 1, F.col("last")),
        lambda t, i: F.when(t == "", F.concat(F.lit(GAP_NAME), (i + 1).cast("string"))).otherwise(t),
    )
    written = (
        rows.withColumn("texts", texts)
        .withColumn("last", last)
        .withColumn("names", named)
        .withColumn("keys", F.transform("names", header_key))
        .select(*SHEET, "header_row", "names", "keys")
    )
    # One row per sheet from here on.
    return staged(written).select(
        *SHEET, "header_row", _unique_names(F.col("names"), F.col("keys")).alias("names")
    )


def force_headers(facts: DataFrame, grid: DataFrame, forced: DataFrame) -> DataFrame:
    """Replace the header row of the sheets in ``forced`` (``file, sheet_index, header_row``).

    A forced row that is blank leaves the sheet without headers; one that is not in the sheet
    gets a null ``header_row`` and ``out_of_bounds``.
    """
    wanted = forced.select(*SHEET, F.col("header_row").alias("forced_row"))
    rows = grid.join(wanted, SHEET).where(F.col("row_index") == F.col("forced_row"))
    usable = rows.where(row_width(F.col("cells")) > 0).select(
        *SHEET, F.col("row_index").alias("usable_row")
    )
    joined = facts.join(wanted, SHEET, "left").join(usable, SHEET, "left")
    is_forced = F.col("forced_row").isNotNull()
    return joined.select(
        *SHEET,
        "sheet_name",
        F.when(is_forced, F.col("usable_row")).otherwise(F.col("header_row")).alias("header_row"),
        "last_row",
        "bottom",
        (is_forced & ~F.col("forced_row").between(0, F.col("bottom"))).alias("out_of_bounds"),
    )


def data_rows(grid: DataFrame, named: DataFrame) -> DataFrame:
    """Rows below the header that hold something, and how many columns their sheet names.

    The names themselves stay with the sheet.
    """
    heads = named.select(*SHEET, "header_row", F.size("names").alias("columns"))
    return (
        grid.join(heads, SHEET)
        .where((F.col("row_index") > F.col("header_row")) & holds_something(F.col("cells")))
        .select(*SHEET, "sheet_name", "row_index", "columns", "cells")
    )


def classify(
    facts: DataFrame, named: DataFrame, rows: DataFrame, truncated: DataFrame | None = None,
    selection: DataFrame | None = None, scan_depth: int = SCAN_DEPTH,
) -> DataFrame:
    """One row per sheet: data rows, header row, issue, and whether it is included.

    ``searched`` is the number of rows in which a header was looked for, where that may be why
    none was found; ``scan_depth`` must be that of the facts.
    """
    counts = rows.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("row_count"))
    sheets = facts.join(counts, SHEET, "left")
    if truncated is not None:
        cut = truncated.select(*SHEET).distinct().withColumn("cut", F.lit(True))
        sheets = sheets.join(cut, SHEET, "left")
    else:
        sheets = sheets.withColumn("cut", F.lit(False))
    issue = (
        F.when(F.col("last_row").isNull(), EMPTY)
        .when(F.col("header_row").isNull() & (F.col("last_row") >= scan_depth), NOT_WITHIN_DEPTH)
        .when(F.col("header_row").isNull(), NO_HEADERS)
        .when(F.col("cut"), TRUNCATED)
    )
    usable = F.col("header_row").isNotNull() & F.col("last_row").isNotNull()
    included = usable
    if selection is not None:
        chosen = selection.select(*SHEET, F.col("included").alias("chosen"))
        sheets = sheets.join(chosen, SHEET, "left")
        included = usable & F.coalesce("chosen", F.lit(True))
    return sheets.select(
        *SHEET,
        "sheet_name",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        "header_row",
        issue.alias("issue"),
        F.when(issue == NOT_WITHIN_DEPTH, F.lit(scan_depth)).alias("searched"),
        included.alias("included"),
    )


def long_rows(rows: DataFrame, named: DataFrame) -> LongCells:
    """The cells of data rows in the form the profile reads. Missing cells are blank."""
    position = F.explode(F.sequence(F.lit(0), F.col("columns") - 1))
    cell = F.get("cells", F.col("position"))
    rows, tasks, bucket = dealt(rows.where("columns > 0").select(*SHEET, "row_index", "columns", "cells"), F.col("columns"))
    cells = rows.select(*bucket, *SHEET, "row_index", "cells", position.alias("position")).select(
        *bucket, *SHEET, "position", F.col("row_index").alias("row"), *[cell[slot[2:]].alias(slot) for slot in CELL_SLOTS]
    )
    names = named.select(*SHEET, F.posexplode("names").alias("position", "column"))

    def with_names(frame: DataFrame) -> DataFrame:
        joined = frame.join(names, [*SHEET, "position"])
        table = F.concat_ws("/", "file", F.col("sheet_index").cast("string"))
        others = [c for c in frame.columns if c not in (*SHEET, "position")]
        return joined.select(table.alias("table"), "column", "position", *others)

    return LongCells(cells, (*SHEET, "position"), CELL_SLOTS, with_names, tasks)


def sheet_table(rows: DataFrame, names: list[str], file: str, sheet_index: int) -> DataFrame:
    """One sheet as a table of cell structs, one column per name, plus ``row_number``."""
    sheet = rows.where((F.col("file") == file) & (F.col("sheet_index") == sheet_index))
    return sheet.select(
        (F.col("row_index") + 1).alias("row_number"),
        *[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)],
    )

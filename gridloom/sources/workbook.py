"""Workbooks: ``.xlsx`` files as one grid of typed cells.

There are two ways to read them, with the same rows:

* :func:`read_workbooks` lists and fetches files with Spark's binary file source, so any Hadoop file
  system works and files spread over the cluster. A task parses the workbooks that it was given.
* :class:`WorkbookSource`, ``spark.read.format("workbook")`` once registered, has a partition per
  sheet. A task opens its file at random places and reads the directory, the shared texts and
  its own sheet, so one large book is read by as many tasks as it has sheets. Files are opened by
  Arrow's file systems.

Either way rows leave a task while a file is still being read. A file that turns out to be damaged gives a
row with ``error`` beside those, and :func:`sheet_rows` leaves the whole file out.
"""

from __future__ import annotations

import fnmatch
import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.functions.cells import CELL_TYPE
from gridloom.sources import xlsx
from gridloom.session import stored
from gridloom.sources.xlsx import Limits

GRID_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("sheet_index", T.IntegerType()),
        T.StructField("sheet_name", T.StringType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("cells", T.ArrayType(CELL_TYPE)),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)
BATCH_ROWS = 2_000
# Tasks get the parser with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(xlsx)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_workbooks(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """Every row of every sheet. Each sheet also has a marker row with ``row_index`` -1 that
    says whether it was truncated; a file that cannot be read gives one row with ``error``.

    The files are parsed once; the grid is written to the shared folder, for several steps read it.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.xlsx")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return stored(parse_workbooks(files.select("path", "content"), limits), "grid")


def _blocks(rows: Iterator[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    while block := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(block, schema)


def parse_workbooks(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The grid of workbooks given as ``path`` and ``content`` columns."""
    schema, size = to_arrow_schema(GRID_SCHEMA), BATCH_ROWS

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                yield from _blocks(xlsx.workbook_rows(name.as_py(), content.as_py(), limits), schema, size)

    return files.select("path", "content").mapInArrow(parse, GRID_SCHEMA)


@dataclass
class SheetPartition(InputPartition):
    """One sheet of a file, or the reason why the file is not read."""

    file: str
    sheet: int
    reason: str | None = None


class WorkbookReader(DataSourceReader):
    """Plans a partition per sheet from the directories of the files; tasks read one sheet each."""

    def __init__(self, path: str, limits: Limits, pattern: str) -> None:
        self._path, self._limits, self._pattern = path, limits, pattern

    def _system(self) -> tuple[fs.FileSystem, str]:
        """The file system, and the path within it."""
        return fs.FileSystem.from_uri(self._path) if ":/" in self._path else (fs.LocalFileSystem(), self._path)

    def _files(self, system: fs.FileSystem, base: str) -> list[str]:
        if system.get_file_info(base).type == fs.FileType.File:
            return [base]
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        names = (f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self._pattern))
        return sorted(f.path for f in names)

    def partitions(self) -> list[InputPartition]:
        system, base = self._system()
        files = self._files(system, base)

        def sheets(file: str) -> list[InputPartition]:
            try:
                with system.open_input_file(file) as source:
                    book = xlsx.open_book(source, self._limits)
                    if book is None:
                        return [SheetPartition(file, -1, xlsx.TOO_LARGE)]
                    return [SheetPartition(file, i) for i in range(len(book.sheets))]
            except Exception:  # as in the tasks, a damaged file costs itself only
                return [SheetPartition(file, -1, xlsx.UNREADABLE)]

        # A directory is a few reads at the end of a file.
        with ThreadPoolExecutor(16) as pool:
            return [part for parts in pool.map(sheets, files) for part in parts]

    def _rows(self, partition: SheetPartition) -> Iterator[dict]:
        if partition.reason is not None:
            yield xlsx.refused(partition.file, partition.reason)
            return
        try:
            system, _ = self._system()
            with system.open_input_file(partition.file) as source:
                book = xlsx.open_book(source, self._limits)
                yield from xlsx.sheet_rows(partition.file, book, partition.sheet, self._limits)
        except Exception:  # whatever a damaged file raises, it costs that file and not the job
            yield xlsx.refused(partition.file, xlsx.UNREADABLE)

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        return _blocks(self._rows(partition), to_arrow_schema(GRID_SCHEMA), BATCH_ROWS)


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(path)``: the grid of a file or a folder of files.

    Options: ``sheets``, ``rows``, ``columns``, ``unzippedBytes`` (caps, none by default) and
    ``pathGlobFilter``. Use :func:`register` first.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        return GRID_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        def cap(name: str) -> int | None:
            value = self.options.get(name)
            return None if value is None else int(value)

        limits = Limits(cap("sheets"), cap("rows"), cap("columns"), cap("unzippedBytes"))
        return WorkbookReader(self.options["path"], limits, self.options.get("pathGlobFilter", "*.xlsx"))


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("workbook")`` known to a session."""
    spark.dataSource.register(WorkbookSource)


def sheet_rows(grid: DataFrame) -> DataFrame:
    """The grid of the files that were read whole: no row of a file that has an error.

    The grid is read twice, so it should be one that is written, as by :func:`read_workbooks`.
    """
    bad = grid.where(F.col("error").isNotNull()).select("file").distinct()
    return grid.where(F.col("error").isNull()).drop("error").join(bad, "file", "left_anti")


def capped(grid: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Apply read caps to a grid from elsewhere: the grid, and the sheets that a cap cut."""
    everything = F.lit(True)
    sheet = everything if limits.sheets is None else F.col("sheet_index") < limits.sheets
    row = everything if limits.rows is None else F.col("row_index") < limits.rows
    kept = grid.where(sheet & row)
    wide = F.lit(False)
    if limits.columns is not None:
        kept = kept.withColumn("cells", F.slice("cells", 1, limits.columns))
        wide = F.exists(
            F.slice("cells", limits.columns + 1, 2**31 - 1 - limits.columns),
            lambda cell: cell["kind"].isNotNull(),
        )
    cut = grid.where(~sheet | ~row | wide).select("file", "sheet_index").distinct()
    return kept, cut


def truncated_sheets(grid: DataFrame) -> DataFrame:
    return grid.where("truncated").select("file", "sheet_index")


def unreadable_files(grid: DataFrame) -> DataFrame:
    return grid.where(F.col("error").isNotNull()).select("file", "error")


def cells(grid: DataFrame) -> DataFrame:
    """The grid in long form: one row per cell that holds a value."""
    return (
        grid.where(F.col("row_index") >= 0)
        .select("file", "sheet_index", "sheet_name", "row_index", F.posexplode("cells"))
        .withColumnRenamed("pos", "col_index")
        .select("file", "sheet_index", "sheet_name", "row_index", "col_index", "col.*")
        .where(F.col("kind").isNotNull())
    )

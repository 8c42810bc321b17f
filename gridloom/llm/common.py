"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.session import scratch_folder

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows that Spark hands to a Python worker at once; texts make them large.
BATCH_ROWS, BATCH_SETTING = "2000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def write_small_batches(df: DataFrame, path: str) -> None:
    """Write; Python workers get smaller batches meanwhile, then the session's setting is put back."""
    conf = df.sparkSession.conf
    before = conf.get(BATCH_SETTING)
    conf.set(BATCH_SETTING, BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        conf.set(BATCH_SETTING, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut."""
    path = scratch_folder(df.sparkSession, name)
    write_small_batches(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame, function: Callable[[dict[str, list]], dict[str, object]], schema: str, rows: int = 512
) -> DataFrame:
    """``function`` from columns to columns over batches of at most ``rows`` rows."""
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                columns = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
                out = function(columns)
                made = pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in wanted], schema=wanted
                )
                if made.num_rows:
                    yield made

    return df.mapInArrow(run, schema)


def map_arrow(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str
) -> DataFrame:
    """``function`` from batches to columns by name."""
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in wanted], schema=wanted)

    return df.mapInArrow(run, schema)


def small_set(keys: DataFrame, most: int) -> np.ndarray | None:
    """Sorted values of a one-column table, or None if they are more than tasks should hold."""
    if keys.count() > most:
        return None
    return np.unique(np.asarray(keys.toArrow().column(0)).astype(np.int64))


def is_in(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``known``."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix of unsigned integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ascii_lower(column) -> object:
    return F.translate(column, UPPER, LOWER)


class WordHashes(dict):
    """Word to a 64-bit hash; forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 200_000) -> None:
        super().__init__()
        self._most = most

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= self._most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers by place, so that a sequence of words and another order of it differ.
PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    np.uint64,
)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; with fewer words, of all of them as one."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * PLACES[i]
    return mixed(total + np.uint64(n))

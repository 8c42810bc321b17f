"""Line deduplication over levelled sorted runs of line hashes (DataFrame functions only).

A run is a table of line hashes sorted and bucketed by hash, with the number of documents that
hold the line and the largest of their ids. Documents come in batches. A batch is reduced to one
row per hash and merge-anti-joined with the runs: a hash in no run is marked as first seen there,
all others are increments. The batch then becomes a run of level 0; when a level has ``fanout``
runs they are compacted into one of the next. As a run is bucketed by hash, the joins move the
batch but not what was stored before.

Defined results: a null or empty text is one empty line; lines shorter than ``min_chars`` are
never dropped; a line repeated within one document counts once, and all its repeats go or stay
together; rows that repeat a doc_id count as one document; a null doc_id is a document of its own
that no id exceeds, so its lines are dropped wherever another document holds them. An empty table
gives an empty result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACES, ascii_lower, table, written
from gridloom.session import scratch_folder

HASH = ["h1", "h2"]
#: Orders below every id, so that a document without one never keeps a shared line.
NO_ID = -(2**63)


class LineRuns:
    """The runs of all batches so far."""

    def __init__(self, spark, fanout: int = 3, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, occurrences: DataFrame) -> None:
        """One batch: rows of h1, h2, doc_id."""
        batch = (
            occurrences.groupBy(*HASH, "doc_id").agg(F.lit(1).alias("one"))
            .groupBy(*HASH).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
            .withColumn("first", F.lit(True))
        )
        for run in self.runs():
            seen = run.filter("first").select(*HASH, F.lit(False).alias("unseen"))
            batch = batch.join(seen, HASH, "left").withColumn(
                "first", F.col("first") & F.coalesce("unseen", F.lit(True))
            ).drop("unseen")
        self.levels[0].append(self._sorted_run(batch))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        merged = merged_runs(self.levels[level])
        self.levels[level] = []
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(self._sorted_run(merged))

    def _sorted_run(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid4().hex}"
        (
            rows.repartition(self.buckets, "h1").write.format("parquet")
            .bucketBy(self.buckets, "h1").sortBy(*HASH)
            .option("path", scratch_folder(self.spark, "line-run")).saveAsTable(name)
        )
        run = self.spark.table(name)
        run.schema  # resolve the files before the name goes
        self.spark.sql(f"DROP TABLE {name}")
        return run

    def state(self) -> DataFrame:
        """h1, h2, docs, last of every line: its new row and the increments to it."""
        # Dealt anew, as in merged_runs.
        rows = union_of(self.runs())
        new = rows.filter("first").select(*HASH, "docs", "last").repartition(*HASH)
        more = rows.filter("NOT first").repartition(*HASH).groupBy(*HASH).agg(
            F.sum("docs").alias("more_docs"), F.max("last").alias("more_last")
        )
        return new.join(more, HASH, "left").select(
            *HASH, (F.col("docs") + F.coalesce("more_docs", F.lit(0))).alias("docs"),
            F.greatest("last", "more_last").alias("last"),
        )


def union_of(runs: list[DataFrame]) -> DataFrame:
    rows = runs[0]
    for run in runs[1:]:
        rows = rows.unionByName(run)
    return rows


def merged_runs(runs: list[DataFrame]) -> DataFrame:
    # Dealt anew: Spark may take a union of bucketed tables as partitioned and then read them
    # unbucketed. A key is in a run once at most, so nothing would combine before the shuffle.
    return union_of(runs).repartition(*HASH).groupBy(*HASH).agg(
        F.sum("docs").alias("docs"), F.max("last").alias("last"), F.max("first").alias("first")
    )


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def dedup_lines(
    docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 3
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text of the lines that stay)."""
    spark = docs.sparkSession
    docs = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("__row", F.xxhash64("text"))
    split = F.split("text", "\n", -1)
    lines = (
        docs.select(F.col("__id").alias("doc_id"), "__row", F.posexplode(split).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.length("key") >= min_chars)
        .select(
            "doc_id", "__row", "pos",
            F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
            F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(batches)).cast("int").alias("batch"),
        )
    )
    lines = written(lines, "lines")
    runs = LineRuns(spark, fanout)
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch).select(*HASH, "doc_id"))
    # Written: the join then deals both sides itself, and Spark can split a hot line's rows.
    shared = written(runs.state().filter(F.col("docs") >= min_docs).select(*HASH, "last"), "shared-lines")
    dropped = (
        lines.join(shared, HASH).filter(F.col("doc_id") < F.col("last"))
        .groupBy(F.col("doc_id").alias("__id"), "__row").agg(F.collect_set("pos").alias("gone"))
    )
    # Positions are looked up by hash set and by index: linear in the lines of a document.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return (
        docs.join(dropped, ["__id", "__row"], "left")
        .withColumn("lines", split)
        .select(
            "doc_id",
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("gone").isNull(), F.col("text"))
            .otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
            .alias("kept"),
        )
    )


def op5_line_dedup(spark, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")
    )


_KEY = """translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
OP5_SQL = f"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM parts
), keyed AS (
  SELECT doc_id, pos, line, {_KEY} AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, pos, line, coalesce(k.doc_id < last, false) AS gone
  FROM keyed k LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

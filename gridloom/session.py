"""Session helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, shared on a cluster.

    Only a local session that names none gets a temporary folder.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="gridloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for a table that is written and read back."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that later steps read only the columns
    they use and do not compute it again."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Beyond so many bytes the JVM interprets a method and never compiles it.
_COMPILED_BYTES = 8000


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Within, Spark splits generated methods that the JVM would not compile; a session's own limit stays."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, _COMPILED_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(name)


def local_session(cores: str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        # Larger methods are not compiled by the JVM; let Spark split them instead.
        .config("spark.sql.codegen.hugeMethodLimit", str(_COMPILED_BYTES))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

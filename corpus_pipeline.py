"""The corpus pipeline: stages over ``documents``, each written as Parquet and read back.

Every stage takes all rows that the one before kept. All but the last return the columns of
documents; the last returns what its token files hold.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard, mixing, tokens, toxicity
from gridloom.llm.common import table, written
from gridloom.session import scratch_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.7 or more. Null and empty texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.flag_toxic(docs, model).filter("NOT __toxic").drop("__toxic")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the smallest id.

    Rows are told apart by id and text together: other texts under the same id are other documents,
    and of equal rows one stays. A row without an id stays only if no row of its group has one.
    Documents without words stay.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    grouped = jaccard.jaccard_components(keyed.select(F.col("__key").alias("doc_id"), "text"), n=5, percent=80)
    found = written(
        grouped.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("__key"), "component_id").count(), "components"
    )
    # False sorts first, and so do ids before no id.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")
    first = (
        keyed.select("__key", "doc_id").join(found, "__key")
        .groupBy("component_id").agg(F.min(order).alias("first")).select("first.__key")
    )
    gone = written(found.select("__key").join(first, "__key", "left_anti"), "gone")
    kept = keyed.join(gone, "__key", "left_anti")
    again = written(found.filter("count > 1").select("__key").join(gone, "__key", "left_anti"), "again")
    if again.isEmpty():
        return kept.select(docs.columns)
    repeated = kept.join(again, "__key", "left_semi")
    one = repeated.groupBy("__key").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row"))
    return kept.join(again, "__key", "left_anti").select(docs.columns).unionByName(one.select("__row.*"))


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a copy of a benchmark item.

    Found by text, so that ids may be null or repeat.
    """
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text").filter("text IS NOT NULL")
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"))
    found = written(found.select(F.col("doc_id").alias("__text")).distinct(), "contaminated")
    return docs.withColumn("__key", F.xxhash64("text")).join(
        found, F.col("__key") == F.col("__text"), "left_anti"
    ).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate draws, in shuffled order."""
    return mixing.mix_sources(docs, mixing.rates(docs)).select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from the written files."""
    path = scratch_folder(spark, "tokens")
    tokens.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), keep=False)
    return tokens.token_digests(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_test_items),
    ("mixing", mix),
    ("tokens", to_tokens),
]

#: Toxicity is learned, near copies are connected and passages are aligned: SQL can't express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs

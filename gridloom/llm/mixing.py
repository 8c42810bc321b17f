"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of all characters over its share as it is. Each
document is repeated as often as a Poisson variable with that mean says: the distribution is
inverted at a uniform number that a seed and the document's hash give, so reruns and retries draw
the same. Copies are exploded and dealt over all partitions by a hash, and sorted by it within
them: a global shuffle.

The probabilities are built once per source, in logarithms, up to far beyond what 32 bits can draw;
no rate is capped. Sources join by value, null as one of its own, and Spark splits large ones.

Defined results: a source without characters has rate 1. A null id or text hashes as a fixed
word; rows alike in id and text draw alike. Columns of the input that are named ``copy`` or
``shuffle_key`` are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import table, written

SEED, POWER = "mix-1", 0.7


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER,
          epochs: float = 1.0) -> DataFrame:
    """__source, __rate. Without ``weights`` a source weighs its characters to ``power``."""
    sizes = docs.groupBy(F.col("source").alias("__source")).agg(
        F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars")
    )
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("chars", F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "given string, weight double"
        )
        sizes = sizes.join(given, F.col("__source").eqNullSafe(F.col("given")), "left").select(
            "__source", "chars", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    # Two numbers.
    chars, weight = sizes.agg(F.sum("chars"), F.sum(F.when(F.col("chars") > 0, F.col("weight")))).first()
    if not chars or not weight:
        return sizes.select("__source", F.lit(float(epochs)).alias("__rate"))
    share = F.col("weight") / F.lit(weight) * F.lit(chars * epochs) / F.col("chars")
    return sizes.select("__source", F.when(F.col("chars") > 0, share).otherwise(F.lit(1.0)).alias("__rate"))


def poisson_steps(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... to where the rest is below 2 ** -40."""
    last = F.ceil(rate + F.sqrt(rate) * 12 + 40).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.log(rate) - F.log(k.cast("double"))
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"),
                        F.concat(state["steps"], F.array(total)).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["steps"]).otherwise(
        F.array(F.lit(1.0))
    )


def uniform(seed: str) -> Column:
    """Of (0, 1), from the first 32 bits of a digest."""
    words = [F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
             F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-"))]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *words)), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def mix_sources(docs: DataFrame, rate_table: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows of ``docs`` as often as drawn, with ``copy`` (from 1) and ``shuffle_key``."""
    # Written, so that Spark knows its size before it plans the join.
    steps = written(rate_table.select("__source", poisson_steps(F.col("__rate")).alias("__steps")), "rates")
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    drawn = (
        docs.select(*columns)
        .withColumn("__draw", uniform(seed))
        .join(steps, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__count", F.size(F.filter("__steps", lambda p: p < F.col("__draw"))))
        .filter("__count > 0")
        .select(*columns, F.explode(F.sequence(F.lit(1), F.col("__count"))).alias("copy"))
    )
    key = F.substring(
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                          F.col("copy").cast("string"))), 1, 16,
    )
    # The place of a row with the same id and copy as another is not defined by the key alone.
    spread = F.xxhash64("shuffle_key", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return drawn.withColumn("shuffle_key", key).repartition(parts, spread).sortWithinPartitions("shuffle_key")


def op2_mix_sources(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mix_sources(docs, rates(docs))


OP2_SQL = f"""
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY source
), rates AS (
  SELECT source, CASE WHEN chars > 0
    THEN pow(chars, {POWER}) / (SELECT sum(pow(chars, {POWER})) FROM sizes)
         * (SELECT sum(chars) FROM sizes) / chars
    ELSE 1 END AS rate
  FROM sizes
), terms AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM rates, range(0, (SELECT CAST(max(rate + 12 * sqrt(rate) + 41) AS BIGINT) FROM rates)) AS r(k)
), steps AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM terms
), drawn AS (
  SELECT *, (CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|'
             || coalesce(md5(text), '-')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS draw
  FROM documents
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.upto < d.draw) AS n
  FROM drawn d
), copies AS (
  SELECT * EXCLUDE (n), CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM counted
)
SELECT *, substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || copy), 1, 16) AS shuffle_key
FROM copies
"""

"""Centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors are integers. They are put in the order of a Hilbert curve over all their components and
cut into blocks, so that a block holds neighbours; each block has the least and greatest value of every
component. The distance of a centroid to that box, and to its farthest corner, bounds its distance to every
vector of the block: only centroids whose least distance is not beyond the smallest farthest one are
candidates there. They are compared exactly, all vectors of the block at once.

The blocks are written once and read by every round. A task returns one sum per cluster, so what is
shuffled and what reaches the driver is bounded by centroids and components, not by vectors.
The curve's ties are dealt by id, so equal vectors do not meet in one task.

Defined results: vectors of another length, null, or with a null or non-finite component take no part.
Equal distances go to the smaller number. A vector without an id is clustered but never
becomes a first centroid. Rows that repeat an id are vectors of their own. With fewer vectors than
centroids there are as many centroids as vectors with an id. No vectors give no rows. Means are rounded down
exactly; squared distances must fit in 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_arrow, table, written

#: Vectors of a block, and bits of each component that the curve looks at.
BLOCK, BITS = 1024, 3
EXACT = 2.0**53


def curve_keys(levels: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of points with components below ``2 ** bits``, as sortable bytes.

    Skilling's transform, over all points at once.
    """
    points, n = levels.astype(np.uint32).T.copy(), levels.shape[1]
    for bit in range(bits - 1, 0, -1):
        below = np.uint32((1 << bit) - 1)
        for i in range(n):
            high = (points[i] >> np.uint32(bit)) & np.uint32(1) == 1
            swapped = np.where(high, 0, (points[0] ^ points[i]) & below)
            points[0] ^= np.where(high, below, swapped)
            points[i] ^= swapped
    points = np.bitwise_xor.accumulate(points, axis=0)
    flips = np.zeros(points.shape[1], np.uint32)
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where((points[n - 1] >> np.uint32(bit)) & np.uint32(1), np.uint32((1 << bit) - 1), np.uint32(0))
    points ^= flips
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)[:, None, None]
    digits = ((points[None] >> shifts) & np.uint32(1)).astype(np.uint8).reshape(bits * n, -1)
    packed = np.packbits(digits.T, axis=1)
    return [row.tobytes() for row in packed]


def whole_vectors(df: DataFrame, dim: int, scale: int = 64) -> DataFrame:
    """vec_id and v: the components of vectors of ``dim`` finite ones, times ``scale`` and rounded down."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _narrowest(low: int, high: int) -> str:
    for kind in ("i1", "<i2", "<i4"):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return kind
    return "<i8"


BLOCK_SCHEMA = "ids array<long>, kind string, data binary, low binary, high binary"


def blocks(vectors: DataFrame, dim: int, rows: int = BLOCK, bits: int = BITS) -> DataFrame | None:
    """Blocks of neighbours with their boxes; None without vectors."""
    least, most = vectors.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if least is None:
        return None
    span, top = most - least + 1, (1 << bits) - 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if batch.num_rows:
                values = _matrix(batch.column(1), dim)
                levels = np.minimum((values - float(least)) / span * (top + 1), top).astype(np.uint32)
                yield {"vec_id": batch.column(0), "v": batch.column(1), "curve": curve_keys(levels, bits)}

    def packed(ids: list, values: np.ndarray) -> dict:
        kind = _narrowest(int(values.min()), int(values.max()))
        box = [[f(values, axis=0).astype("<i8").tobytes()] for f in (np.min, np.max)]
        return {"ids": [ids], "kind": [kind], "data": [values.astype(kind).tobytes()], "low": box[0], "high": box[1]}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, held = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            held.append(_matrix(batch.column(1), dim))
            while len(ids) >= rows:
                values = np.concatenate(held)
                yield packed(ids[:rows], values[:rows])
                ids, held = ids[rows:], [values[rows:]]
        if ids:
            yield packed(ids, np.concatenate(held))

    # Written first: dealing by range looks at the keys twice.
    placed = written(map_arrow(vectors.select("vec_id", "v"), place, "vec_id long, v array<long>, curve binary"), "curve")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(parts, "curve", F.xxhash64("vec_id"), F.monotonically_increasing_id())
    ordered = dealt.sortWithinPartitions("curve").select("vec_id", "v")
    return written(map_arrow(ordered, pack, BLOCK_SCHEMA), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector in the box, ascending."""
    outside = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    farthest = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return np.flatnonzero((outside**2).sum(axis=1) <= (farthest**2).sum(axis=1).min())


def nearest(values: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest of ``numbers`` and squared distance, for every row."""
    chosen = centroids[numbers]
    reach = float(np.abs(values).max(initial=0)) + float(np.abs(chosen).max(initial=0))
    # Floating point is exact, and much faster, while all sums stay below its whole numbers.
    kind = np.float64 if 2 * reach * reach * values.shape[1] < EXACT else np.int64
    x, c = values.astype(kind), chosen.astype(kind)
    far = (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)
    best = far.argmin(axis=1)
    return numbers[best], far[np.arange(len(far)), best].astype(np.int64)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    """Ids, vectors, numbers and distances block by block."""
    dim = centroids.shape[1]
    for batch in batches:
        for row in batch.to_pylist():
            values = np.frombuffer(row["data"], row["kind"]).reshape(-1, dim).astype(np.int64)
            box = np.frombuffer(row["low"], "<i8"), np.frombuffer(row["high"], "<i8")
            yield row["ids"], values, *nearest(values, centroids, candidates(*box, centroids))


def moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: means rounded down, empty ones where they were."""
    k, dim = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, values, numbers, _ in _assigned(batches, centroids):
            order = np.argsort(numbers, kind="stable")
            present, starts = np.unique(numbers[order], return_index=True)
            sums[present] += np.add.reduceat(values[order], starts, axis=0)
            counts += np.bincount(numbers, minlength=k)
        met = np.flatnonzero(counts)
        yield {"cluster": met, "n": counts[met], "sums": list(sums[met])}

    parts = map_arrow(packed, add, "cluster int, n long, sums array<long>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")
    )
    after = centroids.copy()
    # One row per centroid and component.
    for row in totals.collect():
        after[row.cluster, row["at"]] = int(row.x) // row.n
    return after


def cluster(packed: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of every vector after ``rounds`` rounds, and the centroids."""
    for _ in range(rounds):
        centroids = moved(packed, centroids)
    schema = "vec_id long, cluster int, distance long"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, _, numbers, far in _assigned(batches, centroids):
            yield {"vec_id": ids, "cluster": numbers, "distance": far}

    return map_arrow(packed, assign, schema), centroids


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id IS NOT NULL").select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clustered(vectors: DataFrame, dim: int, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """Cluster, distance, inertia and a hash of the centroid for every vector."""
    spark = vectors.sparkSession
    vectors = written(vectors, "vectors")
    start = first_centroids(vectors, k, seed)
    packed = blocks(vectors, dim) if len(start) else None
    if packed is None:
        return spark.createDataFrame([], RESULT)
    assigned, centroids = cluster(packed, start, rounds)
    assigned = written(assigned, "assigned")
    totals = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, total, sum(totals.values()), names[c]) for c, total in totals.items()]
    # A row per centroid.
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(*(c.split()[0] for c in RESULT.split(", ")))


def op12_clusters(spark, folder: str) -> DataFrame:
    return clustered(whole_vectors(table(spark, folder, "embeddings"), 64), 64)


def _sql(rounds: int = 3) -> str:
    far = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS k, e
  FROM v WHERE vec_id IS NOT NULL ORDER BY k LIMIT 16
)""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT n, vec_id, e, min(struct_pack(d := d, k := k)) AS near
  FROM (SELECT v.n, v.vec_id, v.e, c.k, {far} AS d FROM v, c{r} c) GROUP BY n, vec_id, e
)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (
  SELECT k, list(x ORDER BY i) AS e FROM (
    SELECT k, i, CAST((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*) AS BIGINT) AS x
    FROM (SELECT near.k AS k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY k, i
  ) GROUP BY k
), c{r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k
)"""
            )
    return (
        "WITH " + ", ".join(steps) + f"""
SELECT a.vec_id, CAST(a.near.k AS INTEGER) AS cluster, CAST(a.near.d AS BIGINT) AS distance,
       CAST(sum(a.near.d) OVER (PARTITION BY a.near.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.near.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.near.k = c.k
"""
    )


OP12_SQL = _sql()

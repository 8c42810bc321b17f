"""Exact top-k inner-product search by distributed selection on score histograms.

Every query is scored against every candidate once, block against block. A first part of the
candidates comes first: the histogram of each query's best scores there, summed over the blocks,
tells a score and an id that its k-th result cannot fall behind. The other candidates are then
compared with that bound as they are scored, so that few of them leave their task, and what is left
of both parts is ranked. The first part only sets bounds: its size changes the time, not the rows.

A task never reports more than the k best of its block to a query: others can't be in the result, so
this loses nothing and bounds what is sent where bounds do not help. Products are taken in the
narrowest type that holds every partial sum, by Cauchy-Schwarz.

Defined results: vectors that are null or hold a null or non-finite component take no part, as
query or candidate. Shorter vectors are filled with zeros. A repeated id is a candidate as often as
it occurs but asks once, with its smallest vector; rows with the query's own id are never its
result. Fewer than k candidates are all returned. Rows with a null id take no part. Integer scores
must fit in 64 bits. Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import map_arrow, table, written

#: Most rows of the blocks that a task compares; candidates are held, also in bytes, and queries pass by.
QUERY_ROWS, CANDIDATE_ROWS, CANDIDATE_BYTES = 1 << 19, 1 << 18, 1 << 24
#: Pairs are dealt to as many tasks as these, fewer only if each would have less than so many pairs.
TASKS, TASK_PAIRS = 48, 1 << 22
#: Query blocks at least in the first part, where each block of candidates reports k rows a query.
FIRST_QUERY_BLOCKS = 12
#: The first part has so many times the root of all candidates: bounds and survivors cost alike then.
FIRST = 128
#: Queries that are compared with a block at once, and rows of a product, which stays in the cache.
GROUP, SLICE, CHUNK = 4096, 512, 1024
#: Bytes of vectors in a pack; packs are what is shuffled.
PACK_BYTES = 1 << 14
#: Below these, sums of integers are exact in 32 and 64 bits of floating point.
EXACT = ((2.0**24, np.float32), (2.0**53, np.float64))
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: The signs of four numbers of 16 bits.
SIGNS = np.uint64(0x8000800080008000)
KINDS = (("byte", np.int8), ("short", np.int16), ("int", np.int32), ("long", np.int64))


def integer_vectors(df: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, the components times ``scale`` rounded down."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
    )


def _pack(batches: Iterator[pa.RecordBatch], dim: int, kind: type, rows: int) -> Iterator[dict]:
    """Packs of rows: all columns before the last as 64-bit numbers, the vectors filled to ``dim``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            *others, vectors = batch.slice(start, rows).columns
            numbers = np.stack([np.asarray(c, np.int64) for c in others], axis=1)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            data = np.zeros((len(vectors), dim), kind)
            data[np.arange(dim) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
            yield {"numbers": [numbers.tobytes()], "data": [data.tobytes()]}


def packed(df: DataFrame, dim: int, kind: type, rows: int, name: str) -> DataFrame:
    """Numbered packs of ``df``, written."""
    packs = map_arrow(df, partial(_pack, dim=dim, kind=kind, rows=rows), "numbers binary, data binary")
    # Packs of a partition are dealt in turn, and each partition starts elsewhere.
    place = F.monotonically_increasing_id()
    number = place.bitwiseAND(F.lit((1 << 33) - 1)) + F.shiftright(place, 33) * 7919
    return written(packs.withColumn("number", number), name)


def _unpacked(packs: list[tuple], dim: int, kind: type, columns: int) -> tuple[np.ndarray, np.ndarray]:
    numbers, data = (b"".join(x) for x in zip(*packs, strict=True))
    return np.frombuffer(numbers, np.int64).reshape(-1, columns), np.frombuffer(data, kind).reshape(-1, dim)


def _longest(data: np.ndarray) -> float:
    return float(np.sqrt(np.square(data, dtype=np.float64).sum(axis=1)).max())


class Group:
    """Queries that are compared with a block at once, and what counts for each of them.

    ``numbers`` are the query's id, the least score that counts and the largest id that counts with
    just that score.
    """

    def __init__(self, numbers: np.ndarray, data: np.ndarray) -> None:
        self.own, self.least, self.last = (numbers[:, i].copy() for i in range(3))
        self.longest, self.paired_from = _longest(data), 0
        self._data, self._turned, self._pairs = data, {}, {}

    def turned(self, kind: type) -> np.ndarray:
        if kind not in self._turned:
            self._turned[kind] = self._data.astype(kind)
        return self._turned[kind]

    def pairs(self, part: slice, gain: int) -> np.ndarray:
        """The first half of a part, 2**16 times, plus the second half ``gain`` times; two columns more."""
        known, both = self._pairs.get(part.start, (0, None))
        if known != gain:
            queries = self.turned(np.float32)[part]
            half = -(-len(queries) // 2)
            both = np.zeros((half, queries.shape[1] + 2), np.float32)
            # Without a second query nothing counts.
            both[:, -2] = -(1 << 14)
            both[:, :-2] = queries[:half] * np.float32(1 << 16)
            both[: len(queries) - half, :-2] += queries[half:] * np.float32(gain)
            self._pairs[part.start] = gain, both
        return both


class Block:
    """Candidates in order of id, and the best of them for groups of queries."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int) -> None:
        order = np.argsort(ids, kind="stable")
        self._ids, self._data, self._k = ids[order], data[order], k
        self._longest = [_longest(self._data[i : i + CHUNK]) for i in range(0, len(ids), CHUNK)]
        self._scores = {kind: np.empty(SLICE * CHUNK, kind) for _, kind in EXACT}
        self._whole = np.empty(SLICE * CHUNK + 2, "<i4")

    def best(self, group: Group) -> dict[str, np.ndarray]:
        """query_id, vec_id and score of the k best of each query, as far as they count."""
        least, last = group.least, group.last
        found, new, waiting = _NOTHING, [], 0
        for chunk, start in enumerate(range(0, len(self._ids), CHUNK)):
            ids, rows = self._ids[start : start + CHUNK], self._data[start : start + CHUNK]
            # Ids grow, so from here on ties with the bound come too late.
            late = last < ids[0]
            least[late] += 1
            last[late] = HIGHEST
            reach = 1.000001 * group.longest * self._longest[chunk]
            kind = next((kind for most, kind in EXACT if reach < most), np.int64)
            candidates = np.ones((rows.shape[1] + 2, len(rows)), kind)
            candidates[:-2] = rows.T
            for a in range(0, len(least), SLICE):
                part, reached = slice(a, a + SLICE), None
                if kind is np.float32 and chunk >= group.paired_from:
                    reached = self._reached_in_pairs(group, part, candidates, rows, reach)
                    if reached is None:
                        group.paired_from = 2 * chunk + 1
                row, place, score = reached or self._reached(group, part, candidates[:-2], ids)
                row += a
                counts = (ids[place] != group.own[row]) & ((score > least[row]) | (ids[place] <= last[row]))
                new.append((row[counts], place[counts] + start, score[counts]))
                waiting += len(new[-1][0])
                if waiting > max(len(least) * self._k, 1 << 17):
                    found, new, waiting = self._merged(found, new, group), [], 0
        row, place, score = self._merged(found, new, group)
        return {"query_id": group.own[row], "vec_id": self._ids[place], "score": score}

    def _product(self, queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        if queries.dtype.type not in self._scores:
            return queries @ candidates
        shape = len(queries), candidates.shape[1]
        out = self._scores[queries.dtype.type][: shape[0] * shape[1]].reshape(shape)
        return np.matmul(queries, candidates, out=out)

    def _reached(self, group: Group, part: slice, candidates: np.ndarray, ids: np.ndarray) -> tuple:
        """Row, place and score of what reaches ``least``, and the k-th score of its row in this chunk."""
        scores = self._product(group.turned(candidates.dtype.type)[part], candidates)
        k, low = self._k, group.least[part].astype(scores.dtype)[:, None]
        at = np.flatnonzero(scores >= low)
        if len(at) > 2 * k * len(scores) and k < len(ids):
            others = np.where(ids == group.own[part][:, None], np.array(LOWEST, scores.dtype), scores)
            at = np.flatnonzero(scores >= np.maximum(low, np.partition(others, -k, axis=1)[:, [-k]]))
        row, place = np.divmod(at, len(ids))
        return row, place, scores.ravel()[at].astype(np.int64)

    def _reached_in_pairs(
        self, group: Group, part: slice, candidates: np.ndarray, rows: np.ndarray, reach: float
    ) -> tuple | None:
        """The same with half the products, or None where they can't hold two scores or too many come near.

        With d and e what the scores of a pair of queries are above their least ones, a product is
        2**16 * (d + 1) + gain * (e + shift), but for the error of a sum in floating point, of which
        the usual bound holds in any order. As whole numbers the upper 16 bits are d or d + 1. The lower
        ones hold the rest with its sign, as ``gain`` is small enough, and if e is not negative they
        aren't either, as ``shift`` makes up for the error. So nothing with a clear sign in neither half
        counts. The others are scored again, exactly.
        """
        least = group.least[part]
        top = int(reach) + 2
        if least.min() < 0 or top > 1 << 13 or len(candidates) > 1 << 17 or group.longest > 255:
            return None
        least = np.minimum(least, top)
        most = int(least.max())
        error = 1.03 * len(candidates) * 2.0**-8 * (reach + most + 4)
        gain = min(128, 1 << int((2**15 - 1) / (reach + most + 1)).bit_length() - 1)
        shift = int(error / gain) + 1
        if gain * (reach + shift) + error >= 2**15:
            return None
        both = group.pairs(part, gain)
        half, width = len(both), candidates.shape[1]
        both[:, -1] = (1 - least[:half]) * 2.0**16
        both[: len(least) - half, -2] = gain * (shift - least[half:])
        product = self._product(both, candidates).ravel()
        whole = self._whole[: len(product) + len(product) % 2]
        whole[-1] = -1
        np.copyto(whole[: len(product)], product, casting="unsafe")
        fours = whole.view("<u8")
        np.bitwise_and(fours, SIGNS, out=fours)
        near = np.flatnonzero(fours != SIGNS)
        if len(near) > len(product) // 128:
            return None
        at, lane = np.nonzero(fours[near].view("<i2").reshape(-1, 4) == 0)
        # The lower 16 bits come first, and are of the second half.
        row, place = np.divmod(near[at] * 2 + lane // 2, width)
        row += half * (1 - lane % 2)
        order = np.flatnonzero(row < len(least))
        order = order[np.argsort(row[order], kind="stable")]
        row, place = row[order], place[order]
        queries = group.turned(np.float32)[part]
        score = np.einsum("ij,ij->i", queries[row], rows[place].astype(np.float32)).astype(np.int64)
        counts = score >= least[row]
        return row[counts], place[counts], score[counts]

    def _merged(self, found: tuple, new: list[tuple], group: Group) -> tuple:
        """The k best of each row; where there are k, later candidates must be above the last of them."""
        row, place, score = (np.concatenate(x) for x in zip(found, *new, strict=True))
        # Places grow within a row, and the sort is stable.
        order = np.lexsort((-score, row))
        row, place, score = row[order], place[order], score[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
        full = rank == self._k - 1
        group.least[row[full]] = score[full] + 1
        group.last[row[full]] = HIGHEST
        kept = rank < self._k
        return row[kept], place[kept], score[kept]


_NOTHING = tuple(np.empty(0, np.int64) for _ in range(3))


def _compared(batches: Iterator[pa.RecordBatch], dim: int, kind: type, k: int) -> Iterator[dict]:
    """The best candidates of each query in its unit; a unit's candidates come before its queries."""
    unit, block, candidates, queries, waiting = None, None, [], [], 0

    def answers() -> Iterator[dict]:
        nonlocal block, candidates, queries, waiting
        if queries and candidates:
            numbers, data = _unpacked(candidates, dim, kind, 1)
            block, candidates = Block(numbers[:, 0], data, k), []
        if queries and block is not None:
            numbers, data = _unpacked(queries, dim, kind, 3)
            for i in range(0, len(numbers), GROUP):
                yield block.best(Group(numbers[i : i + GROUP], data[i : i + GROUP]))
        queries, waiting = [], 0

    for batch in batches:
        for u, asks, numbers, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if u != unit:
                yield from answers()
                unit, block, candidates = u, None, []
            if not asks:
                candidates.append((numbers, data))
                continue
            queries.append((numbers, data))
            waiting += len(numbers) // 24
            if waiting >= GROUP:
                yield from answers()
    yield from answers()


def _bounds(kept: DataFrame, k: int) -> DataFrame:
    """vec_id of each query with k candidates or more, the k-th score, and the last id that has it.

    By the histogram of the scores: there are k candidates at that score or above, so that a lower
    score, or the same with a larger id, is in no result.
    """
    from_top = Window.partitionBy("query_id").orderBy(F.desc("score"))
    return (
        kept.repartition("query_id").groupBy("query_id", "score")
        .agg(F.count("*").alias("n"), F.max("vec_id").alias("last"))
        .withColumn("upto", F.sum("n").over(from_top)).filter(F.col("upto") >= k)
        .groupBy(F.col("query_id").alias("vec_id"))
        .agg(F.max("score").alias("least"), F.max_by("last", "score").alias("last"))
    )


def top_k(
    vectors: DataFrame, is_query, k: int = 20,
    query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS, first_rows: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score of integer ``vectors``; ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    vectors = written(vectors.select("vec_id", "v"), "vectors")
    n, dim, low, high = vectors.agg(
        F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))
    ).first()
    result = "query_id long, vec_id long, score long"
    asking = vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asking.count()
    if not asked:
        empty = spark.createDataFrame([], result)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    dim, low, high = max(dim, 1), low or 0, high or 0
    stored, kind = next((s, t) for s, t in KINDS if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    narrow = F.col("v").cast(f"array<{stored}>").alias("v")
    row_bytes = dim * np.dtype(kind).itemsize
    pack_rows = max(1, PACK_BYTES // row_bytes)
    candidate_rows = min(candidate_rows, max(1, CANDIDATE_BYTES // row_bytes))

    # Dealt at random, so that every pack is a sample of the table.
    salted = vectors.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartition("salt")
    candidates = packed(salted.select("vec_id", narrow), dim, kind, min(pack_rows, candidate_rows), "candidates")
    asking = written(asking.select("vec_id", narrow), "asking")

    def compared(bounds: DataFrame | None, part, share: float, spread: int) -> DataFrame:
        """The best of a part of the candidates, every query block beside every candidate block."""
        bounded = asking.join(bounds, "vec_id", "left") if bounds is not None else asking.select(
            "*", F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("last")
        )
        queries = packed(
            bounded.select("vec_id", F.coalesce("least", F.lit(LOWEST)), F.coalesce("last", F.lit(HIGHEST)), "v"),
            dim, kind, min(pack_rows, query_rows), "queries",
        )
        rows = share * n
        tasks = min(TASKS, -(-asked * rows // TASK_PAIRS))
        query_blocks = int(max(-(-asked // query_rows), min(spread, tasks)))
        blocks = int(max(-(-rows // candidate_rows), -(-tasks // query_blocks), 1))
        query_block, block = F.pmod("number", F.lit(query_blocks)), F.pmod("number", F.lit(blocks))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        units = candidates.filter(part).select(
            every(query_blocks).alias("q"), block.alias("c"), F.lit(False).alias("asks"), "numbers", "data"
        ).unionByName(queries.select(
            query_block.alias("q"), every(blocks).alias("c"), F.lit(True).alias("asks"), "numbers", "data"
        ))
        dealt = (
            units.select((F.col("q") * blocks + F.col("c")).cast("int").alias("unit"), "asks", "numbers", "data")
            .repartitionById(query_blocks * blocks, "unit").sortWithinPartitions("unit", "asks")
        )
        return written(map_arrow(dealt, partial(_compared, dim=dim, kind=kind, k=k), result), "kept")

    parts = max(1, n // (first_rows or int(FIRST * n**0.5)))
    part = F.pmod(F.xxhash64("number"), F.lit(parts))
    kept = compared(None, part == 0, 1 / parts, FIRST_QUERY_BLOCKS)
    if parts > 1:
        kept = kept.unionByName(compared(_bounds(kept, k), part > 0, 1 - 1 / parts, 1))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op3_top_k(spark, folder: str) -> DataFrame:
    vectors = integer_vectors(table(spark, folder, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

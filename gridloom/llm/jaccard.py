"""Jaccard join of documents on word n-grams, by size: subsets for small sets, lists for large ones.

A pair of sets of sizes a and b has a similarity of ``percent`` or more if and only if it shares
``percent * (a + b) / (100 + percent)`` shingles. Equal sets are one node from the start.

* Light sets, up to a boundary: every subset of the sizes c that a partner can require is
  enumerated, as a sum of hashes less the hashes left out. Sets that share a c-subset meet, and
  each is compared with the smallest of them only: whichever two are similar because of this
  subset, both are similar to that one.
* Heavy sets, and light ones near enough to the boundary to pair with them: inverted lists of the
  rarest shingles, as many as a set may miss in a partner plus one, so that similar sets share one.
  Rareness is by a fixed-size count sketch over all documents; any order is right, a good one makes
  lists short. Positions in that order bound what two sets of a list can still share. A list is
  first scanned against its best-placed set. Where its sets are then in one component, that is all;
  else those outside are compared with all others that the bound admits.
* The boundary is where the enumerated subsets of all light sets and the lists of all heavy ones
  cost least, estimated from a histogram of sizes.

Every candidate pair is confirmed on the whole sets, so no link is missed and none is made up.
Lists that many near copies share are scanned once per copy, not once per pair. What tasks filter
with is a set of 64-bit numbers only while below ``FILTER_MOST`` (it is counted first); beyond, the
same step is a join.

Defined results: null and empty texts, and those of white space, have no shingles, link with
nothing, and are their own component. Rows without a doc_id are in no component and link nothing.
Rows that repeat an id are in the components of their texts; sets whose smallest id is the same
are one node. Shingles are told apart by 64 bits of hash, sets by 128. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import (
    LOWER,
    UPPER,
    WordHashes,
    grams,
    is_in,
    map_arrow,
    mixed,
    small_set,
    table,
    written,
)
from gridloom.llm.components import components

SKETCH = 1 << 22
SKETCH_PART = 1 << 14
FILTER_MOST = 4_000_000
#: Keys in one task that looks for keys of several sets.
RANGE_KEYS = 1_000_000
#: Sizes at which the boundary between light and heavy sets may be.
BOUNDARIES = range(4, 41)
#: Cost of a list entry (scan, bound, confirmation) in enumerated subsets.
LIST_COST = 4.0
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


@lru_cache(maxsize=1)
def hashes() -> WordHashes:
    """One per worker process."""
    return WordHashes()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams. bytes.split() cuts at ASCII white space only."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return np.unique(grams(hashes().of(words), n))


def needed(a, b, percent: int):
    """Shingles that sets of these sizes share at least."""
    return -((-percent * (a + b)) // (100 + percent))


def least_part(size: int, percent: int) -> int:
    """Shingles of a set that any partner has at least."""
    return -((-percent * size) // 100)


def subsets(size: int, percent: int) -> int:
    return sum(comb(size, r) for r in range(size - least_part(size, percent) + 1))


def subset_keys(items: np.ndarray, percent: int) -> np.ndarray:
    """A hash of each subset of each size that a partner can require."""
    spread = mixed(items)
    total, size = int(spread.sum(dtype=np.uint64)), len(items)
    keys = []
    for left_out in range(size - least_part(size, percent) + 1):
        level = (size - left_out) << 56
        for gone in combinations(spread.tolist(), left_out):
            keys.append((total - sum(gone) + level) & (2**64 - 1))
    return mixed(np.array(keys, np.uint64))


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    a, b = mixed(items), mixed(items ^ np.uint64(0x5851F42D4C957F2D))
    return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (a, b))


# Sketch of document frequencies


def frequency_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Approximate documents per shingle by its hash: SKETCH counters, whatever the input."""

    def count(batches):
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, _counter(shingles(text, n)), 1)
        for part in range(SKETCH // SKETCH_PART):
            own = counts[part * SKETCH_PART : (part + 1) * SKETCH_PART]
            if own.any():
                yield {"part": [part], "counts": [own.tobytes()]}

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH_PART, np.uint64)
        for raw in group.counts:
            total += np.frombuffer(raw, np.uint32)
        capped = np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pd.DataFrame({"part": group.part.iloc[:1], "counts": [capped.tobytes()]})

    parts = written(
        map_arrow(docs.select("text"), count, "part int, counts binary").groupBy("part").applyInPandas(
            add, "part int, counts binary"
        ),
        "sketch",
    )
    sketch = np.zeros(SKETCH, np.uint32)
    for row in parts.toLocalIterator():
        sketch[row.part * SKETCH_PART : (row.part + 1) * SKETCH_PART] = np.frombuffer(row.counts, np.uint32)
    return sketch


def _counter(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(42)).astype(np.int64)


# Boundary


def light_boundary(docs: DataFrame, n: int, percent: int) -> int:
    """The largest light size. Sizes are estimated by words, of short texts alone."""
    most = BOUNDARIES[-1] * 2
    short = docs.filter(F.length("text") <= 20 * most)
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = (
        short.select(F.greatest(words - (n - 1), F.lit(1)).alias("size")).filter(F.col("size") <= most)
        .groupBy("size").count().collect()
    )
    sizes = {r["size"]: r["count"] for r in rows}

    def cost(boundary: int) -> float:
        light = sum(c * subsets(s, percent) for s, c in sizes.items() if s <= boundary)
        heavy = sum(c * (s - least_part(s, percent) + 1) for s, c in sizes.items() if 100 * s > percent * boundary)
        return light + LIST_COST * heavy

    return min(BOUNDARIES, key=cost)


# Candidates


def described(docs: DataFrame, n: int, percent: int, sketch: np.ndarray, boundary: int) -> DataFrame:
    """doc_id, n, h1, h2 of every row, and for lists its rarest shingles, in order."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def describe(batches):
        rareness = held.value
        for batch in batches:
            out = {"doc_id": batch.column(0), "n": [], "h1": [], "h2": [], "rare": [], "light": []}
            for text in batch.column(1).to_pylist():
                items = shingles(text, n)
                size = len(items)
                h1, h2 = fingerprint(items)
                out["n"].append(size)
                out["h1"].append(h1)
                out["h2"].append(h2)
                out["light"].append(items.view(np.int64) if 0 < size <= boundary else None)
                if 100 * size > percent * boundary:
                    order = np.lexsort((items, rareness[_counter(items)]))
                    out["rare"].append(items[order[: size - least_part(size, percent) + 1]].view(np.int64))
                else:
                    out["rare"].append(None)
            yield out

    return map_arrow(
        docs.select("doc_id", "text"), describe,
        "doc_id long, n long, h1 long, h2 long, rare array<long>, light array<long>",
    )


def shared_keys(rows: DataFrame) -> DataFrame:
    """key: the values in ``rare`` that rows of different sets (h1) hold.

    Keys go by ranges, with the smallest and largest set hash of each task's batch: a key of very
    many sets takes one entry per batch.
    """
    ranges = max(1, int((rows.agg(F.sum(F.size("rare"))).first()[0] or 0) // RANGE_KEYS) + 1)

    def deal(batches):
        for batch in batches:
            lists, owners = batch.column(0), batch.column(1)
            keys = np.asarray(lists.flatten())
            owner = np.repeat(np.asarray(owners), np.asarray(lists.value_lengths()))
            if len(keys):
                yield _by_range(*_extremes(keys, owner, owner), ranges)

    def find(group: pd.DataFrame) -> pd.DataFrame:
        keys, low, high = (np.concatenate([np.frombuffer(x, np.int64) for x in group[c]]) for c in ("keys", "low", "high"))
        keys, low, high = _extremes(keys, low, high)
        return pd.DataFrame({"key": keys[low < high]})

    dealt = map_arrow(rows.filter("rare IS NOT NULL").select("rare", "h1"), deal, "part int, keys binary, low binary, high binary")
    return dealt.groupBy("part").applyInPandas(find, "key long")


def _extremes(keys: np.ndarray, low: np.ndarray, high: np.ndarray):
    order = np.argsort(keys, kind="stable")
    keys, low, high = keys[order], low[order], high[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)


def _by_range(keys: np.ndarray, low: np.ndarray, high: np.ndarray, ranges: int) -> dict[str, list]:
    part = ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(ranges + 1, dtype=np.uint64))
    out = {"part": [], "keys": [], "low": [], "high": []}
    for r in range(ranges):
        chosen = order[cuts[r] : cuts[r + 1]]
        if len(chosen):
            out["part"].append(r)
            for name, values in (("keys", keys), ("low", low), ("high", high)):
                out[name].append(values[chosen].tobytes())
    return out


def list_entries(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """key, at (place among the rarest), n, h1, node: one entry of a list per set."""
    known = small_set(keys, FILTER_MOST)
    heavy = rows.filter("rare IS NOT NULL AND doc_id IS NOT NULL").select("rare", "doc_id", "n", "h1")
    if known is None:
        entries = heavy.select("doc_id", "n", "h1", F.posexplode("rare").alias("at", "key")).join(keys, "key", "left_semi")
    else:
        held = rows.sparkSession.sparkContext.broadcast(known)

        def pick(batches):
            for batch in batches:
                lists = batch.column(0)
                lengths = np.asarray(lists.value_lengths())
                values = np.asarray(lists.flatten())
                row = np.repeat(np.arange(len(lengths)), lengths)
                at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                chosen = is_in(held.value, values)
                row = row[chosen]
                yield {"key": values[chosen], "at": at[chosen],
                       **{c: np.asarray(batch.column(i))[row] for i, c in ((1, "doc_id"), (2, "n"), (3, "h1"))}}

        entries = map_arrow(heavy, pick, "key long, at int, doc_id long, n long, h1 long")
    return entries.groupBy("key", "at", "n", "h1").agg(F.min("doc_id").alias("node"))


def whole_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node, h1, items of the documents that ``nodes`` (node, h1) names."""
    ids = small_set(nodes.select("node").distinct(), FILTER_MOST)
    chosen = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    if ids is None:
        chosen = chosen.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    held = docs.sparkSession.sparkContext.broadcast(ids)

    def build(batches):
        for batch in batches:
            ids, out = held.value, {"node": [], "h1": [], "items": []}
            doc_ids = np.asarray(batch.column(0))
            inside = np.ones(len(doc_ids), bool) if ids is None else is_in(ids, doc_ids)
            for i in np.flatnonzero(inside):
                items = shingles(batch.column(1)[int(i)].as_py(), n)
                out["node"].append(doc_ids[i])
                out["h1"].append(fingerprint(items)[0])
                out["items"].append(items.view(np.int64))
            yield out

    built = map_arrow(chosen, build, "node long, h1 long, items array<long>")
    return built.dropDuplicates(["node", "h1"]) if ids is None else built


def confirmed(docs: DataFrame, pairs: DataFrame, entries: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b of the pairs (a, b) whose whole sets are similar enough."""
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = entries.select("node", "h1").distinct().join(written(named, "named"), "node")
    sets = written(whole_sets(docs, nodes, n), "sets")
    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.select("a", "b").join(one, "a").join(other, "b")
        .filter(shared * (100 + percent) >= (F.size("x") + F.size("y")) * percent)
        .select("a", "b").distinct()
    )


def _may_pair(percent: int, n1: str, at1: str, n2: str, at2: str):
    """Two sets that share their entry at these places can be similar."""
    rest = F.least(F.col(n1) - F.col(at1), F.col(n2) - F.col(at2))
    return (rest * (100 + percent) >= (F.col(n1) + F.col(n2)) * percent) & (
        F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    )


def light_links(rows: DataFrame, percent: int) -> DataFrame:
    """a, b of light sets, by common subsets, confirmed on the sets themselves."""

    def enumerate_(batches):
        for batch in batches:
            out = {"key": [], "n": [], "node": [], "items": []}
            for node, items in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.asarray(items.values)
                for key in subset_keys(values.view(np.uint64), percent).view(np.int64).tolist():
                    out["key"].append(key)
                    out["n"].append(len(values))
                    out["node"].append(node)
                    out["items"].append(values)
            yield out

    light = (
        rows.filter("light IS NOT NULL AND doc_id IS NOT NULL").groupBy("n", "h1", "h2")
        .agg(F.min("doc_id").alias("node"), F.first("light").alias("light")).select("node", "light")
    )
    keyed = written(map_arrow(light, enumerate_, "key long, n long, node long, items array<long>"), "subsets")
    first = (
        keyed.groupBy("key").agg(F.min(F.struct("n", "node")).alias("b"), F.count("*").alias("sets"))
        .filter("sets > 1").select("key", F.col("b.node").alias("b"))
    )
    best = first.join(keyed.select("key", F.col("node").alias("b"), F.col("items").alias("y")), ["key", "b"])
    shared = F.size(F.array_intersect("items", "y"))
    return (
        keyed.join(written(best, "first-sets"), "key").filter("node <> b")
        .filter(shared * (100 + percent) >= (F.size("items") + F.size("y")) * percent)
        .select(F.col("node").alias("a"), "b").distinct()
    )


def heavy_links(docs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: links by inverted lists that join whatever sets are similar into one component."""
    keys = written(shared_keys(rows), "shared-keys")
    entries = written(list_entries(rows, keys), "entries")
    hubs = written(
        entries.groupBy("key").agg(F.min(F.struct("at", "n", "node")).alias("hub"), F.count("*").alias("sets"))
        .filter("sets > 1").select("key", F.col("hub.at").alias("at2"), F.col("hub.n").alias("n2"), F.col("hub.node").alias("b")),
        "hubs",
    )
    scanned = (
        entries.join(hubs, "key").filter(F.col("node") != F.col("b"))
        .filter(_may_pair(percent, "n", "at", "n2", "at2"))
        .select(F.col("node").alias("a"), "b").distinct()
    )
    links = written(confirmed(docs, written(scanned, "pairs"), entries, n, percent), "links")

    # Lists whose sets are still in several components, and in them the sets that may yet pair.
    labels = components(links)
    labelled = written(
        entries.join(hubs.select("key", "b"), "key").join(labels, "node", "left")
        .withColumn("label", F.coalesce("component", "node"))
        # The largest partner that the shingles after this place leave room for.
        .withColumn("room", F.floor((F.col("n") - F.col("at")) * (100 + percent) / percent) - F.col("n"))
        .select("key", "at", "n", "node", "label", "room", (F.col("node") == F.col("b")).alias("is_hub")),
        "labelled",
    )
    several = (
        labelled.groupBy("key").agg(
            F.min("label").alias("l1"), F.max("label").alias("l2"), F.min("n").alias("smallest"),
            F.max("room").alias("most_room"), F.max(F.when(F.col("is_hub"), F.col("label"))).alias("hub_label"),
        ).filter("l1 < l2")
    )
    active = written(
        labelled.filter("NOT is_hub").join(several, "key")
        .filter("room >= smallest AND n <= most_room").withColumn("outside", F.col("label") != F.col("hub_label"))
        .select("key", "at", "n", "node", "label", "outside"),
        "active",
    )
    other = active.select("key", *(F.col(c).alias(f"{c}2") for c in ("at", "n", "node", "label", "outside")))
    rest = (
        active.filter("outside").join(other, "key").filter("label <> label2")
        .filter(~F.col("outside2") | (F.col("node") < F.col("node2")))
        .filter(_may_pair(percent, "n", "at", "n2", "at2"))
        .select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
    )
    rest = written(rest, "pairs")
    return links if rest.isEmpty() else links.unionByName(confirmed(docs, rest, entries, n, percent))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    boundary = light_boundary(docs, n, percent)
    sketch = frequency_sketch(docs, n)
    rows = written(described(docs, n, percent, sketch, boundary), "described")
    links = light_links(rows, percent).unionByName(heavy_links(docs, rows, n, percent))
    labels = components(written(links, "links"))
    sets = ["n", "h1", "h2"]
    nodes = rows.filter("n > 0").groupBy(*sets).agg(F.min("doc_id").alias("node"))
    classes = written(
        nodes.join(labels, "node", "left").select(*sets, F.coalesce("component", "node").alias("component")), "classes"
    )
    return (
        rows.select("doc_id", *sets).join(classes, sets, "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
    )


def op4_jaccard_join(spark, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))

"""Repeated 100-byte strings by suffix arrays over distributed text.

A byte goes if a string of ``WIDTH`` bytes that covers it starts earlier too: in a document with a
smaller id, or earlier in the same one.

1. Whole copies of a document are told by hash; all but the first are nothing but repeats.
2. The windows of a text are dealt by their minimizer, the ``SEED``-byte string in the window whose
   hash is smallest (the first, if it recurs). Equal windows have equal minimizers at equal places,
   so they meet. Consecutive windows with one minimizer make one piece of text around it.
3. Minimizers that occur once are dropped: their windows occur once. Pieces that are equal as a
   whole are reduced to the first; all windows of the others are repeats.
4. The pieces that remain around a minimizer differ. In each task a suffix array is built by linear
   grouping over what follows the minimizers, and one over what precedes them, reversed. Windows
   with a given part before and after are equal where both orders' common prefixes reach as far;
   all but the first of each such class are repeats. The contexts are cut into units of seven bytes.
5. A minimizer with more than ``GROUP_MOST`` different pieces (a line that most documents hold, say)
   has its windows resolved by hash, in Spark's own aggregation, which splits such groups.
6. Repeated windows become spans, and documents are cut by their spans.

What tasks filter with is sets of 64-bit numbers while below a size that is counted first; beyond,
the same steps are joins. Windows and pieces are told apart by hashes of 64 bits and 128 bits.

Defined results: null and empty texts have no bytes and lose none. Texts below ``WIDTH`` bytes lose
none. Rows equal in id and text are one document and each give its row. A null id is below all
others; documents that share an id are ordered by their text's hash. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import is_in, map_arrow, mixed, small_set, table, written
from gridloom.llm.suffix_array import suffix_array

WIDTH, SEED = 100, 32
#: Windows whose minimizers are found at once; no text is longer than its slices.
SLICE = 1 << 19
FILTER_MOST = 4_000_000
RANGE_KEYS = 500_000
#: Different pieces around one minimizer that one task resolves, and pieces of a task.
GROUP_MOST, TASK_PIECES = 2_000, 8_000
UNIT = 7
#: Documents that a task cuts at once.
CUT_ROWS = 500
NO_ID = -(2**63)
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 20) - 1)


def _widened(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of twice the width from those of strings of ``width`` bytes."""
    return hashes[:-width] * np.uint64(pow(_BASE, width, 2**64)) + hashes[width:]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place on."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part = mixed(data.astype(np.uint64) + np.uint64(1))
    total, done, size = np.zeros(n, np.uint64), 0, 1
    while True:
        if width & size:
            # The places of this power of two come after those already taken.
            total = total * np.uint64(pow(_BASE, size, 2**64)) + part[done : done + n]
            done += size
        if size * 2 > width:
            return mixed(total)
        part = _widened(part, size)
        size *= 2


def minimizers(data: np.ndarray, width: int = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a text: first window, last window, place of the minimizer, and its hash."""
    found = [
        _slice_minimizers(data[at : at + SLICE + width - 1], at, width, seed)
        for at in range(0, max(len(data) - width + 1, 0), SLICE)
    ]
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _slice_minimizers(data: np.ndarray, offset: int, width: int, seed: int):
    hashes = rolling(data, seed)
    # Smallest hash, then first place: both in one number.
    ranked = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    span, reach = width - seed + 1, 1
    while reach * 2 <= span:
        ranked = np.minimum(ranked[:-reach], ranked[reach:])
        reach *= 2
    if reach < span:
        ranked = np.minimum(ranked[: len(ranked) - (span - reach)], ranked[span - reach :])
    place = (ranked & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return first + offset, last + offset, place[first] + offset, hashes[place[first]]


def repeated_minimizers(docs: DataFrame) -> DataFrame:
    """key: hashes of the minimizers of more than one piece. Counts go by ranges of keys."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(size // (RANGE_KEYS * 25)) + 1

    def deal(batches):
        for batch in batches:
            found = [minimizers(_bytes(t))[3] for t in batch.column("text").to_pylist()]
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
            slices = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            chosen = [r for r, s in enumerate(slices) if s.stop > s.start]
            many = np.minimum(counts, 2).astype(np.uint8)
            yield {"part": chosen, "keys": [keys[slices[r]].tobytes() for r in chosen],
                   "many": [many[slices[r]].tobytes() for r in chosen]}

    def repeated(held: list[tuple[np.ndarray, np.ndarray]]) -> dict:
        keys = np.concatenate([k for k, _ in held])
        again = np.concatenate([k[m > 1] for k, m in held])
        keys.sort()
        return {"key": np.unique(np.concatenate((keys[1:][keys[1:] == keys[:-1]], again)))}

    def find(batches):
        part, held = None, []
        for batch in batches:
            for number, keys, many in zip(*(batch.column(i) for i in range(3)), strict=True):
                if held and number.as_py() != part:
                    yield repeated(held)
                    held = []
                part = number.as_py()
                # Copies, so that the batch can be freed.
                held.append((np.frombuffer(keys.as_buffer(), np.int64).copy(), np.frombuffer(many.as_buffer(), np.uint8).copy()))
        if held:
            yield repeated(held)

    # A range is a few megabytes; the ranges of a partition follow each other.
    dealt = map_arrow(docs.select("text"), deal, "part int, keys binary, many binary")
    return map_arrow(dealt.repartition(ranges, "part").sortWithinPartitions("part"), find, "key long")


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


PIECE = "key long, s1 long, s2 long, id long, h long, start long, seed_at int, n int, piece binary"


def pieces(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Pieces around the minimizers in ``keys``: the bytes, their hash, and where they are."""
    known = small_set(keys, FILTER_MOST)
    held = docs.sparkSession.sparkContext.broadcast(known)

    def cut(batches):
        for batch in batches:
            out = {name: [] for name in ("key", "s1", "s2", "id", "h", "start", "seed_at", "n", "piece")}
            for doc_id, h, text in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "text")), strict=True):
                raw = (text or "").encode()
                first, last, at, key = minimizers(np.frombuffer(raw, np.uint8))
                key = key.view(np.int64)
                chosen = np.arange(len(key)) if held.value is None else np.flatnonzero(is_in(held.value, key))
                for i in chosen.tolist():
                    a, b = int(first[i]), int(last[i]) + WIDTH
                    piece = raw[a:b]
                    digest = xxhash.xxh3_128_intdigest(piece)
                    out["piece"].append(piece)
                    out["s1"].append((digest >> 64) - 2**63)
                    out["s2"].append((digest & (2**64 - 1)) - 2**63)
                    out["start"].append(a)
                    out["n"].append(b - a)
                out["key"] += key[chosen].tolist()
                out["seed_at"] += (at[chosen] - first[chosen]).tolist()
                out["id"] += [doc_id] * len(chosen)
                out["h"] += [h] * len(chosen)
            yield out

    cut_pieces = map_arrow(docs.select("id", "h", "text"), cut, PIECE)
    return cut_pieces if known is not None else cut_pieces.join(keys, "key", "left_semi").select(
        *(c.split()[0] for c in PIECE.split(", "))
    )


def _units(parts: list[bytes]) -> list[np.ndarray]:
    """Each text as numbers of seven bytes and how many of them are text, so that order and
    prefixes are those of the bytes."""
    out = []
    for part in parts:
        units = -(-len(part) // UNIT)
        padded = np.frombuffer(part.ljust(units * UNIT, b"\0"), np.uint8).reshape(units, UNIT)
        wide = np.zeros((units, 8), np.uint8)
        wide[:, :UNIT] = padded
        wide[:, UNIT] = UNIT
        if units:
            wide[-1, UNIT] = len(part) - (units - 1) * UNIT
        out.append(wide.reshape(-1).view(">u8"))
    return out


def _classes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the texts by a suffix array of all, and what each shares with the one before."""
    units = _units(parts)
    lengths = np.array([len(u) for u in units])
    flat = np.concatenate(units) if len(units) else np.zeros(0, ">u8")
    _, ranks = np.unique(flat, return_inverse=True)
    # A separator, lower than all units, ends each text.
    text = np.zeros(len(flat) + len(parts), np.int64)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    inside = np.ones(len(text), bool)
    inside[starts + lengths] = False
    text[inside] = ranks + 1
    owner = np.full(len(text), -1)
    owner[starts] = np.arange(len(parts))
    ordered = owner[np.array(suffix_array(text.tolist()), np.int64)]
    ordered = ordered[ordered >= 0]
    longest = max(map(len, parts))
    sizes = np.array([len(p) for p in parts])
    rows = np.zeros((len(parts), longest + 1), np.uint8)
    for i, part in enumerate(parts):
        rows[i, : len(part)] = np.frombuffer(part, np.uint8)
    a, b = rows[ordered[1:]], rows[ordered[:-1]]
    differ = a != b
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
    shared = np.minimum(shared, np.minimum(sizes[ordered[1:]], sizes[ordered[:-1]]))
    return ordered, np.r_[0, shared]


def repeated_windows(group: pd.DataFrame) -> Iterator[tuple[int, int, int]]:
    """(row, first, last window) of the repeats among the pieces of some minimizers.

    ``group`` is in order of document and place of the minimizer.
    """
    n = len(group)
    before = group["seed_at"].to_numpy(np.int64)
    texts = group["piece"].tolist()
    after = np.array([len(t) for t in texts]) - before
    order_r, shared_r = _classes([t[b:] for t, b in zip(texts, before.tolist(), strict=True)])
    order_l, shared_l = _classes([t[:b][::-1] for t, b in zip(texts, before.tolist(), strict=True)])
    repeated = np.zeros((n, WIDTH - SEED + 1), bool)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for reach in range(WIDTH - SEED + 1):
        rows = np.flatnonzero((before >= reach) & (after >= WIDTH - reach))
        if len(rows) < 2:
            continue
        left[order_l] = np.cumsum(shared_l < reach)
        right[order_r] = np.cumsum(shared_r < WIDTH - reach)
        _, firsts = np.unique(left[rows] * (n + 1) + right[rows], return_index=True)
        again = np.ones(len(rows), bool)
        again[firsts] = False
        repeated[rows[again], reach] = True
    for row in np.flatnonzero(repeated.any(axis=1)).tolist():
        windows = before[row] - np.flatnonzero(repeated[row])[::-1]
        for run in np.split(windows, np.flatnonzero(np.diff(windows) > 1) + 1):
            yield row, int(run[0]), int(run[-1])


SPAN = "id long, h long, start long, stop long"


def _resolve(group: pd.DataFrame) -> pd.DataFrame:
    group = group.assign(place=group["start"] + group["seed_at"]).sort_values(["id", "h", "place"], ignore_index=True)
    found = list(repeated_windows(group))
    rows = [f[0] for f in found]
    starts = group["start"].to_numpy()[rows] if rows else np.zeros(0, np.int64)
    return pd.DataFrame(
        {"id": group["id"].to_numpy()[rows] if rows else starts, "h": group["h"].to_numpy()[rows] if rows else starts,
         "start": starts + np.array([f[1] for f in found], np.int64),
         "stop": starts + np.array([f[2] + WIDTH for f in found], np.int64)}
    )


def _window_rows(large: DataFrame) -> DataFrame:
    """g1, g2, id, h, start of every window of the pieces."""

    def spread(batches):
        for batch in batches:
            out = {name: [] for name in ("g1", "g2", "id", "h", "start")}
            for doc_id, h, start, piece in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "start", "piece")), strict=True):
                data = np.frombuffer(piece, np.uint8)
                one = rolling(data, WIDTH)
                out["g1"].append(one)
                out["g2"].append(rolling(data ^ np.uint8(0x55), WIDTH))
                out["start"].append(np.arange(len(one)) + start)
                out["id"].append(np.full(len(one), doc_id))
                out["h"].append(np.full(len(one), h))
            if out["g1"]:
                done = {k: np.concatenate(v) for k, v in out.items()}
                yield done | {k: done[k].view(np.int64) for k in ("g1", "g2")}

    return map_arrow(large.select("id", "h", "start", "piece"), spread, "g1 long, g2 long, id long, h long, start long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """id, h, start, stop of repeated windows in ``docs`` (id, h, text), whose texts all differ."""
    keys = written(repeated_minimizers(docs), "minimizers")
    cut = written(pieces(docs, keys), "pieces")
    place = F.struct("id", "h", "start")
    firsts = written(
        cut.groupBy("key", "s1", "s2").agg(F.min(place).alias("first"), F.count("*").alias("times")), "first-pieces"
    )
    # Equal pieces: every one but the first, as a whole.
    again = firsts.filter("times > 1").select("key", "s1", "s2", F.col("first").alias("of"))
    same = (
        cut.select("key", "s1", "s2", "id", "h", "start", "n").join(written(again, "again"), ["key", "s1", "s2"])
        .filter(place != F.col("of")).select("id", "h", "start", (F.col("start") + F.col("n")).alias("stop"))
    )
    # Different pieces around one minimizer.
    kinds = firsts.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    several = written(firsts.join(kinds, "key").select("first.id", "first.h", "first.start", "kinds"), "several")
    differ = written(cut.join(several, ["id", "h", "start"]).select("key", "kinds", "id", "h", "start", "seed_at", "piece"), "different")
    small = differ.filter(F.col("kinds") <= GROUP_MOST)
    tasks = int((small.count()) // TASK_PIECES) + 1
    resolved = small.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks))).groupBy("task").applyInPandas(_resolve, SPAN)
    windows = written(_window_rows(differ.filter(F.col("kinds") > GROUP_MOST)), "windows")
    earliest = written(
        windows.groupBy("g1", "g2").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times"),
        "earliest",
    )
    hashed = (
        windows.join(earliest, ["g1", "g2"]).filter(place != F.col("first"))
        .select("id", "h", "start", (F.col("start") + WIDTH).alias("stop"))
    )
    return same.unionByName(resolved).unionByName(hashed)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("h", F.xxhash64("text"))
    named = written(
        keyed.select("id", "h", F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").alias("n")), "texts"
    )
    whole = ["h", "h2", "n"]
    first = written(named.groupBy(*whole).agg(F.min("id").alias("first"), F.count("*").alias("times")).filter("times > 1"), "copied")
    copies = written(
        named.join(first, whole).filter("id <> first").select("id", "h", "n").distinct(), "copies"
    )
    # One row of each text: other rows of the same id and text would repeat all of it.
    alike = named.groupBy("id", "h").count().filter("count > 1")
    texts = keyed.join(copies.select("id", "h"), ["id", "h"], "left_anti")
    if not alike.isEmpty():
        texts = texts.groupBy("id", "h").agg(F.first("text").alias("text"))
    texts = texts.select("id", "h", "text").filter(F.octet_length("text") >= WIDTH)
    spans = repeated_spans(texts).unionByName(
        copies.filter(F.col("n") >= WIDTH).select("id", "h", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("stop"))
    )
    by_text = written(
        spans.groupBy("id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans"
    )

    def cut(batches):
        for batch in (b.slice(at, CUT_ROWS) for b in batches for at in range(0, b.num_rows, CUT_ROWS)):
            out = {name: [] for name in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                parts, removed, runs, at = [], 0, 0, 0
                for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if stop <= at and runs:
                        continue
                    if start > at or not runs:
                        parts.append(raw[at:start])
                        runs += 1
                        removed += stop - start
                    else:
                        removed += stop - at
                    at = stop
                parts.append(raw[at:])
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(removed)
                out["n_spans"].append(runs)
                out["kept"].append(b"".join(parts))
            yield out | {"doc_id": batch.column("doc_id")}

    joined = keyed.join(by_text, ["id", "h"], "left").select("doc_id", "text", "spans")
    return map_arrow(joined, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark, folder: str) -> DataFrame:
    return cut_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )

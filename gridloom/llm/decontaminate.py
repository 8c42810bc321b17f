"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

A seed is a run of three words of a test item. All seeds count, however many documents hold them:
copies of an item that many documents share are no less copies. Documents meet items on seeds by a
join that carries the places of the shared seeds. An alignment that scores enough is at most twice
as long as its item, so around those places the document is cut that wide on both sides, and what
holds too few of the item's words goes. The rest is aligned with the item word by word, and the
score is the alignment's over that of a perfect copy. Edited, cut and paraphrased copies keep a
large part of it; chance finds have a few words.

In tasks, documents are filtered by the set of all seeds while that set is below ``FILTER_SEEDS``
(its size is counted first); beyond, the same join takes all runs of three words. Results agree.

Words are runs of letters, digits and underscores, in lower case. Defined results: null or empty
texts and items, and those without words, match nothing; items of fewer words than a seed has are
one seed as a whole. Equal rows of documents or items give equal pairs once. Columns other than
the ids and texts are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WordHashes, grams, map_batches, table, written

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
#: An alignment that scores LEAST covers at most so many words of a passage for each of its item:
#: with all words matched, MATCH * (1 - LEAST) extra ones use up the rest of the score.
SPAN = 2
FILTER_SEEDS = 2_000_000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@lru_cache(maxsize=1)
def hashes() -> WordHashes:
    """One per worker process."""
    return WordHashes()


def seeds_of(words: list[str]) -> np.ndarray:
    return grams(hashes().of(words), SEED_WORDS).view(np.int64)


def align(passage: list[str], item: list[str]) -> tuple[int, int]:
    """Score of the best local alignment, and where it ends in the passage (exclusive)."""
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in passage])
    columns = np.arange(len(a) + 1) * -GAP
    row = np.zeros(len(a) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        equal = a == codes.get(word, -1)
        fresh = np.maximum(row + GAP, 0)
        fresh[1:] = np.maximum(fresh[1:], row[:-1] + np.where(equal, MATCH, MISMATCH))
        # A gap in the passage: the best to the left, less one for each word passed.
        row = np.maximum.accumulate(fresh + columns) - columns
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def aligned(passage: list[str], item: list[str]) -> tuple[float, int, int]:
    """Score from 0 to 1 and the words of the passage that it covers."""
    shared = sum((Counter(passage) & Counter(item)).values())
    if shared < LEAST * len(item):
        return 0.0, 0, 0  # not even all shared words in one row would do
    score, end = align(passage, item)
    if score < LEAST * MATCH * len(item):
        return score / (MATCH * len(item)), 0, 0
    _, back = align(passage[:end][::-1], item[::-1])
    return score / (MATCH * len(item)), end - back, end


def windows(at: list[int], length: int) -> list[tuple[int, int]]:
    """From and to which word alignments with an item of ``length`` words can reach around seeds ``at``."""
    places, reach = np.unique(at), SPAN * length
    groups = np.split(places, np.flatnonzero(np.diff(places) > 2 * reach) + 1)
    return [(max(0, int(g[0]) - reach), int(g[-1]) + SEED_WORDS + reach) for g in groups]


def item_seeds(items: DataFrame) -> DataFrame:
    """item_id, seed."""

    def cut(columns: dict[str, list]) -> dict[str, list]:
        out = {"item_id": [], "seed": []}
        for item_id, text in zip(columns["item_id"], columns["text"], strict=True):
            found = np.unique(seeds_of(words_of(text)))
            out["seed"] += found.tolist()
            out["item_id"] += [item_id] * len(found)
        return out

    return map_batches(items.select("item_id", "text"), cut, "item_id long, seed long").distinct()


def _filter_set(seeds: DataFrame) -> np.ndarray | None:
    known = seeds.select("seed").distinct()
    if known.count() > FILTER_SEEDS:
        return None
    return np.sort(np.array([r.seed for r in known.toLocalIterator()], np.int64))


def _held(found: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    if known is None:
        return np.ones(len(found), bool)
    if not len(known):
        return np.zeros(len(found), bool)
    return known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found


def passages(docs: DataFrame, seeds: DataFrame, reach: int) -> DataFrame:
    """doc_id, first (word), words (joined by spaces), seeds, at: what surrounds seeds, ``reach`` words wide.

    ``at`` are the places of the seeds in the passage.
    """
    known = _filter_set(seeds)

    def cut(columns: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": [], "first": [], "words": [], "seeds": [], "at": []}
        for doc_id, text in zip(columns["doc_id"], columns["text"], strict=True):
            words = words_of(text)
            found = seeds_of(words)
            at = np.flatnonzero(_held(found, known))
            if not len(at):
                continue
            for group in np.split(at, np.flatnonzero(np.diff(at) > 2 * reach) + 1):
                first = max(0, int(group[0]) - reach)
                out["doc_id"].append(doc_id)
                out["first"].append(first)
                out["words"].append(" ".join(words[first : int(group[-1]) + SEED_WORDS + reach]))
                out["seeds"].append(found[group].tolist())
                out["at"].append((group - first).tolist())
        return out

    return map_batches(
        docs.select("doc_id", "text"), cut,
        "doc_id long, first long, words string, seeds array<long>, at array<long>",
    )


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word (exclusive) of the best passage of each pair."""
    items = items.select("item_id", "text").distinct()
    seeds = written(item_seeds(items), "item-seeds")

    def tidy(columns: dict[str, list]) -> dict[str, list]:
        found = [words_of(t) for t in columns["text"]]
        return {"item_id": columns["item_id"], "item": [" ".join(w) for w in found], "n": [len(w) for w in found]}

    item_words = written(map_batches(items, tidy, "item_id long, item string, n int"), "items")
    reach = (item_words.agg(F.max("n")).first()[0] or 1) * SPAN
    cut = written(passages(docs, seeds, reach).withColumn("passage", F.monotonically_increasing_id()), "passages")
    pairs = (
        cut.select("passage", F.explode(F.arrays_zip("seeds", "at")).alias("s"))
        .select("passage", F.col("s.seeds").alias("seed"), F.col("s.at").alias("at")).join(seeds, "seed")
        .groupBy("passage", "item_id").agg(F.collect_set("at").alias("at"))
        .join(cut.drop("seeds", "at"), "passage").join(item_words, "item_id")
    )

    def score(columns: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": [], "item_id": [], "score": [], "first_word": [], "last_word": []}
        for doc_id, item_id, first, text, item, at in zip(
            *(columns[c] for c in ("doc_id", "item_id", "first", "words", "item", "at")), strict=True
        ):
            words, wanted = text.split(" "), item.split(" ")
            for start, stop in windows(at, len(wanted)):
                value, begin, end = aligned(words[start:stop], wanted)
                if value >= LEAST:
                    row = (doc_id, item_id, round(value, 6), first + start + begin, first + start + end)
                    for name, x in zip(out, row, strict=True):
                        out[name].append(x)
        return out

    scored = map_batches(
        pairs.select("doc_id", "item_id", "first", "words", "item", "at"), score,
        "doc_id long, item_id long, score double, first_word long, last_word long",
    )
    best = F.max(F.struct("score", (-F.col("first_word")).alias("at"), "last_word")).alias("b")
    return scored.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.score", (-F.col("b.at")).alias("first_word"), "b.last_word"
    )


def op7_decontaminate(spark, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))

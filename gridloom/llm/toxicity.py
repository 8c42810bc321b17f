"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding maps look-alike letters of other scripts to Latin, digits and signs that stand for letters
to those letters, drops invisible characters, lower-cases, and turns all other signs to spaces.
Lexicon entries are words, or word beginnings of 4 to 7 letters (for inflected or compounded
words), learned as log-odds of document frequencies. Exception phrases are two-word phrases around
an entry that are typical of clean documents: a match inside one does not count. A document's
weight is summed over its matches and taken both in all and per square root of its words; a
logistic function of the two and of its largest weight gives the score.

Fitting reads a bounded sample of labelled rows (``SAMPLE`` rows, those with the smallest hash of
the id) and nothing but their texts and labels; the lexicon keeps the ``TERMS`` strongest entries.
Scoring reads every whole text.

Defined results: null and empty texts have no match and get the score of weight 0; so does every
text if no labelled row is toxic or none is clean. Of several labels of an id the highest counts;
null labels and labels without a document are ignored. Each input row gives one row; columns other
than doc_id and text are kept by ``flag_toxic`` and never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_batches, table, written

SAMPLE, TERMS = 20_000, 5_000
#: An entry is in this many toxic documents of the sample at least, at these log-odds.
MIN_TOXIC, MIN_ODDS = 4, 2.0
#: And its documents differ from the sample by this G statistic (many thousands are tried).
MIN_G = 24.0
MIN_CLEAN_PHRASES = 3
#: Times as many toxic documents as one word with it has, for a beginning to be an entry.
ADDS = 1.25
STEM = range(4, 8)
CUT = 0.7
#: Share of the sample that the penalty of the logistic regression weighs.
RIDGE = 1e-4

#: Look-alikes of Latin letters in Cyrillic and Greek, and signs that stand for letters (fixed).
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t",
    "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g",
    "ı": "i", "ȷ": "j", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
    "@": "a", "$": "s", "!": "i", "€": "e", "|": "i",
}
INVISIBLE = "­​‌‍⁠﻿"
#: Signs that stand for a letter only inside a word.
INNER_SIGN = re.compile(r"(?<=\w)[@$!€|](?=\w)|(?<![\w@$!€|])[@$€](?=\w)")


class _Fold(dict):
    """A table for str.translate that is filled as characters occur."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        low = char.lower()
        if char in INVISIBLE:
            out = ""
        elif low in LOOK_ALIKES and low.isalnum():
            out = LOOK_ALIKES[low]
        else:
            out = low if char.isalnum() or unicodedata.combining(char) else " "
        self[code] = out
        return out


_FOLD = _Fold()


def folded(text: str) -> str:
    """Words between single or more spaces, with a space at both ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "@" in text or "$" in text or "!" in text or "|" in text or "€" in text:
        text = INNER_SIGN.sub(lambda m: LOOK_ALIKES[m[0]], text)
    return f" {text.translate(_FOLD)} "


@dataclass
class Model:
    """entries: folded patterns (a space before; one after for whole words) to weights."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -20.0
    total: float = 0.0
    density: float = 0.0
    strongest: float = 0.0

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.entries:
            return None
        found = ahocorasick.Automaton()
        for pattern in self.exceptions:
            found.add_word(pattern, (len(pattern), None))
        for pattern, weight in self.entries.items():
            found.add_word(pattern, (len(pattern), weight))
        found.make_automaton()
        return found

    def score(self, weight: float, most: float, words: int) -> float:
        x = self.bias + self.strongest * most
        x += self.total * np.log1p(weight) + self.density * np.log1p(weight / max(words, 1) ** 0.5)
        return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def matched(automaton, text: str) -> tuple[float, float, int]:
    """Sum and maximum of the weights matched outside exceptions, and the number of words."""
    spread = folded(text)
    words = len(spread.split())
    if automaton is None:
        return 0.0, 0.0, words
    starts: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(spread):
        start = end - length + 1
        if weight is None:
            spared.append((start, end))
        else:
            starts[start] = max(weight, starts.get(start, 0.0))
    if spared:
        inside = {s for a, b in spared for s in starts if a <= s < b}
        starts = {s: w for s, w in starts.items() if s not in inside}
    return sum(starts.values()), max(starts.values(), default=0.0), words


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text and toxic of at most ``rows`` labelled documents outside the held-out third."""
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # At most ``rows`` rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Copies would make all their words stand out.
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic"))


def held_out(column: str):
    return F.crc32(F.col(column).cast("string")) % 3 == 1


def _counts(sample: DataFrame, features: Callable[[str], set[str]], least: str) -> dict[str, tuple[int, int]]:
    """Documents per feature, toxic and clean, where ``least`` (a condition) holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(toxic > 0)].update(features(text or ""))
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict(
                {"f": keys, "toxic": pa.array([seen[1][k] for k in keys], pa.int64()),
                 "clean": pa.array([seen[0][k] for k in keys], pa.int64())}
            )

    rows = (
        sample.mapInArrow(count, "f string, toxic long, clean long")
        .groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(least)
    )
    return {r.f: (r.toxic, r.clean) for r in rows.collect()}


def _beginnings(text: str) -> set[str]:
    """Words (with spaces at both ends) and word beginnings (with a space before)."""
    words = set(folded(text).split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in STEM if len(w) > n}


def _odds(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return float(np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1)))


def _stands_out(toxic: int, clean: int, n_toxic: int, n_clean: int) -> bool:
    odds = _odds(toxic, clean, n_toxic, n_clean)
    both, prior = toxic + clean, n_toxic / (n_toxic + n_clean)
    g = 2 * sum(
        n * np.log(n / (both * share)) for n, share in ((toxic, prior), (clean, 1 - prior)) if n
    )
    return odds >= MIN_ODDS and g >= MIN_G


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, terms: int = TERMS) -> Model:
    sample = written(labelled_sample(docs, labels, sample_rows), "labelled")
    sizes = {bool(r.y): r.n for r in sample.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Model()
    # What is rarer among toxic documents than among all can't pass the odds; it isn't collected.
    usual = f"toxic >= {MIN_TOXIC} AND toxic * {n_clean} >= clean * {n_toxic} * 3"
    counts = _counts(sample, _beginnings, usual)
    entries: dict[str, float] = {}
    strong = {f: _odds(t, c, n_toxic, n_clean) for f, (t, c) in counts.items()}
    chosen = {f for f, (t, c) in counts.items() if _stands_out(t, c, n_toxic, n_clean)}
    # A beginning that is hardly in more documents than one word with it says nothing new.
    within: dict[str, int] = {}
    for f in chosen:
        if f.endswith(" "):
            for n in STEM:
                within[f[: n + 1]] = max(within.get(f[: n + 1], 0), counts[f][0])
    # Shortest first: a word that a beginning in the lexicon covers needs no entry of its own.
    for f in sorted(chosen, key=lambda f: (len(f), f)):
        word = f.strip()
        if not f.endswith(" ") and counts[f][0] < ADDS * within.get(f, 0):
            continue
        if not any(f" {word[:n]}" in entries for n in STEM if n < len(word) or not f.endswith(" ")):
            entries[f] = strong[f]
    entries = dict(sorted(entries.items(), key=lambda e: (-counts[e[0]][0] * e[1], e[0]))[:terms])
    exceptions = _exceptions(sample, entries, n_toxic, n_clean)
    model = Model(entries, exceptions)
    return _calibrated(sample, model)


def _exceptions(sample: DataFrame, entries: dict[str, float], n_toxic: int, n_clean: int) -> list[str]:
    """Two-word phrases around an entry that are in clean documents, and hardly in toxic ones."""

    def phrases(text: str) -> set[str]:
        words = folded(text).split()
        hit = [f" {w} " in entries or any(f" {w[:n]}" in entries for n in STEM) for w in words]
        return {f" {a} {b} " for (a, x), (b, y) in pairwise(zip(words, hit, strict=True)) if x or y}

    counts = _counts(sample, phrases, f"clean >= {MIN_CLEAN_PHRASES}")
    return sorted(f for f, (t, c) in counts.items() if _odds(t, c, n_toxic, n_clean) < 0)


def _calibrated(sample: DataFrame, model: Model) -> Model:
    """Logistic regression on the weights of the sample's documents (numbers, no texts)."""

    def weigh(columns: dict[str, list]) -> dict[str, list]:
        found = model.automaton()
        pairs = [matched(found, t or "") for t in columns["text"]]
        return {"weight": [p[0] for p in pairs], "most": [p[1] for p in pairs], "words": [p[2] for p in pairs],
                "toxic": [int(y > 0) for y in columns["toxic"]]}

    rows = map_batches(sample, weigh, "weight double, most double, words long, toxic int").collect()
    weight = np.array([r.weight for r in rows])
    words = np.array([max(r.words, 1) for r in rows])
    y = np.array([r.toxic for r in rows], float)
    most = np.array([r.most for r in rows])
    x = np.stack([np.ones(len(y)), np.log1p(weight), np.log1p(weight / np.sqrt(words)), most], axis=1)
    coefficients = np.zeros(4)
    ridge = np.diag([0.0, 1.0, 1.0, 1.0]) * RIDGE * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ coefficients, -60, 60)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(4)
        coefficients += np.clip(np.linalg.solve(curve, x.T @ (y - p) - ridge @ coefficients), -5, 5)
    model.bias, model.total, model.density, model.strongest = map(float, coefficients)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def score(columns: dict[str, list]) -> dict[str, list]:
        found = model.automaton()
        scores = [model.score(*matched(found, t or "")) for t in columns["text"]]
        return {"doc_id": columns["doc_id"], "score": scores, "predicted": [int(s >= CUT) for s in scores]}

    return map_batches(docs.select("doc_id", "text"), score, "doc_id long, score double, predicted int", 4096)


def flag_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``__toxic``."""

    @F.pandas_udf("boolean")
    def toxic(texts):
        found = model.automaton()
        return texts.map(lambda t: model.score(*matched(found, t or "")) >= CUT)

    return docs.withColumn("__toxic", toxic("text"))


def op1_toxicity(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit(docs, table(spark, folder, "labels"))
    return scored(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")

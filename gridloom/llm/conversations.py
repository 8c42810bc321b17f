"""Conversation structure repair: the cheapest edits that leave ``(s?(ua)+)?`` as role initials.

Rows of a conversation are taken by turn (nulls first); rows of one turn follow each other in an
order that is fixed but means nothing (by hash of role and text). Edits are Keep (cost 0), Rerole
to user or assistant (2), Delete (3; required for rows that are blank or repeat the role and text
of an earlier row) and Insert of an empty user or assistant row anywhere (2). A row that stays though its
text does not end a sentence adds 1. Of the cheapest sequences the one with the least audit is
taken, the audit being the initials of the edits in order.

The lattice has a node for every row and state of the roles so far. A heap from the front and one from
the back settle nodes until no cheaper path can be open; then all crossings of that cost are
finished and the least audit is followed over them (:func:`cheapest`).

A conversation may be as long as a table, so nothing holds one whole:

* Roles, faults and hashes are computed row by row; equal rows are counted before any shuffle of
  them, and the first of equal rows is found by an aggregation.
* These narrow rows are dealt by range, so a long conversation lies in several partitions, and cut
  into pieces of at most ``PIECE`` rows. Each piece is searched on its own, from every state that it can
  begin in to every one that it can end in; one task then picks the states between the pieces of
  a conversation from a few numbers per piece.
* Texts are shuffled once, and stream past their edits in order. A SHA-256 is a sequence, so
  the texts of one conversation pass one task, which holds a batch of them at a time.

Defined results: nulls count as one space, in any column but conv_id and turn; a null conv_id is a
conversation of its own. Equal rows of one turn are repeats of each other. Roles other than those that
begin with s, u or a fit nowhere and are reroled or deleted. An empty conversation has zeros, an
empty audit and the hash of nothing. Other columns are ignored. Rows are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import SPACES, map_arrow, table, written

#: Rows of a piece that is searched on its own.
PIECE = 2048
#: States: nothing yet, a system row, a user row last, an assistant row last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or an assistant row, whichever may follow.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after keeping a row with initial s, u, a or another one.
KEEP = (
    (SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None),
)
BEFORE = tuple(tuple(p for p in range(4) if NEXT[p] == q) for q in range(4))
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A row that must go; other codes are twice the initial plus one if the row adds 1 when it stays.
GONE = 8
END = 4
DELETE, INSERT, REROLE = 3, 2, 2
FAR = 1 << 62


class _Lattice:
    """Edges of the nodes 4 * row + state of one piece, in order of their letters."""

    def __init__(self, codes: bytes, repeats: list[int], last: bool) -> None:
        self.codes, self.repeats, self.last, self.rows = codes, repeats, last, len(codes)

    def leaving(self, node: int) -> list[tuple[str, int, int]]:
        i, q = node >> 2, node & 3
        if i == self.rows:
            return [("I", INSERT, 4 * i + NEXT[q])] if self.last else []
        code = self.codes[i]
        insert = ("I", INSERT, 4 * i + NEXT[q])
        if code == GONE:
            return [("D", DELETE * self.repeats[i], node + 4), insert]
        edges = [("D", DELETE, node + 4), insert]
        kept = KEEP[q][code >> 1]
        if kept is not None:
            edges.append(("K", code & 1, 4 * i + 4 + kept))
        if kept != NEXT[q]:
            edges.append(("R", REROLE + (code & 1), 4 * i + 4 + NEXT[q]))
        return edges

    def entering(self, node: int) -> list[tuple[str, int, int]]:
        i, q = node >> 2, node & 3
        edges = []
        if i < self.rows or self.last:
            edges += [("I", INSERT, 4 * i + p) for p in BEFORE[q]]
        if i:
            code = self.codes[i - 1]
            if code == GONE:
                return [*edges, ("D", DELETE * self.repeats[i - 1], node - 4)]
            edges.append(("D", DELETE, node - 4))
            for p in range(4):
                kept = KEEP[p][code >> 1]
                if kept == q:
                    edges.append(("K", code & 1, 4 * i - 4 + p))
                elif NEXT[p] == q:
                    edges.append(("R", REROLE + (code & 1), 4 * i - 4 + p))
        return edges


def cheapest(codes: bytes, repeats: list[int], entry: int, exits: tuple[int, ...], last: bool) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits of a piece, by Dijkstra from both ends.

    The audit has one letter for a run of rows that must go. A piece that is not the ``last`` ends
    with the edit of its last row, so that inserts between pieces belong to the later one.
    """
    lattice = _Lattice(codes, repeats, last)
    size = 4 * len(codes) + 4
    goals = [size - 4 + q for q in exits]
    ahead, behind = {entry: 0}, dict.fromkeys(goals, 0)
    front, back = [(0, entry)], [(0, node) for node in goals]
    settled, order, finished = set(), [], set()
    best = 0 if entry in behind else FAR
    # Up to and including the best cost, so that every crossing of that cost is finished.
    while (front or back) and (front[0][0] if front else FAR) + (back[0][0] if back else FAR) <= best < FAR or (
        best == FAR and front and back
    ):
        if front and (not back or front[0][0] <= back[0][0]):
            heap, here, there, done, edges = front, ahead, behind, settled, lattice.leaving
        else:
            heap, here, there, done, edges = back, behind, ahead, finished, lattice.entering
        far, node = heappop(heap)
        if node in done:
            continue
        done.add(node)
        if heap is front:
            order.append(node)
        for _, cost, to in edges(node):
            if far + cost < here.get(to, FAR):
                here[to] = far + cost
                heappush(heap, (far + cost, to))
                best = min(best, far + cost + there.get(to, FAR))
    if best == FAR:
        return None
    # A cheapest path runs over settled nodes nearer than ``rim``, then crosses to finished ones.
    rim = front[0][0] if front else FAR
    after: dict[int, tuple[str, int]] = {}
    for node in reversed(order):
        far = ahead[node]
        if far >= rim:
            continue
        for letter, cost, to in lattice.leaving(node):
            inside = ahead.get(to) == far + cost and to in after and ahead[to] < rim
            if inside or (to in finished and far + cost + behind[to] == best):
                after[node] = (letter, to)
                break
        else:
            if node in goals and far == best:
                after[node] = ("", -1)
    audit, node = [], entry
    while node in after:
        letter, node = after[node]
        audit.append(letter)
    while node >= 0 and behind[node] > 0 or (node >= 0 and node not in goals):
        for letter, cost, to in lattice.leaving(node):
            if to in finished and cost + behind[to] == behind[node]:
                audit.append(letter)
                node = to
                break
    return best, "".join(audit)


# From rows to pieces

KEY = ["conv_id", "turn", "h1", "h2"]


def _cleaned(rows: DataFrame) -> DataFrame:
    """Rows with nulls as spaces and a hash of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"),
    ).select("*", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role").alias("h2"))


def _initial(role: Column) -> Column:
    letter = F.substring(role, 1, 1)
    return F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)


def _marked(cleaned: DataFrame) -> DataFrame:
    """One narrow row for all equal rows of a turn: copies, initial, blank, cut, and first."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    counted = written(
        cleaned.select(
            *KEY, _initial(F.col("role")).alias("initial"), (end == "").alias("blank"),
            (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
        ).groupBy(*KEY, "initial", "blank", "cut").agg(F.count("*").alias("copies")),
        "turns",
    )
    same = ["conv_id", "h1", "h2"]
    earliest = counted.groupBy(*same).agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull().cast("int")).alias("unnumbered")
    ).select(F.col("conv_id").alias("c"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "least", "unnumbered")
    equal = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    first = F.when(F.col("unnumbered") == 1, F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    return counted.join(earliest, equal).select(*counted.columns, first.alias("first"))


NUMBERS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")
PIECE_SCHEMA = (
    "conv_id long, part int, seq long, turn long, h1 long, h2 long, codes binary, repeats binary, "
    + ", ".join(f"{n} long" for n in NUMBERS) + ", opens int, closes int"
)
LEGAL = {(0, 1), (1, 2), (2, 1)}


class _Piece:
    """A run of rows of one conversation."""

    def __init__(self, row: tuple, part: int, seq: int) -> None:
        self.key, self.part, self.seq = row[:4], part, seq
        self.codes, self.repeats = bytearray(), []
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.opens, self.closes = row[4], None

    def add(self, row: tuple) -> None:
        _, turn, _, _, initial, blank, cut, copies, first = row
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        if self.closes is not None:
            self.illegal += (self.closes, initial) not in LEGAL
        self.closes = initial
        self.illegal += copies - 1
        gone = copies
        if blank:
            self.blank += copies
        elif first:
            gone -= 1
            self.codes.append(2 * initial + cut)
            self.repeats.append(1)
            self.truncated += cut
        if gone:
            self.duplicate += 0 if blank else gone
            if self.codes and self.codes[-1] == GONE:
                self.repeats[-1] += gone
            else:
                self.codes.append(GONE)
                self.repeats.append(gone)

    def record(self) -> list:
        repeats = np.array(self.repeats, "<i8").tobytes()
        numbers = [getattr(self, n) for n in NUMBERS]
        conv_id, turn, h1, h2 = self.key
        return [conv_id, self.part, self.seq, turn, h1, h2, bytes(self.codes), repeats, *numbers, self.opens, self.closes]


def _columns(names: list[str], records: list[list]) -> dict[str, list]:
    return dict(zip(names, map(list, zip(*records, strict=True)), strict=True))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batched(schema: str, records: Iterator[list], most: int = 256) -> Iterator[dict[str, list]]:
    names, held = _names(schema), []
    for record in records:
        held.append(record)
        if len(held) >= most:
            yield _columns(names, held)
            held = []
    if held:
        yield _columns(names, held)


def _pieces(marked: DataFrame, most: int) -> DataFrame:
    """Pieces in order of (part, seq), which is the order of rows within a conversation."""
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        part, seq, piece = TaskContext.get().partitionId(), 0, None
        for row in _rows(batches):
            if piece is None or piece.key[0] != row[0] or len(piece.codes) >= most:
                if piece is not None:
                    yield piece.record()
                piece, seq = _Piece(row, part, seq), seq + 1
            piece.add(row)
        if piece is not None:
            yield piece.record()

    columns = [*KEY, "initial", "blank", "cut", "copies", "first"]
    pieces = map_arrow(dealt.select(columns), lambda batches: _batched(PIECE_SCHEMA, cut(batches)), PIECE_SCHEMA)
    # A row per piece, not per turn, meets in this window.
    within = Window.partitionBy("conv_id").orderBy("part", "seq")
    return pieces.select(
        "*", F.lag("seq").over(within).isNull().alias("head"), F.lead("seq").over(within).isNull().alias("tail")
    )


FOUND = "entries array<int>, exits array<int>, costs array<long>, ranks array<int>, audits array<string>"


def _searched(pieces: DataFrame) -> DataFrame:
    """Pieces with cost and audit from each state that they can begin in to each they can end in."""
    schema = f"{PIECE_SCHEMA}, head boolean, tail boolean, {FOUND}"

    def options(codes: bytes, repeats: bytes, head: bool, tail: bool) -> list[list]:
        counts = np.frombuffer(repeats, "<i8").tolist()
        found = []
        for entry in (START,) if head else range(4):
            ends = [(END, (START, ASSISTANT))] if tail else [(q, (q,)) for q in range(4)]
            made = [(entry, end, cheapest(codes, counts, entry, goals, tail)) for end, goals in ends]
            made = sorted(((a, b, x[0], x[1]) for a, b, x in made if x is not None), key=lambda x: x[3])
            found += [[a, b, cost, rank, audit] for rank, (a, b, cost, audit) in enumerate(made)]
        return [list(c) for c in zip(*found, strict=True)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = _names(PIECE_SCHEMA)
        codes, repeats = names.index("codes"), names.index("repeats")
        records = ([*row, *options(row[codes], row[repeats], row[-2], row[-1])] for row in _rows(batches))
        return _batched(schema, records)

    return map_arrow(pieces, search, schema)


PICKED = (
    "conv_id long, part int, seq long, pick int, head boolean, "
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
)


def _chosen(searched: DataFrame) -> DataFrame:
    """The option that each piece takes, and on the first piece the numbers of its conversation."""
    names = ["conv_id", "part", "seq", *NUMBERS, "opens", "closes", "entries", "exits", "costs", "ranks"]
    at = {n: i for i, n in enumerate(names)}

    def choose(pieces: list[tuple]) -> Iterator[list]:
        go = [{END: 0}]
        for piece in reversed(pieces):
            here: dict[int, int] = {}
            for a, b, cost in zip(piece[at["entries"]], piece[at["exits"]], piece[at["costs"]], strict=True):
                if b in go[-1]:
                    here[a] = min(here.get(a, FAR), cost + go[-1][b])
            go.append(here)
        go.reverse()
        blank, duplicate, truncated, illegal = (sum(p[at[n]] for p in pieces) for n in NUMBERS[3:])
        turns, low, high, closes = 0, None, None, None
        for p in pieces:
            if p[at["low"]] is not None:
                turns += p[at["turns"]] - (p[at["low"]] == high)
                low, high = (p[at["low"]] if low is None else low), p[at["high"]]
            if closes is not None:
                illegal += (closes, p[at["opens"]]) not in LEGAL
            closes = p[at["closes"]]
        gaps = 0 if low is None else high - low + 1 - turns
        entry = START
        for i, p in enumerate(pieces):
            options = zip(p[at["entries"]], p[at["exits"]], p[at["costs"]], p[at["ranks"]], strict=True)
            _, pick, to = min(
                (rank, n, b) for n, (a, b, cost, rank) in enumerate(options)
                if a == entry and b in go[i + 1] and cost + go[i + 1][b] == go[i][a]
            )
            numbers = [gaps, blank, duplicate, truncated, illegal, go[0][START]] if i == 0 else [None] * 6
            yield [*p[:3], pick, i == 0, *numbers]
            entry = to

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        grouped = groupby(_rows(batches), key=lambda row: row[0])
        return _batched(PICKED, (record for _, pieces in grouped for record in choose(list(pieces))))

    parts = int(searched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = searched.select(names).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return map_arrow(dealt, assemble, PICKED)


# Edits beside texts

REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
REPAIRED = "conv_id long, place long, edit string, role string, text string"
NOTHING, EDITS, TEXT = range(3)


class _Edited:
    """Follows the edits of one conversation past its rows."""

    def __init__(self) -> None:
        self.state, self.edits, self.numbers, self.audit = START, [], None, []

    def follow(self, audit: str, codes: bytes, repeats: bytes) -> Iterator[tuple[str, str, str]]:
        """The edits of the next piece; what is left of the last one are inserts."""
        yield from self.rest()
        counts = iter(np.frombuffer(repeats, "<i8").tolist())
        self.edits = [[letter, 1 if letter == "I" else next(counts)] for letter in audit]
        self.audit += [letter * count for letter, count in self.edits]
        self.edits.reverse()

    def _insert(self) -> tuple[str, str, str]:
        self.edits.pop()
        self.state = NEXT[self.state]
        return "I", ROLES[self.state], ""

    def rest(self) -> Iterator[tuple[str, str, str]]:
        while self.edits:
            yield self._insert()

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What becomes of a row, with the inserts before it."""
        while self.edits[-1][0] == "I":
            yield self._insert()
        letter = self.edits[-1][0]
        self.edits[-1][1] -= 1
        if not self.edits[-1][1]:
            self.edits.pop()
        if letter == "K":
            self.state = KEEP[self.state]["sua".index(role[0])]
            yield letter, role, text
        elif letter == "R":
            self.state = NEXT[self.state]
            yield letter, ROLES[self.state], text


def _stream(cleaned: DataFrame, ids: DataFrame | None, most: int) -> tuple[DataFrame, list[str]]:
    """Edits and texts of every conversation in order, each piece's edits before its first row."""
    searched = written(_searched(_pieces(_marked(cleaned), most)), "pieces")
    picks = _chosen(searched).drop("conv_id").withColumnsRenamed({"part": "p", "seq": "s", "head": "leads"})
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    edits = searched.drop(*numbers).join(picks, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select(
        *KEY, F.lit(EDITS).alias("kind"), F.get("audits", "pick").alias("role"), F.lit(None).cast("string").alias("text"),
        "codes", "repeats", *numbers,
    )
    texts = cleaned.select(*KEY, F.lit(TEXT).alias("kind"), "role", "text")
    rows = edits.unionByName(texts, allowMissingColumns=True)
    if ids is not None:
        every = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        rows = rows.unionByName(every.withColumn("kind", F.lit(NOTHING)), allowMissingColumns=True)
    parts = int(cleaned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*KEY, "kind", "role", "text", "codes", "repeats", *numbers]
    return rows.select(columns).repartition(parts, "conv_id").sortWithinPartitions(*KEY, "kind"), columns


def _walk(rows: Iterator[tuple], edited: _Edited) -> Iterator[tuple[str, str, str]]:
    for row in rows:
        kind, role, text = row[4:7]
        if kind == EDITS:
            yield from edited.follow(role, row[7], row[8])
            if row[9] is not None:
                edited.numbers = row[9:15]
        elif kind == TEXT:
            yield from edited.row(role, text)
    yield from edited.rest()


def report(rows: DataFrame, ids: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """Faults, cost, audit and hash of the repaired rows per conversation.

    ``rows`` has conv_id, turn, role and text; ``ids`` names conversations that are reported even
    without rows.
    """

    def conversation(conv_id, rows) -> list:
        edited, digest, between = _Edited(), hashlib.sha256(), b""
        for _, role, text in _walk(rows, edited):
            digest.update(between + f"{role}:{text}".encode())
            between = b"\n"
        numbers = edited.numbers or [0] * 6
        return [conv_id, *numbers, "".join(edited.audit), digest.hexdigest()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        return _batched(REPORT, (conversation(c, g) for c, g in groupby(_rows(batches), key=lambda row: row[0])))

    return map_arrow(_stream(_cleaned(rows), ids, piece)[0], run, REPORT)


def repaired(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The rows of repaired conversations: conv_id, place from 0, edit (K, R or I), role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        grouped = groupby(_rows(batches), key=lambda row: row[0])
        return _batched(
            REPAIRED, ([c, place, *made] for c, g in grouped for place, made in enumerate(_walk(g, _Edited())))
        )

    return map_arrow(_stream(_cleaned(rows), None, piece)[0], run, REPAIRED)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or reroled by a checksum of conversation and turn."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20
    kinds = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return kinds.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        copies.alias("copy"),
    ).drop("copy")


def op11_repair(spark, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return report(damaged(conversations), conversations)

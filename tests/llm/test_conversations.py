"""Repair of conversations against a plain search over every sequence of edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from gridloom.llm import conversations
from gridloom.llm.conversations import END, GONE, cheapest

SCHEMA = "conv_id long, turn long, role string, text string"
MUST_END = re.compile(r"[^\x20\x09-\x0D]")


def brute_repair(rows):
    """Numbers, cost, audit and hash of one conversation whose rows are in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        signs = MUST_END.findall(text)
        faults.append(
            "blank" if not signs else "duplicate" if (role, text) in seen
            else "truncated" if signs[-1] not in ".!?" else None
        )
        seen.add((role, text))
    pairs = zip(rows, rows[1:], strict=False)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)

    @cache
    def best(i, out):
        """Cost, audit and kept lines; ``out`` is the initials so far, of which the last two matter."""
        last = out[-1:]
        wanted = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[wanted]
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if len(out) < 2 * len(rows) + 4:
            if depth(out) < 2:
                cost, audit, lines = best(i, out + "." + wanted)
                found.append((cost + 2, "I" + audit, (name + ":",) + lines))
        if i < len(rows):
            _, role, text = rows[i]
            base = out.replace(".", "")
            cost, audit, lines = best(i + 1, base)
            found.append((cost + 3, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] == wanted or (role[:1] == "s" and base == ""):
                    cost, audit, lines = best(i + 1, base + role[0])
                    found.append((cost + more, "K" + audit, (role + ":" + text,) + lines))
                cost, audit, lines = best(i + 1, base + wanted)
                found.append((cost + 2 + more, "R" + audit, (name + ":" + text,) + lines))
        return min(found) if found else (10**9, "", ())

    def depth(out):
        return out.count(".")

    cost, audit, lines = best(0, "")
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, digest)


def random_rows(rng, most, roles=("system", "user", "assistant", "tool", None, "")):
    rows, turn = [], 0
    for _ in range(rng.randint(0, most)):
        turn += rng.choice((1, 1, 1, 2))
        text = rng.choice((f"t{turn}.", f"u{turn}!", f"v{turn}", "same.", "", " \t", None, "cut"))
        rows.append((turn, rng.choice(roles), text))
    return rows


@pytest.mark.parametrize("piece", [1, 3, 2048])
def test_repair_matches_brute_force(spark, piece):
    rng = random.Random(piece)
    talks = {i: random_rows(rng, 7) for i in range(120)}
    talks[500] = []
    rows = [(i, *row) for i, talk in talks.items() for row in talk]
    rng.shuffle(rows)
    ids = spark.createDataFrame([(i, "x") for i in talks], "conv_id long, text string")
    made = conversations.report(spark.createDataFrame(rows, SCHEMA), ids, piece)
    got = {r.conv_id: tuple(r)[1:] for r in made.collect()}
    assert got == {i: brute_repair(talk) for i, talk in talks.items()}


def test_repair_of_long_conversations_is_the_same_in_pieces(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(("user", "assistant")), rng.choice((f"a{t}.", f"b{t}", "again."))) for t in range(1500)]
    rows += [(2, 0, "user", "x" * 200_000 + "."), (2, 1, "assistant", "y.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole, pieces = (
        sorted(tuple(r) for r in conversations.report(frame, None, most).collect()) for most in (10_000, 64)
    )
    assert whole == pieces
    digest = hashlib.sha256(f"user:{'x' * 200_000}.\nassistant:y.".encode()).hexdigest()
    assert whole[1] == (2, 0, 0, 0, 0, 0, 0, "KK", digest)


def test_repaired_rows_follow_the_grammar_and_give_the_hash(spark):
    rng = random.Random(8)
    talks = {i: random_rows(rng, 9) for i in range(40)}
    frame = spark.createDataFrame([(i, *row) for i, talk in talks.items() for row in talk], SCHEMA)
    digests = {r.conv_id: r.repaired_sha256 for r in conversations.report(frame).collect()}
    by_talk = {}
    for r in sorted(conversations.repaired(frame).collect()):
        by_talk.setdefault(r.conv_id, []).append((r.role, r.text))
    for i, digest in digests.items():
        lines = by_talk.get(i, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in lines))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest() == digest


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, "user", "hi."), (3, 2, "user", "a."), (3, 2, "user", "a."), (3, 2, "user", "a."),
            (3, 3, "assistant", "b."), (4, None, "user", "q."), (4, 1, "assistant", "r."), (4, 2, "user", "q.")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", h1 int, kind string")
    got = {r.conv_id: r for r in conversations.report(frame).collect()}
    assert got[3].duplicate == 2 and got[3].audit == "KDDK" and got[3].illegal == 2 and got[3].gaps == 0
    assert got[4].duplicate == 1 and got[4].audit == "KKD" and got[4].cost == 3
    assert got[None].blank == 1 and sorted(got[None].audit) == sorted("DIK") and got[None].gaps == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.report(empty, empty).count() == 0 and conversations.repaired(empty).count() == 0


def test_cheapest_between_states():
    assert cheapest(b"", [], 0, (0, 3), True) == (0, "")
    assert cheapest(b"", [], 1, (0, 3), True) == (4, "II")
    assert cheapest(bytes([GONE]), [5], 2, (2,), False) == (15, "D")
    assert cheapest(bytes([2, 4]), [1, 1], 3, (0,), False) is None
    assert END not in (0, 1, 2, 3)


def test_query_damages_and_repairs_every_conversation(spark):
    folder = "/root/testdata/sf0.001"
    kept = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        rows = kept.setdefault(r.conv_id, [])
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role, text = "user" if kind == 4 else r.role, re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        if kind:
            rows += [(r.turn, role, "" if kind == 1 else text)] * (2 if kind == 3 else 1)
    want = {i: brute_repair(sorted(rows, key=lambda row: row[0])) for i, rows in kept.items()}
    assert {r.conv_id: tuple(r)[1:] for r in conversations.op11_repair(spark, folder).collect()} == want

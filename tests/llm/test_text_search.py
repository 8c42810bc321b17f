"""Lines, secrets, toxicity, top-k and mixing on small inputs, against brute force."""

import base64
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import lines, mixing, secret_scan, topk, toxicity

DOCS = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Lines


def line_dedup(rows, least=3, chars=20):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(
        str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc_id)
    out = {}
    for doc_id, text in rows:
        split = (text or "").split("\n")
        stay = [
            line for line in split
            if len(key(line)) < chars or len(holders[key(line)]) < least or doc_id == max(holders[key(line)])
        ]
        out[doc_id] = (len(split), len(split) - len(stay), "\n".join(stay))
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    pool = [" Shared line number %d that is long enough" % i for i in range(6)] + ["short", "", "ÄÖ ü" * 6]
    rows = [
        (i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 8))))
        for i in range(60)
    ] + [(60, None), (61, ""), (62, "\n".join(["x" * 30] * 2000)), (63, "\n" * 5), (64, pool[0] + "\t\r\n\x0b")]
    got = lines.dedup_lines(spark.createDataFrame(rows, DOCS))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got.collect()} == line_dedup(rows)


def test_line_dedup_of_null_ids_repeated_rows_and_nothing(spark):
    line = "a line that three documents hold"
    rows = [(None, line), (1, line), (1, line), (2, line), (None, "other")]
    got = lines.dedup_lines(spark.createDataFrame(rows, DOCS).withColumn("batch", F.lit(7)))
    assert sorted((r.doc_id or -1, r.n_dropped, r.kept) for r in got.collect()) == [
        (-1, 0, "other"), (-1, 1, ""), (1, 1, ""), (1, 1, ""), (2, 0, line)
    ]
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_compacted_runs_hold_the_same_state(spark):
    rows = [(i % 7, i % 5, i) for i in range(40)]
    frame = spark.createDataFrame(rows, "h1 long, h2 long, doc_id long")
    runs = lines.LineRuns(spark, fanout=2, buckets=3)
    for part in range(4):
        runs.add(frame.filter(F.col("doc_id") % 4 == part))
    assert len(runs.runs()) == 1
    want = {}
    for h1, h2, doc in rows:
        docs, last = want.get((h1, h2), (0, 0))
        want[h1, h2] = (docs + 1, max(last, doc))
    assert {(r.h1, r.h2): (r.docs, r.last) for r in runs.state().collect()} == want


def occurrences(spark):
    rows = [(i % 7, i % 5, i) for i in range(40)]
    return spark.createDataFrame(rows, "h1 long, h2 long, doc_id long")


@pytest.mark.parametrize("fanout", [2, 3, 9])
def test_a_line_is_new_in_one_run_only(spark, fanout):
    frame, runs = occurrences(spark), lines.LineRuns(spark, fanout=fanout, buckets=3)
    for part in range(5):
        runs.add(frame.filter(F.col("doc_id") % 5 == part))
    new = lines.union_of(runs.runs()).filter("first")
    assert new.count() == new.select(*lines.HASH).distinct().count() == 35
    assert runs.state().count() == 35 and runs.state().agg(F.sum("docs")).first()[0] == 40


def test_the_anti_join_carries_the_result(spark, monkeypatch):
    """Without it every batch would start its own record of a line."""
    frame, runs = occurrences(spark), lines.LineRuns(spark, fanout=9, buckets=3)
    monkeypatch.setattr(lines.LineRuns, "runs", lambda self: [])
    for part in range(5):
        runs.add(frame.filter(F.floor(F.col("doc_id") / 8) == part))
    monkeypatch.undo()
    assert runs.state().count() > 35


# Secrets


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def private_key():
    number = lambda n: der(2, b"\x01" * n)
    return der(0x30, der(2, b"\x00"), *(number(40) for _ in range(8)))


def token(header):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{part(header)}.{part({'sub': 'someone'})}.c2lnbmF0dXJl"


def kinds(text):
    return [k for _, _, k in sorted(secret_scan.confirmed_spans(text))]


def test_secrets_are_confirmed_by_structure():
    good = base64.b64encode(private_key()).decode()
    assert kinds(f"see {good} here") == ["der"]
    assert kinds(f"see {private_key().hex()} here") == ["der"]
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{good}\n-----END RSA PRIVATE KEY-----") == ["pem", "der"]
    assert kinds(f"x {token({'alg': 'HS256'})} y") == ["jwt"]
    blob = b"".join(len(p).to_bytes(4, "big") + p for p in (b"ssh-ed25519", b"k" * 32))
    assert kinds(f"ssh-ed25519 {base64.b64encode(blob).decode()} me") == ["ssh"]


def test_lookalikes_are_not_reported():
    broken = private_key()[:-3]
    assert kinds(base64.b64encode(broken).decode()) == []
    assert kinds(broken.hex()) == [] and kinds("ab" * 60) == [] and kinds("A" * 90) == []
    assert kinds(token({"kid": "no algorithm"})) == []
    assert kinds(f"-----BEGIN PRIVATE KEY-----\n{'QUJD' * 20}\n-----END PRIVATE KEY-----") == []


def wrapped(text, end, width=64):
    return end.join(text[i : i + width] for i in range(0, len(text), width))


def test_keys_over_lines_and_escaped_keys_are_confirmed():
    good = base64.b64encode(private_key()).decode()
    for end in ("\n", "\r\n", "\\n", "\n  "):
        block = f"-----BEGIN PRIVATE KEY-----{end}{wrapped(good, end)}{end}-----END PRIVATE KEY-----"
        assert "pem" in kinds(f'{{"private_key": "{block}"}}'), repr(end)
        bare = f"key: {wrapped(good, end)} and"
        found = secret_scan.confirmed_spans(bare)
        assert [(bare[a:b], k) for a, b, k in found] == [(wrapped(good, end), "der")], repr(end)
    # Lines that do not make a key together, and a key of whole lines above other text.
    assert kinds(wrapped(good[:-8], "\n")) == [] and kinds("\n".join(["QUJD" * 12] * 9)) == []
    full = next(good for n in range(40, 90) if len(good := base64.b64encode(sized_key(n)).decode().rstrip("=")) % 64 == 0)
    text = f"{wrapped(full, chr(10))}\nafterwards"
    assert [(text[a:b], k) for a, b, k in secret_scan.confirmed_spans(text)] == [(wrapped(full, "\n"), "der")]


def sized_key(n):
    number = lambda n: der(2, b"\x01" * n)
    return der(0x30, der(2, b"\x00"), number(n), *(number(40) for _ in range(7)))


def test_tokens_with_spaces_in_their_json_are_confirmed():
    part = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    for head, body in (('{ "alg": "HS256" }', "{ }"), ('\n{"alg":"RS256"}', '{"a": 1}'), ('{\n "alg": "ES256"}', "{}")):
        assert kinds(f"Bearer {part(head)}.{part(body)}.c2ln") == ["jwt"]
    assert kinds(f"{part('[1, 2, 3, 4, 5, 6]')}.{part('{}')}.c2ln") == [] and kinds("www.a-long-enough-host-name.example.org") == []


def brute_base(text):
    """Spans by walking over every place of a text."""
    name = "A-Za-z0-9+/_.=-"
    out, at = [], 0
    while at < len(text):
        m = re.compile(rf"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([{name}]+)""").match(text, at)
        if m and len(m[1]) >= 6:
            out.append((at, m.end(), "assign"))
        at = m.end() if m else at + 1
    for kind, first, signs, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            end = at + len(first) if text.startswith(first, at) else at
            while (end > at or not first) and end < len(text) and text[end] in signs:
                end += 1
            if end > at + len(first) and end - at >= least:
                out.append((at, end, kind))
            at = max(end if end > at + len(first) else at + 1, at + 1)
    return secret_scan.joined(out)


def test_base_spans_match_a_walk_over_random_texts(spark):
    rng = random.Random(11)
    parts = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", ":", "=", " ", '"', "'", "abc", "Zz9_", "AKIA", "AKIAB" * 4, "0f" * 9,
             "0f" * 14, "é", "\n", "x" * 30, "Q" * 17, "-----", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts.append("token = " + "abcdef0123456789" * 40_000 + " é secret: x")
    frame = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.base for r in secret_scan.scan_secrets(frame).collect()}
    assert got == {i: brute_base(text) for i, text in enumerate(texts)}
    assert secret_scan.scan_secrets(frame.limit(0)).count() == 0


def test_base_spans_follow_the_rules(spark):
    text = "ä password: token: abcdefgh API-key='x' apikey = \"Zz09+/_.=-\" AKIA" + "B" * 16 + " AKIAshort " + "0f" * 12 + "g"
    rows = [(1, text), (2, None), (3, ""), (None, "secret=abcdef"), (1, text)]
    got = secret_scan.scan_secrets(spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(None).cast("string")))
    found = sorted(got.collect(), key=lambda r: (r.doc_id or 0))
    assert len(found) == 5 and found[0].base == "assign:0:13" and found[3].base == found[4].base == ""
    first = found[1]
    spans = [s.split(":") for s in first.base.split(",")]
    # "password: token" takes the text that a later match would need, and is then too short.
    assert [k for k, _, _ in spans] == ["assign", "access", "hex"]
    assert (first.n_assign, first.n_access, first.n_hex) == (1, 1, 1)
    assert text[int(spans[2][1]) : int(spans[2][2])] == "0f" * 12


# Toxicity


def toxic_corpus(n=900):
    rng = random.Random(5)
    clean = [f"{a}{b}" for a in "bdfglmnpr" for b in ("ano", "ere", "ilo", "uma", "oti")]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["blorgle", "snivvelhead", "snivvelton", "snivvelish"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_learns_and_sees_through_disguise(spark):
    docs, labels = toxic_corpus()
    docs += [(10_001, "ano blоrgl3 ere " + "ilo " * 20), (10_002, None), (10_003, ""), (None, "ere " * 9), (10_004, "Snivv3lmark ano")]
    frame = spark.createDataFrame(docs, DOCS)
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert " blorgle " in model.entries and any(e in model.entries for e in (" sniv", " snivv", " snivve"))
    got = {r.doc_id: r for r in toxicity.scored(frame, model).collect()}
    held = [(i, y) for i, y in labels if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].predicted == y for i, y in held)
    assert got[10_001].predicted == got[10_004].predicted == 1
    assert got[10_002].score == got[10_003].score < 0.5 and 0 <= got[None].score <= 1


def test_exception_phrases_spare_a_word():
    model = toxicity.Model({" trash ": 4.0}, [" trash can "], bias=-3, strongest=2)
    automaton = model.automaton()
    assert toxicity.matched(automaton, "the trash can is full")[0] == 0
    assert toxicity.matched(automaton, "you TR4SH, trash can")[0] == 4.0


def test_toxicity_without_labels(spark):
    frame = spark.createDataFrame([(1, "any text"), (2, None)], DOCS)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    nulls = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    for labels in (empty, nulls):
        model = toxicity.fit(frame, labels)
        assert [r.predicted for r in toxicity.scored(frame, model).collect()] == [0, 0]
    assert toxicity.scored(spark.createDataFrame([], DOCS), model).count() == 0


# Top-k


def brute_top(rows, k):
    whole = [
        (i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = set()
    for qid in {i for i, _ in whole if i % 20 == 0}:
        query = min(v for i, v in whole if i == qid)
        scores = [(-sum(a * b for a, b in zip(query, v)), i) for i, v in whole if i != qid]
        out |= {(qid, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_top_k_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(90)]
    rows += [(100 + i, [0.5, 0.5, -0.25, 1.0, 0.0]) for i in range(70)]
    rows += [(300, None), (301, [None, 1.0]), (302, [float("nan"), 1.0]), (303, [float("inf")]), (None, [1.0]),
             (304, []), (305, [1.0]), (40, [9.0, 9.0]), (401, [3e4] * 5), (401, [3e4] * 5)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20, query_rows=3, candidate_rows=16)
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()}
    assert found == brute_top(rows, 20)


def test_top_k_of_long_vectors_with_scores_at_a_bin_edge(spark):
    # The interval of 200,004 scores has bins of 782, and 782 is no multiple of the next step, 4.
    edge = -100_002 + 782 * 200
    scores = [edge + 1] * 5 + [edge] * 5 + [edge - 1] * 5 + [edge - 2] * 185
    rows = [(0, [1])] + [(i, [s]) for i, s in enumerate(scores, 1)] + [(999, [-100_000])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") == 0)
    want = sorted(((-s, i) for i, s in enumerate(scores, 1)))[:20]
    assert [(-r.score, r.vec_id) for r in got.orderBy("rank").collect()] == want


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = topk.integer_vectors(spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [-3.0])], schema))
    got = topk.top_k(few, F.col("vec_id") % 20 == 0)
    assert [(r["rank"], r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(1, 1, 4096), (2, 2, -12288)]
    for rows in ([], [(1, [1.0])]):
        none = topk.integer_vectors(spark.createDataFrame(rows, schema))
        assert topk.top_k(none, F.col("vec_id") % 20 == 0).count() == 0


def brute_ranks(rows, k):
    whole = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows]
    out = []
    for own in {i for i, _ in whole if i % 20 == 0}:
        query = min(v for i, v in whole if i == own)
        scores = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in whole if i != own)
        out += [(own, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k_is_bounded_by_a_first_part_of_the_candidates(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(260)]
    rows += [(1000 - i, rows[20][1]) for i in range(60)] + [(40, [0.25] * 8)] * 30 + [(7, rows[0][1])] * 25
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(4)
    want = brute_ranks(rows, 20)
    for first in (1, 100):
        got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, query_rows=9, candidate_rows=32, first_rows=first)
        assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("most, paired", [(8, True), (300, False), (10**6, False), (3 * 10**8, False)])
def test_block_of_candidates_scores_each_pair_once(monkeypatch, most, paired):
    # Products hold two scores, or one in 32 or 64 bits of floating point or 64 bits of integers.
    rng = np.random.default_rng(most)
    data, asking = rng.integers(-most, most + 1, (5_000, 40)), rng.integers(-most, most + 1, (700, 40))
    data[rng.random(5_000) < 0.001] = asking[3]
    ids, own = rng.integers(0, 4_000, 5_000), np.arange(700)
    scores = asking @ data.T
    kth = np.sort(scores, axis=1)[:, -12]
    kth[-5:] = topk.LOWEST
    last = np.where(own % 2 == 0, topk.HIGHEST, 2_000)
    pairs, product = [], topk.Block._product

    def counted(block, queries, candidates):
        pairs.append(queries.shape[0] * candidates.shape[1])
        return product(block, queries, candidates)

    monkeypatch.setattr(topk.Block, "_product", counted)
    kind = np.int8 if most < 128 else np.int64
    group = topk.Group(np.stack([own, kth, last], 1), asking.astype(kind))
    found = topk.Block(ids, data.astype(kind), 20).best(group)
    want = []
    for q in own:
        counts = (ids != q) & ((scores[q] > kth[q]) | ((scores[q] == kth[q]) & (ids <= last[q])))
        want += [(q, i, -s) for s, i in sorted(zip(-scores[q][counts], ids[counts]))[:20]]
    assert sorted(zip(found["query_id"], found["vec_id"], found["score"])) == sorted(want)
    assert (sum(pairs) < 0.8 * scores.size) if paired else (sum(pairs) == scores.size)


# Mixing


def test_rates_meet_target_weights_and_draws_follow_them(spark):
    rows = [(i, "abcd" * 5, "big" if i % 10 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rate = mixing.rates(docs, {"big": 1.0, "small": 1.0})
    assert {r["__source"]: round(r["__rate"], 3) for r in rate.collect()} == {"big": 0.556, "small": 5.0}
    mixed = mixing.mix_sources(docs, rate)
    assert mixed.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(counts["big"] - 2000) < 200 and abs(counts["small"] - 2000) < 200
    assert mixed.collect() == mixing.mix_sources(docs, rate).collect()


def test_mixing_of_odd_inputs(spark):
    rows = [(1, "x", None, 9), (None, "y", None, 9), (2, None, "empty", 9), (2, None, "empty", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    mixed = mixing.mix_sources(docs, mixing.rates(docs))
    assert set(mixed.columns) == {"doc_id", "text", "source", "copy", "shuffle_key"}
    assert all(r.copy >= 1 for r in mixed.collect())
    nothing = spark.createDataFrame([], docs.schema)
    assert mixing.mix_sources(nothing, mixing.rates(nothing)).count() == 0


def test_poisson_steps_are_its_distribution(spark):
    frame = spark.range(1).select(mixing.poisson_steps(F.lit(2.5)).alias("a"), mixing.poisson_steps(F.lit(900.0)).alias("b"))
    row = frame.first()
    assert abs(row.a[2] - 0.543813) < 1e-6 and abs(row.b[-1] - 1) < 1e-9 and abs(row.b[900] - 0.5088) < 1e-3

"""Joins, repeats, contamination, tokens, pages and the pipeline on small inputs, against brute force."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import components, decontaminate, html_text, jaccard, repeats, suffix_array, tokens

DOCS = "doc_id long, text string"


# Jaccard join


def brute_components(rows, n, percent):
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
        sets[doc_id] = frozenset(runs)
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and label[b] < label[a] and 100 * len(x & y) >= percent * len(x | y):
                    label[a], changed = label[b], True
    return {i: (len(s), label[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 70)])
def test_jaccard_components_match_brute_force(spark, n, percent):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, bases = [], [[rng.choice(vocabulary) for _ in range(size)] for size in (1, 2, 4, 9, 12, 14, 18, 25, 60, 150)]
    for base in bases:
        for _ in range(16):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.choice((0, 1))] = [rng.choice(vocabulary)] * rng.choice((0, 1))
            rows.append((len(rows), (" " if rng.random() < 0.5 else "\n\t").join(words).swapcase()))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "w1 w1 w1 w1 w1 w1 w1 w1"), (1004, "\x85 "), (1005, "É W1")]
    rng.shuffle(rows)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, n, percent)


def test_jaccard_without_filters_and_with_odd_rows(spark, monkeypatch):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "g h"), (2, "g h"), (5, "x " * 300), (4, "x y " * 300)]
    frame = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(jaccard, "FILTER_MOST", 0)
    got = sorted((r.doc_id or 0, r.component_id) for r in jaccard.jaccard_components(frame, 3, 90).collect())
    assert got == [(0, None), (1, 1), (2, 2), (2, 2), (3, 1), (4, 4), (5, 5)]
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_jaccard_light_and_heavy_agree(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(24)]
    rows = []
    for i in range(60):
        words = base[: rng.randint(12, 24)]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"other{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    frame, found = spark.createDataFrame(rows, DOCS), []
    for boundary in (4, 13, 22):
        monkeypatch.setattr(jaccard, "BOUNDARIES", range(boundary, boundary + 1))
        found.append({r.doc_id: r.component_id for r in jaccard.jaccard_components(frame, 1, 90).collect()})
    assert found[0] == found[1] == found[2] == {i: c for i, (_, c) in brute_components(rows, 1, 90).items()}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (60, 55)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {55: 55, 60: 55}
    assert {r.node: r.component for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Suffix arrays and repeats


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_is_the_sorted_order(text):
    assert suffix_array.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(rows, width):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - width + 1):
            piece = raw[at : at + width]
            if piece in seen:
                gone[at : at + width] = True
            seen.add(piece)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[doc_id] = (len(raw), int(gone.sum()), runs, kept)
    return out


def repeated_corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (20, 40, 90)]
    rows = []
    for i in range(70):
        parts = [rng.choice((text(rng.randint(0, 30)), rng.choice(shared), shared[2][rng.randint(0, 200) :])) for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice(("", " ", "\n")).join(parts)))
    rows += [(100, None), (101, ""), (102, "abcde" * 200), (103, "x" * 99), (104, "x" * 99), (105, "y" * 100), (106, "y" * 100),
             (107, "y" * 350), (108, shared[2] + "\0" + shared[2]), (109, "\0" * 230), (110, rows[3][1]), (111, rows[4][1] + "!")]
    return rows


def spans_of(spark, rows):
    got = repeats.cut_repeats(spark.createDataFrame(rows, DOCS))
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()}


def test_repeats_match_brute_force(spark):
    rows = repeated_corpus(1)
    random.Random(0).shuffle(rows)
    assert spans_of(spark, rows) == brute_repeats(rows, 100)


def test_repeats_of_hot_groups_by_hash_and_without_filters(spark, monkeypatch):
    rows = repeated_corpus(2)
    monkeypatch.setattr(repeats, "GROUP_MOST", 1)
    monkeypatch.setattr(repeats, "FILTER_MOST", 0)
    assert spans_of(spark, rows) == brute_repeats(rows, 100)


def test_repeats_across_slices(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 64)
    rng = random.Random(4)
    one = "".join(rng.choice("abcdefgh ") for _ in range(900))
    data = np.frombuffer((one + one[150:700]).encode(), np.uint8)
    first, last, at, _ = repeats.minimizers(data)
    windows = [w for a, b in zip(first, last, strict=True) for w in range(a, b + 1)]
    assert windows == list(range(len(data) - 99)) and ((at >= last) & (at <= first + 68)).all()
    assert spans_of(spark, [(1, one + one[150:700])]) == brute_repeats([(1, one + one[150:700])], 100)


def test_repeats_of_repeated_rows_null_ids_and_nothing(spark):
    text = "some words " * 30
    got = repeats.cut_repeats(spark.createDataFrame([(5, text), (5, text), (None, "q" * 150), (7, "q" * 150)], DOCS))
    rows = sorted((r.doc_id or -1, r.n_removed) for r in got.collect())
    assert rows[0][0] == -1 and rows[0][1] > 0 and rows[3] == (7, 150) and rows[1] == rows[2]
    assert repeats.cut_repeats(spark.createDataFrame([], DOCS)).count() == 0


# Decontamination


def test_copies_and_edited_copies_of_items_are_found(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "sh", "l")]
    passage = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, passage(rng.randint(15, 50))) for i in range(12)]
    docs, want = [], set()
    for i in range(120):
        text = passage(rng.randint(30, 150))
        if i % 4 == 0:
            item_id, item = items[i % len(items)]
            copy = list(item)
            for _ in range(len(copy) // 6 if i % 8 else 0):
                copy[rng.randrange(len(copy))] = "edited"
            if i % 16 == 4:
                del copy[len(copy) // 2]
            text[10:10] = copy
            want.add((i, item_id))
        docs.append((i, ", ".join(text).upper() if i % 3 else " ".join(text)))
    docs += [(500, None), (501, ""), (502, "!?"), (None, "nothing here"), (503, " ".join(items[0][1])), (503, " ".join(items[0][1]))]
    want.add((503, 0))
    bench = [(i, " ".join(t)) for i, t in items] + [(90, None), (91, ""), (92, "zzz qqq"), (0, " ".join(items[0][1]))]
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string"))
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    first = next(r for r in rows if r.doc_id == 0)
    assert (first.first_word, first.last_word) == (10, 10 + len(items[0][1])) and first.score == 1.0


def test_items_that_many_documents_hold_edited_are_found(spark):
    item = [f"w{i}" for i in range(40)]
    edited = [("edited" if i % 10 == 5 else w) for i, w in enumerate(item)]
    bench = spark.createDataFrame([(3, " ".join(item))], "item_id long, text string")
    for copies, exact in ((17, 0), (1000, 0), (1000, 3)):
        docs = [(i, f"before {' '.join(edited)} after") for i in range(copies)]
        docs += [(5000 + i, " ".join(item)) for i in range(exact)]
        docs += [(9000 + i, f"in {' '.join(item[:20])} half") for i in range(30)]
        docs += [(9900 + i, f"too {' '.join(item[:12])} little") for i in range(30)]
        got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), bench).collect()
        assert sorted(r.doc_id for r in got) == [i for i, _ in docs if i < 9900]
        # Each edited word costs its match and a mismatch.
        assert {r.score for r in got if r.doc_id < 5000} == {(36 * 2 - 4) / 80}


def test_alignments_are_found_at_their_full_width(spark):
    item = [f"w{i}" for i in range(41)]
    wide = [x for i, w in enumerate(item) for x in ([w] if i < 3 else ["extra", w])]
    docs = [(1, " ".join(wide + ["end"] * 300)), (2, " ".join(["end"] * 300 + wide))]
    bench = spark.createDataFrame([(3, " ".join(item))], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), bench).collect()
    assert {(r.doc_id, r.first_word, r.last_word) for r in got} == {(1, 0, 79), (2, 300, 379)}


def test_decontamination_without_filter_or_items(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "two three"), (3, "four one")], DOCS)
    bench = spark.createDataFrame([(7, "two three four five"), (8, "four one")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "FILTER_SEEDS", 0)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} >= {(1, 7)}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_alignment_is_smith_waterman():
    rng = random.Random(8)
    for _ in range(60):
        a = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        b = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = max(0, table[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == table.max()


# Tokens


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=400) | st.lists(st.integers(0, 50), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_packed_ids_round_trip(ids, start, stop):
    payload = tokens.packed(np.array(ids, np.uint32))
    assert tokens.unpacked(payload).tolist() == ids
    assert tokens.unpacked(payload, start, stop).tolist() == ids[start:stop]


TEXTS = st.text(st.sampled_from("abz éß漢🙂'sT.,;:\n\t  019_<|>-"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_encoder_gives_the_tokenizers_ids(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = test_encoder_gives_the_tokenizers_ids.__dict__.setdefault("tool", Tokenizer.from_file(path))
    assert tokens.encoder(path).ids(text).tolist() == want.encode(text, add_special_tokens=False).ids


@settings(max_examples=120, deadline=None)
@given(st.lists(TEXTS, max_size=12), st.sampled_from((3, 50, 10_000)))
def test_encoder_of_a_batch_gives_the_ids_of_each(texts, remembered):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = test_encoder_gives_the_tokenizers_ids.__dict__.setdefault("tool", Tokenizer.from_file(path))
    before = tokens.REMEMBERED, tokens.CHARACTERS, tokens.TOGETHER
    tokens.REMEMBERED, tokens.CHARACTERS, tokens.TOGETHER = remembered, remembered, 5
    try:
        got = [ids.tolist() for ids in tokens.encoder(path).batch(texts)]
    finally:
        tokens.REMEMBERED, tokens.CHARACTERS, tokens.TOGETHER = before
    assert got == [want.encode(text, add_special_tokens=False).ids for text in texts]


def test_every_letter_is_encoded_as_by_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    texts = [f"{' '.join(letters[i:i + 500])}\n{'. '.join(letters[i:i + 500])} " for i in range(0, len(letters), 500)]
    got = tokens.encoder(path).batch(texts)
    assert all(a.tolist() == want.encode(t, add_special_tokens=False).ids for a, t in zip(got, texts, strict=True))


def test_token_files_hold_all_documents_in_order(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    rows = [(i, f"Text number {i}. " + "word, " * (i % 50)) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "long text <|endoftext|> " * 30_000), (5, "again"), (5, "again"), (None, "first")]
    frame = spark.createDataFrame(rows, DOCS).repartition(7)
    tokens.write_tokens(frame, f"{tmp_path}/ids", path)
    got = sorted(tokens.token_digests(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    start, seen = 0, []
    for r in got:
        assert r.start == start
        start += r.n_tokens
        seen.append((r.doc_id, r.n_tokens, r.ids_crc32))
    order = [-1 if d is None else d for d, _, _ in seen]
    assert order == sorted(order)
    want = []
    for doc_id, text in rows:
        ids = tool.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(repr, seen)) == sorted(map(repr, want))
    whole = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokens.read_tokens(spark, f"{tmp_path}/ids").filter("doc_id = 7").collect()}
    assert whole[7] == tool.encode(rows[7][1], add_special_tokens=False).ids + [0]


def test_token_files_of_nothing(spark, tmp_path):
    tokens.write_tokens(spark.createDataFrame([], DOCS), f"{tmp_path}/none", public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.token_digests(spark, f"{tmp_path}/none").count() == 0


# Pages

STORY = ["A first paragraph, which runs on for a while, as stories do.", "The second one tells more, with a few commas, and ends."]


def page(body, top="", bottom=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{top}{body}{bottom}</body></html>"


def test_article_without_what_surrounds_it():
    paragraphs = f"<p>{STORY[0]}</p>\n<p>{STORY[1].replace('more', '<b>mo</b>re &amp;&nbsp; more')}"
    top = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><header><h1>Site</h1></header><div class=cookie-notice>We use cookies, many of them, all day long.</div>"
    side = "<div class='sidebar'><p>Something about other things, quite long, and not part of it.</p></div>"
    bottom = "<div id=comments><p>A reader says something, rather long as well, but it is a comment.</p></div><footer>&copy; all of it</footer><script>var x='<p>no</p>'</script>"
    want = "\n".join(["Head line", STORY[0], STORY[1].replace("more", "more & more")])
    for container in ("<article>%s</article>", "<main>%s</main>", '<div class="post-17 content">%s</div>', '<div class="layout with-sidebar"><section>%s</section></div>'):
        text = html_text.Page(page(container % f"<h1>Head\n  line</h1>{paragraphs}", top, side + bottom)).text(None)
        assert text == want, container


def test_broken_and_empty_pages():
    read = lambda s: html_text.Page(s).text(None)
    assert read("") == read("<html>") == read("<script>if (a < b) {") == read("<!-- never closed <p>x</p>") == ""
    assert read("just text &lt;b&gt; &#233;") == "just text <b> é"
    assert read(f"<article><p>{STORY[0]}<p>{STORY[1]}<a href='x") == "\n".join(STORY)
    assert read(f"<article><p><b>{STORY[0]}<br><p>{STORY[1]}</article></div></p>") == "\n".join(STORY)
    assert read("a < b and c > d") == "a < b and c > d"
    assert read("<div>" * 3000 + STORY[0]) == STORY[0]


def test_hosts_agree_on_a_path(spark):
    one = '<div class="col-1 box">%s</div><div class="col-2 teaser"><p>%s</p></div>'
    long_teaser = "Advice of the day, which is long on some pages, longer than the text, by chance, even. " * 4
    rows = [(i, "http://www.Example.org:80/%d" % i, page(one % ("".join(f"<p>{s}</p>" for s in STORY * 3), "Short teaser."))) for i in range(6)]
    rows.append((6, "http://www.example.org/6", page(one % (f"<p>{STORY[0]}</p><p>{STORY[1]}</p>", long_teaser))))
    rows += [(7, None, None), (8, "not a url", ""), (None, "http://other.example/", page(f"<p>{STORY[0]}</p>")), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("x", "path")
    got = {r.page_id: r.text for r in html_text.extract(frame).collect()}
    assert got[6] == "\n".join(STORY) and got[0] == "\n".join(STORY * 3)
    assert got[7] == got[8] == "" and got[None] == STORY[0]
    assert html_text.extract(frame.limit(0)).count() == 0 and html_text.extract(frame).count() == len(rows)


# Pipeline


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rng = random.Random(11)
    clean = [f"{a}{b}" for a in "bdfglmnprst" for b in ("ano", "ere", "ilo", "uma", "oti", "esk", "ard")]
    text = lambda n: " ".join(rng.choice(clean) for _ in range(n))
    items = [(i, text(25)) for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        body = text(rng.randint(30, 70))
        if i % 5 == 1:
            body += " vilewort vilewort " + text(5)
        labels.append((i, 1, int(i % 5 == 1)))
        rows.append((i, body))
    rows += [(1000, rows[0][1]), (1001, rows[2][1] + " extra"), (1002, text(20) + " " + items[3][1] + " " + text(9)), (1003, None), (1004, "")]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows] + [(5, rows[5][1], "en", "s2", 0)]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
        assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", "), name
        docs = spark.createDataFrame(docs.collect(), schema)
        kept.append(sorted(r.doc_id for r in docs.collect()))
    toxic = {i for i in range(400) if i % 5 == 1}
    assert kept[0] == sorted(r[0] for r in rows if r[0] not in toxic)
    assert kept[1] == sorted({r[0] for r in rows} - toxic - {1000, 1001})
    assert kept[2] == sorted(set(kept[1]) - {1002})
    end = corpus_pipeline.run(spark, folder)
    assert end.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id for r in end.collect()} <= set(kept[2])


def test_near_copies_are_told_apart_by_id_and_text(spark):
    text = lambda letter: " ".join(f"{letter}{i}" for i in range(30))
    rows = [
        (1, text("a")), (2, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (None, text("e")), (None, text("e") + " more"),
        (None, text("f")), (4, text("f")), (5, text("g")), (5, text("g")), (None, None), (None, ""), (6, ""), (6, ""),
    ]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()
    kept = [(r.doc_id, r.text) for r in got]
    whole = [(1, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (4, text("f")), (5, text("g")), (None, None), (None, ""), (6, ""), (6, "")]
    alone = [r for r in kept if r[0] is None and (r[1] or "").startswith("e0 ")]
    key = lambda r: (str(r[0]), str(r[1]))
    assert len(alone) == 1 and sorted(set(kept) - set(alone), key=key) == sorted(set(whole), key=key)
    assert len(kept) == len(whole) + 1


def test_pipeline_is_the_order_of_its_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "decontamination", "mixing", "tokens"]

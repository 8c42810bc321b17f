"""Main text of pages: pages built from known text, what must stay, and pages that are hard to read."""

import html
import random
import time

import pytest

from gridloom.llm import html_text


def built_page(rng, host):
    """A page of a random make-up with its main text: what a reader must give."""
    word = lambda: "".join(rng.choice("abcdefgéß&<") for _ in range(rng.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + ", " + word() + "."
    shown = lambda text: html.escape(text).replace(" ", rng.choice((" ", "\n ", "\t")))
    lines, body = [], []
    for _ in range(rng.randint(2, 6)):
        kind, text = rng.choice(("p", "p", "h2", "quote", "list", "inline", "table")), sentence(rng.randint(8, 40))
        if kind == "list":
            items = [sentence(3) for _ in range(rng.randint(1, 5))]
            link = rng.random() < 0.5
            body.append("<ul>" + "".join(f"<li><a href='/x'>{shown(t)}</a></li>" if link else f"<li>{shown(t)}" for t in items) + "</ul>")
            lines += items
            continue
        if kind == "inline":
            cut = text.index(" ")
            body.append(f"<p>{shown(text[:cut])} <b>{shown(text[cut + 1:])}</b><script>if (a < b) x('</p>')</script></p>")
        elif kind == "table":
            body.append(f"<table><tr><td>{shown(text)}</td></tr></table>")
        else:
            tag = {"p": "p", "h2": "h2", "quote": "blockquote"}[kind]
            body.append(f"<{tag} class='{rng.choice(('lead', 'search-and-rescue', 'text social-history', 'x'))}'>{shown(text)}</{tag}>")
        lines.append(text)
    noise = [
        f"<nav><ul><li><a href='/'>{sentence(9)}</a></ul></nav>".replace("&<", ""), f"<div class='ad-slot'>{shown(sentence(30))}</div>",
        f"<div id='related-posts'><p>{shown(sentence(30))}</p></div>", f"<!-- {'-' * 9} <p>not this</p> -->",
        f"<section class='userComments'><p>{shown(sentence(30))}</p></section>", f"<form>{shown(sentence(9))}</form>",
        f"<div class='cookie-notice'>{shown(sentence(9))}</div>", f"<aside><p>{shown(sentence(30))}</p></aside>",
    ]
    for piece in rng.sample(noise[1:], 2):
        body.insert(rng.randint(0, len(body)), piece)
    container = {"a": "<article>%s</article>", "b": "<div class='post-%d body-text'>%%s</div>" % rng.randint(1, 99)}[host]
    top, bottom = (rng.sample(noise, rng.randint(0, 3)) for _ in "ab")
    page = f"<html><head><title>T</title></head><body>{''.join(top)}<div>{container % ''.join(body)}</div>{''.join(bottom)}</body></html>"
    return page, "\n".join(lines)


def test_built_pages_give_their_text(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(160):
        host = rng.choice("ab")
        source, want[i] = built_page(rng, host)
        rows.append((i, f"http://{host}.org/{i}", source))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in want if got[i] != want[i]} == {}


def test_two_templates_on_a_host_keep_their_articles(spark):
    text = "A long enough sentence of running text, with a comma and a good many words in it. "
    often = f"<body><div class='lead'><p>{text * 3}</p></div></body>"
    other = f"<body><div class='lead'><p>{text}</p></div><div class='story'>{f'<p>{text * 2}</p>' * 6}</div></body>"
    rows = [(i, "http://h/", often if i else other) for i in range(9)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "\n".join([(text * 2).strip()] * 6) and got[1] == (text * 3).strip()


def test_a_list_of_sources_and_names_that_only_contain_a_word_stay():
    text = "A long enough sentence of running text, with a comma and a good many words in it."
    sources = "".join(f"<li><a href='/{i}'>Source {i}</a>" for i in range(5))
    for name in ("search-and-rescue", "social-history", "adaptation", "header-files-explained"):
        page = f"<article><p>{text}</p><div class='{name}'><p>{text}</p></div><section id='{name}'>{text}</section><ul>{sources}</ul></article>"
        assert html_text.Page(page).text(None) == "\n".join([text] * 3 + [f"Source {i}" for i in range(5)])
    for name in ("ad", "ad-slot-3", "related-posts", "socialShareButtons", "cookie_notice", "comments-area"):
        page = f"<article><p>{text}</p><div class='{name}'><p>{text}</p></div></article>"
        assert html_text.Page(page).text(None) == text


@pytest.mark.parametrize(
    "source",
    ["<a" * 500_000, "<div>" * 200_000, "<p title=\"" * 100_000, "<p \">\" " * 140_000 + "'", "<b>" * 150_000 + "</i>" * 150_000,
     "<span>" * 70_000 + "<div></div>" * 70_000, "<ul>" + "<li>x" * 150_000, "<" * 1_000_000, "<!--" * 250_000, "<![CDATA[" * 100_000,
     "<script>" * 100_000, "<a href='" * 100_000 + ">", "<div>some longer text, with commas and more than enough of it " * 15_000],
    ids=range(13),
)
def test_a_megabyte_of_anything_is_read_in_seconds(source):
    start = time.perf_counter()
    page = html_text.Page(source)
    page.text(page.path(len(page.tag) - 1))
    assert time.perf_counter() - start < 8

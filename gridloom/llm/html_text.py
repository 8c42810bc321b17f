"""Main text of web pages by consensus of a host's pages on where the text is.

Each page's containers are scored by the running text they hold, and the best one votes for its
generalised path: tags and classes from the body down, with digits replaced, so that
``div.post-17`` and ``div.post-4`` agree. Votes are summed per host and path in Spark, the path
with most votes wins its host, and each page is read again with its host's path. A page where that
path is missing, or holds less than ``LEAST_SHARE`` of what its own best container does, uses its
own; ``LEAST_APART`` is enough where the two share no text, as a long advert beside the text would.

Inside a container, elements that are menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or comments by tag, role, class or id are left out. A class or id counts if all its
words say so: ``related-posts`` does, ``search-and-rescue`` does not. Of a header inside an article its
headings stay. Lists of nothing but links are left out only where no container was found.

Pages are read in one pass: what holds for an element's ancestors is kept with it, and no tag is
looked at twice, so the time grows with the length of a page whatever is on it.

Defined results: null and empty pages give an empty text. Pages cut off anywhere are read as far
as they go; an unclosed script, style or comment takes the rest. Without a usable url the host is
the empty text, so such pages vote together. If no container qualifies, all text outside such
elements is taken. Repeated rows each give a row. Columns other than the three are ignored.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_batches, table, written

#: Tags by their role in HTML (fixed).
RAW = {"script", "style", "textarea", "title", "xmp", "noframes", "iframe", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details",
         "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
         "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav",
         "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEFT_OUT = {"head", "nav", "aside", "footer", "form", "menu", "template", "noscript", "svg", "math",
            "object", "applet", "select", "button", "canvas", "audio", "video", "dialog"}
LEFT_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog",
                  "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of class and id names that mark what isn't the article.
LEFT_OUT_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor",
    "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "submenu",
    "breadcrumb", "breadcrumbs", "masthead", "topbar", "header", "footer", "sidebar", "aside", "widget",
    "widgets", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup",
    "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "share",
    "sharing", "social", "comment", "comments", "commentlist", "respond", "disqus", "reply", "replies",
    "related", "recommended", "recommendations", "pagination", "pager", "toolbar", "copyright",
}
HEADER_WORDS = {"header", "masthead", "banner"}
#: Words beside such a word that do not change what it says.
HELPERS = {
    "area", "article", "bar", "block", "bottom", "box", "btn", "button", "buttons", "card", "col", "column", "container",
    "desktop", "div", "entry", "fixed", "form", "group", "holder", "inline", "inner", "item", "items", "js", "left", "link",
    "links", "list", "mobile", "module", "news", "outer", "panel", "policy", "post", "posts", "primary", "right", "row",
    "secondary", "section", "site", "slot", "sticky", "story", "stories", "tab", "the", "title", "toggle", "top", "unit",
    "user", "view", "wrap", "wrapper", "and", "us", "by", "for", "of",
}
NEVER_LEFT_OUT = {"html", "body", "main", "article"}
#: A start tag of one of these ends an open one of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
         "th": {"tr", "table"}, "option": {"select"}}

LONG, LINKED, LEAST_SHARE, LEAST_APART, MENU_ITEMS = 25, 0.5, 0.95, 0.2, 3

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What ends a tag, or starts a quoted value in it.
MARK = re.compile(r"[>\"']")
CUT = re.compile(r"<[/!?a-zA-Z][^<>]*$")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Page:
    """Elements and text blocks of a page, in page order."""

    def __init__(self, source: str) -> None:
        # By element: parent, tag, and the number of its path (tags and classes from the body down).
        self.parent, self.tag, self.path_of = [-1], [""], [0]
        # By element, itself included: left out, in an article, in a header, in a heading; nearest block.
        self.out, self.article, self.header, self.heading, self.holder = [False], [False], [False], [False], [0]
        # By path: that of the parent, and tag with classes.
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self._numbers: dict[tuple[int, str], int] = {}
        # By block: element, text, characters of it in links.
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._links = [0], 0
        # Depths of the open elements by tag, and of the open blocks.
        self._depths: dict[str, list[int]] = {}
        self._open_blocks: list[int] = []
        self._pieces: list[str] = []
        self._linked: list[str] = []
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, start, dead = 0, 0, set()
        last = source.rfind(">")
        while True:
            start = source.find("<", start)
            if start > last:
                # No tag ends after this; an open comment still takes the rest.
                comment = source.find("<!--", start)
                start = comment
            if start < 0:
                rest = source[at:]
                # A tag that the end of the page cuts off isn't text.
                cut = CUT.search(rest)
                self._text(rest[: cut.start()] if cut else rest)
                return
            if source.startswith("<!--", start):
                self._text(source[at:start])
                end = source.find("-->", start + 4)
                if end < 0:
                    return
                at = start = end + 3
                continue
            if source.startswith("<![CDATA[", start):
                self._text(source[at:start])
                at = start = start + 9
                continue
            if source[start + 1 : start + 2] in ("!", "?"):
                self._text(source[at:start])
                at = start = source.find(">", start) + 1
                continue
            tag = TAG.match(source, start)
            if tag is None:
                start += 1
                continue
            self._text(source[at:start])
            end = self._tag_end(source, tag.end(), dead)
            name, attributes = tag[2].lower(), source[tag.end() : end - 1]
            at = start = end
            if tag[1]:
                self._close(name)
            elif name in RAW:
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                if close is None:
                    return
                at = start = source.find(">", close.start()) + 1
                if at == 0:
                    return
            else:
                self._open(name, attributes, attributes.endswith("/") and name not in BLOCK)

    @staticmethod
    def _tag_end(source: str, at: int, dead: set[int]) -> int:
        """The place after the tag; a ``>`` in quotes does not end it, unless a quote is never closed.

        ``dead`` are quotes after which a search found no end; what leads to one has none either.
        """
        first, trail = at, []
        while True:
            mark = MARK.search(source, at)
            if mark is not None and mark[0] == ">":
                return mark.end()
            close = -1
            if mark is not None and mark.start() not in dead:
                trail.append(mark.start())
                close = source.find(mark[0], mark.end())
            if close < 0:
                dead.update(trail)
                return source.find(">", first) + 1
            at = close + 1

    def _text(self, text: str) -> None:
        if text:
            text = entities.unescape(text) if "&" in text else text
            self._pieces.append(text)
            if self._links:
                self._linked.append(text)

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                linked = len(" ".join("".join(self._linked).split()))
                self.blocks.append((self._stack[-1], text, linked))
            self._pieces, self._linked = [], []

    def _open(self, name: str, attributes: str, closed: bool) -> None:
        if name in BLOCK:
            self._flush()
            if name not in VOID:
                self._end_paragraph()
        if name in VOID or closed:
            return
        if name in CLOSES:
            self._end_of(CLOSES[name], KEEPS[name])
        element = len(self.tag)
        parent = self._stack[-1]
        classes, words, hidden = self._names(attributes)
        key = (self.path_of[parent], ".".join([name, *classes]) if classes else name)
        number = self._numbers.setdefault(key, len(self.paths))
        if number == len(self.paths):
            self.paths.append(key)
        self.parent.append(parent)
        self.tag.append(name)
        self.path_of.append(number)
        self.out.append(self.out[parent] or hidden or self._is_left_out(name, words, parent))
        self.article.append(self.article[parent] or name in ("article", "main"))
        self.header.append(self.header[parent] or name == "header")
        self.heading.append(self.heading[parent] or name in HEADINGS)
        self.holder.append(element if name in BLOCK else self.holder[parent])
        self._depths.setdefault(name, []).append(len(self._stack))
        if name in BLOCK:
            self._open_blocks.append(len(self._stack))
        self._stack.append(element)
        self._links += name == "a"

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self._flush()
        if self._depths.get(name):
            self._pop_to(self._depths[name][-1])

    def _pop_to(self, depth: int) -> None:
        for element in reversed(self._stack[depth:]):
            tag = self.tag[element]
            self._depths[tag].pop()
            if tag in BLOCK:
                self._open_blocks.pop()
            self._links -= tag == "a"
        del self._stack[depth:]

    def _end_paragraph(self) -> None:
        """A block ends an open paragraph and what is inside it."""
        if self._open_blocks and self.tag[self._stack[self._open_blocks[-1]]] == "p":
            self._pop_to(self._open_blocks[-1])

    def _end_of(self, tags: set[str], within: set[str]) -> None:
        def deepest(names: set[str]) -> int:
            return max((self._depths[n][-1] for n in names if self._depths.get(n)), default=0)

        depth = deepest(tags)
        if depth > deepest(within):
            self._pop_to(depth)

    @staticmethod
    def _names(attributes: str) -> tuple[list[str], list[list[str]], bool]:
        classes, words, hidden = [], [], False
        if not attributes:
            return classes, words, hidden
        if "=" in attributes or "hidden" in attributes:
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    hidden = hidden or name == "hidden" and m.start() == m.start(1)
                elif name == "role":
                    words.append(["role", value.lower()])
                else:
                    names = value.split()
                    words += [[w.lower() for w in NAME_WORDS.findall(n)] for n in names]
                    if name == "class":
                        classes = sorted({re.sub(r"\d+|>", "#", n) for n in names})
        return classes, words, hidden

    def _is_left_out(self, name: str, words: list[list[str]], parent: int) -> bool:
        if name in NEVER_LEFT_OUT:
            return False
        if name in LEFT_OUT or name == "header" and not self.article[parent]:
            return True
        for parts in words:
            if parts[:1] == ["role"]:
                if len(parts) > 1 and parts[1] in LEFT_OUT_ROLES:
                    return True
                continue
            bad = {w for w in parts if w in LEFT_OUT_WORDS}
            others = {w for w in parts if not w.isdigit()} - bad
            if bad and others <= HELPERS:
                return not (bad <= HEADER_WORDS and self.article[parent])
        return False

    def path(self, element: int) -> str:
        keys, number = [], self.path_of[element]
        while number > 0:
            number, key = self.paths[number]
            keys.append(key)
        return ">".join(reversed(keys))

    def texts(self, containers: set[int] | None) -> list[str]:
        """Blocks in one of ``containers`` (None: anywhere) that no element left out holds."""
        held = [containers is None]
        lists = self._link_lists() if containers is None else set()
        listed = [False]
        for e in range(1, len(self.tag)):
            held.append(held[self.parent[e]] or (containers is not None and e in containers))
            listed.append(listed[self.parent[e]] or e in lists)
        return [
            text for e, text, _ in self.blocks
            # Of a header in an article only headings are part of it.
            if held[e] and not self.out[e] and not listed[e] and (self.heading[e] or not self.header[e])
        ]

    def _link_lists(self) -> set[int]:
        counts = [[0, 0, 0] for _ in self.tag]
        for e, text, linked in self.blocks:
            count = counts[e]
            count[0], count[1], count[2] = count[0] + 1, count[1] + len(text), count[2] + linked
        for e in range(len(self.tag) - 1, 0, -1):
            above = counts[self.parent[e]]
            for i, n in enumerate(counts[e]):
                above[i] += n
        return {
            e for e, (n, chars, linked) in enumerate(counts)
            if self.tag[e] in ("ul", "ol") and n >= MENU_ITEMS and linked >= 0.9 * chars
        }

    def best(self) -> tuple[int, float] | None:
        """The container with most running text, and its score."""
        scores: dict[int, float] = {}
        for element, text, linked in self.blocks:
            if len(text) < LONG or linked > LINKED * len(text) or self.out[element]:
                continue
            value = 1 + min(text.count(","), 5) + min(len(text) / 100, 5)
            # The paragraph itself is no container; what holds it is, and half as much the next.
            holder = self.holder[element]
            if self.tag[holder] not in ("div", "article", "section", "main", "body", "td"):
                holder = self.holder[max(self.parent[holder], 0)]
            for part in (1.0, 0.5):
                if holder > 0:
                    scores[holder] = scores.get(holder, 0.0) + value * part
                    holder = self.holder[self.parent[holder]]
        if not scores:
            return None
        top = max(scores, key=lambda e: (scores[e], -e))
        for wanted in ("article", "main"):
            e = top
            while e > 0:
                if self.tag[e] == wanted:
                    return e, scores[top]
                e = self.parent[e]
        return top, scores[top]

    def text(self, path: str | None) -> str:
        found = self.best()
        own = self.texts(self._on_path(self.path_of[found[0]])) if found else self.texts(None)
        voted = self._same(path) if path else set()
        if voted:
            lines = self.texts(voted)
            # A path that is part of the page's own may lose some of its text; one beside it has another.
            least = LEAST_APART if set(lines).isdisjoint(own) else LEAST_SHARE
            if sum(map(len, lines)) >= least * sum(map(len, own)):
                return "\n".join(lines)
        return "\n".join(own)

    def _on_path(self, number: int) -> set[int]:
        return {e for e, n in enumerate(self.path_of) if n == number and e > 0}

    def _same(self, path: str) -> set[int]:
        """Elements on a path given as text."""
        number = 0
        for key in path.split(">"):
            number = self._numbers.get((number, key), -1)
            if number < 0:
                return set()
        return self._on_path(number)


def host_of(url):
    host = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(host, F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, score of each page's best container."""

    def vote(columns: dict[str, list]) -> dict[str, list]:
        out = {"host": [], "path": [], "score": []}
        for host, source in zip(columns["host"], columns["html"], strict=True):
            page = Page(source or "")
            found = page.best()
            if found:
                out["host"].append(host)
                out["path"].append(page.path(found[0]))
                out["score"].append(found[1])
        return out

    return map_batches(pages.select("host", "html"), vote, "host string, path string, score double")


def winners(votes: DataFrame) -> DataFrame:
    """host and the path with most votes; ties go to the higher score, then to the later path."""
    return (
        votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("score"))
        .groupBy("host").agg(F.max(F.struct("n", "score", "path")).alias("best"))
        .select("host", F.col("best.path").alias("path"))
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of ``pages`` (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))

    def read(columns: dict[str, list]) -> dict[str, list]:
        texts = [Page(s or "").text(p) for s, p in zip(columns["html"], columns["path"], strict=True)]
        return {"page_id": columns["page_id"], "url": columns["url"], "text": texts}

    # Written, so that Spark knows its size: a small table of hosts needs no shuffle of the pages.
    chosen = written(winners(votes(pages)), "winners")
    return map_batches(
        pages.join(chosen, "host", "left").select("page_id", "url", "html", "path"),
        read, "page_id long, url string, text string",
    )


def op10_main_text(spark, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))

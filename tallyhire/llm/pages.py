"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host, path and id, so a page's nearest URLs are its neighbours.  Every page is read into text lines, one
per block element, furniture and all.  The lines of a page and of either neighbour of the same host are aligned by longest
common subsequence, and lines they share are deleted: a site's furniture repeats, its text does not.

The page's own elements then check the outcome, since furniture also holds lines of one page alone, and articles repeat as
copies and quoted passages.  Lines below an element that its name, role or class marks as menu, header, footer, sidebar,
notice, advert, form or reader comments go whether shared or not.  Lines inside an ``article`` or ``main`` element stay whether
shared or not.  All others are the alignment's to decide, on pages with an article too: a story in plain blocks beside a
teaser stays, the site's blocks around it go.  A neighbour that shares every line but marked ones is a copy of the page and
says nothing about it; a page about which no neighbour says anything consists of its article, if it has one.

Pages are dealt out by ranges of the sort order, so a host with most of the pages is spread over tasks; at the edge of a range
a page has one neighbour.  A task holds three pages at a time.

Cases: a null or empty html gives an empty text; repeated rows are neighbours and give equal texts; a null url sorts first,
under an empty host; unclosed and truncated markup is read as far as it goes; page_id, url and html only are read; an empty
table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyhire.llm.common import slices

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Text of these is never read; some hold characters that look like tags.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object"}
#: Those of them that may be empty or never closed; a page goes on behind such a one.
EMBEDDED = {"noscript", "iframe", "svg", "math", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section",
    "select", "summary", "table", "tbody", "tfoot", "thead", "title", "tr", "ul",
}
CELLS = {"td", "th"}
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
FURNITURE = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "search"}
#: Furniture only outside of an article; inside it holds the article's own heading.
PAGE_FURNITURE = {"header"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
MARKS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "ad", "ads", "advert",
    "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments",
    "commentlist", "disqus", "reply", "replies", "respond", "pagination", "pager", "toolbar", "widget", "masthead", "skip",
}
PAGE_MARKS = {"header", "topbar"}
CONTENT = {"article", "main"}

#: text, inside an article, below a marked element
Line = tuple[str, bool, bool]


def _attributes(rest: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)}


def _marked(name: str, rest: str, inside: bool) -> bool:
    if name in FURNITURE or name in PAGE_FURNITURE and not inside:
        return True
    if not rest.strip(" /\t\r\n"):
        return False
    found = _attributes(rest)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return True
    words = set(re.findall(r"[a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
    return bool(words & MARKS) or not inside and bool(words & PAGE_MARKS)


def lines(html: str) -> list[Line]:
    """The text lines of a page in order, each with whether it stands inside an article and whether an element marks it.

    The stack holds (name, inside an article, marked).  An article inside a marked element starts afresh, so an element
    that was never closed cannot swallow it; an article that is marked itself, as a reader's comment is, is no article.
    """
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    text: list[str] = []
    unclosed: set[str] = set()

    def close_line() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                out.append((line, *stack[-1][1:]))
            text.clear()

    at = 0
    while True:
        found = MARKUP.search(html, at)
        text.append(html[at:found.start() if found else len(html)])
        if not found:
            break
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        end, rest = bool(found["end"] or found["end2"]), found["rest"] or found["rest2"] or ""
        if name in BLOCK:
            close_line()
        elif name in CELLS:
            text.append(" ")
        if end:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close_line()
                    del stack[depth:]
                    break
            continue
        if name in RAW:
            if name in EMBEDDED and rest.rstrip().endswith("/"):
                continue
            over = None if name in unclosed else re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(html, at)
            if not over and name in EMBEDDED:
                unclosed.add(name)  # nor will a later one be closed
                continue
            at = over.end() if over else len(html)
            continue
        if name in VOID or rest.rstrip().endswith("/") and name not in BLOCK:
            continue
        if name in CLOSED_BY.get(stack[-1][0], ()):
            stack.pop()
        _, inside, marked = stack[-1]
        marks = _marked(name, rest, inside)
        if name in CONTENT and not marks:
            close_line()
            stack.append((name, True, False))
        elif name in BLOCK or name in CELLS or marks:
            if marks:
                close_line()
            stack.append((name, inside, marked or marks))
    close_line()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places of ``a`` on a longest common subsequence with ``b``: bit-parallel rows, walked back."""
    common = set(a) & set(b)
    if not common:
        return set()
    places, b = [i for i, x in enumerate(a) if x in common], [x for x in b if x in common]
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for i in places:
        match = row & where[a[i]]
        row = (row + match | row - match) & full
        rows.append(row)
    # a zero bit of a row is a step of the length along b
    out, j = set(), len(b)
    for k in range(len(places), 0, -1):
        length = lambda r, stop: stop - (r & ((1 << stop) - 1)).bit_count()
        while j and length(rows[k], j - 1) == length(rows[k], j):
            j -= 1
        if j and length(rows[k - 1], j) < length(rows[k], j):
            out.add(places[k - 1])
            j -= 1
    return out


def differenced(own: list[Line], neighbours: list[list[Line]]) -> list[str]:
    """The lines of a page without those it shares with a neighbour, after the checks that the module states."""
    texts = [text for text, _, _ in own]
    plain = {i for i, (_, _, marked) in enumerate(own) if not marked}
    gone: set[int] = set()
    told = False
    for other in neighbours:
        same = shared(texts, [text for text, _, _ in other])
        if not plain <= same:
            gone |= same
            told = True
    article = {i for i in plain if own[i][1]}
    return [texts[i] for i in sorted(article | plain - gone if told else article or plain)]


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    kind = pages.select("page_id", "url").schema
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in slices(batches):
                for page_id, url, html, host in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    yield page_id, url, host, lines(html)

        def texts():
            """Each page once its follower is known."""
            before = now = None
            for after in _ended(rows()):
                if now:
                    yield now[0], now[1], "\n".join(differenced(
                        now[3], [p[3] for p in (before, after) if p and p[2] == now[2]]))
                before, now = now, after

        done: list[tuple] = []
        for row in texts():
            done.append((*row, len(row[2])))
            if len(done) >= 512:
                yield packed(done)
                done = []
        if done:
            yield packed(done)

    def packed(done: list[tuple]) -> pa.RecordBatch:
        page_id, url, text, n = zip(*done)
        return pa.RecordBatch.from_arrays(
            [pa.array(page_id), pa.array(url, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int64())], names=names)

    url = F.coalesce("url", F.lit(""))
    keyed = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][-A-Za-z0-9+.]*://([^/?#]*)", 1)).alias("_host"),
        F.regexp_extract(url, r"^(?:[A-Za-z][-A-Za-z0-9+.]*://[^/?#]*)?([^?#]*)", 1).alias("_path"))
    order = ["_host", "_path", "page_id", "url"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("page_id", "url", "html", "_host").mapInArrow(
        run, kind.add("text", "string").add("n_chars", "long"))


def _ended(rows: Iterator[tuple]) -> Iterator[tuple | None]:
    yield from rows
    yield None

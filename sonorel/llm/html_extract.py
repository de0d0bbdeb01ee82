"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element starts a new line; lines inside elements that never hold the
article (menus, forms, scripts, comments, ...) are left out. Text lengths, less those of links, are summed
over sliding windows of lines. The text surges where a window's sum rises over a threshold, and dives where
it falls to nothing; what lies between is one stretch, with the short lines that lead up to the surge. The threshold
falls until some text is found, so short pages keep their text.

What the page says of itself weighs lines, on every page in the same way: in ``article`` and ``main`` elements links
count as text, a stretch ends at their edges, and its length counts ``MARKED`` times. If the weightiest stretch is
marked, the marked ones are the article; else the marks are of teasers or the like, and every stretch that surges is
kept. On such a page the innermost element with four fifths of the kept text is the article's place: lines of a stretch outside it
have to surge by themselves, or be headings. And a stretch that doesn't surge is kept if it lies in the same element as one that
does, and is mostly whole sentences or has a heading: the last words behind a list of links, the lead before it. Such elements count inside a form too, and ``main`` inside an element left out for its class. A page without any
text takes the articles inside such elements, or what a form holds.

Defined results: null, empty and text-free pages give an empty string and length 0; markup that is cut off
or never closed is read as far as it goes; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window.
WINDOW = 3
#: Characters that a window needs to start a surge; the later ones serve pages with less text.
THRESHOLDS = (120, 60, 20, 1)
#: How many times the length of a stretch in an article or main element counts.
MARKED = 3

#: Share of the kept text that the article's place holds.
PLACE = 0.8

#: A whole sentence of three words or more, and words of notices that are no sentence of an article.
_SENTENCE = re.compile(r"\S+\s+\S+\s.*[.!?\u2026\u3002]['\")\]\u00bb\u201d\u2019]*\Z", re.S)
_NOTICE = re.compile(r"\u00a9|\(c\)\s|copyright|all rights reserved|cookies?\b|newsletter|subscribe|sign up|log ?in\b|advertis|sponsored|privacy policy|terms of (?:use|service)|share this|follow us", re.I)

_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_LOOSE_TAG = re.compile(r"</?[a-zA-Z][^<>]*+(?:>|\Z)")
#: Tags whose quotes never end on a page before quotes lose their meaning in it: each costs a look at the rest of the page.
UNENDED = 16
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+|["'=/]""")
_SPACE = re.compile(r"\s+")

RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes", "object", "canvas"}
BOILERPLATE = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "fieldset", "label", "input", "map", "audio", "video", "datalist", "dir", "frameset"}
HEADER = "header"
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "frame", "keygen"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr"}
HEADINGS = {"h1", "h2"}
#: Block elements that are lines, or lists and tables of lines, of the element around them.
LINES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "pre", "blockquote", "figure", "figcaption", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "br", "hr", "address"}
ENDS_P = {"p", "div", "ul", "ol", "table", "section", "article", "main", "aside", "header", "footer", "nav", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "hr", "dl", "fieldset", "address", "details"}

#: Class and id tokens that mark an element as no part of the article: words that may begin or end a longer token
#: (site-nav, comments-area), and words that count as whole tokens only.
_NOUNS = (
    r"ads?|adverts?|advertis\w+|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|subscri\w*|sign-?up|login|popup|modal|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|widget\w*|"
    r"related|recommend\w*|sharing|share|social|footer|masthead|topbar|toolbar|pagination|pager|comments?|commentlist|respond|replies|discussion|disqus\w*|feedback|copyright|disclaimer|skip\w*|notice|notification|alert"
)
_AWAY = re.compile(
    rf"(?:{_NOUNS})(?:[_-]\S*)?|\S+[_-](?:{_NOUNS})|overlay|side|foot|site-?header|page-?header|search(?:[_-]?(?:form|box|bar|results?))?|form|\S+[_-]form|tags?|tag-?(?:clouds?|lists?|links?|box)|toc|legal|hidden|visually-hidden|print",
    re.I,
)
#: Classes that say what a page or a wrapper has or how it is laid out, or what a post is about, not what the element is.
_ABOUT = re.compile(r"(?:has|with|without|no|is|hide|show)[_-](?!print)\S+|side-by-side|content-sidebar\S*|(?:comments?|pings?)-(?:open|closed)|(?:tag|category)-(?!clouds?$|lists?$|links?$|box$|menu$|wrap)\S+", re.I)
#: Beside one of these, sticky-nav and the like tell how the wrapper behaves.
_WRAPPER = {"wrapper", "wrap", "page", "layout", "container", "site"}
_AWAY_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
_MAIN_WORD = re.compile(r"(?:^|[\s_-])(?:article-?body|entry-content|post-content|article-content|main-content|story-body|post-body)(?:$|[\s_-])", re.I)


FORM, CLASS, PART = 1, 2, 3


@dataclass
class Line:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    away: int = 0  # the strongest mark around it: 0 none, FORM, CLASS or PART
    main: bool = False
    box: int = 0  # the element around it that is more than a line
    head: bool = False

    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.parts)).strip()


def _attributes(tag: str) -> dict[str, str]:
    """Attributes of a start tag, the first of each name, in one pass: what a value holds is no attribute."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag, _NAME.match(tag).end(), len(tag) - tag.endswith(">")):
        if m[1]:
            out.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    return out


def _marked(words: str) -> bool:
    """Whether classes and ids say that an element is no part of the article."""
    tokens = [x for x in words.split() if not _ABOUT.fullmatch(x)]
    if _WRAPPER.intersection(x.lower() for x in tokens):
        tokens = [x for x in tokens if not x.lower().startswith("sticky-")]
    return any(map(_AWAY.fullmatch, tokens))


def marks(page: str):
    """(from, to) of every tag, comment and declaration, in time linear in the page."""
    at, unended = 0, 0
    while (at := page.find("<", at)) >= 0:
        m = _OTHER.match(page, at)
        if m is None and unended < UNENDED and _NAME.match(page, at):
            m = _TAG.match(page, at)
            unended += m is None
        if m is None and (m := _LOOSE_TAG.match(page, at)) is None:
            at += 1
            continue
        # what is sent back is where to go on
        at = (yield m.start(), m.end()) or m.end()


def lines_of(page: str) -> tuple[list[Line], list[int]]:
    """The page's text as lines, one a block, and the parent of every box, each of which comes behind its parent; references are
    decoded after the markup is off."""
    out, line, parents = [], Line(), [-1]
    open_: list[tuple[str, tuple[int, int, int, int, int]]] = []  # name, and what held around it
    places: dict[str, list[int]] = {}  # of each name in open_
    blocks: list[int] = []  # places of those not inline
    links = away = main = box = head = 0

    def cut():
        nonlocal line
        if line.parts:
            out.append(line)
        line = Line()

    def close(k: int):
        nonlocal away, main, links, box, head
        away, main, links, box, head = open_[k][1]
        for n, _ in open_[k:]:
            places[n].pop()
        del open_[k:]
        while blocks and blocks[-1] >= k:
            blocks.pop()

    def text(s: str):
        if s:
            s = html.unescape(s)
            line.parts.append(s)
            line.away, line.main, line.box, line.head = away, main > 0, box, head > 0
            if links:
                line.linked += len(s.strip())

    at, skip, found = 0, None, marks(page)
    while True:
        try:
            start, end = found.send(skip)
        except StopIteration:
            text(page[at:])
            break
        skip = None
        text(page[at:start])
        at, tag = end, page[start:end]
        if not (name := _NAME.match(tag)):
            continue
        name = name[1].lower()
        if tag.startswith("</"):
            if name not in INLINE:
                cut()
            if places.get(name) and not (name in INLINE and blocks and blocks[-1] > places[name][-1]):
                close(places[name][-1])
            continue
        if name in RAW:
            if not tag.endswith("/>"):
                m = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = skip = m.end() if m else len(page)
            continue
        if name not in INLINE:
            cut()
        if name in ENDS_P and blocks and open_[blocks[-1]][0] == "p":  # a paragraph can't hold a block
            close(blocks[-1])
        if name in VOID or tag.endswith("/>"):
            continue
        a = _attributes(tag)
        words = f"{a.get('class', '')} {a.get('id', '')}".strip()
        is_main = name in MAIN or a.get("role", "").lower() == "main" or a.get("itemprop", "") == "articleBody" or bool(words and _MAIN_WORD.search(words))
        role = a.get("role", "").lower()
        hidden = a.get("aria-hidden", "").lower() == "true" or "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower()
        places.setdefault(name, []).append(len(open_))
        if name not in INLINE:
            blocks.append(len(open_))
        open_.append((name, (away, main, links, box, head)))
        if name not in INLINE and name not in LINES:
            parents.append(box)
            box = len(parents) - 1
        head += name in HEADINGS
        if is_main and away <= (CLASS if name == "main" or role == "main" else FORM):
            away = 0  # the text begins here, whatever wraps it
        if hidden or name in BOILERPLATE - {"form"} or (name == HEADER and not main) or role in _AWAY_ROLE:
            away = PART
        elif words and name not in ("html", "body") and not is_main and _marked(words):
            away = max(away, CLASS)
        elif name == "form":
            away = max(away, FORM)
        main += is_main
        links += name == "a"
    cut()
    return out, parents


def stretches(sizes: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, largest window sum) of what lies between two dives, the short lines before a surge too."""
    n, out, at = len(sizes), [], 0
    sums = [sum(sizes[i : i + WINDOW]) for i in range(n)]
    while at < n:
        end = at
        if sizes[at]:
            while end < n and sums[end]:  # the window at the dive holds no text
                end += 1
            out.append((at, end, max(sums[at:end])))
        at = max(end, at + 1)
    return out


def told(text: str, head: bool) -> int:
    """How many of a line's characters tell that it is of an article: all of a sentence that is no notice. A heading
    counts so often that it decides for the lines around it."""
    return len(text) * 10**6 if head else len(text) if _SENTENCE.match(text) and not _NOTICE.search(text) else 0


def placed(keep: list[bool], sizes: list[int], boxes: list[int], parents: list[int]) -> list[bool]:
    """Whether each line lies in the innermost box that holds ``PLACE`` of the kept text."""
    weight = [0] * len(parents)
    for k, n, b in zip(keep, sizes, boxes, strict=True):
        weight[b] += n * k
    for b in range(len(parents) - 1, 0, -1):
        weight[parents[b]] += weight[b]
    # the boxes that hold so much lie in one another; the last one that was opened is the innermost
    place = max(b for b, w in enumerate(weight) if w >= PLACE * weight[0])
    inside = [False] * len(parents)
    for b in range(len(parents)):
        inside[b] = b == place or (b > 0 and inside[parents[b]])
    return [inside[b] for b in boxes]


def homes(boxes: list[int], parents: list[int]) -> list[int]:
    """The innermost box of each line that holds another line too: an element around one line is only that line."""
    count = [0] * len(parents)
    for b in boxes:
        count[b] += 1
    for b in range(len(parents) - 1, 0, -1):
        count[parents[b]] += count[b]
    home = list(range(len(parents)))
    for b in range(1, len(parents)):
        if count[b] < 2:
            home[b] = home[parents[b]]
    return [home[b] for b in boxes]


def chosen(lines: list[tuple[bool, int, int, int]], parents: list[int], tells: Callable[[int], int]) -> list[bool]:
    """Which lines (marked as article, length, length of links, box) are the main text; ``tells`` says what tells that a line is of
    an article, and is asked only where windows don't decide."""
    found = []  # marked, from, to, surge, weight
    at = 0
    for marked, group in groupby(lines, key=lambda x: x[0]):
        sizes = [n if marked else max(0, n - linked) for _, n, linked, *_ in group]
        for a, b, surge in stretches(sizes):
            found.append((marked, at + a, at + b, surge, sum(sizes[a:b]) * (MARKED if marked else 1)))
        at += len(sizes)
    keep = [False] * len(lines)
    if not found:
        return keep
    only_marked = max(found, key=lambda f: f[4])[0]
    most = max(f[3] for f in found)
    least = next(t for t in THRESHOLDS if most >= t)
    for marked, a, b, surge, _ in found:
        if marked if only_marked else surge >= least:
            keep[a:b] = [True] * (b - a)
    if only_marked:
        return keep
    sizes = [n if marked else max(0, n - linked) for marked, n, linked, *_ in lines]
    boxes = homes([x[3] for x in lines], parents)
    surging = {b for b, k in zip(boxes, keep, strict=True) if k}
    inside = placed(keep, sizes, boxes, parents)
    for _, a, b, surge, weight in found:
        if surge < least:
            if surging.issuperset(boxes[a:b]) and 2 * sum(map(tells, range(a, b))) >= sum(sizes[a:b]):
                keep[a:b] = [True] * (b - a)
            continue
        for within, run in groupby(range(a, b), key=inside.__getitem__):
            run = list(run)
            alone = [sizes[i] for i in run]
            if not within and max((f[2] for f in stretches(alone)), default=0) < least:
                for i in run:
                    keep[i] = tells(i) > lines[i][1]  # headings
    return keep


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    lines, parents = lines_of(page)
    lines = [(x, x.text()) for x in lines]
    lines = [(x, t) for x, t in lines if t]
    for main, most in ((False, 0), (True, CLASS), (False, FORM)):  # a page that would be empty takes what a form or a class hides
        some = [(x, t) for x, t in lines if x.away <= most and (x.main or not main)]  # the others neither fill a window nor make a dive
        keep = chosen([(x.main, len(t), x.linked, x.box) for x, t in some], parents, lambda i: told(some[i][1], some[i][0].head))  # noqa: B023
        if any(keep):
            return " ".join(t for (_, t), k in zip(some, keep, strict=True) if k)
    return ""


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html)."""

    def run(batches):
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, SCHEMA)

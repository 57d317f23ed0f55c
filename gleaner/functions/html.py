"""Text of HTML pages: visible text in lines, and a page's main text by readability.

Readability here is a score of elements: paragraphs earn points by length and commas, pass them to what is around them, and
lose them where text is links. Class and id words, and what an element is, count too. The best element is the main text,
with those beside it that read like a part of it.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Elements whose text doesn't show, that begin a line, that hold no main text, and that hold nothing.
_HIDDEN = {"script", "style", "head", "title", "template", "noscript"}
_BLOCKS = {"p", "div", "li", "ul", "ol", "br", "tr", "table", "article", "main", "section", "nav", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "dl", "dt", "dd", "address", "figcaption"}
_ASIDE = {"nav", "footer", "aside", "form", "button", "select"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "source", "area", "base", "col", "embed", "track", "wbr"}
# Words of classes, ids and roles that are never text, seldom text, or text after all; and that speak for or against it.
_NEVER = {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "cookie", "cookies", "banner", "popup", "hidden"}
_SELDOM = {"breadcrumb", "breadcrumbs", "comment", "comments", "community", "disqus", "extra", "footer", "header", "legends", "menu", "menubar", "navigation", "nav", "navbar", "pager", "pagination", "promo", "related", "remark", "replies", "rss", "share", "shoutbox", "sidebar", "skyscraper", "social", "supplemental", "toolbar", "widget"}
_AFTER_ALL = {"article", "body", "column", "content", "main", "post"}
_FOR = {"article", "blog", "body", "content", "description", "entry", "hentry", "job", "main", "page", "post", "posting", "story", "text"}
_AGAINST = {"com", "combx", "contact", "footnote", "foot", "gdpr", "hid", "masthead", "media", "meta", "modal", "outbrain", "scroll", "shopping", "tags", "tool"} | _SELDOM
# Points of an element by its kind, by a word of its class or id; the least paragraph, and what is enough text.
_POINTS = {"div": 5, "article": 25, "main": 25, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys(("address", "ol", "ul", "dl", "dd", "dt", "li"), -3) | dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "th"), -5)
_WORD_POINTS, _LEAST, _ENOUGH, _LEVELS = 25, 25, 500, 5
_LISTS = {"div", "ol", "section", "table", "ul"}
_PARAGRAPHS = {"p", "td", "pre", "section", "h2", "h3", "h4", "h5", "h6"}


class _Reader(HTMLParser):
    """Pieces of a page's text, its title, and its elements in document order: kind, place of what is around it, first
    and last piece, words of class, id and role, and whether it is said not to show."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.title, self.in_title = [], 0, [], False
        self.open: list[int] = []
        self.counts: dict[str, int] = {}
        self.tags, self.up, self.first, self.last, self.words, self.unseen = ["body"], [-1], [0], [0], [frozenset()], [False]

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN
        self.in_title = self.in_title or tag == "title"
        if tag in _BLOCKS:
            if tag != "br" and self.counts.get("p"):
                self._close("p")  # a paragraph ends where another block begins
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" ")  # cells of a row are words of one line
        if tag in _VOID:
            return
        a = dict(attrs)
        said = " ".join(a.get(k) or "" for k in ("class", "id", "role")).lower()
        self.up.append(self.open[-1] if self.open else 0)
        self.open.append(len(self.tags))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.tags.append(tag)
        self.first.append(len(self.out))
        self.last.append(-1)
        self.words.append(frozenset(re.split(r"[^a-z]+", said)))
        self.unseen.append("hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style") or "")))

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag == "title":
            self.in_title = False
        if tag in _BLOCKS:
            self.out.append("\n")
        if self.counts.get(tag):
            self._close(tag)

    def _close(self, tag):
        """Ends the innermost element of this kind; those in it that were never closed end with it."""
        done = None
        while done != tag:
            i = self.open.pop()
            done = self.tags[i]
            self.counts[done] -= 1
            self.last[i] = len(self.out)

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not self.hidden:
            self.out.append(data)

    def finish(self, html: str) -> _Reader:
        self.feed(html)
        self.close()
        for i in (0, *self.open):
            self.last[i] = len(self.out)
        return self


def _lines(parts: list[str]) -> str:
    lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


class _Scored:
    """One look at a page: which pieces stay, and the points of its elements. Strict: elements whose words seldom
    belong to a text go first. Weighed: words of classes and ids count."""

    def __init__(self, r: _Reader, strict: bool, weighed: bool):
        self.r, n = r, len(r.tags)
        inside = [False] * n  # in an article or main: a header there is a part of it
        for i in range(1, n):
            inside[i] = inside[r.up[i]] or r.tags[r.up[i]] in ("article", "main")
        self.gone = [self._goes(i, inside[i], strict) for i in range(n)]
        for i in range(1, n):
            self.gone[i] = self.gone[i] or self.gone[r.up[i]]
        dead, links = self._over(self.gone), self._over([t == "a" for t in r.tags])
        sizes = [0 if d else len(" ".join(x.split())) for x, d in zip(r.out, dead, strict=True)]
        self.kept = [not d for d in dead]
        self.chars = list(accumulate(sizes, initial=0))
        self.linked = list(accumulate((s if a else 0 for s, a in zip(sizes, links, strict=True)), initial=0))
        self.commas = list(accumulate((0 if d else x.count(",") + x.count("、") + x.count("，") for x, d in zip(r.out, dead, strict=True)), initial=0))
        blocks = [False] * n  # has a block in it
        for i in range(n - 1, 0, -1):
            blocks[r.up[i]] = blocks[r.up[i]] or blocks[i] or r.tags[i] in _BLOCKS
        self.paragraph = [t in _PARAGRAPHS or (t == "div" and not b) for t, b in zip(r.tags, blocks, strict=True)]
        self.points = self._points(weighed)

    def _goes(self, i: int, inside: bool, strict: bool) -> bool:
        t, words = self.r.tags[i], self.r.words[i]
        if t in ("body", "html", "article", "main", "a"):
            return False
        if t in _ASIDE or self.r.unseen[i] or words & _NEVER or (t == "header" and not inside):
            return True
        return strict and bool(words & _SELDOM) and not words & _AFTER_ALL

    def _over(self, chosen: list[bool]) -> list[bool]:
        """Whether each piece lies in one of the chosen elements."""
        edges = [0] * (len(self.r.out) + 1)
        for c, a, b in zip(chosen, self.r.first, self.r.last, strict=True):
            if c:
                edges[a] += 1
                edges[b] -= 1
        return [d > 0 for d in accumulate(edges[:-1])]

    def size(self, i: int) -> int:
        return self.chars[self.r.last[i]] - self.chars[self.r.first[i]]

    def density(self, i: int) -> float:
        return (self.linked[self.r.last[i]] - self.linked[self.r.first[i]]) / max(1, self.size(i))

    def _points(self, weighed: bool) -> dict[int, float]:
        points: dict[int, float] = {}
        r = self.r
        for i, is_one in enumerate(self.paragraph):
            if not is_one or self.gone[i] or self.size(i) < _LEAST:
                continue
            own = 1 + self.commas[r.last[i]] - self.commas[r.first[i]] + min(self.size(i) // 100, 3)
            at = r.up[i]
            for level in range(_LEVELS):
                if at < 0:
                    break
                if at not in points:
                    words = r.words[at] if weighed else frozenset()
                    points[at] = _POINTS.get(r.tags[at], 0) + _WORD_POINTS * (bool(words & _FOR) - bool(words & _AGAINST))
                points[at] += own / (1 if level == 0 else 2 if level == 1 else 3 * level)
                at = r.up[at]
        return {i: p * (1 - self.density(i)) for i, p in points.items() if not self.gone[i]}

    def text(self) -> str | None:
        """None where no element has points."""
        r, points = self.r, self.points
        if not points:
            return None
        top = max(points, key=lambda i: (points[i], -i))
        while (up := r.up[top]) > 0 and points.get(up, 0) > points[top]:
            top = up
        best, words, chosen = points[top], r.words[top] - {""}, {top}
        chosen |= {i for i, up in enumerate(r.up) if up == r.up[top] and i != top and not self.gone[i] and self._belongs(i, best, words)}
        links = self._over([t in _LISTS and i not in chosen and self.density(i) > 0.5 for i, t in enumerate(r.tags)])
        kept = [k and not x for k, x in zip(self.kept, links, strict=True)]
        return _lines([x for i in sorted(chosen) for x, k in zip(["\n", *r.out[r.first[i] : r.last[i]]], [True, *kept[r.first[i] : r.last[i]]], strict=True) if k])

    def _belongs(self, i: int, best: float, words: frozenset) -> bool:
        alike = 0.2 * best if words and words == self.r.words[i] - {""} else 0
        if self.points.get(i, 0) + alike >= max(10, 0.2 * best) and i in self.points:
            return True
        if not self.paragraph[i]:
            return False
        size, density = self.size(i), self.density(i)
        if size > 80:
            return density < 0.25
        end = "".join(x for x, k in zip(self.r.out[self.r.first[i] : self.r.last[i]], self.kept[self.r.first[i] : self.r.last[i]], strict=True) if k).rstrip()[-1:]
        return size > 0 and density == 0 and end == "."


def _main(r: _Reader) -> str:
    """The text of the best element and of those beside it that belong to it, without lists that are links for the most
    part. Where that is short, seldom words are let in, then words are not weighed at all, if that gives over twice the
    text. A page without paragraphs gives its longest article or main element, else all that isn't aside."""
    found = ""
    for strict, weighed in ((True, True), (False, True), (False, False)):
        s = _Scored(r, strict, weighed)
        text = s.text()
        if text is None:
            named = [i for i, t in enumerate(r.tags) if t in ("article", "main") and s.size(i)]
            i = max(named, key=s.size, default=0)
            text = _lines([x for x, k in zip(r.out[r.first[i] : r.last[i]], s.kept[r.first[i] : r.last[i]], strict=True) if k])
        if len(text) > 2 * len(found):
            found = text
        if len(found) >= _ENOUGH:
            break
    return found


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Visible text of HTML in lines, one for each block; scripts, styles and heads don't show."""
    return html.map(lambda x: None if x is None else _lines(_Reader().finish(x).out))


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("text", StringType())]))
def main_text(html: pd.Series) -> pd.DataFrame:
    """A page's title (null if it has none) and its main text by readability."""
    read = [None if x is None else _Reader().finish(x) for x in html]
    return pd.DataFrame({"title": [None if r is None else " ".join("".join(r.title).split()) or None for r in read], "text": [None if r is None else _main(r) for r in read]})


@F.pandas_udf(StringType())
def page_title(html: pd.Series) -> pd.Series:
    """A page's title alone, null if it has none: what follows the head isn't laid out."""
    return html.map(lambda x: None if x is None else " ".join("".join(_Reader().finish(x).title).split()) or None)

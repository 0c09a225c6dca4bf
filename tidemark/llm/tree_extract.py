"""Operator 9: main text of an HTML page by tree scoring.

Every block of text passes points for its length and its commas to the elements around it, less
with distance. An element's points are discounted by its share of link text. The best element is
the container; its siblings are kept as well unless they are links or a bare scrap. Blocks of the
kept elements come out in page order.

Class and id words cut an element only if they say nothing but boilerplate ("cookie-notice", not
"related-work"); beside other words they cut it only where it is mostly links. Headings are never
cut, nor what holds the article: a form or banner around a ``main``, a ``h1`` or, except for reader
comments, an ``article``, or around more than half of the page's text in paragraphs.

A page is read once: a tag ends before the next ``<`` outside quotes, or it is text; elements know
their innermost open namesake and block, and sums go up the tree once.

Edge cases: null or empty html gives an empty text; unclosed and crossed tags, unfinished
comments and character references are read as browsers do, a stray ``<`` is text; a page without
any text block gives an empty text; repeated pages give equal results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrow import per_text
from tidemark.llm.words import Texts

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>'\"]*+)((?:[^'\"<>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>'\"]*+)([^<>]*+)>"  # a quote that never ends is no quote
    r"|</?[a-zA-Z][^<>]*+\Z",  # cut off by the end
    re.S,
)
MARKED = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""\shidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
SPACES = re.compile(r"\s+")

# Element kinds of HTML.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table"
    " tbody td tfoot th thead tr ul caption".split()
)
LEFT_OUT = frozenset(
    "head nav footer aside script style noscript iframe textarea title select option button input svg canvas"
    " template object embed menu dialog label audio video".split()
)
PARAGRAPH = frozenset("p pre td th li dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
LISTS = frozenset("ul ol dl table".split())
CLOSES_SELF = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
SCOPE = frozenset("table ul ol dl td th body html article section div main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FORMS = frozenset("form fieldset".split())
# Words in class or id that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs footer comment comments respond disqus replies cookie cookies consent notice"
    " notices alert popup modal overlay subscribe newsletter signup login share sharing social related recommended"
    " widget toolbar pager pagination masthead skip copyright".split()
)
COMMENTS = frozenset("comment comments respond disqus replies".split())
# Words that only say what shape or place the marked thing has.
SHAPE = frozenset(
    "area article articles bar block bottom box btn button buttons container content header icon icons inner item items"
    " left link links list main outer page panel post posts primary reader right row secondary section site slot thread"
    " top unit user users wrap wrapper".split()
)
WORD = re.compile(r"[a-z]+")
CUT, SUSPECT, THREAD = 1, 2, 3  # marks of an element; THREAD: reader comments


def marks(attributes: str) -> int:
    """Mark of an element by its class, id, role and label; 0 if none."""
    worst = 0
    for kind, value in MARKED.findall(attributes):
        kind, value = kind.lower(), value.strip("\"'").lower()
        for token in [value] if kind == "aria-label" else value.split():
            words = WORD.findall(token)
            told = [w for w in words if w in BOILERPLATE]
            if not told:
                continue
            pure = all(w in BOILERPLATE or w in SHAPE for w in words)
            if pure and not COMMENTS.isdisjoint(told):
                return THREAD
            # an id names a place in the article as often as a part of the page
            if pure and (kind != "id" or len(words) > 1 or told[0] in ("sidebar", "footer", "nav", "navbar", "navigation")):
                worst = CUT
            else:
                worst = worst or SUSPECT
    return worst


# Points.
LENGTH_STEP, LENGTH_MOST = 100, 3
PLAIN_LENGTH, PLAIN_LINKS = 40, 0.25
MOSTLY_LINKS = 0.5
SENTENCE = re.compile("[.!?:;…。！？][\"'»”)]?$")


class Page:
    """Element tree and text blocks of one page."""

    def __init__(self, html: str):
        self.tag, self.parent, self.out, self.mark, self.block = ["#root"], [-1], [False], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []  # (owner element, text, characters in links)
        self._stack, self._parts, self._links = [0], [], 0
        self._where: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
        self._read(html)
        self._flush()

    def _flush(self):
        if self._parts:
            text = SPACES.sub(" ", "".join(self._parts)).strip()
            if text:
                self.blocks.append((self.block[self._stack[-1]], text, min(self._links, len(text))))
            self._parts, self._links = [], 0

    def _text(self, raw: str):
        if raw and not self.out[self._stack[-1]]:
            text = entities.unescape(raw)
            self._parts.append(text)
            if self._where.get("a"):
                self._links += len(SPACES.sub(" ", text).strip())

    def _open(self, name: str, attributes: str):
        if name in BLOCK:
            self._flush()
            if name not in ("html", "body"):
                self._close("p", SCOPE)
        for other in CLOSES_SELF.get(name, ()):
            self._close(other, SCOPE - {name} - CLOSES_SELF[name])
        up, at = self._stack[-1], len(self.tag)
        left_out = self.out[up] or name in LEFT_OUT or bool(attributes) and HIDDEN.search(attributes) is not None
        if name == "header" and not self._where.get("article") and not self._where.get("main"):
            left_out = True
        mark = 0
        if attributes and not left_out and name not in HEADINGS and name not in ("html", "body", "main"):
            mark = marks(attributes)
            if name == "article" and mark != THREAD:
                mark = 0
        self.tag.append(name)
        self.parent.append(up)
        self.out.append(left_out)
        self.mark.append(mark or CUT * (name in FORMS))
        self.block.append(at if name in BLOCK else self.block[up])
        if name not in VOID:
            self._where.setdefault(name, []).append(len(self._stack))
            self._stack.append(at)
        elif name in ("br", "hr"):
            self._text(" ")

    def _close(self, name: str, scope=frozenset()):
        """Close the innermost open element of that name, and all inside it, unless an element of
        ``scope`` is open inside it."""
        places = self._where.get(name)
        if not places or any(self._where[s][-1] > places[-1] for s in scope if self._where.get(s)):
            return
        i = places[-1]
        if any(self.block[e] == e for e in self._stack[i:]):
            self._flush()
        for e in self._stack[i:]:
            self._where[self.tag[e]].pop()
        del self._stack[i:]

    def _read(self, html: str):
        at, n = 0, len(html)
        while at < n:
            start = html.find("<", at)
            if start < 0:
                self._text(html[at:])
                return
            self._text(html[at:start])
            found = TAG.match(html, start)
            if found is None:
                self._text("<")
                at = start + 1
                continue
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            if found[1] or found[4]:
                if name == "p":
                    self._flush()
                self._close(name)
                continue
            self._open(name, found[3] or found[6] or "")
            if name in RAW:
                end = re.compile(rf"</{name}\s*>?", re.I).search(html, at)
                at = n if end is None else end.end()
                self._close(name)

    def _cut(self, blocks: list) -> list[bool]:
        """Elements that do not belong to the article by their marks, with all inside them."""
        size = len(self.tag)
        length, linked, prose, holds, article = ([0] * size for _ in range(5))
        for owner, text, links in blocks:
            length[owner] += len(text)
            linked[owner] += links
            prose[owner] += len(text) * (self.tag[owner] in ("p", "pre", "blockquote"))
        for e in range(size - 1, 0, -1):
            up = self.parent[e]
            holds[e] |= not self.out[e] and self.tag[e] in ("main", "h1")
            article[e] |= not self.out[e] and self.tag[e] == "article"
            for of in (length, linked, prose):
                of[up] += of[e]
            holds[up] |= holds[e]
            article[up] |= article[e]
        cut = [False] * size
        for e in range(1, size):
            mark = self.mark[e]
            if cut[self.parent[e]]:
                cut[e] = True
            elif mark == THREAD:
                cut[e] = not holds[e]
            elif mark == CUT:
                cut[e] = not (holds[e] or article[e] or 2 * prose[e] > length[0])
            elif mark == SUSPECT:
                cut[e] = linked[e] > MOSTLY_LINKS * length[e]
        return cut

    def main_blocks(self) -> list[str]:
        usable = [b for b in self.blocks if not self.out[b[0]]]
        cut = self._cut(usable)
        usable = [b for b in usable if not cut[b[0]]]
        if not usable:
            return []
        size = len(self.tag)
        points, length, linked, ends = [0.0] * size, [0] * size, [0] * size, [False] * size
        for owner, text, links in usable:
            value = 1 + text.count(",") + min(len(text) / LENGTH_STEP, LENGTH_MOST)
            value *= 1 - links / len(text)
            at, step = (self.parent[owner] if self.tag[owner] in PARAGRAPH else owner), 1
            while at > 0 and step <= 3:
                points[at] += value / step
                at, step = self.parent[at], step + 1
            if at == 0 and step == 1:
                points[0] += value
            length[owner] += len(text)
            linked[owner] += links
            ends[owner] |= SENTENCE.search(text[-2:]) is not None
        for e in range(size - 1, 0, -1):
            up = self.parent[e]
            length[up] += length[e]
            linked[up] += linked[e]
            ends[up] |= ends[e]
        for e in range(size):
            if length[e]:
                points[e] *= 1 - linked[e] / length[e]
        best = max(range(size), key=lambda e: (points[e], -e))
        at = best
        while at > 0:  # the article element around the best one is the container
            at = self.parent[at]
            if self.tag[at] in ("article", "main"):
                best = at
                if self.tag[at] == "article":
                    break
        kept = {best}
        if self.tag[best] not in ("article", "main", "body", "#root"):
            for e in range(1, size):
                if self.parent[e] != self.parent[best] or not length[e] or cut[e]:
                    continue
                share = linked[e] / length[e]
                shaped = self.tag[e] in HEADINGS or self.tag[e] in PARAGRAPH or self.tag[e] in LISTS
                if share < PLAIN_LINKS and (length[e] > PLAIN_LENGTH and ends[e] or length[e] > 2 * PLAIN_LENGTH or shaped):
                    kept.add(e)
        inside = [False] * size
        for e in range(size):
            inside[e] = e in kept or e > 0 and inside[self.parent[e]]
        return [text for owner, text, _ in usable if inside[owner]]


def main_text(html: str) -> str:
    return "\n\n".join(Page(html).main_blocks())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def work(texts: Texts) -> dict:
        found = [main_text(texts.text(i).decode("utf-8", "replace")) for i in range(len(texts.bounds) - 1)]
        return {"text": found, "n_chars": [len(t) for t in found]}

    return per_text(pages, ["page_id", "url"], "html", [("text", pa.string()), ("n_chars", pa.int64())], lambda: work)

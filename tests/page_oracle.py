"""Readable markdown of a page in plain Python: what the columns of the library are tested against.

Two extractors read a page as one list of pieces in page order: one takes the
container with the most prose, the other a fixed root and a list of allowed
elements.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

from quarry.operators.pagetree import PARAGRAPH_ENDS

SPARSE = 400
#: Elements, parts of class names and roles that are dropped (fixed values).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {
    "script", "style", "nav", "header", "footer", "aside", "noscript", "svg", "button", "form", "input", "select", "textarea", "iframe", "template",
    "label", "menu", "canvas", "dialog",
}
DROPPED_PARTS = ("navbar", "sidebar", "menu", "toc", "breadcrumb")
DROPPED_ROLES = {"toolbar", "navigation", "menu", "tablist"}
ALLOWED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "pre", "code", "blockquote", "table", "thead", "tbody", "tr", "th", "td", "a", "strong", "em", "b", "i", "br", "hr", "dl", "dt", "dd"}
CONTAINERS = {"div", "section", "article", "main", "body"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "li", "pre", "blockquote", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "dt", "dd", "hr", "body", "html"}
NAV_WORDS = re.compile(r"\b(log in|sign in|sign up|menu|search|home)\b", re.I)
LANGUAGE = re.compile(r"lang(?:uage)?-([\w+#-]+)", re.I)
#: Items and quotes inside one another up to this depth are indented.
INDENTED = 32


@dataclass
class Piece:
    """An element, or a text where ``tag`` is empty; ``end`` is the number of the first piece after it."""

    tag: str
    parent: int
    text: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    end: int = 0

    def words(self) -> str:
        return self.attrs.get("class", "").lower()


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces = [Piece("root", -1)]
        self.open = [0]
        self.many: Counter[str] = Counter()

    def _add(self, piece: Piece) -> int:
        self.pieces.append(piece)
        piece.end = len(self.pieces)
        return len(self.pieces) - 1

    def handle_starttag(self, tag, attrs):
        if tag in PARAGRAPH_ENDS and self.many["p"]:
            self.handle_endtag("p")
        if tag == "li":
            for k in reversed(self.open):
                if self.pieces[k].tag == "li":
                    self.handle_endtag("li")
                if self.pieces[k].tag in ("li", "ul", "ol"):
                    break
        k = self._add(Piece(tag, self.open[-1], attrs={k: v or "" for k, v in attrs}))
        if tag not in VOID:
            self.open.append(k)
            self.many[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._add(Piece(tag, self.open[-1], attrs={k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        while self.many[tag]:
            k = self.open.pop()
            self.pieces[k].end = len(self.pieces)
            self.many[self.pieces[k].tag] -= 1
            if self.pieces[k].tag == tag:
                return

    def handle_data(self, data):
        self._add(Piece("", self.open[-1], data))


class Page:
    """The pieces of a page, and for every stretch of them how many characters and linked characters it holds (without white space)."""

    def __init__(self, html: str):
        reader = _Reader()
        reader.feed(html)
        reader.close()
        self.pieces = reader.pieces
        for k in reader.open:
            self.pieces[k].end = len(self.pieces)
        self.title = self.text(next((k for k, p in enumerate(self.pieces) if p.tag == "title"), len(self.pieces))).strip()
        self.hrefs = [p.attrs["href"] for p in self.pieces if p.tag == "a" and "href" in p.attrs]
        self.dropped = self._dropped()
        self.chars, self.linked, link = [0], [0], 0
        for k, p in enumerate(self.pieces):
            if p.tag == "a":
                link = max(link, p.end)
            n = 0 if p.tag or self.dropped[k] else len("".join(p.text.split()))
            self.chars.append(self.chars[-1] + n)
            self.linked.append(self.linked[-1] + (n if k < link else 0))

    def _dropped(self) -> list[bool]:
        out, until = [], 0
        for k, p in enumerate(self.pieces):
            if k >= until and p.tag and (p.tag in DROPPED or "-" in p.tag or any(x in p.words() for x in DROPPED_PARTS) or p.attrs.get("role", "").lower() in DROPPED_ROLES):
                until = p.end
            out.append(k < until)
        return out

    def text(self, k: int) -> str:
        return "".join(p.text for p in self.pieces[k : self.pieces[k].end] if not p.tag) if k < len(self.pieces) else ""

    def size(self, k: int) -> tuple[int, float]:
        """(characters, share of them in links)."""
        end = self.pieces[k].end
        n = self.chars[end] - self.chars[k]
        return n, (self.linked[end] - self.linked[k]) / n if n else 0.0

    def children(self, k: int):
        j = k + 1
        while j < self.pieces[k].end:
            yield j
            j = self.pieces[j].end

    def main_root(self) -> int:
        """The theme's markdown container, else main, article, body, else everything."""
        for test in (lambda p: "theme-doc-markdown" in p.words().split(), lambda p: p.tag == "main", lambda p: p.tag == "article", lambda p: p.tag == "body"):
            found = next((k for k, p in enumerate(self.pieces) if test(p) and not self.dropped[k]), None)
            if found is not None:
                return found
        return 0

    def densest(self) -> int:
        """The container whose own paragraphs hold most unlinked prose; of equals the outermost."""
        prose: Counter[int] = Counter()
        for k, p in enumerate(self.pieces):
            if p.tag in ALLOWED and not self.dropped[k] and self.pieces[p.parent].tag in CONTAINERS:
                n, share = self.size(k)
                prose[p.parent] += n * (1 - share)
        best = max(prose, key=lambda k: (prose[k], -k), default=None)
        return self.main_root() if best is None or prose[best] <= 0 else best

    def link_blocks(self, root: int, ends: int = 5) -> set[int]:
        """First and last elements of a root that are navigation: short and mostly links, or short with words of navigation."""
        kids = [k for k in self.children(root) if self.pieces[k].tag and not self.dropped[k]]
        out = set()
        for k in {*kids[:ends], *kids[-ends:]}:
            n, share = self.size(k)
            if self.pieces[k].tag in ("h1", "h2", "pre") or not 0 < n < 220:
                continue
            if share > 0.6 or NAV_WORDS.search(self.text(k)):
                out.add(k)
        return out

    def markdown(self, root: int, without: set[int] = frozenset()) -> str:
        """ATX headings, dash bullets, fences with their language, links; images are dropped."""
        held: list[tuple[int, list[str]]] = [(root, [])]  # open elements that change what they hold
        inside: Counter[str] = Counter()
        k, last = root, self.pieces[root].end
        closing: list[int] = []  # open blocks that only stand apart

        def leave() -> None:
            at, parts = held.pop()
            inside[self.pieces[at].tag] -= 1
            held[-1][1].append(shaped(self.pieces[at], "".join(parts)))

        while k < last or len(held) > 1 or closing:
            while len(held) > 1 and self.pieces[held[-1][0]].end <= k and not (closing and closing[-1] > held[-1][0]):
                leave()
            if closing and self.pieces[closing[-1]].end <= k:
                closing.pop()
                held[-1][1].append("\n\n")
                continue
            if k >= last:
                if len(held) > 1:
                    leave()
                continue
            p = self.pieces[k]
            if self.dropped[k] or k in without or p.tag == "img":
                k = p.end
            elif not p.tag:
                held[-1][1].append(re.sub(r"\s+", " ", p.text))
                k += 1
            elif p.tag == "pre":
                found = next((m[1] for q in self.pieces[k : p.end] if q.tag and (m := LANGUAGE.search(q.words()))), "")
                held[-1][1].append(f"\n\n```{found}\n{self.text(k).strip(chr(10))}\n```\n\n")
                k = p.end
            elif p.tag in ("br", "hr"):
                held[-1][1].append("\n" if p.tag == "br" else "\n\n---\n\n")
                k += 1
            else:
                nested = inside[p.tag] >= (INDENTED if p.tag in ("li", "blockquote") else 1)
                if p.tag in SHAPES and not nested and k != root:
                    inside[p.tag] += 1
                    held.append((k, []))
                elif p.tag in BLOCKS:
                    held[-1][1].append("\n\n")
                    closing.append(k)
                k += 1
        return tidy("".join(held[0][1]))


SHAPES = {"h1", "h2", "h3", "h4", "h5", "h6", "code", "a", "strong", "b", "em", "i", "li", "blockquote"}


def shaped(piece: Piece, inner: str) -> str:
    """What an element makes of the markdown inside it."""
    flat, tag = inner.strip(), piece.tag
    if not flat:
        return ""
    if m := re.fullmatch(r"h([1-6])", tag):
        return f"\n\n{'#' * int(m[1])} {re.sub(chr(10) + '+', ' ', flat)}\n\n"
    if tag == "code":
        return f"`{flat}`"
    if tag == "a":
        return f"[{flat}]({piece.attrs['href']})" if piece.attrs.get("href") else inner
    if tag in ("strong", "b"):
        return f"**{flat}**"
    if tag in ("em", "i"):
        return f"_{flat}_"
    flat = re.sub(r"\n{3,}", "\n\n", flat)
    if tag == "li":
        return "\n- " + flat.replace("\n", "\n  ")
    return "\n\n" + "\n".join("> " + line for line in flat.split("\n")) + "\n\n"


def tidy(md: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)^ (?=\S)", "", re.sub(r"[ \t]+\n", "\n", md))).strip()


def read_page(html: str) -> tuple[str, str, str, list[str]]:
    """(title, markdown by density, markdown by root, targets of links)."""
    page = Page(html or "")
    root = page.main_root()
    return page.title, page.markdown(page.densest()), page.markdown(root, page.link_blocks(root)), page.hrefs

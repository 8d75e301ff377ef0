"""HTML extraction by consensus host paths.

Every page is read into blocks of text, each with the path of its open elements.
Path steps are generalised: tag plus classes, digits as ``0``. Containers are
scored by the text they hold outside links and page furniture; a page votes with
the shares of its best containers. Spark sums the votes for each host and path
(partial sums first, so a hot host is no hot key), and the winning path of a host
decides what is extracted from its pages. A page on which the winning path holds
no text is extracted by the best container of its own.

Forms and elements named by furniture words are cut, but not those that hold more than
half of the page's unlinked text (of its longest article or main, where it has one):
these are wrappers, and the votes decide on them. Reader comments count as a wrapper
only where nothing else of that text is left.

A page is read in one pass with trees of paths and of wrappers, whose sums go from
children to parents once, so that the work is in proportion to the page however deep
it nests.

Defined cases: null or empty html gives an empty text; pages without a url share
one host; a tag cut off by the end of the html is dropped; an unclosed comment,
script or style runs to the end; ties between paths go to more pages, then to the
smaller path, and within a page to the one that begins first; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from heapq import nsmallest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: Winners up to this many hosts are broadcast (about 100 bytes each); beyond, a merge join takes them, whose page side
#: adaptive execution splits where a host is hot.
BROADCAST_HOSTS = 200_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")

#: Elements by their role in HTML (fixed values).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label", "nobr",
}
FURNITURE = {"nav", "header", "footer", "aside", "button", "select", "menu", "dialog", "svg", "canvas", "object", "head", "fieldset", "option"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"ul", "ol", "table", "article", "section", "div", "main", "body", "html", "nav", "header", "footer", "aside", "form", "td", "blockquote"}
#: Class and id words of furniture, adverts, notices and reader comments (fixed values).
FURNITURE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent",
    "notice", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "sidebar", "header", "footer", "share", "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "respond",
    "disqus", "replies", "widget", "toolbar", "pagination", "pager", "login", "search", "masthead", "topbar", "skip",
}
COMMENT_WORDS = {"comment", "comments", "commentlist", "respond", "disqus", "replies"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
WORD = re.compile(r"[a-z]+")


class Element:
    """An open element: numbers of its path, of the innermost wrapper and of the innermost article or main around its text."""

    __slots__ = ("furniture", "link", "main", "path", "tag", "wrapper")

    def __init__(self, tag: str, path: int, furniture: bool, link: bool, wrapper: int = -1, main: int = -1):
        self.tag, self.path, self.furniture, self.link, self.wrapper, self.main = tag, path, furniture, link, wrapper, main


class Tree:
    """Numbered nodes whose parents (-1: none) come before them."""

    def __init__(self) -> None:
        self.parent: list[int] = []

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        return len(self.parent) - 1

    def sums(self, own: list[float]) -> list[float]:
        """Of each node's own value and those below it."""
        out = list(own)
        for k in range(len(out) - 1, -1, -1):
            if self.parent[k] >= 0:
                out[self.parent[k]] += out[k]
        return out

    def below(self, node: int) -> list[bool]:
        """Whether each node is ``node`` or below it."""
        out = []
        for k, parent in enumerate(self.parent):
            out.append(k == node or (parent >= 0 and out[parent]))
        return out


class Paths(Tree):
    """Paths of generalised steps, each once."""

    def __init__(self) -> None:
        super().__init__()
        self.step: list[str] = []
        self.depth: list[int] = []
        self.known: dict[tuple[int, str], int] = {}

    def at(self, parent: int, step: str) -> int:
        k = self.known.get((parent, step))
        if k is None:
            k = self.known[parent, step] = self.add(parent)
            self.step.append(step)
            self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        return k

    def text(self, k: int) -> str:
        out = []
        while k >= 0:
            out.append(self.step[k])
            k = self.parent[k]
        return "/".join(reversed(out))

    def find(self, path: str) -> int | None:
        k: int | None = -1
        for step in path.split("/"):
            k = self.known.get((k, step))
            if k is None:
                return None
        return k


@dataclass
class Block:
    text: str
    path: int  # of the innermost container
    linked: int  # characters inside links
    wrapper: int = -1
    main: int = -1
    number: int = 0


@dataclass
class Read:
    """Blocks of a page and the paths they lie in."""

    blocks: list[Block] = field(default_factory=list)
    paths: Paths = field(default_factory=Paths)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def blocks(page: str) -> Read:
    """The blocks of a page outside furniture."""
    read, wrapped, mains = Read(), Tree(), Tree()
    stack = [Element("", -1, False, False)]
    many: Counter[str] = Counter()  # open elements by tag
    comments: list[bool] = []  # of each wrapper
    parts: list[tuple[str, Element]] = []
    done = at = 0

    def flush(ends: bool = True) -> None:
        nonlocal done
        if parts:
            linked = sum(len(p) for p, e in parts if e.link)
            first = parts[0][1]
            read.blocks.append(Block("".join(p for p, _ in parts), stack[-1].path, linked, first.wrapper, first.main, done))
            parts.clear()
        done += ends

    def said(text: str) -> None:
        top = stack[-1]
        if text and not top.furniture:
            if parts and parts[-1][1].wrapper != top.wrapper:  # an inline wrapper begins or ends
                flush(False)
            parts.append((entities.unescape(text), top))

    def close(k: int) -> None:
        """Pops the stack down to the element at k, and that one."""
        if any(e.tag not in INLINE for e in stack[k:]):
            flush()
        for e in stack[k:]:
            many[e.tag] -= 1
        del stack[k:]

    def close_last(tags: set[str]) -> None:
        """Closes the last open element of these tags, unless a fence lies before it."""
        if not any(many[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                close(k)
                return
            if stack[k].tag in FENCES:
                return

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            cut = page.rfind("<", at)
            tail = page[at:]
            if cut >= 0 and re.match(r"</?[A-Za-z!?]", page[cut : cut + 3]):
                tail = page[at:cut]
            said(tail)
            break
        said(page[at : m.start()])
        at = m.end()
        if m[2] is None or not m[4]:  # a comment or declaration; or a tag that the end cuts off
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if many[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                close_last({"p"})
            if tag in SIBLINGS:
                close_last(SIBLINGS[tag])
        found = attributes(m[3]) if m[3].strip(" /") else {}
        names = found.get("class", "").lower()
        top = stack[-1]
        furniture = top.furniture or tag in FURNITURE or "hidden" in found or found.get("role", "").lower() in FURNITURE_ROLES
        wrapper, main = top.wrapper, top.main
        if tag in ("article", "main"):
            main = mains.add(main)
        elif not furniture and tag not in ("html", "body"):
            words = set(WORD.findall(f"{names} {found.get('id', '').lower()}"))
            if tag == "form" or not FURNITURE_WORDS.isdisjoint(words):
                wrapper = wrapped.add(wrapper)
                comments.append(not COMMENT_WORDS.isdisjoint(words))
        path = top.path if tag in INLINE else read.paths.at(top.path, ".".join([tag, *sorted(set(DIGITS.sub("0", names).replace("/", "|").split()))]))
        stack.append(Element(tag, path, furniture, top.link or tag == "a", wrapper, main))
        many[tag] += 1
    flush()
    stays = wrappers(read.blocks, wrapped, comments, mains) if comments else []
    whole: dict[int, Block] = {}
    for b in read.blocks:
        if b.wrapper < 0 or stays[b.wrapper]:
            before = whole.get(b.number)
            whole[b.number] = Block(before.text + b.text, before.path, before.linked + b.linked) if before else Block(b.text, b.path, b.linked)
    read.blocks = [Block(text, b.path, b.linked) for b in whole.values() if (text := SPACE.sub(" ", b.text).strip())]
    return read


def wrappers(found: list[Block], wrapped: Tree, comments: list[bool], mains: Tree) -> list[bool]:
    """Whether each wrapper and all around it hold most of a page's unlinked text, so that they stay."""
    sizes = [max(0, len(b.text.strip()) - b.linked) for b in found]
    own = [0] * len(mains.parent)
    for size, b in zip(sizes, found, strict=True):
        if b.main >= 0:
            own[b.main] += size
    by_main = mains.sums(own)
    main = max(range(len(by_main)), key=lambda k: (by_main[k], -k), default=None)
    inside = mains.below(main) if main is not None and by_main[main] else None
    bare, total, own = False, 0, [0] * len(comments)
    for size, b in zip(sizes, found, strict=True):
        if inside is None or (b.main >= 0 and inside[b.main]):
            total += size
            if b.wrapper >= 0:
                own[b.wrapper] += size
            elif size:
                bare = True
    held = wrapped.sums(own)
    stays: list[bool] = []
    for k, parent in enumerate(wrapped.parent):  # outer wrappers come first
        stay = 2 * held[k] > total and not (comments[k] and bare) and (parent < 0 or stays[parent])
        stays.append(stay)
        bare = bare or (stay and own[k] > 0)
    return stays


def container_scores(read: Read) -> dict[int, float]:
    """Score of each container path of a page: the share of unlinked text it holds, with a bias to inner and named containers."""
    weights = [max(0, len(b.text) - b.linked) for b in read.blocks]
    total = sum(weights) or 1
    own = [0.0] * len(read.paths.parent)
    for weight, b in zip(weights, read.blocks, strict=True):
        if b.path >= 0:
            own[b.path] += weight / total
    used = [False] * len(own)
    for b in read.blocks:
        if b.path >= 0:
            used[b.path] = True
    out = {}
    for k, share in enumerate(read.paths.sums(own)):
        leaf = read.paths.step[k]
        tag = leaf.partition(".")[0]
        if (share <= 0 and not used[k]) or tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "td", "tr", "dt", "dd", "html"):
            continue
        words = set(WORD.findall(leaf))
        bias = 0.25 * (tag in ("article", "main")) + 0.15 * bool(words & {"article", "content", "post", "entry", "story", "main"}) + 0.02 * read.paths.depth[k]
        out[k] = share * (1 + bias)
    return out


def best_paths(read: Read, most: int) -> list[tuple[int, float]]:
    scored = nsmallest(most, container_scores(read).items(), key=lambda x: (-round(x[1], 9), x[0]))
    best = (scored[0][1] if scored else 1.0) or 1.0
    return [(k, score / best) for k, score in scored]


def votes(read: Read, most: int = 3) -> list[tuple[str, float]]:
    return [(read.paths.text(k), score) for k, score in best_paths(read, most)]


def text_at(read: Read, path: str | None) -> str:
    """Text of the blocks inside ``path``; of the page's best container if that holds none."""
    for chosen in (lambda: read.paths.find(path) if path else None, lambda: next((k for k, _ in best_paths(read, 1)), None)):
        k = chosen()
        if k is not None:
            inside = read.paths.below(k)
            own = [b.text for b in read.blocks if b.path >= 0 and inside[b.path]]
            if own:
                return " ".join(own)
    return " ".join(b.text for b in read.blocks)


def hosts(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host); pages without a readable url share the empty host."""
    return pages.select("page_id", "url", "html", F.coalesce(F.lower(F.expr("try_parse_url(url, 'HOST')")), F.lit("")).alias("host"))


def host_paths(keyed: DataFrame) -> DataFrame:
    """(host, path): the winning container path of each host."""
    import pyarrow as pa

    def vote(batches):
        for batch in batches:
            sums: dict[tuple[str, str], list[float]] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, score in votes(blocks(page or "")):
                    s = sums.setdefault((host, path), [0.0, 0])
                    s[0] += score
                    s[1] += 1
            rows = [{"host": h, "path": p, "score": s[0], "n": s[1]} for (h, p), s in sums.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64()), ("n", pa.int64())]))

    cast = keyed.select("host", "html").mapInArrow(vote, "host string, path string, score double, n bigint")
    cast = cast.groupBy("host", "path").agg(F.round(F.sum("score"), 6).alias("score"), F.sum("n").alias("n"))
    return cast.groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("n")).alias("n"), F.col("path"))).alias("top")).select("host", "top.path")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    keyed = hosts(pages)
    winners = common.materialise(host_paths(keyed), "host-paths")
    winners = F.broadcast(winners) if winners.count() <= BROADCAST_HOSTS else winners.hint("merge")
    joined = keyed.join(winners, "host", "left").select("page_id", "url", "html", "path")
    out = StructType([*[f for f in joined.schema if f.name in ("page_id", "url")], *StructType.fromDDL("text string")])
    schema = to_arrow_schema(out)

    def read(batches):
        for batch in batches:
            pairs = zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)
            text = pa.array([text_at(blocks(page or ""), path) for page, path in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text], schema=schema)

    return joined.mapInArrow(read, out)

"""HTML pages as tables of tokens and elements, without a parser: nested-set numbers, sums over subtrees, parents.

A pattern whose alternatives cover every character cuts a page into tokens. An element
is the stretch of tokens [n, end): a start tag's partner is the next tag of its name at
its depth, by a running sum for each name; paragraphs and items also end where the next
one of their list begins; and no element outlives the one around it, which is how
elements that are never closed end. Everything else is a sum over such stretches:

* what lies inside dropped elements, links or code is where the running sum of their
  starts and ends is above zero;
* a subtree's characters are the difference of running sums at its end and its start;
* an element's parent is the last element one level up that began before it.

All windows are by page.
"""

from __future__ import annotations

import json
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = (
    r"(?s)<!--.*?(?:-->|\z)|<(?i:script|style)\b[^>]*+>.*?(?:</(?i:script|style)\s*>|\z)|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[!?][^>]*+>?|[^<]++|<"
)
#: Elements, parts of class names and roles that are dropped, and kinds of elements (fixed values).
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
DROPPED = [
    "script", "style", "nav", "header", "footer", "aside", "noscript", "svg", "button", "form", "input", "select", "textarea", "iframe", "template",
    "label", "menu", "canvas", "dialog",
]
DROPPED_PARTS = ["navbar", "sidebar", "menu", "toc", "breadcrumb"]
DROPPED_ROLES = ["toolbar", "navigation", "menu", "tablist"]
LISTS = ["ul", "ol"]
#: Elements before which a paragraph ends (fixed values).
PARAGRAPH_ENDS = [
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "dt", "dd", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol",
    "p", "pre", "section", "table", "ul",
]


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag as it is written; null if it has none."""
    pattern = rf"(?is)\A<[^\s>]++(?:[^>\"'\s]++|\"[^\"]*+\"|'[^']*+'|\s++(?!{name}\s*+=))*+\s++{name}\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))"
    return F.when(tag.rlike(pattern), F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]))


def decoded(x: Column) -> Column:
    """Text with its character references replaced."""
    named = F.from_json(F.lit(json.dumps({name: chr(point) for name, point in name2codepoint.items()})), "map<string, string>")
    point = lambda digits, base: F.conv(digits, base, 10).cast("int")
    letter = lambda n: F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("�")

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, r"\A&([a-zA-Z]\w*);\z", 1)
        decimal, hexadecimal = F.regexp_extract(part, r"\A&#([0-9]{1,9});\z", 1), F.regexp_extract(part, r"\A&#[xX]([0-9a-fA-F]{1,8});\z", 1)
        return F.when(name != "", F.coalesce(F.try_element_at(named, name), part)).when(decimal != "", letter(point(decimal, 10))).when(hexadecimal != "", letter(point(hexadecimal, 16))).otherwise(part)

    parts = F.regexp_extract_all(x, F.lit(r"&#?\w+;|[^&]++|&"), F.lit(0))
    return F.when(x.contains("&"), F.array_join(F.transform(parts, lambda p: F.when(p.startswith("&"), one(p)).otherwise(p)), "")).otherwise(x)


def tokens(pages: DataFrame) -> DataFrame:
    """(page, n, tag, kind, text, empty, classes, role, href) of pages (page, html): kind is open, close or text; comments and declarations are left out."""
    rows = pages.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("n", "t"))
    rows = rows.filter(~F.col("t").rlike(r"\A<[!?]"))
    rows = rows.withColumn("tag", F.lower(F.regexp_extract("t", r"\A</?([a-zA-Z][^\s/>]*)", 1)))
    kind = F.when(F.col("tag") == "", "text").when(F.col("t").startswith("</"), "close").otherwise("open")
    rows = rows.withColumn("kind", kind)
    opens = F.col("kind") == "open"
    given = lambda name: F.when(opens, attribute(F.col("t"), name))
    empty = opens & (F.col("tag").isin([*VOID, "script", "style"]) | F.endswith("t", F.lit("/>")))
    return rows.select(
        "page", "n", "tag", "kind", F.when(F.col("kind") == "text", decoded(F.col("t"))).alias("text"), empty.alias("empty"),
        F.lower(F.coalesce(given("class"), F.lit(""))).alias("classes"), F.lower(F.coalesce(given("role"), F.lit(""))).alias("role"), decoded(given("href")).alias("href"),
    )


def elements(rows: DataFrame) -> DataFrame:
    """(page, n, end, tag, classes, role, href) of the elements of tokens: each is nested in those it begins in."""
    order = Window.partitionBy("page").orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("kind") == "close", -1).when((F.col("kind") == "open") & ~F.col("empty"), 1).otherwise(0)
    rows = rows.withColumn("step", step).filter("kind <> 'text'")
    last = rows.groupBy("page").agg((F.max("n") + 1_000_000_000).alias("page_end"))
    # the partner by name and depth
    same = Window.partitionBy("page", "tag").orderBy("n")
    depth = F.sum("step").over(same.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("depth", F.coalesce(depth, F.lit(0)) + F.when(F.col("step") > 0, 1).otherwise(0))
    lists = F.coalesce(F.sum(F.when(F.col("tag").isin(LISTS), F.col("step")).otherwise(0)).over(before), F.lit(0))
    runs = F.col("tag").isin("p", "li")
    rows = rows.withColumn("group", F.when(F.col("tag") == "li", lists).otherwise(F.col("depth")))
    alike = Window.partitionBy("page", "tag", "group").orderBy("n")
    follows, kind_after = F.lead("n").over(alike), F.lead("kind").over(alike)
    ends_paragraph = ((F.col("kind") == "open") & F.col("tag").isin(PARAGRAPH_ENDS)) | (F.col("tag") == "p")
    next_block = F.first(F.when(ends_paragraph, F.col("n")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    partner = F.when(F.col("tag") == "p", next_block).when((F.col("tag") == "li") | (kind_after == "close"), follows)
    rows = rows.withColumn("partner", F.when(F.col("step") > 0, partner))
    # close tags that close something count for the depth of all names; those of paragraphs and items do not, since these may end before
    firm = (F.col("partner").isNotNull() & ~runs).cast("int")
    closed = F.lag(firm).over(alike) == 1
    rows = rows.withColumn("move", F.when(F.col("step") > 0, firm).when((F.col("step") < 0) & closed & ~runs, -1).otherwise(0))
    rows = rows.withColumn("outer", F.coalesce(F.sum("move").over(before), F.lit(0)))
    around = Window.partitionBy("page", "outer").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    bound = F.first(F.when(F.col("move") < 0, F.col("n")), ignorenulls=True).over(around)
    # a firm close stands at the depth that it ends
    rows = rows.withColumn("bound", bound).join(last, "page")
    end = F.when(F.col("step") > 0, F.least(F.coalesce("partner", "page_end"), F.coalesce("bound", "page_end"))).otherwise(F.col("n") + 1)
    rows = rows.withColumn("end", end)
    # what begins in a paragraph or an item ends with it
    held = [F.last(F.when((F.col("step") > 0) & (F.col("tag") == t), F.col("end")), ignorenulls=True).over(before) for t in ("p", "li")]
    within = [F.when(h > F.col("n"), F.least("end", h)).otherwise(F.col("end")) for h in held]
    return rows.withColumn("end", F.least(*within)).filter("kind = 'open'").select("page", "n", "end", "tag", "classes", "role", "href")


def dropped() -> Column:
    parts = reduce(lambda a, b: a | b, [F.contains("classes", F.lit(w)) for w in DROPPED_PARTS])
    return F.col("tag").isin(DROPPED) | F.contains("tag", F.lit("-")) | parts | F.col("role").isin(DROPPED_ROLES)


def inside(rows: DataFrame, spans: DataFrame, **kinds: Column) -> DataFrame:
    """``rows`` (page, n, ...) with, for each kind, how many of the ``spans`` (page, n, end) of that kind are open there; a span's own start counts."""
    names = list(kinds)
    marks = spans.select("page", "n", "end", *[c.cast("int").alias(k) for k, c in kinds.items()]).filter(" + ".join(names) + " > 0")
    starts = marks.select("page", F.col("n").alias("n"), *names)
    ends = marks.select("page", F.col("end").alias("n"), *[(-F.col(k)).alias(k) for k in names])
    moves = starts.unionByName(ends).groupBy("page", "n").agg(*[F.sum(k).cast("int").alias(k) for k in names])
    both = rows.join(moves, ["page", "n"], "left")
    upto = Window.partitionBy("page").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    # ends that fall on no row take effect at the next one
    missed = moves.join(rows.select("page", "n"), ["page", "n"], "left_anti")
    extra = missed.select("page", "n", *names, *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("page", "n")])
    whole = both.withColumn("_row", F.lit(True)).unionByName(extra.withColumn("_row", F.lit(False)))
    return whole.withColumns({k: F.coalesce(F.sum(k).over(upto), F.lit(0)).cast("int") for k in names}).filter("_row").drop("_row")


def measured(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (page, n, end, ...) with parent, level, chars, linked and solid: characters of the texts inside that are no white space and not dropped, those of them in links, and rules and code inside. ``rows`` have drops and links."""
    size = F.when((F.col("kind") == "text") & (F.col("drops") == 0), F.length(F.regexp_replace("text", r"\s+", ""))).otherwise(0)
    texts = rows.select("page", "n", size.alias("size"), F.when(F.col("links") > 0, size).otherwise(0).alias("of_links"), ((F.col("kind") == "open") & F.col("tag").isin("hr", "pre") & (F.col("drops") == 0)).cast("int").alias("of_solid"))
    at = lambda c, rank: found.select("page", F.col(c).alias("n"), F.col("n").alias("own"), F.lit(rank).alias("rank"))
    none = F.lit(0)
    events = at("end", 0).unionByName(at("n", 1)).withColumns({"size": none, "of_links": none, "of_solid": none})
    events = events.unionByName(texts.withColumns({"own": F.lit(None).cast("int"), "rank": F.lit(2)}))
    order = Window.partitionBy("page").orderBy("n", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    events = events.withColumns({"chars": total("size"), "linked": total("of_links"), "solid": total("of_solid"), "level": total(F.when(F.col("rank") == 1, 1).when(F.col("rank") == 0, -1).otherwise(0))})
    events = events.filter("rank < 2")
    sign = F.when(F.col("rank") == 0, 1).otherwise(-1)
    sums = events.groupBy("page", "own").agg(F.sum(F.col("chars") * sign).alias("chars"), F.sum(F.col("linked") * sign).alias("linked"), F.sum(F.col("solid") * sign).alias("solid"), F.max(F.when(F.col("rank") == 1, F.col("level"))).alias("level"))
    # parents: each element marks the level below its own
    starts = sums.select("page", F.col("own").alias("n"), "level")
    marks = starts.select("page", "n", "level", F.lit(None).cast("int").alias("mark")).unionByName(starts.select("page", "n", (F.col("level") + 1).alias("level"), F.col("n").alias("mark")))
    above = F.last("mark", ignorenulls=True).over(Window.partitionBy("page", "level").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    parents = marks.withColumn("parent", above).filter("mark is null").select("page", "n", "parent")
    return found.join(sums.select("page", F.col("own").alias("n"), "chars", "linked", "solid", "level"), ["page", "n"]).join(parents, ["page", "n"])


def page_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, elements) of pages (page, html): tokens with drops and links, elements with parent, level, chars, linked and whether they are dropped."""
    rows = tokens(pages)
    found = elements(rows).withColumn("drop", dropped())
    rows = inside(rows, found, drops=F.col("drop"), links=F.col("tag") == "a")
    return rows, measured(rows, found)

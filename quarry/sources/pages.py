"""Readable markdown of fetched pages, in columns over the page tree.

Two extractors read a page: one takes the container with the most prose, the other a
fixed root without the short blocks of links at its ends. Either result is the page's
texts and what its elements set before and after them, sorted by place and joined; which
one is used is a CASE over their lengths. White space inside an element's marks is taken
away by private characters that stand beside the marks until the text is whole. Of
quotes and list items inside one another the marks of quotes come first in a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import markdown, text, urls
from quarry.operators import pagetree
from quarry.plans.shared import bound_batches, written

SPARSE = 400
#: Kinds of elements (fixed values).
ALLOWED = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "pre", "code", "blockquote", "table", "thead", "tbody", "tr", "th", "td", "a", "strong", "em", "b", "i", "br", "hr", "dl", "dt", "dd"]
CONTAINERS = ["div", "section", "article", "main", "body"]
BLOCKS = ["p", "div", "section", "article", "main", "ul", "ol", "li", "pre", "blockquote", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "dt", "dd", "hr", "body", "html"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
MARKS = {"code": "`", "strong": "**", "b": "**", "em": "_", "i": "_"}
#: Words of navigation (fixed values).
NAV_WORDS = r"(?i)\b(log in|sign in|sign up|menu|search|home)\b"
LANGUAGE = r"(?i)lang(?:uage)?-([\w+#-]+)"
#: Short blocks at the ends of a root: how many are looked at, their most characters, and the share of them in links.
ENDS, SHORT, LINKED = 5, 220, 0.6
#: Items and quotes inside one another up to this depth are indented.
INDENTED = 32
#: Stand before and after what an element holds, around code, for the mark of a quote, at the end of a line's indent, and around elements that hold nothing.
OPEN, SHUT, CODE_OPEN, CODE_SHUT, QUOTE, INDENT, NOTHING, NEITHER = "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue006", "\ue007", "\ue008"
NO_END = 2_000_000_000


def roots(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(page, kind, n, end) of each page's two roots: ``rooted`` is the theme's container, else main, article or body; ``dense`` the container whose own paragraphs hold most unlinked prose, of equals the outermost, else the same."""
    live = found.filter("drops = 0")
    words = F.split("classes", r"\s+")
    rank = F.when(F.array_contains(words, "theme-doc-markdown"), 0).when(F.col("tag") == "main", 1).when(F.col("tag") == "article", 2).when(F.col("tag") == "body", 3)
    span = F.struct("n", "end")
    rooted = live.withColumn("rank", rank).filter("rank is not null").groupBy("page").agg(F.min_by(span, F.struct("rank", "n")).alias("rooted"))
    holders = found.filter(F.col("tag").isin(CONTAINERS)).select("page", F.col("n").alias("parent"), F.col("end").alias("holder_end"))
    prose = live.filter(F.col("tag").isin(ALLOWED)).join(holders, ["page", "parent"]).groupBy("page", "parent", "holder_end").agg(F.sum(F.col("chars") - F.col("linked")).alias("prose"))
    dense = prose.filter("prose > 0").groupBy("page").agg(F.min_by(F.struct(F.col("parent").alias("n"), F.col("holder_end").alias("end")), F.struct(-F.col("prose"), "parent")).alias("dense"))
    whole = F.struct(F.lit(-1).alias("n"), F.lit(NO_END).alias("end"))
    rows = rows.select("page").distinct().join(rooted, "page", "left").join(dense, "page", "left").withColumn("rooted", F.coalesce("rooted", whole))
    kinds = F.array(F.struct(F.lit("rooted").alias("kind"), F.col("rooted").alias("r")), F.struct(F.lit("dense").alias("kind"), F.coalesce("dense", "rooted").alias("r")))
    return rows.select("page", F.explode(kinds).alias("k")).select("page", "k.kind", "k.r.*")


def link_blocks(rows: DataFrame, found: DataFrame, chosen: DataFrame) -> DataFrame:
    """(page, n, end) of the first and last elements of the fixed root that are navigation: short and mostly links, or short with words of navigation."""
    own = chosen.filter("kind = 'rooted'").select("page", F.col("n").alias("root"))
    kids = found.filter("drops = 0").withColumn("root", F.coalesce("parent", F.lit(-1))).join(own, ["page", "root"])
    order = Window.partitionBy("page").orderBy("n")
    kids = kids.withColumn("first", F.row_number().over(order)).withColumn("last", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("n"))))
    short = kids.filter((F.least("first", "last") <= ENDS) & ~F.col("tag").isin("h1", "h2", "pre") & F.col("chars").between(1, SHORT - 1)).select("page", "n", "end", "chars", "linked")
    said = rows.filter("kind = 'text'").filter(F.col("text").rlike(NAV_WORDS)).select("page", F.col("n").alias("at"))
    named = short.join(said, "page").filter("at > n and at < end").select("page", "n").distinct().withColumn("named", F.lit(True))
    return short.join(named, ["page", "n"], "left").filter((F.col("linked") > F.col("chars") * LINKED) | F.col("named")).select("page", "n", "end")


def _strings(found: DataFrame, languages: DataFrame) -> DataFrame:
    """(page, n, end, before, after, li, bq): what each live element sets before and after what it holds, and in how many items and quotes it lies."""
    tag, href = F.col("tag"), F.col("href")
    rows = found.filter("drops = 0 and (pre = 0 or (pre = 1 and tag = 'pre'))").join(languages, ["page", "n"], "left")
    line = F.when(F.col("heads") - tag.isin(HEADINGS).cast("int") > 0, " ").otherwise("\n")
    two = F.concat(line, line)
    nested = F.lit(False)
    for name in MARKS:
        nested = nested | ((tag == name) & (F.col(name) > 1))
    nested = nested | ((tag == "a") & (F.col("links") > 1)) | ((tag == "li") & (F.col("li") > INDENTED)) | ((tag == "blockquote") & (F.col("bq") > INDENTED))
    level = F.substring(tag, 2, 1).cast("int")
    full = F.col("chars") + F.col("solid") > 0
    mark = F.try_element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), tag)
    shaped = tag.isin(*MARKS, *HEADINGS, "a", "li", "blockquote") & ~nested
    before = (
        F.when(tag == "pre", F.concat(two, F.lit("```"), F.coalesce("language", F.lit("")), line, F.lit(CODE_OPEN))).when(tag == "br", line).when(tag == "hr", F.concat(two, F.lit("---"), two))
        .when(shaped & ~full, NOTHING).when(shaped & tag.isin(HEADINGS), F.concat(two, F.repeat(F.lit("#"), level), F.lit(" " + OPEN)))
        .when(shaped & (tag == "a"), F.when(href != "", "[" + OPEN).otherwise("")).when(shaped & mark.isNotNull(), F.concat(mark, F.lit(OPEN)))
        .when(shaped & (tag == "li"), F.concat(line, F.lit("- " + OPEN))).when(shaped & (tag == "blockquote"), F.concat(two, F.lit(QUOTE + OPEN)))
        .when(tag.isin(BLOCKS), two).otherwise("")
    )
    after = (
        F.when(tag == "pre", F.concat(F.lit(CODE_SHUT), line, F.lit("```"), two)).when(tag.isin("br", "hr"), "")
        .when(shaped & ~full, NEITHER).when(shaped & tag.isin(HEADINGS), F.concat(F.lit(SHUT), two))
        .when(shaped & (tag == "a"), F.when(href != "", F.concat(F.lit(SHUT + "]("), href, F.lit(")"))).otherwise("")).when(shaped & mark.isNotNull(), F.concat(F.lit(SHUT), mark))
        .when(shaped & (tag == "li"), SHUT).when(shaped & (tag == "blockquote"), F.concat(F.lit(SHUT), two))
        .when(tag.isin(BLOCKS), two).otherwise("")
    )
    outer = lambda c, name: F.col(c) - F.when(shaped & (tag == name), 1).otherwise(0)
    return rows.select("page", "n", "end", before.alias("before"), after.alias("after"), outer("li", "li").alias("li"), outer("bq", "blockquote").alias("bq"))


def tidy(x: Column) -> Column:
    """The joined pieces as markdown: white space inside marks, at line ends and between blocks goes."""
    line = rf"\n[> ]*+{INDENT}"
    blank = rf"(?:{line}|\s)"
    x = F.regexp_replace(F.regexp_replace(x, f"{CODE_OPEN}(?:{line})*+", ""), f"(?:{line})*+{CODE_SHUT}", "")
    for _ in range(3):
        x = F.regexp_replace(x, f"{NOTHING}{blank}*+{NEITHER}", "")
    x = F.regexp_replace(F.regexp_replace(x, f"{OPEN}{blank}*+", ""), rf"(?<![\s{INDENT}]){blank}++{SHUT}", "")
    x = F.regexp_replace(x, f"(?<={INDENT}){line}(?={line})", "")
    x = F.replace(F.regexp_replace(x, f"[{OPEN}-{CODE_SHUT}{INDENT}-{NEITHER}]", ""), F.lit(QUOTE), F.lit("> "))
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]+\n", "\n"), r"(?md)^ (?=\S)", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(x, rf"\A{text.SPACE}+|{text.SPACE}+\z", "")


def rendered(rows: DataFrame, found: DataFrame, chosen: DataFrame, without: DataFrame) -> DataFrame:
    """(page, kind, markdown) of the two roots of each page; ``without`` (page, n, end) is left out of the fixed root."""
    words = F.regexp_extract("classes", LANGUAGE, 1)
    fences = found.filter("tag = 'pre' and pre = 1").select("page", F.col("n").alias("own"), F.col("end").alias("own_end"))
    named = found.filter("pre > 0").withColumn("language", words).filter("language <> ''").select("page", F.col("n").alias("at"), "language")
    languages = fences.join(named, "page").filter("at >= own and at < own_end").groupBy("page", F.col("own").alias("n")).agg(F.min_by("language", "at").alias("language"))
    parts = _strings(found, languages)
    place = lambda at, rank, tie, s: F.struct(at.alias("at"), F.lit(rank).alias("rank"), tie.alias("tie"), s.alias("s"))
    n, end = F.col("n"), F.col("end")
    marks = parts.select("page", "n", "li", "bq", F.explode(F.array(place(n, 1, n, F.col("before")), place(end, 0, -n, F.col("after")))).alias("x")).filter("x.s <> ''")
    said = F.when(F.col("pre") > 0, F.col("text")).otherwise(F.regexp_replace("text", rf"{text.SPACE}+", " "))
    texts = rows.filter("kind = 'text' and drops = 0").select("page", "n", "li", "bq", place(n, 1, n, said).alias("x"))
    pieces = marks.unionByName(texts)
    base = found.select("page", "n", F.col("li").alias("li0"), F.col("bq").alias("bq0"))
    spans = chosen.join(base, ["page", "n"], "left").select("page", "kind", F.col("n").alias("root"), F.col("end").alias("root_end"), F.coalesce("li0", F.lit(0)).alias("li0"), F.coalesce("bq0", F.lit(0)).alias("bq0"))
    inner = pieces.join(spans, "page").filter("n > root and n < root_end")
    out = without.groupBy("page").agg(F.collect_list(F.struct("n", "end")).alias("gone"))  # a few blocks a page
    inner = inner.join(out, "page", "left")
    gone = F.exists("gone", lambda g: (F.col("n") >= g["n"]) & (F.col("n") < g["end"]))
    inner = inner.filter(~((F.col("kind") == "rooted") & F.coalesce(gone, F.lit(False))))
    times = lambda s, c: F.repeat(F.lit(s), F.least(F.greatest(F.col(c) - F.col(c + "0"), F.lit(0)), F.lit(INDENTED)))
    lines = F.replace(F.col("x.s"), F.lit("\n"), F.concat(F.lit("\n"), times("> ", "bq"), times("  ", "li"), F.lit(INDENT)))
    grouped = inner.groupBy("page", "kind").agg(F.array_sort(F.collect_list(F.struct("x.at", "x.rank", "x.tie", lines.alias("s")))).alias("pieces"))
    return grouped.select("page", "kind", tidy(F.array_join(F.transform("pieces", lambda p: p["s"]), "")).alias("markdown"))


def read_trees(pages: DataFrame) -> DataFrame:
    """(page, raw_title, dense, rooted, hrefs) of pages (page, html)."""
    rows = written(pagetree.tokens(pages), "tokens")
    found = written(pagetree.elements(rows), "elements")
    tag = F.col("tag")
    kinds = {"drops": pagetree.dropped(), "links": tag == "a", "pre": tag == "pre", "heads": tag.isin(HEADINGS), "li": tag == "li", "bq": tag == "blockquote", **{m: tag == m for m in MARKS}}
    rows = written(pagetree.inside(rows, found, **kinds), "placed")
    found = written(pagetree.measured(rows, found).join(rows.select("page", "n", *kinds), ["page", "n"]), "measured")
    chosen = roots(rows, found)
    made = rendered(rows, found, chosen, link_blocks(rows, found, chosen))
    made = made.groupBy("page").agg(*[F.max(F.when(F.col("kind") == k, F.col("markdown"))).alias(k) for k in ("dense", "rooted")])
    titles = found.filter("tag = 'title'").groupBy("page").agg(F.min_by(F.struct("n", "end"), "n").alias("t"))
    titles = titles.join(rows.filter("kind = 'text'").select("page", F.col("n").alias("at"), "text"), "page").filter("at > t.n and at < t.end")
    titles = titles.groupBy("page").agg(F.btrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")).alias("raw_title"))
    links = found.filter("tag = 'a' and href is not null").groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "href"))), lambda x: x["href"]).alias("hrefs"))
    out = pages.select("page").join(made, "page", "left").join(titles, "page", "left").join(links, "page", "left")
    empty = F.lit("")
    return out.select("page", F.coalesce("raw_title", empty).alias("raw_title"), F.coalesce("dense", empty).alias("dense"), F.coalesce("rooted", empty).alias("rooted"), F.coalesce("hrefs", F.array().cast("array<string>")).alias("hrefs"))


def extract_pages(pages: DataFrame, sparse: int = SPARSE) -> DataFrame:
    """(page_id, url, title, description, markdown, is_sparse, n_links, links) of pages (page_id, url, html).

    The density result if it is not sparse, else the root result if that is not,
    else the longer of the two; markdown of any length stays whole. ``links`` are
    absolute. Equal html is read once.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("page", F.xxhash64("html"))
    read = read_trees(rows.groupBy("page").agg(F.first("html").alias("html")))
    rows = rows.select("page_id", "url", "page", markdown.meta_description(F.col("html")).alias("description")).join(read, "page")
    rows = rows.withColumn("links", urls.resolved("hrefs", "url"))
    size = lambda c: text.body_length(F.col(c))
    best = F.when(size("dense") >= sparse, F.col("dense")).when(size("rooted") >= sparse, F.col("rooted")).when(size("dense") >= size("rooted"), F.col("dense")).otherwise(F.col("rooted"))
    rows = rows.withColumn("markdown", markdown.post_process(best))
    title = F.coalesce(markdown.page_title(F.col("raw_title")), text.markdown_title(F.col("markdown"), F.col("url")))
    return rows.select("page_id", "url", title.alias("title"), "description", "markdown", (text.body_length(F.col("markdown")) < sparse).alias("is_sparse"), F.size("links").alias("n_links"), "links")


def markdown_responses(pages: DataFrame) -> DataFrame:
    """The columns of ``extract_pages`` for pages (page_id, url, markdown) whose server sent markdown."""
    c = F.col("markdown")
    links = urls.markdown_links(c, F.col("url"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", text.markdown_title(c, F.col("url")).alias("title"), F.lit(None).cast("string").alias("description"),
        "markdown", F.lit(False).alias("is_sparse"), F.size(links).alias("n_links"), links.alias("links"),
    )


def read_pages(pages: DataFrame, sparse: int = SPARSE) -> DataFrame:
    """Pages (page_id, url, html, and optionally markdown): a markdown body that looks like one is taken, others are extracted."""
    if "markdown" not in pages.columns:
        return extract_pages(pages, sparse)
    sent = F.coalesce(text.looks_like_markdown(F.col("markdown")), F.lit(False))
    return markdown_responses(pages.filter(sent)).unionByName(extract_pages(pages.filter(~sent), sparse))


def page_documents(extracted: DataFrame, root: str, min_body: int = 200, need_code: bool = True, **scope) -> DataFrame:
    """Documents of extracted pages: sanitised, gated by length and code, with path, uri and the reason of those left out."""
    bound_batches(extracted.sparkSession)
    clean = markdown.sanitize(F.col("markdown"))
    rows = extracted.withColumn("content", clean)
    reason = F.when(~urls.in_scope(F.col("url"), root, **scope), "out of scope").when(text.body_length(F.col("content")) < min_body, "too small")
    if need_code:
        reason = reason.when(~text.has_snippets(F.col("content")), "missing code snippets")
    path = urls.relative_path(F.col("url"))
    return rows.select("page_id", "url", path.alias("path"), text.web_uri(urls.host(F.col("url")), path).alias("uri"), "title", "content", reason.alias("reason"))

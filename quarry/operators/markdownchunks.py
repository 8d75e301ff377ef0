"""Chunks of markdown files, in columns and within a row: nothing is shuffled and no Python runs.

Headings are a fold that carries the open ancestors. A section that is too long is cut
by a fold over its lines (first held line, size, pieces so far; a full piece hands its
last lines on), and small pieces are joined by a second fold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.codechunks import PIECE, preview, right_trimmed, sum_of, tokens_of, trimmed, units

#: Sizes in approximate tokens (fixed values).
MOST, WANTED, LEAST, OVERLAP = 600, 200, 40, 60
HEADING = rf"(?s)\A(#{{1,5}}){text.SPACE}+(.*)\z"
ANY_HEADING = rf"(?m)^#{{2,5}}{text.SPACE}"
CODE_MARK = r"(?mi)```|~~~|^(?: {4}|\t)[^\n]+|<(?:pre|code)[\s>]"
CHUNK = "struct<content: string, line_start: int, line_end: int>"
SECTION = "struct<path: array<string>, start: int, `end`: int>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def leaf_sections(lines: Column) -> Column:
    """(path, start, end) of the headings of levels 2 to 5 that no deeper one follows, lines from 1. Fences are not looked at."""
    listed = F.transform(lines, lambda line, k: F.struct((k + 1).cast("int").alias("line"), F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), trimmed(F.regexp_extract(line, HEADING, 2)).alias("title")))
    titled = F.transform(F.filter(listed, lambda h: h["level"] > 1), lambda h: F.struct(h["line"].alias("line"), h["level"].alias("level"), F.when(h["title"] == "", "Section").otherwise(h["title"]).alias("title")))

    def of(headings: Column) -> Column:
        heading = "struct<line: int, level: int, title: string>"
        start = F.struct(F.array().cast(f"array<{heading}>").alias("open"), F.array().cast("array<array<string>>").alias("paths"))

        def step(state: Column, h: Column) -> Column:
            opened = F.array_append(F.filter(state["open"], lambda x: x["level"] < h["level"]), h)
            return F.struct(opened.alias("open"), F.array_append(state["paths"], F.transform(opened, lambda x: x["title"])).alias("paths"))

        paths = F.aggregate(headings, start, step, lambda s: s["paths"])
        after = lambda k: F.get(headings, k + 1)
        found = F.transform(headings, lambda h, k: F.when(F.coalesce(after(k)["level"] <= h["level"], F.lit(True)), F.struct(
            k.alias("k"), h["line"].alias("start"), F.coalesce(after(k)["line"] - 1, F.size(lines)).cast("int").alias("end"),
        )))
        return let(paths, lambda all_paths: F.transform(F.filter(found, lambda s: s.isNotNull()), lambda s: F.struct(F.get(all_paths, s["k"]).alias("path"), s["start"].alias("start"), s["end"].alias("end"))))

    return let(titled, of)


def line_pieces(lengths: Column) -> Column:
    """Pieces (a, z) of lines from 0 that end where they reach the limit; each starts with the fewest last lines of the one before that hold the overlap."""
    start = F.struct(F.lit(0).alias("first"), F.lit(-1).alias("size"), F.array().cast(f"array<{PIECE}>").alias("out"))

    def kept(first: Column, k: Column) -> Column:
        """How many of the lines first..k are handed on."""
        back = F.reverse(F.slice(lengths, first + 1, k - first + 1))
        none = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("held"))
        more = lambda s, n: F.when(s["held"] >= OVERLAP, s).otherwise(F.struct((s["lines"] + 1).alias("lines"), (s["held"] + tokens_of(n)).alias("held")))
        return F.aggregate(back, none, more, lambda s: s["lines"])

    def step(state: Column, line: Column) -> Column:
        size = state["size"] + line["n"] + 1
        cut = lambda first: F.struct(first.alias("first"), sum_of(F.slice(lengths, first + 1, line["k"] + 1 - first)).alias("size"), F.array_append(state["out"], F.struct(state["first"].alias("a"), line["k"].alias("z"))).alias("out"))
        return F.when(tokens_of(size) >= MOST, let(line["k"] + 1 - kept(state["first"], line["k"]), cut)).otherwise(F.struct(state["first"].alias("first"), size.alias("size"), state["out"].alias("out")))

    lines = F.transform(lengths, lambda n, k: F.struct(n.alias("n"), k.alias("k")))
    rest = lambda s: F.array_append(s["out"], F.struct(s["first"].alias("a"), (F.size(lengths) - 1).alias("z")))
    return F.aggregate(lines, start, step, rest)


def merged(chunks: Column) -> Column:
    """Chunks below the wanted size take in the next one where both fit the limit."""
    start = F.struct(F.get(chunks, F.lit(0)).alias("last"), F.array().cast(f"array<{CHUNK}>").alias("out"))

    def step(state: Column, c: Column) -> Column:
        last = state["last"]
        both = trimmed(F.concat(last["content"], F.lit("\n\n"), c["content"]))
        joined = F.struct(F.struct(both.alias("content"), last["line_start"].alias("line_start"), c["line_end"].alias("line_end")).alias("last"), state["out"].alias("out"))
        fits = (tokens_of(units(last["content"])) < WANTED) & (tokens_of(units(both)) <= MOST)
        return F.when(fits, joined).otherwise(F.struct(c.alias("last"), F.array_append(state["out"], last).alias("out")))

    return F.aggregate(F.slice(chunks, 2, F.size(chunks)), start, step, lambda s: F.array_append(s["out"], s["last"]))


def limited(content: Column, start: Column, end: Column) -> Column:
    """The content as one chunk, or cut at line ends where it reaches the limit, with overlap and small chunks merged."""
    chunk = lambda c, a, z: F.struct(c.alias("content"), a.cast("int").alias("line_start"), z.cast("int").alias("line_end"))

    def cut(lines: Column) -> Column:
        count = F.size(lines)
        last = lambda p, k, n: k == n - 1

        def texts(pieces: Column) -> Column:
            held = F.transform(pieces, lambda p, k: chunk(
                trimmed(F.array_join(F.slice(lines, p["a"] + 1, p["z"] - p["a"] + 1), "\n")),
                F.when(last(p, k, F.size(pieces)), end - (count - p["a"]) + 1).otherwise(start + p["a"]), F.when(last(p, k, F.size(pieces)), end).otherwise(start + p["z"]),
            ))
            return F.filter(held, lambda c: tokens_of(units(c["content"])) >= LEAST)

        whole = F.array(chunk(right_trimmed(F.substring(content, 1, MOST * 4)), start, end))
        return let(let(let(F.transform(lines, units), line_pieces), texts), lambda out: F.when(F.size(out) == 0, whole).otherwise(merged(out)))

    return F.when(tokens_of(units(content)) <= MOST, F.array(chunk(content, start, end))).otherwise(let(F.split(content, "\n", -1), cut))


def markdown_chunks(files: DataFrame, *carried: str) -> DataFrame:
    """Chunks of files (document_id, path, title, prefix array, content) by leaf sections, with the columns ``carried`` of their file; a file without headings is one section under its title."""
    name = trimmed(F.coalesce("title", F.lit("")))
    files = files.select("document_id", F.when(name == "", "Document").otherwise(name).alias("name"), "prefix", "content", *carried)
    crumb = lambda path: text.breadcrumb(F.concat(F.col("prefix"), path))
    under = lambda path, s: F.array_join(F.filter(F.array(crumb(path), s), lambda x: x != ""), "\n\n")
    row = lambda path: lambda c: F.struct(c["content"].alias("content"), crumb(path).alias("context_path"), F.element_at(path, -1).alias("title"), c["line_start"].alias("line_start"), c["line_end"].alias("line_end"))
    own = F.array(F.col("name"))

    def of(lines: Column, clean: Column, body: Column) -> Column:
        def section(s: Column) -> Column:
            held = trimmed(F.array_join(F.slice(clean, s["start"], s["end"] - s["start"] + 1), "\n"))
            return F.transform(let(under(s["path"], held), lambda content: limited(content, s["start"], s["end"])), row(s["path"]))

        def plain(whole: Column) -> Column:
            one = F.array(F.struct(whole.alias("content"), F.lit(1).alias("line_start"), F.size(lines).alias("line_end")))
            single = (tokens_of(units(whole)) <= MOST) & body.rlike(CODE_MARK) & ~body.rlike(ANY_HEADING)
            return F.transform(F.when(single, one).otherwise(limited(whole, F.lit(1), F.size(lines))), row(own))

        by_section = lambda found: F.when(F.size(found) > 0, F.flatten(F.transform(found, section))).otherwise(let(under(own, body), plain))
        return F.when(body != "", let(leaf_sections(lines), by_section))

    cleaned = lambda lines: let(F.transform(lines, right_trimmed), lambda clean: let(trimmed(F.array_join(clean, "\n")), lambda body: of(lines, clean, body)))
    chunks = let(F.split("content", r"\r?\n", -1), cleaned)
    rows = files.select("document_id", *carried, F.posexplode(chunks).alias("position", "c")).select("document_id", *carried, "position", "c.*")
    none = F.lit(None).cast("string")
    return rows.select(
        "document_id", "position", F.lit("doc").alias("chunk_type"), "context_path", "title", preview(F.col("content")).alias("preview"), none.alias("language"),
        none.alias("symbol_name"), none.alias("symbol_type"), none.alias("symbol_id"), none.cast("int").alias("symbol_part_index"), none.cast("int").alias("symbol_part_count"),
        "line_start", "line_end", tokens_of(units(F.col("content"))).alias("token_count"), "content", *carried,
    )

"""Chunks of source files, in columns.

A file's lines and its symbols meet in one row. Pieces of a symbol are a fold over the
lengths of its lines: a piece ends where it reaches the target, and the next one starts
with its last lines. Neighbours of one symbol are joined by a fold over each run of
them, and small chunks that others hold are found by the containment join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import containment, symbols

#: Sizes in approximate tokens and lines (fixed values).
TARGET, OVERLAP_LINES, MOST, JOINED, NESTED = 320, 8, 1000, 800, 50
PREVIEW = 220
#: The characters of ``text.SPACE``.
WHITE = " \t\n\x0b\x0c\r\u00a0\ufeff\u2028\u2029"
PIECE = "struct<a: int, z: int>"


def units(x: Column) -> Column:
    """Length in UTF-16 units."""
    return F.when(F.octet_length(x) == F.length(x), F.length(x)).otherwise((F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int"))


def tokens_of(length: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(length / 4)).cast("int")


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def right_trimmed(x: Column) -> Column:
    return F.rtrim(x, F.lit(WHITE))


def preview(x: Column) -> Column:
    """The preview of a text, of which only the beginning is read where that is long enough."""
    head = text.squeeze(F.substring(x, 1, 4 * PREVIEW))
    return F.when(F.length(head) > PREVIEW, F.concat(F.substring(head, 1, PREVIEW - 3), F.lit("..."))).otherwise(text.preview(x, PREVIEW))


def sum_of(lengths: Column) -> Column:
    """Length of lines joined by line ends."""
    return F.aggregate(lengths, F.lit(-1), lambda total, n: total + n + 1)


def line_windows(lengths: Column, target: int = TARGET, overlap: int = OVERLAP_LINES) -> Column:
    """Pieces (a, z) of lines from 0 that end where they reach ``target`` tokens, each starting with the last ``overlap`` lines before; the last piece takes the rest."""
    start = F.struct(F.lit(0).alias("first"), F.lit(-1).alias("size"), F.array().cast(f"array<{PIECE}>").alias("out"))

    def step(held: Column, line: Column) -> Column:
        size = held["size"] + line["n"] + 1
        first = F.greatest(held["first"], line["k"] + 1 - overlap)
        full = tokens_of(size) >= target
        return F.struct(
            F.when(full, first).otherwise(held["first"]).alias("first"),
            F.when(full, sum_of(F.slice(lengths, first + 1, line["k"] + 1 - first))).otherwise(size).alias("size"),
            F.when(full, F.array_append(held["out"], F.struct(held["first"].alias("a"), line["k"].alias("z")))).otherwise(held["out"]).alias("out"),
        )

    lines = F.transform(lengths, lambda n, k: F.struct(n.alias("n"), k.alias("k")))
    rest = lambda held: F.array_append(held["out"], F.struct(held["first"].alias("a"), (F.size(lengths) - 1).alias("z")))
    return F.aggregate(lines, start, step, rest)


def cut_lines(x: Column, most: int = MOST) -> Column:
    """Parts of a text that end at the line where they reach ``most`` tokens."""
    lines = F.split(x, "\n", -1)
    sized = F.transform(lines, lambda line: F.struct(line.alias("line"), units(line).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(-1).alias("size"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        held, size = F.array_append(state["held"], line["line"]), state["size"] + line["n"] + 1
        full = tokens_of(size) >= most
        return F.struct(
            F.when(full, F.array().cast("array<string>")).otherwise(held).alias("held"), F.when(full, F.lit(-1)).otherwise(size).alias("size"),
            F.when(full, F.array_append(state["out"], F.array_join(held, "\n"))).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(sized, start, step, lambda s: F.when(F.size(s["held"]) > 0, F.array_append(s["out"], F.array_join(s["held"], "\n"))).otherwise(s["out"]))


def fenced(crumb: Column, code: Column, language: Column) -> Column:
    return F.concat(crumb, F.lit("\n\n"), text.code_fence(code, language))


def pieces(files: DataFrame) -> DataFrame:
    """(document_id, path, prefix, language, content, n, piece, line_start, line_end, symbol_name, symbol_type, symbol_id): what each symbol's lines are cut into, or those of a file without symbols, lines from 1; a null piece for a file that has none but blank ones."""
    own = symbols.symbols(files)
    ident = F.concat_ws("-", "symbol_name", "start", "end")
    listed = F.array_sort(F.collect_list(F.struct("line_start", (-F.col("line_end")).alias("back"), "start", "symbol_name", "symbol_type", ident.alias("symbol_id"))))
    rows = files.join(own.groupBy("document_id").agg(listed.alias("symbols")), "document_id", "left")
    lines = F.split("content", "\n", -1)
    rows = rows.withColumn("lines", lines).withColumn("lengths", F.transform(lines, units))
    none = F.lit(None).cast("string")
    whole = F.array(F.struct(F.lit(0).alias("line_start"), (1 - F.size("lines")).alias("back"), F.lit(0).alias("start"), none.alias("symbol_name"), none.alias("symbol_type"), none.alias("symbol_id")))
    rows = rows.withColumn("symbols", F.coalesce("symbols", whole))

    def of(symbol: Column) -> Column:
        at, count = symbol["line_start"], 1 - symbol["back"] - symbol["line_start"]
        return F.transform(line_windows(F.slice("lengths", at + 1, count)), lambda w: F.struct(
            trimmed(F.array_join(F.slice("lines", at + w["a"] + 1, w["z"] - w["a"] + 1), "\n")).alias("piece"), (at + w["a"] + 1).alias("line_start"), (at + w["z"] + 1).alias("line_end"),
            symbol["symbol_name"].alias("symbol_name"), symbol["symbol_type"].alias("symbol_type"), symbol["symbol_id"].alias("symbol_id"),
        ))

    found = F.filter(F.flatten(F.transform("symbols", of)), lambda p: p["piece"] != "")
    kept = rows.select("document_id", "path", "prefix", "language", "content", found.alias("found"))
    return kept.select("document_id", "path", "prefix", "language", "content", F.posexplode_outer("found").alias("n", "p")).select("document_id", "path", "prefix", "language", "content", F.coalesce("n", F.lit(0)).alias("n"), "p.*")


def drafts(files: DataFrame) -> DataFrame:
    """One row a piece, with breadcrumb and fence; a piece over the limit is cut at line ends, and a file without pieces is one chunk without lines."""
    rows = pieces(files)
    crumb = text.breadcrumb(F.concat(F.col("prefix"), F.array("path", "symbol_name")))
    rows = rows.withColumn("context_path", crumb).withColumn("big", F.col("piece").isNotNull() & (tokens_of(units(fenced(F.col("context_path"), F.col("piece"), F.col("language")))) > MOST))
    parts = F.when(F.col("big"), cut_lines(F.col("piece"))).otherwise(F.array(F.coalesce("piece", "content")))
    rows = rows.withColumn("symbol_part_count", F.when(F.col("big"), F.size(parts))).select("*", F.posexplode(parts).alias("part", "code"))
    return rows.select(
        "document_id", "language", "context_path", "n", "part", "symbol_name", "symbol_type", "symbol_id", F.when(F.col("big"), F.col("part")).alias("symbol_part_index"), "symbol_part_count",
        "line_start", "line_end", F.coalesce("symbol_name", F.substring_index("context_path", "/", -1)).alias("title"), preview(F.col("code")).alias("preview"),
        right_trimmed(F.col("code")).alias("code"),
    )


FOLDED = ["symbol_name", "symbol_type", "symbol_id", "symbol_part_index", "symbol_part_count", "line_start", "line_end", "title", "preview", "code"]


def joined(rows: DataFrame) -> DataFrame:
    """Neighbours of one symbol become one chunk while they fit together: a fold over each run of drafts with one name, kind and context."""
    order = Window.partitionBy("document_id").orderBy("n", "part")
    same = F.struct("symbol_name", "symbol_type", "context_path")
    fresh = F.col("symbol_name").isNull() | ~F.lag(same).over(order).eqNullSafe(same)
    rows = rows.withColumn("run", F.sum(fresh.cast("int")).over(order))
    item = F.struct("n", "part", *FOLDED)
    runs = rows.groupBy("document_id", "run").agg(F.first("language").alias("language"), F.first("context_path").alias("context_path"), F.array_sort(F.collect_list(item)).alias("items"))
    first, others = F.get("items", F.lit(0)), F.slice("items", 2, F.size("items"))
    kind = rows.select(item.alias("i")).schema["i"].dataType.simpleString()

    def step(state: Column, after: Column) -> Column:
        last = state["last"]
        code = trimmed(F.concat(last["code"], F.lit("\n"), after["code"]))
        fits = tokens_of(units(fenced(F.col("context_path"), code, F.col("language")))) <= JOINED
        changed = {
            "code": code, "preview": preview(code), "line_start": F.least(last["line_start"], after["line_start"]), "line_end": F.greatest(last["line_end"], after["line_end"]),
            "symbol_part_index": F.lit(None).cast("int"), "symbol_part_count": F.lit(None).cast("int"),
        }
        both = F.struct(*[changed.get(c, last[c]).alias(c) for c in ("n", "part", *FOLDED)])
        return F.struct(F.when(fits, both).otherwise(after).cast(kind).alias("last"), F.when(fits, state["out"]).otherwise(F.array_append(state["out"], last)).alias("out"))

    start = F.struct(first.cast(kind).alias("last"), F.array().cast(f"array<{kind}>").alias("out"))
    folded = F.aggregate(others, start, step, lambda s: F.array_append(s["out"], s["last"]))
    return runs.select("document_id", "language", "context_path", F.explode(folded).alias("i")).select("document_id", "language", "context_path", "i.*")


def code_chunks(files: DataFrame) -> DataFrame:
    """Chunks of files (document_id, path, prefix array, language, content) by symbols and lines, without those that others hold."""
    rows = joined(drafts(files)).withColumn("content", fenced(F.col("context_path"), F.col("code"), F.col("language")))
    rows = rows.withColumn("token_count", tokens_of(units(F.col("content")))).withColumn("place", F.struct("n", "part"))
    rows = containment.without_nested(rows, NESTED, position="place")
    position = F.row_number().over(Window.partitionBy("document_id").orderBy("place")) - 1
    return rows.withColumn("position", position.cast("int")).withColumn("chunk_type", F.lit("code")).drop("place", "n", "part", "code")

"""Symbols of source files, in columns: declarations and where their blocks end.

Brace languages: a pattern whose alternatives cover every character cuts a file into
tokens (comments, strings, brackets, the text between). A running sum over the tokens
gives offsets, lines and the depth of brackets; an opening bracket's partner is the next
bracket of its depth. What stands between a bracket and the boundary before it is its
header, and a header that declares something makes the block a symbol. Extra closing
brackets lower the depth for all that follows and so disturb no pair; brackets in
comments and strings are never seen.

Python: a block ends before the next line of code that is indented no more than its
declaration; for each indent of declarations the lines at or left of it are one window.
Ruby and Lua: a block ends at the next ``end`` with the declaration's indent.

There is no grammar: anonymous functions are no symbols, and of several declarations in
one header the last counts. Languages without symbols (styles, data, shells) give none;
their brackets can be asked for all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BRACE_LANGUAGES = ["typescript", "tsx", "javascript", "jsx", "go", "rust", "java", "kotlin", "swift", "php", "c", "cpp", "c_sharp", "scala"]
#: Comments, strings and what else is one token; the last two alternatives take all the rest.
TOKEN = (
    r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/|\"[^\"\\\n]*+(?:\\[\s\S][^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
    r"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`|[{};]|[^{};\"'`/]++|[\s\S]"
)
PYTHON_TOKEN = (
    r"#[^\n]*+|\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|\"[^\"\\\n]*+(?:\\[\s\S][^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'|[^#\"']++|[\s\S]"
)
QUOTED = r"\A(?://|/\*|#|\"[\s\S]|'[\s\S]|`[\s\S])"
MODIFIERS = "export|default|public|private|protected|internal|static|final|abstract|async|pub(?:\\([a-z]+\\))?|open|override|inline|virtual|const|unsafe"
WORDS = r"function\*?|func|fn|fun|def|class|interface|struct|enum|trait|impl"
#: Groups: what stands before, indent, word, its name, name of a method.
HEADER = (
    rf"(?s)\A(|.*\n)([ \t]*)(?:(?:{MODIFIERS})\s+)*+(?:({WORDS})\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*+).*"
    r"|([A-Za-z_$][\w$]*+)\s*\([^;{}]*\)\s*(?::\s*[^{;=]+)?)\z"
)
#: Names before a bracketed list that declare nothing.
NOT_METHODS = ["if", "for", "while", "switch", "catch", "return", "function", "with", "do", "else", "match", "loop", "using", "lock"]
#: Symbol kinds of declaring words whose kind isn't their own name.
KINDS = {
    "function": "function_declaration", "function*": "function_declaration", "func": "function_declaration", "fn": "function_item", "fun": "function_declaration",
    "def": "method", "trait": "interface_declaration", "impl": "class_declaration",
}
SYMBOL = "symbol_name string, symbol_type string, start int, `end` int, line_start int, line_end int"


def bare(token: Column) -> Column:
    """The token, with comments and strings blank but for their line ends."""
    return F.when(token.rlike(QUOTED), F.regexp_replace(token, r"[^\n]", " ")).otherwise(token)


def line_ends(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def tokens(files: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """(document_id, n, token, offset, line) of files (document_id, content): tokens in order, with the characters and line ends before each."""
    rows = files.select("document_id", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("n", "token"))
    before = Window.partitionBy("document_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0)).cast("int")
    return rows.select("document_id", "n", "token", total(F.length("token")).alias("offset"), total(line_ends(F.col("token"))).alias("line"))


def headed_brackets(files: DataFrame) -> DataFrame:
    """(document_id, header, header_offset, header_line, offset, line, closed_offset, closed_line, depth) of every opening bracket; null closing places: never closed."""
    rows = tokens(files)
    order = Window.partitionBy("document_id").orderBy("n")
    boundary = F.col("token").isin("{", "}", ";")
    part = F.coalesce(F.sum(boundary.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = boundary.cast("int")
    parts = rows.withColumn("part", part).groupBy("document_id", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~boundary, F.struct("n", bare(F.col("token")).alias("t"))))), lambda x: x.t), "").alias("header"),
        F.min("offset").alias("header_offset"), F.min("line").alias("header_line"),
        F.max(F.when(boundary, F.col("token"))).alias("token"), F.max("offset").alias("offset"), F.max(F.when(edge == 1, F.col("line"))).alias("line"),
    )
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    by_part = Window.partitionBy("document_id").orderBy("part")
    after = F.sum(step).over(by_part.rowsBetween(Window.unboundedPreceding, 0))
    brackets = parts.withColumn("depth", after - F.least(step, F.lit(0))).filter("token in ('{', '}')")
    alike = Window.partitionBy("document_id", "depth").orderBy("part")
    closed = brackets.withColumn("closed_offset", F.lead("offset").over(alike)).withColumn("closed_line", F.lead("line").over(alike))
    return closed.filter("token = '{'").drop("token", "part")


def brackets(files: DataFrame) -> DataFrame:
    """(document_id, opened, closed, depth) of every pair of braces outside comments and strings, in characters from 0."""
    rows = headed_brackets(files).filter("closed_offset is not null")
    least = F.min("depth").over(Window.partitionBy("document_id"))
    return rows.select("document_id", F.col("offset").alias("opened"), F.col("closed_offset").alias("closed"), (F.col("depth") - least + 1).cast("int").alias("depth"))


def brace_symbols(files: DataFrame) -> DataFrame:
    part = lambda k: F.nullif(F.regexp_extract("header", HEADER, k), F.lit(""))
    rows = headed_brackets(files).filter("closed_offset is not null").filter(F.col("header").rlike(HEADER))
    rows = rows.withColumn("word", part(3)).withColumn("method", part(5)).filter(~F.coalesce(F.col("method").isin(NOT_METHODS), F.lit(False)))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    kind = F.when(F.col("word").isNull(), "method_definition").otherwise(F.coalesce(F.try_element_at(kinds, "word"), F.concat("word", F.lit("_declaration"))))
    ahead = F.regexp_extract("header", HEADER, 1)
    start = F.col("header_offset") + F.length(ahead) + F.length(F.regexp_extract("header", HEADER, 2))
    return rows.select(
        "document_id", F.coalesce(part(4), F.col("method")).alias("symbol_name"), kind.alias("symbol_type"), start.cast("int").alias("start"), (F.col("closed_offset") + 1).cast("int").alias("end"),
        (F.col("header_line") + line_ends(ahead)).cast("int").alias("line_start"), F.col("closed_line").cast("int").alias("line_end"),
    )


def _lines(files: DataFrame, content: Column) -> DataFrame:
    return files.select("document_id", F.posexplode(F.split(content, "\n", -1)).alias("line", "text"))


def python_symbols(files: DataFrame) -> DataFrame:
    clean = F.array_join(F.transform(F.regexp_extract_all("content", F.lit(PYTHON_TOKEN), F.lit(0)), bare), "")
    order = Window.partitionBy("document_id").orderBy("line")
    count = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    rows = _lines(files, clean).withColumn("open", F.coalesce(F.sum(count("([{") - count(")]}")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("indent", F.length(F.regexp_extract("text", r"\A([ \t]*)", 1)))
    # the last line of a bracketed list or a string belongs to the block as well
    code = rows.filter("open <= 0 and text rlike '[^ \\t\\r]'")
    ends = rows.filter("open > 0 or text rlike '[^ \\t\\r]'").select("document_id", "line").withColumn("previous", F.lag("line").over(order))
    last = ends.groupBy("document_id").agg(F.max("line").alias("last"))
    declared = F.regexp_extract("text", r"\A[ \t]*(?:async[ \t]+)?(def|class)[ \t]+(\w+)", 1)
    code = code.withColumn("word", declared).withColumn("name", F.regexp_extract("text", r"\A[ \t]*(?:async[ \t]+)?(def|class)[ \t]+(\w+)", 2))
    indents = code.filter("word <> ''").select("document_id", F.col("indent").alias("level")).distinct()
    left = code.join(indents, "document_id").filter("indent <= level")
    left = left.withColumn("next", F.lead("line").over(Window.partitionBy("document_id", "level").orderBy("line"))).filter("word <> '' and indent = level")
    found = left.join(ends.select("document_id", F.col("line").alias("next"), "previous"), ["document_id", "next"], "left").join(last, "document_id")
    kind = F.when(F.col("word") == "class", "class_definition").otherwise("function_definition")
    row = (F.col("line") + 1).cast("int")
    stop = F.coalesce("previous", "last")
    return found.select("document_id", F.col("name").alias("symbol_name"), kind.alias("symbol_type"), row.alias("start"), (stop + 1).cast("int").alias("end"), F.col("line").cast("int").alias("line_start"), stop.cast("int").alias("line_end"))


#: Declarations that an ``end`` closes: pattern (indent, word, name) and kinds by word.
END_BLOCKS = {
    "ruby": (r"\A([ \t]*)(def|class|module)\s+((?:self\.)?[\w:]+[?!=]?)", {"def": "method", "class": "class", "module": "module"}),
    "lua": (r"\A([ \t]*)(?:local\s+)?(function)\s+([\w.:]+)\s*\(", {"function": "function_declaration"}),
}


def end_symbols(files: DataFrame, language: str) -> DataFrame:
    pattern, kinds = END_BLOCKS[language]
    rows = _lines(files, F.col("content")).withColumn("indent", F.regexp_extract("text", r"\A([ \t]*)", 1)).withColumn("word", F.regexp_extract("text", pattern, 2))
    rows = rows.withColumn("closes", F.when(F.col("text").rlike(r"\A[ \t]*end\b"), F.col("line"))).filter("word <> '' or closes is not null")
    after = Window.partitionBy("document_id", "indent").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    last = F.when(F.col("text").rlike(r"\bend\s*\z"), F.col("line")).otherwise(F.first("closes", ignorenulls=True).over(after))
    known = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    found = rows.withColumn("last", last).filter("word <> '' and last is not null")
    row = (F.col("line") + 1).cast("int")
    return found.select(
        "document_id", F.regexp_extract("text", pattern, 3).alias("symbol_name"), F.element_at(known, F.col("word")).alias("symbol_type"), row.alias("start"), (F.col("last") + 1).cast("int").alias("end"),
        F.col("line").cast("int").alias("line_start"), F.col("last").cast("int").alias("line_end"),
    )


def symbols(files: DataFrame) -> DataFrame:
    """(document_id, symbol_name, symbol_type, start, end, line_start, line_end) of files (document_id, language, content).

    Lines count from 0. ``start`` and ``end`` are characters in brace languages and lines
    from 1 in the others; both are part of a symbol's identifier.
    """
    out = brace_symbols(files.filter(F.col("language").isin(BRACE_LANGUAGES))).unionByName(python_symbols(files.filter("language = 'python'")))
    for language in END_BLOCKS:
        out = out.unionByName(end_symbols(files.filter(F.col("language") == language), language))
    return out

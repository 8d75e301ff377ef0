"""Text expressions: sizes, previews, breadcrumbs, titles, gates, slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of documentation files (fixed values).
DOC_EXTENSIONS = ["md", "mdx", "markdown", "rst", "adoc", "txt"]
#: Language of a source file by its extension (fixed values).
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript",
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "swift": "swift", "rb": "ruby",
    "php": "php", "c": "c", "cpp": "cpp", "cxx": "cpp", "scala": "scala", "sh": "bash", "bash": "bash", "lua": "lua",
    "css": "css", "html": "html", "json": "json",
}
SPACE = r"[\s ﻿  ]"


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.btrim(F.regexp_replace(text, rf"{SPACE}+", " "))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def preview(text: Column, limit: int = 220) -> Column:
    flat = squeeze(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, max(0, limit - 3)), F.lit("...")))


def clamp(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(F.substring(text, 1, limit), rf"{SPACE}+\z", ""))


def code_fence(code: Column, language: Column | None = None) -> Column:
    label = F.lit("") if language is None else F.coalesce(language, F.lit(""))
    return F.concat(F.lit("```"), label, F.lit("\n"), F.regexp_replace(code, rf"{SPACE}+\z", ""), F.lit("\n```"))


def breadcrumb(segments: Column) -> Column:
    """Trimmed non-empty segments, none equal to the one before, joined by ' > '."""
    clean = F.filter(F.transform(segments, lambda x: F.btrim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    fresh = F.filter(clean, lambda x, i: (i == 0) | (x != F.get(clean, i - 1)))
    return F.array_join(fresh, " > ")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def extension(path: Column) -> Column:
    """Lower-case extension of the base name; empty without a dot."""
    base = F.lower(F.substring_index(path, "/", -1))
    return F.when(base == "dockerfile", F.lit("dockerfile")).when(base.contains("."), F.substring_index(base, ".", -1)).otherwise(F.lit(""))


def language(path: Column) -> Column:
    ext = extension(path)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(ext == "", F.lit(None).cast("string")).otherwise(F.coalesce(F.try_element_at(known, ext), ext))


def is_doc(path: Column) -> Column:
    return extension(path).isin(DOC_EXTENSIONS)


def document_title(text: Column) -> Column:
    """Heading text when the first non-blank line is '# x', else null."""
    first = F.get(F.filter(F.split(text, r"\r?\n", -1), lambda x: F.btrim(x) != ""), F.lit(0))
    title = F.btrim(F.regexp_extract(F.btrim(first), r"^#\s+(.+)\z", 1))
    return F.when(title != "", title)


def markdown_title(text: Column, url: Column) -> Column:
    """First '# x' line anywhere, else the last path segment without .md, else the host."""
    head = F.btrim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    leaf = F.regexp_replace(F.substring_index(F.try_parse_url(url, F.lit("PATH")), "/", -1), r"\.md\z", "")
    return F.coalesce(F.when(head != "", head), F.when(leaf != "", leaf), F.try_parse_url(url, F.lit("HOST")), url)


def repo_uri(owner: Column, repo: Column, ref: Column, path: Column) -> Column:
    return F.concat(F.lit("gh://"), owner, F.lit("/"), repo, F.lit("@"), ref, F.lit("/"), path)


def web_uri(host: Column, path: Column) -> Column:
    """The reader's form of a page address: host and path without a separator."""
    return F.concat(F.lit("web://"), host, path)


def has_code(text: Column) -> Column:
    """Fence, indented line, or pre/code tag."""
    return text.contains("```") | text.contains("~~~") | text.rlike(r"(?m)^(?: {4}|\t).+") | text.rlike(r"(?i)<(pre|code)[\s>]")


def has_snippets(text: Column) -> Column:
    """Closed fence or inline code."""
    return text.rlike(r"(?s)```.*?```") | text.rlike(r"(?s)~~~.*?~~~") | text.rlike(r"`[^`]+`")


def body_length(text: Column) -> Column:
    """Characters that are no white space, without leading front matter."""
    return F.length(F.regexp_replace(F.regexp_replace(text, r"(?s)\A---.*?---\s*", ""), rf"{SPACE}+", ""))


def looks_like_markdown(text: Column) -> Column:
    head = F.lower(F.substring(F.regexp_replace(text, rf"\A{SPACE}+", ""), 1, 200))
    marks = (
        text.rlike(r"(^|\n)#{1,6}\s+\S") | text.contains("```") | text.contains("~~~")
        | text.rlike(r"\[[^\]]+\]\([^)]+\)") | text.rlike(r"(^|\n)\s*[-*+]\s+\S")
    )
    return (head != "") & ~head.contains("<!doctype") & ~head.contains("<html") & marks


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (1-based, inclusive, clamped); CRLF counts as one line end."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(lines))
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


#: Limits of a slice: lines spanned and UTF-8 bytes returned (fixed values).
MAX_SPAN, MAX_BYTES = 400, 4096


def slice_error(text: Column, spec: Column) -> Column:
    """Why 'a:b' can't be cut from a text; null if it can."""
    a = F.expr("try_cast(null as int)") if spec is None else F.regexp_extract(spec, r"\A(\d+):(\d+)\z", 1).try_cast("int")
    b = F.regexp_extract(spec, r"\A(\d+):(\d+)\z", 2).try_cast("int")
    lines = F.size(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1))
    cut = line_slice(text, a, b)
    return (
        F.when(~spec.contains(":"), "slice must be start:end")
        .when(a.isNull() | b.isNull(), "slice bounds must be numbers")
        .when(b < a, "slice end lies before its start")
        .when(b - a >= MAX_SPAN, "slice spans too many lines")
        .when(F.greatest(a, F.lit(1)) > lines, "slice starts after the last line")
        .when(F.octet_length(cut) > MAX_BYTES, "slice holds too many bytes")
    )

"""Chunking of one document in plain Python: what the columns of the library are tested against."""

from __future__ import annotations

import ast
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

from quarry.functions.text import LANGUAGES

#: Sizes in approximate tokens, lines and characters (fixed values).
DOC_MAX, DOC_WANTED, DOC_MIN, DOC_OVERLAP = 600, 200, 40, 60
CODE_TARGET, CODE_OVERLAP_LINES, CODE_MAX, CODE_MERGED, CODE_NESTED = 320, 8, 1000, 800, 50
PREVIEW = 220

LINES = re.compile(r"\r?\n")
HEADING = re.compile(r"(#{1,5})\s+(.*)")
CODE_MARK = re.compile(r"```|~~~|^(?: {4}|\t).+|<(?:pre|code)[\s>]", re.M | re.I)


def units(text: str) -> int:
    """Length in UTF-16 units, the measure of the token estimate."""
    return len(text) + sum(1 for c in text if c > "￿") if not text.isascii() else len(text)


def tokens_of(length: int) -> int:
    return max(1, math.ceil(length / 4))


def tokens(text: str) -> int:
    return tokens_of(units(text))


def preview(text: str, limit: int = PREVIEW) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= limit else flat[: limit - 3] + "..."


def breadcrumb(segments: list[str | None]) -> str:
    out: list[str] = []
    for s in segments:
        s = (s or "").strip()
        if s and out[-1:] != [s]:
            out.append(s)
    return " > ".join(out)


@dataclass(frozen=True)
class Chunk:
    content: str
    context_path: str
    title: str
    line_start: int | None
    line_end: int | None
    chunk_type: str = "doc"
    preview: str = ""
    language: str | None = None
    symbol_name: str | None = None
    symbol_type: str | None = None
    symbol_id: str | None = None
    symbol_part_index: int | None = None
    symbol_part_count: int | None = None

    @property
    def token_count(self) -> int:
        return tokens(self.content)


def doc_chunk(content: str, crumb: str, title: str, start: int, end: int) -> Chunk:
    return Chunk(content, crumb, title, start, end, preview=preview(content))


# Markdown.


@dataclass
class Section:
    path: list[str]
    level: int
    start: int
    end: int
    leaf: bool = True


def sections(lines: list[str]) -> list[Section]:
    """Sections of the headings of levels 2 to 5, with their ancestors' titles. Fences are not looked at."""
    out: list[Section] = []
    open_: list[Section] = []
    for n, line in enumerate(lines, 1):
        m = HEADING.fullmatch(line)
        if not m or len(m[1]) == 1:
            continue
        while open_ and open_[-1].level >= len(m[1]):
            open_.pop().end = n - 1
        if open_:
            open_[-1].leaf = False
        own = Section([*(open_[-1].path if open_ else []), m[2].strip() or "Section"], len(m[1]), n, len(lines))
        out.append(own)
        open_.append(own)
    return out


def overlap(lines: list[str], want: int) -> list[str]:
    """Fewest last lines that hold ``want`` tokens."""
    held = 0
    for k in range(len(lines) - 1, -1, -1):
        held += tokens(lines[k])
        if held >= want:
            return lines[k:]
    return list(lines)


def limited(content: str, crumb: str, title: str, start: int, end: int) -> list[Chunk]:
    """The content as one chunk, or cut at line ends where it reaches the limit, with overlap and small chunks merged."""
    if tokens(content) <= DOC_MAX:
        return [doc_chunk(content, crumb, title, start, end)]
    out: list[Chunk] = []
    held: list[str] = []
    size = -1  # of the held lines, joined

    def emit(first: int, last: int) -> None:
        text = "\n".join(held).strip()
        if tokens(text) >= DOC_MIN:
            out.append(doc_chunk(text, crumb, title, first, last))

    for at, line in enumerate(content.split("\n")):
        held.append(line)
        size += units(line) + 1
        if tokens_of(size) >= DOC_MAX:
            emit(start + at - len(held) + 1, start + at)
            held = overlap(held, DOC_OVERLAP)
            size = sum(units(x) + 1 for x in held) - 1
    emit(end - len(held) + 1, end)
    if not out:
        out = [doc_chunk(content[: DOC_MAX * 4].rstrip(), crumb, title, start, end)]
    return merged(out)


def merged(chunks: list[Chunk]) -> list[Chunk]:
    """Chunks below the wanted size take in the next one where both fit the limit."""
    out: list[Chunk] = []
    for c in chunks:
        if out and out[-1].token_count < DOC_WANTED:
            both = f"{out[-1].content}\n\n{c.content}".strip()
            if tokens(both) <= DOC_MAX:
                out[-1] = replace(out[-1], content=both, preview=preview(both), line_end=c.line_end)
                continue
        out.append(c)
    return out


def markdown_chunks(text: str, title: str | None = None, prefix: list[str] | None = None) -> list[Chunk]:
    name, prefix = (title or "Document").strip() or "Document", prefix or []
    lines = LINES.split(text)
    clean = [x.rstrip() for x in lines]
    body = "\n".join(clean).strip()
    under = lambda path, s: "\n\n".join(x for x in (breadcrumb([*prefix, *path]), s) if x)
    whole = under([name], body)
    if body and not re.search(r"^#{2,5}\s", body, re.M) and CODE_MARK.search(body) and tokens(whole) <= DOC_MAX:
        return [doc_chunk(whole, breadcrumb([*prefix, name]), name, 1, len(lines))]
    out: list[Chunk] = []
    for s in sections(lines):
        own = "\n".join(clean[s.start - 1 : s.end]).strip()
        if s.leaf and own:
            out += limited(under(s.path, own), breadcrumb([*prefix, *s.path]), s.path[-1], s.start, s.end)
    if not out and body:
        out = limited(whole, breadcrumb([*prefix, name]), name, 1, len(lines))
    return out


# Code.


@dataclass(frozen=True)
class Symbol:
    kind: str
    name: str | None
    start: int  # first and last line, from 0
    end: int
    key: str


#: Declarations of brace languages: kind and the group of the name (patterns are ours).
DECLARATION = re.compile(
    r"^[ \t]*(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|pub(?:\([a-z]+\))?|open|override|inline|virtual|const|unsafe)\s+)*"
    r"(?:(?P<kind>function\*?|func|fn|fun|def|class|interface|struct|enum|trait|impl)\s+(?:\([^)]*\)\s*)?(?P<name>[A-Za-z_$][\w$]*)"
    r"|(?P<method>[A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?::\s*[^{;=]+)?\{)",
    re.M,
)
KINDS = {"function": "function_declaration", "function*": "function_declaration", "func": "function_declaration", "fn": "function_item", "fun": "function_declaration", "def": "method", "trait": "interface_declaration", "impl": "class_declaration"}
BRACED = set(LANGUAGES.values()) - {"bash", "css", "html", "json", "python", "ruby", "lua"}
CONTROL = {"if", "for", "while", "switch", "catch", "return", "function", "with", "do", "else", "match", "loop", "using", "lock"}


def python_symbols(code: str) -> list[Symbol]:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            out.append(Symbol(kind, node.name, node.lineno - 1, node.end_lineno - 1, f"{node.name}-{node.lineno}-{node.end_lineno}"))
    return sorted(out, key=lambda s: (s.start, -s.end))


def brace_symbols(code: str) -> list[Symbol]:
    """Declarations with a braced body; the body ends at the matching brace outside strings and comments."""
    bare = re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", lambda m: re.sub(r"[^\n]", " ", m[0]), code, flags=re.S)
    closes: dict[int, int] = {}
    open_: list[int] = []
    for m in re.finditer(r"[{}]", bare):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            closes[open_.pop()] = m.start()
    out = []
    for m in DECLARATION.finditer(bare):
        word, method = m["kind"], m["method"]
        if method in CONTROL:
            continue
        at = m.end() - 1 if method else bare.find("{", m.end())
        stop = bare.find(";", m.end())
        if at < 0 or at not in closes or (not method and 0 <= stop < at):
            continue
        first = m.start() + len(m[0]) - len(m[0].lstrip())
        name = m["name"] or method
        kind = "method_definition" if method else KINDS.get(word, f"{word}_declaration")
        out.append(Symbol(kind, name, code.count("\n", 0, first), code.count("\n", 0, closes[at]), f"{name}-{first}-{closes[at] + 1}"))
    return sorted(out, key=lambda s: (s.start, -s.end))


#: Declarations of languages whose blocks run to an ``end`` of the same indent: their kinds by word (patterns are ours).
END_BLOCKS = {
    "ruby": (re.compile(r"^([ \t]*)(def|class|module)\s+((?:self\.)?[\w:]+[?!=]?)", re.M), {"def": "method", "class": "class", "module": "module"}),
    "lua": (re.compile(r"^([ \t]*)(?:local\s+)?(function)\s+([\w.:]+)\s*\(", re.M), {"function": "function_declaration"}),
}


def end_symbols(code: str, language: str) -> list[Symbol]:
    """Declarations whose body ends at the next ``end`` with their indent; those on one line end there."""
    pattern, kinds = END_BLOCKS[language]
    lines = code.split("\n")
    ends: dict[str, list[int]] = {}
    for k, line in enumerate(lines):
        if re.match(r"[ \t]*end\b", line):
            ends.setdefault(line[: len(line) - len(line.lstrip())], []).append(k)
    out = []
    for m in pattern.finditer(code):
        first = code.count("\n", 0, m.start())
        own = ends.get(m[1], [])
        at = bisect_right(own, first)
        last = first if re.search(r"\bend\s*$", lines[first]) else own[at] if at < len(own) else None
        if last is not None:
            out.append(Symbol(kinds[m[2]], m[3], first, last, f"{m[3]}-{first + 1}-{last + 1}"))
    return sorted(out, key=lambda s: (s.start, -s.end))


def symbols_of(code: str, language: str | None) -> list[Symbol]:
    if language == "python":
        return python_symbols(code)
    if language in END_BLOCKS:
        return end_symbols(code, language)
    return brace_symbols(code) if language in BRACED else []


def windows(lines: list[str]) -> Iterator[tuple[int, int]]:
    """(first, last) line of pieces that end where they reach the target, each starting with the last lines of the one before."""
    first, size = 0, -1
    for k, line in enumerate(lines):
        size += units(line) + 1
        if tokens_of(size) >= CODE_TARGET:
            yield first, k
            first = max(first, k + 1 - CODE_OVERLAP_LINES)
            size = sum(units(x) + 1 for x in lines[first : k + 1]) - 1
    if lines:
        yield first, len(lines) - 1


def fenced(crumb: str, code: str, language: str | None) -> str:
    return f"{crumb}\n\n```{language or ''}\n{code.rstrip()}\n```"


def code_in(content: str) -> str:
    m = re.search(r"```[^\n]*\n(.*)```", content, re.S)
    return (m[1].rstrip() if m and m[1] else content.strip())


def code_pieces(code: str, language: str | None) -> Iterator[tuple[str, int, int, Symbol | None]]:
    lines = code.split("\n")
    for s in symbols_of(code, language) or [None]:
        at, own = (s.start, lines[s.start : s.end + 1]) if s else (0, lines)
        for a, b in windows(own):
            yield "\n".join(own[a : b + 1]), at + a + 1, at + b + 1, s


def parts_of(text: str) -> list[str]:
    """Cuts at line ends where a part reaches the maximum."""
    out, held, size = [], [], -1
    for line in text.split("\n"):
        held.append(line)
        size += units(line) + 1
        if tokens_of(size) >= CODE_MAX:
            out.append("\n".join(held))
            held, size = [], -1
    return [*out, "\n".join(held)] if held else out


def code_chunks(code: str, path: str, language: str | None = None, prefix: list[str] | None = None) -> list[Chunk]:
    out: list[Chunk] = []
    for piece, start, end, s in code_pieces(code, language):
        text = piece.strip()
        if not text:
            continue
        name = s.name if s else None
        crumb = breadcrumb([*(prefix or []), path, name])
        big = tokens(fenced(crumb, text, language)) > CODE_MAX
        parts = parts_of(text) if big else [text]
        for k, part in enumerate(parts):
            out.append(
                Chunk(
                    fenced(crumb, part, language), crumb, name or crumb.rsplit("/", 1)[-1], start, end, "code", preview(part), language,
                    name, s.kind if s else None, s.key if s else None, k if big else None, len(parts) if big else None,
                )
            )
    if not out:
        crumb = breadcrumb([*(prefix or []), path])
        return [Chunk(fenced(crumb, code, language), crumb, path.rsplit("/", 1)[-1], None, None, "code", preview(code), language)]
    return without_nested(joined_symbols(out))


def joined_symbols(chunks: list[Chunk]) -> list[Chunk]:
    """Neighbours of one symbol become one chunk while they fit together."""
    out: list[Chunk] = []
    for c in chunks:
        same = lambda x: (x.symbol_name, x.symbol_type, x.context_path, x.language)
        if out and c.symbol_name is not None and same(out[-1]) == same(c):
            a = out[-1]
            code = f"{code_in(a.content)}\n{code_in(c.content)}".strip()
            content = fenced(a.context_path, code, a.language)
            if tokens(content) <= CODE_MERGED:
                out[-1] = replace(a, content=content, preview=preview(code), line_start=min(a.line_start, c.line_start), line_end=max(a.line_end, c.line_end), symbol_part_index=None, symbol_part_count=None)
                continue
        out.append(c)
    return out


def without_nested(chunks: list[Chunk]) -> list[Chunk]:
    """Tiny chunks whose lines and code another chunk holds are dropped."""
    if len(chunks) < 2:
        return chunks
    codes = [code_in(c.content) for c in chunks]

    def inside(k: int) -> bool:
        c = chunks[k]
        return c.token_count < CODE_NESTED and bool(codes[k]) and any(
            j != k and o.line_start <= c.line_start and o.line_end >= c.line_end and codes[k] in codes[j] for j, o in enumerate(chunks)
        )

    return [c for k, c in enumerate(chunks) if not inside(k)]

"""Secret scans: fixed patterns, and password guess costs for values in a credential context.

The guess cost of a value is the least sum, over all cuts of it into spans, of the
log10 guesses of each span: dictionary words (any case, common substitutions;
passwords first, then the words of a public vocabulary by their frequency there),
dates, repeats (a unit of any length and all the copies that follow it), walks over
neighbouring keys or through alphabet and digits (of three keys and more, cut
anywhere), or brute force a character. Values next to a credential word whose cost
reaches ``min_cost`` become spans of kind ``value``, unless they overlap a base span.

Defined cases: null or empty text has no spans; very long values are costed whole
(the work is n log n in their length); repeated rows give repeated results; a null
doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm import common

KINDS = ("assign", "access", "hex", "value")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A run of 16 or 32 characters of a greedy run is the run itself, so lengths can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+)["']?([!-~]{6,})""",
    re.ASCII | re.IGNORECASE,
)
CUE = re.compile(r"pass|pwd|secret|token|key|credential|auth", re.ASCII | re.IGNORECASE)

#: Common words of passwords, most frequent first; the rank is the guess number (fixed values).
COMMON = (
    "password passwd pass admin welcome login master dragon monkey letmein qwerty secret summer winter spring autumn "
    "football baseball soccer hockey shadow sunshine princess iloveyou trustno hello freedom whatever ninja mustang "
    "access batman superman starwars michael jordan thomas daniel robert maria anna test user root guest default "
    "changeme example company database server system manager service demo sample orange purple yellow silver golden "
    "tiger lion eagle horse battery staple correct river mountain ocean coffee cookie flower computer internet "
    "123456 12345678 123456789 123123 111111 654321 666666 qwerty123 abc123 1q2w3e 1q2w3e4r zaq12wsx qazwsx qazwsxedc "
    "asdfgh zxcvbn passw0rd hunter killer pepper ginger buster jennifer joshua maggie charlie matthew andrew michelle "
    "jessica ashley amanda nicole hannah chelsea arsenal liverpool barcelona samsung google pokemon naruto matrix "
    "cheese chocolate butterfly rainbow diamond crystal phoenix thunder lucky money love angel devil heaven forever"
).split()
LEET = str.maketrans("043157$@!", "oaeistsai")
#: Keyboard rows, each half a key to the right of the one above, and sequences (fixed values).
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
WALK, STEP, TURN = math.log10(94), 0.2, math.log10(4)


def neighbours() -> dict[tuple[str, str], int]:
    """Direction of the step between two neighbouring keys: along a row, to the row below or above, or through a sequence."""
    at = {key: (r, c) for r, row in enumerate(ROWS) for c, key in enumerate(row)}
    ways = {(0, 1): 1, (0, -1): 2, (1, 0): 3, (1, -1): 4, (-1, 0): 5, (-1, 1): 6}
    out = {(a, b): ways[way] for a, (r, c) in at.items() for b, (s, d) in at.items() if (way := (s - r, d - c)) in ways}
    for row in SEQUENCES:
        for a, b in zip(row, row[1:], strict=False):
            out.setdefault((a, b), 7)
            out.setdefault((b, a), 8)
    return out


NEXT = neighbours()
LEAST_WORD = 4


def dictionary() -> dict[str, int]:
    """Rank of each word: the common ones of passwords, then the words that byte_bpe_50k begins with a space, in its order."""
    import public_tokenizers

    found = list(COMMON)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        for token in (base64.b64decode(line.split()[0]) for line in f):
            word = token[1:]
            if token[:1] == b" " and len(word) >= LEAST_WORD and word.isalpha():
                found.append(word.decode("ascii").lower())
    return {w: k + 1 for k, w in enumerate(dict.fromkeys(found))}


WORD_RANK = dictionary()
WORD_LENGTHS = sorted({len(w) for w in WORD_RANK})
DATES = (
    re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"),
    re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d"),
    re.compile(r"(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])[-/.]?(?:19|20)\d\d"),
)
YEAR = re.compile(r"(?:19|20)\d\d")


def repetitions(value: str) -> list[tuple[int, int, int]]:
    """(start, end, unit) of the maximal stretches of two and more copies of a unit.

    A stretch of unit u holds a multiple of u whose character comes again u later, so
    those are looked at; stretches of a unit's multiples are those of the unit.
    """
    v = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    n, out = len(v), []

    def agree(a: int, b: int, way: int) -> int:
        """How far the value agrees from a and from b, forwards or, before them, backwards."""
        x, y = (v[a:], v[b:]) if way > 0 else (v[:a][::-1], v[:b][::-1])
        m, at, size = min(len(x), len(y)), 0, 32
        while at < m:
            differ = np.flatnonzero(x[at : min(at + size, m)] != y[at : min(at + size, m)])
            if len(differ):
                return at + int(differ[0])
            at, size = at + size, 2 * size
        return m

    for unit in range(1, n // 2 + 1):
        places = np.arange(0, n - unit, unit)
        done = 0
        for a in places[v[places] == v[places + unit]].tolist():
            if a + unit < done:
                continue
            known = next((e for s, e, u in out if unit % u == 0 and s <= a < a + unit < e and e - s >= 2 * unit), 0)
            if known:
                done = known
                continue
            first, last = a - agree(a, a + unit, -1), a + unit + agree(a, a + unit, 1)
            done = last
            if last - first >= 2 * unit:
                out.append((first, last, unit))
    return out


def class_size(ch: str) -> int:
    return 10 if ch.isdigit() else 26 if ch.isalpha() else 33


def guess_cost(value: str) -> float:
    """Least log10 guesses over all segmentations of ``value``."""
    n = len(value)
    low = value.lower()
    plain = low.translate(LEET)
    brute = [math.log10(class_size(c)) for c in value]
    starts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for size in WORD_LENGTHS:
            for k, form in enumerate((low, plain)):
                rank = WORD_RANK.get(form[i : i + size])
                if rank and i + size <= n:
                    cased = value[i : i + size]
                    extra = 0 if cased.islower() or not any(map(str.isalpha, cased)) else math.log10(2) if cased.istitle() or cased.isupper() else 0.3 * sum(map(str.isupper, cased))
                    starts[i].append((i + size, math.log10(rank + 1) + extra + 0.6 * k))
        if value[i].isdigit():
            if m := YEAR.match(value, i):
                starts[i].append((m.end(), math.log10(120)))
            for pattern in DATES:
                if m := pattern.match(value, i):
                    starts[i].append((m.end(), math.log10(365 * 120)))
    for first, last, unit in repetitions(value):
        inner = guess_cost(value[first : first + unit]) if unit > 1 else math.inf
        whole = sum(brute[first : first + unit])  # the same for every rotation
        for i in range(first, last - 2 * unit + 1):
            times = (last - i) // unit
            own = min(whole, unit_cost(value[i : i + unit]), inner if i == first else math.inf)
            starts[i].append((i + unit * times, own + math.log10(times)))
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    short = long = math.inf  # best walks of two and of more keys that end before the present character
    for i in range(n):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + brute[i])
        for end, cost in starts[i]:
            best[end] = min(best[end], here + cost)
        way = NEXT.get((low[i - 1], low[i])) if i else None
        if way is None:
            short = long = math.inf
            continue
        turn = TURN if i > 1 and NEXT.get((low[i - 2], low[i - 1])) != way else 0.0
        long = min(short, long) + STEP + turn
        short = best[i - 1] + WALK + TURN + 2 * STEP
        best[i + 1] = min(best[i + 1], long)
    return best[n]


def unit_cost(piece: str) -> float:
    rank = WORD_RANK.get(piece.lower())
    return math.log10(rank + 1) + 0.3 if rank else math.inf


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def value_spans(text: str, base: list[tuple[int, int, str]], min_cost: float) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        while end > start and text[end - 1] in "\"'`,;:.!?)]}>|":
            end -= 1
        if start < at or end - start < 6 or any(s < end and e > start for s, e, _ in base):
            continue
        if guess_cost(text[start:end]) >= min_cost:
            out.append((start, end, "value"))
            at = end
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def secret_scan(docs: DataFrame, min_cost: float = 9.0) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_value, n_spans, base_sha256, spans) of every row."""

    def judge(found: list[str]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_value", "n_spans", "base_sha256", "spans")}
        for text in found:
            base = base_spans(text)
            spans = base + (value_spans(text, base, min_cost) if CUE.search(text) else [])
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in spans))
            out["n_spans"].append(len(spans))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    return common.map_texts(docs, judge, "n_assign bigint, n_access bigint, n_hex bigint, n_value bigint, n_spans bigint, base_sha256 string, spans string")

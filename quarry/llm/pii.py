"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions for other forms.

The network (numpy only, gates and states squashed by softsign) reads characters in both
directions and scores the tags outside, begin and inside; transitions are part of the
training loss. ``fit`` trains it on labelled spans made from templates with a fixed seed
(``PERSONAL``): spelled-out addresses, national phone forms, spelled-out numbers,
identity, account and passport numbers, street addresses and dates of birth, among words
of many invented writers and neutral prices, dates, versions and hex strings, and after
each epoch on neutral windows that it mistook for spans. Its parameters are stored
beside this file.

Every character of every text is read, in pieces of ``CORE`` with ``CONTEXT`` more on both
sides, and decoded: the scores of a whole text are joined and its best tags are those of
one Viterbi path, so no place and no length of a span is left out. ``doubtful`` only
saves steps where an exact bound shows that the best tag is outside. Spans that overlap
base ones go; base spans always stay. ``reconcile`` joins the spans of several readings
by the greatest total score (weighted interval scheduling); one path needs none.

Defined cases: null or empty text has no spans; repeated rows give repeated
results; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm import common

KINDS = ("email", "ip", "card", "phone", "other")
#: The part of an address from its @ on, and the letters that may stand before it.
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A number that starts inside a run of digits is never leftmost.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NUMERALS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

WINDOW = 64  # of training
STORED = Path(__file__).with_name("pii_tagger.npz")
CORE, CONTEXT = 512, 32  # of reading: pieces, and what is read before and after them
LANES = 384  # pieces that are read together
CELLS = 1 << 20  # of decoding: stretches that are decoded together, times the longest's characters
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n.,:;-_+()[]{}@/\\'\"#*=<>|%&$!?~"
CODE = {c: k + 2 for k, c in enumerate(SYMBOLS)}  # 0: padding, 1: any other character
CODES = np.array([CODE.get(chr(k), 1) for k in range(129)])
HIDDEN, EMBED, TAGS = 20, 12, 3


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: from each @ with a domain to the left, no further than the address before; every letter is looked at once."""
    end = 0
    for m in AT_DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def encode(text: str) -> np.ndarray:
    return CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


# Labelled spans for training.


#: Names, streets and mail hosts of the training spans (fixed values).
FIRST = "anna ben carla david elena farid grace hugo ines jonas karin liam maria noah olga peter quentin rosa samuel tara ulrich vera walter xenia yusuf zoe".split()
LAST = "adams baker costa dubois evans fischer garcia haddad ivanov jensen keller lopez meyer novak olsen petrov quinn rossi schmidt tanaka ueda vogel weber yilmaz zhang".split()
STREETS = "Baker Church Garden High King Lake Mill North Park Queen River School Station Victoria Water".split()
ROADS = "Street Road Avenue Lane St. Ave Drive".split()
HOSTS = "mail post inbox webpost office uni-net example corp-mail".split()
ENDS = "com org net edu de fr co".split()
ACCENTS = list("äöüßéèêàçñíóáøåłжиан的")
GAPS = (", ", ", ", ". ", ".\n", "\n", "! ", "!! ", "; ", ": ", " - ", " (", ") ", "\n\n", "? ")
MONTHS = "January February March April May June July August September October November December".split()
Rng = np.random.Generator


def _letters(rng: Rng, low: int, high: int) -> str:
    return "".join("etaoinshrdlucmfgpb"[k] for k in rng.integers(0, 18, rng.integers(low, high)))


def _digits(rng: Rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng: Rng) -> str:
    """A given name, a family name, letters, or two of these with a hyphen."""
    one = lambda: str(rng.choice([rng.choice(FIRST), rng.choice(LAST), _letters(rng, 3, 9), _letters(rng, 6, 14)]))
    return f"{one()}-{one()}" if rng.random() < 0.25 else one()


def _address(rng: Rng) -> str:
    at, dot = [("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", "{dot}"), ("at", "dot"), ("[AT]", "[DOT]"), ("_at_", "_dot_")][rng.integers(6)]
    user = f"{_word(rng)}{_digits(rng, 2) if rng.random() < 0.4 else ''}" if rng.random() < 0.5 else f"{_word(rng)}.{_word(rng)}"
    gap = "" if at == "_at_" else " "
    return gap.join([user, at, str(rng.choice(HOSTS)) if rng.random() < 0.4 else _word(rng), dot, str(rng.choice(ENDS))])


def _phone(rng: Rng) -> str:
    d = lambda n: _digits(rng, n)
    return [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)}/{d(7)}"][rng.integers(5)]


def _born(rng: Rng) -> str:
    day, month, year = int(rng.integers(1, 29)), int(rng.integers(1, 13)), int(rng.integers(1930, 2010))
    date = [f"{day} {MONTHS[month - 1]} {year}", f"{MONTHS[month - 1]} {day}, {year}", f"{day:02d}/{month:02d}/{year}", f"{year}-{month:02d}-{day:02d}"][rng.integers(4)]
    return f"{['born on', 'born', 'date of birth:', 'DOB:', 'DOB'][rng.integers(5)]} {date}"


#: Makers of labelled spans, by kind.
PERSONAL = {
    "address": _address,
    "spaced address": lambda r: f"{_word(r)}.{_word(r)} @ {_letters(r, 3, 9)} . {r.choice(ENDS)}",
    "phone": _phone,
    "spelled number": lambda r: [" ", " ", "-", "."][r.integers(4)].join(r.choice(NUMERALS, r.integers(7, 11))),
    "identity number": lambda r: f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}",
    "account": lambda r: [f"DE{_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)} {_digits(r, 2)}", f"FR{_digits(r, 20)}", f"GB{_digits(r, 2)} NWBK {_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)} {_digits(r, 2)}"][r.integers(3)],
    "passport": lambda r: f"passport {['no. ', 'number ', ''][r.integers(3)]}{''.join(r.choice(list('ABCEFGHKLMNPRTX'), r.integers(1, 3)))}{_digits(r, 7)}",
    "street": lambda r: f"{r.integers(1, 400)} {r.choice(STREETS)} {r.choice(ROADS)}",
    "birth": _born,
}
NEUTRAL = (
    lambda r: f"{_digits(r, 2)}.{_digits(r, 2)} EUR",
    lambda r: f"19{_digits(r, 2)}",
    lambda r: f"20{_digits(r, 2)}-0{r.integers(1, 9)}-1{r.integers(0, 9)}",
    lambda r: f"on {r.integers(1, 29)} {r.choice(MONTHS)} {r.integers(1900, 2030)}",
    lambda r: f"version {_digits(r, 1)}.{_digits(r, 1)}.{_digits(r, 2)}",
    lambda r: f'token = "{"".join(r.choice(list("0123456789abcdef"), 40))}"',
    lambda r: f'TOKEN = "{"".join(r.choice(list("0123456789ABCDEF"), 40))}"',
    lambda r: _digits(r, int(r.integers(1, 7))),
    lambda r: _digits(r, 16),
    lambda r: f"{_digits(r, 2)}.{_digits(r, 3)}.{_digits(r, 2)}.{_digits(r, 2)}",
    lambda r: f"+1 ({_digits(r, 3)}) 555-{_digits(r, 4)}",
    lambda r: f"{_letters(r, 3, 8)}.{_digits(r, 2)}@mail{_digits(r, 1)}.example.com",
    lambda r: f"CC BY 4.{_digits(r, 1)}",
    lambda r: f"page {_digits(r, 3)} of {_digits(r, 4)}",
    lambda r: _digits(r, 16) + " " + _letters(r, 3, 8).title() + ".",
    lambda r: f"{r.choice(NUMERALS)} {r.choice(['of', 'or', 'more', 'days'])}",
    lambda r: f"{r.integers(1, 400)} {_letters(r, 3, 9)}",
    lambda r: f"at {_letters(r, 2, 6)} {r.choice(['the', 'a'])}",
)


def _personal(rng: Rng) -> str:
    return list(PERSONAL.values())[rng.integers(len(PERSONAL))](rng)


def _neutral(rng: Rng) -> str:
    return NEUTRAL[rng.integers(len(NEUTRAL))](rng)


@lru_cache(1)
def vocabulary() -> list[str]:
    """The tokens of byte_bpe_50k that are letters only, without a space before them, in its order."""
    import base64

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        found = (base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip() for line in f)
        return list(dict.fromkeys(word for word in found if word.isalpha()))


@lru_cache(1)
def short_tokens() -> list[str]:
    return [word for word in vocabulary() if len(word) <= 4]


def _writer(rng: Rng) -> Callable[[], str]:
    """A maker of words and what parts them, with its own shares of common words, of words glued from a few tokens, of letters, of repeats and of signs."""
    words, short, draw = vocabulary(), short_tokens(), rng.random
    power = (1, 3, 5)[rng.integers(3)]  # early tokens are frequent ones
    own = [short[int(len(short) * draw() ** power)] for _ in range(rng.integers(8, 40))] + [str(c) for c in rng.choice(ACCENTS, rng.integers(0, 4))]
    few = [words[int(len(words) * draw() ** power)] for _ in range(rng.integers(4, 30))]
    common, glued, stops, titles = draw() * 0.7, draw(), draw() * 0.3, draw() * 0.2
    again = draw() if draw() < 0.15 else 0.02  # the chance that a word comes many times
    signs = [str(c) * int(rng.integers(1, 4)) for c in rng.choice(list("#*$%&|<>!?-=+~/_.:;"), 3)] if draw() < 0.2 else []

    def word() -> str:
        if draw() < common:
            out = few[int(draw() * len(few))] if draw() < 0.7 else words[int(len(words) * draw() ** power)]
        elif draw() < glued:
            out = "".join(own[int(draw() * len(own))] for _ in range(1 + int(draw() * 4)))
        else:
            out = _letters(rng, 1, 9)
        case = draw()
        out = out.title() if case < titles else out.upper() if case > 0.98 else out
        if signs and draw() < 0.7:
            out += (" " if draw() < 0.3 else "") + signs[int(draw() * len(signs))]
        out += GAPS[int(draw() * len(GAPS))] if draw() < stops else " "
        return out * int(2 + draw() ** 2 * 40) if draw() < again * 0.2 else out

    return word


def training_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of words with labelled spans and neutral figures among them; a part holds neither, as most of any text does."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for k in range(n):
        text, tags, word, plain, loud = "", [], _writer(rng), rng.random() < 0.3, rng.random() < 0.04
        while len(text) < WINDOW + 24:
            kind = 1 if plain else rng.random()
            part = _personal(rng) if kind < 0.25 else _neutral(rng) if kind < 0.5 else word().upper() if loud else word()
            own = [1] + [2] * (len(part) - 1) if kind < 0.25 else [0] * len(part)
            gap = "" if kind >= 0.5 else " " if rng.random() < 0.9 else ", "
            text, tags = text + part + gap, tags + own + [0] * len(gap)
        at = int(rng.integers(0, len(text) - WINDOW + 1))
        x[k], y[k] = encode(text[at : at + WINDOW]), tags[at : at + WINDOW]
    return x, y


# The network.


def _sign(v: np.ndarray) -> np.ndarray:
    """Softsign; its half, from 0 to 1, opens the gates."""
    return v / (1 + np.abs(v))


def _lstm(e: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray):
    """Hidden states (time, batch, HIDDEN) of inputs (time, batch, EMBED), and what their gradient needs."""
    steps, n, _ = e.shape
    h, c = np.zeros((n, HIDDEN), e.dtype), np.zeros((n, HIDDEN), e.dtype)
    out, saved = np.empty((steps, n, HIDDEN), e.dtype), []
    pre = e @ w + b
    for t in range(steps):
        a = _sign(pre[t] + h @ u)
        s, g = 0.5 + 0.5 * a[:, : 3 * HIDDEN], a[:, 3 * HIDDEN :]
        before, c = c, s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * g
        tc = _sign(c)
        saved.append((h, before, a, s, tc))
        h = s[:, 2 * HIDDEN :] * tc
        out[t] = h
    return out, saved


def _lstm_back(d_out, e, w, u, saved):
    steps = len(saved)
    d_w, d_u, d_b = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, w.dtype)
    d_e = np.empty_like(e)
    d_h, d_c = np.zeros_like(saved[0][0]), np.zeros_like(saved[0][0])
    for t in range(steps - 1, -1, -1):
        h, before, a, s, tc = saved[t]
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], a[:, 3 * HIDDEN :]
        d_h = d_h + d_out[t]
        d_c = d_c + d_h * o * (1 - np.abs(tc)) ** 2
        d_z = np.concatenate([0.5 * d_c * g, 0.5 * d_c * before, 0.5 * d_h * tc, d_c * i], 1) * (1 - np.abs(a)) ** 2
        d_w += e[t].T @ d_z
        d_u += h.T @ d_z
        d_b += d_z.sum(0)
        d_e[t] = d_z @ w.T
        d_h, d_c = d_z @ u.T, d_c * f
    return d_w, d_u, d_b, d_e


def _lse(v: np.ndarray, axis: int) -> np.ndarray:
    top = v.max(axis, keepdims=True)
    return (top + np.log(np.exp(v - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Parameters by name; ``scores`` gives tag scores (batch, time, TAGS)."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        r = lambda *shape: (rng.normal(0, 0.25, shape)).astype(np.float32)
        self.p = {"emb": r(len(SYMBOLS) + 2, EMBED), "out": r(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        for way in "fb":
            b = np.zeros(4 * HIDDEN, np.float32)
            b[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {f"w{way}": r(EMBED, 4 * HIDDEN), f"u{way}": r(HIDDEN, 4 * HIDDEN), f"b{way}": b}

    def _run(self, x: np.ndarray):
        p = self.p
        e = p["emb"][x.T]
        hf, sf = _lstm(e, p["wf"], p["uf"], p["bf"])
        hb, sb = _lstm(e[::-1], p["wb"], p["ub"], p["bb"])
        h = np.concatenate([hf, hb[::-1]], 2)
        return h @ p["out"] + p["bias"], (e, h, sf, sb)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._run(x)[0].transpose(1, 0, 2)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p = self.p
        s, (e, h, sf, sb) = self._run(x)
        steps, n, _ = s.shape
        fwd, bwd = np.empty_like(s), np.zeros_like(s)
        fwd[0] = s[0]
        for t in range(1, steps):
            fwd[t] = _lse(fwd[t - 1][:, :, None] + p["move"], 1) + s[t]
        for t in range(steps - 2, -1, -1):
            bwd[t] = _lse(p["move"] + (s[t + 1] + bwd[t + 1])[:, None, :], 2)
        total = _lse(fwd[-1], 1)
        gold = np.eye(TAGS, dtype=np.float32)[y.T]
        pair = np.exp(fwd[:-1, :, :, None] + p["move"] + (s[1:] + bwd[1:])[:, :, None, :] - total[None, :, None, None])
        d_s = (np.exp(fwd + bwd - total[None, :, None]) - gold) / n
        path = (s * gold).sum() + (p["move"] * np.einsum("tna,tnb->ab", gold[:-1], gold[1:])).sum()
        g = {"move": (pair.sum((0, 1)) - np.einsum("tna,tnb->ab", gold[:-1], gold[1:])) / n}
        g["out"] = np.einsum("tnh,tna->ha", h, d_s)
        g["bias"] = d_s.sum((0, 1))
        d_h = d_s @ p["out"].T
        g["wf"], g["uf"], g["bf"], d_f = _lstm_back(d_h[:, :, :HIDDEN], e, p["wf"], p["uf"], sf)
        g["wb"], g["ub"], g["bb"], d_b = _lstm_back(d_h[::-1, :, HIDDEN:], e[::-1], p["wb"], p["ub"], sb)
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], x.T, d_f + d_b[::-1])
        return float(total.sum() - path) / n, g

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best tags (batch, time)."""
        n, steps, _ = scores.shape
        back = np.zeros((steps, n, TAGS), np.int8)
        v = scores[:, 0]
        for t in range(1, steps):
            a = v[:, :, None] + self.p["move"]
            back[t] = a.argmax(1)
            v = a.max(1) + scores[:, t]
        tags = np.empty((n, steps), np.int8)
        tags[:, -1] = v.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags


def neutral_text(rng: Rng, size: int) -> str:
    """At least ``size`` characters of words of one writer and some neutral figures, without anything personal."""
    word, loud, parts, n = _writer(rng), rng.random() < 0.05, [], 0
    while n < size + 2:
        parts.append(f"{_neutral(rng)} " if rng.random() < 0.04 else word().upper() if loud else word())
        n += len(parts[-1])
    return "".join(parts).rstrip()


def mistaken_windows(tagger: Tagger, rng: Rng, most: int, texts: int = 400, size: int = 2000) -> np.ndarray:
    """Up to ``most`` windows of neutral texts around what the tagger takes for spans."""
    found = [neutral_text(rng, size) for _ in range(texts)]
    spans = [(k, *span) for k, own in enumerate(tag_texts(tagger, found)) for span in own]
    spans = [spans[j] for j in rng.permutation(len(spans))[:most]]
    x = np.zeros((len(spans), WINDOW), np.int64)
    for row, (k, a, b) in enumerate(spans):
        at = int(np.clip(rng.integers(a, b) - rng.integers(8, WINDOW - 8), 0, len(found[k]) - WINDOW))
        x[row] = encode(found[k][at : at + WINDOW])
    return x


def fit(windows: int = 12000, epochs: int = 32, batch: int = 100, seed: int = 11) -> Tagger:
    """A tagger fitted on ``windows`` labelled windows (Adam on the CRF loss) and, from the second epoch on, on neutral ones that it mistook."""
    x, y = training_windows(windows, seed)
    tagger = Tagger(seed)
    rng = np.random.default_rng(seed + 1)
    first = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    second = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch:
            wrong = mistaken_windows(tagger, rng, windows // 6)
            x, y = np.concatenate([x, wrong]), np.concatenate([y, np.zeros_like(wrong)])
        order = rng.permutation(len(x))
        for at in range(0, len(x) - batch + 1, batch):
            step += 1
            _, grads = tagger.step(x[order[at : at + batch]], y[order[at : at + batch]])
            rate = 0.01 * min(1, 1.2 * (1 - (epoch + at / len(x)) / epochs))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                tagger.p[k] = (tagger.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return tagger


@lru_cache(1)
def train() -> Tagger:
    """The tagger of ``fit()``: its parameters as stored beside this file (some four minutes of one core), fitted anew where they are missing."""
    if not STORED.exists():
        return fit()
    tagger = Tagger()
    with np.load(STORED) as found:
        tagger.p = {k: found[k] for k in tagger.p}
    return tagger


def doubtful(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Whether a span over each character of a text could score as much as the outside tag; where none could, the best tag is outside.

    A span scores over the outside tag at most the sum of what its characters do, with the best step between them, and
    the best steps in and out. Of all spans over a character the best is bounded by the least sum up to it and the
    greatest one from it on.
    """
    into, out, inner = (float(m.max() - move[0, 0]) for m in (move[0, 1:], move[1:, 0], move[1:, 1:]))
    sums = np.zeros(len(scores) + 1)
    np.cumsum(np.maximum(scores[:, 1], scores[:, 2]) - scores[:, 0] + inner, dtype=np.float64, out=sums[1:])
    return np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1]) > inner - into - out - 1e-2


def best_tags(scores: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """Viterbi over many stretches, each between outside characters."""
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(scores)
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    done = 0
    while done < len(order):
        own = order[done : done + max(1, CELLS // len(scores[order[done]]))]
        done += len(own)
        sizes = np.array([len(scores[k]) for k in own])
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # lanes longer than each step
        s = np.zeros((sizes[0], TAGS, len(own)), scores[own[0]].dtype)
        for lane, k in enumerate(own):
            s[: sizes[lane], :, lane] = scores[k]
        v = s[0] + move[0][:, None]
        came = np.empty(s.shape, np.int8)
        for t in range(1, sizes[0]):
            n = live[t]
            a = v[:, None, :n] + move[:, :, None]
            came[t, :, :n] = a.argmax(0)
            v[:, :n] = a.max(0) + s[t, :, :n]
        tag = (v + move[:, :1]).argmax(0)
        tags = np.empty((sizes[0], len(own)), np.int8)
        lanes = np.arange(len(own))
        for t in range(sizes[0] - 1, -1, -1):
            n = live[t]
            tags[t, :n] = tag[:n]
            if t:
                tag[:n] = came[t, tag[:n], lanes[:n]]
        for lane, k in enumerate(own):
            out[k] = tags[: sizes[lane], lane]
    return out


def decoded(scores: np.ndarray, move: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Best tags of texts that lie one after another in ``scores``, the k-th from ``bounds[k]`` to ``bounds[k + 1]``.

    What lies before and after a text is outside. Characters that are outside for sure part a text into stretches, which
    alone have the same best tags as in the whole.
    """
    tags, runs = np.zeros(len(scores), np.int8), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if a < b:
            edges = np.flatnonzero(np.diff(doubtful(scores[a:b], move), prepend=False, append=False)) + a
            runs += edges.reshape(-1, 2).tolist()
    for (a, b), own in zip(runs, best_tags([scores[a:b] for a, b in runs], move), strict=True):
        tags[a:b] = own
    return tags


def reconcile(found: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Non-overlapping spans of greatest total score; the same span of two windows counts with both scores."""
    total: dict[tuple[int, int], float] = {}
    for a, b, gain in found:
        total[a, b] = total.get((a, b), 0.0) + gain
    spans = sorted(total, key=lambda s: (s[1], s[0]))
    ends = [b for _, b in spans]
    best, take = [0.0], []
    for k, (a, b) in enumerate(spans):
        j = bisect_right(ends, a, 0, k)
        with_it = best[j] + total[a, b]
        take.append((with_it > best[k], j))
        best.append(max(best[k], with_it))
    out, k = [], len(spans)
    while k:
        chosen, j = take[k - 1]
        if chosen:
            out.append(spans[k - 1])
        k = j if chosen else k - 1
    return out[::-1]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def parts(tagger: Tagger, way: str) -> tuple[np.ndarray, np.ndarray]:
    """What ``sweep`` multiplies the states (twice the hidden ones) and characters (and a one) by, for gates and tags; and the characters."""
    p = tagger.p
    out = np.zeros((HIDDEN + EMBED + 1, TAGS), np.float32)
    out[:HIDDEN] = (p["out"][:HIDDEN] if way == "f" else p["out"][HIDDEN:]) / 2
    both = np.concatenate([np.concatenate([p["u" + way] / 2, p["w" + way], p["b" + way][None]]), out], 1)
    return np.ascontiguousarray(both.T), np.ascontiguousarray(p["emb"].T)


def sweep(x: np.ndarray, both: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Tag scores (time, TAGS, lanes) of one direction for codes (time, lanes): ``_lstm`` with a lane a column, in place."""
    steps, n = x.shape
    scores = np.empty((steps, TAGS, n), np.float32)
    given = np.zeros((HIDDEN + EMBED + 1, n), np.float32)  # states doubled, the character, one
    given[-1] = 1
    z, size, c, own = (np.zeros((k, n), np.float32) for k in (4 * HIDDEN + TAGS, 4 * HIDDEN, HIDDEN, HIDDEN))
    h, e, a, tags, gates = given[:HIDDEN], given[HIDDEN:-1], z[: 4 * HIDDEN], z[4 * HIDDEN :], z[: 3 * HIDDEN]
    i, f, o, g = (a[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
    for t in range(steps):
        codes.take(x[t], 1, e, "clip")
        np.matmul(both, given, z)
        if t:
            scores[t - 1] = tags
        np.abs(a, size)
        np.add(size, 1, size)
        np.divide(a, size, a)
        np.add(gates, 1, gates)  # twice the open part
        np.multiply(c, f, c)
        np.multiply(g, i, g)
        np.add(c, g, c)
        np.multiply(c, 0.5, c)
        np.abs(c, own)
        np.add(own, 1, own)
        np.divide(c, own, own)
        np.multiply(o, own, h)
    np.matmul(both[4 * HIDDEN :], given, scores[-1])
    return scores


def read_scores(tagger: Tagger, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tag scores of every character of texts that lie one after another in ``codes``.

    Each text is read in equal pieces of at most ``CORE`` characters with ``CONTEXT`` more of it on both sides, some
    ``LANES`` at a time. Every piece starts both sweeps at its own ends, so that its scores don't depend on those beside it.
    """
    scores = np.empty((len(codes), TAGS), np.float32)
    forward, backward = parts(tagger, "f"), parts(tagger, "b")
    pieces = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        size = -(-(b - a) // max(1, -(-(b - a) // CORE)))
        pieces += [(max(a, at - CONTEXT), at, min(b, at + size), min(b, at + size + CONTEXT)) for at in range(a, b, max(1, size))]
    pieces.sort(key=lambda p: p[3] - p[0])
    for k in range(0, len(pieces), LANES):
        own = pieces[k : k + LANES]
        x = np.zeros((2, len(own), own[-1][3] - own[-1][0]), np.int64)
        for lane, (first, _, _, last) in enumerate(own):
            x[0, lane, : last - first] = codes[first:last]
            x[1, lane, : last - first] = codes[first:last][::-1]
        left, right = (np.ascontiguousarray(sweep(np.ascontiguousarray(one.T), *way).transpose(2, 0, 1)) for one, way in zip(x, (forward, backward), strict=True))
        for lane, (first, a, b, last) in enumerate(own):
            np.add(left[lane, a - first : b - first], right[lane, last - b : last - a][::-1], out=scores[a:b])
    scores += tagger.p["bias"]
    return scores


def tag_texts(tagger: Tagger, found: list[str]) -> list[list[tuple[int, int]]]:
    """Spans of the network for every text: each of its characters is read and decoded."""
    bounds = np.cumsum([0, *map(len, found)])
    tags = decoded(read_scores(tagger, np.concatenate([np.empty(0, np.int64), *map(encode, found)]), bounds), tagger.p["move"], bounds)
    before, after = np.append(0, tags[:-1]), np.append(tags[1:], 0)
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(tags))]
    before[inner], after[inner - 1] = 0, 0
    first = np.flatnonzero((tags == 1) | (tags == 2) & (before == 0))
    last = np.flatnonzero((tags > 0) & (after != 2)) + 1
    at = np.searchsorted(first, bounds)
    return [list(zip((first[a:b] - start).tolist(), (last[a:b] - start).tolist(), strict=True)) for a, b, start in zip(at[:-1], at[1:], bounds[:-1], strict=True)]


def pii_scan(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_other, n_spans, base_sha256, spans) of every row; n_spans counts all spans."""
    tagger = tagger or train()

    def judge(found: list[str]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in (*[f"n_{k}" for k in KINDS], "n_spans", "base_sha256", "spans")}
        for text, more in zip(found, tag_texts(tagger, found), strict=True):
            base = base_spans(text)
            taken = bytearray(len(text))
            for a, b, _ in base:
                taken[a:b] = b"\1" * (b - a)
            spans = base + [(a, b, "other") for a, b in more if taken.find(1, a, b) < 0]
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in spans))
            out["n_spans"].append(len(spans))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    return common.map_texts(docs, judge, ", ".join(f"n_{k} bigint" for k in KINDS) + ", n_spans bigint, base_sha256 string, spans string")

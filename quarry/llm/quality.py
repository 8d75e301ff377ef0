"""Quality rules with line sequence labelling by a linear-chain conditional random field.

Every line of a text gets 0/1 features, taken over all its words (those of furniture
and lower-case words as bins of their share); a two-state chain (content, boilerplate)
trained on labelled documents is decoded by Viterbi, and a document is kept when
the base rules pass and content lines hold at least ``min_share`` of its words.

The chain is fitted on at most ``sample`` labelled documents of each class (those
with the smallest hashes of their ids), and at most ``lines`` lines of each, in
pieces spread evenly over it. Labels belong to documents, lines have to be labelled
by training itself: a first chain takes the document's label for all its lines;
then lines go where that chain's emissions alone put them, unless most words of the
document would contradict its label; the second chain learns from these, so that
its transitions know where a text switches. Without labels of both classes every
line counts as content.

Defined cases: null or empty text has no words, fails the base rules and is not
kept; ties between the states go to content; repeated rows give repeated results;
a labelled id of several rows trains on one of them; a null doc_id stays null;
other columns are carried by ``quality_filter`` only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

WORDS = re.compile(common.WORD)
SYMBOLS = "#*$%&|<>"
#: Words that a page's furniture uses and prose seldom does (fixed values).
FURNITURE = {"cookie", "cookies", "subscribe", "newsletter", "login", "sign", "menu", "share", "click", "javascript", "copyright", "privacy", "terms", "advertisement"}
REPEAT_WINDOW = 8
N_FEATURES = 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[str]) -> int:
    """Words inside 8-word windows that occur at least twice in the list."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    names = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for k in range(REPEAT_WINDOW):
        windows = (windows ^ (windows >> np.uint64(29))) * MIX + names[k : k + n]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    edge[starts] += 1
    np.subtract.at(edge, starts + REPEAT_WINDOW, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_features(line: str, words: list[str], again: bool) -> list[int]:
    """Indices of the features a line has."""
    n = len(words)
    if not n:
        return [0, 1]
    symbols = sum(map(line.count, SYMBOLS))
    upper = sum(map(str.isupper, words))
    distinct = len(set(words))
    letters = sum(map(len, words))
    out = [0, 2 if n < 4 else 3 if n < 9 else 4]
    out.append(5 if not symbols else 6 if symbols < 0.3 * n else 7)
    out.append(8 if upper <= 0.3 * n else 9 if upper < 0.8 * n or n < 3 else 10)
    out.append(11 if distinct > 0.6 * n or n < 5 else 12 if distinct > 0.25 * n else 13)
    if again:
        out.append(14)
    if line.rstrip(common.WHITE)[-1] in ".!?:;…\"')":
        out.append(15)
    if "!!" in line:
        out.append(16)
    if letters > 14 * n or letters < 2 * n:
        out.append(17)
    furniture = sum(w.lower() in FURNITURE for w in words)
    if furniture:
        out.append(18 if 12 * furniture >= n else 20)
    lower = sum(w.isalpha() and w.islower() for w in words)
    if lower:
        out.append(19 if 4 * lower >= n else 21)
    return out


@dataclass
class Analysis:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: list[list[int]]
    line_words: list[int]

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


def analyse(text: str) -> Analysis:
    words, features, line_words, seen, dup = [], [], [], set(), 0
    for line in text.split("\n"):
        own = WORDS.findall(line)
        again = False
        if own:
            again = line in seen
            dup += again
            seen.add(line)
        features.append(line_features(line, own, again))
        line_words.append(len(own))
        words += own
    word_chars = len(text) - sum(map(text.count, common.WHITE))
    return Analysis(len(words), word_chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(words), features, line_words)


@dataclass
class Chain:
    """Linear chain over (content, boilerplate): emission weights, transitions, start."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def decode(self, features: list[list[int]]) -> list[int]:
        """Viterbi path; 0 is content."""
        e0, e1 = self.emit[:, 0].tolist(), self.emit[:, 1].tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = self.start.tolist()
        back = []
        for k, own in enumerate(features):
            x0, x1 = sum([e0[f] for f in own]), sum([e1[f] for f in own])
            if k == 0:
                s0, s1 = s0 + x0, s1 + x1
                continue
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((b > a, d > c))
            s0, s1 = max(a, b) + x0, max(c, d) + x1
        state = int(s1 > s0)
        path = [state]
        for step in reversed(back):
            state = int(step[state])
            path.append(state)
        return path[::-1]

    def content_share(self, found: Analysis) -> float:
        if not found.n_words:
            return 0.0
        return sum(n for n, s in zip(found.line_words, self.decode(found.features), strict=True) if s == 0) / found.n_words


def all_content() -> Chain:
    return Chain(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.array([1.0, 0.0]))


@dataclass
class Piece:
    """Lines of a labelled document: features, words and labels of each (0 content, 1 boilerplate), and the document's label."""

    features: list[list[int]]
    words: list[int]
    labels: list[int]
    document: int


def relabelled(found: list[Piece], chain: Chain) -> list[Piece]:
    """Lines by the emissions of a chain alone; a piece whose words would mostly contradict its document keeps its labels."""
    lean = chain.emit[:, 1] - chain.emit[:, 0]
    out = []
    for p in found:
        labels = [int(lean[own].sum() > 0) for own in p.features]
        against = sum(n for n, k in zip(p.words, labels, strict=True) if k != p.document)
        out.append(p if 2 * against > sum(p.words) else Piece(p.features, p.words, labels, p.document))
    return out


def train(cut: list[Piece], steps: int = 80, rate: float = 0.15, ridge: float = 0.02) -> Chain:
    """Maximum likelihood by gradient steps over padded batches of pieces."""
    if len({p.document for p in cut}) < 2:
        return all_content()
    n, most = len(cut), max(len(p.features) for p in cut)
    x, y, on = np.zeros((n, most, N_FEATURES), np.float32), np.zeros((n, most), int), np.zeros((n, most))
    weight = np.zeros(n)
    per_class = [sum(p.document == k for p in cut) for k in (0, 1)]
    for i, p in enumerate(cut):
        for k, own in enumerate(p.features):
            x[i, k, own] = 1
        y[i, : len(p.labels)], on[i, : len(p.labels)], weight[i] = p.labels, 1, 1 / per_class[p.document] / len(p.labels)
    weight /= weight.sum()
    gold = np.eye(2)[y] * on[..., None]
    theta = [np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        emit, move, start = theta
        s = x @ emit
        fwd, bwd = np.zeros((most, n, 2)), np.zeros((most, n, 2))
        fwd[0] = start + s[:, 0]
        for k in range(1, most):
            nxt = np.logaddexp(fwd[k - 1][:, :1] + move[0], fwd[k - 1][:, 1:] + move[1]) + s[:, k]
            fwd[k] = np.where(on[:, k, None] > 0, nxt, fwd[k - 1])
        total = np.logaddexp(fwd[-1][:, 0], fwd[-1][:, 1])[:, None]
        for k in range(most - 2, -1, -1):
            ahead = bwd[k + 1] + s[:, k + 1]
            prev = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
            bwd[k] = np.where(on[:, k + 1, None] > 0, prev, bwd[k + 1])
        post = np.exp(fwd + bwd - total).transpose(1, 0, 2) * on[..., None]
        diff = (gold - post) * weight[:, None, None]
        g_emit = np.einsum("nkf,nks->fs", x, diff)
        g_start = diff[:, 0].sum(0)
        pair = fwd[:-1, :, :, None] + move + (bwd[1:] + s.transpose(1, 0, 2)[1:])[:, :, None, :] - total[..., None]
        live = (on[:, 1:].T * weight)[..., None, None]
        both = gold.transpose(1, 0, 2)
        g_move = ((both[:-1, :, :, None] * both[1:, :, None, :] - np.exp(pair) * (on[:, 1:].T)[..., None, None]) * live).sum((0, 1))
        for i, g in enumerate((g_emit, g_move, g_start)):
            g = g - ridge * theta[i] / most
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            theta[i] = theta[i] + rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-9)
    return Chain(*theta)


def pieces(found: Analysis, lines: int, size: int = 64) -> list[tuple[list[list[int]], list[int]]]:
    """(features, words) of pieces of ``size`` lines, at most ``lines`` in all, spread evenly over a text."""
    starts = range(0, len(found.features), size)
    most = max(1, lines // size)
    if len(starts) > most:
        starts = [starts[k * len(starts) // most] for k in range(most)]
    return [(found.features[a : a + size], found.line_words[a : a + size]) for a in starts]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 300, lines: int = 256) -> Chain:
    """Chain fitted on at most ``sample`` labelled documents of each class and ``lines`` lines of each."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = {q: [r.doc_id for r in known.filter(F.col("quality") == q).orderBy(*order).limit(sample).collect()] for q in (0, 1)}
    label = {doc: 1 - q for q, own in chosen.items() for doc in own}
    if len(set(label.values())) < 2:
        return all_content()

    def judge(found: list[str]) -> dict[str, list]:
        cut = [pieces(analyse(t), lines) for t in found]
        return {"features": [[f for f, _ in own] for own in cut], "words": [[w for _, w in own] for own in cut]}

    rows = docs.select("doc_id", "text").filter(F.col("doc_id").isin(list(label))).dropDuplicates(["doc_id"])
    rows = common.map_texts(rows, judge, "features array<array<array<int>>>, words array<array<int>>").collect()
    found = [Piece(f, w, [label[r.doc_id]] * len(f), label[r.doc_id]) for r in sorted(rows, key=lambda r: r.doc_id) for f, w in zip(r.features, r.words, strict=True)]
    chain = train(relabelled(found, train(found)))
    common.release()
    return chain


def quality_scan(docs: DataFrame, chain: Chain, min_share: float = 0.5) -> DataFrame:
    """(doc_id, base columns, content_share, kept) of every row."""

    def judge(found: list[str]) -> dict[str, list]:
        rows = [analyse(t) for t in found]
        share = [chain.content_share(r) for r in rows]
        out = {k: [getattr(r, k) for r in rows] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}
        return out | {"content_share": share, "kept": [not r.base_failed and s >= min_share for r, s in zip(rows, share, strict=True)]}

    return common.map_texts(docs, judge, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean")


def quality_filter(docs: DataFrame, chain: Chain, min_share: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that the rules and the chain keep, with all their columns."""

    def keep(found: list[str]) -> list[bool]:
        rows = [analyse(t) for t in found]
        return [not r.base_failed and chain.content_share(r) >= min_share for r in rows]

    return common.filter_rows(docs, keep)

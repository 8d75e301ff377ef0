"""Benchmark decontamination by latent semantic retrieval.

Texts are words (letters and digits, lower case) hashed to ``2**BUCKET_BITS``
buckets, once, and written beside their rows. Document frequencies of buckets are
counted over all documents in Spark. All benchmark
items, cut into passages of at most ``PASSAGE`` words, form a TF-IDF matrix A of unit
rows. Nothing comes from a sample: the weights are those of all documents, the rows those
of all items. Its right singular
vectors come from a randomised SVD with two passes over the passages in Spark: the first
gives the rows of A times a random matrix, whose basis Q the driver makes; the second
sums Q'A A'Q. Both are as large as the number of passages. Words' vectors are A'U over
the singular values, made by the tasks that search; no array of words times dimensions
passes the driver.

Every document is then searched whole: windows of ``SPAN`` words, every ``STEP``
words, are folded into the latent space and compared with the item passages. The
cosine takes the window's norm over all its words, so the lengths of the words'
latent vectors bound it by the triangle inequality, and windows under that bound
need no product. Every window over the threshold is a candidate, confirmed on the
words around it: the longest common subsequence with the item, or a shorter one
together with the words of the item's answer (its last sentence). Adjacent windows
form regions; a region that fails as a whole holds no window that passes. The first
window that confirms settles an item; the greatest cosine is only reported.

Items under ``SPAN + STEP - 1`` words need not hold a window of their own. For them a
window is compared once more, folded and normed over the words that the item holds,
where the words around it hold enough of the item for the least common subsequence.

Benchmarks of more passages than ``BLOCK`` are searched in blocks, each with a
latent space of its own; one pass over the documents serves ``TOGETHER`` blocks. A
benchmark is small by its nature and held by the driver, up to ``MOST_ITEMS`` items.

Defined cases: null or empty text, and text without words, leaks nothing; empty
items are ignored; an empty benchmark leaks nothing; repeated rows and rows that
share an id are judged each and give repeated results; a null doc_id is returned as
null; other columns are ignored, or carried by ``drop_leaks``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Collection
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.names import names_of

BUCKET_BITS = 18
PASSAGE, SPAN, STEP, BLOCK = 48, 24, 8, 256
#: Blocks of one pass over the documents: a space takes some 30 MB of a worker.
TOGETHER = 4
MOST_ITEMS = 200_000
#: Arrays of tasks are added in so many branches, then those: a group holds a branch's share of the tasks.
BRANCHES = 64
#: Passages a task of the SVD takes at least, and numbers in a part of its sums.
PER_TASK, STEP_OF_SUMS = 64, 2048
WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
LEAST_WEIGHT = 0.05
#: Singular values of less than this share of the greatest are those of rows that repeat one another.
LEAST_SHARE = 1e-3


ONES = np.ones(STEP, np.float32)
#: Latent spaces of a worker, by key.
KEPT: dict[str, "Latent"] = {}


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def buckets_of(words: Collection[str]) -> np.ndarray:
    return (names_of(words) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def added(pieces: DataFrame, kind: str) -> DataFrame:
    """(part, values) out of (part, branch, values): arrays of one part added up, in branches first."""
    import pyarrow as pa

    def add(table):
        values = np.sum([np.frombuffer(b, kind) for b in table.column("values").to_pylist()], axis=0, dtype=kind)
        return pa.table([table.column("part")[:1], table.column("branch")[:1], pa.array([values.tobytes()], pa.binary())], names=["part", "branch", "values"])

    shape = "part int, branch int, values binary"
    return pieces.groupBy("part", "branch").applyInArrow(add, shape).groupBy("part").applyInArrow(add, shape).select("part", "values")


def in_parts(total: np.ndarray, step: int):
    """A batch of (part, branch, values) of a task's array."""
    import pyarrow as pa
    from pyspark import TaskContext

    cuts = [total[k : k + step].tobytes() for k in range(0, len(total), step)]
    branch = TaskContext.get().partitionId() % BRANCHES
    return pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([branch] * len(cuts), pa.int32()), pa.array(cuts, pa.binary())], names=["part", "branch", "values"])


def tokenised(docs: DataFrame) -> DataFrame:
    """(_row, buckets) of every row: its columns as a struct, and the buckets of its words, written to shared scratch."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructType

    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.struct(*common.columns(docs)).alias("_row"))

    def run(batches):
        for batch in batches:
            found = [buckets_of(words_of(t or "")).tobytes() for t in texts_in(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, pa.binary())], names=["_row", "buckets"])

    out = StructType([*rows.schema.fields]).add("buckets", BinaryType())
    return common.materialise(rows.mapInArrow(lambda batches: common.released(run(batches)), out), "tokens")


def texts_in(batch):
    """The texts of the rows of a batch, one at a time."""
    return (t.as_py() for t in batch.column("_row").field("text"))


def document_frequencies(tokens: DataFrame, slices: int = 64) -> tuple[np.ndarray, int]:
    """(documents holding a word of each bucket; number of documents)."""
    size = 2**BUCKET_BITS // slices

    def count(batches):
        df = np.zeros(2**BUCKET_BITS + size, np.int64)  # the part after the last holds the number of documents
        for batch in batches:
            for own in batch.column("buckets"):
                df[np.frombuffer(own.as_buffer(), np.int32)] += 1  # an index that comes again counts once
                df[-1] += 1
        if df[-1]:
            yield in_parts(df, size)

    df = np.zeros((slices + 1, size), np.int64)
    counted = tokens.select("buckets").mapInArrow(count, "part int, branch int, values binary")
    for row in added(counted, "<i8").collect():
        df[row.part] = np.frombuffer(bytes(row["values"]), np.int64)
    return df[:-1].reshape(-1), int(df[-1, -1])


def weights_of(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies; words in over a tenth of all documents keep the least weight."""
    return np.maximum(np.log((n + 1) / (df + 1)) - np.log(10), LEAST_WEIGHT).astype(np.float32)


def places_of(a: list[str]) -> dict[str, int]:
    """The places of each word, one bit a word of ``a``."""
    at: dict[str, int] = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    return at


def lcs(a: list[str], b: list[str], at: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, one bit a word of ``a``; ``at``: its ``places_of``, where known."""
    at = places_of(a) if at is None else at
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if w in at:  # other words change nothing
            m = v & at[w]
            v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


@dataclass
class Item:
    item_id: int
    words: list[str]
    answer: set[str]

    @cached_property
    def at(self) -> dict[str, int]:
        return places_of(self.words)


def items_of(benchmark: DataFrame) -> list[Item]:
    """Benchmark items, distinct; one of more than ``MOST_ITEMS`` is refused."""
    rows = benchmark.select("item_id", "text").dropna().distinct().orderBy("item_id", "text").limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"a benchmark of more than {MOST_ITEMS} items: search it in parts")
    out = []
    for row in rows:
        words = words_of(row.text)
        if words:
            last = next((s for s in reversed(SENTENCE.split(row.text.strip())) if len(words_of(s)) >= 2), row.text)
            out.append(Item(row.item_id, words, set(words_of(last))))
    return out


@dataclass
class Passages:
    """Sparse TF-IDF rows: word rows, their weights (scaled to unit length), and the passage of each."""

    word: np.ndarray
    value: np.ndarray
    passage: np.ndarray
    n_words: int
    n: int

    @classmethod
    def of(cls, rows: list[np.ndarray], row: np.ndarray, weights: np.ndarray, n_words: int) -> Passages:
        value = [weights[w] / np.linalg.norm(weights[w]) for w in rows]
        return cls(row[np.concatenate(rows)], np.concatenate(value), np.repeat(np.arange(len(rows)), [len(w) for w in rows]), n_words, len(rows))

    def times(self, x: np.ndarray) -> np.ndarray:
        """A x, for x of a row a word."""
        out = np.zeros((self.n, x.shape[1]), np.float32)
        np.add.at(out, self.passage, self.value[:, None] * x[self.word])
        return out

    def words_of(self, x: np.ndarray) -> np.ndarray:
        """A'x, for x of a row a passage."""
        out = np.zeros((self.n_words, x.shape[1]), np.float32)
        np.add.at(out, self.word, self.value[:, None] * x[self.passage])
        return out


@dataclass
class Latent:
    """Latent space of one block: weights and rows of buckets, passages and their basis, the item passages and the item of each."""

    weights: np.ndarray
    row: np.ndarray
    used: np.ndarray
    passages: Passages
    basis: np.ndarray
    own: list[np.ndarray]
    owner: np.ndarray
    items: list[Item]
    least_cosine: float
    least_lcs: float
    answer_lcs: float
    least_answer: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def kept(self) -> Latent:
        """The same space as an earlier task of this worker has it, with what it has made of it."""
        if self.key not in KEPT and len(KEPT) >= 2 * TOGETHER:
            KEPT.clear()
        return KEPT.setdefault(self.key, self)

    @cached_property
    def vectors(self) -> np.ndarray:
        """Weighted latent vectors of the buckets' rows, and zeros for others at the end."""
        return np.vstack([self.plain * self.weights[self.used][:, None], np.zeros((1, self.basis.shape[1]), np.float32)])

    @cached_property
    def plain(self) -> np.ndarray:
        return self.passages.words_of(self.basis)

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.linalg.norm(self.vectors, axis=1).astype(np.float64)

    @cached_property
    def queries(self) -> np.ndarray:
        """Unit vectors of the item passages."""
        folded = np.array([self.weights[q] @ self.plain[self.row[q]] for q in self.own])
        return folded / np.maximum(np.linalg.norm(folded, axis=1, keepdims=True), 1e-12)

    def candidates(self, own: np.ndarray) -> list[tuple[int, dict[int, float]]]:
        """(item number, cosine by first word of all windows over the threshold) of each item, over a text's buckets."""
        n = len(own)
        weight = self.weights[own]
        energy = weight.astype(np.float64) ** 2
        start = np.arange(0, max(1, n - SPAN + STEP), STEP)
        end = np.minimum(start + SPAN, n)
        total = np.concatenate([[0.0], np.cumsum(energy)])
        reach = np.concatenate([[0.0], np.cumsum(self.lengths[self.row[own]])])
        norm2 = total[end] - total[start]
        live = np.flatnonzero(((reach[end] - reach[start]) ** 2 >= self.least_cosine**2 * norm2 * 0.999) & (norm2 > 0))
        found: dict[int, dict[int, float]] = self.short_candidates(own)
        for at in range(0, len(live), 4096):
            some = live[at : at + 4096]
            place = start[some][:, None] + np.arange(SPAN)
            ok = place < end[some][:, None]
            ids = own[np.where(ok, place, 0)]
            rows = np.where(ok, self.row[ids], -1)
            folded = np.zeros((len(some), self.vectors.shape[1]), np.float32)
            for k in range(SPAN):  # row -1, the last one, is zero; weights are in the vectors
                folded += self.vectors[rows[:, k]]
            cosine = folded @ self.queries.T / np.sqrt(norm2[some])[:, None].astype(np.float32)
            for w, q in zip(*np.nonzero(cosine >= self.least_cosine), strict=True):
                own_windows, place = found.setdefault(int(self.owner[q]), {}), int(start[some[w]])
                own_windows[place] = max(own_windows.get(place, -1.0), float(cosine[w, q]))
        return sorted(found.items())

    @cached_property
    def short(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Items under SPAN + STEP - 1 words: their numbers, needed words, table row by bucket row (0: in none), and the
        table: by item the product with the query, squared weight and 1 of a bucket that the item holds."""
        passages = [q for q, k in enumerate(self.owner) if len(self.items[k].words) < SPAN + STEP - 1]
        numbers = self.owner[passages].astype(np.int64) if passages else np.zeros(0, np.int64)
        buckets = [np.unique(buckets_of(self.items[k].words)) for k in numbers]
        used = np.unique(np.concatenate([np.zeros(0, np.int32), *buckets]))
        place = np.zeros(len(self.vectors), np.int32)
        place[self.row[used]] = np.arange(1, len(used) + 1)
        table = np.zeros((len(used) + 1, 3, len(numbers)), np.float32)
        for s, (q, own) in enumerate(zip(passages, buckets, strict=True)):
            at = np.searchsorted(used, own) + 1
            table[at, 0, s] = self.vectors[self.row[own]] @ self.queries[q]
            table[at, 1, s] = self.weights[own] ** 2
            table[at, 2, s] = 1
        least = min(self.least_lcs, self.answer_lcs)
        need = np.array([least * len(self.items[k].words) - 1e-6 for k in numbers])
        return numbers, need, place, table.reshape(len(used) + 1, -1)

    def short_candidates(self, own: np.ndarray) -> dict[int, dict[int, float]]:
        """Windows over the threshold by item number, for short items and over their words alone."""
        found: dict[int, dict[int, float]] = {}
        numbers, need, place, table = self.short
        rows = place[self.row[own]]
        words = np.flatnonzero(rows)
        if len(words) < need.min(initial=np.inf):
            return found
        n, wide, many = -(-len(own) // STEP), SPAN // STEP, len(numbers)
        # STEP words by STEP words; the edges are as wide as the words around any window
        edge = -(-(SPAN + STEP) // STEP) + 1
        sums = np.zeros((n + 2 * edge + wide, table.shape[1]), np.float32)
        padded = np.zeros(n * STEP, np.int32)
        padded[: len(rows)] = rows
        for at in range(0, n, 4096):
            part = table.take(padded[at * STEP : (at + 4096) * STEP], axis=0, mode="clip").reshape(-1, STEP, table.shape[1])
            sums[edge + at : edge + at + len(part)] = np.matmul(ONES, part)
        held = np.concatenate([np.zeros((1, many), np.float32), np.cumsum(sums[:, 2 * many :], axis=0)])
        last = max(1, n - wide + 1)  # windows
        near = held[wide + 2 * edge : wide + 2 * edge + last] - held[:last] >= need
        window = sum(sums[edge + k : edge + k + last, : 2 * many] for k in range(wide))
        dot, norm2 = window[:, :many], window[:, many:]
        live = near & (dot > 0) & (dot * dot >= self.least_cosine**2 * norm2)
        for w, s in zip(*np.nonzero(live), strict=True):
            found.setdefault(int(numbers[s]), {})[int(w) * STEP] = float(dot[w, s] / np.sqrt(norm2[w, s]))
        return found

    def judged(self, item: Item, words: list[str], first: int, last: int) -> tuple[float, float, bool]:
        """(common subsequence share, answer share, confirmed) of the words around the windows from ``first`` to ``last``."""
        near = words[max(0, first - len(item.words)) : last + SPAN + len(item.words)]
        share = lcs(item.words, near, item.at) / len(item.words)
        answer = len(item.answer.intersection(near)) / len(item.answer)
        return share, answer, share >= self.least_lcs or (share >= self.answer_lcs and answer >= self.least_answer)

    def confirmed(self, item: Item, words: list[str], windows: dict[int, float]) -> tuple[float, float] | None:
        """(common subsequence share, answer share) at the first window that confirms, those of great cosine first."""
        regions: list[list[int]] = []
        for place in sorted(windows):
            if regions and place - regions[-1][-1] <= SPAN:
                regions[-1].append(place)
            else:
                regions.append([place])
        for region in sorted(regions, key=lambda r: -max(map(windows.__getitem__, r))):
            share, answer, passed = self.judged(item, words, region[0], region[-1])
            if passed and len(region) > 1:  # a part may fail where the whole passes, never the other way round
                for place in sorted(region, key=lambda p: (-windows[p], p)):
                    share, answer, passed = self.judged(item, words, place, place)
                    if passed:
                        break
            if passed:
                return share, answer
        return None

    def leaks(self, own: np.ndarray, text: Callable[[], str]) -> list[tuple[int, float, float, float]]:
        """(item_id, cosine, common subsequence share, answer share) of each item that a text with these buckets leaks; few texts are asked for."""
        out, words = [], None
        for number, windows in self.candidates(own):
            words = words_of(text()) if words is None else words
            item = self.items[number]
            if shares := self.confirmed(item, words, windows):
                out.append((item.item_id, max(windows.values()), *shares))
        return out


@lru_cache(1)
def directions(rows: int, wide: int) -> np.ndarray:
    """The random matrix of the sketch, made where it is used."""
    return np.random.default_rng(3).standard_normal((rows, wide), np.float32)


def spread(spark, found: Passages, compute, kinds: str) -> DataFrame:
    """Rows that ``compute`` makes of the numbers of passages, dealt over tasks; the passages are bounded and go along."""
    tasks = min(-(-found.n // PER_TASK), common.shuffle_partitions(spark))

    def run(batches):
        numbers = np.array([n for batch in batches for n in batch.column("id").to_pylist()], np.int64)
        if len(numbers):
            yield compute(numbers)

    return spark.range(0, found.n, 1, tasks).mapInArrow(run, kinds)


def latent_basis(spark, found: Passages) -> np.ndarray:
    """U over the singular values (passages times rank) by a randomised SVD as wide as the passages or their words are many."""
    import pyarrow as pa

    wide = min(found.n, found.n_words)

    def sketch(numbers):
        one = np.isin(found.passage, numbers)
        part = Passages(found.word[one], found.value[one], np.searchsorted(numbers, found.passage[one]), found.n_words, len(numbers))
        rows = part.times(directions(found.n_words, wide))
        return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "values"])

    rows = spread(spark, found, sketch, "id bigint, values binary").collect()
    y = np.zeros((found.n, wide), np.float32)
    for r in rows:
        y[r.id] = np.frombuffer(bytes(r["values"]), np.float32)
    q, _ = np.linalg.qr(y)

    def gram(numbers):
        one = np.isin(found.passage, numbers)
        part = Passages(found.word[one], found.value[one], np.searchsorted(numbers, found.passage[one]), found.n_words, len(numbers))
        z = part.times(found.words_of(q)).astype(np.float64)  # the rows of A A'Q
        return in_parts((q[numbers].T.astype(np.float64) @ z).reshape(-1), STEP_OF_SUMS)

    total = np.zeros(q.shape[1] ** 2)
    for r in added(spread(spark, found, gram, "part int, branch int, values binary"), "<f8").collect():
        values = np.frombuffer(bytes(r["values"]), np.float64)
        total[r.part * STEP_OF_SUMS :][: len(values)] = values
    total = total.reshape(q.shape[1], -1)
    values, rotation = np.linalg.eigh((total + total.T) / 2)
    best = np.flatnonzero(values > LEAST_SHARE**2 * values.max())[::-1]
    return (q @ rotation[:, best].astype(np.float32)) / np.sqrt(np.maximum(values[best], 1e-9)).astype(np.float32)


def latent_spaces(tokens: DataFrame, items: list[Item], least_cosine: float = 0.3, least_lcs: float = 0.6, answer_lcs: float = 0.45, least_answer: float = 0.8) -> list[Latent]:
    """One latent space for each block of benchmark passages."""
    spark = tokens.sparkSession
    df, n = document_frequencies(tokens)
    weights = weights_of(df, n)
    blocks: list[list[tuple[int, np.ndarray]]] = []
    for k, item in enumerate(items):  # an item lies in one block
        passages = [(k, buckets_of(item.words[a : a + PASSAGE])) for a in range(0, len(item.words), PASSAGE)]
        if not blocks or len(blocks[-1]) + len(passages) > BLOCK:
            blocks.append([])
        blocks[-1] += passages
    out = []
    for own in blocks:
        rows = [q for _, q in own]
        used = np.unique(np.concatenate(rows))
        row = np.full(2**BUCKET_BITS, -1, np.int32)
        row[used] = np.arange(len(used))
        found = Passages.of(rows, row, weights, len(used))
        basis = latent_basis(spark, found)
        mine = sorted({k for k, _ in own})
        owner = np.searchsorted(mine, [k for k, _ in own])
        out.append(Latent(weights, row, used, found, basis, rows, owner, [items[k] for k in mine], least_cosine, least_lcs, answer_lcs, least_answer))
    common.release()
    return out


def together(spaces: list[Latent]) -> list[list[Latent]]:
    """Spaces by the pass over the documents that searches them."""
    return [spaces[k : k + TOGETHER] for k in range(0, len(spaces), TOGETHER)]


def leaks_in(batch, spaces: list[Latent]):
    """The leaks of each row of a batch, found as they are asked for."""
    spaces = [space.kept() for space in spaces]
    for own, text in zip(batch.column("buckets"), batch.column("_row").field("text"), strict=True):
        found = np.frombuffer(own.as_buffer(), np.int32)
        yield (leak for space in spaces for leak in space.leaks(found, text.as_py)) if len(found) else iter(())


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share) of every item that a document leaks."""
    import pyarrow as pa

    kinds = "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_share double"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64())])
    items = items_of(benchmark)
    if not items:
        return docs.sparkSession.createDataFrame([], kinds)
    tokens = tokenised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = None
    for spaces in together(latent_spaces(tokens, items, **options)):

        def search(batches, spaces=spaces):
            for batch in batches:
                ids = batch.column("_row").field("doc_id").to_pylist()
                rows = [(doc, *leak) for doc, found in zip(ids, leaks_in(batch, spaces), strict=True) for leak in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        found = tokens.mapInArrow(lambda batches, search=search: common.released(search(batches)), kinds)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that leak no item, with all their columns."""
    import pyarrow as pa

    items = items_of(benchmark)
    if not items:
        return docs
    rows = tokens = tokenised(docs)
    for spaces in together(latent_spaces(tokens, items, **options)):

        def clean(batches, spaces=spaces):
            for batch in batches:
                yield batch.filter(pa.array([next(found, None) is None for found in leaks_in(batch, spaces)], pa.bool_()))

        rows = rows.mapInArrow(lambda batches, clean=clean: common.released(clean(batches)), tokens.schema)
    return common.plain_rows(rows, docs)

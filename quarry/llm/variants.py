"""Spelling variants: words of a corpus one edit apart, by composing acceptors.

The pairs wanted are the paths of (vocabulary acceptor) o (one-edit transducer) o
(vocabulary acceptor). A pair whose shorter word has m code points shares its first
m // 2 or its last m - m // 2 of them, so the composition falls apart by the state that
the forward or the backward acceptor is in after that half: every word goes to the
partition of its half, for m of its own length and of one less. A partition with more
than ``partition_words`` words is divided again by the halves of what is left of its
words, so that a prefix which holds a third of all words is no hot task.

Each task takes whole partitions sorted by what is left, builds the minimised acceptor
of these remainders (states register by their transitions, bottom up), and composes:
along the diagonal no edit is spent; a replacement leaves it for two different
transitions, an insertion for one transition and none; after that both sides must read
the same as far as the shorter word goes, and two sides in one state share all they
accept. States know how many words they accept, so that a path is the number of its
word. An insertion counts only at the rightmost place that gives the pair, and never at
the border of a shared ending, so no pair is found twice.

Words are counted in tasks before they are shuffled. Words, their counts and their near
words are tables; nothing of them passes through the driver. Roots are found by
doubling: a form has at least twice the count, so some five rounds settle all chains.

Defined cases: null or empty text has no words; characters outside A-Z, a-z and
U+00C0-U+00FF separate; a null doc_id is written as an empty string where ids are hashed;
repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: A task's counts go out whenever it holds this many words.
HELD_WORDS = 1_000_000
PARTITION_WORDS = 20_000
#: Remainders that share an acceptor, in whole partitions.
ACCEPTOR_WORDS = 50_000
#: Letters as one Latin-1 byte each, A-Z in lower case; all else is a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def words_of(doc_id: int | None, text: str, noise: int | None) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of a text, in Latin-1; the words whose hash ``noise`` divides lose one letter."""
    runs = Counter(text.encode("latin-1", "replace").translate(LETTERS).split())
    if noise is None:
        yield from runs.items()
        return
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
        if h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, min_chars: int, min_count: int, noise: int | None) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""
    import pyarrow as pa

    def rows(counts: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in counts]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for word, n in words_of(doc_id, text.as_py(), noise):
                    if len(word) >= min_chars:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    partial = common.texts(docs).mapInArrow(lambda batches: common.released(count(batches)), "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def halves(rows: DataFrame) -> DataFrame:
    """Rows (key, rest, m, ending) by both halves: ``rest`` is what a word does not share with its partition, ``m`` the shorter length of rests, ``ending`` whether a shared ending follows."""
    m, rest = F.col("m"), F.col("rest")
    h = F.floor(m / 2).cast("int")
    size = F.length(rest)
    key = F.col("key")

    def part(mark: str, shared: Column, left: Column, of: Column, ending: Column) -> Column:
        return F.struct(F.concat(key, F.lit(mark), shared).alias("key"), left.alias("rest"), of.alias("m"), ending.alias("ending"))

    head = part(">", rest.substr(F.lit(1), h), rest.substr(h + 1, size), m - h, F.col("ending"))
    tail = part("<", rest.substr(size - (m - h) + 1, m - h), rest.substr(F.lit(1), size - (m - h)), h, F.lit(True))
    return rows.select("word", "n", F.explode(F.array(head, tail)).alias("p")).select("word", "n", "p.*")


def partitions(words: DataFrame, min_chars: int, partition_words: int) -> DataFrame:
    """(word, n, key, rest, m, ending): every word in the partitions of its halves, none of them over the bound unless its rests have one letter."""
    length = F.length("word")
    of = F.explode(F.filter(F.array(length, length - 1), lambda m: m >= min_chars))
    rows = words.select("word", "n", F.col("word").alias("rest"), of.alias("m"), F.lit(False).alias("ending"))
    rows = common.materialise(halves(rows.withColumn("key", F.col("m").cast("string"))), "halves")
    done = []
    while True:
        large = rows.filter("m > 1").groupBy("key").count().filter(F.col("count") > partition_words).select("key")
        large = common.materialise(large, "large")
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, "key", "left_anti"))
        rows = common.materialise(halves(rows.join(large, "key", "left_semi")), "halves")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class Acceptor:
    """Minimised acceptors of sorted lists of strings; lists that are added share states."""

    def __init__(self):
        self.register: dict[tuple, int] = {}
        #: Per state: its transitions as (letter, state, words accepted before it), words accepted, greatest and least length.
        self.moves: list[tuple[tuple[str, int, int], ...]] = []
        self.count: list[int] = []
        self.longest: list[int] = []
        self.shortest: list[int] = []

    def _state(self, final: bool, moves: list[tuple[str, int]]) -> int:
        signature = (final, *moves)
        state = self.register.get(signature)
        if state is None:
            state = self.register[signature] = len(self.moves)
            before, out = int(final), []
            for letter, target in moves:
                out.append((letter, target, before))
                before += self.count[target]
            self.moves.append(tuple(out))
            self.count.append(before)
            self.longest.append(max((self.longest[t] + 1 for _, t in moves), default=0))
            self.shortest.append(0 if final else min(self.shortest[t] + 1 for _, t in moves))
        return state

    def add(self, words: Iterable[str]) -> int:
        """Initial state of the acceptor of distinct strings in ascending order; word k is the one that accepts with number k."""
        path: list[list] = [[False, []]]  # open states of the last word
        last = ""
        for word in words:
            same = 0
            for a, b in zip(word, last):  # noqa: B905
                if a != b:
                    break
                same += 1
            while len(path) > same + 1:
                final, moves = path.pop()
                path[-1][1].append((last[len(path) - 1], self._state(final, moves)))
            path.extend([False, []] for _ in range(len(word) - same))
            path[-1][0] = True
            last = word
        while len(path) > 1:
            final, moves = path.pop()
            path[-1][1].append((last[len(path) - 1], self._state(final, moves)))
        return self._state(*path[0])

    def shared(self, a: int, b: int, i: int, j: int, left: int, but: str = "") -> Iterator[tuple[int, int]]:
        """Numbers of the words of ``left`` letters that two states both accept, counted from ``i`` and ``j``; ``but`` is no first letter of them."""
        open_pairs = [(a, b, i, j, left, but)]
        while open_pairs:
            a, b, i, j, left, but = open_pairs.pop()
            if self.shortest[a] > left or self.shortest[b] > left or self.longest[a] < left or self.longest[b] < left:
                continue
            if left == 0:
                yield i, j
            elif a == b and not but and self.shortest[a] == self.longest[a]:
                yield from zip(range(i, i + self.count[a]), range(j, j + self.count[b]))  # noqa: B905
            else:
                other = {letter: (target, before) for letter, target, before in self.moves[b]}
                for letter, target, before in self.moves[a]:
                    if letter != but and letter in other:
                        open_pairs.append((target, other[letter][0], i + before, j + other[letter][1], left - 1, ""))

    def one_edit(self, start: int, m: int, ending: bool) -> Iterator[tuple[int, int]]:
        """Numbers of the pairs of words one edit apart whose shorter one has ``m`` letters, each pair once; with ``ending`` nothing is inserted at the end."""
        diagonal = [(start, 0, m)]
        while diagonal:
            q, i, left = diagonal.pop()
            moves = self.moves[q]
            for k, (letter, target, before) in enumerate(moves):
                if left:
                    for _, target2, before2 in moves[k + 1 :]:
                        yield from self.shared(target, target2, i + before, i + before2, left - 1)
                # the longer word reads one letter more, and then both go on with another letter or end
                if left or not ending:
                    yield from self.shared(q, target, i, i + before, left, letter)
                if left and self.count[target] > 1:
                    diagonal.append((target, i + before, left - 1))


def near_words(rows: DataFrame) -> DataFrame:
    """(word, n, n_near, best) by partition: the near words that a word has there, and the one with the largest count as (-n, word)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL("word string, n bigint, n_near bigint, best struct<minus_n: bigint, word: string>")
    schema = to_arrow_schema(out)

    def groups(batches) -> Iterator[tuple[int, bool, list[str], list[str], list[int]]]:
        """Whole partitions of two words or more: (m, ending, rests, words, counts)."""
        key, of, held = None, (0, False), ([], [], [])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "m", "ending", "rest", "word", "n")]
            for k, m, ending, *values in zip(*columns, strict=True):
                if k != key:
                    if len(held[0]) > 1:
                        yield *of, *held
                    key, of, held = k, (m, ending), ([], [], [])
                for own, v in zip(held, values, strict=True):
                    own.append(v)
        if len(held[0]) > 1:
            yield *of, *held

    def run(batches):
        acceptor, size, found = Acceptor(), 0, []
        for m, ending, rests, words, counts in groups(batches):
            start = acceptor.add(rests)
            near, best = [0] * len(words), [None] * len(words)
            for i, j in acceptor.one_edit(start, m, ending):
                for a, b in ((i, j), (j, i)):
                    near[a] += 1
                    rank = (-counts[b], words[b])
                    if best[a] is None or rank < best[a]:
                        best[a] = rank
            found.extend((w, n, c, r) for w, n, c, r in zip(words, counts, near, best, strict=True) if c)
            size += len(words)
            if size >= ACCEPTOR_WORDS:
                acceptor, size = Acceptor(), 0
            if len(found) >= 20_000:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)

    def batch_of(found):
        words, counts, near, best = zip(*found, strict=True)
        ranks = pa.StructArray.from_arrays([pa.array([r[0] for r in best], pa.int64()), pa.array([r[1] for r in best], pa.string())], fields=list(schema.field("best").type))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(near, pa.int64()), ranks], schema=schema)

    spread = rows.select("key", "m", "ending", "rest", "word", "n").repartition(common.shuffle_partitions(rows.sparkSession), "key")
    return spread.sortWithinPartitions("key", "rest").mapInArrow(lambda batches: common.released(run(batches)), out)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the last word of their chain, by doubling."""
    state = common.materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while not state.filter("open").isEmpty():
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("open").alias("next_open"))
        moved = state.filter("open").join(onward, "root", "left")
        moved = moved.select("word", F.coalesce("next", "root").alias("root"), F.coalesce("next_open", F.lit(False)).alias("open"))
        state = common.materialise(state.filter("not open").unionByName(moved), "roots")
    return state.select("word", "root")


def spelling_variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, noise: int | None = None, ratio: int = 2, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    ``form`` is the near word with the largest count (ties: the first in code-point
    order) if that count is ``ratio`` (at least 2) times the word's or more; ``root`` is
    where forms lead. ``noise`` takes a letter out of each run whose crc32, with its
    document's id, it divides.
    """
    if ratio < 2:
        raise ValueError("a form needs a larger count than its word")
    words = common.materialise(vocabulary(docs, min_chars, min_count, noise), "words")
    none = F.lit(None).cast("struct<minus_n: bigint, word: string>")
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("best"))
    rows = alone.unionByName(near_words(partitions(words, min_chars, partition_words)))
    rows = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    accepted = -F.col("best.minus_n") >= F.col("n") * ratio
    rows = rows.select("word", "n", "n_near", F.when(accepted, F.col("best.word")).alias("form"), F.when(accepted, -F.col("best.minus_n")).alias("form_n"))
    rows = common.materialise(rows, "forms")
    linked = rows.join(roots(rows.filter("form is not null")), "word", "left")
    return linked.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

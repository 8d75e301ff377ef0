"""Substring dedup by recompression: long word sequences that an earlier document holds are removed.

Words have global 64-bit names. A round first names runs (a name that repeats k times
becomes one symbol for the name and k), then pairs: symbols fall on a left or right
side by a hash, and a left one followed by a right one becomes one symbol. Two more
namings join neighbours two by two, so that a high-level symbol stands for four
symbols of the round. Names are functions of what they stand for: every task names
alike, and equal substrings get equal symbols, except near their ends. How near is
kept with each symbol: the words that were looked at to settle it.

A window of ``WINDOW`` words thus has a form of its own, whatever lies around it: the
symbols settled by its words alone, and the words popped at both ends. A first Spark
round finds the high-level symbols that several documents share: of those settled in
a window the one of least rank stands for it (where runs leave none, the whole form
does), so windows whose symbol one document alone holds can't be repeated, and none
that is repeated is missed. A second round verifies the windows revealed: their whole
forms, named in 96 bits, against the smallest document that holds them.

Documents travel in packs of about ``PACK_CHARS`` characters that are written once.
Packs send their names to buckets and get one bit for each name back; what a bucket
gets is one entry for a name and pack at most, so a passage in a third of all
documents is no hot key. Buckets grow in number with the text, ``BUCKET_CHARS``
characters each at most. Names are compared as sorted arrays; no pairs of documents
are made.

Defined cases: null or empty text has no words; texts shorter than a window stay
whole; repeated rows of one id are no earlier document for each other, and each is
returned; a null doc_id sorts before all others and is returned as null; other
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.names import names_of

WINDOW, JOINED = 13, 4
PACK_CHARS, BUCKET_CHARS = 4_000_000, 64_000_000
WORDS = re.compile(common.WORD)
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bases of the sums that name sequences (odd).
BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * P2
    x = (x ^ (x >> np.uint64(27))) * P3
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * P1 + b)


@dataclass
class Level:
    """Symbols in text order: name, first word, and the words [low, high) that settle it; a document's end settles nothing."""

    name: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray


def neighbours(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Whether the symbol before, and the one after, is of the same document."""
    same = level.doc[1:] == level.doc[:-1]
    return np.concatenate([[False], same]), np.concatenate([same, [False]])


def run_round(level: Level, ends: np.ndarray) -> Level:
    """Runs of one name as one symbol, named by the name and its count; ``ends``: first word after each document."""
    before, _ = neighbours(level)
    first = np.ones(len(level.name), bool)
    first[1:] = ~before[1:] | (level.name[1:] != level.name[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(first)) - 1
    count = (last - at + 1).astype(np.uint64)
    name = level.name[at]
    name = np.where(count > 1, joined(name, mix(count)), name)
    doc = level.doc[at]
    low = np.where(before[at], level.low[at - 1], level.start[at] - 1)
    after = np.minimum(last + 1, len(first) - 1)
    high = np.where((last + 1 < len(first)) & (level.doc[after] == doc), level.high[after], ends[doc] + 1)
    return Level(name, level.start[at], low, high, doc)


def pair_round(level: Level, ends: np.ndarray, salt: int = 1) -> Level:
    """Left symbols with a right symbol behind them as one symbol."""
    left = (mix(level.name ^ np.uint64(salt)) >> np.uint64(40)) & np.uint64(1) == 0
    before, after = neighbours(level)
    pair = np.zeros(len(left), bool)
    pair[:-1] = left[:-1] & ~left[1:] & after[:-1]
    first = np.ones(len(left), bool)
    first[1:] = ~pair[:-1]
    at = np.flatnonzero(first)
    name = level.name[at]
    two = pair[at]
    name[two] = joined(name[two], level.name[at[two] + 1])
    right = np.minimum(at + 1, len(left) - 1)
    low = np.where(left[at], level.low[at], np.where(before[at], level.low[at - 1], level.start[at] - 1))
    high = np.where(left[at], np.where(after[at], level.high[right], ends[level.doc[at]] + 1), level.high[at])
    return Level(name, level.start[at], low, high, level.doc[at])


def four_round(level: Level) -> Level:
    """Symbols for each four neighbours of one document, joined two by two."""
    n = len(level.name) - JOINED + 1
    if n <= 0:
        return Level(*[x[:0] for x in (level.name, level.start, level.low, level.high, level.doc)])
    two = joined(level.name[:-1], level.name[1:])
    name = joined(two[:n], two[2 : n + 2])
    own = level.doc[:n] == level.doc[JOINED - 1 :]
    return Level(name[own], level.start[:n][own], level.low[:n][own], level.high[JOINED - 1 :][own], level.doc[:n][own])


class Sums:
    """Names of ranges of a sequence: sums of its names times powers of a base, moved to the power 0."""

    def __init__(self, names: np.ndarray, base: np.uint64):
        power = np.full(len(names) + 1, base, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * power[:-1], dtype=np.uint64)])
        self.back = np.full(len(names) + 1, np.uint64(pow(int(base), -1, 2**64)), np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[first]) * self.back[first]


class Pack:
    """Words of several documents as one array of names, and their symbols."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.words = ids, [WORDS.findall(t) for t in texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(sizes)
        self.names = names_of(list(chain.from_iterable(self.words)))
        self.doc = np.repeat(np.arange(len(ids)), sizes)
        place = np.arange(len(self.names))
        plain = Level(self.names, place, place, place + 1, self.doc)
        self.symbols = pair_round(run_round(plain, self.ends), self.ends) if len(place) else plain

    def windows(self) -> np.ndarray:
        """Starts of the windows that lie in one document."""
        n = len(self.names) - WINDOW + 1
        if n <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :])

    def stands(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(for each window the first word of the high-level symbol that stands for it, -1 without one; names by first word)."""
        high, n = four_round(self.symbols), len(self.names)
        name, rank = np.zeros(n, np.uint64), np.full(n, FULL, np.uint64)
        name[high.start], rank[high.start] = high.name, mix(high.name)
        # words that settle a symbol before its first word, and from there on; a window holds so many at most
        left, right = np.full(n, WINDOW, np.int8), np.full(n, WINDOW, np.int8)
        left[high.start] = np.minimum(high.start - high.low, WINDOW)
        right[high.start] = np.minimum(high.high - high.start, WINDOW + 1)
        m = max(0, n - WINDOW + 1)
        best, where = np.full(m, FULL, np.uint64), np.full(m, -1, np.int8)
        for shift in range(WINDOW - JOINED + 1):  # the leftmost of equals
            at = slice(shift, shift + m)
            better = np.flatnonzero((left[at] <= shift) & (right[at] <= WINDOW - shift) & (rank[at] < best))
            best[better] = rank[at][better]
            where[better] = shift
        own = where[starts]
        return np.where(own < 0, -1, starts + own), name

    def forms(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96-bit names (64 and 32 bits) of windows: words popped left, settled symbols, words popped right."""
        s = self.symbols
        first = np.searchsorted(s.low, starts, "left")
        after = np.searchsorted(s.high, starts + WINDOW, "right")
        core = after > first
        after = np.where(core, after, first)
        begin = np.where(core, s.start[np.minimum(first, len(s.start) - 1)], starts + WINDOW)
        end = np.where(core, np.append(s.start, len(self.names))[after], starts + WINDOW)
        # the symbol after the core may be of the next document
        end = np.minimum(end, self.ends[self.doc[starts]])
        out = []
        for base in BASES:
            words, symbols = Sums(self.names, base), Sums(s.name, base)
            shape = (begin - starts).astype(np.uint64) * P1 + (end - starts).astype(np.uint64) * P2
            out.append(joined(joined(words.of(starts, begin) + shape, symbols.of(first, after)), words.of(end, starts + WINDOW)))
        return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)

    def revealing(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words where what stands for windows begins, names of these, index of each window's)."""
        place, name = self.stands(starts)
        where, index = np.unique(place[place >= 0], return_inverse=True)
        own = np.empty(len(starts), np.int64)
        own[place >= 0] = index.reshape(-1)
        bare = np.flatnonzero(place < 0)
        own[bare] = len(where) + np.arange(len(bare))
        forms = self.forms(starts[bare])[0] if len(bare) else np.empty(0, np.uint64)
        return np.concatenate([where, starts[bare]]), np.concatenate([name[where], forms]), own


def by_bucket(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct names, bucket of each, index of each input name); sorted by bucket, then name."""
    own, inverse = np.unique(names, return_inverse=True)
    bucket = (own >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(own), np.int64)
    back[order] = np.arange(len(own))
    return own[order], bucket[order], back[inverse.reshape(-1)]


def short(names: np.ndarray) -> bytes:
    """The low 40 bits of names, five bytes each."""
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unshort(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def slices(bucket: np.ndarray):
    """(bucket, slice) of each run of equal buckets."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(bucket)], strict=True):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def marked(replies, kind: int, buckets: np.ndarray) -> np.ndarray:
    """The bits of the replies of one kind, in the order of ``by_bucket``."""
    found = {b: bits for k, b, bits in replies if k == kind}
    out = np.zeros(len(buckets), bool)
    for b, s in slices(buckets):
        out[s] = np.unpackbits(np.frombuffer(found[b], np.uint8), count=s.stop - s.start).astype(bool)
    return out


def sent_names(pack: Pack, buckets: int):
    """(bucket, names, flags) to send: standing names, with those of several documents of the pack flagged."""
    where, names, _ = pack.revealing(pack.windows())
    own, bucket, back = by_bucket(names, buckets)
    least, most = np.full(len(own), 2**62), np.full(len(own), -1)
    ids = np.array(pack.ids, np.int64)
    rank = np.unique(ids, return_inverse=True)[1].reshape(-1)
    np.minimum.at(least, back, rank[pack.doc[where]])
    np.maximum.at(most, back, rank[pack.doc[where]])
    for b, s in slices(bucket):
        yield b, short(own[s]), np.packbits(most[s] > least[s]).tobytes()


def groups_of(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one of each distinct pair, in the order of the pairs; index of each pair among these)."""
    order = np.argsort(high, kind="stable")
    new = np.ones(len(order), bool)
    same = high[order[1:]] == high[order[:-1]]
    if (same & (low[order[1:]] != low[order[:-1]])).any():
        order = np.lexsort((low, high))
        same = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
    new[1:] = ~same
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    return order[new], index


def candidates(pack: Pack, replies, buckets: int):
    """(window starts, distinct forms as two arrays, buckets, index, document of each window, smallest id of each form) of windows that may be repeated."""
    starts = pack.windows()
    _, names, own = pack.revealing(starts)
    _, bucket, back = by_bucket(names, buckets)
    if len(starts):
        starts = starts[marked(replies, 0, bucket)[back][own]]
    high, low = pack.forms(starts) if len(starts) else (np.empty(0, np.uint64), np.empty(0, np.uint32))
    one, index = groups_of(high, low)
    high, low = high[one], low[one]
    bucket = (high >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    back = back[index]
    ids = np.array(pack.ids, np.int64)[pack.doc[starts]] if len(starts) else np.empty(0, np.int64)
    least = np.full(len(order), 2**63 - 1)
    np.minimum.at(least, back, ids)
    return starts, high[order], low[order], bucket[order], back, ids, least


def removed_words(pack: Pack, replies, buckets: int) -> np.ndarray:
    """Which words repeated windows cover."""
    starts, _, _, bucket, back, ids, least = candidates(pack, replies, buckets)
    edge = np.zeros(len(pack.names) + 1, np.int64)
    if len(starts):
        gone = starts[marked(replies, 1, bucket)[back] | (ids > least[back])]
        edge[gone] += 1
        edge[gone + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


# The jobs.


def packs_of(docs: DataFrame, pack_chars: int) -> DataFrame:
    """(pack, ids, sizes, blob): documents in packs of compressed texts, made where they are read."""
    import pyarrow as pa
    from pyspark import TaskContext

    schema = pa.schema([("pack", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary())])

    def run(batches):
        number, ids, data, size = TaskContext.get().partitionId() << 33, [], [], 0

        def row():
            raw = b"".join(data)
            blob = pa.compress(raw, "zstd", asbytes=True) if raw else b""
            return pa.RecordBatch.from_pylist([{"pack": number, "ids": ids, "sizes": [len(x) for x in data], "blob": blob}], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column("_id"), batch.column("text"), strict=True):
                if ids and size + len(text.as_buffer()) > pack_chars:
                    yield row()
                    number, ids, data, size = number + 1, [], [], 0
                ids.append(doc.as_py())
                data.append(text.as_buffer().to_pybytes())
                size += len(data[-1])
        if ids:
            yield row()

    rows = common.texts(docs).select(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("_id"), "text")
    return rows.mapInArrow(run, "pack bigint, ids array<bigint>, sizes array<bigint>, blob binary")


def unpack(ids: list[int], sizes: list[int], blob: bytes) -> Pack:
    import pyarrow as pa

    total, at, texts = sum(sizes), 0, []
    raw = pa.decompress(blob, total, "zstd", asbytes=True) if total else b""
    for size in sizes:
        texts.append(raw[at : at + size].decode())
        at += size
    return Pack(ids, texts)


def substring_dedup(docs: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row."""
    import pyarrow as pa

    spark = docs.sparkSession
    packs = common.materialise(packs_of(docs, pack_chars), "packs")
    chars = packs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(2 * common.shuffle_partitions(spark), -(-chars // BUCKET_CHARS))
    reply_schema = pa.schema([("pack", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary())])
    reply_kinds = "pack bigint, kind int, bucket bigint, bits binary"

    def rows_of(table):
        return [unpack(*row) for row in zip(table.column("ids").to_pylist(), table.column("sizes").to_pylist(), table.column("blob").to_pylist(), strict=True)]

    def send(batches):
        schema = pa.schema([("pack", pa.int64()), ("bucket", pa.int64()), ("names", pa.binary()), ("flags", pa.binary())])
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                number = part.column("pack")[0].as_py()
                rows = [(number, *row) for row in sent_names(rows_of(part)[0], buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def bits_by_row(table, sizes, bits, kind):
        cut = np.split(bits, np.cumsum(sizes)[:-1])
        return pa.table([table.column("pack"), pa.array([kind] * len(sizes), pa.int32()), table.column("bucket"), pa.array([np.packbits(b).tobytes() for b in cut], pa.binary())], schema=reply_schema)

    def shared_names(table):
        names = [unshort(x) for x in table.column("names").to_pylist()]
        sizes = [len(x) for x in names]
        flags = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) for f, n in zip(table.column("flags").to_pylist(), sizes, strict=True)])
        every = np.concatenate(names)
        _, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
        inverse = inverse.reshape(-1)
        several = count > 1
        several[inverse[flags]] = True
        return bits_by_row(table, sizes, several[inverse], 0)

    replies = packs.mapInArrow(send, "pack bigint, bucket bigint, names binary, flags binary")
    replies = common.materialise(replies.groupBy("bucket").applyInArrow(shared_names, reply_kinds), "replies")

    def replies_of(table):
        return list(zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True))

    window_kinds = "pack bigint, bucket bigint, high binary, low binary, least binary"
    window_schema = pa.schema([("pack", pa.int64()), ("bucket", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("least", pa.binary())])

    def windows(left, right):
        rows = []
        for number, pack in zip(left.column("pack").to_pylist(), rows_of(left), strict=True):
            _, high, low, bucket, _, _, least = candidates(pack, replies_of(right), buckets)
            rows += [(number, b, high[s].tobytes(), low[s].tobytes(), least[s].tobytes()) for b, s in slices(bucket)]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(window_schema.types)], schema=window_schema)

    def earlier(table):
        every = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        high, least = every("high", np.uint64), np.concatenate(every("least", np.int64))
        one, index = groups_of(np.concatenate(high), np.concatenate(every("low", np.uint32)))
        first = np.full(len(one), 2**63 - 1)
        np.minimum.at(first, index, least)
        return bits_by_row(table, [len(x) for x in high], first[index] < least, 1)

    grouped = packs.groupBy("pack")
    found = grouped.cogroup(replies.groupBy("pack")).applyInArrow(windows, window_kinds)
    found = found.groupBy("bucket").applyInArrow(earlier, reply_kinds)
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def kept(left, right):
        rows = []
        for pack in rows_of(left):
            gone, at = removed_words(pack, replies_of(right), buckets), 0
            for doc, words in zip(pack.ids, pack.words, strict=True):
                own = gone[at : at + len(words)]
                at += len(words)
                n = int(own.sum())
                text = " ".join(words) if not n else " ".join([w for w, g in zip(words, own.tolist(), strict=True) if not g])
                rows.append((None if doc == common.NULL_ID else doc, len(words), n, text))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(out_schema.types)], schema=out_schema)

    both = replies.unionByName(found)
    return grouped.cogroup(both.groupBy("pack")).applyInArrow(kept, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")

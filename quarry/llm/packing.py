"""Packing of documents into fixed-length token sequences by minimum bin slack.

A document is its token ids and the separator id. Whole windows are cut off first;
what is left of every document goes into a pool of lengths. For each sequence a
bitset subset-sum over the pool's length multiset (lengths taken in powers of two
of their counts) finds the fill closest to the capacity, with the longest length
always in; backtracking gives the counts, and the same multiset is used as often
as the pool allows. Where even the best fill leaves slack, one piece is cut to close
it. The last pieces of a pool that fill no window are laid out in sequences whose
lengths are powers of two, which need no padding.

Pools are per partition and packed whenever they hold ``POOL_TOKENS`` tokens, so the
memory of a task is bounded and nothing is shuffled. ``sequence_id`` holds the
partition number in its upper bits, as monotonically_increasing_id does.

The ids are those of the ``tokenizers`` file of the same vocabulary; they are made
by ``tiktoken``, which takes a quarter of the time, and by ``tokenizers`` where that
library's pattern gives up (a million blanks in a row). The added tokens of that file
(``<|endoftext|>``) are matched in the text first, as ``tokenizers`` does.

Defined cases: null or empty text is the separator alone; repeated rows are packed
each; a null doc_id stays null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm import common

CAPACITY = 1024
POOL_TOKENS = 1 << 22
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"


@lru_cache(2)
def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """Ids by a rank file, a path or a name that ``public_tokenizers`` knows, and the added tokens of the json beside it."""
    import base64
    import json
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    added = {}
    if os.path.exists(beside := os.path.splitext(path)[0] + ".json"):
        with open(beside, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    fast = partial(encoding.encode, allowed_special="all")

    def encode(text: str) -> list[int]:
        try:
            return fast(text)
        except ValueError:  # its pattern stops at very long runs of white space
            if not os.path.exists(beside):
                raise
            return Tokenizer.from_file(beside).encode(text, add_special_tokens=False).ids

    return encode


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Multiset of at most ``counts`` whose sum is closest to ``capacity`` from below; the longest length is in."""
    lengths = sorted(counts, reverse=True)
    must = lengths[0]
    room = capacity - must
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        left, take = min(counts[length] - (length == must), room // length), 1
        while left > 0:
            take = min(take, left)
            more = (reach | reach << take * length) & mask
            if more != reach:
                trail.append((length, take, reach))
                reach = more
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    sum_left, used = reach.bit_length() - 1, {must: 1}
    for length, take, before in reversed(trail):
        if not before >> sum_left & 1:
            used[length] = used.get(length, 0) + take
            sum_left -= take * length
    return used


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int | None, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:at], self.total), Piece(self.doc, self.start + at, self.ids[at:], self.total)


class Pool:
    """Pieces shorter than the capacity, by length."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.tokens, self.by_length = capacity, 0, {}

    def add(self, piece: Piece) -> None:
        self.by_length.setdefault(len(piece.ids), []).append(piece)
        self.tokens += len(piece.ids)

    def take(self, length: int) -> Piece:
        own = self.by_length[length]
        piece = own.pop()
        if not own:
            del self.by_length[length]
        self.tokens -= length
        return piece

    def full(self) -> Iterator[list[Piece]]:
        """Sequences of exactly the capacity, until fewer tokens are left."""
        while self.tokens >= self.capacity:
            used = best_fill({k: len(v) for k, v in self.by_length.items()}, self.capacity)
            slack = self.capacity - sum(k * n for k, n in used.items())
            times = 1 if slack else min(len(self.by_length[k]) // n for k, n in used.items())
            for _ in range(times):
                sequence = [self.take(k) for k, n in used.items() for _ in range(n)]
                if slack:  # all that is left is longer than the slack
                    head, tail = self.take(min(self.by_length)).cut(slack)
                    sequence.append(head)
                    self.add(tail)
                yield sequence

    def rest(self) -> Iterator[list[Piece]]:
        """What is left, in sequences whose lengths are powers of two."""
        left = [self.take(k) for k in sorted(self.by_length, reverse=True) for _ in range(len(self.by_length[k]))]
        total = sum(len(p.ids) for p in left)
        left.reverse()
        while total:
            want = 1 << (total.bit_length() - 1)
            total -= want
            sequence = []
            while want:
                piece = left.pop()
                if len(piece.ids) > want:
                    piece, tail = piece.cut(want)
                    left.append(tail)
                sequence.append(piece)
                want -= len(piece.ids)
            yield sequence


def sequences(documents: Iterable[tuple[int | None, str]], encode: Callable[[str], list[int]], capacity: int, separator: int, pool_tokens: int = POOL_TOKENS) -> Iterator[list[Piece]]:
    """Sequences of pieces over all documents."""
    pool = Pool(capacity)
    for doc, text in documents:
        ids = np.array([*encode(text), separator], "<u4")
        whole = len(ids) - len(ids) % capacity
        for at in range(0, whole, capacity):
            yield [Piece(doc, at, ids[at : at + capacity], len(ids))]
        if whole < len(ids):
            pool.add(Piece(doc, whole, ids[whole:].copy(), len(ids)))
        if pool.tokens >= pool_tokens:
            yield from pool.full()
    yield from pool.full()
    yield from pool.rest()


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken", separator: int = 0, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    import pyarrow as pa
    from pyspark import TaskContext

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def documents(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield from zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)

    def run(batches):
        rows: list[tuple] = []
        number = TaskContext.get().partitionId() << 33
        for sequence in sequences(documents(batches), encoder(vocabulary), capacity, separator, pool_tokens):
            offset = 0
            for p in sequence:
                rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, number, offset))
                offset += len(p.ids)
            number += 1
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return common.texts(docs).mapInArrow(lambda batches: common.released(run(batches)), SCHEMA)

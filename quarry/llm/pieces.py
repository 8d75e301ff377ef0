"""SentencePiece encoding with source offsets, and decoding.

Encoding keeps the source position of everything. ``CharacterMap`` normalises a text by
the model's compiled character map: at each place the longest key of its double-array
trie is replaced, other characters stay. Each normalised byte remembers the source byte
that it comes from, so that the bounds of a piece in the normalised text give its bytes
in the source. What the model adds (a leading mark) has no source bytes; of the byte
pieces of an unknown character all but the last are empty spans at its start, and the
last one covers it, as the library has it.

The normalised text is cut where no piece of the vocabulary holds the two neighbours
(before a mark that follows another character, and around white space that is in no
longer piece), because no merge can cross such a place; distinct cuts are segmented once
by the library, with a model whose normalisation is off. A vocabulary that holds such
neighbours leaves texts whole. Cuts stay known to a worker up to ``KNOWN`` characters.

Everything happens within a row; nothing is shuffled. Output batches close at
``BATCH_TOKENS`` tokens, whatever the lengths of texts.

Defined cases: null or empty text gives the end id alone, with an empty span; malformed
bytes are read as U+FFFD each, as the library does; repeated rows are encoded each; a
null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm import common

MARK = "▁"
KNOWN = 8_000_000
BATCH_TOKENS = 1_000_000
#: Texts are segmented together up to this many source bytes.
LEARNT_BYTES = 1_000_000
SCHEMA = "doc_id bigint, ids array<int>, begins array<int>, ends array<int>, decoded string"
#: Piece types of the model format (fixed values).
CONTROL, USER_DEFINED, BYTE = 3, 4, 6


class CharacterMap:
    """Longest-prefix replacement by a compiled map: the size of a double-array trie, the trie, and its strings."""

    def __init__(self, blob: bytes = b"", symbols: tuple[bytes, ...] = ()):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]
        self.symbols = re.compile(b"|".join(re.escape(s) for s in sorted(symbols, key=len, reverse=True))) if symbols else None
        quiet = [c for c in range(128) if self._quiet(c)] if self.units and not symbols else []
        one = b"[" + b"".join(re.escape(bytes([c])) for c in quiet) + b"]"
        #: Bytes that are no key, before another such byte: no key begins there.
        self.run = re.compile(one + b"+(?=" + one + b")") if quiet else None

    @property
    def identity(self) -> bool:
        return not self.units and self.symbols is None

    def _step(self, node: int, byte: int) -> tuple[int, int] | None:
        """(next node, value or -1) after a byte, if some key goes on with it."""
        at = node ^ byte
        if at >= len(self.units) or (unit := self.units[at]) & 0x800000FF != byte:
            return None
        following = at ^ self._offset(unit)
        return following, self.units[following] & 0x7FFFFFFF if unit >> 8 & 1 else -1

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def _quiet(self, byte: int) -> bool:
        step = self._step(self._offset(self.units[0]), byte)
        return step is None or step[1] < 0 and not any(self._step(step[0], c) for c in range(128))

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """(length of the longest key at a place, its replacement)."""
        if self.symbols is not None and (m := self.symbols.match(source, at)):
            return m.end() - at, m.group()
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for k in range(at, len(source)):
            step = self._step(node, source[k])
            if step is None:
                break
            node = step[0]
            if step[1] >= 0:
                found = k + 1 - at, step[1]
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]

    def replaced(self, source: bytes) -> Iterator[tuple[bytes, int, bool]]:
        """(normalised bytes, source start, whether they are copies byte for byte) from left to right."""
        at = 0
        while at < len(source):
            if self.run is not None and (m := self.run.match(source, at)):
                yield m.group(), at, True
                at = m.end()
                continue
            if key := self.longest(source, at):
                yield key[1], at, False
                at += key[0]
                continue
            length = character_length(source, at)
            yield (source[at : at + length], at, False) if length else ("�".encode(), at, False)
            at += length or 1


def character_length(source: bytes, at: int) -> int:
    """Bytes of the well-formed character at a place; 0 if there is none."""
    first = source[at]
    length = 1 if first < 0x80 else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
    try:
        source[at : at + length].decode()
    except UnicodeDecodeError:
        return 0
    return length if at + length <= len(source) else 0


class Cuts(dict):
    """Numbers of cuts in the order of their first appearance; ``new`` holds those that are not segmented yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, cut: str) -> int:
        self.new.append(cut)
        number = self[cut] = len(self)
        return number


class Pieces:
    """A model: normalisation with alignment, segmentation of cuts, decoding."""

    def __init__(self, model: str):
        import public_tokenizers
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(model if "/" in model else public_tokenizers.path(model), "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        self.spec, self.suffix = type(proto.normalizer_spec)(), proto.trainer_spec.treat_whitespace_as_suffix
        self.spec.CopyFrom(proto.normalizer_spec)
        texts = [p.piece for p in proto.pieces]
        self.map = CharacterMap(self.spec.precompiled_charsmap, tuple(p.piece.encode() for p in proto.pieces if p.type == USER_DEFINED))
        self.is_byte = np.array([p.type == BYTE for p in proto.pieces])
        self.width = np.array([len(t.encode()) for t in texts], np.int32)
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.end = self.decoder.eos_id()
        proto.normalizer_spec.Clear()
        proto.normalizer_spec.name, proto.normalizer_spec.add_dummy_prefix = "identity", False
        proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = False, False
        proto.denormalizer_spec.Clear()
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        lone = "".join(c for c in "\n\t\r" if not any(c in t and t != c for t in texts))
        crossed = any(MARK in t.lstrip(MARK) for t in texts) or not self.spec.escape_whitespaces
        #: Marks and what follows them, or a white space character of its own.
        self.cut = None if crossed else re.compile(f"[{lone}]|{MARK}*[^{MARK}{lone}]+|{MARK}+" if lone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.forget()

    def forget(self) -> None:
        self.known = Cuts()
        self.size, self.ids, self.widths, self.starts = 0, np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def normalise(self, source: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its bytes and of its end."""
        mark = MARK.encode() if self.spec.escape_whitespaces else b" "
        if self.map.identity and not self.spec.remove_extra_whitespaces:
            try:
                text = source.decode()
            except UnicodeDecodeError:
                pass
            else:
                if not source:
                    return "", np.zeros(1, np.int32)
                repeats = np.ones(len(source), np.int32)
                repeats[np.frombuffer(source, np.uint8) == 32] = len(mark)
                back = np.repeat(np.arange(len(source), dtype=np.int32), repeats)
                before = len(mark) if self.spec.add_dummy_prefix and not self.suffix else 0
                after = len(mark) if self.spec.add_dummy_prefix and self.suffix else 0
                back = np.concatenate([np.zeros(before, np.int32), back, np.full(after + 1, len(source), np.int32)])
                text = text.replace(" ", MARK) if self.spec.escape_whitespaces else text
                return MARK * bool(before) + text + MARK * bool(after), back
        return self._normalise_slowly(source, mark)

    def _normalise_slowly(self, source: bytes, mark: bytes) -> tuple[str, np.ndarray]:
        squeeze = self.spec.remove_extra_whitespaces
        parts, backs, spaced, begun, end = [], [], squeeze, False, 0
        for piece, at, copied in self.map.replaced(source):
            if squeeze:
                if spaced and not copied:
                    piece = piece.lstrip(b" ")
                elif copied:  # runs of copies: one space of several, none after a space
                    places = [k for k, c in enumerate(piece) if c != 32 or not (spaced if k == 0 else piece[k - 1] == 32)]
                    kept = bytes(piece[k] for k in places)
                    spaced = piece[-1:] == b" "
                    if kept and not begun:
                        begun = self._begin(parts, backs, at + places[0], mark)
                    self._push(parts, backs, kept, [at + k for k in places], mark)
                    continue
            if piece:
                if not begun:
                    begun = self._begin(parts, backs, at, mark)
                self._push(parts, backs, piece, range(at, at + len(piece)) if copied else [at] * len(piece), mark)
                spaced = squeeze and piece[-1:] == b" "
        end = len(source)
        if squeeze:
            text = b"".join(parts)
            while text.endswith(mark):
                text = text[: -len(mark)]
                end = backs[len(text)]
                del backs[len(text) :]
            parts = [text]
        if begun and self.spec.add_dummy_prefix and self.suffix:
            parts.append(mark)
            backs.extend([end] * len(mark))
        return b"".join(parts).decode(), np.array([*backs, end], np.int32)

    def _begin(self, parts: list[bytes], backs: list[int], at: int, mark: bytes) -> bool:
        if self.spec.add_dummy_prefix and not self.suffix:
            parts.append(mark)
            backs.extend([at] * len(mark))
        return True

    @staticmethod
    def _push(parts: list[bytes], backs: list[int], piece: bytes, places, mark: bytes) -> None:
        parts.append(piece.replace(b" ", mark))
        for c, at in zip(piece, places, strict=True):
            backs.extend([at] * (len(mark) if c == 32 else 1))

    def _learn(self) -> None:
        """Segment the new cuts: their ids, and the normalised bytes of each piece."""
        cuts, self.known.new = self.known.new, []
        found = self.segmenter.encode(cuts, num_threads=1)
        ids = np.fromiter((i for one in found for i in one), np.int32)
        widths = self.width[ids]
        if (odd := self.is_byte[ids]).any():  # the bytes of a character: nothing, and at the last one all
            value = self._byte_values()[ids]
            continues = odd & (value >= 0x80) & (value < 0xC0)
            last = odd & ~np.append(continues[1:], False)
            first = np.flatnonzero(odd & ~continues)
            widths[odd] = 0
            widths[last] = np.flatnonzero(last) - first + 1
        self.size += sum(map(len, cuts))
        self.ids, self.widths = np.concatenate([self.ids, ids]), np.concatenate([self.widths, widths])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(one) for one in found])])

    @lru_cache(1)  # noqa: B019
    def _byte_values(self) -> np.ndarray:
        """Byte value of each byte piece (<0xNN>)."""
        return np.array([int(self.decoder.id_to_piece(i)[3:5], 16) if odd else 0 for i, odd in enumerate(self.is_byte.tolist())])

    def encode(self, sources: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids with the end id, begins, ends) of each text; spans are source bytes."""
        held, size = [], 0
        for source in sources:
            held.append(self.normalise(source))
            size += len(source)
            if size >= LEARNT_BYTES:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, normalised: list[tuple[str, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.size > KNOWN:
            self.forget()
        numbers = []
        for text, _ in normalised:
            cuts = self.cut.findall(text) if self.cut is not None else [text] if text else []
            numbers.append(np.fromiter(map(self.known.__getitem__, cuts), np.int64, len(cuts)))
        if self.known.new:
            self._learn()
        for rows, (_, back) in zip(numbers, normalised, strict=True):
            counts = self.starts[rows + 1] - self.starts[rows]
            # places of all pieces in the table of cuts
            at = np.arange(counts.sum()) + np.repeat(self.starts[rows] - (np.cumsum(counts) - counts), counts)
            bounds = back[np.concatenate([[0], np.cumsum(self.widths[at])])]
            bounds = np.append(bounds, back[-1])
            yield np.append(self.ids[at], np.int32(self.end)), bounds[:-1], bounds[1:]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.decoder.decode(ids, num_threads=1)


@lru_cache(2)
def load(model: str) -> Pieces:
    return Pieces(model)


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, ids, begins, ends, decoded) of every row: piece ids and the end id, the source bytes [begin, end) of each, and the text that the ids decode to."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def batch_of(doc_ids, rows, pieces):
        offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, np.concatenate([r[k] for r in rows]).astype(np.int32)) for k in range(3)]
        decoded = pieces.decode([r[0].tolist() for r in rows])
        columns = [pa.array(doc_ids, pa.int64()), *[a.cast(schema.field(k + 1).type) for k, a in enumerate(lists)], pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        pieces = load(model)
        for batch in batches:
            ids, rows, size = [], [], 0
            texts = (v.as_py() for v in batch.column("text"))
            for doc_id, row in zip(batch.column("doc_id").to_pylist(), pieces.encode(texts), strict=True):
                ids.append(doc_id)
                rows.append(row)
                size += len(row[0])
                if size >= BATCH_TOKENS:
                    yield batch_of(ids, rows, pieces)
                    ids, rows, size = [], [], 0
            if rows:
                yield batch_of(ids, rows, pieces)

    rows = common.texts(docs)
    return rows.select("doc_id", rows["text"].cast("binary").alias("text")).mapInArrow(lambda batches: common.released(run(batches)), SCHEMA)

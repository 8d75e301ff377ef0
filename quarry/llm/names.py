"""64-bit names of words, the same in every process."""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
from xxhash import xxh3_64_intdigest

#: Words a worker remembers (about 200 bytes each); names of forgotten ones are made again.
REMEMBERED = 200_000


class Names(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        name = self[word] = xxh3_64_intdigest(word)
        return name


NAMES = Names()


def names_of(words: Collection[str]) -> np.ndarray:
    return np.fromiter(map(NAMES.__getitem__, words), np.uint64, len(words))

"""Search terms: Unicode words without diacritics, in lower case, with the Porter stem.

The stemmer follows the published algorithm (Porter, 1980). It is Python, but it
only ever sees distinct terms.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

VOWELS = "aeiou"
#: Suffix rules of steps 2 to 4 (fixed values of the algorithm).
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]


def _consonant(word: str, k: int) -> bool:
    """A y is a vowel after a consonant, so the letters of a run of them take turns."""
    first = k
    while first > 0 and word[k] == "y" == word[first - 1]:
        first -= 1
    if word[k] != "y":
        return word[k] not in VOWELS
    leads = first == 0 or word[first - 1] in VOWELS
    return leads == ((k - first) % 2 == 0)


def _shape(word: str) -> str:
    """Consonants as c, vowels as v, runs collapsed."""
    out, consonant = "", False
    for c in word:
        consonant = c not in VOWELS and not (c == "y" and consonant)
        if not out.endswith("c" if consonant else "v"):
            out += "c" if consonant else "v"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short(word: str) -> bool:
    return len(word) >= 3 and _consonant(word, len(word) - 3) and not _consonant(word, len(word) - 2) and _consonant(word, len(word) - 1) and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


@lru_cache(100_000)
def porter(word: str) -> str:
    """Stem of a lower-case word; words with other than a-z, and of fewer than three letters, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        for suffix, new in rules:
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def folded(text: str) -> str:
    """Lower case, base letters only."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def term(word: str, stemmed: bool = True) -> str:
    plain = folded(word)
    return porter(plain) if stemmed else plain


@lru_cache(200_000)
def known_term(word: str) -> str:
    """The stemmed term of a word, kept by the worker."""
    return term(word)


@pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    """Terms of distinct raw words."""
    return words.map(lambda w: None if w is None else term(w))


#: Declared nondeterministic, so that no filter on a term moves it below the aggregation to distinct words.
stems = stems.asNondeterministic()


#: The characters of words: letters, digits and their marks.
WORD = r"\p{L}\p{N}\p{M}"


def raw_tokens(text: Column) -> Column:
    """Words of letters, digits and their marks, in lower case, in text order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{WORD}]+"), F.lit(0))


def arrow_tokens(texts):
    """The words of an Arrow array of lower-case texts, as an array of lists."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spaced = pc.utf8_trim(pc.replace_substring_regex(texts, f"[^{WORD}]+", " "), " ")
    return pc.split_pattern(pc.if_else(pc.equal(spaced, ""), pa.scalar(None, spaced.type), spaced), " ").fill_null([])


def count_tokens(texts):
    """The number of words of each text of an Arrow array."""
    import pyarrow.compute as pc

    return pc.count_substring_regex(texts, f"[{WORD}]+").to_numpy(zero_copy_only=False)

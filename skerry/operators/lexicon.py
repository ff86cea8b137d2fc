"""What the words of a corpus are like, to tell what is read from pictures from noise.

Words are counted by the documents that use them.  Those of at least ``least`` documents
make a word list; of more than ``most``, those of the most documents.  Other words are
known by their parts: every three letters that follow one another in them, the word's
ends included, must be in a share of the documents, so that forms and words which few
documents use count, and letters struck at random do not.  Both travel to tasks as sorted
arrays of 64-bit hashes, of ``most`` entries each at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, LEAST = 200_000, 3
#: The share of documents that must have three letters in a row.
PART_SHARE = 0.002
#: A word: letters of any script, and marks on them.
WORD = r"[\p{L}\p{M}]{3,}"


def _hashes(words: Iterable[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") for w in words], np.uint64)


def parts_of(word: str) -> list[str]:
    """A word's three letters in a row, a blank at its ends."""
    whole = f" {word} "
    return [whole[i : i + 3] for i in range(len(whole) - 2)]


class Lexicon:
    """Tells what is a word: ``lexicon(word)``.  It pickles."""

    def __init__(self, words: Iterable[str], parts: Iterable[str] = ()) -> None:
        self.words, self.parts = np.unique(_hashes(w.lower() for w in words)), np.unique(_hashes(p.lower() for p in parts))

    @staticmethod
    def _all(known: np.ndarray, hashes: np.ndarray) -> bool:
        at = np.searchsorted(known, hashes)
        return bool((at < len(known)).all() and (known[at] == hashes).all())

    def __call__(self, word: str) -> bool:
        word = word.lower()
        return self._all(self.words, _hashes([word])) or self._all(self.parts, _hashes(parts_of(word)))


def _words(units: DataFrame, document: str, text: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(WORD), 0))
    return units.select(F.col(f"`{document}`").alias("document"), F.explode(found).alias("word")).distinct()


def word_counts(units: DataFrame, document: str = "file_id", text: str = "text") -> DataFrame:
    """(word, n): the documents that use a word, in lower case.  Both counts combine
    before they are shuffled."""
    return _words(units, document, text).groupBy("word").agg(F.count("*").alias("n"))


def part_counts(units: DataFrame, document: str = "file_id", text: str = "text") -> DataFrame:
    """(part, n): the documents whose words have three letters in a row."""
    whole = F.concat(F.lit(" "), "word", F.lit(" "))
    parts = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr(whole, i, F.lit(3)))
    seen = _words(units, document, text).select("document", F.explode(parts).alias("part")).distinct()
    return seen.groupBy("part").agg(F.count("*").alias("n"))


def learn(units: DataFrame, document: str = "file_id", text: str = "text", least: int = LEAST, most: int = MOST, share: float = PART_SHARE) -> Lexicon:
    """What units tell; ties for the last places go by the word."""
    documents = units.select(F.col(f"`{document}`")).distinct().count()

    def first(counts: DataFrame, name: str, fewest: float) -> list[str]:
        return [r[0] for r in counts.where(F.col("n") >= fewest).orderBy(F.col("n").desc(), name).limit(most).select(name).collect()]

    return Lexicon(first(word_counts(units, document, text), "word", least), first(part_counts(units, document, text), "part", max(least, share * documents)))

"""An index of a table's words by their letter pairs, for terms of several words.

A token counts for a word of such a term if it contains the word, or if their ratio is
at least ``matchers.TOKEN_RATIO``.  Both leave letter pairs in common, by which tokens are
found without looking at the others:

* ratio r of lengths a and b needs a common subsequence of l >= r (a + b) / 200 letters.
  A letter that is missing breaks two of a string's pairs at most, one that is put in
  breaks one: at least (a - 1) - 2 (a - l) - (b - l) pairs of the first are left, and as
  many of the second the other way round, counted as often as they occur;
* a token that contains the word has all of its pairs.

What is found so is scored, and what the ratio then refuses falls out: the scores are
those of all tokens.  A word for which the bound leaves no pair, one of two letters, is
compared with the whole vocabulary.

Three tables in a folder that all executors share: ``pairs`` (pair, n, token, length),
sorted by pair in ranges, so that a word reads the parts that hold its pairs;
``vocabulary`` (token, length), for the words without a bound; ``places`` (token, keys),
sorted by token.  Building shuffles each distinct token of a row once; a token is in
``pairs`` as often as it has distinct pairs, whatever number of rows has it.

A null text has no tokens; rows of one key are one; an empty table gives an empty index.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, tokens
from . import matchers
from .layout import spread


#: Characters of a token, at least, as ``functions.text.tokens`` has it.
SHORTEST = 3


def pairs_of(word: str) -> Counter:
    return Counter(word[i : i + 2] for i in range(len(word) - 1))


def least_shared(a: int, b: int, ratio: float = matchers.TOKEN_RATIO) -> int | None:
    """The letter pairs that strings of two lengths have in common at least, counted as
    often as they occur, if their ratio is ``ratio`` or more; None if it cannot be."""
    common = math.ceil(ratio * (a + b) / 200 - 1e-9)
    if common > min(a, b):
        return None
    return max((a - 1) - 2 * (a - common) - (b - common), (b - 1) - 2 * (b - common) - (a - common))


def lengths_like(a: int, ratio: float = matchers.TOKEN_RATIO) -> range:
    """Lengths that a string whose ratio with one of length ``a`` is enough may have."""
    share = ratio / (200 - ratio)
    return range(max(1, math.ceil(a * share - 1e-9)), math.floor(a / share + 1e-9) + 1)


class TokenIndex:
    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str]) -> None:
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), list(keys)

    @classmethod
    def build(cls, rows: DataFrame, keys: Sequence[str], text: str, folder: str) -> TokenIndex:
        """Index the words of ``text``; rows are told apart by ``keys``."""
        own = cls(rows.sparkSession, folder, keys)
        named = [F.col(f"`{k}`") for k in keys]
        seen = spread(rows).select(*named, F.explode(F.array_distinct(tokens(normalize(F.col(f"`{text}`"))))).alias("_token"))
        seen.distinct().repartitionByRange("_token").sortWithinPartitions("_token").write.parquet(f"{own.folder}/places")
        vocabulary = own._read("places").select(F.col("_token").alias("token")).distinct().withColumn("length", F.length("token"))
        vocabulary.write.parquet(f"{own.folder}/vocabulary")
        each = F.transform(F.sequence(F.lit(1), F.col("length") - 1), lambda i: F.substr("token", i, F.lit(2)))
        counted = own._read("vocabulary").where("length > 1").select("token", "length", each.alias("all"))
        counted = counted.select("token", "length", "all", F.explode(F.array_distinct("all")).alias("pair"))
        n = F.size(F.filter("all", lambda p: p == F.col("pair")))
        counted.select("pair", n.alias("n"), "token", "length").repartitionByRange("pair", "token").sortWithinPartitions("pair", "length").write.parquet(f"{own.folder}/pairs")
        return own

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def candidates(self, word: str, ratio: float = matchers.TOKEN_RATIO) -> DataFrame:
        """(token): all that contain ``word`` or have enough of a ratio with it, and few others."""
        pairs, size = pairs_of(word), len(word)
        bounds = {b: n for b in lengths_like(size, ratio) if b >= SHORTEST and (n := least_shared(size, b, ratio)) is not None}
        if not pairs or min(bounds.values(), default=1) < 1:
            return self._read("vocabulary").select("token")
        times = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
        found = self._read("pairs").where(F.col("pair").isin(*pairs) & (F.col("length") >= min([*bounds, size])))
        shared = found.groupBy("token", "length").agg(F.sum(F.least("n", F.element_at(times, F.col("pair")))).alias("shared"))
        contains = F.lit(size - 1)
        enough = F.lit(False) if not bounds else F.col("shared") >= F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in bounds.items() for x in kv)), F.col("length")), contains)
        return shared.where(enough | (F.col("shared") >= contains)).select("token")

    def token_scores(self, word: str, weights: dict | None = None) -> DataFrame:
        """(token, score) of the tokens that count for a word among others."""
        scored = spread(self.candidates(word)).withColumn("score", matchers.best_token(word, F.array("token"), weights, among_words=True))
        return scored.where("score > 0")

    def scores(self, words: Sequence[str], weights: dict | None = None) -> DataFrame:
        """(keys, score): of each row the least over the words of its best token for each;
        rows without a token for one of them are left out."""
        words = list(dict.fromkeys(words))
        if not words:
            return self._read("places").select(*self._keys()).withColumn("score", F.lit(0.0)).limit(0)
        found = reduce(DataFrame.unionByName, (self.token_scores(w, weights).withColumn("word", F.lit(i)) for i, w in enumerate(words)))
        places = self._read("places").join(found.withColumnRenamed("token", "_token"), "_token")
        best = places.groupBy(*self._keys(), "word").agg(F.max("score").alias("score"))
        return best.groupBy(*self._keys()).agg(F.min("score").alias("score"), F.count("*").alias("_words")).where(F.col("_words") == len(words)).drop("_words")

    def _keys(self) -> list[Column]:
        return [F.col(f"`{k}`") for k in self.keys]

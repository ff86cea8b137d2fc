"""Language ID: error-correcting output codes over byte n-grams.

Method: every language gets a codeword; a binary n-gram classifier is trained for
each of its bits, and a document is given the language whose codeword has the
smallest loss, each bit weighted by how well its classifier separates the
training languages.  Documents whose two best codewords are close are flagged.

Classifiers are linear in hashed byte trigrams with naive-Bayes weights, so that
training is one aggregate of trigram counts by language over all labelled rows;
what reaches the driver is ``languages x BUCKETS`` counts whatever the input.

Defined cases: ``und`` with score 0 if a text is null or has no letter, or if
there was nothing to learn from; with one language learned every other text gets
it; a null language is not learned from; repeated rows are returned each; of languages
that score alike the one first by name counts; texts of any length are read whole.
Other columns, of any name and type, stay as they are, but for those that have the name
of an added one, in any case, which are replaced.  An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import arrow_map, read_table, slices, with_columns

BUCKETS = 1 << 14
SMOOTHING = 0.5
#: Margins are means over trigrams; this scales them for the exponential loss.
SCALE = 6.0
#: Flagged as ambiguous when the best language's share is below this.
AMBIGUOUS = 0.5
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")

#: ASCII letters in lower case, other bytes of UTF-8 as they are, the rest blank.
_FOLD = np.full(256, 32, np.uint8)
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    bit_weights: np.ndarray  # bits


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram that has a letter in its middle, and its text's index."""
    data = np.frombuffer(b"".join(b"  " + t for t in texts) + b"  ", np.uint8)
    lengths = np.array([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    x = _FOLD[data].astype(np.uint32)
    mid = np.flatnonzero(x[1:-1] != 32) + 1
    code = (x[mid - 1] * np.uint32(0x9E3779B1) ^ x[mid] * np.uint32(0x85EBCA6B) ^ x[mid + 1] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    return code >> np.uint32(32 - 14), owner[mid]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for b in slices(batches, "text"):
        langs = b.column("lang").to_pylist()
        names = sorted(set(langs))
        at = np.array([names.index(x) for x in langs])
        codes, owner = trigrams([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()])
        both = np.bincount(at[owner] * BUCKETS + codes, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
        for name, row in zip(names, both, strict=True):
            totals[name] = totals.get(name, 0) + row
    for name, row in totals.items():
        some = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(row[some].astype(np.int64))], ["lang", "bucket", "n"])


def codewords(n: int) -> np.ndarray:
    """n x bits of -1 and 1: the exhaustive code for up to 6 languages, beyond
    that pseudo-random dense codes of 12 log2(n) bits, repeats and constants left out."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = [b for b in product((-1, 1), repeat=n) if b[0] == 1 and -1 in b]
    else:
        rng, bits, want = np.random.default_rng(7), [], int(12 * np.log2(n))
        while len(bits) < want:
            b = tuple(rng.choice((-1, 1), n).tolist())
            if len(set(b)) == 2 and b not in bits:
                bits.append(b)
    return np.array(bits, np.int8).T


def fit(docs: DataFrame) -> Model | None:
    """Learn from the text and lang of all rows whose lang is not null."""
    counted = arrow_map(docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang"), _count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[rows["lang"].map(languages.index).to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return train(languages, counts)


def train(languages: list[str], counts: np.ndarray) -> Model:
    share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)  # languages count alike
    codes = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, codes, np.zeros((BUCKETS, 1), np.float32), np.ones(1))
    weights = np.stack([np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)) for c in codes.T], axis=1)
    margins = (share @ weights) * codes  # of a typical text of each language
    bit_weights = np.clip(margins.min(axis=0), 0.02, None)
    return Model(languages, codes, weights.astype(np.float32), bit_weights / bit_weights.sum())


def decode(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language of each text, and its share of all."""
    codes, owner = trigrams(texts)
    n = np.bincount(owner, minlength=len(texts))
    sums = np.stack([np.bincount(owner, model.weights[codes, b], minlength=len(texts)) for b in range(model.weights.shape[1])], axis=1)
    z = SCALE * sums / np.maximum(n, 1)[:, None]
    loss = np.stack([(np.exp(-np.clip(z * c, -20, 20)) * model.bit_weights).sum(axis=1) for c in model.codes], axis=1)
    score = 1 / np.maximum(loss, 1e-12)
    return loss.argmin(axis=1), score.max(axis=1) / score.sum(axis=1)


NAMES = ("lang_pred", "lang_score", "lang_ambiguous")


def predict(docs: DataFrame, model: Model | None, names: Sequence[str] = NAMES) -> DataFrame:
    """``docs`` with the predicted language, its score and whether it is ambiguous, in
    columns of the given names, which replace those of the same name in any case."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(text: pa.Array) -> list[pa.Array]:
        m, texts = shared.value, text.to_pylist()
        seen = np.array([bool(t and _LETTER.search(t)) for t in texts])
        if m is None:
            best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            seen[:] = False
        else:
            best, score = decode(m, [(t or "").encode() for t in texts])
        name = [m.languages[i] if ok else UNKNOWN for i, ok in zip(best, seen, strict=True)]
        score = np.where(seen, score, 0.0)
        return [pa.array(name, pa.string()), pa.array(score), pa.array((score < AMBIGUOUS).tolist(), pa.bool_())]

    added = StructType([StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), BooleanType()), strict=True)])
    return with_columns(docs, added, ["text"], make)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))

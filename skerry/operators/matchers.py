"""Matchers: (query, normalised value) to a score Column in [0, 1].

exact, contains and partial are native expressions; fuzzy and phonetic run as
Arrow-batched functions that score each distinct value of a batch once; semantic
is the cosine of embedding columns, or of vectors from the encoder in use."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.query import DEFAULT_WEIGHTS, MatchType

NATIVE = (MatchType.EXACT, MatchType.CONTAINS, MatchType.PARTIAL)
# What lets a token count for a word.
TOKEN_RATIO, TOKEN_COSINE, SHORT_WORD = 80.0, 0.5, 3

#: Texts to an array of one vector each.
Encoder = Callable[[list[str]], np.ndarray]
_encoder: Encoder | None = None


def use_encoder(encode: Encoder | None) -> None:
    """Make semantic matching available, or with None not.  ``encode`` must pickle;
    it runs in the workers, on distinct values of a batch."""
    global _encoder
    _encoder = encode


def has_encoder() -> bool:
    return _encoder is not None


def _cosines(encode: Encoder, query: str, values: list[str]) -> dict[str, float]:
    if not values:
        return {}
    vectors = np.asarray(encode([query, *values]), dtype="float64")
    norms = np.linalg.norm(vectors, axis=1)
    scale = norms[0] * norms[1:]
    found = np.divide(vectors[1:] @ vectors[0], scale, out=np.zeros(len(values)), where=scale > 0)
    return dict(zip(values, np.clip(found, 0.0, 1.0).tolist(), strict=True))


def _semantic(query: str, value: Column) -> Column:
    encode = _encoder

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        known = _cosines(encode, query, [v for v in values.unique() if v])
        return values.map(lambda v: known.get(v, 0.0)).astype("float64")

    return score(value)


def _kernel(many: Callable[[str, list[str]], np.ndarray], query: str, value: Column) -> Column:
    """``many`` of the query and a column, each distinct value of a batch once."""

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        at, distinct = pd.factorize(values, use_na_sentinel=False)
        return pd.Series(many(query, distinct.tolist())[at], dtype="float64")

    return score(value)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, cut to [0, 1]; 0 if either has no length."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), product(a, b) / norm))).otherwise(0.0)


def active_weights(weights: dict | None) -> dict[MatchType, float]:
    chosen = {MatchType(k): float(w) for k, w in (weights or DEFAULT_WEIGHTS).items()}
    return {k: w for k, w in chosen.items() if w > 0 and k != MatchType.COMPOSITE and (has_encoder() or k != MatchType.SEMANTIC)}


def has_python(weights: dict | None) -> bool:
    """Whether a composite score needs Python workers."""
    return any(k not in NATIVE for k in active_weights(weights))


def atomic(kind: MatchType, query: str, value: Column) -> Column:
    if kind == MatchType.SEMANTIC and not has_encoder():
        raise RuntimeError("semantic matching needs an encoder: use_encoder(), or cosine() on embedding columns")
    if not query:
        return F.lit(0.0)
    if kind == MatchType.SEMANTIC:
        return _semantic(query, value)
    test = {MatchType.EXACT: value == query, MatchType.CONTAINS: value.contains(query), MatchType.PARTIAL: value.startswith(query) | value.endswith(query)}
    if kind in test:
        return F.when((value != "") & test[kind], 1.0).otherwise(0.0)
    return _kernel(kernels.fuzzy_many if kind == MatchType.FUZZY else kernels.phonetic_many, query, value)


def parts(kind: MatchType, query: str, value: Column, weights: dict | None = None) -> dict[MatchType, Column]:
    """The atomic scores that make up a match."""
    return {k: atomic(k, query, value) for k in active_weights(weights)} if kind == MatchType.COMPOSITE else {kind: atomic(kind, query, value)}


def combined(scores: dict[MatchType, Column], weights: dict | None) -> Column:
    w = active_weights(weights)
    if not w:
        return F.lit(0.0)
    total = F.lit(0.0)
    for k, x in w.items():
        total = total + x * scores[k]
    return total / sum(w.values())


def composite(query: str, value: Column, weights: dict | None, least: float | None = None) -> Column:
    """``score`` of a composite of all matchers but semantic, each distinct value of a batch
    once; values that cannot reach ``least`` may get 0, which spares most of them the dear
    matchers."""
    active = {k.value: w for k, w in active_weights(weights).items()}
    if not query or not active:
        return F.lit(0.0)
    return _kernel(lambda q, values: kernels.soft_composite(q, values, active, least), query, value)


def score(kind: MatchType, query: str, value: Column, weights: dict | None = None) -> Column:
    found = parts(kind, query, value, weights)
    return combined(found, weights) if kind == MatchType.COMPOSITE else found[kind]


def _token_scores(word: str, weights: dict[MatchType, float], among_words: bool, encode: Encoder | None) -> Callable[[Iterable[str]], dict[str, float]]:
    """A function from tokens to the scores of those that may count for ``word``.
    Among the words of a longer term a token must contain or resemble the word; a
    single word's token must not be like a short one by sound alone, and where
    meanings can be compared, must contain the word or be near in meaning."""
    plain = {
        MatchType.EXACT: lambda t: float(t == word), MatchType.CONTAINS: lambda t: float(word in t), MatchType.PARTIAL: lambda t: float(t.startswith(word) or t.endswith(word)),
        MatchType.FUZZY: lambda t: kernels.fuzzy(word, t), MatchType.PHONETIC: lambda t: kernels.phonetic(word, t),
    }

    def one(token: str, cosine_: float) -> float:
        found = {k: plain[k](token) for k in weights if k in NATIVE}
        inside = any(found.values())
        if among_words:
            if not inside and kernels.ratio(word, token) < TOKEN_RATIO:
                return 0.0
        elif word not in token and encode is not None and cosine_ < TOKEN_COSINE:
            return 0.0
        found |= {k: cosine_ if k == MatchType.SEMANTIC else plain[k](token) for k in weights if k not in NATIVE}
        if not among_words and not inside and len(word) <= SHORT_WORD and found.get(MatchType.PHONETIC, 0.0) > 0:
            return 0.0
        return sum(w * found[k] for k, w in weights.items()) / sum(weights.values())

    def scores(tokens: Iterable[str]) -> dict[str, float]:
        values = list(tokens)
        cosines = _cosines(encode, word, values) if MatchType.SEMANTIC in weights else {}
        return {t: one(t, cosines.get(t, 0.0)) for t in values}

    return scores


def best_token(word: str, tokens: Column, weights: dict | None, among_words: bool) -> Column:
    """The best score of ``word`` over an array of tokens, 0 if none may count.
    Native matchers stay in the JVM: a token that they give anything contains the
    word and so always counts.  Others score each distinct token of a batch once."""
    active = active_weights(weights)
    if not word or not active:
        return F.lit(0.0)
    if all(k in NATIVE for k in active):
        return F.coalesce(F.array_max(F.transform(tokens, lambda t: combined({k: atomic(k, word, t) for k in active}, active))), F.lit(0.0))
    scores = _token_scores(word, active, among_words, _encoder if MatchType.SEMANTIC in active else None)

    @F.pandas_udf("double")
    def best(rows: pd.Series) -> pd.Series:
        known = scores({t for row in rows if row is not None for t in row})
        return rows.map(lambda row: max((known[t] for t in row), default=0.0) if row is not None else 0.0).astype("float64")

    return best(tokens)

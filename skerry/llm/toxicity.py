"""Toxicity: restore disguised words, then score the restored text.

Method: noisy-channel deobfuscation.  A token that looks disguised (digits or
signs among letters, letters spaced out or repeated) becomes a lattice of the
letters that each sign may stand for; Viterbi decoding under a character trigram
model of the whole corpus picks the likeliest word.  The document's words,
restored ones included, and their beginnings are features of a logistic model.

Labels are learned from a bounded sample of labelled rows (``SAMPLE``, by the
smallest hashes of doc_id); the character model counts every document.  Neither
labels nor lang, source or doc_id are inputs of a score.

The model's letters are those of Latin-1; letters of other scripts count as one sign
to it, so that it restores no disguise among them, while their words are features as
they stand.

Defined cases: a null text is empty and gets the score of a text without features;
several labels of one document count as toxic if one is; rows without a label are
not learned from; without labels of both sorts every score is 0; repeated rows
are returned each; texts of any length are read whole, a disguised token in time in
proportion to its length.  Other columns, of any name and type, stay as they are, but
for one named like the score, in any case, which is replaced.  An empty table gives an
empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import arrow_map, read_table, slices, with_columns

SAMPLE = 12_000
#: A feature is considered if so many toxic rows of the sample have it.
LEAST = 6
FEATURES = 3_000
PREFIXES = (5, 6, 7)
THRESHOLD = 0.7

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))).replace("÷", "")
SIZE = len(LETTERS) + 1  # 0 is what is no letter
_INDEX = np.zeros(256, np.int64)
for _i, _c in enumerate(LETTERS):
    _INDEX[ord(_c)] = _i + 1

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "#": "h"}
BETWEEN = ".-_'`~,·"
EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_~`“”‘’«»…"
EDGE_BUT = EDGE.replace("$", "")
REMEMBER = 100  # letters of a token whose decoding is remembered
BOUNDARY = -2.0  # log-cost of a word's end within letters that are spaced out
STRIDE = 3  # letters of a run that are not yet a sign of disguise

_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]){3,}[^\W_](?=[.,;:!?\"')]*(?!\S))")
_SIGNS = re.compile(r"[0-9@$!|+€(#*.\-_'`~,·]")
_RUN = re.compile(r"(.)\1\1")


class CharacterModel:
    """Trigram log-probabilities, interpolated with bigrams."""

    def __init__(self, counts: np.ndarray) -> None:
        c3 = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        c2 = c3.sum(axis=0)
        c1 = c2.sum(axis=0) + 1
        p1 = c1 / c1.sum()
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3)


def trigram_counts(texts: list[str]) -> np.ndarray:
    data = np.frombuffer("\n\n".join(["", *texts, ""]).lower().encode("latin-1", "replace"), np.uint8)
    x = _INDEX[data]
    code = (x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:]
    return np.bincount(code[(x[1:-1] > 0) | (x[2:] > 0)], minlength=SIZE**3)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per place of a token the strings it may stand for, with log-costs."""
    out: list[list[tuple[str, float]]] = []
    for run in re.finditer(r"(.)\1*", token):
        c, n = run.group(1), len(run.group())
        if c in BETWEEN or c == " ":
            continue
        if c == "*":
            out += [[(x, -3.3) for x in LETTERS[:26]] + [("", -1.5)]] * n
            continue
        options = LEET.get(c, c if c.isalpha() else "")
        if not options:
            return []
        cost = 0.0 if c.isalpha() else -0.5
        if n >= STRIDE:  # a stretched letter: one, or two
            out.append([(o * k, cost - 0.2 * k) for o in options for k in (1, 2)])
        else:
            out += [[(o, cost) for o in options]] * n
    return out


def decode(token: str, model: CharacterModel, boundaries: bool = False) -> str:
    """The likeliest word for a disguised token, by Viterbi over the last two letters;
    with ``boundaries`` the likeliest words, with spaces between them."""
    steps = lattice(token)
    if not steps:
        return ""
    if boundaries:
        steps = [steps[0], *([*o, *((" " + x, c + BOUNDARY) for x, c in o if x)] for o in steps[1:])]
    index = {c: i + 1 for i, c in enumerate(LETTERS)}
    # a way is a chain of (way before, text), so that its length costs no copies
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in steps:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, way) in states.items():
            for text, cost in options:
                s, p, q = score + cost, a, b
                for ch in text:
                    i = index.get(ch, 0)
                    s += model.log[p, q, i]
                    p, q = q, i
                if (p, q) not in new or s > new[p, q][0]:
                    new[p, q] = (s, (way, text))
        states = new
    _, way = max(((s + model.log[a, b, 0], w) for (a, b), (s, w) in states.items()), key=lambda x: x[0])
    out = []
    while way:
        way, text = way
        out.append(text)
    return "".join(reversed(out))


def disguised(text: str, words: list[str]) -> set[str]:
    """Tokens of a lower-cased text that may hide a word."""
    out = set()
    for w in words:
        if not w.isalpha():
            signs = len(_SIGNS.findall(w))
            letters = sum(map(str.isalpha, w))
            if signs and letters and signs <= 2 * letters and w.count("*") <= max(2, letters):
                out.add(w)
    if _RUN.search(text):
        out.update(w for w in words if w.isalpha() and _RUN.search(w))
    out.update(_SPACED.findall(text))
    return out


def restored(token: str, model: CharacterModel) -> set[str]:
    """The word that a disguised token hides; of letters spaced out also the words
    that they make when it is told where one ends."""
    out = {decode(token, model)}
    if _SPACED.fullmatch(token):
        out.update(decode(token, model, True).split(" "))
    return out


class Restorer:
    """Words of a text, restored ones included; remembers what it decoded."""

    REMEMBERED = 200_000

    def __init__(self, model: CharacterModel) -> None:
        self.model, self.known = model, {}

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        tokens = {w.strip(EDGE) for w in low.split()}
        raw = {w.rstrip(EDGE) for w in low.split() if w[0] in "$|(#" and w[1:2].isalpha()}
        raw |= {w.strip(EDGE_BUT) for w in low.split() if "$" in w[-3:]}
        found = set(tokens)
        for token in disguised(low, [*tokens, *raw]):
            words = self.known.get(token)
            if words is None:
                words = restored(token, self.model)
                if len(self.known) >= self.REMEMBERED:
                    self.known.clear()
                if len(token) <= REMEMBER:
                    self.known[token] = words
            found |= words
        found.discard("")
        return found


def features(words: set[str]) -> set[str]:
    out = set(words)
    for n in PREFIXES:
        out.update({f"{w[:n]}~" for w in words if len(w) >= n})
    return out


@dataclass
class Model:
    characters: CharacterModel
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0


def fit_characters(docs: DataFrame) -> CharacterModel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for b in slices(batches, "text"):
            total += trigram_counts([t or "" for t in b.column("text").to_pylist()])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["code", "n"])

    rows = arrow_map(docs.select("text"), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # at most SIZE ** 3 rows
    counts = np.zeros(SIZE**3)
    counts[rows["code"].to_numpy(int)] = rows["n"].to_numpy()
    return CharacterModel(counts)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the given labels (doc_id, toxic) and the texts of ``docs``."""
    spark = docs.sparkSession
    model = Model(fit_characters(docs))
    taken = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    taken = taken.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("text", "toxic")  # at most `sample` rows are sent
    shared = spark.sparkContext.broadcast(model.characters)

    def counted(only: set[str] | None, toxic: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restore, n, total = Restorer(shared.value), Counter(), 0
            for b in batches:
                for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                    if label == toxic:
                        f = features(restore.words(text))
                        n.update(f if only is None else f & only)
                        total += 1
            n[""] = total
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["f", "n"])

        return arrow_map(rows, run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))

    with_it = {r["f"]: r["n"] for r in counted(None, 1).where((F.col("n") >= LEAST) | (F.col("f") == "")).collect()}
    without = {r["f"]: r["n"] for r in counted(set(with_it) - {""}, 0).collect()}
    n1, n0 = with_it.pop("", 0), without.pop("", 0)
    if not n1 or not n0:
        return model
    gain = {f: _likelihood_ratio(k, n1, without.get(f, 0), n0) for f, k in with_it.items()}
    chosen = [f for f in sorted(gain, key=lambda f: (-gain[f], f)) if gain[f] > 6][:FEATURES]
    at = {f: i for i, f in enumerate(chosen)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for b in batches:
            got = [sorted(at[f] for f in features(restore.words(t)) & at.keys()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(got, pa.list_(pa.int32()))], ["toxic", "at"])

    data = arrow_map(rows, present, "toxic int, at array<int>").toPandas()
    model.weights, model.bias = _logistic(chosen, data["at"].tolist(), data["toxic"].to_numpy(float))
    return model


def _likelihood_ratio(k1: int, n1: int, k0: int, n0: int) -> float:
    """Signed log-likelihood ratio of a feature; positive if it speaks for toxic."""
    def ll(k: float, n: float, p: float) -> float:
        return (k * np.log(p) if k else 0.0) + ((n - k) * np.log(1 - p) if n > k else 0.0)

    p = (k1 + k0) / (n1 + n0)
    g = ll(k1, n1, k1 / n1) + ll(k0, n0, k0 / n0) - ll(k1, n1, p) - ll(k0, n0, p)
    return g if k1 / n1 > k0 / n0 else -g


def _logistic(names: list[str], present: list, y: np.ndarray) -> tuple[dict[str, float], float]:
    """Ridge logistic regression by gradient steps with momentum; the bias is then
    moved so that the threshold of best F1 on these rows is a score of 0.7."""
    lengths = [len(p) for p in present]
    row = np.repeat(np.arange(len(present)), lengths)
    col = np.concatenate([np.asarray(p, int) for p in present]) if row.size else np.zeros(0, int)
    w, b = np.zeros(len(names)), float(np.log(y.mean() / (1 - y.mean())))
    vw, vb, n = np.zeros_like(w), 0.0, len(y)
    for _ in range(400):
        z = b + np.bincount(row, w[col], minlength=n)
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(col, e[row], minlength=len(w)) + 0.3 * w
        vw, vb = 0.9 * vw - 4.0 / n * gw * 5, 0.9 * vb - 1.0 / n * e.sum()
        w, b = w + vw, b + vb
    z = b + np.bincount(row, w[col], minlength=n)
    order = np.argsort(-z)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, n + 1) + y.sum())
    last = int(f1.argmax())
    cut = (z[order[last]] + z[order[min(last + 1, n - 1)]]) / 2
    return dict(zip(names, w.tolist(), strict=True)), b - cut + float(np.log(THRESHOLD / (1 - THRESHOLD)))


def _scorer(m: Model) -> Callable[[str | None], float]:
    restore, weights = Restorer(m.characters), m.weights
    words = {f for f in weights if f[-1] != "~"}
    starts = {n: {f[:-1] for f in weights if f[-1] == "~" and len(f) == n + 1} for n in PREFIXES}

    def score(text: str | None) -> float:
        got = restore.words(text)
        z = m.bias + sum(weights[f] for f in got & words)
        for n, known in starts.items():
            z += sum(weights[f + "~"] for f in {w[:n] for w in got} & known)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxicity, 0 to 1; a column of that name, in any case, is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    ready: list[Callable] = []  # one for each task

    def make(texts: pa.Array) -> list[pa.Array]:
        if not ready:
            ready.append(_scorer(shared.value))
        return [pa.array([ready[0](t) for t in texts.to_pylist()], pa.float64())]

    return with_columns(docs, StructType([StructField("toxicity", DoubleType())]), ["text"], make)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))

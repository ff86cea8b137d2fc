"""Snippets of texts around the place that a query matched, misspelt ones included."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import FileQ, query_words
from . import kernels

# Scores a likeness must reach to be marked, and the marks.
ALIGNMENT, WORD, MEANING = 60.0, 50.0, 0.5
MARKS = {"guillemets": ("«", "»"), "bold": ("[bold]", "[/bold]"), "html": ("<b>", "</b>"), "none": ("", "")}
MORE = "..."
_WORDS = re.compile(r"[\w']+")
_TAG = re.compile(r"(\[[^\]:]*\])(.*)", re.S)
Span = tuple[int, int]
#: Of a term and words their likeness in meaning.
Meaning = Callable[[str, list[str]], list[float]]


def split_label(text: str) -> tuple[str, str]:
    """A tag's [label] and its body, blanks collapsed; [a: b] is no label."""
    flat = " ".join(text.split())
    return (m[1], m[2].strip()) if (m := _TAG.fullmatch(flat)) else ("", flat)


def _same_words(body: str, words: list[str]) -> list[Span]:
    """The first place of each word; none if one is missing."""
    first: dict[str, Span] = {}
    for m in _WORDS.finditer(body):
        first.setdefault(m.group().lower(), m.span())
    return [first[w] for w in words] if words and all(w in first for w in words) else []


def _around(places: list[Span]) -> Span:
    return min(a for a, _ in places), max(b for _, b in places)


def find_span(body: str, term: str, meaning: Meaning | None = None) -> Span:
    """Where a term is: as written, else around all of its words, else the most alike
    stretch, else the most alike word, else the word nearest in meaning, else the
    first character.  A term of several words none of which is found is nowhere."""
    low, term = body.lower(), term.strip().lower()
    if not body:
        return 0, 0
    if not term:
        return 0, 1
    if (at := low.find(term)) >= 0:
        return at, at + len(term)
    words = query_words(term)
    if " " in term and len(words) > 1:
        places = _same_words(body, words)
        return _around(places) if places else best_span(body, words, meaning)
    score, a, b = kernels.partial_alignment(term, low)
    if score >= ALIGNMENT and a < b:
        return a, b
    found = [m.span() for m in _WORDS.finditer(low)]
    for like, least in ((lambda ws: [kernels.partial_ratio(term, w) for w in ws], WORD), (lambda ws: meaning(term, ws) if meaning else [], MEANING)):
        scores = like([low[x:y] for x, y in found])
        if scores and max(scores) >= least:
            return found[scores.index(max(scores))]
    return 0, 1


def best_span(body: str, terms: list[str], meaning: Meaning | None = None) -> Span:
    """Of several terms the place most like its own; the first on equal terms."""
    spans = [find_span(body, t, meaning) for t in terms]
    scores = [kernels.partial_ratio(t.lower(), body[a:b].lower()) if a < b else 0.0 for t, (a, b) in zip(terms, spans, strict=True)]
    return spans[scores.index(max(scores))] if spans else (0, 0)


def query_span(body: str, q: FileQ, term: str | None = None, meaning: Meaning | None = None) -> Span:
    """The place to mark for a query, or for the one term of it that matched."""
    if term:
        return find_span(body, term, meaning)
    terms = q.terms()
    if q.compound or len(query_words(q.value or "")) < 2:
        return best_span(body, terms, meaning) if len(terms) > 1 else find_span(body, terms[0] if terms else "", meaning)
    words = query_words(q.value)
    places = _same_words(body, words)
    return _around(places) if places else next((p[0] for p in (_same_words(body, [w]) for w in words) if p), (0, 0))


def _escape(text: str, marks: str) -> str:
    return html.escape(text) if marks == "html" else re.sub(r"\[(?=[a-zA-Z#/@])", r"\\[", text) if marks == "bold" else text


def _cut(text: str, length: int) -> str:
    return text if len(text) <= length else text[: length - len(MORE)] + MORE


def snippet(text: str | None, q: FileQ, term: str | None = None, length: int = 100, marks: str = "guillemets", meaning: Meaning | None = None) -> str | None:
    """The text with its blanks collapsed, cut to about ``length`` characters around
    the marked place, a leading [label] kept; null stays null."""
    if text is None:
        return None
    label, body = split_label(text)
    lead = f"{label} " if label else ""
    if not body:
        return label
    if marks == "none" or not (term or q.terms()):
        return _cut(lead + body, length)
    a, b = query_span(body, q, term, meaning)
    if a >= b:
        if sum(len(query_words(t)) for t in q.terms()) >= 2:
            return _cut(lead + body, length)
        b = min(len(body), a + 1)
    left, right = MARKS[marks]
    marked = left + _escape(body[a:b], marks) + right

    def shown(start: int, stop: int) -> str:
        return lead + (MORE if start else "") + _escape(body[start:a], marks) + marked + _escape(body[b:stop], marks) + (MORE if stop < len(body) else "")

    if marks == "guillemets" and len(body) + 2 <= length or len(shown(0, len(body))) <= length:
        return shown(0, len(body))
    if len(marked) >= length:
        return marked[: length - len(MORE)] + MORE
    room = length - len(marked)
    return shown(max(0, a - room // 2), min(len(body), b + room - room // 2))


def snippets(lines: Column, q: FileQ, length: int = 100, marks: str = "guillemets") -> Column:
    """``snippet`` of each of an array of (text, matched_term, location_kind) structs;
    a picture's line has no place to mark."""

    @F.pandas_udf("array<string>")
    def all_of(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: None if row is None else [snippet(x["text"], q, x["matched_term"], length, "none" if x["location_kind"] == "semantic_image" else marks) for x in row])

    return all_of(F.transform(lines, lambda x: F.struct(x["text"].alias("text"), x["matched_term"].alias("matched_term"), x["location_kind"].alias("location_kind"))))

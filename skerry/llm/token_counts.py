"""Token counts of whole texts under a sentencepiece BPE vocabulary.

Method, the whole-token shortcut: what the vocabulary alone proves is found once a
worker, by ``Counter._prove``.  No merge can make a piece that the vocabulary does not hold, so
that (a) two neighbouring characters which stand beside each other in no piece are
never joined, and a text may be cut between them; and (b) a character that no longer
piece holds is by itself whatever stands around it.  Texts are cut before the blanks
by (a) and at control characters by (b) into pre-tokens.  Vocabulary strings which the
library, asked for each of them, encodes alone as one token count one; only the rest
is merged, each distinct pre-token once while it is remembered.

Defined cases: a null text has the bytes and tokens of an empty one, none; texts of any
length are counted whole, a pre-token at a time; rows that repeat are counted each, in
the order they come; a null id stays null; an empty table gives an empty one.  Other
columns, of any name and type, stay as they are, and ``counted`` finds names for its
own that none of them has, in any case.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import fresh, read_table, with_columns

VOCABULARY = "piece_bpe_32k.model"
#: A document of more tokens is over the limit.
LIMIT = 4096
NAMES = ("n_bytes", "n_tokens", "over_limit")
#: What the library writes for a blank.
BLANK = "▁"
#: Characters of merged pre-tokens that a worker remembers; longer pre-tokens than these are not.
REMEMBERED, LONGEST = 8_000_000, 64


class Counter:
    """Token counts by one model.  ``spaced`` and ``bare`` hold the counts of pre-tokens
    with and without a blank before them; a pre-token of several blanks stands in
    ``spaced`` without the first."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._prove()
        self.room = REMEMBERED

    def _prove(self) -> None:
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        pairs = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}
        inside = {c for pair in pairs for c in pair}
        if any(b == BLANK != a for a, b in pairs):
            raise ValueError("a piece holds a blank behind another character, so that texts cannot be cut at blanks")
        alone = [c for c in map(chr, range(32)) if c not in inside and len(m.encode(f"a{c}a")) == 3]
        if "\n" not in alone:
            raise ValueError("a piece holds a line's end with other characters")
        self.cuts = re.compile("[" + re.escape("".join(alone)) + "]")
        spaced, bare = [p[1:].replace(BLANK, " ") for p in pieces if p[0] == BLANK], [p for p in pieces if p[0] != BLANK]
        self.spaced = {p: 1 for p, ids in zip(spaced, m.encode(spaced, num_threads=1), strict=True) if len(ids) == 1}
        self.spaced[""] = 1  # the blank alone, which the library gives for no text
        #: behind a line's end, whose tokens are its own by (b)
        self.head = len(m.encode("\n"))
        self.bare = {p: 1 for p, n in zip(bare, self._after_line(bare), strict=True) if n == 1} | {"": 0}
        self.whole = len(self.spaced) + len(self.bare) - 2

    def _after_line(self, words: list[str]) -> list[int]:
        return [len(ids) - self.head for ids in self.model.encode(["\n" + w for w in words], num_threads=1)]

    def _merge(self, known: dict[str, int], words: list[str]) -> dict[str, int]:
        """Counts of pre-tokens that ``known`` lacks, remembered there while there is room."""
        found = [len(ids) for ids in self.model.encode(words, num_threads=1)] if known is self.spaced else self._after_line(words)
        counts = dict(zip(words, found, strict=True))
        for w, n in counts.items():
            if len(w) <= LONGEST and self.room > 0:
                known[w] = n
                self.room -= len(w) + 1
        return counts

    def _sum(self, known: dict[str, int], words: list[str]) -> int:
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            new = self._merge(known, list({w for w in words if w not in known}))
            return sum(known[w] if w in known else new[w] for w in words)

    def count(self, text: str) -> int:
        if not text:
            return 0
        spaced: list[str] = []
        bare: list[str] = []
        parts = self.cuts.split(text.replace(BLANK, " "))
        for k, part in enumerate(parts):
            # the library writes a blank before the text
            runs = part.split(" ") if k else ["", *part.split(" ")]
            bare.append(runs[0])
            if "" in runs[1:-1]:
                runs = _joined(runs)
            spaced += runs[1:]
        return len(parts) - 1 + self._sum(self.bare, bare) + self._sum(self.spaced, spaced)


def _joined(runs: list[str]) -> list[str]:
    """Where blanks follow one another, all of them before the word behind them."""
    out, blanks = [runs[0]], ""
    for w in runs[1:-1]:
        if w:
            out.append(blanks + w)
            blanks = ""
        else:
            blanks += " "
    out.append(blanks + runs[-1])
    return out


@lru_cache(maxsize=2)
def counter(path: str | None = None) -> Counter:
    import public_tokenizers

    return Counter(path or public_tokenizers.path(VOCABULARY))


def counted(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None, names: tuple[str, str, str] | None = None) -> DataFrame:
    """``docs`` with the bytes and tokens of ``text`` and whether the tokens are more
    than ``limit``, in columns of NAMES or, where these are taken, of names made from them."""
    names = names or fresh(docs, *NAMES)
    added = StructType([StructField(n, t) for n, t in zip(names, (LongType(), LongType(), BooleanType()), strict=True)])

    def make(text: pa.Array) -> list[pa.Array]:
        c = counter(vocabulary)
        n = pa.array([c.count(t or "") for t in text.to_pylist()], pa.int64())
        return [pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()), n, pc.greater(n, limit)]

    return with_columns(docs, added, ["text"], make)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return counted(docs).select("doc_id", *NAMES)

"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again for the next.  All but the last keep the
columns of ``documents``, and columns of any other name.

In every stage an empty table gives an empty one, and texts of any length are worked on
whole.  What becomes of null texts, null ids, repeated rows and ties stands with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import decontaminate, language_id, packing, pii, simhash
from skerry.llm.common import columns, fresh, materialize, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; ``und`` and ambiguous ones go.
    ``lang`` becomes the predicted language.  A text that is null, empty or without a
    letter is ``und``; repeated rows and null ids are judged each by their text; a null
    ``lang`` is not learned from; where nothing can be learned, no document stays.  Of
    languages that score alike the one first by name counts."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    pred, _, ambiguous = names = fresh(docs, *language_id.NAMES)
    found = language_id.predict(docs, model, names).where((F.col(pred) != language_id.UNKNOWN) & ~F.col(ambiguous))
    return found.withColumn("lang", F.col(pred)).select(*columns(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of texts
    of one id that are near copies the one with the smallest digest.  Rows that repeat
    an id and text become one; null and empty texts are copies of one another; rows
    without an id stay."""
    return simhash.deduplicated(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs.  Null and empty texts have none and
    stay; repeated rows and rows of one id are judged each by their own text; items
    without words match nothing."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by marks.  A null text stays null;
    repeated rows are changed alike; spans that start together are marked in the order
    of their kinds."""
    return pii.redacted(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their tokens, and their places in sequences.  A null text
    is an empty one; repeated rows and rows without an id are packed each; pieces of one
    length may change places."""
    return packing.packed(docs, keep_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Classifiers, fingerprints and tokenizers cannot be written in SQL; tests/llm
#: compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""A word list learned from texts, and what it tells of a picture's writing."""

import pickle
import random
import string

from pyspark.sql import functions as F

from skerry.operators import lexicon
from skerry.sources import extract


def test_words_are_counted_by_documents(spark):
    units = spark.createDataFrame([(1, "Haus haus ab"), (1, "haus"), (2, "HAUS été"), (3, "été x1"), (4, "été"), (5, None)], "file_id long, text string")
    assert {r["word"]: r["n"] for r in lexicon.word_counts(units).collect()} == {"haus": 2, "été": 3}
    words = lexicon.learn(units, least=2)
    assert len(words.words) == 2 and words("Haus") and words("ÉTÉ") and not words("x1") and not words("hau")
    assert not lexicon.learn(units, least=4)("haus") and len(lexicon.learn(units, least=1, most=1).words) == 1
    assert pickle.loads(pickle.dumps(words))("haus") and not lexicon.Lexicon([])("haus")


def test_parts_make_words_that_no_list_has(spark):
    units = spark.createDataFrame([(i, t) for i, t in enumerate(["banana", "ananas", "bana", "xyz"])], "file_id long, text string")
    assert {r["part"]: r["n"] for r in lexicon.part_counts(units).collect()} | {"ana": 3, " ba": 2, "na ": 2, "xyz": 1, "as ": 1} == {r["part"]: r["n"] for r in lexicon.part_counts(units).collect()}
    words = lexicon.learn(units, least=2)
    assert words("bananana") and not words("xyz") and not words("nabana") and len(words.words) == 0


def test_gibberish_is_told_from_the_words_of_four_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    words = lexicon.learn(docs.where(~apart), "doc_id")
    r = random.Random(3)
    gibberish = ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(5, 10))) for _ in range(3000)]
    assert sum(map(words, gibberish)) < 0.01 * len(gibberish)
    ports = extract.Ports(ocr=bytes.decode, is_word=words)
    by_language = {}
    for row in docs.where(apart & (F.length("text") > 200)).select("lang", F.substring("text", 1, 200).alias("t")).collect():
        by_language.setdefault(row["lang"], []).append(bool(ports.writing(row["t"].encode())))
    print({k: (sum(v), len(v)) for k, v in by_language.items()}, sum(map(words, gibberish)), len(words.words), len(words.parts))
    assert len(by_language) == 4 and all(sum(v) > 0.9 * len(v) for v in by_language.values())
    lines = [" ".join(gibberish[i : i + 8]) for i in range(0, 3000, 8)]
    assert not any(ports.writing(t.encode()) for t in lines)

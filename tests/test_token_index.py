"""Tokens like a word, found by letter pairs: nothing that counts is lost."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.functions import kernels
from skerry.operators import matchers, token_index, units
from skerry.operators.token_index import TokenIndex, least_shared, lengths_like, pairs_of

WEIGHTS = {"contains": 0.5, "fuzzy": 0.3, "phonetic": 0.2}


@settings(max_examples=1500, deadline=None)
@given(st.text("abc", min_size=2, max_size=14), st.data())
def test_the_bound_loses_nothing(word, data):
    other = list(word)
    for _ in range(data.draw(st.integers(0, 4))):
        at = data.draw(st.integers(0, len(other)))
        other[at : at + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "a", "b", "cc", "x"]))
    other = "".join(other)
    if other and kernels.ratio(word, other) >= matchers.TOKEN_RATIO:
        bound = least_shared(len(word), len(other))
        assert bound is not None and len(other) in lengths_like(len(word))
        assert sum((pairs_of(word) & pairs_of(other)).values()) >= bound
    assert least_shared(len(word), len(other) or 1) is None or (len(other) or 1) in lengths_like(len(word))


def test_bounds_leave_pairs_for_words_of_three_letters_and_more():
    for a in range(3, 60):
        assert all((n := least_shared(a, b)) is None or n >= 1 for b in lengths_like(a) if b >= token_index.SHORTEST), a
    assert least_shared(2, 3) == 0


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    stems = ["worthless", "window", "garden", "straße", "année", "it's", "ab", "kettle", "lantern"]

    def spelt(w):
        w = list(w)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w[r.randrange(len(w))] = r.choice(["", "e", "x", "nn"])
        return "".join(w)

    data = [(i, i % 3, " ".join(spelt(r.choice(stems)) + r.choice(["", "", "s", "ing"]) for _ in range(r.randint(0, 9)))) for i in range(400)] + [(400, 0, None), (401, 0, "   ")]
    return spark.createDataFrame(data, "doc long, `part.no` int, text string").cache()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return TokenIndex.build(rows, ["doc", "part.no"], "text", str(tmp_path_factory.mktemp("index") / "i"))


def brute(rows, words, weights):
    out = rows.withColumn("score", units.term_score(" ".join(words), F.col("text"), F.lit("line"), weights)).where("score > 0")
    return sorted((r["doc"], r["part.no"], round(r["score"], 9)) for r in out.collect())


@pytest.mark.parametrize("words", [["worthles", "window"], ["gardn"], ["strase", "kettle", "lantern"], ["annee", "wind"], ["zzz", "window"], ["it's", "garden"]])
@pytest.mark.parametrize("weights", [WEIGHTS, {"contains": 1.0}])
def test_scores_are_those_of_all_tokens(index, rows, words, weights):
    if len(words) == 1:
        words = [*words, *words]
    got = sorted((r["doc"], r["part.no"], round(r["score"], 9)) for r in index.scores(words, weights).collect())
    assert got == brute(rows, words, weights)


def test_few_tokens_are_looked_at(index, spark):
    whole = index._read("vocabulary").count()
    for word in ("worthless", "garden", "lantern"):
        found = {r["token"] for r in index.candidates(word).collect()}
        assert len(found) < whole / 3
        count = {r["token"] for r in index._read("vocabulary").collect() if word in r["token"] or kernels.ratio(word, r["token"]) >= 80}
        assert count <= found
    assert index.candidates("ab").count() == whole
    assert index.scores([], WEIGHTS).count() == 0
    plan = spark._jvm.PythonSQLUtils.explainString(index.candidates("garden")._jdf.queryExecution(), "formatted")
    assert "In(pair, [" in plan.split("PushedFilters: ")[1].split("\n")[0]


def test_an_empty_table_gives_an_empty_index(rows, tmp_path):
    index = TokenIndex.build(rows.limit(0), ["doc"], "text", str(tmp_path / "none"))
    assert index.scores(["window", "garden"], WEIGHTS).count() == 0
    assert token_index.pairs_of("aaa") == {"aa": 2}

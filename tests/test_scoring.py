"""Which tokens may count for a word, matching by meaning, and near matches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import kernels
from skerry.operators import matchers, records, units
from skerry.operators.file_search import search_files
from skerry.plans.query import Q


def _scores(spark, term, texts, kind="line", weights=None, below=None):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(units.term_score(term, F.col("t"), F.lit(kind), weights, below)).collect()]


def _composite(word, token):
    parts = {0.35: kernels.fuzzy(word, token), 0.15: float(token.startswith(word) or token.endswith(word)), 0.12: kernels.phonetic(word, token), 0.10: float(word in token), 0.08: float(word == token)}
    return sum(w * s for w, s in parts.items()) / sum(parts)


def test_each_word_needs_a_token_like_it(spark):
    got = _scores(spark, "far cry", ["And got so far, let me in", "a far cry", "cries, fare", None, "", "farr crye"])
    assert got[0] == 0 and got[1] == pytest.approx(1) and got[2:5] == [0, 0, 0]
    assert got[5] == pytest.approx(min(_composite("far", "farr"), _composite("cry", "crye")))
    # an ending misspelt still counts, by the full weights
    assert _scores(spark, "quarterly revenue", ["quartely revenues"]) == [pytest.approx(min(_composite("quarterly", "quartely"), _composite("revenue", "revenues")))]
    # without matchers that look inside, containing is not enough: the ratio decides
    assert _scores(spark, "rev plan", ["revenue planning"], weights={"fuzzy": 1.0}) == [0]


def test_short_words_do_not_match_tokens_by_sound(spark):
    assert _scores(spark, "nit", ["knight knit"], "tag") == [pytest.approx(_composite("nit", "knit"))]
    assert _scores(spark, "nit", ["night"], "ocr") == [0]
    assert _scores(spark, "night", ["[Title] knight"], "tag") == [pytest.approx(_composite("night", "knight"))]


def _encode(texts):
    meaning = {"car": (1, 0), "auto": (0.9, 0.1), "automobile": (1, 0.2), "tree": (0, 1)}
    return np.array([meaning.get(t, (0, 0)) for t in texts], dtype=float)


def test_encoder_makes_meaning_count(spark):
    df = spark.createDataFrame([("auto",), ("tree",), ("",), (None,)], "w string")
    with pytest.raises(RuntimeError):
        records.search(df, "car", where=Q.semantic("w"))
    plain = _scores(spark, "car", ["auto"])
    matchers.use_encoder(_encode)
    try:
        found = {r["w"]: r["score"] for r in records.search(df, "car", where=Q.semantic("w")).collect()}
        assert set(found) == {"auto"} and found["auto"] > 0.99
        assert _scores(spark, "car", ["auto", "tree"], below=0.35)[0] > 0.99 > plain[0]
        assert _scores(spark, "car", ["tree"], "tag") == [0] and _scores(spark, "car", ["auto"], "ocr")[0] > 0
    finally:
        matchers.use_encoder(None)
    assert not matchers.has_encoder()


def test_near_match_is_shown_where_a_name_matched(spark, tmp_path):
    def speech(data):
        yield 3, "nothing at all", "transcript"
        yield 9, data.decode(), "transcript"

    (tmp_path / "knitting.wav").write_text("kniting")
    weights = {"contains": 0.35, "phonetic": 0.65}
    row = search_files(spark, str(tmp_path), "knitt", weights=weights, readers={".wav": speech}).results.first()
    assert row["breakdown"]["name"] > 0.35 and row["breakdown"]["content"] == 0
    assert [(x["line_number"], x["location_kind"]) for x in row["lines"]] == [(9, "transcript")]
    assert 0.18 <= row["lines"][0]["score"] < 0.25


def test_vocabulary_gives_the_scores_of_rows(spark):
    texts = ["knight knit", "the night", "", None, "nothing"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    joined = {r["i"]: r["score"] for r in units.vocabulary_scores(rows, ["i"], "t", "night").collect()}
    direct = _scores(spark, "night", texts, "tag")
    assert joined == {i: pytest.approx(s) for i, s in enumerate(direct) if s > 0} and set(joined) >= {0, 1}


def test_composites_of_values_that_cannot_reach_enough_are_zero_and_others_whole():
    weights = {"fuzzy": 0.35, "partial": 0.15, "phonetic": 0.12, "contains": 0.1, "exact": 0.08}
    r = random.Random(12)
    pieces = ["worth", "less", "school", "rock", "knight", "phone", "mac", "back", "e", " ", "of", "é", "ß", "the", "x1"]
    values = ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(1500)] + ["k", "", "worthless", " ", "rock" * 80]
    for query in ("worthless", "school of rock", "knight", "mac", "x1", "a", "phone" * 20):
        whole = kernels.soft_composite(query, values, weights)
        plain = [sum(w * f for w, f in zip(weights.values(), (kernels.fuzzy(query, v), float(bool(v) and (v.startswith(query) or v.endswith(query))), kernels.phonetic(query, v), float(query in v), float(v == query)), strict=True)) / 0.8 for v in values[:200]]
        assert np.allclose(whole[:200], plain, atol=1e-12)
        for least in (0.18, 0.35, 0.6):
            cut = kernels.soft_composite(query, values, weights, least)
            assert ((cut == whole) | (cut == 0)).all() and (whole[cut == 0] < least).all()


def test_phonetic_scores_are_those_of_whole_codes():
    r = random.Random(13)
    values = ["".join(r.choice(["kn", "ph", "sch", "mac", "gh", "w", "r", "ll", "mm", "a", "o", "e", "t", " ", "1", "k", "tion"]) for _ in range(r.randint(0, 30))) for _ in range(2500)]
    for query in ("knight", "school", "macdonald", "phone", "a", "rr", "1"):
        a, s, n = kernels.metaphone(query), kernels.soundex(query), kernels.nysiis(query)
        for v, got in zip(values, kernels.phonetic_many(query, values), strict=True):
            b = kernels.metaphone(v) if v else ""
            near = kernels.ratio(a, b) / 100
            want = 0.0 if not a or not b else 1.0 if a == b else 0.5 * near if near >= 0.5 else 0.0
            if v and want < 0.85 and (s and s == kernels.soundex(v) or n and n == kernels.nysiis(v)):
                want = 0.85
            assert got == want, (query, v)


def test_metaphone_codes_of_published_examples():
    """Codes by the rules of the algorithm's first publication (Philips 1990)."""
    codes = {"back": "BK", "duck": "TK", "rocket": "RKT", "thumb": "0M", "phone": "FN", "school": "SKL", "judge": "JJ", "wrack": "RK", "xenon": "SNN", "match": "MX"}
    assert {w: kernels.metaphone(w) for w in codes} == codes


def test_rows_of_equal_scores_keep_their_order(spark):
    rows = spark.createDataFrame([(i, "alpha" if i % 3 else "alphabet", i) for i in range(3000)], "id int, t string, _place int").repartition(1).sortWithinPartitions("id")
    for _ in range(2):
        got = [r["id"] for r in records.search(rows, "alpha", where=Q.composite("t"), limit=10).collect()]
        assert got == [i for i in range(3000) if i % 3][:10]
    assert records.search(rows, "alpha", where=Q.contains("t")).columns == ["id", "t", "_place", "score"]

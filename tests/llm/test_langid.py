"""Language ID against a dictionary version of the distance, and on held-out rows."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulseloom.llm import langid
from pulseloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain(profiles, text):
    known = set(profiles.letters)
    grams = Counter()
    for word in langid.words_of(text or ""):
        if word:
            grams.update(langid.grams_of("".join(c if c in known else "\U0010ffff" for c in word)))
    if not grams or not profiles.ranked:
        return "und", 0.0
    place = {c: chr(i) for i, c in enumerate(["_", *profiles.letters, "\U0010ffff"])}
    top = sorted(grams, key=lambda g: (-grams[g], len(g), [place[c] for c in g]))[:profiles.document_length]
    scores = []
    for language in profiles.languages:
        rank = {g: i for i, g in enumerate(profiles.ranked[language])}
        scores.append(sum(abs(rank[g] - i) if g in rank else profiles.length for i, g in enumerate(top)))
    best = min(range(len(scores)), key=scores.__getitem__)
    return profiles.languages[best], max(0.0, 1 - scores[best] / (len(top) * max(profiles.length, profiles.document_length)))


@pytest.fixture(scope="module")
def documents(spark):
    if not Path(SF).exists():
        pytest.skip("test tables are not here")
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_distance(spark, documents):
    profiles = langid.learn(documents, per_language=40, length=150, document_length=90)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdeéñ ,.ZŻ漢字İ1_") for _ in range(rnd.randint(0, 80))) for _ in range(200)]
    texts += [None, "", "12 !?", "a", "the " * 30_000, "Straße"] + [r.text for r in documents.limit(40).collect()]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, profiles).collect()}
    for i, t in enumerate(texts):
        want = plain(profiles, t)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1]), (i, t)
    kept = {r.doc_id for r in langid.keep_known(df, profiles).collect()}
    assert kept == {i for i in got if got[i][0] != "und"}


def test_held_out_rows(spark, documents):
    held = QUERIES["op9_language_id"](spark, SF).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    right = held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    profiles = langid.learn(empty)
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.learn(one).ranked == {}
    assert langid.predict(one, profiles).first()[1:] == ("und", 0.0)
    assert langid.predict(empty, profiles).collect() == []

"""License scans against plain search, and the tolerant part on edited notices."""

import random
import re

import pytest

from pulseloom.llm import licenses
from pulseloom.llm.queries import LICENSE_PHRASES, LICENSE_TEMPLATES

WORD = re.compile(licenses.WORD)


def plain(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in LICENSE_PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places(spark):
    rnd = random.Random(1)
    some = "under the mit license apache version 2 cc by nc É und 7 The MIT Licenseß".split()
    texts = [" ".join(rnd.choice(some) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "cc-by-nc", "Under the MIT\nlicense, under the mit license!", "cc by nc " * 4000, "x" * 100_000, "cc by nc", "cc by nc"]
    df = spark.createDataFrame([(i if i % 50 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, labels int").repartition(3)
    got = sorted((tuple(r) for r in licenses.scan(df, LICENSE_PHRASES, LICENSE_TEMPLATES).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=repr)
    assert got == sorted(((i if i % 50 else None, *plain(t)) for i, t in enumerate(texts)), key=repr)


def test_edited_notices(spark):
    bsd = next(t for t, label in LICENSE_TEMPLATES if label == "bsd")
    words = bsd.split()
    texts = [bsd, " ".join(words[:9] + ["really"] + words[9:]), "lorem " * 50 + bsd + " ipsum" * 50, " ".join(words[:8]),
             "this work is licensed under the GNU General Public License, version 3.", "nothing of the kind"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df, LICENSE_PHRASES, LICENSE_TEMPLATES).collect()}
    assert [got[i][0] for i in range(6)] == ["bsd", "bsd", "bsd", "", "gpl-3", ""]
    assert got[0][1] == 1.0 and 0.7 <= got[1][1] < 1.0 and got[3][1] == got[5][1] == 0.0


def test_short_phrase_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(df, LICENSE_PHRASES, []).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(df, [("two words", "x")], [])
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert licenses.scan(one, [], []).first().labels == ""

"""Keyword search by the index against the comparison of all rows."""

import random

from pyspark.sql import functions as F

from pulseloom.operators import postings
from pulseloom.operators.overview import keyword_filter


def test_search_equals_the_scan(spark, tmp_path):
    rnd = random.Random(8)
    letters = ["a", "b", "B", "%", "_", " ", "é", "É", "İ", "ß", "\U0001d538", "\U00010400", "日", "\\", "Σ"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(400)] + [None, "", "ab", "abc" * 2000 + "%_É"]
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)] + [(7, "same key a%_b", "y")]
    df = spark.createDataFrame(rows, "id long, name string, extra string").repartition(4)
    path = str(tmp_path / "index")
    postings.write(df, "id", "name", path)
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(3, 4))) for _ in range(9)]
    words += [t[k:k + 4] for t in texts[:30:7] for k in (0, 2)] + ["", "a", "%_É", "ABCABC", "a%_b", "nowhere", "\U0001d538b"]
    hits = 0
    for word in words:
        want = sorted(keyword_filter(df, "name", word).collect(), key=repr)
        assert sorted(postings.search(df, "id", "name", word, path).collect(), key=repr) == want, word
        hits += bool(want)
    assert hits > 8


def test_common_grams_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, f"report {i}") for i in range(300)], "id long, name string")
    path = str(tmp_path / "index")
    postings.write(df, "id", "name", path)
    assert postings.search(df, "id", "name", "REPORT", path).count() == 300  # all rows hold it: no postings are read
    plan = postings.search(df, "id", "name", "port 29", path)
    assert "_gram" in plan._jdf.queryExecution().toString() and plan.count() == 11
    none = df.where(F.lit(False))
    postings.write(none, "id", "name", path)
    assert postings.search(none, "id", "name", "port", path).collect() == []

"""The pipeline's stages against plain versions, and null and repeated rows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulseloom.llm import langid, leaks, repeats, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stages(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "s", None), (90002, "12 34", None, None, 5), (90003, "", "de", "s", 0)], given.schema)
    docs = given.unionByName(odd)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_copies", "repeated_passages", "benchmark_leaks", "byte_bpe"]
    stages = dict(corpus_pipeline.STAGES)

    spoken = corpus_pipeline.materialise(stages["language_id"](spark, docs, SF))
    assert spoken.columns == COLUMNS
    profiles = langid.learn(docs)
    assert {r.doc_id for r in spoken.collect()} == {r.doc_id for r in docs.collect() if profiles.predict(r.text)[0] != "und"}

    apart = corpus_pipeline.materialise(stages["near_copies"](spark, spoken, SF))
    assert apart.columns == COLUMNS
    sets = {r.doc_id: set(simhash.shingles(r.text.encode(), 5)) for r in spoken.collect()}
    kept = {r.doc_id for r in apart.collect()}
    near = {(i, j): jaccard(sets[i], sets[j]) for i in sets for j in sets if j < i}
    least = {i: i for i in sets}  # groups that links of 0.8 or more reach, in exact arithmetic
    for (i, j), _ in sorted(near.items()):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((least[i], least[j]))
            least = {x: a if y == b else y for x, y in least.items()}
    assert kept == set(least.values())

    cut = corpus_pipeline.materialise(stages["repeated_passages"](spark, apart, SF))
    assert cut.schema.simpleString() == apart.schema.simpleString()
    texts = {r.doc_id: r.text.encode() for r in apart.collect()}
    seen = {}
    for t in texts.values():
        for i in range(len(t) - 199):
            seen[t[i:i + 200]] = seen.get(t[i:i + 200], 0) + 1
    for r in cut.collect():
        t = texts[r.doc_id]
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        edges = [i for i in range(len(t) + 1) if (gone[i - 1] if i else 0) != (gone[i] if i < len(t) else 0)]
        left, at = b"", 0
        for a, b in zip(edges[::2], edges[1::2]):
            a, b = repeats._forward(t, a), repeats._back(t, b)
            if a < b:
                left, at = left + t[at:a], b
        assert r.text.encode() == left + t[at:] and r.n_chars == len(r.text)

    clean = corpus_pipeline.materialise(stages["benchmark_leaks"](spark, cut, SF))
    items = [leaks.normalise(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = leaks.Index(items, leaks.Rule())
    rows = cut.collect()
    held = index.documents([r.text.encode() for r in rows])
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r, h in zip(rows, held) if not h}

    last = stages["byte_bpe"](spark, clean, SF)
    assert last.count() == clean.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_null_and_repeated_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "one two three four five six seven eight " * 3
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (None, text, "en", "a", 1), (3, None, "en", "a", 0), (4, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, schema)
    kept = sorted((r.doc_id or 0 for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()))
    assert kept == [0, 1, 3]  # without an id: kept; the null and the empty text are copies of each other
    cut = {(r.doc_id, r.text) for r in corpus_pipeline.cut_repeated_passages(spark, docs, SF).collect()}
    assert (3, None) in cut and (4, "") in cut
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_an_id_with_several_texts(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    words = [f"w{i}" for i in range(100)]
    one, near, clean = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"v{i}" for i in range(100))
    rows = [(1, one), (2, near), (2, clean), (3, clean + " a"), (4, "m " + " ".join(reversed(words))), (4, "n " + " ".join(reversed(words)))]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], schema)
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert kept[:2] == [(1, one), (2, clean)]  # the clean text of an id stays when its other text is a copy
    assert [k for k, _ in kept] == [1, 2, 4]  # of two near texts of one id one stays


CLASHES = ["kept", "spans", "n_bytes", "_missing", "_id", "_copy", "_text_id", "key", "id", "ranges", "other_0", "_c0"]


def test_other_columns_of_any_name(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("lang", F.lit("xx"))
    more = given.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    docs = more.unionByName(more.where("doc_id < 5"))  # repeated rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF))
        assert docs.schema.simpleString() == more.schema.simpleString(), name
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)

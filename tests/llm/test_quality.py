"""Quality rules: base counts against a plain version, the classifier on rows it hasn't seen."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulseloom.llm import quality
from pulseloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    seen, again = set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def odd_texts():
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "a", "\x1c\x85\xa0 x", "a\x0bb\x0cc\rd", "$$|<>#*%& é漢😀", "x\nx\n x\nx \n\n\n", "the " * 5000, "a b " * 4,
             "a b c d e f g h " * 2, "a b c d e f g h i " * 2, "1 " * 8, "1 " * 9, "z" * 100_000, "é" * 700 + "   y"]
    for _ in range(150):
        some = [rnd.choice(["a", "b", "é", "|", "w x", "the", "\n", "\n", "  ", "\t"]) for _ in range(rnd.randint(0, 120))]
        texts.append(rnd.choice(["", " "]).join(some))
        texts.append(" ".join(rnd.choices("abc", k=rnd.randint(0, 60))))
    return texts


def test_base_counts_and_rules(spark):
    rows = list(enumerate(odd_texts())) + [(1, "again"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(k, t, True, "x") for k, t in rows], "doc_id long, text string, kept boolean, n_words string")
    got = [tuple(r) for r in quality.judge(df, None).collect()]
    want = []
    for k, t in rows:
        counts = plain(t)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        want.append((k, *counts, failed, None, not failed))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pieces_hold_every_ngram(monkeypatch):
    texts = [t for t in odd_texts() if t]
    whole = [quality.shares(t, 12) for t in texts]
    monkeypatch.setattr(quality, "PIECE", 7)
    for t, (places, shares) in zip(texts, whole):
        again = quality.shares(t, 12)
        assert again[0].tolist() == places.tolist() and again[1].tolist() == pytest.approx(shares.tolist())
    # shares of a kind add up to its scale, for each kind that the text has
    for t, (_, shares) in zip(texts, whole):
        raw, words = t.encode(), t.encode().split()
        kinds = sum(len(raw) >= n for n in quality.BYTES) + sum(len(words) >= n for n in quality.WORDS)
        assert shares.sum() == pytest.approx(quality.SCALE * kinds)


def test_margin_is_the_product_of_weights_and_shares():
    import numpy as np

    weights = np.random.default_rng(1).standard_normal(1 << 12)
    model = quality.Model(weights, 0.25, 2.0, -1.0)
    for t in odd_texts():
        raw, _, hashes = quality._read(t)
        places, shares = quality.shares(t, 12)
        assert model.margin(raw, hashes) == pytest.approx(0.25 + float(weights[places] @ shares), abs=1e-9)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_rows_not_learned_from(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 1
    model = quality.learn(documents, labels.where(~held))
    judged = quality.judge(documents, model).join(labels.where(held), "doc_id").select("kept", "base_failed", "quality", "probability").collect()
    good, bad = ([r for r in judged if r.quality == q and not r.base_failed] for q in (1, 0))
    assert len(good) > 500 and len(bad) > 30
    assert sum(r.kept for r in good) / len(good) > 0.99 and sum(not r.kept for r in bad) / len(bad) > 0.9
    # calibrated on labelled rows of all kinds: the mean probability is the share of good ones
    share = sum(r.quality for r in judged) / len(judged)
    assert sum(r.probability for r in judged) / len(judged) == pytest.approx(share, abs=0.03)


def test_query_has_every_document(spark):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = QUERIES["op11_quality_rules"](spark, path).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts == plain(texts[r.doc_id])
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert r.kept == (not r.base_failed and r.probability >= 0.5) and 0 <= r.probability <= 1


def test_labels(spark):
    docs = spark.createDataFrame([(i, ("good text here " if i % 2 else "BAD!! | ") * 10 + str(i)) for i in range(80)] + [(3, None), (None, "x")],
                                 "doc_id long, text string")
    kind = "doc_id long, quality int, toxic int"
    for rows in ([], [(1, 1, 0)], [(1, None, 0), (None, 1, 0), (2, 7, 0)], [(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, 0, 1)], [(900, 1, 0), (901, 0, 0)]):
        assert quality.learn(docs, spark.createDataFrame(rows, kind)) is None
    model = quality.learn(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(60)] * 2, kind), bits=10)
    kept = {r.doc_id: r.kept for r in quality.judge(docs.where("doc_id >= 60"), model, least_words=0, repeated_percent=100).collect()}
    assert all(kept[i] == bool(i % 2) for i in kept) and len(kept) == 20
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(empty, model).collect() == [] and quality.learn(empty, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], kind)) is None

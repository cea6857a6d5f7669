"""Ranked search against a plain version that scores every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pulseloom.llm import ranked
from pulseloom.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, queries, k=20):
    counts = [Counter(cut(t)) for _, t in docs]
    lengths = [sum(c.values()) for c in counts]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in queries:
        scored = []
        for (doc, _), c, length in zip(docs, counts, lengths):
            score = 0
            for t in cut(text):
                if t in c:
                    m = 100 - 25 + (25 * length * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def check(spark, docs, queries, parts=3, **more):
    d = spark.createDataFrame([(k, t, 5, "x") for k, t in docs], "doc_id long, text string, rank int, n string").repartition(parts)
    q = spark.createDataFrame([(k, t, 1.5) for k, t in queries], "item_id long, text string, score double")
    got = ranked.rank(d, q, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, queries, more.get("k", 20))


def sentences(seed, n, words=60, longest=40):
    rnd = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    odds = [1 / (i + 1) for i in range(words)]
    return [" ".join(rnd.choices(names, odds, k=rnd.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("short", [0, 3, 40, 10_000])
def test_against_plain(spark, short):
    docs = list(enumerate(sentences(1, 400)))
    check(spark, docs, list(enumerate(sentences(2, 30))), short=short, k=7)


def test_small_segments_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "SEGMENT", 1)
    check(spark, list(enumerate(sentences(3, 3000, longest=12))), list(enumerate(sentences(4, 12))), short=20, block_bytes=300, k=5)


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, " .,!"), (4, "Straße ÉTÉ été 漢字 K9"), (5, "straße"), (5, "straße"), (None, "straße"), (None, "k9 K9"),
            (7, "k9 k9"), (8, "K9K"), (9, "x" * 1000 + " k9"), (10, "the " * 50_000 + "end"), (11, "\x00a`b{c")]
    queries = [(1, "STRASSE Straße k9 K9"), (1, "été"), (2, None), (3, "?"), (None, "the end a b c"), (4, "nothing here")]
    check(spark, docs, queries)
    check(spark, docs, [], k=3)
    check(spark, [], queries)
    check(spark, [(1, None)], queries)


def test_ties_go_by_id(spark):
    docs = [(i, "same words here") for i in range(100, 0, -1)] + [(i, "other words") for i in range(200, 260)]
    check(spark, docs, [(1, "same"), (2, "words"), (3, "other same words words")], parts=5, short=4)


def test_search_skips_nothing_that_counts(monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 4)
    rng = np.random.default_rng(5)
    for trial in range(200):
        size, terms = int(rng.integers(1, 300)), 12
        pairs = [(d, t) for t in range(terms) for d in range(size) if rng.random() < rng.random() / (t + 1)]
        if not pairs:
            continue
        doc, term = np.array(pairs).T
        adds = rng.integers(0, 30, len(doc))
        segment = ranked.Segment(np.arange(size) * 3, np.ones(size, bool), doc, term, adds, terms)
        query = [(t, int(rng.integers(1, 3))) for t in range(terms)]
        scores = np.zeros(size, dtype=np.int64)
        for t, times in query:
            np.add.at(scores, doc[term == t], adds[term == t] * times)
        least = int(rng.integers(1, 40))
        found, got = ranked.search(segment, query, 5, least, int(rng.integers(0, 60)))
        assert (scores[found] == got).all()
        want = sorted(((-s, d) for d, s in enumerate(scores) if s >= least))[:5]
        assert sorted((-int(s), int(d)) for s, d in zip(got, found)) == want, trial


def test_query(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    queries = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got = QUERIES["op13_ranked_search"](spark, path).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, queries)

"""Centroid clustering against a plain version, row by row in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from pulseloom.llm import centroids
from pulseloom.llm.queries import QUERIES


def plain(rows, clusters, rounds, size, scale=256):
    good = [(k, v) for k, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(scale * x) for x in v] for _, v in good]

    def place(i):
        k = good[i][0]
        return (k is None, hashlib.sha256(f"2:{k}".encode()).hexdigest() if k is not None else "", good[i][1])

    own = [whole[i] for i in sorted(range(len(good)), key=place)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(own))

    for _ in range(rounds):
        at = [nearest(v)[1] for v in whole]
        own = [
            [sum(col) // len(col) for col in zip(*members)] if (members := [v for v, a in zip(whole, at) if a == n]) else c
            for n, c in enumerate(own)]
    found = [nearest(v) for v in whole]
    inertia = sum(d for d, _ in found)
    return [(k, n, d, sum(x for x, m in found if m == n), inertia, own[n]) for (k, _), (d, n) in zip(good, found)]


def check(spark, rows, **more):
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)
    given = {"clusters": 5, "rounds": 3, "size": 6} | more
    got = sorted((tuple(r) for r in centroids.cluster(df, **given).collect()), key=repr)
    given.pop("width", None)
    assert got == sorted(plain(rows, **given), key=repr)


def vectors(seed, n, size=6, spread=1.0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, size)) * spread).astype(np.float32).tolist()


@pytest.mark.parametrize("width", [1, 2, 4, 6])
def test_against_plain(spark, width):
    check(spark, list(enumerate(vectors(1, 200))), width=width)


def test_odd_vectors_ties_and_copies(spark):
    v = vectors(2, 12)
    rows = list(enumerate(v)) + [
        (100, None), (101, []), (102, [1.0] * 5), (103, [1.0] * 7), (104, [None] + [1.0] * 5), (105, [float("nan")] * 6),
        (106, [float("inf")] + [0.0] * 5), (107, [0.0] * 6), (108, [0.0] * 6), (3, v[3]), (3, v[4]), (None, v[0]), (None, v[1])]
    rows += [(200 + i, v[5]) for i in range(60)]
    check(spark, rows)
    check(spark, rows, clusters=100)  # more centroids than vectors
    check(spark, rows, rounds=0)
    check(spark, [(i, [float(i % 2)] * 6) for i in range(30)], clusters=3)  # equal starts, empty clusters


def test_pages_of_several_batches(spark, monkeypatch):
    monkeypatch.setattr(centroids, "PAGE", 7)
    check(spark, list(enumerate(vectors(3, 100))))


def test_large_components(spark):
    check(spark, list(enumerate(vectors(4, 40, spread=50_000.0))), width=6)
    with pytest.raises(Exception, match="don't fit a long"):
        check(spark, [(0, [1e9] * 6), (1, [0.0] * 6)])


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, None)])


def test_encoding_is_lossless():
    rng = np.random.default_rng(0)
    for block in (rng.integers(-5, 5, (50, 3)), rng.integers(-(1 << 26), 1 << 26, (50, 4))):
        distinct, codes = centroids.encode(block)
        assert (distinct[codes] == block).all() and len(np.unique(distinct, axis=0)) == len(distinct)


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = {(k, n, d, c, i, hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()) for k, n, d, c, i, own in plain(rows, 40, 5, 64)}
    df = QUERIES["op12_centroids"](spark, path)
    got = df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want

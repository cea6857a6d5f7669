"""Lattice hashing against all pairs."""

import numpy as np

from pulseloom.llm import lattice


def plain(rows, cosine):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = {i: np.array(rows[i][1], dtype=np.float64) / np.linalg.norm(np.array(rows[i][1], dtype=np.float64)) for i in good}
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(good):
        for j in good[:n]:
            if len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min([x for x in (least.get(top(i)), rows[i][0]) if x is not None], default=None)
    return sorted(((rows[i][0], links[i], least[top(i)]) for i in range(len(rows))), key=repr)


def clusters(seed, n, size, copies, noise):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = rng.standard_normal(size)
        base /= np.linalg.norm(base)
        for _ in range(int(rng.integers(1, copies + 1))):
            out.append((base + rng.standard_normal(size) * noise / np.sqrt(size)).astype(np.float32).tolist())
    return out


def check(spark, rows, **more):
    df = spark.createDataFrame([(k, v, 7) for k, v in rows], "vec_id long, embedding array<float>, n_links int").repartition(4)
    got = sorted((tuple(r) for r in lattice.near_links(df, **more).collect()), key=repr)
    assert got == plain(rows, more.get("cosine", 0.95))


def test_decode():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 8)) * 3
    near = lattice.decode(x)
    least = ((x - near) ** 2).sum(axis=1)
    assert least.max() <= 1 + 1e-9 and len(lattice.short_vectors()) == 240
    for v in lattice.short_vectors():
        assert (((x - near - v) ** 2).sum(axis=1) >= least - 1e-9).all()


def test_clusters_and_odd_vectors(spark):
    vectors = clusters(1, 60, 64, 5, 0.15)
    rows = list(enumerate(vectors))
    v = vectors[0]
    rows += [(900, v), (901, v), (901, v), (None, [2 * x for x in v]), (902, None), (903, []), (904, [0.0] * 64), (905, [float("nan")] + v[1:]),
             (906, [float("inf")] + v[1:]), (907, [None] + v[1:]), (908, [1.0, 2.0]), (909, [2.0, 4.0]), (None, None)]
    check(spark, rows)


def test_one_crowded_cell_in_blocks(spark):
    rows = list(enumerate(clusters(2, 1, 32, 1, 0.0) * 3 + clusters(3, 4, 32, 1, 0.0)))
    base = rows[0][1]
    rng = np.random.default_rng(5)
    rows += [(100 + i, (np.array(base) + rng.standard_normal(32) * 0.01).astype(np.float32).tolist()) for i in range(150)]
    check(spark, rows, block=16)


def test_empty_table(spark):
    assert lattice.near_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows, n = [], 400
    for i in range(n):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.952 * a + np.sqrt(1 - 0.952 ** 2) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = lattice.near_links(df).where("n_links = 1 and component = vec_id").count()
    assert found >= 0.97 * n

"""SimHash links and groups against all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pulseloom.llm import shinglesets, simhash


def plain_fingerprint(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def components(values, radius):
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ordered = list(parent)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius:
                parent[top(a)] = top(b)
    return {v: top(v) for v in parent}


def test_fingerprint_and_spark_hash(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "B", " ", "\t", "é", " ", "\n", "word"]) for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    texts += [None, "", "one two", "La " * 700]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None, 3) == plain_fingerprint(t, 3)
    same = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first().h  # the seed is 42 there too
    assert same % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def check_links(spark, values, radius, **more):
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = [(r.a, r.b) for r in simhash.link(df, radius, **more).collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius for a, b in edges)
    got = {v: v for v in values}

    def top(v):
        while got[v] != v:
            v = got[v]
        return v

    for a, b in edges:
        got[top(a)] = top(b)
    want = components(values, radius)
    pairs = [(a, b) for i, a in enumerate(values) for b in values[:i]]
    assert all((top(a) == top(b)) == (want[a] == want[b]) for a, b in pairs)


def test_links(spark):
    rnd = random.Random(4)
    values = {0, -1}
    for _ in range(25):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 6)):
            for _ in range(rnd.randint(0, 3)):
                base ^= 1 << rnd.randrange(64)
            values.add(simhash._signed(base))
    values = sorted(values)
    for radius, segments, bucket in ((2, 7, 64), (2, 3, 2), (2, 7, 1), (1, 5, 1), (0, 1, 64), (2, 9, 3)):
        check_links(spark, values, radius, segments=segments, bucket=bucket)


def test_groups(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))) for _ in range(150)] + [None, "", " \n", "w1 w2", "w1 w2"]
    rows = [(i * 3 if i % 40 else None, t, "x") for i, t in enumerate(texts)] + [(0, "w1 w2", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    got = sorted((tuple(r) for r in simhash.groups(df, 3).collect()), key=repr)
    root = components(sorted({plain_fingerprint(t, 3) for _, t, _ in rows}), 2)
    least = {}
    for key, t, _ in rows:
        r = root[plain_fingerprint(t, 3)]
        least[r] = min([x for x in (least.get(r), key) if x is not None], default=None)
    want = sorted(((key, plain_fingerprint(t, 3), least[root[plain_fingerprint(t, 3)]]) for key, t, _ in rows), key=repr)
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(df, 3).collect() == []
    assert simhash.later_copies(df).collect() == []


def near_copies(seed, bases, copies, words=400, changes=12):
    rnd = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [f"{rnd.randrange(5000)}" for _ in range(words)]
        for n in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, changes) if n else 0):
                own[rnd.randrange(words)] = f"{rnd.randrange(5000)}"
            rows.append(" ".join(own))
    rnd.shuffle(rows)
    return rows


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_later_copies(spark):
    texts = near_copies(1, 40, 4, changes=8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0] for r in simhash.later_copies(df).collect()}
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    sure = {i for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.85}
    possible = {i for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.7}
    assert len(sure - got) <= 0.03 * len(sure) and got <= possible


def test_later_copies_in_crowds(spark):
    texts = near_copies(2, 2, 120, words=300, changes=2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries_left = len(texts) - simhash.later_copies(df).count()
    assert entries_left == 2


def test_sketches_never_tell_similar_sets_apart():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m, both = (int(x) for x in rng.integers(0, 900, 3))
        common, a, b = (rng.integers(-(1 << 63), 1 << 63, k) for k in (both, n, m))
        one, two = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
        bits = np.bitwise_count((shinglesets._sketch(one) ^ shinglesets._sketch(two)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(one, two)) and len(shinglesets._sketch(one)) == shinglesets.SKETCH


def exact_groups(texts, similarity=0.8):
    """What is left of the rows 0, 1, ...: the least of each group that links of the similarity reach."""
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    root = list(range(len(texts)))

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            if jaccard(a, sets[j]) >= similarity:
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {i for i in range(len(texts)) if top(i) != i}


def dropped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r[0] for r in simhash.later_copies(df).collect()}


def test_later_copies_are_exact_at_any_size(spark):
    texts = near_copies(3, 100, 3, words=200, changes=8)  # many pairs close to 0.8, on both sides
    want = exact_groups(texts)
    assert want and dropped(spark, texts) == want
    rnd = random.Random(5)
    more = [" ".join(f"{rnd.randrange(10 ** 6)}" for _ in range(60)) for _ in range(6000)]
    assert dropped(spark, texts + more) == want


def test_later_copies_in_a_template(spark):
    rnd = random.Random(6)
    template = [f"t{i}" for i in range(200)]
    texts = []
    for _ in range(250):  # similarity of about 0.5 to each other
        base = template + [f"{rnd.randrange(10 ** 6)}" for _ in range(100)]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 1)):
            own = list(base)
            for _ in range(rnd.randint(2, 7)):  # 0.95 to 0.8
                own[rnd.randrange(len(own))] = f"{rnd.randrange(10 ** 6)}"
            texts.append(" ".join(own))
    rnd.shuffle(texts)
    assert dropped(spark, texts) == exact_groups(texts)


def test_crowded_buckets_are_compared_whole(spark):
    texts = near_copies(8, 2, 60, words=120, changes=6)  # members of a group are often not similar to each other
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(shinglesets.text_id(F.col("text")).alias("id"), "text")
    for crowd, sample in ((2, 1), (2, 10 ** 6), (1000, 1)):
        edges = [(r.a, r.b) for r in shinglesets.link(df, lambda t: simhash.shingles(t, 5), 0.8, crowd=crowd, sample=sample).collect()]
        ids = [r.id for r in df.collect()]
        sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t in zip(ids, texts)}
        assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in edges)
        root = {i: i for i in ids}

        def top(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in edges:
            root[top(a)] = top(b)
        assert all(top(a) == top(b) for a in ids for b in ids if jaccard(sets[a], sets[b]) >= 0.8)


def test_listed_rows_by_both_ways(spark):
    rows = spark.createDataFrame([(i % 7 if i % 5 else None, f"t{i}") for i in range(60)], "id long, text string").repartition(3)
    ids = spark.createDataFrame([(1,), (3,), (99,), (None,)], "id long")
    for how in ("left_semi", "left_anti"):
        want = sorted((r.id, r.text) for r in rows.collect() if (r.id in (1, 3)) == (how == "left_semi") and r.id is not None)
        for shipped in (None, 2):
            got = shinglesets.listed(rows, ids, "id", how, shipped).collect()
            assert sorted((r.id, r.text) for r in got if r.id is not None) == want
            assert sum(r.id is None for r in got) == (0 if how == "left_semi" else 12)  # a null meets nothing

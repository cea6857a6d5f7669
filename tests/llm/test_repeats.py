"""Repeated passages against a count of all strings."""

import collections
import random

import pytest

from pulseloom.llm import repeats


def plain(rows, length):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for key, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        edges = [i for i in range(len(b) + 1) if (gone[i - 1] if i else 0) != (gone[i] if i < len(b) else 0)]
        out.append((key, len(b), tuple(zip(edges[::2], edges[1::2])), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def found(df, length, **more):
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept))
                   for r in repeats.cut_repeats(df, length, **more).collect()), key=repr)


def corpus(seed, n, letters, length):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice(letters) for _ in range(rnd.randint(length // 2, 3 * length))) for _ in range(12)]

    def part():
        return rnd.choice(pool)[rnd.randint(0, 5):] if rnd.random() < 0.5 else "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 2 * length)))

    rows = [(i if rnd.random() < 0.9 else None, "".join(part() for _ in range(rnd.randint(0, 5))) if rnd.random() < 0.95 else None) for i in range(n)]
    return rows + rows[:3] + [(1, "a" * 300), (2, "ab" * 200), (3, ""), (4, None)]


@pytest.mark.parametrize("length, letters, crowd", [
    (20, "ab", 2000), (20, "abcdefghij é", 3), (200, "abcdefghijklmnop qrstuvé", 2000), (33, "abc", 2), (8, "abcde", 2000)])
def test_rows(spark, length, letters, crowd):
    rows = corpus(length + crowd, 50, letters, length)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, spans int").repartition(3)
    assert found(df, length, crowd=crowd) == plain(rows, length)


def test_long_text_in_chunks(spark, monkeypatch):
    rnd = random.Random(9)
    shape = repeats.Shape(50)
    text = bytes(rnd.choice(b"abc") for _ in range(5000))
    whole = repeats.triggers(text, shape)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    first, last, trigger = repeats.phrases(text, shape)
    assert first[0] == 0 and (first[1:] == last[:-1] + 1).all() and last[-1] == len(whole) - 1
    for a, b, t in zip(first, last, trigger):
        assert (whole[a:b + 1] == t).all()


def test_equal_strings_have_equal_triggers():
    rnd = random.Random(3)
    shape = repeats.Shape(60)
    middle = bytes(rnd.choice(b"ab") for _ in range(90))
    one, two = (repeats.triggers(bytes(rnd.choice(b"ab") for _ in range(n)) + middle + b"b" * n, shape) for n in (13, 40))
    assert (one[13:13 + 31] - 13 == two[40:40 + 31] - 40).all()


def test_whole_characters(spark):
    passage = "é" * 60
    rows = [(1, "x" + passage + "ü1"), (2, "yy" + passage + "ö22"), (3, None)]
    df = spark.createDataFrame([(k, t, "o") for k, t in rows], "doc_id long, text string, source string")
    got = {r.doc_id: (bytes(r.kept).decode(), r.source) for r in repeats.cut_repeats(df, 21, others=["source"], whole_characters=True).collect()}
    assert got == {1: ("xü1", "o"), 2: ("yyö22", "o"), 3: ("", "o")}


def test_empty_table(spark):
    assert repeats.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []

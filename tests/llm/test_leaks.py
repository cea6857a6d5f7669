"""Leaks against an edit distance over whole texts."""

import random
import time
import tracemalloc

import pytest

from pulseloom.llm import leaks


def distance(window, text):
    """Least edits between the window and any stretch of the text."""
    before = [0] * (len(text) + 1)
    for i, x in enumerate(window, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(before[j - 1] + (x != y), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def plain(rule, items, text):
    out = {}
    for k, item in enumerate(items):
        starts, size, edits = rule.windows(len(item))
        held = [c for c in (distance(item[s:s + size], leaks.normalise(text)) for s in starts) if c <= edits]
        if held:
            out[k] = (len(held), min(held))
    return out


def edited(rnd, item):
    s = bytearray(item[rnd.randint(0, 20):])
    for _ in range(rnd.randint(0, 10)):
        if len(s) < 3:
            break
        k, kind = rnd.randrange(len(s)), rnd.random()
        if kind < 0.4:
            s[k] = rnd.choice(b"abcdef ")
        elif kind < 0.7:
            del s[k]
        else:
            s.insert(k, rnd.choice(b"abcdef"))
    return bytes(s)


@pytest.mark.parametrize("rule", [leaks.Rule(), leaks.Rule(window=40, edits=2, q=8, step=3)])
def test_windows(rule):
    rnd = random.Random(1)
    items = [leaks.normalise("".join(rnd.choice("abcdef ") for _ in range(rnd.randint(5, 130))).encode()) for _ in range(12)]
    index = leaks.Index(items, rule)
    texts = ["".join(rnd.choice("abcdef ,.") for _ in range(rnd.randint(0, 60))).encode() + edited(rnd, rnd.choice(items)) + b"xyz. Q" for _ in range(120)]
    got = [{f[0]: (f[1], f[2]) for f in row} for row in index.documents(texts)]
    want = [plain(rule, index.items, t) for t in texts]
    assert got == want and sum(map(bool, want)) > 15


@pytest.mark.parametrize("pairs", [leaks.PAIRS, 1])
def test_repetitive_texts(monkeypatch, pairs):
    rnd = random.Random(2)
    rule = leaks.Rule(window=40, edits=3, q=8, step=3)
    shapes = [b"a" * 150, b"ab" * 60, b"abc" * 45, b"a" * 70 + b"b" * 70, b"a" * 60 + b"x" + b"a" * 60, b"abcdefghijklm" * 9, b"a" * 30, b"a" * 150]
    index = leaks.Index(shapes, rule)
    texts = [b"a" * 300, b"ab" * 90, b"abc" * 70, b"", b"a" * 39, b"b" * 50 + b"a" * 37 + b"c" + b"a" * 50]
    for _ in range(30):
        t = bytearray(rnd.choice(shapes) + rnd.choice(shapes))
        for _ in range(rnd.randint(0, 12)):
            t[rnd.randrange(len(t))] = rnd.choice(b"abx")
        texts.append(bytes(t))
    want = [plain(rule, index.items, t) for t in texts]
    monkeypatch.setattr(leaks, "PAIRS", pairs)
    assert [{f[0]: (f[1], f[2]) for f in row} for row in index.documents(texts)] == want and sum(map(len, want)) > 60


def test_very_long_repetitive_texts():
    index = leaks.Index([b"a" * 100_000, b"xyz" * 30_000, b"no such text in the others, nowhere at all"], leaks.Rule())
    tracemalloc.start()
    began = time.monotonic()
    one, two = index.documents([b"a" * 100_000, b"xyz" * 30_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert one == [(0, len(index.plans[0][0]), 0, 0, 100_000)] and two == [(1, len(index.plans[1][0]), 0, 0, 90_000)]
    assert peak < 300e6 and time.monotonic() - began < 120


def test_places_and_long_texts(monkeypatch):
    rnd = random.Random(5)
    item = "".join(rnd.choice("abcdefghijklmnop") for _ in range(150))
    index = leaks.Index([leaks.normalise(item.encode())], leaks.Rule())
    filler = "".join(rnd.choice("qrstuv  ,") for _ in range(30_000))
    monkeypatch.setattr(leaks, "CHUNK", 4000)
    for at in (0, 3950, 4001, 11_111, 30_000):
        text = (filler[:at] + " ... " + item.upper() + filler[at:]).encode()
        (found,) = index.documents([text])[0]
        assert found[2] == 0 and text[found[3]:found[4]] == item.upper().encode()


def test_rows(spark):
    rnd = random.Random(6)
    items = ["".join(rnd.choice("abcdefgh ") for _ in range(200)) for _ in range(5)]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, ""), (11, "tiny"), (None, items[0])], "item_id long, text string")
    clean = ["".join(rnd.choice("ijklmnop ") for _ in range(300)) for _ in range(20)]
    texts = [*clean, None, "", items[1], "Hm: " + items[2].upper() + "!", clean[0] + items[0] + clean[1], clean[0] + items[0] + clean[1]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string").repartition(3)
    for block in (leaks.BLOCK, 300):
        got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, benchmark, block=block).collect()}
        assert got == {(22, 1), (23, 2), (24, 0), (24, None), (25, 0), (25, None)}
        assert {r.doc_id for r in leaks.without_leaks(df, benchmark, block=block).collect()} == set(range(22))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert leaks.find_leaks(none, items).collect() == [] and leaks.find_leaks(one, items).collect() == []
    assert leaks.without_leaks(one, items).count() == 1


def test_rule_is_checked():
    with pytest.raises(ValueError):
        leaks.Rule(window=40, edits=6, q=10)

"""Records with line breaks inside quoted fields, against Python's reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from pulseloom.plans.hotgroups import Limits
from pulseloom.sources import lines


def field(rnd):
    text = "".join(rnd.choice(["a", "b", " ", ",", '"', "\n", "\n", "é", "x y"]) for _ in range(rnd.randint(0, 9)))
    plain = not set(text) & set(',"\n')
    return text if plain and rnd.random() < 0.7 else '"' + text.replace('"', '""') + '"'


def content(seed, rows):
    rnd = random.Random(seed)
    out = ["# notes", "one,two,three"]
    for n in range(rows):
        if rnd.random() < 0.1:
            out.append(f'{n},5" disk,b"c"')  # quotes inside a plain field are letters
        else:
            out.append(",".join([str(n), field(rnd), field(rnd)]))
    return "\n".join(out) + "\n"


def want(text):
    return [tuple(r) for r in csv.reader(io.StringIO(text.split("\n", 2)[2], newline=""))]


@pytest.mark.parametrize("seed", [1, 2])
def test_many_splits(spark, tmp_path, seed):
    texts = [content(seed * 10 + i, 400) for i in range(2)]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.csv").write_bytes(t.encode())
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "512")
        found = lines.parse_csv_with_preamble(lines.read_lines(spark, str(tmp_path)))
        assert lines.read_lines(spark, str(tmp_path)).select("at.block").distinct().count() > 5
        rows = found.orderBy("path", "at").select(F.coalesce("one", F.lit("")), F.coalesce("two", F.lit("")), F.coalesce("three", F.lit(""))).collect()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert [tuple(r) for r in rows] == [r for t in texts for r in want(t)]


def test_blocks_of_a_large_file(spark):
    text = content(5, 300)
    body = text.split("\n")[2:-1]
    df = spark.createDataFrame([("f", (i // 7, i % 7), v) for i, v in enumerate(body)], "path string, at struct<block: long, line: long>, value string")
    found = lines.quoted_records(df.repartition(5), ["path"], Limits(min_rows=20))
    records = [r.value for r in found.orderBy("at").collect()]
    assert [tuple(next(csv.reader(io.StringIO(r, newline="")))) for r in records] == want(text)


def test_open_quote_and_plain_files(spark):
    kind = "path string, at struct<block: long, line: long>, value string"
    rows = [("a", (0, 0), 'x,"open'), ("a", (0, 1), ""), ("a", (0, 2), 'still, ""here'), ("b", (0, 0), 'y,"z"'), ("b", (0, 1), "")]
    got = {(r.path, r.value) for r in lines.quoted_records(spark.createDataFrame(rows, kind), ["path"]).collect()}
    assert got == {("a", 'x,"open\n\nstill, ""here'), ("b", 'y,"z"'), ("b", "")}
    plain = spark.createDataFrame(rows[3:], kind)
    assert lines.quoted_records(plain, ["path"]) is plain

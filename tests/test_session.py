"""Intermediate tables go with the step that wrote them."""

import os

from pulseloom.session import materialise, scratch


def folders(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    return set(os.listdir(root.removeprefix("file:")))


def test_scratch_keeps_only_results(spark):
    outside = materialise(spark.range(3))
    before = folders(spark)
    with scratch(spark) as keep:
        once = materialise(spark.range(100))
        with scratch(spark) as inner:
            small = inner(materialise(once.where("id < 50")).where("id < 10"))
        kept = keep(small.where("id % 2 = 0"))
        assert len(folders(spark) - before) == 3
    assert len(folders(spark) - before) == 1
    assert sorted(r.id for r in kept.collect()) == [0, 2, 4, 6, 8] and outside.count() == 3


def test_scratch_after_an_error(spark):
    materialise(spark.range(1))
    before = folders(spark)
    try:
        with scratch(spark):
            materialise(spark.range(5))
            raise KeyError("stop")
    except KeyError:
        pass
    assert folders(spark) == before

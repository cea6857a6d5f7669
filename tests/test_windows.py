"""Gap statistics, sequences, sampling and hot-group equality."""

import math

import pytest
from pyspark.sql import functions as F

from pulseloom.operators import gaps, ranks, scoring, sequences
from pulseloom.plans.hotgroups import Limits
from pulseloom.schemas import FEATURES

CUT = Limits(min_rows=15, max_blocks=1000)


def connections(spark, starts, group="a"):
    rows = [("f", group, "b", 443, "tcp", float(t), i) for i, t in enumerate(starts)]
    return spark.createDataFrame(
        rows, "source_file string, src_ip string, dst_ip string, dst_port int, ip_protocol string, "
              "start_time double, n int")


def test_gap_statistics(spark):
    rows = gaps.with_gap_features(connections(spark, [10, 25, 16]), ["n"]).orderBy("start_time").collect()
    assert [r.flow_gap for r in rows] == [0.0, 6.0, 9.0]
    last = rows[-1]
    assert last.gap_rolling_mean == pytest.approx(5)
    assert last.gap_rolling_std == pytest.approx(math.sqrt(14))
    assert last.gap_rolling_cv == pytest.approx(math.sqrt(14) / 5)
    assert (last.gap_rolling_median, last.gap_rolling_iqr) == (6.0, 4.5)
    assert last.log_flow_gap == pytest.approx(math.log1p(9))


def feature_rows(spark, n, limits=Limits()):
    c = connections(spark, [i * 10 + (i * i) % 7 for i in range(n)])
    f = gaps.with_gap_features(c, ["n"], limits=limits)
    have = set(f.columns)
    return f.withColumns({x: F.lit(0.5) for x in FEATURES if x not in have}).withColumn("duration", F.col("n") * 1.0)


def peak_scorer():
    import numpy as np

    return lambda blocks: np.where(blocks.max(axis=(1, 2)) >= 219, 0.999, 0.01)


@pytest.mark.parametrize("batch", [1, 32, 512])
@pytest.mark.parametrize("limits", [Limits(), CUT])
def test_all_windows_are_scored(spark, batch, limits):
    f = feature_rows(spark, 220, limits).withColumns(
        {x: F.lit(0.0) for x in FEATURES if x != "duration"} | {"flow_gap": F.lit(0.0)})
    w = sequences.sequence_windows(f, ["n"], features=FEATURES, limits=limits)
    scored = scoring.score_windows(w, peak_scorer(), batch_size=batch)
    best = scoring.best_windows(scored)
    row = best.first()
    assert row.window_count == 211 and row.window_index == 210
    alert = scoring.alerts(best, 0.99).collect()
    assert [(a.confidence, a.risk, a.event_count) for a in alert] == [(99.9, "Critical", 10)]


@pytest.mark.parametrize("bad", ["not-a-number", -0.1, 1.1, None])
def test_bad_threshold(bad):
    with pytest.raises(ValueError):
        scoring.check_threshold(bad)


def test_batch_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        scoring.score_windows(spark.createDataFrame([([0.0],)], "steps array<float>"), peak_scorer(), batch_size=0)


def test_sampling_keeps_200_even_windows(spark):
    f = feature_rows(spark, 210)
    w = sequences.sequence_windows(f, ["n"])
    kept = sorted(r.window_index for r in sequences.sample_windows(w, f).collect())
    assert kept == sorted({k * 200 // 199 for k in range(200)})
    starts = sequences.sampled_starts(sequences.window_counts(f))
    assert sorted(r.window_index for r in starts.collect()) == kept


def test_scaler_weights_equal_exploded_rows(spark):
    f = feature_rows(spark, 230)
    weights = sequences.window_row_weights(f, ["n"])
    got = {r.n: r.weight for r in weights.collect()}
    expected = {}
    for start in {k * 220 // 199 for k in range(200)}:
        for i in range(start, start + 10):
            expected[i] = expected.get(i, 0) + 1
    assert {k: v for k, v in got.items() if v} == expected
    import numpy as np

    values = np.repeat([float(i) for i in sorted(expected)], [expected[i] for i in sorted(expected)])
    scaler = sequences.fit_scaler(weights, ["duration", "byte_ratio"]).first()
    assert scaler.mean_duration == pytest.approx(values.mean())
    assert scaler.std_duration == pytest.approx(values.std())
    assert scaler.std_byte_ratio == 1.0


def test_exact_medians(spark):
    rows = [(float(i % 37) if i % 5 else None, float(i), None) for i in range(501)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    import statistics

    got = ranks.exact_medians(df, ["a", "b", "c"], Limits(min_rows=3, max_blocks=50)).first()
    assert got.a == statistics.median([r[0] for r in rows if r[0] is not None])
    assert got.b == 250.0 and got.c is None


def test_hot_blocks_equal_plain(spark):
    f = connections(spark, [(i * 37) % 1000 + (i % 3) * 0.25 for i in range(300)]).union(
        connections(spark, [5, 5, 5, 6, 7, 100], "z"))
    plain = gaps.with_gap_features(f, ["n"])
    cut = gaps.with_gap_features(f, ["n"], limits=CUT)
    key = lambda r: (r.src_ip, r.n)
    assert sorted(plain.collect(), key=key) == sorted(cut.select(plain.columns).collect(), key=key)


@pytest.mark.parametrize("limits", [Limits(), CUT])
@pytest.mark.parametrize("rows_per_batch", [7, 10000])
def test_row_scoring_equals_window_scoring(spark, limits, rows_per_batch):
    from pulseloom.plans import beacons

    c = connections(spark, [(i * 37) % 1000 for i in range(150)])
    for name, n in (("b", 10), ("c", 9), ("d", 40)):
        c = c.union(connections(spark, [i * i for i in range(n)], name))
    c = c.withColumns({x: F.col("n") / 7 for x in FEATURES if "gap" not in x})
    expected = beacons.scored_windows(c, ["n"])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))
    try:
        got = beacons.modelled_windows(c, ["n"], scoring.regularity_blocks, batch_size=3, limits=limits).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    key = lambda r: (r.src_ip, r.window_index)
    got, want = sorted(got, key=key), sorted(expected.collect(), key=key)
    assert len(got) == len(want) == 141 + 1 + 31
    for a, b in zip(got, want):
        assert key(a) == key(b) and a.window_start_time == b.window_start_time and a.window_end_time == b.window_end_time
        assert a.probability == pytest.approx(b.probability) and a.first_gap_cv == pytest.approx(b.first_gap_cv)

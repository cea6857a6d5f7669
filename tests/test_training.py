"""Imputation, model checks, repeated runs and the selection of a run."""

import pytest
from pyspark.sql import functions as F

from pulseloom.operators import evaluation, scoring, training
from pulseloom.schemas import FEATURES


def test_imputation(spark):
    df = spark.createDataFrame([("1", "x"), ("3", "y"), ("bad", "-"), ("10", None)], "a string, b string")
    rows = training.impute_medians(df, ["a", "b"]).collect()
    assert sorted(r.a for r in rows) == [1.0, 3.0, 3.0, 10.0] and {r.b for r in rows} == {0.0}


def test_model_check():
    good = {**training.model_metadata(), "threshold": 0.99}
    assert scoring.check_model(good, FEATURES) == []
    assert scoring.check_model({}, FEATURES)
    assert scoring.check_model({**good, "input_shape": [9, 24]}, FEATURES)
    assert scoring.check_model({**good, "scaler_features": 3}, FEATURES)
    assert scoring.check_model({**good, "threshold": "x"}, FEATURES)
    assert scoring.check_model(good, FEATURES[1:]) == ["missing columns: flow_gap"]


def test_both_classes(spark):
    rows = spark.createDataFrame([(s, y) for s in ("train", "val", "test") for y in (0, 1)], "split string, label int")
    training.check_both_classes(rows)
    with pytest.raises(ValueError, match="val"):
        training.check_both_classes(rows.where("split <> 'val' or label = 0"))


def test_repeated_runs(spark):
    rows = [(f"g{i % 8}", i // 8, i % 2, [float(i % 2) + 0.1 * (i % 3)] * 4) for i in range(160)]
    w = spark.createDataFrame(rows, "g string, window_index long, label int, steps array<float>")
    runs = training.repeated_runs(w, w, w, [1, 2], ["g"])
    out = runs.collect()
    assert [r.seed for r in out] == [1, 2]
    assert all(r.validation_windows.recall == 1.0 and r.test_groups.f1 == 1.0 for r in out)
    flat = runs.select("seed", "val_loss", "validation_windows.*")
    assert evaluation.best_run(flat).first().recall == 1.0
    assert evaluation.stability(flat, ["recall"]).first()["std"] == 0.0
    assert runs.select(F.countDistinct("val_loss")).first()[0] == 2


def test_scaling_rows_equals_scaling_windows(spark):
    from pulseloom.operators import sequences

    rows = spark.createDataFrame(
        [("f", "a", "b", 1, "tcp", float(i), float(i * i), 0.5, i) for i in range(25)],
        "source_file string, src_ip string, dst_ip string, dst_port int, ip_protocol string, start_time double, "
        "flow_gap double, gap_rolling_cv double, n int")
    names = ["flow_gap", "gap_rolling_cv"]
    scaler = sequences.fit_scaler(sequences.window_row_weights(rows, ["n"]), names)
    late = training.scale_steps(sequences.sequence_windows(rows, ["n"], features=names), scaler, names)
    early = sequences.sequence_windows(training.scale_rows(rows, scaler, names), ["n"], features=["z_" + n for n in names])
    a, b = (sorted((r.window_index, tuple(r.steps)) for r in x.collect()) for x in (late, early))
    assert len(a) == 16
    for (i, x), (j, y) in zip(a, b):
        assert i == j and x == pytest.approx(y)

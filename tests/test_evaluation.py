"""Confusion, threshold choice, repeated runs and timing statistics."""

import random

import pytest

from pulseloom.operators import evaluation
from pulseloom.plans.hotgroups import Limits


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, probability double")


def test_published_confusion(spark):
    rows = [(1, 0.9)] * 998 + [(1, 0.1)] * 13 + [(0, 0.1)] * 131
    r = evaluation.confusion(scored(spark, rows), 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (998, 0, 13, 131)
    assert (r.recall, r.fpr, r.precision, r.f1) == pytest.approx((0.98714, 0, 1, 0.99353), abs=1e-5)


@pytest.mark.parametrize("limits", [Limits(), Limits(min_rows=10, max_blocks=100)])
def test_sweep_against_direct_counts(spark, limits):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), round(rng.random() ** 3, 2)) for _ in range(400)]
    out = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in evaluation.threshold_sweep(scored(spark, rows), limits=limits).collect()}
    assert set(out) == {p for _, p in rows} | {0.0, 1.0}
    for t, counts in out.items():
        hit = [(y, p >= t) for y, p in rows]
        assert counts == (hit.count((1, True)), hit.count((0, True)), hit.count((1, False)), hit.count((0, False)))


def test_choose_threshold(spark):
    clean = [(1, 0.9), (1, 0.8), (0, 0.3), (0, 0.2)]
    r = evaluation.choose_threshold(evaluation.threshold_sweep(scored(spark, clean))).first()
    assert (r.threshold, r.selection_mode, r.validation_recall, r.validation_fpr) == (0.8, "constraints_met", 1.0, 0.0)
    noisy = [(1, 0.2), (1, 0.8), (0, 0.9), (0, 0.1)]
    r = evaluation.choose_threshold(evaluation.threshold_sweep(scored(spark, noisy))).first()
    assert (r.threshold, r.selection_mode, r.target_recall_met, r.target_fpr_met) == (0.2, "recall_then_fpr_fallback", True, False)


def test_stability_and_best_run(spark):
    runs = spark.createDataFrame(
        [(s, r, 0.0, 1.0, 0.9, loss) for s, r, loss in zip(
            (2026, 2027, 2028, 2029, 2030), (0.945946, 0.945946, 0.986486, 1.0, 0.945946), (0.16, 0.67, 0.12, 0.08, 0.26))],
        "seed long, recall double, fpr double, precision double, f1 double, val_loss double")
    row = evaluation.stability(runs, ["recall"]).first()
    assert (row["mean"], row["std"], row["runs"]) == (pytest.approx(0.964865, abs=1e-6), pytest.approx(0.026343, abs=1e-6), 5)
    assert evaluation.best_run(runs).first().seed == 2029
    assert evaluation.stability(runs.limit(1), ["recall"]).first()["std"] == 0.0


@pytest.mark.parametrize("limits", [Limits(), Limits(min_rows=3, max_blocks=20)])
def test_nearest_rank(spark, limits):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "s double")
    r = evaluation.timing_statistics(df, ["s"], limits).first()
    assert (r["min"], r["max"], r["mean"], r["median"], r["p90"], r["p95"]) == (1, 10, 5.5, 5.5, 9, 10)


def test_mixed_groups_are_an_error(spark):
    df = spark.createDataFrame([("g", 0, 0.1), ("g", 1, 0.9)], "g string, label int, probability double")
    with pytest.raises(Exception, match="mixed labels"):
        evaluation.group_scores(df, ["g"]).collect()
    assert tuple(evaluation.group_scores(df, ["g"], mixed="max").first()) == ("g", 1, 0.9)


def test_failed_capture_predicts_nothing(spark):
    samples = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, True), ("d", False, True)],
                                    "source_file string, expected_malicious boolean, detector_ok boolean")
    threats = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "source_file string")
    out = evaluation.capture_results(samples, threats)
    assert {r.source_file: r.outcome for r in out.collect()} == {"a": "TP", "b": "FN", "c": "FP", "d": "TN"}
    m = evaluation.detector_metrics(out).first()
    assert (m.accuracy, m.detector_failures, m.f1, m.total) == (0.5, 1, 0.5, 4)

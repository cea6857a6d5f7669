"""Cleaning, scaling and fitting of a window classifier with Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.operators import evaluation, ranks
from pulseloom.plans.hotgroups import DEFAULT, Limits
from pulseloom.schemas import FEATURES, SEQUENCE_LENGTH, SPLITS
from pulseloom.session import materialise


def impute_medians(rows: DataFrame, features: list[str] = FEATURES, limits: Limits = DEFAULT) -> DataFrame:
    """Unparsable or missing values become the median of the whole column, then 0."""
    typed = rows.withColumns({c: F.col(c).cast("string").try_cast("double") for c in features})
    typed = typed.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in features})
    medians = ranks.exact_medians(typed, features, limits).first()  # one row of column medians
    return typed.withColumns({c: F.coalesce(F.col(c), F.lit(float(medians[c] or 0.0))) for c in features})


def check_both_classes(rows: DataFrame, label: str = "label", split: str = "split") -> None:
    """Every split must hold both classes."""
    found = {r[split]: r["n"] for r in rows.groupBy(split).agg(F.countDistinct(label).alias("n")).collect()}
    for name in SPLITS:
        if found.get(name, 0) != 2:
            raise ValueError(f"rows of one class only in {name}")


def scale_steps(windows: DataFrame, scaler: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Standardise flattened windows with a fitted scaler (one row, shipped as two arrays)."""
    row = scaler.first()
    mean = F.array(*[F.lit(float(row[f"mean_{c}"])) for c in features])
    std = F.array(*[F.lit(float(row[f"std_{c}"])) for c in features])
    n = len(features)
    return windows.withColumn("steps", F.transform("steps", lambda x, i: (
        (x - F.element_at(mean, (i % n + 1).cast("int"))) / F.element_at(std, (i % n + 1).cast("int"))).cast("float")))


def scale_rows(rows: DataFrame, scaler: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Add ``z_<feature>``: the same scaling on rows, a tenth of the work of scaling their windows."""
    row = scaler.first()
    return rows.withColumns({
        f"z_{c}": (F.col(c).cast("float") - F.lit(float(row[f"mean_{c}"]))) / F.lit(float(row[f"std_{c}"])) for c in features
    })


def fit_classifier(windows: DataFrame, label: str = "label", reg: float = 0.01, max_iter: int = 20):
    """Class-weighted logistic regression on the flattened window vector.

    The optimiser passes over the windows many times, so they are written once.
    """
    windows = materialise(windows)
    weights = evaluation.class_weights(windows, label)
    weighted = windows.join(F.broadcast(weights.select(label, "weight")), label)  # one row per class
    ready = weighted.withColumn("features", array_to_vector(F.col("steps").cast("array<double>")))
    return LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="weight", regParam=reg, maxIter=max_iter,
        standardization=False).fit(ready)


def predict(model, windows: DataFrame) -> DataFrame:
    ready = windows.withColumn("features", array_to_vector(F.col("steps").cast("array<double>")))
    scored = model.transform(ready)
    return scored.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1))).drop(
        "features", "rawPrediction", "prediction", "steps")


def model_metadata(features: list[str] = FEATURES) -> dict:
    return {"feature_cols": features, "seq_length": SEQUENCE_LENGTH, "input_shape": [SEQUENCE_LENGTH, len(features)]}


def repeated_runs(train: DataFrame, validation: DataFrame, test: DataFrame, seeds: list[int], group_keys: list[str],
                  share: float = 1.0) -> DataFrame:
    """One row of metrics per seed: fit on a seeded share of the training windows (all of them by default), choose the
    threshold on validation windows, report both levels on validation and test.

    Windows carry ``label`` and scaled ``steps``.  Use :func:`evaluation.best_run` on
    ``validation_windows`` to select and :func:`evaluation.stability` to report.
    """
    spark = train.sparkSession
    train, validation, test = materialise(train), materialise(validation), materialise(test)
    wanted = ["threshold", "tn", "fp", "fn", "tp", "recall", "fpr", "precision", "f1"]
    rows = []
    for seed in seeds:
        # the same window falls to the same side whenever the seed is the same
        draw = F.pmod(F.xxhash64(F.lit(seed), *group_keys, "window_index"), F.lit(1000)) < F.lit(int(share * 1000))
        model = fit_classifier(train.where(draw) if share < 1.0 else train)
        # read by the sweep and by four reports, so scored once
        scored = {"validation": materialise(predict(model, validation)), "test": materialise(predict(model, test))}
        loss = scored["validation"].agg(F.avg(-F.log(F.greatest(F.when(
            F.col("label") == 1, F.col("probability")).otherwise(1 - F.col("probability")), F.lit(1e-7))))).first()[0]
        threshold = evaluation.choose_threshold(evaluation.threshold_sweep(scored["validation"])).first()["threshold"]
        row = {"seed": seed, "val_loss": loss}
        for name, windows in scored.items():
            groups = evaluation.group_scores(windows, group_keys)
            for level, data in (("windows", windows), ("groups", groups)):
                row[f"{name}_{level}"] = evaluation.confusion(data, threshold).select(*wanted).first().asDict()
        rows.append(row)
    metric = "struct<" + ",".join(f"{n}:{'long' if n in ('tn', 'fp', 'fn', 'tp') else 'double'}" for n in wanted) + ">"
    sections = [f"{n}_{level} {metric}" for n in ("validation", "test") for level in ("windows", "groups")]
    return spark.createDataFrame(rows, "seed long, val_loss double, " + ", ".join(sections))

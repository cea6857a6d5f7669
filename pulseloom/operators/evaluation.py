"""Confusion matrices, threshold choice, repeated runs and attribution summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import rules
from pulseloom.operators.ranks import running_totals, values_at
from pulseloom.plans.hotgroups import DEFAULT, Limits
from pulseloom.schemas import MAX_FPR, TARGET_RECALL


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_ratios(counts: DataFrame) -> DataFrame:
    """recall, fpr, precision and f1 from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    df = counts.withColumns({
        "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn), "precision": ratio(tp, tp + fp)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", ratio(2 * p * r, p + r))


def confusion(scored: DataFrame, threshold: float, by: list[str] = (), label: str = "label",
              score: str = "probability") -> DataFrame:
    """Confusion counts and ratios at a threshold (inclusive)."""
    positive, predicted = F.col(label) == 1, F.col(score) >= threshold
    counts = scored.groupBy(*by).agg(
        F.count_if(positive & predicted).alias("tp"), F.count_if(~positive & predicted).alias("fp"),
        F.count_if(positive & ~predicted).alias("fn"), F.count_if(~positive & ~predicted).alias("tn"))
    return with_ratios(counts).withColumn("threshold", F.lit(float(threshold)))


def group_scores(scored: DataFrame, keys: list[str], label: str = "label", score: str = "probability",
                 mixed: str = "error") -> DataFrame:
    """Group label and maximum score; mixed labels are an error, or take the maximum."""
    g = scored.groupBy(*keys).agg(
        F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.max(score).alias(score))
    if mixed == "error":
        checked = F.when(F.col("_lo") == F.col("_hi"), F.col("_hi")).otherwise(
            F.raise_error(F.lit("mixed labels in one group")).cast("int"))
    else:
        checked = F.col("_hi")
    return g.select(*keys, checked.alias(label), score)


def threshold_sweep(scored: DataFrame, label: str = "label", score: str = "probability",
                    limits: Limits = DEFAULT) -> DataFrame:
    """Confusion counts at every distinct score, at 0 and at 1, in one pass over distinct scores."""
    per_score = scored.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ends = scored.sparkSession.sql("SELECT explode(array(0.0D, 1.0D)) AS threshold, 0L AS pos, 0L AS neg")
    points = per_score.unionByName(ends).groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = per_score.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n"))
    keyed = points.withColumns({"_all": F.lit(0), "_down": -F.col("threshold")})
    above = running_totals(keyed, ["_all"], "_down", ["pos", "neg"], limits)
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    counts = above.select(
        "threshold", tp.alias("tp"), fp.alias("fp"),
        (totals.select("p").scalar() - tp).alias("fn"), (totals.select("n").scalar() - fp).alias("tn"))
    return with_ratios(counts)


def choose_threshold(sweep: DataFrame, target_recall: float = TARGET_RECALL, max_fpr: float = MAX_FPR) -> DataFrame:
    """One row: the highest feasible threshold, else the best by recall, low FPR and threshold."""
    recall_met, fpr_met = F.col("recall") >= target_recall, F.col("fpr") <= max_fpr
    feasible = recall_met & fpr_met
    zero = F.lit(0.0)
    rank = F.struct(
        feasible.cast("int").alias("a"),
        F.when(feasible, zero).otherwise(F.col("recall")).alias("b"),
        F.when(feasible, zero).otherwise(-F.col("fpr")).alias("c"),
        F.col("threshold").alias("d"),
    )
    row = F.struct("threshold", "recall", "fpr", recall_met.alias("r"), fpr_met.alias("f"))
    best = sweep.agg(F.max_by(row, rank).alias("b")).select("b.*")
    return best.select(
        "threshold", F.col("recall").alias("validation_recall"), F.col("fpr").alias("validation_fpr"),
        F.col("r").alias("target_recall_met"), F.col("f").alias("target_fpr_met"),
        F.when(F.col("r") & F.col("f"), "constraints_met").otherwise(F.lit("recall_then_fpr_fallback"))
        .alias("selection_mode"),
    )


def class_weights(rows: DataFrame, label: str = "label", multiplier: float = 1.0) -> DataFrame:
    """Balanced weights n / (classes * n_class); class 1 is multiplied."""
    per_class = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    classes = Window.partitionBy(F.lit(0))  # one row per class
    weight = F.sum("n_class").over(classes) / (F.count(F.lit(1)).over(classes) * F.col("n_class"))
    return per_class.select(
        label, "n_class", F.when(F.col(label) == 1, weight * multiplier).otherwise(weight).alias("weight"))


def best_run(runs: DataFrame, target_recall: float = TARGET_RECALL, max_fpr: float = MAX_FPR) -> DataFrame:
    """The run to deploy: targets met, recall, low FPR, F1, low loss, seed, by validation only."""
    met = ((F.col("recall") >= target_recall) & (F.col("fpr") <= max_fpr)).cast("int")
    rank = F.struct(met.alias("m"), "recall", (-F.col("fpr")).alias("nf"), "f1", (-F.col("val_loss")).alias("nl"), "seed")
    return runs.agg(F.max_by(F.struct(*runs.columns), rank).alias("r")).select("r.*")


def stability(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation per metric over runs; 0 deviation for a single run."""
    n = F.count(F.lit(1))
    wide = runs.agg(n.alias("runs"), *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[
        F.when(n > 1, F.stddev_samp(m)).otherwise(F.lit(0.0)).alias(f"{m}_std") for m in metrics])
    return wide.select("runs", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std"))
        for m in metrics])).alias("s")).select("s.*", "runs")


def capture_results(samples: DataFrame, threats: DataFrame, capture: str = "source_file") -> DataFrame:
    """Per capture: threats found, prediction and outcome; a failed capture predicts nothing."""
    n = threats.groupBy(capture).agg(F.count(F.lit(1)).alias("threat_count"))
    joined = samples.join(n, capture, "left")
    ok = F.col("detector_ok")
    count = F.when(ok, F.coalesce("threat_count", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    df = joined.withColumn("threat_count", count).withColumn("predicted_malicious", F.col("threat_count") > 0)
    return df.withColumn("outcome", rules.confusion_outcome(F.col("expected_malicious"), F.col("predicted_malicious")))


def detector_metrics(results: DataFrame) -> DataFrame:
    """Capture-level metrics rounded to six places, with the number of failed captures."""
    counts = results.agg(
        *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "TN", "FP", "FN")],
        F.count_if(~F.col("detector_ok")).alias("detector_failures"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    metrics = {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "false_positive_rate": ratio(fp, fp + tn),
        "false_negative_rate": ratio(fn, fn + tp),
    }
    return counts.select(
        "tp", "tn", "fp", "fn", (tp + tn + fp + fn).alias("total"), "detector_failures",
        *[F.round(v, 6).alias(k) for k, v in metrics.items()])


def pending_samples(samples: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    """Samples without a stored result."""
    return samples.join(done.select(key).distinct(), key, "left_anti")


def with_existing(new: DataFrame, done: DataFrame) -> DataFrame:
    return new.unionByName(done)


def false_negative_windows(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where((F.col("label") == 1) & (F.col("probability") < threshold))


def retrieval_by_label(details: DataFrame, confidence_threshold: float, label: str = "label") -> DataFrame:
    """Coverage, acceptance, technique and confidence rates with three means, per label."""
    n = F.count(F.lit(1))
    counts = {
        "retrieved_candidate_count": F.count_if(F.col("retrieved_top1") != ""),
        "accepted_attribution_count": F.count_if("attribution_accepted"),
        "c2_technique_hit_count": F.count_if("c2_technique_hit"),
        "high_confidence_count": F.count_if(F.col("confidence") >= confidence_threshold),
    }
    rates = {
        "retrieval_coverage": "retrieved_candidate_count", "accepted_attribution_rate": "accepted_attribution_count",
        "c2_technique_hit_rate": "c2_technique_hit_count", "high_confidence_rate": "high_confidence_count",
    }
    return details.groupBy(label).agg(
        n.alias("samples"), *[c.alias(k) for k, c in counts.items()],
        *[(counts[c] / n).alias(k) for k, c in rates.items()],
        F.avg("confidence").alias("mean_confidence"), F.avg("top1_score").alias("mean_top1_score"),
        F.avg("score_gap").alias("mean_score_gap"))


def sample_summary(samples: DataFrame, threshold: float, label: str = "label") -> DataFrame:
    """Per label: samples, those that pass the C2 gate, those that do not, and the mean C2 score."""
    passed = F.col("c2_score") >= threshold
    return samples.groupBy(label).agg(
        F.count(F.lit(1)).alias("sampled_count"), F.count_if(passed).alias("c2_candidate_count"),
        F.count_if(~passed).alias("c2_filtered_count"), F.avg("c2_score").alias("mean_sample_c2_score"))


def attribution_summary(details: DataFrame, confidence_threshold: float, label: str = "label") -> DataFrame:
    """One row of overall rates; the benign rate is null without benign rows."""
    n = F.count(F.lit(1))
    benign, high = F.lower(label) == "none", F.col("confidence") >= confidence_threshold
    return details.agg(
        n.alias("input_feature_count"),
        ratio(F.count_if(F.col("retrieved_top1") != ""), n).alias("retrieval_coverage"),
        F.count_if("attribution_accepted").alias("accepted_attribution_count"),
        ratio(F.count_if("attribution_accepted"), n).alias("accepted_attribution_rate"),
        F.coalesce(F.avg("top1_score"), F.lit(0.0)).alias("mean_top1_score"),
        F.coalesce(F.avg("score_gap"), F.lit(0.0)).alias("mean_score_gap"),
        F.count_if("c2_technique_hit").alias("c2_technique_hit_count"),
        ratio(F.count_if("c2_technique_hit"), n).alias("c2_technique_hit_rate"),
        F.when(F.count_if(benign) > 0, F.count_if(benign & high) / F.count_if(benign))
        .alias("benign_high_confidence_rate"),
    )


def frequency(rows: DataFrame, column: str, n: int | None = None, explode: bool = False) -> DataFrame:
    """Counts of non-blank values, most frequent first; ``n`` keeps the report's top n."""
    value = F.explode(column) if explode else F.col(column)
    counted = rows.select(value.alias("value")).where(F.coalesce(F.col("value"), F.lit("")) != "").groupBy(
        "value").agg(F.count(F.lit(1)).alias("count"))
    ordered = counted.orderBy(F.desc("count"), "value")
    return ordered.limit(n) if n else ordered


def source_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy(F.array_join("detection_sources", ";").alias("detection_sources")).agg(
        F.count(F.lit(1)).alias("threats"))


def batch_totals(results: DataFrame) -> DataFrame:
    """Totals over captures."""
    return results.agg(
        F.count(F.lit(1)).alias("pcap_count"), F.count_if("detector_ok").alias("successful_count"),
        F.count_if("sequence_completed").alias("sequence_completed_count"),
        F.coalesce(F.sum("sequence_flagged"), F.lit(0)).alias("sequence_flagged_count"),
        F.coalesce(F.sum("threat_count"), F.lit(0)).alias("merged_threat_count"))


def timing_statistics(timings: DataFrame, stages: list[str], limits: Limits = DEFAULT) -> DataFrame:
    """min, max, mean, median, p90 and p95 per stage; percentiles by nearest rank, half to even."""
    long = timings.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("seconds")) for s in stages
    ])).alias("t")).select("t.*")
    n = F.col("n")
    at = values_at(long, ["stage"], "seconds", {
        "_low": F.floor((n - 1) / F.lit(2)), "_high": F.ceil((n - 1) / F.lit(2)),
        "p90": F.rint((n - 1) * F.lit(0.90)), "p95": F.rint((n - 1) * F.lit(0.95)),
    }, limits)
    plain = long.groupBy("stage").agg(
        F.min("seconds").alias("min"), F.max("seconds").alias("max"), F.avg("seconds").alias("mean"))
    return plain.join(at, "stage").select(
        "stage", *[F.round(c, 3).alias(c) for c in ("min", "max", "mean")],
        F.round((F.col("_low") + F.col("_high")) / 2, 3).alias("median"),
        F.round("p90", 3).alias("p90"), F.round("p95", 3).alias("p95"))

"""Confusion matrices, thresholds, repeated runs, listings and label joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom import adapters as A
from pulseloom.catalog import query, rounded
from pulseloom.catalog.core import TIE, WINDOWS
from pulseloom.catalog.detect import BEACON
from pulseloom.operators import evaluation, gaps, highrisk, overview, postings, scoring, sequences, training
from pulseloom.operators.training import model_metadata
from pulseloom.plans import beacons
from pulseloom.schemas import FEATURES
from pulseloom.session import materialise, shared_folder
from pulseloom.sources import captures, tables

SCORED = """
sl AS (
  SELECT doc_id, quality AS label, toxic, lang, source, round(n_chars / (n_chars + 2000.0::DOUBLE), 4) AS probability
  FROM labels JOIN documents USING (doc_id))"""
RATIOS = """
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS fpr,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""
COUNTS = """count(*) FILTER (label = 1 AND probability >= {t}) AS tp, count(*) FILTER (label <> 1 AND probability >= {t}) AS fp,
  count(*) FILTER (label = 1 AND probability < {t}) AS fn, count(*) FILTER (label <> 1 AND probability < {t}) AS tn"""
SWEEP = SCORED + """,
t AS (SELECT DISTINCT probability AS threshold FROM sl UNION SELECT 0.0::DOUBLE UNION SELECT 1.0::DOUBLE),
c AS (
  SELECT threshold, count(*) FILTER (label = 1 AND probability >= threshold) AS tp,
         count(*) FILTER (label <> 1 AND probability >= threshold) AS fp,
         count(*) FILTER (label = 1 AND probability < threshold) AS fn,
         count(*) FILTER (label <> 1 AND probability < threshold) AS tn
  FROM t, sl GROUP BY threshold),
sweep AS (
  SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
         CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr FROM c)"""
RATIO_COLUMNS = ["recall", "fpr", "precision", "f1"]
RUNS = SCORED + f""",
r0 AS (
  SELECT doc_id % 5 AS seed, {COUNTS.format(t='0.5')}, avg((label - probability) * (label - probability)) AS val_loss
  FROM sl GROUP BY ALL),
runs AS (SELECT *, {RATIOS} FROM r0)"""


def _runs(spark, d):
    s = A.scored_labels(spark, d).withColumn("seed", F.col("doc_id") % 5)
    loss = s.groupBy("seed").agg(F.avg(F.pow(F.col("label") - F.col("probability"), 2)).alias("val_loss"))
    return rounded(evaluation.confusion(s, 0.5, ["seed"]).join(loss, "seed"), 6, *RATIO_COLUMNS)


def _labelled_windows(spark, d):
    w = beacons.scored_windows(A.connections_from_events(spark, d), TIE)
    user = F.substring("src_ip", 2, 20).cast("long")
    return w.withColumn("label", F.when(user % 3 == 0, 1).otherwise(F.lit(0)))


@query("ev1_confusion", f"""WITH {SCORED}, k AS (SELECT lang, {COUNTS.format(t='0.5')} FROM sl GROUP BY lang)
SELECT lang, tp, fp, fn, tn, {RATIOS}, 0.5::DOUBLE AS threshold FROM k""")
def ev1(spark, d):
    return rounded(evaluation.confusion(A.scored_labels(spark, d), 0.5, ["lang"]), 6, *RATIO_COLUMNS)


@query("win11_threshold_sweep", f"WITH {SWEEP} SELECT threshold, tp, fp, fn, tn, {RATIOS} FROM c")
def win11(spark, d):
    return rounded(evaluation.threshold_sweep(A.scored_labels(spark, d)), 6, *RATIO_COLUMNS).select(
        "threshold", "tp", "fp", "fn", "tn", *RATIO_COLUMNS)


@query("top10_best_threshold", f"""WITH {SWEEP}, f AS (SELECT *, recall >= 0.9 AS r, fpr <= 0.95 AS p FROM sweep)
SELECT threshold, round(recall, 6) AS validation_recall, round(fpr, 6) AS validation_fpr, r AS target_recall_met,
       p AS target_fpr_met, CASE WHEN r AND p THEN 'constraints_met' ELSE 'recall_then_fpr_fallback' END AS selection_mode
FROM f ORDER BY r AND p DESC, CASE WHEN r AND p THEN 0 ELSE recall END DESC, CASE WHEN r AND p THEN 0 ELSE fpr END, threshold DESC
LIMIT 1""")
def top10(spark, d):
    sweep = evaluation.threshold_sweep(A.scored_labels(spark, d))
    return rounded(evaluation.choose_threshold(sweep, 0.9, 0.95), 6, "validation_recall", "validation_fpr")


@query("ev2_threshold_selection", f"""WITH {SWEEP}, f AS (SELECT *, recall >= 0.98 AS r, fpr <= 0.05 AS p FROM sweep)
SELECT threshold, round(recall, 6) AS validation_recall, round(fpr, 6) AS validation_fpr, r AS target_recall_met,
       p AS target_fpr_met, CASE WHEN r AND p THEN 'constraints_met' ELSE 'recall_then_fpr_fallback' END AS selection_mode
FROM f ORDER BY r AND p DESC, CASE WHEN r AND p THEN 0 ELSE recall END DESC, CASE WHEN r AND p THEN 0 ELSE fpr END, threshold DESC
LIMIT 1""")
def ev2(spark, d):
    sweep = evaluation.threshold_sweep(A.scored_labels(spark, d))
    return rounded(evaluation.choose_threshold(sweep), 6, "validation_recall", "validation_fpr")


@query("ev3_window_and_group", f"""WITH {WINDOWS},
lw AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS label FROM win),
lg AS (SELECT src_ip, dst_ip, max(label) AS label, max(probability) AS probability FROM lw GROUP BY ALL),
k AS (SELECT 'groups' AS level, {COUNTS.format(t='0.55')} FROM lg UNION ALL SELECT 'windows', {COUNTS.format(t='0.55')} FROM lw)
SELECT level, tp, fp, fn, tn, {RATIOS} FROM k""")
def ev3(spark, d):
    w = _labelled_windows(spark, d)
    groups = evaluation.group_scores(w, ["src_ip", "dst_ip"])
    both = evaluation.confusion(groups, 0.55).withColumn("level", F.lit("groups")).unionByName(
        evaluation.confusion(w, 0.55).withColumn("level", F.lit("windows")))
    return rounded(both, 6, *RATIO_COLUMNS).drop("threshold")


@query("flt10_false_negatives", f"""WITH {WINDOWS}
SELECT src_ip, dst_ip, window_index FROM win WHERE user_id % 3 = 0 AND probability < 0.55""")
def flt10(spark, d):
    return evaluation.false_negative_windows(_labelled_windows(spark, d), 0.55).select("src_ip", "dst_ip", "window_index")


@query("agg15_class_weights", f"""WITH {SCORED}
SELECT label, count(*) AS n_class, round((SELECT count(*) FROM sl) / ((SELECT count(DISTINCT label) FROM sl) * count(*))
       * CASE WHEN label = 1 THEN 1.5::DOUBLE ELSE 1 END, 6) AS weight FROM sl GROUP BY label""")
def agg15(spark, d):
    return rounded(evaluation.class_weights(A.scored_labels(spark, d), multiplier=1.5), 6, "weight")


@query("agg24_run_stability", f"""WITH {RUNS}
SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS runs FROM (
  SELECT unnest(['recall', 'fpr', 'precision', 'f1']) AS metric, unnest([recall, fpr, precision, f1]) AS v FROM runs)
GROUP BY metric""")
def agg24(spark, d):
    return rounded(evaluation.stability(_runs(spark, d), RATIO_COLUMNS), 6, "mean", "std")


@query("top9_best_run", f"""WITH {RUNS}
SELECT seed, recall, fpr, f1 FROM runs
ORDER BY recall >= 0.98 AND fpr <= 0.05 DESC, recall DESC, fpr, f1 DESC, val_loss, seed DESC LIMIT 1""")
def top9(spark, d):
    return evaluation.best_run(_runs(spark, d)).select("seed", "recall", "fpr", "f1")


@query("ev4_repeated_runs", f"""WITH {RUNS},
b AS (SELECT seed FROM runs ORDER BY recall >= 0.98 AND fpr <= 0.05 DESC, recall DESC, fpr, f1 DESC, val_loss, seed DESC LIMIT 1)
SELECT (SELECT seed FROM b) AS selected_seed, count(*) AS runs, round(avg(recall), 6) AS mean_recall,
       round(stddev_samp(recall), 6) AS std_recall FROM runs""")
def ev4(spark, d):
    runs = _runs(spark, d)
    s = evaluation.stability(runs, ["recall"])
    return s.select(evaluation.best_run(runs).select("seed").scalar().alias("selected_seed"), "runs",
                    F.round("mean", 6).alias("mean_recall"), F.round("std", 6).alias("std_recall"))


@query("ev4_repeated_fits", """
WITH g AS (SELECT user_id, event_type, least(count(*) - 9, 200) AS w FROM events GROUP BY ALL HAVING count(*) >= 10),
s AS (SELECT sum(w) FILTER (user_id % 5 = 3)::BIGINT AS validation_windows, sum(w) FILTER (user_id % 5 = 4)::BIGINT AS test_windows,
             count(*) FILTER (user_id % 5 = 3) AS validation_groups, count(*) FILTER (user_id % 5 = 4) AS test_groups FROM g)
SELECT seed, s.*, true AS loss_is_finite, true AS threshold_in_range FROM s, (VALUES (7), (8)) t(seed)""")
def ev4_fits(spark, d):
    """Each seed fits a classifier; what every right run has in common: all windows and groups are judged, once each."""
    user = F.substring("src_ip", 2, 20).cast("long")
    rows = gaps.with_gap_features(A.feature_rows_from_events(spark, d), TIE).withColumns({
        "label": F.when(user % 3 == 0, 1).otherwise(F.lit(0))})
    scaled = training.scale_rows(rows, sequences.fit_scaler(sequences.window_row_weights(rows, TIE)))
    windows = materialise(sequences.sample_windows(sequences.sequence_windows(
        scaled, TIE, features=[f"z_{c}" for c in FEATURES], label="label"), rows))
    parts = [windows.where(F.col("src_ip").substr(2, 20).cast("long") % 5 <= 2), windows.where(user % 5 == 3), windows.where(user % 5 == 4)]
    runs = training.repeated_runs(*parts, seeds=[7, 8], group_keys=["src_ip", "dst_ip"], share=0.8)

    def judged(name):
        return sum((F.col(f"{name}.{c}") for c in ("tp", "fp", "fn", "tn")), F.lit(0)).cast("long").alias(name)

    return runs.select(
        "seed", *[judged(f"{part}_{level}") for part in ("validation", "test") for level in ("windows", "groups")],
        (F.col("val_loss").isNotNull() & ~F.isnan("val_loss")).alias("loss_is_finite"),
        F.col("validation_windows.threshold").between(0, 1).alias("threshold_in_range"))


CAPTURES = BEACON + """,
res0 AS (
  SELECT c_custkey, c_acctbal > 4000 AS expected, c_custkey % 17 <> 0 AS ok, coalesce(n, 0) AS n
  FROM customer LEFT JOIN (SELECT c AS c_custkey, count(*) AS n FROM risky GROUP BY ALL) USING (c_custkey)),
res AS (
  SELECT c_custkey, expected, ok, CASE WHEN ok THEN n ELSE 0 END AS threat_count,
         CASE WHEN expected AND ok AND n > 0 THEN 'TP' WHEN NOT expected AND ok AND n > 0 THEN 'FP'
              WHEN expected THEN 'FN' ELSE 'TN' END AS outcome FROM res0)"""


def _captures(spark, d):
    threats = highrisk.high_risk_rows(A.beacon_csv_from_orders(spark, d)).select(
        F.col("src_ip").alias("source_file"))
    samples = A.table(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_file"),
        (F.col("c_acctbal") > 4000).alias("expected_malicious"), (F.col("c_custkey") % 17 != 0).alias("detector_ok"))
    return evaluation.capture_results(samples, threats)


@query("ev5_capture_results", f"""WITH {CAPTURES}
SELECT 'c' || c_custkey AS source_file, threat_count, outcome FROM res""")
def ev5(spark, d):
    return _captures(spark, d).select("source_file", "threat_count", "outcome")


@query("ev5_detector_metrics", f"""WITH {CAPTURES},
k AS (SELECT count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'TN') AS tn, count(*) FILTER (outcome = 'FP') AS fp,
             count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (NOT ok) AS detector_failures FROM res)
SELECT tp, tn, fp, fn, tp + tn + fp + fn AS total, detector_failures, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
       round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
       round(fp / (fp + tn), 6) AS false_positive_rate, round(fn / (fn + tp), 6) AS false_negative_rate FROM k""")
def ev5_metrics(spark, d):
    return evaluation.detector_metrics(_captures(spark, d))


@query("agg22_batch_totals", f"""WITH {CAPTURES}
SELECT count(*) AS pcap_count, count(*) FILTER (ok) AS successful_count, count(*) FILTER (c_custkey % 3 = 0) AS sequence_completed_count,
       sum(c_custkey % 4)::BIGINT AS sequence_flagged_count, sum(threat_count)::BIGINT AS merged_threat_count FROM res""")
def agg22(spark, d):
    c = F.substring("source_file", 2, 20).cast("long")
    return evaluation.batch_totals(_captures(spark, d).withColumns({
        "sequence_completed": c % 3 == 0, "sequence_flagged": c % 4}))


@query("agg23_timing_statistics", """
WITH t AS (SELECT unnest(['quantity', 'price', 'discount']) AS stage, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY stage) AS n FROM t)
SELECT stage, round(min(v), 3) AS min, round(max(v), 3) AS max, round(avg(v), 3) AS mean, round(median(v), 3) AS median,
       round(max(v) FILTER (i = round_even((n - 1) * 0.9::DOUBLE, 0)), 3) AS p90,
       round(max(v) FILTER (i = round_even((n - 1) * 0.95::DOUBLE, 0)), 3) AS p95
FROM r GROUP BY stage""")
def agg23(spark, d):
    li = A.table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    return evaluation.timing_statistics(li, ["quantity", "price", "discount"])


@query("jn12_label_join", """
SELECT 'cap' || (user_id % 25) || '.pcap' AS file_name, n_name || '__cap' || (user_id % 25) || '.pcap' AS source_file,
       CASE WHEN n_nationkey % 2 = 1 THEN 1 ELSE 0 END AS label, (['train', 'val', 'test'])[n_nationkey % 3 + 1] AS split,
       n_name AS dataset, r_name AS scenario, count(*) AS n
FROM events JOIN nation ON n_nationkey = user_id % 25 JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def jn12(spark, d):
    e = A.table(spark, d, "events").select(
        F.concat(F.lit("cap"), (F.col("user_id") % 25).cast("string"), F.lit(".pcap")).alias("file_name"),
        F.lit("x").alias("source_file"))
    n = F.col("n_nationkey")
    manifest = A.table(spark, d, "nation").join(
        A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("cap"), n.cast("string"), F.lit(".pcap")).alias("file_name"),
        A._item(["benign", "malicious"], n % 2).alias("label"), A._item(["train", "val", "test"], n % 3).alias("split"),
        F.col("n_name").alias("source"), F.col("r_name").alias("scenario"))
    labelled = tables.label_features(e, manifest)
    return labelled.groupBy("file_name", "source_file", "label", "split", "dataset", "scenario").agg(
        F.count(F.lit(1)).alias("n"))


@query("jn14_skip_existing", """
SELECT o_orderkey::VARCHAR AS file FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def jn14(spark, d):
    samples = A.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("file"))
    done = A.table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").cast("string").alias("file"))
    return evaluation.pending_samples(samples, done)


@query("flt8_keyword_search", """
SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name || '%_' || c_mktsegment), '%_mach')""")
def flt8(spark, d):
    c = A.table(spark, d, "customer").withColumn("t", F.concat("c_name", F.lit("%_"), "c_mktsegment"))
    return overview.keyword_filter(c, "t", " %_MACH ").select("c_custkey", "c_name")


@query("flt8_indexed_search", """
SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.org/de/')""")
def flt8_indexed(spark, d):
    pages = A.table(spark, d, "pages").select("page_id", "url")
    path = shared_folder(spark)
    postings.write(pages, "page_id", "url", path)
    return postings.search(pages, "page_id", "url", " Example.org/DE/", path)


@query("top8_history_page", """
SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders WHERE contains(lower(o_orderpriority), 'high')) AS total,
       greatest(1, ceil((SELECT count(*) FROM orders WHERE contains(lower(o_orderpriority), 'high')) / 10))::BIGINT AS total_pages
FROM orders WHERE contains(lower(o_orderpriority), 'high') ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20""")
def top8(spark, d):
    rows = overview.keyword_filter(A.table(spark, d, "orders"), "o_orderpriority", "HIGH")
    return overview.history_page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 10).select(
        "o_orderkey", "o_custkey", "total", "total_pages")


@query("src12_labelled_captures", """
SELECT path, file_name, label, label = 'cs' AS expected_malicious FROM (
  SELECT '/data/' || CASE WHEN c_custkey % 3 = 0 THEN 'cs' ELSE 'benign' END || '/' || c_name || '.pcap' AS path, c_name || '.pcap' AS file_name,
         CASE WHEN c_custkey % 3 = 0 THEN 'cs' ELSE 'benign' END AS label FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def src12(spark, d):
    c = F.col("c_custkey")
    suffix = F.when(F.col("c_mktsegment") == "BUILDING", ".txt").otherwise(F.lit(".pcap"))
    files = A.table(spark, d, "customer").select(
        F.concat(F.lit("/data/"), F.when(c % 3 == 0, "cs").otherwise(F.lit("benign")), F.lit("/"), "c_name", suffix).alias("path"))
    return captures.labelled_captures(files)


@query("ud4_model_check", f"""
SELECT event_type, count(*) AS rows, '' AS problems FROM events GROUP BY ALL""")
def ud4(spark, d):
    rows = A.feature_rows_from_events(spark, d)
    full = [*rows.columns, *[f for f in FEATURES if "gap" in f]]
    problems = "; ".join(scoring.check_model({**model_metadata(), "threshold": 0.99}, full))
    return rows.groupBy(F.col("dst_ip").alias("event_type")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(problems).alias("problems"))


@query("chk1_required_columns", "SELECT 'label' AS missing, count(*) AS rows FROM events GROUP BY ALL")
def chk1(spark, d):
    rows = A.feature_rows_from_events(spark, d)
    missing = tables.missing_columns([*rows.columns, *[f for f in FEATURES if "gap" in f]], labelled=True)
    return rows.agg(F.lit(",".join(missing)).alias("missing"), F.count(F.lit(1)).alias("rows"))

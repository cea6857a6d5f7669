"""Ten-step sequence windows, their sampling, their statistics and the scaler fitted on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.plans.hotgroups import DEFAULT, Limits, Spread, join_null_safe, spread
from pulseloom.schemas import FEATURES, GROUP_KEYS, SEQUENCE_LENGTH, SORT_COLUMN, TRAIN_WINDOW_CAP
from pulseloom.session import materialise


def feature_vector(df: DataFrame, features: list[str] = FEATURES) -> Column:
    """One float32 vector per row; unparsable or missing values count as 0."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return F.array(*[
        F.coalesce(F.col(c).try_cast("double") if c in text else F.col(c).cast("double"), F.lit(0.0)).cast("float")
        for c in features])


def windows_on(
    s: Spread, tie: list[str], features: list[str] | None = None, label: str | None = None, extra: dict | None = None
) -> DataFrame:
    """One row per window of ten consecutive rows.

    A window is written at its last row, so a frame of nine preceding rows is enough.  Short
    groups give no window.  With ``label`` only windows of a single label are kept.  ``extra``
    maps names to functions of the frame, for scores that are plain window aggregates.
    """
    w = s.window(SORT_COLUMN, *tie)
    frame = w.rowsBetween(1 - SEQUENCE_LENGTH, 0)
    columns = {
        "window_index": s.index(w) - (SEQUENCE_LENGTH - 1),
        "window_start_time": F.first(SORT_COLUMN).over(frame),
        "window_end_time": F.col(SORT_COLUMN),
        "first_flow_gap": F.first("flow_gap").over(frame),
        "first_gap_cv": F.first("gap_rolling_cv").over(frame),
    }
    if label:
        columns |= {"_lo": F.min(label).over(frame), "_hi": F.max(label).over(frame)}
    if features:
        columns["steps"] = F.collect_list(feature_vector(s.df, features)).over(frame)
    for name, make in (extra or {}).items():
        columns[name] = make(frame)
    out = s.with_df(s.df.withColumns(columns).where(F.col("window_index") >= 0)).finish()
    if label:
        out = out.where(F.col("_lo") == F.col("_hi")).withColumn("label", F.col("_lo")).drop("_lo", "_hi")
    keep = [*s.keys, "window_index", "window_start_time", "window_end_time", "first_flow_gap", "first_gap_cv"]
    if label:
        keep.append("label")
    if features:
        out = out.withColumn("steps", F.flatten("steps"))
        keep.append("steps")
    return out.select(*keep, *(extra or {}))


def sequence_windows(
    rows: DataFrame,
    tie: list[str],
    features: list[str] | None = None,
    keys: list[str] = GROUP_KEYS,
    limits: Limits = DEFAULT,
    label: str | None = None,
    extra: dict | None = None,
) -> DataFrame:
    s = spread(rows, keys, SORT_COLUMN, tie=tie, rows_back=SEQUENCE_LENGTH - 1, limits=limits)
    return windows_on(s, tie, features, label, extra)


def window_counts(rows: DataFrame, keys: list[str] = GROUP_KEYS) -> DataFrame:
    """Windows per group, from group sizes alone (no window is built)."""
    n = F.count(F.lit(1)) - (SEQUENCE_LENGTH - 1)
    return rows.groupBy(*keys).agg(n.alias("windows")).where(F.col("windows") > 0)


def sampled_starts(counts: DataFrame, keys: list[str] = GROUP_KEYS, cap: int = TRAIN_WINDOW_CAP) -> DataFrame:
    """The evenly spaced window indexes that training keeps: at most ``cap`` per group."""
    even = F.transform(
        F.sequence(F.lit(0), F.lit(cap - 1)),
        lambda k: F.floor((k.cast("long") * (F.col("windows") - 1)) / F.lit(cap - 1)).cast("long"),
    )
    every = F.sequence(F.lit(0).cast("long"), F.col("windows").cast("long") - 1)
    return counts.select(
        *keys, F.explode(F.when(F.col("windows") > cap, even).otherwise(every)).alias("window_index"))


def sample_windows(windows: DataFrame, rows: DataFrame, keys: list[str] = GROUP_KEYS,
                   cap: int = TRAIN_WINDOW_CAP) -> DataFrame:
    """Keep all windows of small groups and ``cap`` evenly spaced ones of large groups."""
    counts = window_counts(rows, keys)
    joined = join_null_safe(windows, materialise(counts), keys, "inner")
    n, i = F.col("windows") - 1, F.col("window_index")
    # i is kept iff some k in 0..cap-1 has (k * n) div (cap - 1) = i; the only candidate is the
    # smallest k with k * n >= i * (cap - 1).
    k = F.ceil((i * (cap - 1)) / n).cast("long")
    hit = (k <= cap - 1) & (F.floor((k * n) / F.lit(cap - 1)) == i)
    return joined.where((F.col("windows") <= cap) | hit).drop("windows")


def sequence_coverage(rows: DataFrame, keys: list[str] = GROUP_KEYS, by: str = "source_file") -> DataFrame:
    """Per capture: rows, groups, and groups long enough for one window (null keys are a group)."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(by).agg(
        F.sum("n").alias("connection_rows"),
        F.count(F.lit(1)).alias("connection_groups"),
        F.count_if(F.col("n") >= SEQUENCE_LENGTH).alias("groups_with_sequence"),
    )


def coverage_report(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Coverage of every capture of the manifest; a capture without connections has zeros."""
    name = F.concat("source", F.lit("__"), "file_name")
    listed = manifest.select("file_name", "label", "split", "source", "scenario", name.alias("source_file"))
    covered = listed.join(sequence_coverage(rows), "source_file", "left")
    zero = F.lit(0).cast("long")
    return covered.select("file_name", "label", "split", "source", "scenario", *[
        F.coalesce(c, zero).alias(c) for c in ("connection_rows", "connection_groups", "groups_with_sequence")])


def window_statistics(
    rows: DataFrame, tie: list[str], label: str, keys: list[str] = GROUP_KEYS,
    cap: int = TRAIN_WINDOW_CAP, limits: Limits = DEFAULT,
) -> DataFrame:
    """groups, short groups, mixed-label windows (after sampling) and windows cut by the cap."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    built = F.col("n") - (SEQUENCE_LENGTH - 1)
    head = sizes.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("n") < SEQUENCE_LENGTH).alias("short_groups"),
        F.coalesce(F.sum(F.when(built > cap, built - cap)), F.lit(0)).cast("long").alias("capped_windows"),
    )
    labelled = sequence_windows(
        rows, tie, keys=keys, limits=limits,
        extra={"mixed": lambda f: F.min(label).over(f) != F.max(label).over(f)},
    )
    mixed = sample_windows(labelled, rows, keys, cap).agg(F.count_if("mixed").alias("mixed_label_windows"))
    return head.withColumn("mixed_label_windows", mixed.scalar())


def short_group_report(rows: DataFrame, keys: list[str] = GROUP_KEYS) -> DataFrame:
    """One row: the longest group, and whether any group reaches one sequence."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    longest = F.coalesce(F.max("n"), F.lit(0).cast("long"))
    return sizes.agg(
        longest.alias("max_group_connections"),
        F.lit(SEQUENCE_LENGTH).alias("minimum_sequence_length"),
        F.when(longest < SEQUENCE_LENGTH, F.lit("insufficient_sequence")).otherwise(F.lit("ready")).alias("status"),
    )


def window_row_weights(
    rows: DataFrame, tie: list[str], keys: list[str] = GROUP_KEYS, cap: int = TRAIN_WINDOW_CAP,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """How many kept windows hold each row: the scaler counts shared rows once per window."""
    s = spread(rows, keys, SORT_COLUMN, tie=tie, rows_back=0, limits=limits)
    indexed = s.with_df(s.df.withColumn("_row", s.index(s.window(SORT_COLUMN, *tie)))).finish()
    counts = window_counts(rows, keys)
    joined = join_null_safe(indexed, materialise(counts), keys, "inner")
    n = F.col("windows")
    first, last = F.greatest(F.col("_row") - (SEQUENCE_LENGTH - 1), F.lit(0)), F.least(F.col("_row"), n - 1)
    # kept starts in [first, last]: all of them, or the k whose (k * (n - 1)) div (cap - 1) falls inside
    step = F.greatest(n - 1, F.lit(1))
    k_low = F.ceil(first * (cap - 1) / step)
    k_high = F.least(F.ceil((last + 1) * (cap - 1) / step) - 1, F.lit(cap - 1))
    weight = F.when(n <= cap, last - first + 1).otherwise(F.greatest(k_high - k_low + 1, F.lit(0)))
    return joined.withColumn("weight", weight.cast("long")).drop("_row", "windows")


def fit_scaler(weighted: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """One row of mean and population deviation per feature; a zero deviation becomes 1.

    A row lies in at most ten windows, so the rows fall into ten strata by weight.  The strata
    are aggregated in one pass and only those ten rows are combined afterwards.
    """
    value = {c: F.col(c).cast("float").cast("double") for c in features}
    strata = weighted.where(F.col("weight") > 0).groupBy("weight").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(v).alias(f"m_{c}") for c, v in value.items()],
        *[F.var_pop(v).alias(f"v_{c}") for c, v in value.items()],
    )
    ten_rows = Window.partitionBy(F.lit(0))
    w = F.col("weight") * F.col("n")
    strata = strata.withColumns({"_w": w.cast("double"), "_all": F.sum(w).over(ten_rows).cast("double")})
    strata = strata.withColumns({
        f"mean_{c}": F.sum(F.col("_w") * F.col(f"m_{c}")).over(ten_rows) / F.col("_all") for c in features
    })
    spread_of = {
        c: F.sqrt(F.sum(
            F.col("_w") * (F.col(f"v_{c}") + F.pow(F.col(f"m_{c}") - F.col(f"mean_{c}"), 2)) / F.col("_all")))
        for c in features
    }
    out = strata.agg(
        *[F.first(f"mean_{c}").alias(f"mean_{c}") for c in features],
        *[d.alias(f"std_{c}") for c, d in spread_of.items()],
    )
    return out.withColumns({
        f"std_{c}": F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(F.lit(1.0)) for c in features
    })

"""Gaps between the connections of one communication group and their rolling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.plans.hotgroups import DEFAULT, Limits, Spread, spread
from pulseloom.schemas import GAP_HISTORY, GROUP_KEYS, SORT_COLUMN


def sorted_quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of a small sorted array."""
    last = (F.size(values) - 1).cast("double")
    position = last * F.lit(q)
    low = F.floor(position).cast("int")
    a = F.get(values, low)
    b = F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (position - low)


def gap_features_on(s: Spread, tie: list[str]) -> Spread:
    """Add the seven gap features inside an existing spread (needs five rows of history)."""
    w = s.window(SORT_COLUMN, *tie)
    start = F.col(SORT_COLUMN)
    df = s.df.withColumn("flow_gap", F.greatest(F.lit(0.0), F.coalesce(start - F.lag(start).over(w), F.lit(0.0))))
    recent = w.rowsBetween(1 - GAP_HISTORY, 0)
    gap = F.col("flow_gap")
    df = df.withColumns({
        "gap_rolling_mean": F.avg(gap).over(recent),
        "gap_rolling_std": F.stddev_pop(gap).over(recent),
        "_gaps": F.collect_list(gap).over(recent),
    })
    ordered = F.sort_array("_gaps")
    mean, std = F.col("gap_rolling_mean"), F.col("gap_rolling_std")
    df = df.withColumns({
        "log_flow_gap": F.log1p(gap),
        "gap_rolling_cv": F.when(mean > 1e-9, std / mean).otherwise(F.lit(0.0)),
        "gap_rolling_median": sorted_quantile(ordered, 0.5),
        "gap_rolling_iqr": sorted_quantile(ordered, 0.75) - sorted_quantile(ordered, 0.25),
    }).drop("_gaps")
    return s.with_df(df)


def with_gap_features(
    connections: DataFrame, tie: list[str], keys: list[str] = GROUP_KEYS, limits: Limits = DEFAULT
) -> DataFrame:
    s = spread(connections, keys, SORT_COLUMN, tie=tie, rows_back=GAP_HISTORY, limits=limits)
    return gap_features_on(s, tie).finish()

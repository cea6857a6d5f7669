"""Exact order statistics and running totals without one task that sees everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.plans.hotgroups import DEFAULT, Limits, spread


def running_totals(
    df: DataFrame, keys: list[str], order: str, sums: list[str], limits: Limits = DEFAULT
) -> DataFrame:
    """Add ``<c>_before``: the sum of ``c`` over rows of the key with a smaller ``order``.

    ``order`` is unique within the key (aggregate by it first).
    """
    s = spread(df, keys, order, tie=[], rows_back=0, limits=limits)
    s = s.with_carry({f"_c_{c}": F.col(c) for c in sums}, how="sum")
    before = s.window(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    out = s.df.withColumns({
        f"{c}_before": F.coalesce(F.sum(c).over(before), zero) + F.coalesce(F.col(f"_c_{c}"), zero) for c in sums
    }).drop(*[f"_c_{c}" for c in sums])
    return s.with_df(out).finish()


def values_at(
    df: DataFrame, keys: list[str], value: str, positions: dict[str, Column], limits: Limits = DEFAULT
) -> DataFrame:
    """The value at given zero-based positions of the sorted values of each key.

    ``positions`` are expressions over ``n``, the number of non-null values of the key.  Equal
    values are counted before anything is sorted.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    ranked = running_totals(counts, keys, "_v", ["_n"], limits).join(totals, keys)
    low, high = F.col("_n_before"), F.col("_n_before") + F.col("_n")
    return ranked.groupBy(*keys).agg(*[
        F.max(F.when((low <= p) & (p < high), F.col("_v"))).alias(name) for name, p in positions.items()
    ])


def exact_medians(df: DataFrame, columns: list[str], limits: Limits = DEFAULT) -> DataFrame:
    """One row with the exact median of every column, nulls ignored.

    A sketch brackets each median; only values inside the brackets are ranked.
    """
    bracket = df.agg(*[
        F.percentile_approx(F.col(c), [0.499, 0.501], 10_000).alias(c) for c in columns
    ]).first()
    live = [c for c in columns if bracket[c] is not None]
    ends = df.agg(
        *[F.count(F.col(c)).alias(f"n_{c}") for c in live],
        *[F.count_if(F.col(c) < F.lit(float(bracket[c][0]))).alias(f"below_{c}") for c in live],
    )
    if not live:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in columns])
    # a value outside its bracket is null before anything is exploded, so nearly every row gives nothing
    within = F.array_compact(F.array(*[
        F.when(F.col(c).cast("double").between(float(bracket[c][0]), float(bracket[c][1])),
               F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))) for c in live]))
    counts = (
        df.select(F.explode(within).alias("p")).select("p.column", "p.value")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(counts, ["column"], "value", ["_n"], limits)
    facts = ends.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(f"below_{c}").alias("below"))
        for c in live
    ])).alias("f")).select("f.*")
    low = F.col("_n_before") + F.col("below")
    high = low + F.col("_n")
    first, second = F.floor((F.col("n") - 1) / F.lit(2)), F.ceil((F.col("n") - 1) / F.lit(2))
    picked = ranked.join(facts, "column").groupBy("column").agg(
        ((F.max(F.when((low <= first) & (first < high), F.col("value")))
          + F.max(F.when((low <= second) & (second < high), F.col("value")))) / 2).alias("m"))
    return picked.agg(*[
        (F.max(F.when(F.col("column") == c, F.col("m"))) if c in live else F.lit(None).cast("double")).alias(c)
        for c in columns
    ])

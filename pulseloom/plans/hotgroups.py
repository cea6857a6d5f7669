"""Ordered windows over groups of any size.

A window function puts one group into one task.  ``spread`` cuts groups that are
too large for that into blocks along the sort column and copies the last
``rows_back`` rows before each block into it, so that frames of up to
``rows_back`` preceding rows give the same result as on the uncut group.  Groups
that are not hot keep the plain single-shuffle plan and pay one narrow count.  Only
where a hot group exists are the rows written to the shared folder, once per step that
reads them more than once, so that a lost executor repeats no earlier shuffle.

The tables that describe the cut are broadcast.  Their size is bounded by
construction: a group is hot only above ``hot_rows / max_blocks`` rows, so there
are at most ``max_blocks`` hot groups and ``2 * max_blocks`` blocks, whatever the
data size.  Cut points are quantiles of the sort column, so bursts do not fill
one block.  Only a single sort value that holds more rows than a block stays whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.session import materialise

BLOCK, HALO, BASE, HOT = "_block", "_halo", "_base", "_hot"


@dataclass(frozen=True)
class Limits:
    min_rows: int = 1_000_000
    max_blocks: int = 20_000


DEFAULT = Limits()
_CUTS = 16_384  # quantile steps per hot group; a group that needs nearly all blocks gets nearly that many
_FAN = 128  # cut points are looked up in two levels of this width


@dataclass
class Spread:
    """A DataFrame whose ordered windows are partitioned by ``parts``."""

    df: DataFrame
    keys: list[str]
    parts: list[str]
    cut: bool
    _extra: list[str] = field(default_factory=lambda: [BLOCK, HALO, BASE, HOT])

    def window(self, *order):
        return Window.partitionBy(*self.parts).orderBy(*order)

    def index(self, window) -> Column:
        """Zero-based position of the row in its whole group."""
        local = F.row_number().over(window).cast("long") - F.lit(1)
        return F.col(BASE) + local if self.cut else local

    def with_df(self, df: DataFrame) -> "Spread":
        return Spread(df, self.keys, self.parts, self.cut)

    def without_halo(self) -> "Spread":
        return self.with_df(self.df.where(~F.col(HALO))) if self.cut else self

    def finish(self) -> DataFrame:
        """Drop the copied rows and the helper columns."""
        return self.df.where(~F.col(HALO)).drop(*self._extra) if self.cut else self.df

    def with_carry(self, partials: dict[str, Column], how: str = "max") -> "Spread":
        """Add, per name, the running ``max``/``sum`` of all earlier blocks of the group.

        Call it without halo rows.  For groups that are not cut the value is null.
        """
        if not self.cut:
            types = self.df.select(*[c.alias(n) for n, c in partials.items()]).schema
            return self.with_df(
                self.df.withColumns({n: F.lit(None).cast(types[n].dataType) for n in partials})
            )
        agg = F.max if how == "max" else F.sum
        written = materialise(self.df)
        per_block = (
            written.where(F.col(HOT))
            .groupBy(*self.keys, BLOCK)
            .agg(*[agg(c).alias(n) for n, c in partials.items()])
        )
        earlier = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carried = per_block.select(*self.keys, BLOCK, *[agg(n).over(earlier).alias(n) for n in partials])
        return self.with_df(join_null_safe(written, F.broadcast(carried), [*self.keys, BLOCK], "left"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join in which null keys meet; the keys of ``left`` stay."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def spread(
    df: DataFrame,
    keys: list[str],
    order: str,
    *,
    tie: list[str],
    rows_back: int,
    limits: Limits = DEFAULT,
    probe: tuple[DataFrame, list[str]] | None = None,
) -> Spread:
    """Prepare ``df`` for windows over ``keys`` ordered by (``order``, ``tie``).

    ``probe`` names a cheaper table and keys whose groups are never smaller than the groups of
    ``df``: if none of those is hot, ``df`` itself is not counted.
    """
    if probe is not None:
        table, wider = probe
        sizes = table.groupBy(*wider).agg(F.count(F.lit(1)).alias("n"))
        if sizes.where(F.col("n") > limits.min_rows).isEmpty():
            return Spread(df, list(keys), list(keys), False)
        # something is hot: what lies upstream runs once, and rows are counted from files, not behind a join
        df = materialise(df)
    heavy = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > limits.min_rows)
        .agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"))
        .first()
    )
    if not heavy["groups"]:
        return Spread(df, list(keys), list(keys), False)

    # the steps below read the rows several times, so write what lies upstream once
    if probe is None:
        df = materialise(df)
    target = max(limits.min_rows, math.ceil(heavy["rows"] / limits.max_blocks))
    at = F.col(order).cast("double")
    steps = ",".join(f"{k / _CUTS!r}D" for k in range(1, _CUTS))
    pieces = F.least(F.ceil(F.col("n") / F.lit(target)), F.lit(_CUTS)).cast("int")
    hot_keys = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > target)
    hot = (
        join_null_safe(df.select(*dict.fromkeys([*keys, order])), F.broadcast(hot_keys), keys, "inner").withColumn("_at", at)
        .groupBy(*keys, "n").agg(F.expr(f"percentile_approx(_at, array({steps}), 50000)").alias("_q"))
        .withColumn("_cuts", F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(pieces - 1, F.lit(1))),
            lambda k: F.get(F.col("_q"), (k * F.lit(_CUTS) / pieces).cast("int") - 1))))
        .select(*keys, F.transform(
            F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / F.lit(_FAN)).cast("int")),
            lambda i: F.slice(F.col("_cuts"), i * _FAN + 1, _FAN)).alias("_fans"))
    )
    # block = number of cut points at or below the sort value
    coarse = F.size(F.filter(F.col("_fans"), lambda fan: F.get(fan, F.lit(0)) <= at))
    fine = F.size(F.filter(F.get(F.col("_fans"), coarse - 1), lambda cut: cut <= at))
    block_of = (
        F.when(F.col("_fans").isNull(), F.lit(None))
        .when(at.isNull() | (coarse == 0), F.lit(0))
        .otherwise((coarse - 1) * _FAN + fine).cast("long")
    )
    located = join_null_safe(df, F.broadcast(hot), keys, "left").withColumn(BLOCK, block_of)
    by_block = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        located.where(F.col("_fans").isNotNull())
        .groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_tail", F.least(F.col("_n"), F.lit(rows_back)))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(by_block), F.lit(0)))
        .withColumn("_tails_before", F.coalesce(F.sum("_tail").over(by_block), F.lit(0)))
    )
    tagged = join_null_safe(
        located.drop("_fans"),
        F.broadcast(blocks.drop("_n")), [*keys, BLOCK], "left")
    base = F.col("_offset") - F.least(F.col("_offset"), F.lit(rows_back))
    own = tagged.withColumns({
        HOT: F.col(BLOCK).isNotNull(),
        HALO: F.lit(False),
        BASE: F.coalesce(base, F.lit(0)).cast("long"),
        BLOCK: F.coalesce(F.col(BLOCK), F.lit(0)).cast("long"),
    })
    plain = own.drop("_offset", "_tail", "_tails_before")
    if rows_back <= 0:
        return Spread(plain, list(keys), [*keys, BLOCK], True)

    last_first = Window.partitionBy(*keys, BLOCK).orderBy(F.desc(order), *[F.desc(t) for t in tie])
    tails = (
        own.where(F.col(HOT))
        .withColumn("_rn", F.row_number().over(last_first))
        .where(F.col("_rn") <= rows_back)
        .withColumn("_t", F.col("_tails_before") + F.col("_tail") - F.col("_rn") + 1)
        .drop("_rn", "_offset", "_tail", "_tails_before", BLOCK, BASE, HALO)
    )
    wanted = blocks.where(F.col("_tails_before") > 0).select(
        *keys, BLOCK, base.cast("long").alias(BASE),
        F.explode(F.sequence(
            F.greatest(F.col("_tails_before") - rows_back + 1, F.lit(1).cast("long")), F.col("_tails_before")
        )).alias("_t"),
    )
    halo = join_null_safe(tails, wanted, [*keys, "_t"], "inner").withColumn(HALO, F.lit(True)).drop("_t")
    return Spread(plain.unionByName(halo), list(keys), [*keys, BLOCK], True)

"""Epoch arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ntz: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, as BIGINT."""
    day = F.unix_date(ntz.cast("date")).cast("long")
    second = F.hour(ntz) * 3600 + F.minute(ntz) * 60
    micro = (F.extract(F.lit("SECOND"), ntz) * F.lit(1_000_000)).cast("long")
    return day * F.lit(86_400_000_000).cast("long") + second.cast("long") * F.lit(1_000_000) + micro


def epoch_seconds(ntz: Column) -> Column:
    return epoch_micros(ntz) / F.lit(1e6)

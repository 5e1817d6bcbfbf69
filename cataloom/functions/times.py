"""Run times as stored by the catalog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_seconds(ts) -> Column:
    """Round a timestamp to whole seconds, as a seconds-precision column
    stores it (half a second rounds up)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor((F.unix_micros(c) + 500_000) / F.lit(1_000_000)).cast("long"))


def run_time(value: str) -> Column:
    """The one timestamp a whole run stamps on the rows it touches."""
    return whole_seconds(F.lit(value).cast("timestamp"))

"""Local days: moments are UTC, and a learner's day runs from one local midnight to the next, 23, 24 or 25 hours later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UTC = "UTC"
#: No two zones' clocks are further apart, and no local day up to now is longer.
ZONES_APART = "26 hours"


def with_zone(rows: DataFrame, zones: DataFrame | None) -> DataFrame:
    """rows (learner_id) with _tz. zones: learner_id, tz, one row a learner at most; a learner without one, or with null, lives in UTC."""
    if zones is None:
        return rows.withColumn("_tz", F.lit(UTC))
    of = zones.select("learner_id", F.col("tz").alias("_tz"))
    return rows.join(of, "learner_id", "left").fillna(UTC, ["_tz"])


def local_time(at: Column | str, tz: Column) -> Column:
    """What the clock on the wall shows, as a timestamp."""
    return F.from_utc_timestamp(at, tz)


def local_midnight(at: Column | str, tz: Column) -> Column:
    """The moment at which the local day of `at` began; where midnight is skipped, the first moment after it."""
    return F.to_utc_timestamp(F.date_trunc("day", local_time(at, tz)), tz)

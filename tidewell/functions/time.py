"""Calendar functions. Instants are UTC timestamps in a UTC session; zones are names or columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_day(ts: Column, tz) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def day_bounds_utc(day: Column, tz) -> tuple[Column, Column]:
    """[start, end) of a local day: 23 or 25 hours long where clocks change."""
    return F.to_utc_timestamp(day.cast("timestamp"), tz), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), tz)


def night_key(ts: Column, tz) -> Column:
    """The day a night belongs to: local wall clock less six hours."""
    return F.to_date(F.from_utc_timestamp(ts, tz) - F.expr("INTERVAL 6 HOURS"))


def touched_hours(start: Column, end: Column) -> Column:
    """Every UTC hour an interval overlaps; an end on the boundary doesn't touch the next; zero length touches its own."""
    last = F.greatest(end - F.expr("INTERVAL 1 MICROSECOND"), start)
    return F.sequence(F.date_trunc("hour", start), F.date_trunc("hour", last), F.expr("INTERVAL 1 HOUR"))


def minutes(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(60e6)


def metric_display_name(metric: Column) -> Column:
    """Without the identifier prefix, words split at capitals, runs of capitals kept."""
    bare = F.regexp_replace(metric, r"^HK(Quantity|Category|Workout|Data)?TypeIdentifier", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?<=[a-z0-9])(?=[A-Z])", " "), r"(?<=[A-Z])(?=[A-Z][a-z])", " ")


def top_k_per(df, keys, order, k: int):
    """The first k rows of each key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")

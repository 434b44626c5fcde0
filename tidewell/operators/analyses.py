"""Analyses that set metrics, nights and workouts beside each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import correlation, rounded
from ..functions.time import local_day
from .daily import runs
from .sleep import stage_rows
from .workouts import weekly_volume


def joint_runs(points: DataFrame, first: tuple[str, Column], second: tuple[str, Column], least: int) -> DataFrame:
    """Runs of consecutive days on which two metrics meet their conditions; each is (metric, condition on day_value)."""
    (a, on_a), (b, on_b) = first, second
    m = F.col("metric_type")
    both = points.where(((m == a) & on_a) | ((m == b) & on_b)).groupBy("user_id", "date").agg(F.count_distinct("metric_type").alias("n")).where("n = 2")
    return runs(both.withColumn("metric_type", F.lit(f"{a} and {b}")), F.lit(True), least)


def bedtime_and_deep(samples: DataFrame, tz="UTC") -> DataFrame:
    """Per user: mean bedtime (wall-clock minutes after the midnight that begins the night's day) and its correlation with deep sleep."""
    nights = stage_rows(samples, tz).groupBy("user_id", "night").agg(F.min("started_at").alias("bed"), F.coalesce(F.sum(F.when(F.col("value") == 4, F.col("minutes"))), F.lit(0.0)).alias("deep"))
    at = (F.unix_micros(F.from_utc_timestamp("bed", tz)) - F.unix_micros(F.col("night").cast("timestamp"))) / F.lit(60e6)
    return nights.withColumn("bedtime", at).groupBy("user_id").agg(F.count(F.lit(1)).alias("nights"), rounded(F.avg("bedtime"), 1).alias("mean_bedtime"), correlation("bedtime", "deep").alias("corr"))


def weekday_pattern(nights: DataFrame) -> DataFrame:
    """Mean hours by user and weekday (1 Monday ... 7 Sunday)."""
    return nights.groupBy("user_id", (F.weekday("night") + 1).alias("weekday")).agg(F.count(F.lit(1)).alias("nights"), rounded(F.avg("total_minutes") / 60, 2).alias("mean_hours"))


def alerts(points: DataFrame, day: Column, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values of one day below or above their metric's limits (None: no limit on that side)."""
    m, v = F.col("metric_type"), F.col("day_value")
    kind = F.lit(None).cast("string")
    for metric, (low, high) in limits.items():
        if low is not None:
            kind = F.when((m == metric) & (v < low), "low").otherwise(kind)
        if high is not None:
            kind = F.when((m == metric) & (v > high), "high").otherwise(kind)
    return points.where((F.col("date") == day) & m.isin(*limits)).withColumn("alert", kind).where("alert is not null").select("user_id", "metric_type", "date", "day_value", "alert")


def monthly_beside_sessions(points: DataFrame, rows: DataFrame, metric: str) -> DataFrame:
    """A metric's monthly mean beside the month's number of workouts; months with only one of the two stay."""
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    level = points.where(F.col("metric_type") == metric).groupBy("user_id", month("date")).agg(rounded(F.avg("day_value"), 2).alias("mean"))
    load = rows.groupBy("user_id", month("started_at")).agg(F.count(F.lit(1)).alias("sessions"))
    return level.join(load, ["user_id", "month"], "full").select("user_id", "month", "mean", F.coalesce("sessions", F.lit(0)).alias("sessions"))


def monthly_slope(points: DataFrame) -> DataFrame:
    """Least-squares change per 30 days; null with a single point."""
    slope = F.regr_slope(F.col("day_value"), F.datediff("date", F.lit("2000-01-01").cast("date")).cast("double"))
    return points.groupBy("user_id", "metric_type").agg(F.count("day_value").alias("n"), F.when(F.count_distinct("date") > 1, rounded(slope * 30, 2)).alias("per_30_days"))


def staleness(samples: DataFrame, as_of: Column, tz="UTC") -> DataFrame:
    """Per user and metric: rows, the last local day, and how many days ago it was."""
    last = local_day(F.max("started_at"), tz)
    return samples.groupBy("user_id", "metric_type").agg(F.count(F.lit(1)).alias("rows"), last.alias("last_day")).withColumn("days_ago", F.datediff(local_day(as_of, tz), "last_day"))


def after_heavy_weeks(rows: DataFrame, points: DataFrame, metric: str) -> DataFrame:
    """A metric's mean in the weeks that follow weeks of above-average training, and in those that follow others."""
    weeks = weekly_volume(rows).withColumn("heavy", F.col("seconds") > F.avg("seconds").over(Window.partitionBy("user_id")))
    following = weeks.select("user_id", F.date_add("week", 7).alias("week"), "heavy")
    level = points.where(F.col("metric_type") == metric).groupBy("user_id", F.date_trunc("week", "date").cast("date").alias("week")).agg(F.avg("day_value").alias("v"))
    of = lambda c: rounded(F.avg(F.when(c, F.col("v"))), 2)
    return following.join(level, ["user_id", "week"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("weeks"), of(F.col("heavy")).alias("after_heavy"), of(~F.col("heavy")).alias("after_others"))


def metrics_by_month(points: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Plain means of daily values, a column per metric, in one pass."""
    of = lambda m: rounded(F.avg(F.when(F.col("metric_type") == m, F.col("day_value"))), 2).alias(m)
    return points.where(F.col("metric_type").isin(*metrics)).groupBy("user_id", F.date_format("date", "yyyy-MM").alias("month")).agg(*[of(m) for m in metrics])

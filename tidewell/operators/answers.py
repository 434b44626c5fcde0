"""Whole answers: a metric's history, baselines and periods with the reason where there is nothing, training by month, a week's digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.time import day_bounds_utc, local_day, top_k_per
from ..schema import MAX_DAYS, MAX_LIMIT, RAW_DAYS
from ..sources.samples import scan_samples
from .daily import checked_periods, daily_value, lagged, metric_stats, single_unit, tiered_daily
from .quality import absence
from .reports import _mean, period_report

_SERIES = ["user_id", "metric_type"]


def _tiers() -> list[Column]:
    return [F.count_if(F.col("tier") == "summary").alias("summary_points"), F.count_if(F.col("tier") == "raw").alias("raw_points")]


def metric_answer(samples: DataFrame, summaries: DataFrame, users: DataFrame, catalog: DataFrame, as_of: Column, cumulative: tuple[str, ...], tz="UTC", days: int = 7, limit: int = 200, tiebreak: str = "source_device") -> DataFrame:
    """Per user and metric: granularity, count, unit, mean, extremes, tiers, and absence, which tells why the count is 0.

    Up to RAW_DAYS days the answer is about the newest `limit` samples (unit and tiers null), beyond about daily points of
    both tiers in the window's majority unit. days and limit are held to their limits. Every user has a row for each
    metric of the catalog; other metrics have one where there is data.
    """
    days, limit = min(max(days, 1), MAX_DAYS), min(max(limit, 1), MAX_LIMIT)
    if days > RAW_DAYS:
        today = local_day(as_of, tz)
        start = F.date_sub(today, days)
        raw = scan_samples(samples, since=day_bounds_utc(start, tz)[0], until=day_bounds_utc(today, tz)[1])
        here = single_unit(tiered_daily(raw, summaries.where(F.col("summary_date").between(start, today)), tz))
        told = here.groupBy(*_SERIES).agg(F.count(F.lit(1)).alias("count"), F.min("unit").alias("unit"), _mean(cumulative).alias("avg"), F.min("min_value").alias("min"), F.max("max_value").alias("max"), *_tiers())
    else:
        window = scan_samples(samples, since=as_of - F.expr(f"INTERVAL {days} DAYS"), until=as_of + F.expr("INTERVAL 1 MICROSECOND"))
        here = top_k_per(window, _SERIES, [F.col("started_at").desc(), F.col(tiebreak)], limit)
        none = lambda t, c: F.lit(None).cast(t).alias(c)
        told = here.groupBy(*_SERIES).agg(F.count(F.lit(1)).alias("count"), rounded(F.avg("value"), 2).alias("avg"), F.min("value").alias("min"), F.max("value").alias("max")).select(
            *_SERIES, "count", none("string", "unit"), "avg", "min", "max", none("long", "summary_points"), none("long", "raw_points")
        )
    ever = samples.select(*_SERIES).unionByName(summaries.select(*_SERIES))
    out = told.join(absence(users, catalog, here, ever).withColumnRenamed("reason", "absence"), _SERIES, "full")
    return out.withColumns({"count": F.coalesce("count", F.lit(0).cast("long")), "granularity": F.lit("daily" if days > RAW_DAYS else "raw")})


def baselines(points: DataFrame, users: DataFrame, catalog: DataFrame, ever: DataFrame, as_of: Column, cumulative: tuple[str, ...], tz="UTC", days: int = 90) -> DataFrame:
    """metric_stats of the last `days` local days in the window's majority unit, with the kind of value, tiers, good and poor days' limits, absence.

    points: daily points of both tiers, of any unit. ever: user_id, metric_type of all rows of either tier.
    """
    day = local_day(as_of, tz)
    own = daily_value(single_unit(points.where(F.col("date").between(F.date_sub(day, min(max(days, 1), MAX_DAYS)), day))), cumulative)
    told = metric_stats(own).join(own.groupBy(*_SERIES).agg(F.min("unit").alias("unit"), *_tiers()), _SERIES)
    out = told.join(absence(users, catalog, own, ever).withColumnRenamed("reason", "absence"), _SERIES, "full")
    kind = F.when(F.col("metric_type").isin(*cumulative), "daily_total").otherwise("daily_avg")
    return out.withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "value_type": kind, "good_day_above": F.col("p75"), "poor_day_below": F.col("p25")})


def periods_answer(points: DataFrame, periods: dict[str, tuple[str, str]], cumulative: tuple[str, ...], users: DataFrame, catalog: DataFrame, ever: DataFrame) -> DataFrame:
    """period_report with a row for every user and catalog metric, and per period the reason why it has no points."""
    periods = checked_periods(periods)
    out = period_report(points, periods, cumulative)
    for label, (lo, hi) in periods.items():
        here = points.where(F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
        out = out.join(absence(users, catalog, here, ever).withColumnRenamed("reason", f"{label}_absence"), _SERIES, "full")
    return out.withColumns({f"{p}_n": F.coalesce(f"{p}_n", F.lit(0).cast("long")) for p in periods} | {"verdict": F.coalesce("verdict", F.lit("insufficient data"))})


def training_review(rows: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Workouts of the last `days` days against as many before: sessions, hours, types, change in percent, longest and shortest week.

    Weeks begin on Monday and count the window's workouts only; of equally long ones the first is named. Changes are null
    where there was nothing before.
    """
    at, back = F.col("started_at"), lambda n: as_of - F.expr(f"INTERVAL {n} DAYS")
    now = at >= back(days)
    s = rows.where((at >= back(2 * days)) & (at <= as_of)).withColumn("seconds", F.coalesce("duration_seconds", F.lit(0.0)))
    of = lambda when, p: (F.count_if(when).alias(f"{p}sessions"), rounded(F.coalesce(F.sum(F.when(when, F.col("seconds"))), F.lit(0.0)) / 3600, 1).alias(f"{p}hours"), F.count_distinct(F.when(when, F.col("workout_type"))).alias(f"{p}types"))
    both = s.groupBy("user_id").agg(*of(now, ""), *of(~now, "previous_"))
    weeks = s.where(now).groupBy("user_id", F.date_trunc("week", at).cast("date").alias("week")).agg(rounded(F.sum("seconds"), 1).alias("seconds"))
    extremes = weeks.groupBy("user_id").agg(F.min_by("week", F.struct(-F.col("seconds"), F.col("week"))).alias("longest_week"), F.min_by("week", F.struct("seconds", "week")).alias("shortest_week"))
    change = lambda c: rounded(100 * (F.col(c) - F.col(f"previous_{c}")) / F.nullif(F.col(f"previous_{c}").cast("double"), F.lit(0.0)), 1)
    return both.join(extremes, "user_id", "left").withColumns({"weekly_sessions": rounded(F.col("sessions") * 7 / days, 1), "sessions_change": change("sessions"), "hours_change": change("hours")})


def night_points(nights: DataFrame, column: str, metric: str) -> DataFrame:
    """A column of the nights as daily points of a metric of that name."""
    return nights.select("user_id", F.lit(metric).alias("metric_type"), F.col("night").alias("date"), F.col(column).alias("day_value"))


def banded_pair(points: DataFrame, first: str, second: str, edges: tuple[float, ...], lag_days: int = 1) -> DataFrame:
    """Mean of a metric lag_days after days of each band of another one; band counts the edges that its value reaches."""
    band = F.lit(0)
    for edge in edges:
        band = band + (F.col("a") >= edge).cast("int")
    return lagged(points, first, second, lag_days).where("a is not null and b is not null").groupBy("user_id", band.alias("band")).agg(F.count(F.lit(1)).alias("pairs"), rounded(F.avg("b"), 2).alias("second_mean"))


def weekly_digest(points: DataFrame, sessions: DataFrame, as_of: Column, metrics: dict[str, str], tz="UTC", days: int = 7) -> DataFrame:
    """Per user: hrv and steps of the last `days` local days with their numbers of days, and workouts of as many days; absent parts are null, counts 0."""
    day = local_day(as_of, tz)
    here = points.where(F.col("date").between(F.date_sub(day, days), day))
    of = lambda m: F.when(F.col("metric_type") == metrics[m], F.col("day_value"))
    told = here.groupBy("user_id").agg(
        rounded(F.avg(of("hrv")), 1).alias("hrv_avg"), rounded(F.min(of("hrv")), 1).alias("hrv_min"), rounded(F.max(of("hrv")), 1).alias("hrv_max"), F.count(of("hrv")).alias("hrv_days"),
        rounded(F.avg(of("steps")), 0).alias("steps_avg"), rounded(F.sum(of("steps")), 0).alias("steps_total"),
    )
    load = sessions.where((F.col("started_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("started_at") <= as_of)).groupBy("user_id").agg(F.count(F.lit(1)).alias("workouts"))
    return told.join(load, "user_id", "full").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("hrv_days", "workouts")})

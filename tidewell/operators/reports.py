"""Reports that answer a whole question for every user at once: a trend, two periods, one day, the workouts of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.time import day_bounds_utc, local_day, top_k_per
from ..schema import ASLEEP, MAX_DAYS, MAX_MONTHS, RAW_DAYS
from ..sources.samples import scan_samples
from .daily import checked_periods, daily_points, single_unit, tier_status, tiered_daily, unit_votes, weighted_mean
from .quality import absence, freshness
from .sleep import sleep_nights


def trend_start(as_of: Column, months: int) -> Column:
    """First day of a trend of `months` months of 30 days; months and days are held to their limits."""
    return F.date_sub(F.to_date(as_of), min(30 * min(max(months, 1), MAX_MONTHS), MAX_DAYS))


def _mean(cumulative: tuple[str, ...]) -> Column:
    """Mean daily total of cumulative metrics (one decimal), else the mean over samples (two)."""
    return F.when(F.col("metric_type").isin(*cumulative), rounded(F.avg("sum_value"), 1)).otherwise(weighted_mean())


def monthly_trend(points: DataFrame, since: Column, cumulative: tuple[str, ...]) -> DataFrame:
    """Per user, metric and month: mean, days with data, and the tiers (sorted array) that these came from."""
    return points.where(F.col("date") >= since).groupBy("user_id", "metric_type", F.date_format("date", "yyyy-MM").alias("month")).agg(
        _mean(cumulative).alias("avg"), F.count(F.lit(1)).alias("days_with_data"), F.sort_array(F.collect_set("tier")).alias("tiers")
    )


def trend_overview(points: DataFrame, since: Column, cumulative: tuple[str, ...]) -> DataFrame:
    """The same window in one row per user and metric: mean, extremes, unit, days, and points by tier. Points have one unit."""
    return points.where(F.col("date") >= since).groupBy("user_id", "metric_type", "unit").agg(
        _mean(cumulative).alias("avg"), F.min("min_value").alias("min"), F.max("max_value").alias("max"), F.count(F.lit(1)).alias("days_with_data"),
        F.count_if(F.col("tier") == "summary").alias("summary_points"), F.count_if(F.col("tier") == "raw").alias("raw_points"),
    )


def period_report(points: DataFrame, periods: dict[str, tuple[str, str]], cumulative: tuple[str, ...]) -> DataFrame:
    """Two named date ranges (inclusive; they may overlap) with n, mean, extremes, unit and tiers of each, and a verdict.

    points: daily points of both tiers, of any unit, with day_value; each period takes its own majority unit
    (ties: first by name). Without points in one of them the verdict is "insufficient data".
    """
    (a, (a0, a1)), (b, (b0, b1)) = checked_periods(periods).items()
    inside = lambda lo, hi: F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    names = F.array_compact(F.array(F.when(inside(a0, a1), F.lit(a)), F.when(inside(b0, b1), F.lit(b))))
    tagged = points.where(inside(a0, a1) | inside(b0, b1)).withColumn("period", F.explode(names))
    keys = ("user_id", "metric_type", "period")
    units = tagged.groupBy(*keys, "unit").agg(
        F.count(F.lit(1)).alias("points"), F.count("day_value").alias("n"), _mean(cumulative).alias("avg"), rounded(F.min("day_value"), 2).alias("min"), rounded(F.max("day_value"), 2).alias("max"),
        F.count_if(F.col("tier") == "summary").alias("summary_points"), F.count_if(F.col("tier") == "raw").alias("raw_points"),
    )
    told = ("unit", "n", "avg", "min", "max", "summary_points", "raw_points")
    best = units.groupBy(*keys).agg(F.min_by(F.struct(*told), F.struct(-F.col("points"), F.col("unit"))).alias("s"))
    side = lambda p: F.max(F.when(F.col("period") == p, F.col("s")))
    both = best.groupBy("user_id", "metric_type").agg(side(a).alias("a"), side(b).alias("b"))
    delta = rounded(F.col("b.avg") - F.col("a.avg"), 2)
    way = F.when(delta > 0, "higher than").when(delta < 0, "lower than").when(delta == 0, "the same as")
    return both.select(
        "user_id", "metric_type", *[F.col(f"{s}.{c}").alias(f"{p}_{c}") for s, p in (("a", a), ("b", b)) for c in told],
        delta.alias("delta"), rounded(100 * delta / F.nullif(F.col("a.avg"), F.lit(0.0)), 1).alias("pct_change"),
        F.coalesce(F.concat(F.lit(f"{b} is "), way, F.lit(f" {a}")), F.lit("insufficient data")).alias("verdict"),
    )


def day_points(samples: DataFrame, summaries: DataFrame, day: Column, tz="UTC") -> DataFrame:
    """All points of one local day: from raw samples, and from summaries for metrics that have none left."""
    start, end = day_bounds_utc(day, tz)
    raw = daily_points(scan_samples(samples, since=start, until=end), tz)
    old = summaries.withColumnRenamed("summary_date", "date").where(F.col("date") == day).select(*raw.columns)
    rest = old.join(raw.select("user_id", "metric_type"), ["user_id", "metric_type"], "left_anti")
    return raw.withColumn("tier", F.lit("raw")).unionByName(rest.withColumn("tier", F.lit("summary")))


def day_rows(samples: DataFrame, day: Column, tz="UTC", max_rows: int = 1000, tiebreak: str = "source_device") -> DataFrame:
    """One local day's samples by metric and time, at most max_rows of a user; truncated tells that there were more."""
    start, end = day_bounds_utc(day, tz)
    own = Window.partitionBy("user_id")
    rows = scan_samples(samples, since=start, until=end).withColumns({"rank": F.row_number().over(own.orderBy("metric_type", "started_at", tiebreak)), "truncated": F.count(F.lit(1)).over(own) > max_rows})
    return rows.where(F.col("rank") <= max_rows)


def workout_list(rows: DataFrame, limit: int = 20) -> DataFrame:
    """The newest `limit` workouts of each user in minutes and kilometres; a distance of zero is an absent one."""
    w = Window.partitionBy("user_id").orderBy(F.col("started_at").desc(), "source_device")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(
        "user_id", "rank", "started_at", "workout_type", rounded(F.coalesce("duration_seconds", F.lit(0.0)) / 60, 1).alias("duration_minutes"),
        rounded(F.nullif("distance_meters", F.lit(0.0)) / 1000, 2).alias("distance_km"), F.col("energy_cal").alias("calories"), F.col("source_device").alias("source"),
    )


def workout_totals(listed: DataFrame) -> DataFrame:
    """Per user, of listed workouts: how many, their hours, and a map from type to count."""
    kinds = listed.groupBy("user_id", "workout_type").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_minutes").alias("minutes"))
    return kinds.groupBy("user_id").agg(
        F.sum("n").alias("total_workouts"), rounded(F.sum("minutes") / 60, 1).alias("total_hours"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("workout_type", "n")))).alias("by_type")
    )


def _of(metric: str, value: str = "value") -> Column:
    return F.when(F.col("metric_type") == metric, F.col(value))


def health_summary(samples: DataFrame, as_of: Column, metrics: dict[str, str], tz="UTC", days: int = 7, tiebreak: str = "source_device") -> DataFrame:
    """The last `days` times 24 hours in one row per user. metrics names the metric types of steps, hrv, rhr and sleep."""
    s = scan_samples(samples, since=as_of - F.expr(f"INTERVAL {int(days) * 24} HOURS"))
    is_ = lambda m: F.col("metric_type") == metrics[m]
    of = lambda m: _of(metrics[m])
    return s.groupBy("user_id").agg(
        rounded(F.sum(of("steps")), 1).alias("steps_total"), F.count_distinct(F.when(is_("steps"), local_day(F.col("started_at"), tz))).alias("steps_days"), rounded(F.avg(of("hrv")), 1).alias("hrv_avg"),
        rounded(F.max_by("value", F.when(is_("hrv") & F.col("value").isNotNull(), F.struct("started_at", tiebreak))), 2).alias("hrv_latest"), F.count(of("hrv")).alias("hrv_n"), rounded(F.avg(of("rhr")), 1).alias("rhr_avg"),
        F.count_if(is_("sleep")).alias("sleep_records"), F.count_if(is_("sleep") & F.col("value").isin(*ASLEEP)).alias("stage_records"),
    )


def daily_snapshot(samples: DataFrame, day: Column, metrics: dict[str, str], tz="UTC", tiebreak: str = "source_device") -> DataFrame:
    """Highlights of one local day per user: totals of steps and energy, the first value of hrv, sleep records, metrics seen."""
    start, end = day_bounds_utc(day, tz)
    seen = F.when((F.col("metric_type") == metrics["hrv"]) & F.col("value").isNotNull(), F.struct("started_at", tiebreak))
    return scan_samples(samples, since=start, until=end).groupBy("user_id").agg(
        rounded(F.sum(_of(metrics["steps"])), 0).alias("steps"), rounded(F.sum(_of(metrics["energy"])), 0).alias("energy"), rounded(F.min_by(_of(metrics["hrv"]), seen), 2).alias("first_hrv"),
        F.count(_of(metrics["sleep"])).alias("sleep_records"), F.count_distinct("metric_type").alias("metrics"),
    )


def whole_summary(samples: DataFrame, summaries: DataFrame, sessions: DataFrame, users: DataFrame, catalog: DataFrame, as_of: Column, metrics: dict[str, str], tz="UTC", days: int = 7, tiebreak: str = "source_device") -> DataFrame:
    """Health summary of the last `days` days, one row for each of `users`: steps, hrv, rhr, sleep, workouts, tiers, absence of steps.

    Up to RAW_DAYS days the raw samples of `days` times 24 hours count; beyond, daily points of both tiers from the local
    day `days` ago on. Steps have one unit, that of most days of the window; days of others are only counted. hrv and rhr
    are means of samples, latest a sample's value (raw) or a day's mean (tiers). Sleep and workouts are never compacted.
    """
    since, is_long = as_of - F.expr(f"INTERVAL {int(days) * 24} HOURS"), days > RAW_DAYS
    raw = scan_samples(samples, since=since, until=as_of + F.expr("INTERVAL 1 MICROSECOND"))
    levels = ("hrv", "rhr")
    wanted = F.col("metric_type").isin(*[metrics[m] for m in ("steps", *levels)])
    if is_long:
        today = local_day(as_of, tz)
        start = F.date_sub(today, days)
        points = tiered_daily(scan_samples(samples, since=day_bounds_utc(start, tz)[0], until=day_bounds_utc(today, tz)[1]).where(wanted), summaries.where(wanted & F.col("summary_date").between(start, today)), tz)
    else:
        points = daily_points(raw.where(wanted), tz).withColumn("tier", F.lit("raw"))
    votes = unit_votes(points).where(F.col("metric_type") == metrics["steps"]).select("user_id", "unit", "other_points")
    points = single_unit(points)
    steps = points.where(F.col("metric_type") == metrics["steps"]).groupBy("user_id").agg(
        rounded(F.sum("sum_value"), 0).alias("steps_total"), rounded(F.avg("sum_value"), 1).alias("steps_daily_avg"), F.count(F.lit(1)).alias("steps_days")
    ).join(votes.select("user_id", F.col("unit").alias("steps_unit"), F.col("other_points").alias("steps_other_unit_days")), "user_id")
    if is_long:
        of = lambda m, c: _of(metrics[m], c)
        mean = lambda m: rounded(F.sum(of(m, "sum_value")) / F.nullif(F.sum(of(m, "sample_count")), F.lit(0)), 2)
        last = lambda m: rounded(F.max_by(of(m, "avg_value"), F.when(F.col("metric_type") == metrics[m], F.col("date"))), 2)
        level = points.groupBy("user_id").agg(
            *[x for m in levels for x in (mean(m).alias(f"{m}_avg"), last(m).alias(f"{m}_latest"), F.coalesce(F.sum(of(m, "sample_count")), F.lit(0)).cast("long").alias(f"{m}_n"))],
            F.count_if(F.col("tier") == "summary").alias("summary_points"), F.count_if(F.col("tier") == "raw").alias("raw_points"),
        )
    else:
        at = lambda m: F.when((F.col("metric_type") == metrics[m]) & F.col("value").isNotNull(), F.struct("started_at", tiebreak))
        level = raw.where(wanted).groupBy("user_id").agg(
            *[x for m in levels for x in (rounded(F.avg(_of(metrics[m])), 1).alias(f"{m}_avg"), rounded(F.max_by("value", at(m)), 2).alias(f"{m}_latest"), F.count(_of(metrics[m])).alias(f"{m}_n"))]
        ).join(tier_status(points).groupBy("user_id").agg(F.sum("summary_points").alias("summary_points"), F.sum("raw_points").alias("raw_points")), "user_id", "left")
    slept = raw.where(F.col("metric_type") == metrics["sleep"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("sleep_records"), F.count_if(F.col("value").isin(*ASLEEP)).alias("stage_records"))
    trained = sessions.where((F.col("started_at") >= since) & (F.col("started_at") <= as_of)).groupBy("user_id").agg(F.count(F.lit(1)).alias("workouts"), F.sort_array(F.collect_set("workout_type")).alias("workout_types"))
    ever = samples.select("user_id", "metric_type").unionByName(summaries.select("user_id", "metric_type"))
    ids = users.select("user_id").distinct()
    seen = points.where(F.col("metric_type") == metrics["steps"])
    why = absence(ids, catalog, seen, ever).where(F.col("metric_type") == metrics["steps"]).select("user_id", F.col("reason").alias("steps_absence"))
    out = ids
    for part in (steps, level, slept, trained, why):
        out = out.join(part, "user_id", "left")
    counts = ("steps_days", "steps_other_unit_days", *(f"{m}_n" for m in levels), "sleep_records", "stage_records", "workouts", "summary_points", "raw_points")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts} | {"workout_types": F.coalesce("workout_types", F.array().cast("array<string>"))})


def whole_snapshot(samples: DataFrame, summaries: DataFrame, sessions: DataFrame, day: Column, metrics: dict[str, str], cumulative: tuple[str, ...], tz="UTC", max_rows: int = 1000, tiebreak: str = "source_device") -> DataFrame:
    """Everything of one local day, a row for each user with samples or summaries: highlights, their tier, metrics present, sleep, workouts, values.

    Highlights (metrics but sleep and vo2): a day's total of cumulative metrics, else its first value; in the unit of most
    samples (ties: first by name), from summaries (total or mean) for a metric without raw values. all_values: the first
    max_rows samples by metric and time; truncated tells that there were more, total_records how many.
    """
    start, end = day_bounds_utc(day, tz)
    raw, roles = scan_samples(samples, since=start, until=end), {r: m for r, m in metrics.items() if r not in ("sleep", "vo2")}
    points = day_points(samples, summaries, day, tz).where(F.col("metric_type").isin(*roles.values()))
    best = points.groupBy("user_id", "metric_type").agg(F.min_by(F.struct("unit", "sum_value", "avg_value", "tier"), F.struct(-F.col("sample_count"), F.col("unit"))).alias("s")).select("user_id", "metric_type", "s.*")
    seen = F.when(F.col("value").isNotNull(), F.struct("started_at", tiebreak))
    first = raw.groupBy("user_id", "metric_type", F.coalesce("unit", F.lit("")).alias("unit")).agg(F.min_by("value", seen).alias("first"))
    told = best.join(first, ["user_id", "metric_type", "unit"], "left").withColumn(
        "v", F.when(F.col("tier") == "summary", rounded(F.when(F.col("metric_type").isin(*cumulative), F.col("sum_value")).otherwise(F.col("avg_value")), 1)).when(F.col("metric_type").isin(*cumulative), rounded("sum_value", 0)).otherwise(rounded("first", 2))
    )
    high = told.groupBy("user_id").agg(*[F.max(_of(m, "v")).alias(r) for r, m in roles.items()], F.when(F.bool_or(F.col("tier") == "summary"), "summary").otherwise("raw").alias("highlights_tier"))
    here = raw.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_records"), F.count_if(F.col("metric_type") == metrics["sleep"]).alias("sleep_records"), F.sort_array(F.collect_set("metric_type")).alias("present"))
    value = F.struct("metric_type", "started_at", F.col(tiebreak).alias("nth"), "value", "unit")
    listed = day_rows(samples, day, tz, max_rows, tiebreak).groupBy("user_id").agg(F.bool_or("truncated").alias("truncated"), F.sort_array(F.collect_list(value)).alias("all_values"))
    trip = F.struct("started_at", "workout_type", rounded(F.coalesce("duration_seconds", F.lit(0.0)) / 60, 1).alias("duration_minutes"), F.col("energy_cal").alias("calories"))
    trips = sessions.where((F.col("started_at") >= start) & (F.col("started_at") < end)).groupBy("user_id").agg(F.sort_array(F.collect_list(trip)).alias("workouts"))
    old = summaries.where(F.col("summary_date") == day).groupBy("user_id").agg(F.sort_array(F.collect_set("metric_type")).alias("summarised"))
    out = here.join(old, "user_id", "full").join(high, "user_id", "left").join(listed, "user_id", "left").join(trips, "user_id", "left")
    none = lambda c: F.coalesce(c, F.array())
    return out.select(
        "user_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total_records", "sleep_records")], F.coalesce("truncated", F.lit(False)).alias("truncated"),
        F.array_sort(F.array_union(none("present"), none("summarised"))).alias("metrics_present"), *roles, "highlights_tier", none("workouts").alias("workouts"), none("all_values").alias("all_values"),
    )


def _last_30_days(sessions: DataFrame, as_of: Column) -> DataFrame:
    return sessions.where((F.col("started_at") >= as_of - F.expr("INTERVAL 30 DAYS")) & (F.col("started_at") <= as_of))


def coaching_brief(samples: DataFrame, sessions: DataFrame, as_of: Column, metrics: dict[str, str], tz="UTC", tiebreak: str = "source_device") -> DataFrame:
    """Freshness, sleep of the newest seven nights, newest seven hrv samples against the others of 14 days, and training load.

    sessions: workouts of any time; those of the last 30 days count. Every user with any sample has a row.
    """
    fresh = freshness(samples, as_of).select("user_id", "status")
    nights = top_k_per(sleep_nights(scan_samples(samples, metrics["sleep"]), tz), ["user_id"], [F.col("night").desc()], 7).groupBy("user_id").agg(rounded(F.avg(F.col("total_minutes") / 60), 1).alias("last7_sleep_hours"))
    w = Window.partitionBy("user_id").orderBy(F.col("started_at").desc(), tiebreak)
    hrv = scan_samples(samples, metrics["hrv"], since=as_of - F.expr("INTERVAL 14 DAYS")).withColumn("rn", F.row_number().over(w)).groupBy("user_id").agg(
        rounded(F.avg(F.when(F.col("rn") <= 7, F.col("value"))), 2).alias("newest7_hrv"), rounded(F.avg(F.when(F.col("rn") > 7, F.col("value"))), 2).alias("earlier_hrv")
    )
    load = _last_30_days(sessions, as_of).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions_30d"))
    h, d = F.col("last7_sleep_hours"), F.col("newest7_hrv") - F.col("earlier_hrv")
    return fresh.join(nights, "user_id", "left").join(hrv, "user_id", "left").join(load, "user_id", "left").select(
        "user_id", "status", h, F.when(h.isNull(), "no data").when(h >= 7.5, "good").when(h >= 6.5, "borderline").otherwise("poor").alias("sleep_flag"), "newest7_hrv", "earlier_hrv",
        F.when(d > 2, "up").when(d < -2, "down").when(F.col("earlier_hrv").isNotNull(), "flat").alias("hrv_trend"), "sessions_30d", rounded(F.col("sessions_30d") / 4.3, 1).alias("weekly_sessions"),
    )


def fitness_markers(samples: DataFrame, as_of: Column, metrics: dict[str, str], summaries: DataFrame | None = None, tz="UTC") -> DataFrame:
    """Per user: newest vo2 of 365 days; newest and oldest weight of 30 days, the latter null with fewer than two rows.

    With summaries, vo2 is the newest local day's mean over both tiers, in the unit of most days, and vo2_tier tells where it came from.
    """
    s = scan_samples(samples, since=as_of - F.expr("INTERVAL 365 DAYS")).where(F.col("metric_type").isin(metrics["vo2"], metrics["weight"]) & F.col("value").isNotNull())
    at = lambda m, days: F.when((F.col("metric_type") == metrics[m]) & (F.col("started_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")), F.struct("started_at", "value"))
    v, w = at("vo2", 365), at("weight", 30)
    out = s.groupBy("user_id").agg(
        rounded(F.max_by("value", v), 2).alias("vo2_latest"), rounded(F.max_by("value", w), 2).alias("weight_latest"), F.when(F.count(w) > 1, rounded(F.min_by("value", w), 2)).alias("weight_30d_ago")
    )
    if summaries is None:
        return out
    today, kind = local_day(as_of, tz), F.col("metric_type") == metrics["vo2"]
    start = F.date_sub(today, 365)
    old = summaries.where(kind & F.col("summary_date").between(start, today))
    points = single_unit(tiered_daily(scan_samples(samples, since=day_bounds_utc(start, tz)[0], until=day_bounds_utc(today, tz)[1]).where(kind), old, tz))
    newest = points.groupBy("user_id").agg(F.max_by(F.struct("avg_value", "tier"), "date").alias("n"))
    return newest.select("user_id", rounded("n.avg_value", 2).alias("vo2_latest"), F.col("n.tier").alias("vo2_tier")).join(out.drop("vo2_latest"), "user_id", "full")


def whole_brief(samples: DataFrame, summaries: DataFrame, sessions: DataFrame, as_of: Column, metrics: dict[str, str], tz="UTC", tiebreak: str = "source_device") -> DataFrame:
    """coaching_brief with the rest of the report: hrv and rhr of 14 days, hours and types of 30 days' workouts, 7 days' activity, fitness markers.

    hrv_trend follows hrv_delta, which has one decimal. A user who has summaries of vo2 only has a row of status "none".
    """
    w = Window.partitionBy("user_id", "metric_type").orderBy(F.col("started_at").desc(), tiebreak)
    two = scan_samples(samples, since=as_of - F.expr("INTERVAL 14 DAYS"), until=as_of + F.expr("INTERVAL 1 MICROSECOND")).where(F.col("metric_type").isin(metrics["hrv"], metrics["rhr"])).withColumn("rn", F.row_number().over(w))
    at = lambda m: F.when((F.col("metric_type") == metrics[m]) & F.col("value").isNotNull(), F.struct("started_at", tiebreak))
    hrv = _of(metrics["hrv"])
    level = two.groupBy("user_id").agg(
        rounded(F.max_by("value", at("hrv")), 2).alias("hrv_latest"), rounded(F.avg(F.when(F.col("rn") <= 7, hrv)) - F.avg(F.when(F.col("rn") > 7, hrv)), 1).alias("hrv_delta"),
        rounded(F.max_by("value", at("rhr")), 2).alias("rhr_latest"), rounded(F.avg(_of(metrics["rhr"])), 1).alias("rhr_avg"),
    )
    kinds = _last_30_days(sessions, as_of).groupBy("user_id", "workout_type").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_seconds").alias("seconds"))
    load = kinds.groupBy("user_id").agg(rounded(F.sum(F.coalesce("seconds", F.lit(0.0))) / 3600, 1).alias("hours_30d"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("workout_type", "n")))).alias("by_type"))
    week = scan_samples(samples, since=as_of - F.expr("INTERVAL 7 DAYS"), until=as_of + F.expr("INTERVAL 1 MICROSECOND")).where(F.col("metric_type").isin(metrics["steps"], metrics["energy"]))
    active = single_unit(daily_points(week, tz)).groupBy("user_id").agg(*[rounded(F.avg(_of(metrics[m], "sum_value")), 1).alias(f"{m}_daily_avg") for m in ("steps", "energy")])
    out = coaching_brief(samples, sessions, as_of, metrics, tz, tiebreak).drop("hrv_trend").join(fitness_markers(samples, as_of, metrics, summaries, tz), "user_id", "full")
    for part in (level, load, active):
        out = out.join(part, "user_id", "left")
    d = F.col("hrv_delta")
    return out.withColumns({"status": F.coalesce("status", F.lit("none")), "sleep_flag": F.coalesce("sleep_flag", F.lit("no data")), "hrv_trend": F.when(d > 2, "up").when(d < -2, "down").when(d.isNotNull(), "flat")})


def recovery_score(points: DataFrame, nights: DataFrame, as_of: Column, metrics: dict[str, str], tz="UTC", days: int = 90) -> DataFrame:
    """Score of 0 to 100 per user: hrv (40 above the user's own p75, then 30, 20, 10), rhr (30 up to p25, then 20, 10, 5), sleep (30 from 7.5 hours, 20 from 6.5, 10 from 6, else 5).

    points: daily points of both tiers, of any unit. Quartiles and the newest day and night are of the last `days` local
    days, of the window's majority unit. A part without data is null, and so is the score: fewer parts don't compare with three.
    """
    day = local_day(as_of, tz)
    inside = lambda c: F.col(c).between(F.date_sub(day, days), day)
    own = single_unit(points.where(inside("date") & F.col("metric_type").isin(metrics["hrv"], metrics["rhr"])))
    q = own.groupBy("user_id", "metric_type").agg(F.max_by("avg_value", "date").alias("v"), F.percentile("avg_value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    v, (p25, p50, p75) = F.col("v"), (F.col("p")[i] for i in range(3))
    high = F.when(v > p75, 40).when(v >= p50, 30).when(v >= p25, 20).otherwise(10)
    low = F.when(v <= p25, 30).when(v <= p50, 20).when(v <= p75, 10).otherwise(5)
    part = lambda m, band: F.max(F.when(F.col("metric_type") == metrics[m], band))
    levels = q.groupBy("user_id").agg(part("hrv", high).alias("hrv_points"), part("rhr", low).alias("rhr_points"))
    h = F.max_by("total_minutes", "night") / 60
    last = nights.where(inside("night")).groupBy("user_id").agg(F.when(h >= 7.5, 30).when(h >= 6.5, 20).when(h >= 6, 10).otherwise(5).alias("sleep_points"))
    return levels.join(last, "user_id", "full").withColumn("score", F.col("hrv_points") + F.col("rhr_points") + F.col("sleep_points"))


def level_and_sleep_score(points: DataFrame, nights: DataFrame, metric: str) -> DataFrame:
    """Two of the three parts of recovery_score, over all points: newest value of one level metric among the user's own quartiles (10 to 40) plus the newest night's hours (10 to 30)."""
    p = F.percentile("day_value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p")
    base = points.where(F.col("metric_type") == metric).groupBy("user_id").agg(F.max_by("day_value", "date").alias("v"), p)
    last = nights.groupBy("user_id").agg((F.max_by("total_minutes", "night") / 60).alias("hours"))
    h, v = F.coalesce("hours", F.lit(0.0)), F.col("v")
    score = F.when(v >= F.col("p")[2], 40).when(v >= F.col("p")[1], 30).when(v >= F.col("p")[0], 20).otherwise(10) + F.when(h >= 7.5, 30).when(h >= 6.5, 20).otherwise(10)
    return base.join(last, "user_id", "left").select("user_id", score.alias("score"))

"""Registered queries over the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.time import local_day
from ..operators import daily, reports, sleep, workouts
from ..sources.samples import scan_samples
from .registry import _LOCAL, AS_OF, ORACLES, CATALOG, CUMULATIVE, METRICS, TZ, _series, _sleep, _table, _tiered, _trips, query, samples_of, summaries_of

_MEAN = "CASE WHEN metric_type IN ('steps', 'active_energy') THEN round(avg(sum_value), 1) ELSE round(sum(sum_value) / nullif(sum(sample_count), 0), 2) END AS avg"
_TIERS = "count(*) FILTER (tier = 'summary') AS summary_points, count(*) FILTER (tier = 'raw') AS raw_points"
_DAY = "2024-01-16"


def _since():
    return reports.trend_start(F.lit(AS_OF).cast("timestamp"), 24)


def _day():
    return F.lit(_DAY).cast("date")


@query(f"""SELECT user_id, metric_type, strftime(date, '%Y-%m') AS month, {_MEAN}, count(*) AS days_with_data, string_agg(DISTINCT tier, ',' ORDER BY tier) AS tiers
FROM series WHERE date >= DATE '2024-01-31' - 720 GROUP BY user_id, metric_type, strftime(date, '%Y-%m')""")
def monthly_trend(spark, sf_dir):
    return reports.monthly_trend(_series(spark, sf_dir), _since(), CUMULATIVE).withColumn("tiers", F.array_join("tiers", ","))


@query(f"""SELECT user_id, metric_type, unit, {_MEAN}, min(min_value) AS min, max(max_value) AS max, count(*) AS days_with_data, {_TIERS}
FROM series WHERE date >= DATE '2024-01-31' - 720 GROUP BY user_id, metric_type, unit""")
def trend_overview(spark, sf_dir):
    return reports.trend_overview(_series(spark, sf_dir), _since(), CUMULATIVE)


def _side(p: str) -> str:
    return ", ".join(f"{p}.{c} AS {p}_{c}" for c in ("unit", "n", "avg", "min", "max", "summary_points", "raw_points"))


@query(f""", tagged AS (SELECT t.*, CASE WHEN metric_type IN ('steps', 'active_energy') THEN sum_value ELSE avg_value END AS day_value, period FROM tiered t
  JOIN (VALUES ('a', DATE '2024-01-02', DATE '2024-01-14'), ('b', DATE '2024-01-12', DATE '2024-01-23')) v(period, first_day, last_day) ON date BETWEEN first_day AND last_day),
stats AS (SELECT user_id, metric_type, period, unit, count(day_value) AS n, {_MEAN}, round(min(day_value), 2) AS min, round(max(day_value), 2) AS max, {_TIERS},
  row_number() OVER (PARTITION BY user_id, metric_type, period ORDER BY count(*) DESC, unit) AS rn FROM tagged GROUP BY user_id, metric_type, period, unit),
a AS (SELECT * FROM stats WHERE rn = 1 AND period = 'a'), b AS (SELECT * FROM stats WHERE rn = 1 AND period = 'b')
SELECT *, round(100 * delta / nullif(a_avg, 0), 1) AS pct_change, CASE WHEN delta > 0 THEN 'b is higher than a' WHEN delta < 0 THEN 'b is lower than a' WHEN delta = 0 THEN 'b is the same as a' ELSE 'insufficient data' END AS verdict
FROM (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.metric_type, b.metric_type) AS metric_type, {_side('a')}, {_side('b')}, round(b.avg - a.avg, 2) AS delta FROM a FULL JOIN b ON a.user_id = b.user_id AND a.metric_type = b.metric_type)""")
def period_report(spark, sf_dir):
    points = daily.daily_value(_tiered(spark, sf_dir), CUMULATIVE)
    return reports.period_report(points, {"a": ("2024-01-02", "2024-01-14"), "b": ("2024-01-12", "2024-01-23")}, CUMULATIVE)


@query(f""", here AS (SELECT * FROM points WHERE date = DATE '{_DAY}' AND user_id % 2 = 0)
SELECT *, 'raw' AS tier FROM here UNION ALL SELECT *, 'summary' FROM summaries s WHERE date = DATE '{_DAY}' AND NOT EXISTS (SELECT 1 FROM here h WHERE h.user_id = s.user_id AND h.metric_type = s.metric_type)""")
def day_points(spark, sf_dir):
    """The raw rows of every second user have been compacted away: their day comes from the summaries."""
    left = samples_of(spark, sf_dir).where("user_id % 2 = 0")
    return reports.day_points(left, summaries_of(spark, sf_dir), _day(), TZ)


@query("""SELECT user_id, event_id, rank, truncated FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY metric_type, started_at, event_id)::INTEGER AS rank, count(*) OVER (PARTITION BY user_id) > 2 AS truncated FROM samples
WHERE started_at >= TIMESTAMP '2024-01-16 05:00:00' AND started_at < TIMESTAMP '2024-01-17 05:00:00') WHERE rank <= 2""")
def day_rows(spark, sf_dir):
    return reports.day_rows(samples_of(spark, sf_dir), _day(), TZ, max_rows=2, tiebreak="event_id").select("user_id", "event_id", "rank", "truncated")


def _listed(spark, sf_dir):
    """Active-energy samples as workouts of k minutes and 100 k metres, the newest twenty of each user."""
    s = scan_samples(samples_of(spark, sf_dir), "active_energy")
    k = F.from_json("metadata", "k double")["k"]
    kind = F.when(F.col("event_id") % 3 == 0, "Running").when(F.col("event_id") % 3 == 1, "Cycling")
    payload = F.to_json(F.struct(kind.alias("workout_type"), (k * 60).alias("duration_seconds"), (k * 100).alias("total_distance_meters"), F.col("value").alias("total_energy_burned_cal")))
    named = s.withColumns({"metadata": payload, "source_device": F.concat_ws(" ", "source_device", F.lpad(F.col("event_id").cast("string"), 12, "0"))})
    return reports.workout_list(workouts.workouts(named), 20)


_LISTED = """, named AS (SELECT *, source_device || ' ' || lpad(event_id::VARCHAR, 12, '0') AS source, (metadata->>'k')::DOUBLE AS k, CASE event_id % 3 WHEN 0 THEN 'Running' WHEN 1 THEN 'Cycling' ELSE 'unknown' END AS workout_type
  FROM samples WHERE metric_type = 'active_energy'),
listed AS (SELECT user_id, started_at, workout_type, round(coalesce(k * 60, value, 0) / 60, 1) AS duration_minutes, round(nullif(k * 100, 0) / 1000, 2) AS distance_km, value AS calories, source,
  row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, source)::INTEGER AS rank FROM named)
"""


@query(_LISTED + "SELECT user_id, rank, (epoch_us(started_at) // 1000000) AS start_epoch, workout_type, duration_minutes, distance_km, round(calories, 4) AS calories, source FROM listed WHERE rank <= 20")
def workout_list(spark, sf_dir):
    return _listed(spark, sf_dir).select("user_id", "rank", F.unix_timestamp("started_at").alias("start_epoch"), "workout_type", "duration_minutes", "distance_km", rounded("calories", 4).alias("calories"), "source")


@query(_LISTED + """SELECT user_id, sum(n)::BIGINT AS total_workouts, round(sum(minutes) / 60, 1) AS total_hours, string_agg(workout_type || ':' || n, ',' ORDER BY workout_type) AS by_type
FROM (SELECT user_id, workout_type, count(*) AS n, sum(duration_minutes) AS minutes FROM listed WHERE rank <= 20 GROUP BY ALL) GROUP BY user_id""")
def workout_totals(spark, sf_dir):
    out = reports.workout_totals(_listed(spark, sf_dir))
    told = F.transform(F.map_entries("by_type"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return out.withColumn("by_type", F.array_join(told, ","))


@query(f"""SELECT user_id, round(arg_max(value, started_at) FILTER (metric_type = 'hrv'), 2) AS vo2_latest, round(arg_max(value, started_at) FILTER (recent), 2) AS weight_latest,
CASE WHEN count(*) FILTER (recent) > 1 THEN round(arg_min(value, started_at) FILTER (recent), 2) END AS weight_30d_ago
FROM (SELECT *, metric_type = 'resting_hr' AND started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS recent FROM samples WHERE metric_type IN ('hrv', 'resting_hr') AND value IS NOT NULL AND started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) GROUP BY user_id""")
def fitness_markers(spark, sf_dir):
    return reports.fitness_markers(samples_of(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), METRICS)


@query("""SELECT user_id, hrv_points, rhr_points, sleep_points, hrv_points + rhr_points + sleep_points AS score FROM
(SELECT user_id, max(CASE WHEN metric_type = 'hrv' THEN CASE WHEN v > p75 THEN 40 WHEN v >= p50 THEN 30 WHEN v >= p25 THEN 20 ELSE 10 END END) AS hrv_points,
  max(CASE WHEN metric_type = 'resting_hr' THEN CASE WHEN v <= p25 THEN 30 WHEN v <= p50 THEN 20 WHEN v <= p75 THEN 10 ELSE 5 END END) AS rhr_points FROM
  (SELECT user_id, metric_type, arg_max(avg_value, date) AS v, quantile_cont(avg_value, 0.25) AS p25, quantile_cont(avg_value, 0.5) AS p50, quantile_cont(avg_value, 0.75) AS p75 FROM
    (SELECT *, first_value(unit) OVER (PARTITION BY user_id, metric_type ORDER BY n DESC, unit) AS best FROM (SELECT *, count(*) OVER (PARTITION BY user_id, metric_type, unit) AS n FROM tiered
      WHERE metric_type IN ('hrv', 'resting_hr') AND date BETWEEN DATE '2024-01-30' - 90 AND DATE '2024-01-30')) WHERE unit = best GROUP BY user_id, metric_type) GROUP BY user_id)
FULL JOIN (SELECT user_id, CASE WHEN hours >= 7.5 THEN 30 WHEN hours >= 6.5 THEN 20 WHEN hours >= 6 THEN 10 ELSE 5 END AS sleep_points FROM
  (SELECT user_id, arg_max(total_minutes, night) / 60 AS hours FROM nights WHERE night BETWEEN DATE '2024-01-30' - 90 AND DATE '2024-01-30' GROUP BY user_id)) USING (user_id)""")
def recovery_score_full(spark, sf_dir):
    return reports.recovery_score(_tiered(spark, sf_dir), sleep.sleep_nights(_sleep(spark, sf_dir), TZ), F.lit(AS_OF).cast("timestamp"), METRICS, TZ)


def _left(spark, sf_dir):
    """What compaction left raw: for users of odd number, summaries stand in for the steps, hrv and resting_hr of their days."""
    gone = summaries_of(spark, sf_dir).where("user_id % 2 = 1 and metric_type in ('steps', 'hrv', 'resting_hr')").select("user_id", "metric_type", "summary_date").distinct()
    s = samples_of(spark, sf_dir).withColumn("summary_date", local_day(F.col("started_at"), TZ))
    return s.join(gone, ["user_id", "metric_type", "summary_date"], "left_anti").drop("summary_date")


_LEFT = f""", left_raw AS (SELECT * FROM samples s WHERE NOT (user_id % 2 = 1 AND metric_type IN ('steps', 'hrv', 'resting_hr') AND EXISTS (SELECT 1 FROM summaries d WHERE d.user_id = s.user_id AND d.metric_type = s.metric_type AND d.date = {_LOCAL}::DATE)))"""


def _whole(hours: int, points: str, levels: str) -> str:
    """SQL of whole_summary over the last `hours`; points and levels differ with the window's length."""
    return _LEFT + f""", recent AS (SELECT * FROM left_raw WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL {hours} HOUR AND started_at <= TIMESTAMP '{AS_OF}'),
pts AS (SELECT *, count(*) OVER (PARTITION BY user_id, metric_type, unit) AS n, count(*) OVER (PARTITION BY user_id, metric_type) AS total FROM ({points}) WHERE metric_type IN ('steps', 'hrv', 'resting_hr')),
own AS (SELECT * FROM (SELECT *, first_value(unit) OVER (PARTITION BY user_id, metric_type ORDER BY n DESC, unit) AS best FROM pts) WHERE unit = best),
st AS (SELECT user_id, round(sum(sum_value), 0) AS steps_total, round(avg(sum_value), 1) AS steps_daily_avg, count(*) AS steps_days, any_value(unit) AS steps_unit, any_value(total) - any_value(n) AS other FROM own WHERE metric_type = 'steps' GROUP BY user_id),
tiers AS (SELECT user_id, count(*) FILTER (tier = 'summary') AS summary_points, count(*) FILTER (tier = 'raw') AS raw_points FROM own GROUP BY user_id),
lv AS ({levels}),
sl AS (SELECT user_id, count(*) AS sleep_records, count(*) FILTER (value IN (3, 4, 5)) AS stage_records FROM recent WHERE metric_type = 'sleep' GROUP BY user_id),
wo AS (SELECT user_id, count(*) AS workouts, string_agg(DISTINCT workout_type, ',' ORDER BY workout_type) AS workout_types FROM trips WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL {hours} HOUR AND started_at <= TIMESTAMP '{AS_OF}' GROUP BY user_id),
ever AS (SELECT user_id, bool_or(metric_type = 'steps') AS steps FROM (SELECT user_id, metric_type FROM left_raw UNION ALL SELECT user_id, metric_type FROM summaries) GROUP BY user_id)
SELECT c_custkey AS user_id, steps_total, steps_daily_avg, coalesce(steps_days, 0) AS steps_days, steps_unit, coalesce(other, 0)::BIGINT AS steps_other_unit_days, hrv_avg, hrv_latest, coalesce(hrv_n, 0)::BIGINT AS hrv_n, rhr_avg, rhr_latest, coalesce(rhr_n, 0)::BIGINT AS rhr_n,
coalesce(summary_points, 0) AS summary_points, coalesce(raw_points, 0) AS raw_points, coalesce(sleep_records, 0) AS sleep_records, coalesce(stage_records, 0) AS stage_records, coalesce(workouts, 0) AS workouts, coalesce(workout_types, '') AS workout_types,
CASE WHEN steps_days IS NOT NULL THEN NULL WHEN e.steps THEN 'empty_window' WHEN e.user_id IS NULL THEN 'no_data_yet' ELSE 'never_recorded' END AS steps_absence
FROM customer u LEFT JOIN st ON st.user_id = c_custkey LEFT JOIN tiers t ON t.user_id = c_custkey LEFT JOIN lv ON lv.user_id = c_custkey LEFT JOIN sl ON sl.user_id = c_custkey LEFT JOIN wo ON wo.user_id = c_custkey LEFT JOIN ever e ON e.user_id = c_custkey"""


def _whole_summary(spark, sf_dir, days):
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    catalog = spark.createDataFrame(CATALOG, "metric_type string, always_expected boolean, wearable boolean, evidence boolean")
    out = reports.whole_summary(_left(spark, sf_dir), summaries_of(spark, sf_dir), _trips(spark, sf_dir), users, catalog, F.lit(AS_OF).cast("timestamp"), METRICS, TZ, days, "event_id")
    return out.withColumn("workout_types", F.array_join("workout_types", ","))


@query(_whole(168, f"""SELECT user_id, metric_type, {_LOCAL}::DATE AS date, unit, round(sum(value), 4) AS sum_value, 'raw' AS tier FROM recent WHERE value IS NOT NULL GROUP BY ALL""", """SELECT user_id, round(avg(value) FILTER (metric_type = 'hrv'), 1) AS hrv_avg,
round(arg_max(value, (started_at, event_id)) FILTER (metric_type = 'hrv' AND value IS NOT NULL), 2) AS hrv_latest, count(value) FILTER (metric_type = 'hrv') AS hrv_n, round(avg(value) FILTER (metric_type = 'resting_hr'), 1) AS rhr_avg,
round(arg_max(value, (started_at, event_id)) FILTER (metric_type = 'resting_hr' AND value IS NOT NULL), 2) AS rhr_latest, count(value) FILTER (metric_type = 'resting_hr') AS rhr_n FROM recent GROUP BY user_id"""))
def health_summary_full(spark, sf_dir):
    return _whole_summary(spark, sf_dir, 7)


def _level(m: str, c: str) -> str:
    return f"""round(sum(sum_value) FILTER (metric_type = '{m}') / nullif(sum(sample_count) FILTER (metric_type = '{m}'), 0), 2) AS {c}_avg, round(arg_max(avg_value, date) FILTER (metric_type = '{m}'), 2) AS {c}_latest, sum(sample_count) FILTER (metric_type = '{m}') AS {c}_n"""


@query(_whole(90 * 24, "SELECT * FROM tiered WHERE date BETWEEN DATE '2024-01-30' - 90 AND DATE '2024-01-30'", f"SELECT user_id, {_level('hrv', 'hrv')}, {_level('resting_hr', 'rhr')} FROM own GROUP BY user_id"))
def health_summary_long(spark, sf_dir):
    return _whole_summary(spark, sf_dir, 90)


_HIGH = ", ".join(f"max(v) FILTER (metric_type = '{m}') AS {r}" for r, m in METRICS.items() if r not in ("sleep", "vo2"))


@query(_LEFT + f""", here AS (SELECT * FROM left_raw WHERE started_at >= TIMESTAMP '{_DAY} 05:00:00' AND started_at < TIMESTAMP '2024-01-17 05:00:00'),
pts AS (SELECT user_id, metric_type, unit, sum(value) AS total, arg_min(value, (started_at, event_id)) FILTER (value IS NOT NULL) AS level, count(value) AS n, 'raw' AS tier FROM here WHERE value IS NOT NULL GROUP BY user_id, metric_type, unit UNION ALL
  SELECT user_id, metric_type, unit, sum_value, avg_value, sample_count, 'summary' FROM summaries s WHERE date = DATE '{_DAY}' AND NOT EXISTS (SELECT 1 FROM here h WHERE h.user_id = s.user_id AND h.metric_type = s.metric_type AND h.value IS NOT NULL)),
chosen AS (SELECT *, CASE WHEN tier = 'summary' THEN round(CASE WHEN metric_type IN ('steps', 'active_energy') THEN total ELSE level END, 1) WHEN metric_type IN ('steps', 'active_energy') THEN round(total, 0) ELSE round(level, 2) END AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY n DESC, unit) AS rn FROM pts WHERE metric_type <> 'sleep') WHERE rn = 1),
high AS (SELECT user_id, {_HIGH}, CASE WHEN bool_or(tier = 'summary') THEN 'summary' ELSE 'raw' END AS highlights_tier FROM chosen GROUP BY user_id),
present AS (SELECT user_id, string_agg(DISTINCT metric_type, ',' ORDER BY metric_type) AS metrics_present FROM (SELECT user_id, metric_type FROM here UNION ALL SELECT user_id, metric_type FROM summaries WHERE date = DATE '{_DAY}') GROUP BY user_id),
rec AS (SELECT user_id, count(*) AS total_records, count(*) FILTER (metric_type = 'sleep') AS sleep_records, string_agg(metric_type || ':' || event_id || ':' || unit || ':' || coalesce(floor(value)::BIGINT, -1), ',' ORDER BY metric_type, started_at, event_id) AS all_values FROM here GROUP BY user_id),
wo AS (SELECT user_id, string_agg(workout_type || ':' || round(round(coalesce(duration_seconds, 0) / 60, 1) * 10, 0)::BIGINT, ',' ORDER BY started_at, workout_type) AS workouts FROM trips WHERE started_at >= TIMESTAMP '{_DAY} 05:00:00' AND started_at < TIMESTAMP '2024-01-17 05:00:00' GROUP BY user_id)
SELECT user_id, coalesce(total_records, 0) AS total_records, coalesce(sleep_records, 0) AS sleep_records, false AS truncated, metrics_present, steps, energy, hrv, rhr, weight, highlights_tier, coalesce(workouts, '') AS workouts, coalesce(all_values, '') AS all_values
FROM present LEFT JOIN rec USING (user_id) LEFT JOIN high USING (user_id) LEFT JOIN wo USING (user_id)""")
def daily_snapshot_full(spark, sf_dir):
    out = reports.whole_snapshot(_left(spark, sf_dir), summaries_of(spark, sf_dir), _trips(spark, sf_dir), _day(), METRICS, CUMULATIVE, TZ, tiebreak="event_id")
    value = lambda x: F.concat_ws(":", x["metric_type"], x["nth"].cast("string"), x["unit"], F.coalesce(F.floor(x["value"]), F.lit(-1)).cast("string"))
    trip = lambda x: F.concat_ws(":", x["workout_type"], F.round(x["duration_minutes"] * 10).cast("long").cast("string"))
    return out.withColumns({"metrics_present": F.array_join("metrics_present", ","), "workouts": F.array_join(F.transform("workouts", trip), ","), "all_values": F.array_join(F.transform("all_values", value), ",")})


_MARKS = f"""SELECT * FROM (SELECT user_id, round(arg_max(avg_value, date), 2) AS vo2_latest, arg_max(tier, date) AS vo2_tier FROM (SELECT * FROM (SELECT *, first_value(unit) OVER (PARTITION BY user_id ORDER BY n DESC, unit) AS best FROM
  (SELECT *, count(*) OVER (PARTITION BY user_id, unit) AS n FROM tiered WHERE metric_type = 'hrv' AND date BETWEEN DATE '2024-01-30' - 365 AND DATE '2024-01-30')) WHERE unit = best) GROUP BY user_id)
FULL JOIN (SELECT user_id, round(arg_max(value, started_at) FILTER (recent), 2) AS weight_latest, CASE WHEN count(*) FILTER (recent) > 1 THEN round(arg_min(value, started_at) FILTER (recent), 2) END AS weight_30d_ago
  FROM (SELECT *, metric_type = 'resting_hr' AND started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS recent FROM %s WHERE metric_type IN ('hrv', 'resting_hr') AND value IS NOT NULL AND started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) GROUP BY user_id) USING (user_id)"""


@query(_LEFT + _MARKS % "left_raw")
def fitness_markers_tiered(spark, sf_dir):
    return reports.fitness_markers(_left(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), METRICS, summaries_of(spark, sf_dir), TZ)


@query(f"""SELECT user_id, coalesce(status, 'none') AS status, last7_sleep_hours, coalesce(sleep_flag, 'no data') AS sleep_flag, newest7_hrv, earlier_hrv, sessions_30d, weekly_sessions, vo2_latest, vo2_tier, weight_latest, weight_30d_ago, hrv_latest, hrv_delta, rhr_latest, rhr_avg,
  hours_30d, by_type, steps_daily_avg, energy_daily_avg, CASE WHEN hrv_delta > 2 THEN 'up' WHEN hrv_delta < -2 THEN 'down' WHEN hrv_delta IS NOT NULL THEN 'flat' END AS hrv_trend
FROM ({ORACLES['coaching_brief']}) b FULL JOIN ({_MARKS % 'samples'}) m USING (user_id)
LEFT JOIN (SELECT user_id, round(arg_max(value, (started_at, event_id)) FILTER (metric_type = 'hrv' AND value IS NOT NULL), 2) AS hrv_latest, round(avg(value) FILTER (metric_type = 'hrv' AND rn <= 7) - avg(value) FILTER (metric_type = 'hrv' AND rn > 7), 1) AS hrv_delta,
  round(arg_max(value, (started_at, event_id)) FILTER (metric_type = 'resting_hr' AND value IS NOT NULL), 2) AS rhr_latest, round(avg(value) FILTER (metric_type = 'resting_hr'), 1) AS rhr_avg
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY started_at DESC, event_id) AS rn FROM samples WHERE metric_type IN ('hrv', 'resting_hr') AND started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND started_at <= TIMESTAMP '{AS_OF}') GROUP BY user_id) USING (user_id)
LEFT JOIN (SELECT user_id, round(sum(coalesce(seconds, 0)) / 3600, 1) AS hours_30d, string_agg(workout_type || ':' || n, ',' ORDER BY workout_type) AS by_type FROM (SELECT user_id, workout_type, count(*) AS n, sum(duration_seconds) AS seconds FROM trips
  WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND started_at <= TIMESTAMP '{AS_OF}' GROUP BY ALL) GROUP BY user_id) USING (user_id)
LEFT JOIN (SELECT user_id, round(avg(total) FILTER (metric_type = 'steps'), 1) AS steps_daily_avg, round(avg(total) FILTER (metric_type = 'active_energy'), 1) AS energy_daily_avg FROM (SELECT *, first_value(unit) OVER (PARTITION BY user_id, metric_type ORDER BY n DESC, unit) AS best FROM
  (SELECT *, count(*) OVER (PARTITION BY user_id, metric_type, unit) AS n FROM (SELECT user_id, metric_type, unit, {_LOCAL}::DATE AS date, round(sum(value), 4) AS total FROM samples
    WHERE metric_type IN ('steps', 'active_energy') AND value IS NOT NULL AND started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND started_at <= TIMESTAMP '{AS_OF}' GROUP BY ALL))) WHERE unit = best GROUP BY user_id) USING (user_id)""")
def coaching_brief_full(spark, sf_dir):
    out = reports.whole_brief(samples_of(spark, sf_dir), summaries_of(spark, sf_dir), _trips(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), METRICS, TZ, "event_id")
    told = F.transform(F.map_entries("by_type"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return out.withColumn("by_type", F.array_join(told, ","))

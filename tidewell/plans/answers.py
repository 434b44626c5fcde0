"""Registered queries over whole answers, units, activities and a resumable backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import ACTIVITIES, activity_name, unit_tables
from ..functions.numbers import rounded
from ..operators import answers, daily, sleep, upkeep
from ..sources.samples import to_preferred_units
from .registry import _series, _sleep, _table, _tiered, _trips, AS_OF, CATALOG, CUMULATIVE, METRICS, TZ, query, samples_of, summaries_of


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _people(spark, sf_dir):
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return users, spark.createDataFrame(CATALOG, "metric_type string, always_expected boolean, wearable boolean, evidence boolean")


def _ever(spark, sf_dir):
    return samples_of(spark, sf_dir).select("user_id", "metric_type")


_WHY = """, wide AS (SELECT u.c_custkey AS user_id, c.* FROM customer u CROSS JOIN (VALUES """ + ", ".join(map(str, CATALOG)) + """) c(metric_type, expected, wearable, evidence)),
ever AS (SELECT DISTINCT user_id, metric_type FROM samples), worn AS (SELECT user_id, bool_or(metric_type IN ('hrv', 'resting_hr')) AS worn FROM samples GROUP BY user_id),
why AS (SELECT user_id, metric_type, CASE WHEN NOT expected OR e.metric_type IS NOT NULL THEN 'empty_window' WHEN w.worn IS NULL THEN 'no_data_yet' WHEN wearable AND NOT w.worn THEN 'no_recording_device' ELSE 'never_recorded' END AS reason
  FROM wide LEFT JOIN ever e USING (user_id, metric_type) LEFT JOIN worn w USING (user_id))"""
_OWN = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY n DESC, unit) AS rn FROM (SELECT user_id, metric_type, unit, count(*) AS n FROM inside GROUP BY ALL)),
own AS (SELECT i.*, CASE WHEN i.metric_type IN ('steps', 'active_energy') THEN sum_value ELSE avg_value END AS v FROM inside i JOIN ranked r ON r.rn = 1 AND i.user_id = r.user_id AND i.metric_type = r.metric_type AND i.unit = r.unit)"""
_AVG = "CASE WHEN metric_type IN ('steps', 'active_energy') THEN round(avg(sum_value), 1) ELSE round(sum(sum_value) / nullif(sum(sample_count), 0), 2) END"
_TIERS = "count(*) FILTER (tier = 'summary') AS summary_points, count(*) FILTER (tier = 'raw') AS raw_points"
_FULL = "FROM told FULL JOIN why USING (user_id, metric_type)"


def _metric_answer(spark, sf_dir, days):
    return answers.metric_answer(samples_of(spark, sf_dir), summaries_of(spark, sf_dir), *_people(spark, sf_dir), _as_of(), CUMULATIVE, TZ, days, 50, "event_id")


@query(_WHY + f""", told AS (SELECT user_id, metric_type, count(*) AS count, round(avg(value), 2) AS avg, min(value) AS min, max(value) AS max FROM
(SELECT *, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY started_at DESC, event_id) AS rn FROM samples WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY AND started_at <= TIMESTAMP '{AS_OF}') WHERE rn <= 50 GROUP BY ALL)
SELECT user_id, metric_type, coalesce(count, 0) AS count, NULL::VARCHAR AS unit, avg, min, max, NULL::BIGINT AS summary_points, NULL::BIGINT AS raw_points, CASE WHEN count IS NULL THEN reason END AS absence, 'raw' AS granularity {_FULL}""")
def metric_answer_raw(spark, sf_dir):
    """The newest 50 samples of ten days."""
    return _metric_answer(spark, sf_dir, 10)


@query(_WHY + ", inside AS (SELECT * FROM tiered WHERE date BETWEEN DATE '2024-01-30' - 45 AND DATE '2024-01-30')" + _OWN + f""", told AS (SELECT user_id, metric_type, count(*) AS count, min(unit) AS unit, {_AVG} AS avg, min(min_value) AS min, max(max_value) AS max, {_TIERS} FROM own GROUP BY user_id, metric_type)
SELECT user_id, metric_type, coalesce(count, 0) AS count, unit, avg, min, max, summary_points, raw_points, CASE WHEN count IS NULL THEN reason END AS absence, 'daily' AS granularity {_FULL}""")
def metric_answer_daily(spark, sf_dir):
    """Daily points of 45 days."""
    return _metric_answer(spark, sf_dir, 45)


_P = ", ".join(f"round(quantile_cont(v, {p / 100}), 2) AS p{p}" for p in (10, 25, 50, 75, 90))


@query(_WHY + ", inside AS (SELECT * FROM tiered WHERE date BETWEEN DATE '2024-01-30' - 20 AND DATE '2024-01-30')" + _OWN + f""", told AS (SELECT user_id, metric_type, count(v) AS n, round(min(v), 2) AS min, round(max(v), 2) AS max, round(avg(v), 2) AS mean, round(stddev_pop(v), 2) AS std, {_P}, min(unit) AS unit, {_TIERS} FROM own GROUP BY user_id, metric_type)
SELECT user_id, metric_type, coalesce(n, 0) AS n, min, max, mean, std, p10, p25, p50, p75, p90, unit, summary_points, raw_points, CASE WHEN n IS NULL THEN reason END AS absence,
CASE WHEN metric_type IN ('steps', 'active_energy') THEN 'daily_total' ELSE 'daily_avg' END AS value_type, p75 AS good_day_above, p25 AS poor_day_below {_FULL}""")
def baselines(spark, sf_dir):
    return answers.baselines(_tiered(spark, sf_dir), *_people(spark, sf_dir), _ever(spark, sf_dir), _as_of(), CUMULATIVE, TZ, 20)


def _period(p: str, lo: str, hi: str) -> str:
    own = _OWN.replace("inside", f"inside_{p}").replace("ranked", f"ranked_{p}").replace("own AS", f"own_{p} AS")
    return f", inside_{p} AS (SELECT * FROM tiered WHERE date BETWEEN DATE '{lo}' AND DATE '{hi}')" + own + f", told_{p} AS (SELECT user_id, metric_type, count(v) AS n, {_AVG} AS avg, min(unit) AS unit FROM own_{p} GROUP BY user_id, metric_type)"


@query(_WHY + _period("a", "2024-01-03", "2024-01-09") + _period("b", "2024-01-24", "2024-01-30") + """SELECT user_id, metric_type, coalesce(a.n, 0) AS first_n, coalesce(b.n, 0) AS second_n, a.avg AS first_avg, b.avg AS second_avg, round(b.avg - a.avg, 2) AS delta,
CASE WHEN a.n IS NULL THEN reason END AS first_absence, CASE WHEN b.n IS NULL THEN reason END AS second_absence,
CASE WHEN round(b.avg - a.avg, 2) > 0 THEN 'second is higher than first' WHEN round(b.avg - a.avg, 2) < 0 THEN 'second is lower than first' WHEN b.avg - a.avg IS NOT NULL THEN 'second is the same as first' ELSE 'insufficient data' END AS verdict
FROM told_a a FULL JOIN told_b b USING (user_id, metric_type) FULL JOIN why USING (user_id, metric_type)""")
def periods_answer(spark, sf_dir):
    points = daily.daily_value(_tiered(spark, sf_dir), CUMULATIVE)
    out = answers.periods_answer(points, {"first": ("2024-01-03", "2024-01-09"), "second": ("2024-01-24", "2024-01-30")}, CUMULATIVE, *_people(spark, sf_dir), _ever(spark, sf_dir))
    return out.select("user_id", "metric_type", "first_n", "second_n", "first_avg", "second_avg", "delta", "first_absence", "second_absence", "verdict")


def _change(c: str) -> str:
    return f"round(100 * ({c} - previous_{c}) / nullif(previous_{c}::DOUBLE, 0), 1) AS {c}_change"


@query(f""", mine AS (SELECT *, coalesce(duration_seconds, 0) AS seconds, started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AS now FROM trips WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 28 DAY AND started_at <= TIMESTAMP '{AS_OF}'),
week AS (SELECT user_id, date_trunc('week', started_at)::DATE AS week, round(sum(seconds), 1) AS seconds FROM mine WHERE now GROUP BY ALL),
ends AS (SELECT DISTINCT user_id, first_value(week) OVER (PARTITION BY user_id ORDER BY seconds DESC, week) AS longest_week, first_value(week) OVER (PARTITION BY user_id ORDER BY seconds, week) AS shortest_week FROM week),
sides AS (SELECT user_id, count(*) FILTER (now) AS sessions, round(coalesce(sum(seconds) FILTER (now), 0) / 3600, 1) AS hours, count(DISTINCT workout_type) FILTER (now) AS types,
  count(*) FILTER (NOT now) AS previous_sessions, round(coalesce(sum(seconds) FILTER (NOT now), 0) / 3600, 1) AS previous_hours, count(DISTINCT workout_type) FILTER (NOT now) AS previous_types FROM mine GROUP BY user_id)
SELECT *, round(sessions * 7 / 14, 1) AS weekly_sessions, {_change("sessions")}, {_change("hours")} FROM sides LEFT JOIN ends USING (user_id)""")
def training_review(spark, sf_dir):
    """Two weeks against the two before."""
    return answers.training_review(_trips(spark, sf_dir), _as_of(), 14)


@query("""SELECT user_id, (deep >= 30)::INTEGER + (deep >= 60)::INTEGER AS band, count(*) AS pairs, round(avg(day_value), 2) AS second_mean FROM (SELECT user_id, night + 1 AS date, deep_minutes AS deep FROM nights)
JOIN (SELECT user_id, date, day_value FROM series WHERE metric_type = 'hrv') USING (user_id, date) WHERE day_value IS NOT NULL GROUP BY ALL""")
def deep_sleep_bands(spark, sf_dir):
    """Next day's hrv after nights with under 30, under 60, and more minutes of deep sleep."""
    deep = answers.night_points(sleep.sleep_nights(_sleep(spark, sf_dir), TZ), "deep_minutes", "deep")
    points = _series(spark, sf_dir).select(*deep.columns).unionByName(deep)
    return answers.banded_pair(points, "deep", "hrv", (30.0, 60.0))


@query(f"""SELECT user_id, hrv_avg, hrv_min, hrv_max, coalesce(hrv_days, 0) AS hrv_days, steps_avg, steps_total, coalesce(workouts, 0) AS workouts FROM
(SELECT user_id, round(avg(day_value) FILTER (metric_type = 'hrv'), 1) AS hrv_avg, round(min(day_value) FILTER (metric_type = 'hrv'), 1) AS hrv_min, round(max(day_value) FILTER (metric_type = 'hrv'), 1) AS hrv_max, count(day_value) FILTER (metric_type = 'hrv') AS hrv_days,
round(avg(day_value) FILTER (metric_type = 'steps'), 0) AS steps_avg, round(sum(day_value) FILTER (metric_type = 'steps'), 0) AS steps_total FROM series WHERE date BETWEEN DATE '2024-01-23' AND DATE '2024-01-30' GROUP BY user_id)
FULL JOIN (SELECT user_id, count(*) AS workouts FROM trips WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND started_at <= TIMESTAMP '{AS_OF}' GROUP BY user_id) USING (user_id)""")
def weekly_digest_full(spark, sf_dir):
    return answers.weekly_digest(_series(spark, sf_dir), _trips(spark, sf_dir), _as_of(), METRICS, TZ)


_Q = "HKQuantityTypeIdentifier"


@query("""SELECT event_id, user_id, round(CASE WHEN metric_type = 'steps' AND unit = 'g' THEN value / 1000 WHEN metric_type = 'active_energy' AND unit = 'kg' THEN value * 1000 WHEN metric_type = 'hrv' THEN value / 1000 ELSE value END, 4) AS value,
CASE metric_type WHEN 'steps' THEN 'kg' WHEN 'active_energy' THEN 'g' WHEN 'hrv' THEN 's' WHEN 'resting_hr' THEN 'count/min' ELSE unit END AS unit, metric_type = 'sleep' AS unsupported FROM samples""")
def preferred_units(spark, sf_dir):
    """Samples as body mass (kept in kg), protein (in g), heart rate, and metrics without a preferred unit."""
    m = F.col("metric_type")
    named = F.when(m == "steps", f"{_Q}BodyMass").when(m == "active_energy", f"{_Q}DietaryProtein").when(m == "resting_hr", f"{_Q}HeartRate").otherwise(m)
    out = to_preferred_units(samples_of(spark, sf_dir).withColumn("metric_type", named), *unit_tables(spark))
    return out.select("event_id", "user_id", rounded("value", 4).alias("value"), "unit", "unsupported")


@query("SELECT event_id, 'HKWorkoutActivityType' || coalesce(n, 'Unknown') AS activity FROM samples LEFT JOIN (VALUES " + ", ".join(str((c, n)) for c, n in ACTIVITIES.items() if n) + ") a(c, n) ON c = event_id % 90 WHERE metric_type = 'active_energy'")
def workout_activities(spark, sf_dir):
    return samples_of(spark, sf_dir).where("metric_type = 'active_energy'").select("event_id", activity_name(F.col("event_id") % 90).alias("activity"))


@query("""SELECT metric_type, chunk::INTEGER AS chunk, count(value_at) AS stored FROM (VALUES ('steps'), ('hrv'), ('sleep'), ('resting_hr'), ('active_energy'), ('mood')) c(metric_type) CROSS JOIN range(6) r(chunk)
LEFT JOIN (SELECT metric_type, started_at AS value_at, epoch_us(started_at - TIMESTAMP '2023-12-25') // (7 * 86400000000) AS chunk FROM samples) USING (metric_type, chunk) GROUP BY ALL""")
def backfill_resumed(spark, sf_dir):
    """A backfill in chunks of a week that stopped after the even chunks and was taken up again: the logs of both runs."""
    floor, until = (F.lit(d).cast("timestamp") for d in ("2023-12-25", "2024-02-05"))
    catalog = spark.createDataFrame([(m,) for m in ("steps", "hrv", "sleep", "resting_hr", "active_energy", "mood")], "metric_type string")
    none = spark.createDataFrame([], "metric_type string, chunk int")
    run = lambda p: upkeep.chunk_log(upkeep.backfill_chunks(samples_of(spark, sf_dir), p, floor, until, 7), p)
    first = run(upkeep.chunks_pending(catalog, floor, until, none, 7).where("chunk % 2 = 0"))
    return first.unionByName(run(upkeep.chunks_pending(catalog, floor, until, first, 7)))

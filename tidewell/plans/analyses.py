"""Registered queries over the analyses and the upkeep of a store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import local_day
from ..operators import analyses, sleep, store, upkeep
from ..schema import MERGED_SOURCE
from ..sources.samples import scan_samples, with_stage_names
from .registry import _GO, _LOCAL, _RUNS, _SUMMED, AS_OF, CUTOFF, KEPT_RAW, TZ, _merged, _points, _row, _ROW, _series, _sleep, _store, _summary, _trips, query, samples_of, summaries_of


#: With event_id % 3 = 0 as the batch, each row is in the store, in the batch, or in both.
_STORED = "event_id % 3 <> 0 or event_id % 2 = 0"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


@query(_RUNS.format("""(SELECT user_id, 'steps and hrv' AS metric_type, date FROM series WHERE (metric_type = 'steps' AND day_value > 100) OR (metric_type = 'hrv' AND day_value < 300)
GROUP BY user_id, date HAVING count(DISTINCT metric_type) = 2)""", 2))
def joint_runs(spark, sf_dir):
    v = F.col("day_value")
    return analyses.joint_runs(_series(spark, sf_dir), ("steps", v > 100), ("hrv", v < 300), 2)


@query("""SELECT user_id, count(*) AS nights, round(avg(bedtime), 1) AS mean_bedtime, round(CASE WHEN isfinite(corr(bedtime, deep)) THEN corr(bedtime, deep) END, 4) AS corr FROM
(SELECT user_id, epoch_us((min(started_at) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') - night::TIMESTAMP) / 60e6 AS bedtime, coalesce(sum(minutes) FILTER (value = 4), 0) AS deep FROM staged GROUP BY user_id, night) GROUP BY user_id""")
def bedtime_and_deep(spark, sf_dir):
    return analyses.bedtime_and_deep(_sleep(spark, sf_dir), TZ)


@query("SELECT user_id, isodow(night)::INTEGER AS weekday, count(*) AS nights, round(avg(total_minutes) / 60, 2) AS mean_hours FROM nights GROUP BY ALL")
def weekday_pattern(spark, sf_dir):
    return analyses.weekday_pattern(sleep.sleep_nights(_sleep(spark, sf_dir), TZ))


@query("""SELECT * FROM (SELECT user_id, metric_type, date, day_value, CASE WHEN metric_type = 'hrv' AND day_value < 50 THEN 'low' WHEN metric_type = 'resting_hr' AND day_value > 300 THEN 'high' WHEN metric_type = 'resting_hr' AND day_value < 20 THEN 'low' END AS alert
FROM series WHERE date = DATE '2024-01-15') WHERE alert IS NOT NULL""")
def threshold_alerts(spark, sf_dir):
    return analyses.alerts(_series(spark, sf_dir), F.lit("2024-01-15").cast("date"), {"hrv": (50.0, None), "resting_hr": (20.0, 300.0)})


@query("""SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.month, b.month) AS month, mean, coalesce(sessions, 0) AS sessions FROM
(SELECT user_id, strftime(date, '%Y-%m') AS month, round(avg(day_value), 2) AS mean FROM series WHERE metric_type = 'hrv' GROUP BY ALL) a
FULL JOIN (SELECT user_id, strftime(started_at, '%Y-%m') AS month, count(*) AS sessions FROM trips GROUP BY ALL) b ON a.user_id = b.user_id AND a.month = b.month""")
def monthly_beside_sessions(spark, sf_dir):
    return analyses.monthly_beside_sessions(_series(spark, sf_dir), _trips(spark, sf_dir), "hrv")


@query("""SELECT user_id, metric_type, count(day_value) AS n, CASE WHEN count(DISTINCT date) > 1 THEN round(regr_slope(day_value, (date - DATE '2000-01-01')::DOUBLE) * 30, 2) END AS per_30_days FROM series GROUP BY ALL""")
def monthly_slope(spark, sf_dir):
    return analyses.monthly_slope(_series(spark, sf_dir))


@query(f"""SELECT *, ((TIMESTAMP '{AS_OF}' AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE - last_day)::INTEGER AS days_ago FROM
(SELECT user_id, metric_type, count(*) AS rows, (max(started_at) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE AS last_day FROM samples GROUP BY user_id, metric_type)""")
def staleness(spark, sf_dir):
    return analyses.staleness(samples_of(spark, sf_dir), _as_of(), TZ)


@query("""SELECT user_id, count(*) AS weeks, round(avg(v) FILTER (heavy), 2) AS after_heavy, round(avg(v) FILTER (NOT heavy), 2) AS after_others FROM
(SELECT user_id, week + 7 AS week, seconds > avg(seconds) OVER (PARTITION BY user_id) AS heavy FROM (SELECT user_id, date_trunc('week', started_at)::DATE AS week, sum(duration_seconds) AS seconds FROM trips GROUP BY ALL))
JOIN (SELECT user_id, date_trunc('week', date)::DATE AS week, avg(day_value) AS v FROM series WHERE metric_type = 'hrv' GROUP BY ALL) USING (user_id, week) GROUP BY user_id""")
def after_heavy_weeks(spark, sf_dir):
    return analyses.after_heavy_weeks(_trips(spark, sf_dir), _series(spark, sf_dir), "hrv")


@query("""SELECT user_id, strftime(date, '%Y-%m') AS month, round(avg(day_value) FILTER (metric_type = 'hrv'), 2) AS hrv, round(avg(day_value) FILTER (metric_type = 'resting_hr'), 2) AS resting_hr
FROM series WHERE metric_type IN ('hrv', 'resting_hr') GROUP BY ALL""")
def metrics_by_month(spark, sf_dir):
    return analyses.metrics_by_month(_series(spark, sf_dir), ("hrv", "resting_hr"))


_METRICS = [("steps", True), ("hrv", False), ("vo2_max", True), ("mood", False)]


@query("""SELECT c.metric_type, coalesce(n, 0) AS stored, earliest, latest, CASE WHEN n IS NOT NULL THEN 'stored' WHEN expected THEN 'empty but expected' ELSE 'empty' END AS outcome FROM (VALUES """ + ", ".join(map(str, _METRICS)) + f""") c(metric_type, expected)
LEFT JOIN (SELECT metric_type, count(*) AS n, epoch_us(min(started_at)) // 1000000 AS earliest, epoch_us(max(started_at)) // 1000000 AS latest FROM samples WHERE started_at >= TIMESTAMP '2023-01-31' AND started_at < TIMESTAMP '{CUTOFF}' GROUP BY ALL) s ON s.metric_type = c.metric_type""")
def backfill_status(spark, sf_dir):
    rows = upkeep.backfill(samples_of(spark, sf_dir), upkeep.horizon_floor(_as_of()), F.lit(CUTOFF).cast("timestamp"))
    return upkeep.backfill_status(rows, spark.createDataFrame(_METRICS, "metric_type string, always_expected boolean"))


@query(f"SELECT {_ROW} FROM samples WHERE metric_type IN ('steps', 'resting_hr')")
def essentials(spark, sf_dir):
    catalog = spark.createDataFrame([("steps", True), ("resting_hr", True), ("hrv", False)], "metric_type string, is_essential boolean")
    return _row(upkeep.essentials(samples_of(spark, sf_dir), catalog))


@query(f"""SELECT metric_type, count(*) AS rows, count(DISTINCT user_id) AS users, CASE metric_type WHEN 'sleep' THEN 'skip' WHEN 'steps' THEN 'recompute' ELSE 'compact' END AS mode
FROM samples WHERE started_at < TIMESTAMP '{CUTOFF} 05:00:00' GROUP BY ALL""")
def compaction_plan(spark, sf_dir):
    return upkeep.compaction_plan(samples_of(spark, sf_dir), F.lit(f"{CUTOFF} 05:00:00").cast("timestamp"), ("steps",), ("sleep",))


@query("""SELECT p.user_id, p.metric_type, p.date AS summary_date, p.unit, p.sum_value, p.sample_count FROM points p LEFT JOIN summaries s USING (user_id, metric_type, date, unit) WHERE s.user_id IS NULL OR p.user_id % 5 = 0""")
def changed_summaries(spark, sf_dir):
    stored = summaries_of(spark, sf_dir).withColumn("max_value", F.when(F.col("user_id") % 5 == 0, None).otherwise(F.col("max_value")))
    return upkeep.changed_summaries(stored, _points(spark, sf_dir).withColumnRenamed("date", "summary_date")).select("user_id", "metric_type", "summary_date", "unit", "sum_value", "sample_count")


@query("""SELECT metric_type, count(*) AS posted, count(*) FILTER (user_id % 7 = 0) AS rejected, count(*) FILTER (user_id % 7 <> 0 AND event_id % 2 = 1) AS inserted, count(*) FILTER (user_id % 7 <> 0 AND event_id % 2 = 0) AS replaced
FROM samples WHERE event_id % 3 = 0 GROUP BY ALL""")
def batch_log(spark, sf_dir):
    s = samples_of(spark, sf_dir)
    batch = s.where("event_id % 3 = 0").withColumn("metadata", F.when(F.col("user_id") % 7 == 0, F.repeat(F.lit("x"), 5000)).otherwise(F.col("metadata")))
    return upkeep.batch_log(store.validate(batch), s.where(_STORED))


@query(f"SELECT {_ROW} FROM samples s WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.user_id % 2 = 0 AND m.user_id = s.user_id AND m.metric_type = s.metric_type AND m.started_at = date_trunc('hour', s.started_at)) UNION ALL SELECT {_ROW} FROM merged WHERE user_id % 2 = 0")
def repair_hours(spark, sf_dir):
    return _row(upkeep.repair_hours(_store(spark, sf_dir)))


@query(f"SELECT {_ROW} FROM samples WHERE event_id % 3 = 0 AND event_id % 2 = 1")
def append_missing(spark, sf_dir):
    s = samples_of(spark, sf_dir)
    return _row(store.missing_only(s.where(_STORED), s.where("event_id % 3 = 0")))


@query(f"""SELECT {_ROW} FROM (SELECT * EXCLUDE (event_id) FROM samples WHERE event_id % 3 <> 0 UNION ALL SELECT * EXCLUDE (event_id) REPLACE (value + 1 AS value) FROM samples WHERE event_id % 3 = 0)""")
def upsert_samples_all(spark, sf_dir):
    """upsert_samples over the whole table: each row is in the store, in the batch, or in both."""
    s = samples_of(spark, sf_dir)
    batch = s.where("event_id % 3 = 0").withColumn("value", F.col("value") + 1)
    return _row(store.upserted(s.where(_STORED).drop("event_id"), batch.drop("event_id")))


@query(f"""SELECT user_id, metric_type, summary_date, unit, {_SUMMED} FROM (SELECT *, bool_and(source_device = '{MERGED_SOURCE}') OVER (PARTITION BY user_id, metric_type, summary_date) AS clean FROM
(SELECT *, {_LOCAL}::DATE AS summary_date FROM merged UNION ALL SELECT * FROM (SELECT * EXCLUDE (event_id), {_LOCAL}::DATE AS summary_date FROM samples) WHERE metric_type <> 'steps' OR user_id % 3 <> 0 OR day(summary_date) % 4 = 0)) WHERE clean GROUP BY user_id, metric_type, summary_date, unit""")
def recompute_summaries_all(spark, sf_dir):
    """recompute_summaries with all device rows but those that merging has replaced: every fourth day of merged users still has both."""
    s = samples_of(spark, sf_dir).withColumn("day", local_day(F.col("started_at"), TZ))
    device = s.where((F.col("metric_type") != "steps") | (F.col("user_id") % 3 != 0) | (F.dayofmonth("day") % 4 == 0)).drop("event_id", "day")
    return _summary(store.recompute_summaries(_merged(spark, sf_dir).unionByName(device), TZ))


@query(f"""SELECT user_id, metric_type, count(*) AS rows, count(DISTINCT {_LOCAL}::DATE) AS days FROM samples WHERE NOT ({_GO}) GROUP BY ALL""")
def rows_left_raw(spark, sf_dir):
    """What compaction leaves in the raw tier."""
    from ..functions.time import day_bounds_utc, local_day

    cutoff = day_bounds_utc(F.lit(CUTOFF).cast("date"), TZ)[0]
    left = scan_samples(samples_of(spark, sf_dir)).where(~store.to_compact(cutoff, _as_of(), kept_raw=KEPT_RAW))
    return left.groupBy("user_id", "metric_type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(local_day(F.col("started_at"), TZ)).alias("days"))


@query("""SELECT event_id, user_id, (metadata->>'k')::DOUBLE AS k, 'HKCategoryValueSleepAnalysis' || CASE value WHEN 0 THEN 'InBed' WHEN 1 THEN 'AsleepUnspecified' WHEN 2 THEN 'Awake' WHEN 3 THEN 'AsleepCore' WHEN 4 THEN 'AsleepDeep' ELSE 'AsleepREM' END AS sleep_stage FROM samples WHERE metric_type = 'sleep'""")
def sleep_stage_names(spark, sf_dir):
    m = F.from_json("metadata", "k double, sleep_stage string")
    return with_stage_names(_sleep(spark, sf_dir), "sleep").select("event_id", "user_id", m["k"].alias("k"), m["sleep_stage"].alias("sleep_stage"))

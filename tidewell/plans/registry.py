"""Registered queries over the given tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.time import top_k_per, touched_hours
from ..operators import daily, quality, reports, sleep, store, workouts
from ..schema import MERGED_SOURCE
from ..sources.samples import normalise_units, scan_samples
from ..sources.tables import scratch

TZ = "America/New_York"
AS_OF, CUTOFF = "2024-01-31 00:00:00", "2024-01-21"
CUMULATIVE = ("steps", "active_energy")
#: Roles of the reports; the events have no vo2 and weight, so two other level metrics stand in.
METRICS = {"steps": "steps", "energy": "active_energy", "hrv": "hrv", "rhr": "resting_hr", "sleep": "sleep", "vo2": "hrv", "weight": "resting_hr"}
#: The events' metrics have plain names.
PLAIN_METRICS = r"^[a-z_]+$"
QUERIES: dict = {}
ORACLES: dict = {}


def _plain(sql: str) -> str:
    """round(x, n) of the SQL as the library rounds: at nine decimals first."""
    out, at = "", 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue
        depth, i, comma = 1, m.end(), 0
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        out += sql[at : m.start()] + f"round(({_plain(sql[m.end() : comma])})::DECIMAL(28,9), {sql[comma + 1 : i - 1].strip()})::DOUBLE"
        at = i
    return out + sql[at:]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _plain(f"WITH {_CTE}\n{sql}")
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as samples."""
    e, t = _table(spark, sf_dir, "events"), F.col("event_type")
    ts, i = F.col("ts").cast("timestamp"), F.col("event_id")
    metric = F.when(t == "view", "steps").when(t == "click", "active_energy").when(t == "purchase", "hrv").when(t == "signup", "resting_hr").otherwise("sleep")
    unit = F.when(t.isin("view", "click"), F.when(i % 10 == 0, "kg").otherwise("g")).when(t == "purchase", "ms").when(t == "signup", "bpm").otherwise("stage")
    device = F.when(i % 4 == 0, "Oura Ring").when(i % 4 == 1, "Apple Watch").when(i % 4 == 2, "iPhone").otherwise("Polar")
    return e.select(
        "event_id", "user_id", metric.alias("metric_type"), F.when(t == "error", (i % 6).cast("double")).otherwise(F.col("value")).alias("value"), unit.alias("unit"), device.alias("source_device"),
        ts.alias("started_at"), F.timestamp_add("MINUTE", (1 + i % 90).cast("int"), ts).alias("ended_at"), F.col("props").alias("metadata"), F.timestamp_add("HOUR", (i % 48).cast("int"), ts).alias("synced_at"),
    )


def _points(spark, sf_dir):
    return daily.daily_points(samples_of(spark, sf_dir), TZ)


def summaries_of(spark, sf_dir) -> DataFrame:
    p = _points(spark, sf_dir).where((F.col("date") < F.lit(CUTOFF).cast("date")) & (F.dayofmonth("date") % 3 != 0))
    return p.withColumnRenamed("date", "summary_date")


def _tiered(spark, sf_dir):
    return daily.tiered_daily(samples_of(spark, sf_dir), summaries_of(spark, sf_dir), TZ)


def _series(spark, sf_dir):
    return daily.daily_value(daily.single_unit(_tiered(spark, sf_dir)), CUMULATIVE)


def units_of(spark) -> DataFrame:
    """Masses in grams; other units are their own."""
    return spark.createDataFrame([("kg", "g", 1000.0), ("g", "g", 1.0)], "unit string, canonical string, factor double")


def _merged(spark, sf_dir) -> DataFrame:
    """Merged hourly step totals of every third user."""
    s = samples_of(spark, sf_dir).where((F.col("metric_type") == "steps") & (F.col("user_id") % 3 == 0))
    h = store.hourly_totals(normalise_units(s, units_of(spark)).drop("unsupported"))
    return h.select("user_id", "metric_type", "value", "unit", F.lit(MERGED_SOURCE).alias("source_device"), "started_at", (F.col("started_at") + F.expr("INTERVAL 1 HOUR")).alias("ended_at"), F.lit(None).cast("string").alias("metadata"), (F.col("started_at") + F.expr("INTERVAL 2 HOURS")).alias("synced_at"))


def _store(spark, sf_dir) -> DataFrame:
    """Device rows and, for users of even number, merged hours beside them."""
    return samples_of(spark, sf_dir).drop("event_id").unionByName(_merged(spark, sf_dir).where("user_id % 2 = 0"))


_LOCAL = "(started_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
_CTE = f"""
samples AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'steps' WHEN 'click' THEN 'active_energy' WHEN 'purchase' THEN 'hrv' WHEN 'signup' THEN 'resting_hr' ELSE 'sleep' END AS metric_type,
  CASE WHEN event_type = 'error' THEN (event_id % 6)::DOUBLE ELSE value END AS value,
  CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN event_id % 10 = 0 THEN 'kg' ELSE 'g' END WHEN event_type = 'purchase' THEN 'ms' WHEN event_type = 'signup' THEN 'bpm' ELSE 'stage' END AS unit,
  CASE event_id % 4 WHEN 0 THEN 'Oura Ring' WHEN 1 THEN 'Apple Watch' WHEN 2 THEN 'iPhone' ELSE 'Polar' END AS source_device,
  ts AS started_at, ts + INTERVAL 1 MINUTE * (1 + event_id % 90) AS ended_at, props AS metadata, ts + INTERVAL 1 HOUR * (event_id % 48) AS synced_at FROM events),
points AS (SELECT user_id, metric_type, {_LOCAL}::DATE AS date, unit, round(avg(value), 4) AS avg_value, min(value) AS min_value, max(value) AS max_value, round(sum(value), 4) AS sum_value, count(value) AS sample_count
  FROM samples WHERE value IS NOT NULL GROUP BY ALL),
summaries AS (SELECT * FROM points WHERE date < DATE '{CUTOFF}' AND day(date) % 3 <> 0),
tiered AS (SELECT *, 'summary' AS tier FROM summaries UNION ALL
  SELECT *, 'raw' FROM points p WHERE NOT EXISTS (SELECT 1 FROM summaries s WHERE s.user_id = p.user_id AND s.metric_type = p.metric_type AND s.date = p.date)),
votes AS (SELECT *, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY n DESC, unit) AS rn, sum(n) OVER (PARTITION BY user_id, metric_type)::BIGINT AS total FROM (SELECT user_id, metric_type, unit, count(*) AS n FROM tiered GROUP BY ALL)),
series AS (SELECT t.*, CASE WHEN metric_type IN ('steps', 'active_energy') THEN sum_value ELSE avg_value END AS day_value FROM tiered t JOIN (SELECT user_id, metric_type, unit FROM votes WHERE rn = 1) v USING (user_id, metric_type, unit)),
merged AS (SELECT user_id, metric_type, round(sum(CASE unit WHEN 'kg' THEN 1000 * value ELSE value END), 4) AS value, 'g' AS unit, '{MERGED_SOURCE}' AS source_device, date_trunc('hour', started_at) AS started_at, date_trunc('hour', started_at) + INTERVAL 1 HOUR AS ended_at, NULL::VARCHAR AS metadata, date_trunc('hour', started_at) + INTERVAL 2 HOUR AS synced_at
  FROM samples WHERE metric_type = 'steps' AND user_id % 3 = 0 GROUP BY user_id, metric_type, date_trunc('hour', started_at)),
store AS (SELECT user_id, metric_type, value, unit, source_device, started_at, ended_at, metadata, synced_at FROM samples UNION ALL SELECT * FROM merged WHERE user_id % 2 = 0),
asleep AS (SELECT *, ({_LOCAL} - INTERVAL 6 HOUR)::DATE AS night, epoch_us(ended_at - started_at) / 60e6 AS minutes,
  CASE WHEN source_device ILIKE '%oura%' THEN 0 WHEN source_device ILIKE '%apple watch%' THEN 1 WHEN source_device ILIKE '%whoop%' THEN 2 WHEN source_device ILIKE '%garmin%' THEN 3 WHEN source_device ILIKE '%withings%' THEN 4 ELSE 5 END AS rank
  FROM samples WHERE metric_type = 'sleep' AND value IN (3, 4, 5)),
best AS (SELECT user_id, night, source_device FROM (SELECT user_id, night, source_device, row_number() OVER (PARTITION BY user_id, night ORDER BY min(rank), count(*) DESC, source_device) AS rn FROM asleep GROUP BY user_id, night, source_device) WHERE rn = 1),
staged AS (SELECT a.* FROM asleep a JOIN best USING (user_id, night, source_device)),
nights AS (SELECT user_id, night, source_device, round(sum(minutes), 1) AS total_minutes, round(coalesce(sum(minutes) FILTER (value = 3), 0), 1) AS core_minutes, round(coalesce(sum(minutes) FILTER (value = 4), 0), 1) AS deep_minutes,
  round(coalesce(sum(minutes) FILTER (value = 5), 0), 1) AS rem_minutes, count(*) AS segments FROM staged GROUP BY ALL),
trips AS (SELECT user_id, started_at, CASE WHEN event_id % 3 = 0 THEN 'Running' WHEN event_id % 3 = 1 THEN 'Cycling' ELSE 'unknown' END AS workout_type, coalesce((metadata->>'k')::DOUBLE * 60, value) AS duration_seconds FROM samples WHERE metric_type = 'active_energy')
"""


def _sleep(spark, sf_dir):
    return scan_samples(samples_of(spark, sf_dir), "sleep")


def _trips(spark, sf_dir) -> DataFrame:
    """Active-energy samples as workouts, k minutes long."""
    s = scan_samples(samples_of(spark, sf_dir), "active_energy")
    kind = F.when(F.col("event_id") % 3 == 0, "Running").when(F.col("event_id") % 3 == 1, "Cycling")
    payload = F.to_json(F.struct(kind.alias("workout_type"), (F.from_json("metadata", "k double")["k"] * 60).alias("duration_seconds")))
    return workouts.workouts(s.withColumn("metadata", payload))


_POINT = "user_id, metric_type, date, unit, avg_value, min_value, max_value, sum_value, sample_count"


@query(f"SELECT {_POINT} FROM points")
def daily_points(spark, sf_dir):
    return _points(spark, sf_dir)


@query(f"SELECT {_POINT}, tier FROM tiered")
def tiered_daily(spark, sf_dir):
    return _tiered(spark, sf_dir)


@query("SELECT user_id, metric_type, unit, n AS points, (total - n)::BIGINT AS other_points FROM votes WHERE rn = 1")
def single_unit(spark, sf_dir):
    return daily.unit_votes(_tiered(spark, sf_dir))


@query("SELECT user_id, metric_type, count(*) FILTER (tier = 'summary') AS summary_points, count(*) FILTER (tier = 'raw') AS raw_points FROM tiered GROUP BY ALL")
def tier_status(spark, sf_dir):
    return daily.tier_status(_tiered(spark, sf_dir))


@query("""SELECT user_id, metric_type, count(day_value) AS n, round(min(day_value), 2) AS min, round(max(day_value), 2) AS max, round(avg(day_value), 2) AS mean, round(stddev_pop(day_value), 2) AS std,
round(quantile_cont(day_value, 0.1), 2) AS p10, round(quantile_cont(day_value, 0.25), 2) AS p25, round(quantile_cont(day_value, 0.5), 2) AS p50, round(quantile_cont(day_value, 0.75), 2) AS p75, round(quantile_cont(day_value, 0.9), 2) AS p90 FROM series GROUP BY ALL""")
def metric_stats(spark, sf_dir):
    return daily.metric_stats(_series(spark, sf_dir))


@query("SELECT user_id, metric_type, round(sum(sum_value) / nullif(sum(sample_count), 0), 2) AS weighted_mean, round(avg(sum_value), 1) AS mean_daily_total FROM series GROUP BY ALL")
def level_means(spark, sf_dir):
    return _series(spark, sf_dir).groupBy("user_id", "metric_type").agg(daily.weighted_mean().alias("weighted_mean"), rounded(F.avg("sum_value"), 1).alias("mean_daily_total"))


@query("""SELECT user_id, metric_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY started_at DESC, event_id) AS rn FROM samples WHERE started_at >= TIMESTAMP '2024-01-24') WHERE rn <= 20""")
def metric_series(spark, sf_dir):
    s = scan_samples(samples_of(spark, sf_dir), since=F.lit("2024-01-24").cast("timestamp"))
    return top_k_per(s, ["user_id", "metric_type"], [F.col("started_at").desc(), F.col("event_id")], 20).select("user_id", "metric_type", "event_id", "value")


@query("""SELECT user_id, metric_type, date, day_value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY day_value DESC, date)::INTEGER AS rank FROM series WHERE day_value >= 100) WHERE rank <= 10""")
def threshold_days(spark, sf_dir):
    return daily.threshold_days(_series(spark, sf_dir), low=100, limit=10).select("user_id", "metric_type", "date", "day_value", "rank")


@query("""SELECT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 2) AS mean, round(min(o_totalprice), 2) AS min, round(max(o_totalprice), 2) AS max, count(DISTINCT o_orderdate::DATE) AS days, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS sources FROM orders GROUP BY ALL""")
def long_term_trend(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        rounded(F.avg("o_totalprice"), 2).alias("mean"), rounded(F.min("o_totalprice"), 2).alias("min"), rounded(F.max("o_totalprice"), 2).alias("max"), F.count_distinct(F.to_date("o_orderdate")).alias("days"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("sources")
    )


@query("SELECT user_id, metric_type, date_trunc('week', date)::DATE::VARCHAR AS bucket, round(avg(day_value), 2) AS mean, count(DISTINCT date) AS days FROM series GROUP BY ALL")
def period_rollup(spark, sf_dir):
    return daily.period_rollup(_series(spark, sf_dir), "week")


@query("""SELECT o_custkey AS user_id, 'order' AS metric_type, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'autumn' END AS bucket, round(avg(o_totalprice), 2) AS mean, count(DISTINCT o_orderdate::DATE) AS days FROM orders GROUP BY ALL""")
def seasonal_comparison(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.lit("order").alias("metric_type"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("day_value"))
    return daily.period_rollup(o, "season")


@query("""SELECT *, round(b_avg - a_avg, 2) AS delta, round(100 * round(b_avg - a_avg, 2) / nullif(a_avg, 0), 1) AS pct_change FROM (SELECT user_id, metric_type,
count(day_value) FILTER (date BETWEEN '2024-01-02' AND '2024-01-12') AS a_n, round(avg(day_value) FILTER (date BETWEEN '2024-01-02' AND '2024-01-12'), 2) AS a_avg,
count(day_value) FILTER (date BETWEEN '2024-01-13' AND '2024-01-23') AS b_n, round(avg(day_value) FILTER (date BETWEEN '2024-01-13' AND '2024-01-23'), 2) AS b_avg FROM series WHERE date BETWEEN '2024-01-02' AND '2024-01-23' GROUP BY ALL)""")
def compare_periods(spark, sf_dir):
    return daily.compare_periods(_series(spark, sf_dir), {"a": ("2024-01-02", "2024-01-12"), "b": ("2024-01-13", "2024-01-23")})


#: A day counts with its mean of one decimal; the difference is that of the unrounded means of the days.
_HALVES = """(SELECT *, CASE WHEN delta > 0 THEN 'improving' WHEN delta < 0 THEN 'declining' WHEN delta = 0 THEN 'stable' END AS trend FROM
(SELECT user_id, metric_type, points, round(r, 2) AS recent, round(p, 2) AS prior, CASE WHEN points >= 14 THEN round(r - p, 1) END AS delta FROM
(SELECT user_id, metric_type, count(*) AS points, avg(day) FILTER (rn <= 7) AS r, avg(day) FILTER (rn > 7) AS p FROM
(SELECT *, round(avg_value, 1) AS day, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY date DESC, unit) AS rn FROM series WHERE date >= DATE '{}') WHERE rn <= 14 GROUP BY ALL)))"""


@query("SELECT * FROM " + _HALVES.format("1900-01-01"))
def trend_7v7(spark, sf_dir):
    return daily.trend_halves(_series(spark, sf_dir))


@query(f"""SELECT user_id, metric_type, days_with_data, avg, latest, unit, summary_points, raw_points, delta, trend FROM (SELECT user_id, metric_type, count(*) AS days_with_data, round(sum(sum_value) / nullif(sum(sample_count), 0), 2) AS avg,
round(arg_max(avg_value, date), 1) AS latest, any_value(unit) AS unit, count(*) FILTER (tier = 'summary') AS summary_points, count(*) FILTER (tier = 'raw') AS raw_points FROM series WHERE date >= DATE '2024-01-06' GROUP BY ALL)
LEFT JOIN {_HALVES.format("2024-01-06")} USING (user_id, metric_type)""")
def metric_trend(spark, sf_dir):
    """The trend of every metric as one answer."""
    return daily.trend_answer(_series(spark, sf_dir), F.lit("2024-01-06").cast("date"))


@query("SELECT * FROM nights")
def sleep_nights(spark, sf_dir):
    return sleep.sleep_nights(_sleep(spark, sf_dir), TZ)


@query("""SELECT user_id, night, round(sum(minutes) / 60, 2) AS hours, round(coalesce(sum(minutes) FILTER (value = 4), 0), 1) AS deep_minutes, round(coalesce(sum(minutes) FILTER (value = 5), 0), 1) AS rem_minutes, count(*) AS segments FROM asleep WHERE source_device ILIKE '%oura%' GROUP BY ALL""")
def sleep_nightly_view(spark, sf_dir):
    n = sleep.stage_rows(scan_samples(_sleep(spark, sf_dir), source="oura"), TZ)
    part = lambda v: rounded(F.coalesce(F.sum(F.when(F.col("value") == v, F.col("minutes"))), F.lit(0.0)), 1)
    return n.groupBy("user_id", "night").agg(rounded(F.sum("minutes") / 60, 2).alias("hours"), part(4.0).alias("deep_minutes"), part(5.0).alias("rem_minutes"), F.count(F.lit(1)).alias("segments"))


@query("SELECT user_id, night, CASE value WHEN 3 THEN 'core' WHEN 4 THEN 'deep' ELSE 'rem' END AS stage, (epoch_us(started_at) // 1000000) AS start_epoch, round(minutes, 1) AS duration_minutes FROM staged")
def sleep_segments(spark, sf_dir):
    return sleep.segments(_sleep(spark, sf_dir), TZ)


@query("""SELECT user_id, count(*) AS nights, round(avg(total_minutes / 60) FILTER (total_minutes > 0), 1) AS avg_hours, round(sum(deep_minutes) / nullif(sum(total_minutes), 0), 3) AS deep_share, round(sum(rem_minutes) / nullif(sum(total_minutes), 0), 3) AS rem_share,
count(*) FILTER (deep_minutes < 45) AS low_deep_nights, arg_max(night, (total_minutes, night)) AS best_night, arg_min(night, (total_minutes, night)) AS worst_night FROM nights GROUP BY user_id""")
def sleep_review(spark, sf_dir):
    return sleep.sleep_review(sleep.sleep_nights(_sleep(spark, sf_dir), TZ))


@query("SELECT user_id, (epoch_us(started_at) // 1000000) AS start_epoch, workout_type, duration_seconds, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY duration_seconds DESC, started_at)::INTEGER AS rank FROM trips) WHERE rank <= 5")
def longest_workouts(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.col("duration_seconds").desc(), "started_at")
    return _trips(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("user_id", F.unix_timestamp("started_at").alias("start_epoch"), "workout_type", "duration_seconds", "rank")


@query("SELECT *, round(sessions / sum(sessions) OVER (PARTITION BY user_id), 4) AS share FROM (SELECT user_id, workout_type, count(*) AS sessions, round(avg(duration_seconds), 1) AS mean_seconds FROM trips GROUP BY ALL)")
def workout_type_counts(spark, sf_dir):
    return workouts.type_counts(_trips(spark, sf_dir))


@query("""SELECT w.*, p.seconds AS previous_seconds FROM (SELECT user_id, date_trunc('week', started_at)::DATE AS week, round(sum(duration_seconds), 1) AS seconds, count(*) AS sessions FROM trips GROUP BY ALL) w
LEFT JOIN (SELECT user_id, date_trunc('week', started_at)::DATE + 7 AS week, round(sum(duration_seconds), 1) AS seconds FROM trips GROUP BY ALL) p USING (user_id, week)""")
def weekly_volume(spark, sf_dir):
    return workouts.weekly_volume(_trips(spark, sf_dir))


@query("""SELECT user_id, f.date, count(*) AS sessions, round(sum(duration_seconds), 1) AS seconds FROM (SELECT DISTINCT user_id, date FROM series WHERE metric_type = 'hrv' AND day_value < 100) f JOIN trips t USING (user_id)
WHERE t.started_at < f.date AND t.started_at >= f.date - INTERVAL 48 HOUR GROUP BY ALL""")
def preceding_events(spark, sf_dir):
    return workouts.preceding(_series(spark, sf_dir).where("metric_type = 'hrv' and day_value < 100"), _trips(spark, sf_dir))


@query("""SELECT user_id, round(sum(value) FILTER (metric_type = 'steps'), 0) AS steps, round(sum(value) FILTER (metric_type = 'active_energy'), 0) AS energy, round(arg_min(value, (started_at, event_id)) FILTER (metric_type = 'hrv'), 2) AS first_hrv,
count(*) FILTER (metric_type = 'sleep') AS sleep_records, count(DISTINCT metric_type) AS metrics FROM samples WHERE started_at >= TIMESTAMP '2024-01-15 05:00:00' AND started_at < TIMESTAMP '2024-01-16 05:00:00' GROUP BY user_id""")
def daily_snapshot(spark, sf_dir):
    return reports.daily_snapshot(samples_of(spark, sf_dir), F.lit("2024-01-15").cast("date"), METRICS, TZ, "event_id")


@query(f"""SELECT user_id, round(sum(value) FILTER (metric_type = 'steps'), 1) AS steps_total, count(DISTINCT {_LOCAL}::DATE) FILTER (metric_type = 'steps') AS steps_days, round(avg(value) FILTER (metric_type = 'hrv'), 1) AS hrv_avg,
round(arg_max(value, (started_at, event_id)) FILTER (metric_type = 'hrv'), 2) AS hrv_latest, count(*) FILTER (metric_type = 'hrv') AS hrv_n, round(avg(value) FILTER (metric_type = 'resting_hr'), 1) AS rhr_avg,
count(*) FILTER (metric_type = 'sleep') AS sleep_records, count(*) FILTER (metric_type = 'sleep' AND value IN (3, 4, 5)) AS stage_records FROM samples WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR GROUP BY user_id""")
def health_summary(spark, sf_dir):
    return reports.health_summary(samples_of(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), METRICS, TZ, tiebreak="event_id")


@query(f"""SELECT u.user_id, f.status, s.hours AS last7_sleep_hours, CASE WHEN s.hours IS NULL THEN 'no data' WHEN s.hours >= 7.5 THEN 'good' WHEN s.hours >= 6.5 THEN 'borderline' ELSE 'poor' END AS sleep_flag, h.recent AS newest7_hrv, h.rest AS earlier_hrv,
CASE WHEN h.recent - h.rest > 2 THEN 'up' WHEN h.recent - h.rest < -2 THEN 'down' WHEN h.rest IS NOT NULL THEN 'flat' END AS hrv_trend, t.sessions AS sessions_30d, round(t.sessions / 4.3, 1) AS weekly_sessions
FROM (SELECT DISTINCT user_id FROM samples) u
JOIN (SELECT user_id, CASE WHEN epoch(TIMESTAMP '{AS_OF}' - max(started_at)) <= 48 * 3600 THEN 'fresh' ELSE 'stale' END AS status FROM samples GROUP BY user_id) f USING (user_id)
LEFT JOIN (SELECT user_id, round(avg(total_minutes / 60), 1) AS hours FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY night DESC) AS rn FROM nights) WHERE rn <= 7 GROUP BY user_id) s USING (user_id)
LEFT JOIN (SELECT user_id, round(avg(value) FILTER (rn <= 7), 2) AS recent, round(avg(value) FILTER (rn > 7), 2) AS rest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, event_id) AS rn FROM samples WHERE metric_type = 'hrv' AND started_at >= TIMESTAMP '2024-01-17') GROUP BY user_id) h USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS sessions FROM trips GROUP BY user_id) t USING (user_id)""")
def coaching_brief(spark, sf_dir):
    return reports.coaching_brief(samples_of(spark, sf_dir), _trips(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), METRICS, TZ, "event_id")


@query(f"SELECT user_id, round(epoch(TIMESTAMP '{AS_OF}' - max(started_at)) / 3600, 1) AS age_hours, CASE WHEN epoch(TIMESTAMP '{AS_OF}' - max(started_at)) / 3600 <= 48 THEN 'fresh' ELSE 'stale' END AS status FROM samples GROUP BY user_id")
def freshness(spark, sf_dir):
    return quality.freshness(samples_of(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))


CATALOG = [("steps", True, False, False), ("hrv", True, True, True), ("resting_hr", True, True, True), ("active_energy", False, False, False), ("sleep", False, True, False), ("vo2_max", True, True, False)]


@query("""SELECT u.c_custkey AS user_id, c.metric_type, CASE WHEN w.user_id IS NOT NULL THEN NULL WHEN NOT expected OR e.user_id IS NOT NULL THEN 'empty_window' WHEN f.user_id IS NULL THEN 'no_data_yet' WHEN wearable AND NOT f.worn THEN 'no_recording_device' ELSE 'never_recorded' END AS reason
FROM (SELECT c_custkey FROM customer) u CROSS JOIN (VALUES """ + ", ".join(str(r) for r in CATALOG) + """) c(metric_type, expected, wearable, evidence)
LEFT JOIN (SELECT DISTINCT user_id, metric_type FROM samples WHERE started_at >= TIMESTAMP '2024-01-28') w ON w.user_id = u.c_custkey AND w.metric_type = c.metric_type
LEFT JOIN (SELECT DISTINCT user_id, metric_type FROM samples) e ON e.user_id = u.c_custkey AND e.metric_type = c.metric_type
LEFT JOIN (SELECT user_id, bool_or(metric_type IN ('hrv', 'resting_hr')) AS worn FROM samples GROUP BY user_id) f ON f.user_id = u.c_custkey""")
def absence_status(spark, sf_dir):
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    catalog = spark.createDataFrame(CATALOG, "metric_type string, always_expected boolean, wearable boolean, evidence boolean")
    s = samples_of(spark, sf_dir)
    return quality.absence(users, catalog, scan_samples(s, since=F.lit("2024-01-28").cast("timestamp")), s)


@query("SELECT metric_type, count(*) AS rows, count(DISTINCT user_id) AS users, (epoch_us(min(started_at)) // 1000000) AS earliest, (epoch_us(max(started_at)) // 1000000) AS latest FROM samples GROUP BY ALL")
def metric_inventory(spark, sf_dir):
    return quality.metric_inventory(samples_of(spark, sf_dir))


@query("SELECT user_id, metric_type, source_device, (epoch_us(hour) // 1000000) AS hour_epoch, event_id FROM (SELECT *, date_trunc('hour', started_at) AS hour, row_number() OVER (PARTITION BY user_id, metric_type, source_device, date_trunc('hour', started_at) ORDER BY event_id DESC) AS rn FROM samples) WHERE rn = 1")
def dedupe_latest(spark, sf_dir):
    s = samples_of(spark, sf_dir).withColumn("started_at", F.date_trunc("hour", "started_at"))
    return store.dedupe_latest(s, F.col("event_id")).select("user_id", "metric_type", "source_device", F.unix_timestamp("started_at").alias("hour_epoch"), "event_id")


@query(f"""SELECT user_id, metric_type, source_device, (epoch_us(started_at) // 1000000) AS start_epoch, value, CASE WHEN user_id % 11 = 0 THEN 'no metric' WHEN user_id % 7 = 0 THEN 'metadata too large' WHEN source_device = '{MERGED_SOURCE}' AND user_id % 4 = 0 THEN 'not a whole hour' END AS reject_reason FROM store""")
def validate_samples(spark, sf_dir):
    s, u = _store(spark, sf_dir), F.col("user_id")
    bad = s.withColumns({
        "metric_type": F.when(u % 11 == 0, " ").otherwise(F.col("metric_type")), "metadata": F.when(u % 7 == 0, F.repeat(F.lit("x"), 5000)).otherwise(F.col("metadata")),
        "ended_at": F.when(u % 4 == 0, F.col("started_at")).otherwise(F.col("ended_at")), "real": F.col("metric_type"),
    })
    out = store.validate(bad, allowed_merged=("steps",))
    return out.select("user_id", F.col("real").alias("metric_type"), "source_device", F.unix_timestamp("started_at").alias("start_epoch"), "value", "reject_reason")


@query("SELECT user_id, metric_type, (epoch_us(h) // 1000000) AS hour_epoch, count(*) AS rows FROM (SELECT user_id, metric_type, unnest(generate_series(date_trunc('hour', started_at), date_trunc('hour', ended_at - INTERVAL 1 MICROSECOND), INTERVAL 1 HOUR)) AS h FROM samples) GROUP BY ALL")
def touched_hours_count(spark, sf_dir):
    s = samples_of(spark, sf_dir)
    return s.select("user_id", "metric_type", F.explode(touched_hours(F.col("started_at"), F.col("ended_at"))).alias("h")).groupBy("user_id", "metric_type", F.unix_timestamp("h").alias("hour_epoch")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT user_id, metric_type, (epoch_us(date_trunc('hour', started_at)) // 1000000) AS hour_epoch, unit, round(coalesce(sum(value), 0), 4) AS value, count(*) AS device_rows FROM samples GROUP BY ALL")
def hourly_totals(spark, sf_dir):
    return store.hourly_totals(samples_of(spark, sf_dir)).select("user_id", "metric_type", F.unix_timestamp("started_at").alias("hour_epoch"), "unit", "value", "device_rows")


_ROW = "user_id, metric_type, round(value, 4) AS value, unit, source_device, (epoch_us(started_at) // 1000000) AS start_epoch"


def _row(df):
    return df.select("user_id", "metric_type", rounded("value", 4).alias("value"), "unit", "source_device", F.unix_timestamp("started_at").alias("start_epoch"))


@query(f"SELECT {_ROW} FROM samples s WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.user_id = s.user_id AND m.metric_type = s.metric_type AND m.started_at = date_trunc('hour', s.started_at)) UNION ALL SELECT {_ROW} FROM merged")
def replace_merged_hours(spark, sf_dir):
    return _row(store.replace_merged_hours(_store(spark, sf_dir), _merged(spark, sf_dir)))


@query(f"SELECT {_ROW} FROM samples s WHERE EXISTS (SELECT 1 FROM merged m WHERE m.user_id % 2 = 0 AND m.user_id = s.user_id AND m.metric_type = s.metric_type AND s.started_at >= m.started_at AND s.started_at < m.ended_at)")
def double_counted(spark, sf_dir):
    return _row(store.double_counted(_store(spark, sf_dir)))


_SUMMED = "round(min(value), 4) AS min_value, round(max(value), 4) AS max_value, round(sum(value), 2) AS sum_value, count(value) AS sample_count, round(sum(value) / count(value), 2) AS avg_value"


def _summary(df):
    return df.select("user_id", "metric_type", "summary_date", "unit", rounded("min_value", 4).alias("min_value"), rounded("max_value", 4).alias("max_value"), rounded("sum_value", 2).alias("sum_value"), "sample_count", rounded("avg_value", 2).alias("avg_value"))


@query(f"""SELECT user_id, metric_type, summary_date, unit, {_SUMMED} FROM (SELECT *, {_LOCAL}::DATE AS summary_date, bool_and(source_device = '{MERGED_SOURCE}') OVER (PARTITION BY user_id, metric_type, {_LOCAL}::DATE) AS clean FROM
(SELECT * FROM merged UNION ALL SELECT user_id, metric_type, value, unit, source_device, started_at, ended_at, metadata, synced_at FROM samples WHERE event_id % 5 = 0)) WHERE clean GROUP BY user_id, metric_type, summary_date, unit""")
def recompute_summaries(spark, sf_dir):
    mixed = _merged(spark, sf_dir).unionByName(samples_of(spark, sf_dir).where("event_id % 5 = 0").drop("event_id"))
    return _summary(store.recompute_summaries(mixed, TZ))


#: Never compacted: sleep is a category, steps are merged hours.
KEPT_RAW = ("sleep", "steps")
_GO = f"metric_type NOT IN {KEPT_RAW} AND started_at < TIMESTAMP '{CUTOFF} 05:00:00' AND synced_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR"


def _compacted(spark, sf_dir):
    from ..functions.time import day_bounds_utc

    cutoff = day_bounds_utc(F.lit(CUTOFF).cast("date"), TZ)[0]
    return store.compact(samples_of(spark, sf_dir), summaries_of(spark, sf_dir), cutoff, F.lit(AS_OF).cast("timestamp"), TZ, kept_raw=KEPT_RAW)


@query(f"""SELECT user_id, metric_type, summary_date, unit, round(min(lo), 4) AS min_value, round(max(hi), 4) AS max_value, round(sum(s), 2) AS sum_value, sum(n)::BIGINT AS sample_count, round(sum(s) / sum(n), 2) AS avg_value FROM
(SELECT user_id, metric_type, date AS summary_date, unit, min_value AS lo, max_value AS hi, sum_value AS s, sample_count AS n FROM summaries UNION ALL
SELECT user_id, metric_type, {_LOCAL}::DATE, unit, min(value), max(value), sum(value), count(value) FROM samples WHERE {_GO} GROUP BY ALL) GROUP BY ALL""")
def compact_samples(spark, sf_dir):
    return _summary(_compacted(spark, sf_dir)[1])


@query(f"""SELECT coalesce(r.user_id, d.user_id) AS user_id, coalesce(r.metric_type, d.metric_type) AS metric_type, coalesce(rn, 0) AS raw_rows, coalesce(dn, 0)::BIGINT AS summary_rows, round(coalesce(rs, 0) + coalesce(ds, 0), 2) AS total_sum FROM
(SELECT user_id, metric_type, count(value) AS rn, sum(value) AS rs FROM samples WHERE NOT ({_GO}) GROUP BY ALL) r FULL JOIN
(SELECT user_id, metric_type, sum(n) AS dn, sum(s) AS ds FROM (SELECT user_id, metric_type, sum_value AS s, sample_count AS n FROM summaries UNION ALL SELECT user_id, metric_type, value, 1 FROM samples WHERE {_GO}) GROUP BY ALL) d
ON r.user_id = d.user_id AND r.metric_type = d.metric_type""")
def compaction_totals(spark, sf_dir):
    return store.compaction_totals(*_compacted(spark, sf_dir))


@query("""SELECT p.user_id, p.metric_type, p.date AS summary_date, p.unit, p.sample_count FROM points p LEFT JOIN (SELECT *, CASE WHEN user_id % 5 = 0 THEN sum_value + 1 ELSE sum_value END AS stored FROM summaries) s USING (user_id, metric_type, date, unit)
WHERE s.stored IS NULL OR abs(p.sum_value - s.stored) > 1e-6 OR p.sample_count <> s.sample_count""")
def recompute_mismatches(spark, sf_dir):
    stored = summaries_of(spark, sf_dir).withColumn("sum_value", F.when(F.col("user_id") % 5 == 0, F.col("sum_value") + 1).otherwise(F.col("sum_value")))
    return store.recompute_mismatches(_points(spark, sf_dir).withColumnRenamed("date", "summary_date"), stored).select("user_id", "metric_type", "summary_date", "unit", "sample_count")


_RUNS = """SELECT user_id, metric_type, min(date) AS first_day, max(date) AS last_day, count(*) AS days FROM (SELECT *, date - (row_number() OVER (PARTITION BY user_id, metric_type ORDER BY date))::INTEGER AS island FROM (SELECT DISTINCT user_id, metric_type, date FROM {0})) GROUP BY user_id, metric_type, island HAVING count(*) >= {1}"""


@query(_RUNS.format("series WHERE day_value > 50", 3))
def streaks(spark, sf_dir):
    return daily.runs(_series(spark, sf_dir), F.col("day_value") > 50, 3)


@query(_RUNS.format("(SELECT *, lag(day_value) OVER (PARTITION BY user_id, metric_type ORDER BY date) AS before FROM series) WHERE day_value < before", 2))
def declining_runs(spark, sf_dir):
    from pyspark.sql import Window

    s = _series(spark, sf_dir).withColumn("before", F.lag("day_value").over(Window.partitionBy("user_id", "metric_type").orderBy("date")))
    return daily.runs(s, F.col("day_value") < F.col("before"), 2)


@query("""SELECT user_id, count(*) AS pairs, round(avg(a), 2) AS first_mean, round(avg(b), 2) AS second_mean, round(CASE WHEN isfinite(corr(a, b)) THEN corr(a, b) END, 4) AS corr FROM (SELECT user_id, date + 1 AS date, avg(day_value) AS a FROM series WHERE metric_type = 'steps' GROUP BY ALL)
JOIN (SELECT user_id, date, avg(day_value) AS b FROM series WHERE metric_type = 'hrv' GROUP BY ALL) USING (user_id, date) GROUP BY user_id""")
def lagged_pair(spark, sf_dir):
    return daily.lagged_pair(_series(spark, sf_dir), "steps", "hrv")


@query("SELECT user_id, metric_type, date, day_value, round(own_mean, 2) AS own_mean FROM (SELECT *, avg(day_value) OVER (PARTITION BY user_id, metric_type) AS own_mean FROM series) WHERE day_value < 0.8 * own_mean")
def below_average_days(spark, sf_dir):
    return daily.below_average_days(_series(spark, sf_dir)).select("user_id", "metric_type", "date", "day_value", "own_mean")


@query("""SELECT user_id, (CASE WHEN v >= p75 THEN 40 WHEN v >= p50 THEN 30 WHEN v >= p25 THEN 20 ELSE 10 END + CASE WHEN coalesce(hours, 0) >= 7.5 THEN 30 WHEN coalesce(hours, 0) >= 6.5 THEN 20 ELSE 10 END)::INTEGER AS score FROM
(SELECT user_id, arg_max(day_value, date) AS v, quantile_cont(day_value, 0.25) AS p25, quantile_cont(day_value, 0.5) AS p50, quantile_cont(day_value, 0.75) AS p75 FROM series WHERE metric_type = 'hrv' GROUP BY user_id)
LEFT JOIN (SELECT user_id, arg_max(total_minutes, night) / 60 AS hours FROM nights GROUP BY user_id) USING (user_id)""")
def recovery_score(spark, sf_dir):
    """hrv and sleep only, as its SQL; recovery_score_full has all three parts."""
    return reports.level_and_sleep_score(_series(spark, sf_dir), sleep.sleep_nights(_sleep(spark, sf_dir), TZ), "hrv")


@query(f"""SELECT user_id, round(avg(day_value) FILTER (metric_type = 'hrv'), 2) AS hrv_avg, round(min(day_value) FILTER (metric_type = 'hrv'), 2) AS hrv_min, round(max(day_value) FILTER (metric_type = 'hrv'), 2) AS hrv_max,
round(avg(day_value) FILTER (metric_type = 'steps'), 2) AS steps_avg, round(sum(day_value) FILTER (metric_type = 'steps'), 2) AS steps_total FROM series WHERE date >= DATE '2024-01-24' GROUP BY user_id""")
def weekly_digest(spark, sf_dir):
    s = _series(spark, sf_dir).where(F.col("date") >= F.lit("2024-01-24").cast("date"))
    of = lambda m: F.when(F.col("metric_type") == m, F.col("day_value"))
    return s.groupBy("user_id").agg(
        rounded(F.avg(of("hrv")), 2).alias("hrv_avg"), rounded(F.min(of("hrv")), 2).alias("hrv_min"), rounded(F.max(of("hrv")), 2).alias("hrv_max"), rounded(F.avg(of("steps")), 2).alias("steps_avg"), rounded(F.sum(of("steps")), 2).alias("steps_total")
    )


@query("SELECT user_id, metric_type, event_id, round(CASE unit WHEN 'kg' THEN value * 1000 ELSE value END, 4) AS value, CASE unit WHEN 'kg' THEN 'g' ELSE unit END AS unit, unit NOT IN ('g', 'kg') AS unsupported FROM samples")
def normalised_units(spark, sf_dir):
    return normalise_units(samples_of(spark, sf_dir), units_of(spark)).select("user_id", "metric_type", "event_id", rounded("value", 4).alias("value"), "unit", "unsupported")


@query("""SELECT event_id, user_id, metric_type, source_device FROM samples s WHERE NOT EXISTS (SELECT 1 FROM samples b WHERE b.user_id = s.user_id AND b.metric_type = s.metric_type AND b.event_id % 4 < s.event_id % 4 AND b.started_at < s.ended_at AND s.started_at < b.ended_at)""")
def drop_overlaps(spark, sf_dir):
    s = samples_of(spark, sf_dir)
    order = functools.reduce(operator.add, [F.when(F.col("source_device") == d, i).otherwise(0) for i, d in enumerate(("Oura Ring", "Apple Watch", "iPhone", "Polar"))])
    return store.drop_overlaps(s, order).select("event_id", "user_id", "metric_type", "source_device")


@query(f"SELECT {_ROW} FROM samples s WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def erase_users(spark, sf_dir):
    gone = _table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("user_id"))
    return _row(store.erase_users(samples_of(spark, sf_dir), gone))


@query(f"""SELECT {_ROW} FROM (SELECT * EXCLUDE (event_id) FROM samples WHERE event_id % 2 = 0 AND event_id % 3 <> 0 UNION ALL SELECT * EXCLUDE (event_id) REPLACE (value + 1 AS value) FROM samples WHERE event_id % 3 = 0)""")
def upsert_samples(spark, sf_dir):
    s = samples_of(spark, sf_dir)
    batch = s.where("event_id % 3 = 0").withColumn("value", F.col("value") + 1)
    return _row(store.upserted(s.where("event_id % 2 = 0").drop("event_id"), batch.drop("event_id")))


def _payload_files(spark, sf_dir) -> str:
    """The events as payload files in a scratch folder, some rows sent twice."""
    path = scratch(spark, "payloads")
    s = samples_of(spark, sf_dir)
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c)
    row = F.struct("metric_type", "value", "unit", F.concat("source_device", F.lit(" "), F.col("user_id").cast("string")).alias("source_device"), at("started_at"), at("ended_at"), "metadata")
    sent = s.unionByName(s.where("event_id % 10 = 0"))
    sent.withColumn("file", F.pmod(F.hash("event_id"), F.lit(4))).groupBy("file", F.expr("event_id div 400").alias("part")).agg(F.collect_list(row).alias("samples")).select("samples").write.json(path)
    return path


@query(f"SELECT metric_type, round(value, 4) AS value, unit, source_device || ' ' || user_id AS source_device, (epoch_us(started_at) // 1000000) AS start_epoch FROM samples")
def ingest_stream(spark, sf_dir):
    """The events sent as payload files, drained by the stream into a store by metric and day, and read back."""
    from ..streaming.ingest import ingest_stream as run
    from ..streaming.ingest import read_store

    at = scratch(spark, "store")
    run(spark, _payload_files(spark, sf_dir), at, scratch(spark, "offsets"), "u1", pattern=PLAIN_METRICS).awaitTermination()
    return _row(read_store(spark, at)).drop("user_id")


@query(f"""SELECT metric_type, round(value, 4) AS value, unit, source_device, (epoch_us(started_at) // 1000000) AS start_epoch, CASE WHEN metric_type = 'sleep' THEN 'skipped' WHEN metric_type = 'hrv' THEN 'refused' END AS reason FROM samples""")
def read_export_xml(spark, sf_dir):
    """The events written as an XML export and read with the skip and refuse lists."""
    from ..sources.samples import read_export_xml as read

    at, s = scratch(spark, "export"), samples_of(spark, sf_dir)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss '+0000'")
    s.select(F.col("metric_type").alias("_type"), F.col("value").alias("_value"), F.col("unit").alias("_unit"), F.col("source_device").alias("_sourceName"), stamp("started_at").alias("_startDate"), stamp("ended_at").alias("_endDate"), F.lit("x").alias("note")).write.format("xml").option("rootTag", "HealthData").option("rowTag", "Record").save(at)
    out = read(spark, at, skip=("sle",), refuse=("hrv",))
    return out.select("metric_type", rounded("value", 4).alias("value"), "unit", "source_device", F.unix_timestamp("started_at").alias("start_epoch"), "reason")

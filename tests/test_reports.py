"""Golden values of the reports."""

import datetime

from pyspark.sql import functions as F

from tidewell.operators import daily, reports, workouts
from tidewell.schema import SAMPLES

T = datetime.datetime


def rows(spark, data):
    """(user, metric, value, unit, start, metadata)"""
    return spark.createDataFrame([(u, m, v, unit, "w", at, at + datetime.timedelta(minutes=1), meta, at) for u, m, v, unit, at, meta in data], SAMPLES)


def tiered(spark, data):
    s = rows(spark, data)
    none = daily.daily_points(s).limit(0).withColumnRenamed("date", "summary_date")
    return daily.daily_value(daily.tiered_daily(s, none), ("steps",))


def test_trend_window_is_held_to_its_limits(spark):
    at = F.lit("2024-01-31").cast("timestamp")
    got = spark.range(1).select(*[F.date_diff(at, reports.trend_start(at, m)) for m in (-3, 1, 24, 60, 61, 500)]).first()
    assert tuple(got) == (30, 30, 720, 1800, 1825, 1825)


def test_monthly_means_weigh_samples_and_total_steps(spark):
    day = lambda d, h: T(2024, 1, d, h)
    p = tiered(spark, [("u", "hr", 60.0, "bpm", day(1, 1), None), ("u", "hr", 60.0, "bpm", day(1, 2), None), ("u", "hr", 90.0, "bpm", day(2, 1), None), ("u", "steps", 100.0, "count", day(1, 1), None), ("u", "steps", 200.0, "count", day(1, 2), None), ("u", "steps", 100.0, "count", T(2024, 2, 1), None)])
    got = {(r.metric_type, r.month): (r.avg, r.days_with_data, r.tiers) for r in reports.monthly_trend(p, F.lit("2024-01-01").cast("date"), ("steps",)).collect()}
    assert got == {("hr", "2024-01"): (70.0, 2, ["raw"]), ("steps", "2024-01"): (300.0, 1, ["raw"]), ("steps", "2024-02"): (100.0, 1, ["raw"])}
    r = reports.trend_overview(p, F.lit("2024-01-01").cast("date"), ("steps",)).where("metric_type = 'steps'").first()
    assert (r.avg, r.min, r.max, r.days_with_data, r.summary_points, r.raw_points) == (200.0, 100.0, 200.0, 2, 0, 2)


def test_an_empty_period_gives_no_verdict_and_each_has_its_own_unit(spark):
    at = lambda d: T(2024, 1, d, 5)
    p = tiered(spark, [("u", "w", 80.0, "kg", at(1), None), ("u", "w", 176.0, "lb", at(1), None), ("u", "w", 81.0, "kg", at(2), None), ("u", "w", 82.0, "kg", at(3), None), ("v", "w", 70.0, "kg", at(1), None)])
    got = {r.user_id: r for r in reports.period_report(p, {"old": ("2024-01-01", "2024-01-02"), "new": ("2024-01-02", "2024-01-03")}, ("steps",)).collect()}
    u, v = got["u"], got["v"]
    assert (u.old_unit, u.old_n, u.old_avg, u.new_avg, u.delta, u.pct_change, u.verdict) == ("kg", 2, 80.5, 81.5, 1.0, 1.2, "new is higher than old")
    assert (v.old_avg, v.new_n, v.new_avg, v.delta, v.verdict) == (70.0, None, None, None, "insufficient data")


def test_a_day_falls_back_to_summaries_by_metric(spark):
    s = rows(spark, [("u", "hr", 60.0, "bpm", T(2024, 1, 5, 1), None), ("u", "hr", 61.0, "bpm", T(2024, 1, 6, 1), None)])
    old = daily.daily_points(rows(spark, [("u", "hr", 99.0, "bpm", T(2024, 1, 5, 1), None), ("u", "steps", 7.0, "count", T(2024, 1, 5, 1), None)])).withColumnRenamed("date", "summary_date")
    day = F.lit("2024-01-05").cast("date")
    assert {(r.metric_type, r.sum_value, r.tier) for r in reports.day_points(s, old, day).collect()} == {("hr", 60.0, "raw"), ("steps", 7.0, "summary")}
    assert reports.day_points(s.limit(0), old.limit(0), day).count() == 0
    r = reports.day_rows(s, day, max_rows=1).collect()
    assert [(x.value, x.truncated) for x in r] == [(60.0, False)]


def test_workouts_in_minutes_and_kilometres(spark):
    s = rows(spark, [("u", "workout", 600.0, "seconds", T(2024, 1, 5, 1), '{"workout_type": "Run", "duration_seconds": 1830, "total_distance_meters": 5004.0}'), ("u", "workout", 600.0, "seconds", T(2024, 1, 6, 1), '{"total_distance_meters": 0}'), ("u", "workout", None, "seconds", T(2024, 1, 7, 1), None)])
    listed = reports.workout_list(workouts.workouts(s), 20)
    assert [(r.rank, r.workout_type, r.duration_minutes, r.distance_km) for r in listed.orderBy("rank").collect()] == [(1, "unknown", 0.0, None), (2, "unknown", 10.0, None), (3, "Run", 30.5, 5.0)]
    t = reports.workout_totals(listed).first()
    assert (t.total_workouts, t.total_hours, t.by_type) == (3, 0.7, {"Run": 1, "unknown": 2})


def test_latest_values_skip_nulls_and_old_weight_needs_two_rows(spark):
    m = {"steps": "steps", "energy": "energy", "hrv": "hrv", "rhr": "rhr", "sleep": "sleep", "vo2": "vo2", "weight": "weight"}
    at = F.lit("2024-01-31").cast("timestamp")
    s = rows(spark, [("u", "hrv", 40.0, "ms", T(2024, 1, 29), None), ("u", "hrv", None, "ms", T(2024, 1, 30), None), ("u", "weight", 80.0, "kg", T(2024, 1, 10), None), ("u", "weight", 79.0, "kg", T(2024, 1, 20), None), ("u", "vo2", 50.0, "", T(2023, 6, 1), None), ("u", "vo2", 51.0, "", T(2022, 6, 1), None), ("v", "weight", 70.0, "kg", T(2024, 1, 20), None)])
    r = reports.health_summary(s, at, m).first()
    assert (r.user_id, r.hrv_latest, r.hrv_n, r.sleep_records) == ("u", 40.0, 1, 0)
    got = {r.user_id: tuple(r)[1:] for r in reports.fitness_markers(s, at, m).collect()}
    assert got == {"u": (50.0, 79.0, 80.0), "v": (None, 70.0, None)}
    b = {r.user_id: r for r in reports.coaching_brief(s, workouts.workouts(s.limit(0)), at, m).collect()}
    assert (b["u"].status, b["v"].status, b["u"].sleep_flag, b["u"].newest7_hrv, b["u"].sessions_30d) == ("fresh", "stale", "no data", 40.0, None)


def test_recovery_score_has_all_three_parts_of_90_days(spark):
    m = {"hrv": "hrv", "rhr": "rhr"}
    data = [(u, k, v, unit, T(2024, 1, d, 1), None) for u in ("u", "v") for k, unit, values in (("hrv", "ms", (40.0, 50.0, 60.0, 70.0, 80.0)), ("rhr", "bpm", (60.0, 58.0, 56.0, 54.0, 52.0))) for d, v in enumerate(values, 1) if (u, k) != ("v", "rhr")]
    data += [("u", "hrv", 500.0, "ms", T(2023, 9, 1), None), ("u", "hrv", 900.0, "s", T(2024, 1, 4), None)]
    nights = spark.createDataFrame([("u", datetime.date(2024, 1, 4), 480.0), ("u", datetime.date(2024, 1, 5), 330.0), ("v", datetime.date(2024, 1, 5), 360.0), ("w", datetime.date(2024, 1, 5), 400.0)], "user_id string, night date, total_minutes double")
    got = {r.user_id: tuple(r)[1:] for r in reports.recovery_score(tiered(spark, data), nights, F.lit("2024-01-06").cast("timestamp"), m).collect()}
    assert got == {"u": (40, 30, 5, 75), "v": (40, None, 10, None), "w": (None, None, 20, None)}


def _catalog(spark):
    return spark.createDataFrame([("steps", True, False, False), ("hrv", True, True, True)], "metric_type string, always_expected boolean, wearable boolean, evidence boolean")


def test_whole_summary_keeps_units_apart_and_takes_compacted_days(spark):
    m = {"steps": "steps", "energy": "energy", "hrv": "hrv", "rhr": "rhr", "sleep": "sleep", "vo2": "vo2", "weight": "weight"}
    at, users = F.lit("2024-01-31").cast("timestamp"), spark.createDataFrame([("u",), ("v",), ("x",)], "user_id string")
    s = rows(spark, [("u", "steps", 100.0, "count", T(2024, 1, 28, 1), None), ("u", "steps", 300.0, "count", T(2024, 1, 29, 1), None), ("u", "steps", 5.0, "kg", T(2024, 1, 29, 2), None), ("u", "rhr", 55.0, "bpm", T(2024, 1, 28), None), ("u", "rhr", 58.0, "bpm", T(2024, 1, 29), None), ("v", "hrv", 40.0, "ms", T(2024, 1, 29), None), ("u", "workout", 60.0, "s", T(2024, 1, 29), '{"workout_type": "Run"}'), ("u", "workout", 60.0, "s", T(2023, 12, 1), '{"workout_type": "Swim"}')])
    old = daily.daily_points(rows(spark, [("u", "steps", 500.0, "count", T(2023, 12, 5), None), ("u", "rhr", 70.0, "bpm", T(2023, 12, 5), None), ("u", "steps", 9.0, "count", T(2022, 1, 1), None)])).withColumnRenamed("date", "summary_date")
    trips = workouts.workouts(s.where("metric_type = 'workout'"))
    got = {d: {r.user_id: r for r in reports.whole_summary(s, old, trips, users, _catalog(spark), at, m, days=d).collect()} for d in (7, 90)}
    u, v, x = (got[7][k] for k in "uvx")
    assert (u.steps_total, u.steps_daily_avg, u.steps_days, u.steps_unit, u.steps_other_unit_days, u.rhr_avg, u.rhr_latest, u.workouts, u.workout_types, u.steps_absence) == (400.0, 200.0, 2, "count", 1, 56.5, 58.0, 1, ["Run"], None)
    assert (v.steps_total, v.steps_absence, v.hrv_latest, x.steps_absence, x.hrv_n) == (None, "never_recorded", 40.0, "no_data_yet", 0)
    u = got[90]["u"]
    assert (u.steps_total, u.steps_days, u.rhr_avg, u.rhr_latest, u.summary_points, u.raw_points, u.workouts, u.workout_types) == (900.0, 3, 61.0, 58.0, 2, 4, 2, ["Run", "Swim"])


def test_whole_snapshot_has_a_row_for_compacted_days_and_all_values(spark):
    m = {"steps": "steps", "energy": "energy", "hrv": "hrv", "rhr": "rhr", "sleep": "sleep", "weight": "weight"}
    s = rows(spark, [("u", "rhr", 60.0, "bpm", T(2024, 1, 5, 1), None), ("u", "rhr", 50.0, "bpm", T(2024, 1, 5, 9), None), ("u", "steps", 7.0, "count", T(2024, 1, 5, 1), None), ("u", "steps", 8.0, "count", T(2024, 1, 5, 2), None), ("u", "steps", 900.0, "kg", T(2024, 1, 5, 3), None), ("u", "sleep", 3.0, "", T(2024, 1, 5, 3), None), ("u", "workout", 90.0, "s", T(2024, 1, 5, 5), '{"workout_type": "Run"}')])
    old = daily.daily_points(rows(spark, [("w", "steps", 4.0, "count", T(2024, 1, 5, 1), None), ("w", "rhr", 61.0, "bpm", T(2024, 1, 5, 1), None), ("u", "weight", 80.0, "kg", T(2024, 1, 5), None)])).withColumnRenamed("date", "summary_date")
    got = {r.user_id: r for r in reports.whole_snapshot(s, old, workouts.workouts(s.where("metric_type = 'workout'")), F.lit("2024-01-05").cast("date"), m, ("steps",), max_rows=6).collect()}
    u, w = got["u"], got["w"]
    assert (u.steps, u.rhr, u.weight, u.highlights_tier, u.total_records, u.truncated, len(u.all_values), u.sleep_records) == (15.0, 60.0, 80.0, "summary", 7, True, 6, 1)
    assert [(x.workout_type, x.duration_minutes) for x in u.workouts] == [("Run", 1.5)] and u.metrics_present == ["rhr", "sleep", "steps", "weight", "workout"]
    assert (w.steps, w.rhr, w.total_records, w.metrics_present, w.all_values, w.workouts) == (4.0, 61.0, 0, ["rhr", "steps"], [], [])


def test_brief_counts_30_days_of_workouts_and_finds_compacted_vo2(spark):
    m = {"steps": "steps", "energy": "energy", "hrv": "hrv", "rhr": "rhr", "sleep": "sleep", "vo2": "vo2", "weight": "weight"}
    at, run = F.lit("2024-01-31").cast("timestamp"), '{"workout_type": "Run", "duration_seconds": 5400}'
    s = rows(spark, [("u", "workout", 1.0, "s", T(2024, 1, d), run) for d in (2, 20)] + [("u", "workout", 1.0, "s", T(2023, 10, 1), run)] + [("u", "hrv", 50.0 if d > 23 else 40.0, "ms", T(2024, 1, d), None) for d in range(19, 31)] + [("u", "rhr", 55.0, "bpm", T(2024, 1, 29), None), ("u", "steps", 100.0, "count", T(2024, 1, 29), None), ("u", "steps", 7.0, "kg", T(2024, 1, 29), None), ("u", "steps", 200.0, "count", T(2024, 1, 30), None)])
    old = daily.daily_points(rows(spark, [("u", "vo2", 48.0, "", T(2023, 8, 1), None), ("z", "vo2", 44.0, "", T(2023, 8, 1), None), ("u", "vo2", 30.0, "", T(2022, 8, 1), None)])).withColumnRenamed("date", "summary_date")
    trips = workouts.workouts(s.where("metric_type = 'workout'"))
    assert [(r.sessions_30d, r.weekly_sessions) for r in reports.coaching_brief(s, trips, at, m).collect()] == [(2, 0.5)]
    marks = {r.user_id: (r.vo2_latest, r.vo2_tier) for r in reports.fitness_markers(s, at, m, old).collect()}
    assert marks["u"] == (48.0, "summary") and marks["z"] == (44.0, "summary")
    b = {r.user_id: r for r in reports.whole_brief(s, old, trips, at, m).collect()}
    u = b["u"]
    assert (u.sessions_30d, u.hours_30d, u.by_type, u.hrv_latest, u.hrv_delta, u.hrv_trend, u.rhr_latest, u.rhr_avg, u.steps_daily_avg, u.energy_daily_avg, u.vo2_latest) == (2, 3.0, {"Run": 2}, 50.0, 10.0, "up", 55.0, 55.0, 150.0, None, 48.0)
    assert (b["z"].status, b["z"].vo2_latest, b["z"].sleep_flag) == ("none", 44.0, "no data")


def test_store_and_batch_cover_the_whole_table(spark):
    from tidewell import plans
    from tidewell.plans import analyses

    s = plans.registry.samples_of(spark, "/root/testdata/sf0.001")
    assert s.where(f"not (({analyses._STORED}) or event_id % 3 = 0)").count() == 0
    assert plans.registry.QUERIES["upsert_samples"](spark, "/root/testdata/sf0.001").count() == s.count()

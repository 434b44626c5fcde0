"""Golden values, invariants, and all SQL oracles on a small table."""

import datetime
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.functions.numbers import correlation
from tidewell.functions.time import day_bounds_utc, local_day, metric_display_name, touched_hours
from tidewell.operators import daily, quality, sleep, store, upkeep
from tidewell.plans import registry
from tidewell.schema import MERGED_SOURCE, SAMPLES
from tidewell.streaming.ingest import ingest_stream, read_store

SF = "/root/testdata/sf0.001"
T = datetime.datetime


def rows(spark, data):
    """(user, metric, value, unit, source, start, minutes)"""
    out = [(u, m, v, unit, s, at, at + datetime.timedelta(minutes=n), None, at) for u, m, v, unit, s, at, n in data]
    return spark.createDataFrame(out, SAMPLES)


def merged_day(spark, hours, value=100.0):
    return rows(spark, [("u", "steps", value, "count", MERGED_SOURCE, T(2024, 1, 5, h), 60) for h in hours])


def test_local_days(spark):
    one = spark.range(1)
    at = lambda t, z: one.select(local_day(F.lit(t).cast("timestamp"), z)).first()[0].isoformat()
    assert [at("2026-03-10 23:30:00", z) for z in ("UTC", "America/New_York", "Asia/Tokyo")] == ["2026-03-10", "2026-03-10", "2026-03-11"]
    a, b = one.select(*day_bounds_utc(F.lit("2024-03-10").cast("date"), "America/New_York")).first()
    assert (b - a).total_seconds() == 23 * 3600
    hours = one.select(F.size(touched_hours(F.lit("2024-01-01 10:50:00").cast("timestamp"), F.lit("2024-01-01 12:00:00").cast("timestamp")))).first()[0]
    assert hours == 2
    assert one.select(metric_display_name(F.lit("HKQuantityTypeIdentifierVO2Max"))).first()[0] == "VO2 Max"


def test_units_stay_apart_and_majority_wins(spark):
    s = rows(spark, [("u", "protein", 32.0, "g", "a", T(2026, 3, 1, 12), 1), ("u", "protein", 0.032, "kg", "a", T(2026, 3, 1, 13), 1), ("u", "protein", 30.0, "g", "a", T(2026, 3, 2, 12), 1)])
    p = daily.daily_points(s)
    assert p.where("date = '2026-03-01'").count() == 2 and not p.where("sum_value = 32.032").count()
    assert daily.single_unit(p).agg(F.avg("sum_value")).first()[0] == 31.0


def test_a_day_comes_from_one_tier(spark):
    s = rows(spark, [("u", "steps", 999.0, "count", "a", T(2026, 3, 1, 12), 1), ("u", "steps", 50.0, "count", "a", T(2026, 3, 2, 12), 1)])
    done = daily.daily_points(rows(spark, [("u", "steps", 100.0, "count", "a", T(2026, 3, 1, 12), 1)])).withColumnRenamed("date", "summary_date")
    assert daily.tiered_daily(s, done).agg(F.sum("sum_value")).first()[0] == 150.0


@pytest.mark.parametrize("segments,best,total", [([("Apple Watch", 400), ("Oura", 300)], "Oura", 300), ([("Whoop", 420), ("iPhone", 100), ("iPhone", 100)], "Whoop", 420), ([("Polar", 500), ("Fitbit", 10), ("Fitbit", 10), ("Fitbit", 10)], "Fitbit", 30)])
def test_best_sleep_source(spark, segments, best, total):
    s = rows(spark, [("u", "sleep", 3.0, "", d, T(2026, 3, 1, 23, i), n) for i, (d, n) in enumerate(segments)])
    n = sleep.sleep_nights(s).first()
    assert (n.source_device, n.total_minutes) == (best, total)


def test_merged_hours_replace_device_rows_and_late_rows_are_found(spark):
    device = rows(spark, [("u", "steps", 5.0, "count", "watch", T(2024, 1, 5, 11, 10), 5), ("u", "steps", 7.0, "count", "watch", T(2024, 1, 5, 12), 5)])
    once = store.replace_merged_hours(device, merged_day(spark, [11]))
    again = store.replace_merged_hours(once, merged_day(spark, [11]))
    assert sorted(r.value for r in again.collect()) == [7.0, 100.0] == sorted(r.value for r in once.collect())
    late = once.unionByName(rows(spark, [("u", "steps", 3.0, "count", "phone", T(2024, 1, 5, 11, 40), 5)]))
    assert store.double_counted(late).count() == 1 and store.double_counted(store.replace_merged_hours(late, merged_day(spark, [11]))).count() == 0


def test_recompute(spark):
    r = store.recompute_summaries(merged_day(spark, range(24))).first()
    assert (r.sum_value, r.sample_count) == (2400.0, 24)
    mixed = merged_day(spark, range(24)).unionByName(rows(spark, [("u", "steps", 1.0, "count", "watch", T(2024, 1, 5, 3), 5)]))
    assert store.recompute_summaries(mixed).count() == 0


def test_compaction_conserves(spark):
    first = rows(spark, [("u", "hr", float(60 + i), "bpm", "w", T(2024, 1, 5, 1, i), 1) for i in range(60)])
    empty = daily.daily_points(first).limit(0).withColumnRenamed("date", "summary_date")
    cut, now = F.lit("2024-01-10").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    rest, done = store.compact(first, empty, cut, now)
    r = done.first()
    assert (rest.count(), r.sum_value, r.sample_count) == (0, 5370.0, 60)
    late = rows(spark, [("u", "hr", 70.0, "bpm", "w", T(2024, 1, 5, 2, i), 1) for i in range(40)])
    rest, done = store.compact(late, done, cut, now)
    r = done.first()
    assert (r.sum_value, r.sample_count, r.min_value, r.max_value, round(r.avg_value, 1)) == (8170.0, 100, 60.0, 119.0, 81.7)


def test_absence(spark):
    users = spark.createDataFrame([("a",), ("b",), ("c",)], "user_id string")
    catalog = spark.createDataFrame([("steps", True, False, False), ("hrv", True, True, True), ("mood", False, False, False)], "metric_type string, always_expected boolean, wearable boolean, evidence boolean")
    ever = spark.createDataFrame([("a", "steps"), ("b", "hrv")], "user_id string, metric_type string")
    got = {(r.user_id, r.metric_type): r.reason for r in quality.absence(users, catalog, ever.where("user_id = 'a'"), ever).collect()}
    assert got[("a", "steps")] is None and got[("a", "hrv")] == "no_recording_device" and got[("a", "mood")] == "empty_window"
    assert got[("b", "hrv")] == "empty_window" and got[("b", "steps")] == "never_recorded" and got[("c", "hrv")] == "no_data_yet"


def test_overlaps_of_worse_sources_go(spark):
    s = rows(spark, [("u", "steps", 1.0, "", "a", T(2024, 1, 5, 1, 50), 30), ("u", "steps", 2.0, "", "b", T(2024, 1, 5, 2, 19), 5), ("u", "steps", 3.0, "", "b", T(2024, 1, 5, 2, 20), 5), ("u", "steps", 4.0, "", "c", T(2024, 1, 5, 2, 23), 0), ("v", "steps", 5.0, "", "c", T(2024, 1, 5, 2), 5), ("u", "steps", 6.0, "", "c", T(2024, 1, 5, 1, 45), 5)])
    rank = F.when(F.col("source_device") == "a", 0).when(F.col("source_device") == "b", 1).otherwise(2)
    assert sorted(r.value for r in store.drop_overlaps(s, rank).collect()) == [1.0, 3.0, 5.0, 6.0]
    assert store.drop_overlaps(s.limit(0), rank).count() == 0
    with pytest.raises(Exception, match="priority"):
        store.drop_overlaps(s, rank, levels=2).collect()


def test_second_run_changes_nothing(spark):
    new = daily.daily_points(merged_day(spark, range(3))).withColumnRenamed("date", "summary_date")
    assert upkeep.changed_summaries(new.limit(0), new).count() == 1 and upkeep.changed_summaries(new, new).count() == 0
    both = merged_day(spark, [11]).unionByName(rows(spark, [("u", "steps", 3.0, "count", "phone", T(2024, 1, 5, 11, 40), 5), ("u", "steps", 4.0, "count", "phone", T(2024, 1, 5, 12, 40), 5)]))
    fixed = upkeep.repair_hours(both)
    assert sorted(r.value for r in fixed.collect()) == [4.0, 100.0] and store.double_counted(fixed).count() == 0


def test_correlation_of_constants_is_null(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert d.agg(correlation("a", "b")).first()[0] is None and d.agg(correlation("b", "b")).first()[0] == 1.0


@pytest.mark.parametrize("n", range(4))
def test_a_day_at_the_bound_is_judged_alike_in_any_order(spark, n):
    def below(values):
        rows = [("u", "m", datetime.date(2024, 1, 1 + i), v) for i, v in enumerate(values[n:] + values[:n])]
        points = spark.createDataFrame(rows, "user_id string, metric_type string, date date, day_value double").coalesce(1)
        return sorted((r.day_value, r.own_mean) for r in daily.below_average_days(points).collect())

    # a double sum of the first four and of the next four is off by a bit in every order, and the bound with it
    assert below([43.52, 4.26, 25.05, 144.77]) == [(4.26, 54.4), (25.05, 54.4)]  # 43.52 is 0.8 of the mean
    assert below([38.83, 36.37, 22.38, 96.57]) == [(22.38, 48.54), (36.37, 48.54), (38.83, 48.54)]  # here 0.8 of the mean is a bit above
    assert below([None, 1e-12, 3e-12, None]) == [(1e-12, 0.0)] and below([2.0**100, 3 * 2.0**100, None, 2.0**101]) == [(2.0**100, 2.0**101)]
    assert below([float("inf"), 1.0, None, None]) == [(1.0, float("inf"))] and below([None] * 4) == []


def test_users_do_not_mix(spark):
    s = registry.samples_of(spark, SF)
    some = s.where("user_id = 1")
    assert some.count() > 0
    assert sorted(map(tuple, daily.daily_points(s).where("user_id = 1").collect())) == sorted(map(tuple, daily.daily_points(some).collect()))


def test_stream_drains_and_resent_rows_do_not_repeat(spark, tmp_path):
    one = {"metric_type": "hr", "value": 1.0, "unit": "bpm", "source_device": "w", "started_at": "2024-01-05T01:00:00Z", "ended_at": None, "metadata": None}
    same = one | {"value": 2.0, "started_at": "2024-01-04T21:00:00-04:00"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"samples": [one, same, one | {"started_at": "nonsense"}]}) + "\n" + json.dumps({"samples": []}))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "offsets"), "u")
    more = {"pattern": None}
    ingest_stream(*args, **more).awaitTermination()
    (tmp_path / "in/b.json").write_text(json.dumps({"samples": [one | {"value": 3.0}]}))
    ingest_stream(*args, **more).awaitTermination()
    at = str(tmp_path / "store")
    assert [r.value for r in read_store(spark, at).collect()] == [3.0]
    files = lambda day: {p.name for p in (tmp_path / f"store/rows/metric_type=hr/day={day}").glob("*.parquet")}
    before = files("2024-01-05")
    (tmp_path / "in/c.json").write_text(json.dumps({"samples": [one | {"value": 4.0, "started_at": "2024-01-07T01:00:00Z"}]}))
    ingest_stream(*args, **more).awaitTermination()
    assert files("2024-01-05") == before and files("2024-01-07")  # a day that a batch doesn't touch isn't written again
    assert sorted(r.value for r in read_store(spark, at).collect()) == [3.0, 4.0]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_equal_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda v: f"{v:.8g}" if isinstance(v, float) else str(v)
    ours = sorted(tuple(text(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(text(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
    assert ours == theirs

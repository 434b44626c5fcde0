"""Units, activities, checked periods, resumed backfills, and answers over nothing."""

import pytest
from pyspark.sql import functions as F

from tidewell.catalog import ACTIVITIES, PREFERRED_UNITS, activity_name, unit_tables
from tidewell.operators import answers, daily, upkeep
from tidewell.schema import SAMPLES, SUMMARIES
from tidewell.sources.samples import to_preferred_units

CATALOG = "metric_type string, always_expected boolean, wearable boolean, evidence boolean"


def test_units(spark):
    preferred, units = unit_tables(spark)
    assert preferred.count() == preferred.distinct().count() == len({m for ms in PREFERRED_UNITS.values() for m in ms})
    assert preferred.join(units, preferred["preferred"] == units["unit"]).count() == preferred.count()
    q = "HKQuantityTypeIdentifier"
    rows = [(q + "BodyTemperature", "degF", 98.6), (q + "BodyMass", "lb", 100.0), (q + "DietaryIron", "g", 0.018), (q + "HeartRate", "kg", 2.0), ("Other", "mi", 1.0), ("Other", "stage", 3.0), (None, None, None)]
    got = to_preferred_units(spark.createDataFrame(rows, "metric_type string, unit string, value double"), preferred, units).collect()
    told = {(r.metric_type, r.unit): (r.value and round(r.value, 4), r.unsupported) for r in got}
    assert told == {
        (q + "BodyTemperature", "degC"): (37.0, False), (q + "BodyMass", "kg"): (45.3592, False), (q + "DietaryIron", "mg"): (18.0, False), (q + "HeartRate", "g"): (2000.0, False),
        ("Other", "m"): (1609.344, False), ("Other", "stage"): (3.0, True), (None, None): (None, True),
    }


def test_activities(spark):
    got = [r[0].removeprefix("HKWorkoutActivityType") for r in spark.createDataFrame([(c,) for c in (1, 15, 37, 57, 80, 81, 84, 3000, None)], "c int").select(activity_name(F.col("c"))).collect()]
    assert got == ["AmericanFootball", "Unknown", "Running", "Yoga", "Cooldown", "Unknown", "UnderwaterDiving", "Other", "Unknown"]
    assert len([n for n in ACTIVITIES.values() if n]) == 82


@pytest.mark.parametrize("bad", [("2024-02-01", "2024-01-01"), ("2024-01-01", "soon"), ("2010-01-01", "2024-01-01"), ("01/02/2024", "2024-03-01")])
def test_periods_are_checked(bad):
    with pytest.raises(ValueError):
        daily.checked_periods({"a": bad, "b": ("2024-01-01", "2024-01-02")})


def test_labels_are_cut():
    ok = ("2024-01-01", "2024-01-02")
    assert list(daily.checked_periods({"x" * 40: ok, "y": ok})) == ["x" * 32, "y"]
    with pytest.raises(ValueError):
        daily.checked_periods({"x" * 40: ok, "x" * 50: ok})


def test_answers_over_nothing(spark):
    s, old = spark.createDataFrame([], SAMPLES), spark.createDataFrame([], SUMMARIES)
    users, catalog = spark.createDataFrame([("u",)], "user_id string"), spark.createDataFrame([("steps", True, False, False), ("vo2", False, True, True)], CATALOG)
    at = F.lit("2024-01-31").cast("timestamp")
    for days in (7, 90, 10**9):
        got = answers.metric_answer(s, old, users, catalog, at, ("steps",), days=days).select("metric_type", "count", "absence").collect()
        assert sorted(map(tuple, got)) == [("steps", 0, "no_data_yet"), ("vo2", 0, "empty_window")]


def test_backfill_goes_on(spark):
    floor, until = (F.lit(d).cast("timestamp") for d in ("2024-01-01", "2024-07-01"))
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-03-30 23:59:59"), ("a", "2024-03-31 00:00:00"), ("b", "2024-06-30 12:00:00"), ("b", "2024-07-01 00:00:00"), ("b", "2023-12-31 23:59:59")], "metric_type string, t string")
    rows = rows.select("metric_type", F.col("t").cast("timestamp").alias("started_at"))
    catalog, none = spark.createDataFrame([("a",), ("b",)], "metric_type string"), spark.createDataFrame([], "metric_type string, chunk int")
    pending = upkeep.chunks_pending(catalog, floor, until, none)
    assert sorted(map(tuple, pending.collect())) == [(m, c) for m in "ab" for c in (0, 1, 2)]
    log = upkeep.chunk_log(upkeep.backfill_chunks(rows, pending.where("metric_type = 'a'"), floor, until), pending.where("metric_type = 'a'"))
    assert sorted(map(tuple, log.collect())) == [("a", 0, 2), ("a", 1, 1), ("a", 2, 0)]
    rest = upkeep.chunks_pending(catalog, floor, until, log)
    assert sorted(map(tuple, upkeep.backfill_chunks(rows, rest, floor, until).select("metric_type", "chunk").collect())) == [("b", 2)]
    assert upkeep.chunks_pending(catalog, until, floor, none).count() == 0


def test_training_review_and_bands(spark):
    at = F.lit("2024-01-31").cast("timestamp")
    rows = spark.createDataFrame([("u", "2024-01-30", "Run", 3600.0), ("u", "2024-01-23", "Run", 3600.0), ("u", "2023-12-20", "Row", None)], "user_id string, t string, workout_type string, duration_seconds double").withColumn("started_at", F.col("t").cast("timestamp"))
    got = answers.training_review(rows, at).collect()[0]
    assert (got.sessions, got.hours, got.types, got.previous_sessions, got.previous_hours, str(got.longest_week), str(got.shortest_week), got.sessions_change, got.hours_change) == (2, 2.0, 1, 1, 0.0, "2024-01-22", "2024-01-22", 100.0, None)
    p = spark.createDataFrame([("u", "deep", "2024-01-01", 45.0), ("u", "deep", "2024-01-02", 44.9), ("u", "hrv", "2024-01-02", 57.0), ("u", "hrv", "2024-01-03", 44.0)], "user_id string, metric_type string, d string, day_value double").withColumn("date", F.col("d").cast("date"))
    assert sorted(map(tuple, answers.banded_pair(p, "deep", "hrv", (45.0,)).collect())) == [("u", 0, 1, 44.0), ("u", 1, 1, 57.0)]

"""The store under several streams, what ingest rejects, and what compaction leaves alone."""

import json

from pyspark.sql import functions as F

from tidewell.operators import store
from tidewell.schema import SAMPLES
from tidewell.sources import tables
from tidewell.streaming.ingest import HourTotals, batch_reports, ingest_stream, read_store, rejected_rows


def sample(hour, value=1.0, **more):
    return {"metric_type": "HKQuantityTypeIdentifierHeartRate", "value": value, "unit": "bpm", "source_device": "w", "started_at": f"2024-01-05T{hour:02}:00:00Z", "ended_at": None, "metadata": None} | more


def post(folder, name, samples, user=None):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps({"user_id": user, "samples": samples}))


def test_two_streams_share_a_store(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    for i in range(2):
        post(tmp_path / "a", i, [sample(i)])
        ingest_stream(spark, f"file://{tmp_path}/a", at, f"file://{tmp_path}/ca", "u1").awaitTermination()
    post(tmp_path / "b", 0, [sample(5, 9.0), sample(6, ended_at="soon")], " U2 ")
    post(tmp_path / "b", 1, [sample(7, metadata=[1, 2]), sample(8, metric_type="drop table;"), sample(9, started_at="x")], "undefined")
    for _ in range(2):
        ingest_stream(spark, f"file://{tmp_path}/b", at, f"file://{tmp_path}/cb", pattern=r"^HK[A-Za-z0-9]+$").awaitTermination()
    got = {(r.user_id, r.started_at.hour, r.value) for r in read_store(spark, at).collect()}
    assert got == {("u1", 0, 1.0), ("u1", 1, 1.0), ("u2", 5, 9.0)}
    assert sorted(r.reject_reason for r in rejected_rows(spark, at).collect()) == ["bad ended_at", "no user", "no user", "no user"]
    report = batch_reports(spark, at).groupBy().agg(F.sum("posted"), F.sum("rejected"), F.sum("inserted")).first()
    assert tuple(report) == (7, 4, 3)


def test_a_lost_checkpoint_repeats_without_harm(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    post(tmp_path / "a", 0, [sample(1), sample(1, 2.0)])
    for c in ("c1", "c2"):
        ingest_stream(spark, f"file://{tmp_path}/a", at, f"file://{tmp_path}/{c}", "u").awaitTermination()
    assert [r.value for r in read_store(spark, at).collect()] == [2.0]


def test_rules(spark):
    rows = [
        ("HKx", "{}", "2024-01-05T01:00:00Z", None, 1, None), ("HKx", "[1]", "2024-01-05T01:00:00Z", None, 1, "metadata is no object"), ("HKx", "{bad", "2024-01-05T01:00:00Z", None, 1, "metadata is no object"),
        ("HK-x", None, "2024-01-05T01:00:00Z", None, 1, "bad metric type"), ("HKx", None, "2024-01-05T01:00:00Z", "later", 1, "bad ended_at"), ("HKx", None, "2024-01-05T01:00:00Z", None, 1001, "batch too large"),
        ("HKx", None, "nope", None, 1, "bad started_at"),
    ]
    df = spark.createDataFrame(rows, "metric_type string, metadata string, started_text string, ended_text string, batch_rows int, want string")
    df = df.withColumns({"user_id": F.lit("u"), "unit": F.lit(""), "source_device": F.lit("d"), "value": F.lit(1.0), "started_at": F.try_to_timestamp("started_text"), "ended_at": F.try_to_timestamp("ended_text")})
    assert all(r.reject_reason == r.want for r in store.validate(df, pattern=r"^HK[A-Za-z0-9]+$", texts=True).collect())
    merged = df.limit(1).withColumns({"source_device": F.lit("merged hourly total"), "ended_text": F.lit("2024-01-05 02:00"), "ended_at": F.lit("2024-01-05 02:00:00").cast("timestamp")})
    assert store.validate(merged, ("HKx",), texts=True).first().reject_reason == "not a strict instant"
    users = spark.createDataFrame([(" AB ",), ("",), ("null",), (None,)], "u string")
    assert [r[0] for r in users.select(store.user_key(F.col("u"))).collect()] == ["ab", None, None, None]


def test_compaction_leaves_categories_workouts_and_merged_metrics(spark):
    kinds = ["HKCategoryTypeIdentifierSleepAnalysis", "HKWorkoutTypeIdentifier", "HKQuantityTypeIdentifierStepCount", "HKQuantityTypeIdentifierHeartRate"]
    rows = [("u", k, 1.0, "x", "d") for k in kinds]
    df = spark.createDataFrame(rows, "user_id string, metric_type string, value double, unit string, source_device string")
    df = df.withColumns({"started_at": F.lit("2024-01-01").cast("timestamp"), "ended_at": F.lit(None).cast("timestamp"), "metadata": F.lit(None).cast("string"), "synced_at": F.lit("2024-01-01").cast("timestamp")})
    none = spark.createDataFrame([], "user_id string, metric_type string, summary_date date, unit string, min_value double, max_value double, sum_value double, sample_count long")
    rest, done = store.compact(df, none, F.lit("2024-01-20").cast("timestamp"), F.lit("2024-01-31").cast("timestamp"))
    assert sorted(r.metric_type for r in rest.collect()) == sorted(kinds[:3]) and [r.metric_type for r in done.collect()] == kinds[3:]


def test_interleaved_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """Stream A breaks off between staging and putting in; B finds its lock; A's retry and then B's put both rows in."""
    import pytest

    at = f"file://{tmp_path}/store"
    row = lambda u, v: spark.createDataFrame([(u, "hr", v, "bpm", "w", "2024-01-05 01:00:00")], "user_id string, metric_type string, value double, unit string, source_device string, at string").selectExpr("user_id", "metric_type", "value", "unit", "source_device", "timestamp(at) AS started_at", "timestamp(null) AS ended_at", "string(null) AS metadata", "timestamp(at) AS synced_at")

    def made(u, v):
        new = row(u, v)
        days = tables.parted(new)
        return lambda: (days, store.upserted(tables.read_table(spark, at, SAMPLES, days), new))

    assert tables.put(spark, at, made("0", 0.0), "Z", 0)
    overwrite = tables._overwrite
    monkeypatch.setattr(tables, "_overwrite", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        tables.put(spark, at, made("a", 1.0), "A", 0)
    monkeypatch.setattr(tables, "_overwrite", overwrite)
    with pytest.raises(RuntimeError, match="written by stream A"):
        tables.put(spark, at, made("b", 2.0), "B", 0)
    assert [r.user_id for r in read_store(spark, at).collect()] == ["0"]
    assert tables.put(spark, at, lambda: pytest.fail("what is staged is not made again"), "A", 0)
    assert tables.put(spark, at, made("b", 2.0), "B", 0) and not tables.put(spark, at, made("b", 9.0), "B", 0)
    assert sorted((r.user_id, r.value) for r in read_store(spark, at).collect()) == [("0", 0.0), ("a", 1.0), ("b", 2.0)]
    gone = row("0", 0.0)
    assert tables.put(spark, at, lambda: (tables.parted(gone), gone.limit(0)), "Z", 1) and read_store(spark, at).count() == 0


def test_a_session_without_the_setting_has_a_folder_of_its_own(spark):
    class Bare:
        sparkContext = type("C", (), {"master": "local[2]", "applicationId": "x"})
        conf = type("F", (), {"get": staticmethod(lambda key, default=None: default)})

    a, b = tables.scratch(Bare, "t"), tables.scratch(Bare, "t")
    assert a != b and a.rpartition("/")[0] == b.rpartition("/")[0] and a.startswith("file:///")
    Bare.sparkContext.master = "spark://host:7077"
    try:
        tables.scratch(Bare, "t")
        raise AssertionError
    except ValueError:
        pass


def _units(spark):
    return spark.createDataFrame([("g", "g", 1.0), ("kg", "g", 1000.0), ("count", "count", 1.0)], "unit string, canonical string, factor double")


def _device(spark, data):
    """(value, unit, source, start, minutes)"""
    import datetime

    rows = [("u", "m", v, unit, s, at, at + datetime.timedelta(minutes=n), None, at) for v, unit, s, at, n in data]
    return spark.createDataFrame(rows, SAMPLES)


def test_an_hour_has_one_unit_and_a_floor(spark):
    import datetime

    t = lambda h, m=0: datetime.datetime(2024, 1, 5, h, m)
    rows = _device(spark, [(32.0, "g", "a", t(1), 5), (0.032, "kg", "b", t(1, 10), 5), (7.0, "count", "c", t(1, 20), 5), (5.0, "g", "a", t(2), 90)])
    got = store.reemit_hours(rows, rows, _units(spark)).collect()
    assert sorted((r.started_at.hour, r.value, r.unit, r.source_device == "c") for r in got) == [(1, 7.0, "count", True), (1, 64.0, "g", False), (2, 5.0, "g", False), (3, 0.0, "g", False)]
    late = store.merged_hours(rows, rows, _units(spark), not_before=F.lit("2024-01-05 02:59:00").cast("timestamp")).collect()
    assert sorted(r.started_at.hour for r in late) == [2, 3]


def test_overlaps_go_before_the_sum_also_beyond_the_touched_hour(spark):
    import datetime

    t = lambda h, m=0: datetime.datetime(2024, 1, 5, h, m)
    rows = _device(spark, [(1.0, "count", "phone", t(1, 50), 20), (2.0, "count", "watch", t(2, 5), 5), (4.0, "count", "phone", t(1, 5), 5), (8.0, "count", "watch", t(1, 30), 5)])
    priority = F.when(F.col("source_device") == "watch", 0).otherwise(1)
    batch = rows.where("value = 4.0")
    assert [(r.started_at.hour, r.value) for r in store.merged_hours(rows, batch, _units(spark), priority=priority).collect()] == [(1, 12.0)]
    assert [(r.started_at.hour, r.value) for r in store.merged_hours(rows, batch, _units(spark)).collect()] == [(1, 13.0)]


def test_ingest_totals_whole_hours_again_for_late_and_repeated_rows(spark, tmp_path):
    at, metric = f"file://{tmp_path}/store", "HKQuantityTypeIdentifierStepCount"
    step = lambda minute, value, source="watch", minutes=5: {"metric_type": metric, "value": value, "unit": "count", "source_device": source, "started_at": f"2024-01-05T01:{minute:02}:00Z", "ended_at": f"2024-01-05T01:{minute + minutes:02}:00Z", "metadata": None}
    totals = HourTotals((metric,), _units(spark), F.when(F.col("source_device") == "watch", 0).otherwise(1))
    for i, batch in enumerate(([step(0, 10.0), step(10, 20.0), sample(1)], [step(20, 5.0)], [step(20, 5.0)], [step(12, 100.0, "phone"), step(40, 1.0, "phone")])):
        post(tmp_path / "in", i, batch)
        ingest_stream(spark, f"file://{tmp_path}/in", at, f"file://{tmp_path}/c", "u", totals=totals).awaitTermination()
        got = {(r.metric_type, r.source_device, r.value) for r in read_store(spark, at).collect()}
        want = (30.0, 35.0, 35.0, 36.0)[i]
        assert got == {(metric, "merged hourly total", want), ("HKQuantityTypeIdentifierHeartRate", "w", 1.0)}
    assert tables.read_table(spark, f"{at}/devices", SAMPLES).count() == 5


def test_erased_users_are_in_no_file_and_other_files_stay(spark, tmp_path):
    from tidewell.operators.erasure import erase_stored, still_stored

    at, metric = f"file://{tmp_path}/store", "HKQuantityTypeIdentifierStepCount"
    step = lambda day: {"metric_type": metric, "value": 1.0, "unit": "count", "source_device": "w", "started_at": f"2024-01-{day:02}T01:00:00Z", "ended_at": f"2024-01-{day:02}T01:05:00Z", "metadata": None}
    totals = HourTotals((metric,), _units(spark))
    for i, (user, rows) in enumerate((("gone", [step(5), sample(1), sample(2, ended_at="soon")]), ("stays", [step(5), step(6), sample(1, started_at="2024-01-07T01:00:00Z"), sample(3, ended_at="soon")]))):
        post(tmp_path / "in", i, rows, user)
        ingest_stream(spark, f"file://{tmp_path}/in", at, f"file://{tmp_path}/c", totals=totals).awaitTermination()
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    before, asked = files(), spark.createDataFrame([("gone",), ("nobody",)], "user_id string")
    assert {(r.table, r.rows) for r in still_stored(spark, at, asked).collect()} == {("samples", 2), ("devices", 1), ("rejected", 1)}
    erase_stored(spark, at, asked, "r1")
    erase_stored(spark, at, asked, "r1")
    after = files()
    assert still_stored(spark, at, asked).isEmpty() and all(b"gone" not in p.read_bytes() for p in after)
    same = [p for p in before if "day=2024-01-06" in str(p) or "day=2024-01-07" in str(p)]
    assert len(same) == 3 and all(after.get(p) == before[p] for p in same)
    assert sorted((r.user_id, r.started_at.day, r.source_device) for r in read_store(spark, at).collect()) == [("stays", 5, "merged hourly total"), ("stays", 6, "merged hourly total"), ("stays", 7, "w")]
    assert [r.user_id for r in rejected_rows(spark, at).collect()] == ["stays"]


def test_scans_are_pruned_to_touched_partitions(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    post(tmp_path / "in", 0, [sample(1, started_at=f"2024-01-{d:02}T01:00:00Z") for d in range(1, 9)], "u")
    ingest_stream(spark, f"file://{tmp_path}/in", at, f"file://{tmp_path}/c").awaitTermination()
    days = tables.parted(read_store(spark, at)).where("day = '2024-01-03'").select("metric_type", "day")
    some = tables.read_table(spark, at, SAMPLES, days)
    plan = some._jdf.queryExecution().executedPlan().toString()
    wanted = [line for line in plan.splitlines() if "FileScan" in line and "PartitionFilters: [" in line and "day#" in line.split("PartitionFilters: [")[1].split("]")[0]]
    assert wanted and some.count() == 1


def test_summaries_are_scanned_by_metric_and_days(spark, tmp_path):
    import datetime

    from tidewell.sources.samples import scan_summaries

    rows = [("u", m, datetime.date(2024, 1, d), "x", 1.0, 1.0, 1.0, 1.0, 1) for m in ("a", "b") for d in range(1, 9)]
    spark.createDataFrame(rows, "user_id string, metric_type string, date date, unit string, avg_value double, min_value double, max_value double, sum_value double, sample_count long").write.parquet(f"{tmp_path}/s")
    got = scan_summaries(spark, f"file://{tmp_path}/s", "a", F.lit("2024-01-03").cast("date"), F.lit("2024-01-05").cast("date"))
    assert sorted((r.metric_type, r.summary_date.day) for r in got.collect()) == [("a", 3), ("a", 4), ("a", 5)]
    assert "GreaterThanOrEqual(date" in got._jdf.queryExecution().toString() and scan_summaries(spark, f"file://{tmp_path}/s").count() == 16


def test_long_intervals_and_whole_payloads_are_rejected(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    post(tmp_path / "in", 0, [sample(1, ended_at="9999-01-01T00:00:00Z"), sample(2)], "u")
    post(tmp_path / "in", 1, [sample(3)], "v")
    ingest_stream(spark, f"file://{tmp_path}/in", at, f"file://{tmp_path}/c", mode="batch").awaitTermination()
    assert [r.user_id for r in read_store(spark, at).collect()] == ["v"]
    assert sorted(r.reject_reason for r in rejected_rows(spark, at).collect()) == ["batch rejected", "interval too long"]


def test_running_totals_drop_repeats_inside_the_delay(spark, tmp_path):
    import datetime

    from tidewell.streaming.ingest import continuous_totals, latest_totals

    def write(name, data):
        _device(spark, [(v, "count", s, t, 1) for v, s, t in data]).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    t = lambda d, h, m=0: datetime.datetime(2024, 1, d, h, m)
    write("a", [(1.0, "a", t(5, 1)), (2.0, "b", t(5, 1, 30))])
    source = lambda: spark.readStream.schema(SAMPLES).parquet(f"{tmp_path}/in/*")

    def run():
        continuous_totals(spark, source(), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
        return {(r.started_at.day, r.started_at.hour): (r.value, r.rows) for r in latest_totals(spark, f"{tmp_path}/out").collect()}

    assert run() == {(5, 1): (3.0, 2)}
    write("b", [(1.0, "a", t(5, 1)), (4.0, "c", t(5, 1, 40)), (9.0, "d", t(12, 1))])
    assert run() == {(5, 1): (7.0, 3), (12, 1): (9.0, 1)}
    write("c", [(1.0, "a", t(5, 1)), (1.0, "e", t(12, 2))])  # older than the delay: too late to be counted
    assert run() == {(5, 1): (7.0, 3), (12, 1): (9.0, 1), (12, 2): (1.0, 1)}

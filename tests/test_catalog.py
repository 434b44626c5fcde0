"""The metric catalog, stage names and the XML export's defaults."""

import datetime
import json

from pyspark.sql import functions as F

from tidewell.catalog import MERGED_METRICS, SLEEP_METRIC, STAGE_VALUES, metric_catalog
from tidewell.operators import quality
from tidewell.schema import SAMPLES
from tidewell.sources.samples import read_export_xml, stage_code, with_stage_names

T = datetime.datetime


def test_catalog_has_one_row_per_metric_and_serves_absence(spark):
    c = metric_catalog(spark)
    rows = {r.metric_type: r for r in c.collect()}
    assert len(rows) == c.count() and len(MERGED_METRICS) == 14
    hr = rows["HKQuantityTypeIdentifierHeartRate"]
    assert (hr.display_name, hr.always_expected, hr.wearable, hr.cumulative, hr.merged) == ("Heart Rate", True, True, False, False)
    users = spark.createDataFrame([("a",)], "user_id string")
    ever = spark.createDataFrame([("a", "HKQuantityTypeIdentifierStepCount")], "user_id string, metric_type string")
    got = {r.metric_type: r.reason for r in quality.absence(users, c.select("metric_type", "always_expected", "wearable", "evidence"), ever, ever).collect()}
    assert got["HKQuantityTypeIdentifierHeartRate"] == "no_recording_device" and got["HKQuantityTypeIdentifierDistanceWalkingRunning"] == "never_recorded"


def test_stage_names_and_codes(spark):
    d = spark.createDataFrame([(v,) for v in (*STAGE_VALUES, "12", None)], "v string")
    assert [r[0] for r in d.select(stage_code(F.col("v"))).collect()] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, None, None]
    at = T(2024, 1, 1)
    meta = [None, "{}", '{"a": 1, "b": "x}"}', '{"sleep_stage":"kept"}', " "]
    s = spark.createDataFrame([("u", SLEEP_METRIC, 4.0, "", str(i), at, at, m, at) for i, m in enumerate(meta)] + [("u", "hr", 4.0, "", "9", at, at, None, at), ("u", SLEEP_METRIC, None, "", "8", at, at, None, at)], SAMPLES)
    got = {r.source_device: r.metadata for r in with_stage_names(s).collect()}
    deep = STAGE_VALUES[4]
    assert [json.loads(got[str(i)]) for i in range(5)] == [{"sleep_stage": deep}, {"sleep_stage": deep}, {"a": 1, "b": "x}", "sleep_stage": deep}, {"sleep_stage": "kept"}, {"sleep_stage": deep}]
    assert got["9"] is None and json.loads(got["8"]) == {"sleep_stage": "HKCategoryValueSleepAnalysisUnknown"}


def test_export_defaults(spark, tmp_path):
    row = '<Record type="{}" sourceName="w" unit="x" startDate="2024-01-05 01:00:00 -0400" endDate="2024-01-05 02:00:00 -0400" value="{}"/>'
    kinds = [(SLEEP_METRIC, STAGE_VALUES[3]), (MERGED_METRICS[0], "5"), ("HKClinicalThing", "1"), ("HKQuantityTypeIdentifierHeartRate", "NaN")]
    (tmp_path / "e.xml").write_text("<HealthData>" + "\n".join(row.format(*k) for k in kinds) + "</HealthData>")
    got = {r.metric_type: (r.value, r.reason, r.started_at) for r in read_export_xml(spark, str(tmp_path / "e.xml")).collect()}
    at = T(2024, 1, 5, 5)
    assert got == {SLEEP_METRIC: (3.0, None, at), MERGED_METRICS[0]: (5.0, "refused", at), "HKClinicalThing": (1.0, "skipped", at), "HKQuantityTypeIdentifierHeartRate": (None, None, at)}
    assert read_export_xml(spark, str(tmp_path / "e.xml"), stages=False).where(F.col("metric_type") == SLEEP_METRIC).first().value is None

"""Registered queries over compaction with a ledger and summaries kept up by differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import day_bounds_utc
from ..operators import ledger, maintain, store
from ..sources.tables import scratch
from .registry import _GO, _LOCAL, _SUMMED, _merged, _store, _summary, AS_OF, CUTOFF, KEPT_RAW, ORACLES, TZ, query, samples_of, summaries_of

_STORE = f"""store_after AS (SELECT * FROM (SELECT user_id, metric_type, value, unit, source_device, started_at, ended_at, metadata, synced_at FROM samples s WHERE NOT EXISTS
  (SELECT 1 FROM merged m WHERE m.user_id = s.user_id AND m.metric_type = s.metric_type AND m.started_at = date_trunc('hour', s.started_at)) UNION ALL SELECT * FROM merged)),
days_after AS (SELECT *, {_LOCAL}::DATE AS summary_date FROM store_after)"""


def _keys(df):
    """Samples with keys of their own: the events' devices don't tell their rows apart."""
    return df.withColumn("source_device", F.concat_ws(" ", "source_device", F.col("event_id").cast("string"))).drop("event_id").withColumn("user_id", F.col("user_id").cast("string"))


def _compacted_twice(spark, sf_dir):
    """All samples are compacted with a ledger; then all of them are sent again and compacted again."""
    cutoff, as_of = day_bounds_utc(F.lit(CUTOFF).cast("date"), TZ)[0], F.lit(AS_OF).cast("timestamp")
    rows, old = _keys(samples_of(spark, sf_dir)), summaries_of(spark, sf_dir).withColumn("user_id", F.col("user_id").cast("string"))
    none = spark.createDataFrame([], ledger.LEDGER)
    first = ledger.compact_once(rows, old, none, ledger.ledger_filter(none), cutoff, as_of, TZ, kept_raw=KEPT_RAW)
    at = scratch(spark, "ledger")
    first.ledger.write.partitionBy("metric_type", "month").parquet(at)
    keys = spark.read.schema(ledger.LEDGER).parquet(at)
    return ledger.compact_once(rows, first.summaries, keys, ledger.ledger_filter(keys), cutoff, as_of, TZ, kept_raw=KEPT_RAW)


@query(f"SELECT user_id::VARCHAR AS user_id, metric_type, raw_rows, summary_rows, total_sum FROM ({ORACLES['compaction_totals']})")
def compaction_resent(spark, sf_dir):
    """Totals after everything has been sent and compacted a second time: those of the first time."""
    done = _compacted_twice(spark, sf_dir)
    return store.compaction_totals(done.samples, done.summaries)


@query(f"SELECT metric_type, 'compact' AS mode, 0::BIGINT AS raw_rows, count(*) AS refused_rows, 0::BIGINT AS summary_rows FROM samples WHERE {_GO} GROUP BY metric_type")
def compaction_report(spark, sf_dir):
    """What the second compaction says: every row that was due is refused."""
    return _compacted_twice(spark, sf_dir).report


def _kept_up(spark, sf_dir):
    """States before and after the merged hours of all users replace their device rows; the second one by differences."""
    before = _store(spark, sf_dir)
    after = store.replace_merged_hours(before, _merged(spark, sf_dir))
    state = maintain.summary_state(before, TZ)
    return state, maintain.maintained(state, *maintain.changed_rows(before, after), after, TZ)


@query(f"""SELECT user_id, metric_type, summary_date, unit, {_SUMMED} FROM (SELECT *, bool_and(source_device = 'merged hourly total') OVER (PARTITION BY user_id, metric_type, summary_date) AS clean FROM (WITH {_STORE} SELECT * FROM days_after))
WHERE clean GROUP BY user_id, metric_type, summary_date, unit HAVING count(value) > 0""")
def maintained_summaries(spark, sf_dir):
    return _summary(maintain.clean_summaries(_kept_up(spark, sf_dir)[1]))


@query(f"""SELECT metric_type, 'recompute' AS mode, count(DISTINCT (user_id, summary_date, unit)) FILTER (clean) AS summary_rows, count(DISTINCT (user_id, summary_date)) FILTER (NOT clean) AS skipped_days FROM
(SELECT *, bool_and(source_device = 'merged hourly total') OVER (PARTITION BY user_id, metric_type, summary_date) AS clean FROM (WITH {_STORE} SELECT * FROM days_after)) GROUP BY metric_type""")
def recompute_report(spark, sf_dir):
    """Days become clean where all device rows have gone; the others are counted as skipped."""
    return maintain.recompute_report(*_kept_up(spark, sf_dir))

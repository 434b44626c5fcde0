"""Registered queries over ingest by several users, batches, user zones and the stored summary tier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import daily, store
from ..sources.samples import scan_summaries as scan
from ..sources.tables import scratch
from .registry import _row, _ROW, _table, PLAIN_METRICS, query, samples_of, summaries_of, units_of


def _user_payloads(spark, sf_dir, which: int) -> str:
    """Payload files of the users of one half, in batches of at most 400 samples of one user, with bad rows among them."""
    path, s = scratch(spark, "payloads"), samples_of(spark, sf_dir).where(F.col("user_id") % 2 == which)
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    bad = F.col("event_id") % 7 == 0
    row = F.struct(
        "metric_type", "value", "unit", F.concat("source_device", F.lit(" "), F.col("event_id").cast("string")).alias("source_device"), at("started_at").alias("started_at"),
        F.when(bad, "soon").otherwise(at("ended_at")).alias("ended_at"), "metadata",
    )
    user = F.concat(F.lit(" U"), F.col("user_id").cast("string"), F.lit(" "))
    s.groupBy("user_id", F.expr("event_id div 400").alias("part")).agg(F.collect_list(row).alias("samples")).select(user.alias("user_id"), "samples").write.json(path)
    return path


@query("""SELECT 'u' || user_id AS user_id, metric_type, round(value, 4) AS value, unit, source_device || ' ' || event_id AS source_device, (epoch_us(started_at) // 1000000) AS start_epoch, event_id % 7 = 0 AS rejected FROM samples""")
def ingest_users(spark, sf_dir):
    """Two streams with checkpoints of their own put all users' payloads into one store; what they reject is read back too."""
    from ..streaming.ingest import ingest_stream, read_store, rejected_rows

    at = scratch(spark, "store")
    for half in (0, 1):
        ingest_stream(spark, _user_payloads(spark, sf_dir, half), at, scratch(spark, "offsets"), pattern=PLAIN_METRICS).awaitTermination()
    good = _row(read_store(spark, at)).withColumn("rejected", F.lit(False))
    return good.unionByName(_row(rejected_rows(spark, at)).withColumn("rejected", F.lit(True)))


@query("""SELECT user_id, event_id, CASE WHEN event_id % 97 = 0 THEN 'metadata is no object' WHEN bool_or(event_id % 97 = 0) OVER (PARTITION BY user_id, event_id // 500) THEN 'batch rejected' END AS reject_reason FROM samples""")
def validate_batches(spark, sf_dir):
    """One bad sample rejects its whole batch."""
    s = samples_of(spark, sf_dir).withColumn("metadata", F.when(F.col("event_id") % 97 == 0, "[1, 2]").otherwise(F.col("metadata")))
    s = s.withColumn("batch_id", F.concat_ws("/", "user_id", F.expr("event_id div 500")))
    return store.validate(s, mode="batch").select("user_id", "event_id", "reject_reason")


_ZONES = ("UTC", "America/New_York", "Asia/Tokyo", "Europe/Berlin", "Pacific/Auckland")


@query(f"""SELECT user_id, metric_type, date, unit, round(avg(value), 4) AS avg_value, round(sum(value), 4) AS sum_value, count(value) AS sample_count FROM (SELECT s.*, (s.started_at AT TIME ZONE 'UTC' AT TIME ZONE coalesce(z, 'UTC'))::DATE AS date
FROM samples s LEFT JOIN (SELECT c_custkey, [{", ".join(map(repr, _ZONES))}][1 + c_nationkey % 5] AS z FROM customer WHERE c_nationkey < 20) ON c_custkey = s.user_id) GROUP BY user_id, metric_type, date, unit""")
def zoned_points(spark, sf_dir):
    """Daily points by each user's own time zone; users without one are in UTC."""
    zones = _table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("user_id"), F.element_at(F.array(*map(F.lit, _ZONES)), (1 + F.col("c_nationkey") % 5).cast("int")).alias("time_zone"))
    points = daily.daily_points(daily.with_zones(samples_of(spark, sf_dir), zones), F.col("time_zone"))
    return points.select("user_id", "metric_type", "date", "unit", "avg_value", "sum_value", "sample_count")


@query("SELECT user_id, metric_type, date AS summary_date, unit, avg_value, min_value, max_value, sum_value, sample_count FROM summaries")
def scan_summaries(spark, sf_dir):
    """The summary tier, stored with the older column name and read back."""
    at = scratch(spark, "summaries")
    summaries_of(spark, sf_dir).withColumnRenamed("summary_date", "date").write.parquet(at)
    return scan(spark, at)


@query(f"""SELECT {_ROW} FROM samples s WHERE metric_type <> 'steps' OR user_id % 3 <> 0 OR event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM samples b WHERE b.event_id % 2 = 0 AND b.metric_type = 'steps' AND b.user_id = s.user_id AND
date_trunc('hour', s.started_at) BETWEEN date_trunc('hour', b.started_at) AND date_trunc('hour', b.ended_at - INTERVAL 1 MICROSECOND)) UNION ALL
SELECT user_id, metric_type, round(coalesce(sum(value), 0), 4) AS value, 'g' AS unit, 'merged hourly total' AS source_device, (epoch_us(hour) // 1000000) AS start_epoch FROM
(SELECT h.user_id, h.metric_type, h.hour, CASE s.unit WHEN 'kg' THEN 1000 * s.value ELSE s.value END AS value FROM (SELECT DISTINCT user_id, metric_type, unnest(generate_series(date_trunc('hour', started_at), date_trunc('hour', ended_at - INTERVAL 1 MICROSECOND), INTERVAL 1 HOUR)) AS hour FROM samples
WHERE event_id % 2 = 0 AND metric_type = 'steps' AND user_id % 3 = 0) h LEFT JOIN samples s ON s.user_id = h.user_id AND s.metric_type = h.metric_type AND date_trunc('hour', s.started_at) = h.hour) GROUP BY user_id, metric_type, hour""")
def reemitted_hours(spark, sf_dir):
    """Every hour that a batch of new step samples touches is totalled anew from all its device rows, and put in whole; an hour left without rows gets 0."""
    s = samples_of(spark, sf_dir)
    batch = s.where("metric_type = 'steps' and user_id % 3 = 0 and event_id % 2 = 0")
    return _row(store.reemit_hours(s.drop("event_id"), batch.drop("event_id"), units_of(spark)))


@query(f""", kept AS (SELECT * FROM samples s WHERE NOT EXISTS (SELECT 1 FROM samples b WHERE b.user_id = s.user_id AND b.metric_type = s.metric_type AND b.event_id % 4 < s.event_id % 4 AND b.started_at < s.ended_at AND s.started_at < b.ended_at)),
touched AS (SELECT DISTINCT user_id, metric_type, unnest(generate_series(date_trunc('hour', started_at), date_trunc('hour', ended_at - INTERVAL 1 MICROSECOND), INTERVAL 1 HOUR)) AS hour FROM samples)
SELECT t.user_id::VARCHAR AS user_id, t.metric_type, (epoch_us(t.hour) // 1000000) AS start_epoch, round(coalesce(sum(CASE unit WHEN 'kg' THEN 1000 * value ELSE value END), 0), 4) AS value, count(event_id) AS device_rows
FROM touched t LEFT JOIN kept k ON k.user_id = t.user_id AND k.metric_type = t.metric_type AND date_trunc('hour', k.started_at) = t.hour GROUP BY ALL""")
def live_hours(spark, sf_dir):
    """The events as a stream of files in three batches, in no order of time, into stateful hour totals."""
    from ..streaming.hours import live_hours as run
    from ..streaming.hours import newest_hours

    at, out, s = scratch(spark, "feed"), scratch(spark, "totals"), samples_of(spark, sf_dir)
    rows = s.withColumns({"user_id": F.col("user_id").cast("string"), "source_device": F.concat_ws(" ", "source_device", F.col("event_id").cast("string"))})
    rows.withColumn("part", F.pmod(F.hash("event_id"), F.lit(3))).drop("event_id").repartition("part").write.partitionBy("part").parquet(at)
    rank = F.element_at(F.array(*[F.lit(i) for i in range(4)]), F.array_position(F.array(*map(F.lit, ("Oura Ring", "Apple Watch", "iPhone", "Polar"))), F.regexp_replace("source_device", r" \d+$", "")).cast("int"))
    run(spark, f"{at}/*", out, scratch(spark, "offsets"), units_of(spark), rank, reach=2, keep=None, max_files=1).awaitTermination()
    return newest_hours(spark, out).select("user_id", "metric_type", F.unix_timestamp("started_at").alias("start_epoch"), rounded("value", 4).alias("value"), "device_rows")

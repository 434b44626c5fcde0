"""Ingest of payload files: validate, de-duplicate, split off merged hours, and put them into the store, batch by batch."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import dedupe_latest, merged_hours, replace_merged_hours, upserted, user_key, validate
from ..operators.upkeep import batch_log
from ..schema import KEY, MAX_INTERVAL_DAYS, MERGED_SOURCE, METRIC_PATTERN, PAYLOAD, SAMPLE_COLUMNS, SAMPLES
from ..sources.samples import from_payloads
from ..sources.tables import parted, put, read_table, remove


@dataclass(frozen=True)
class HourTotals:
    """How ingest totals device rows: those of `metrics` become whole merged hours, in the units of `units` (unit, canonical,
    factor), after rows that overlap a better source's have gone (priority; null: none go), for hours from `not_before` on.
    The device rows themselves are kept in the store's table `devices`, so that a late one finds the others of its hour."""

    metrics: tuple[str, ...]
    units: DataFrame
    priority: Column | None = None
    not_before: Column | None = None


def checked(batch: DataFrame, user_id: str | None, merged_metrics: tuple[str, ...], pattern: str | None = METRIC_PATTERN, mode: str = "row") -> DataFrame:
    """A batch's rows with reject_reason; a payload's own user_id goes before the stream's. mode="batch": a payload with a bad row is rejected as a whole."""
    rows = from_payloads(batch).withColumns({"user_id": F.coalesce(user_key(F.col("user_id")), F.lit(user_id).cast("string")), "synced_at": F.current_timestamp()})
    return validate(rows, merged_metrics, mode=mode, batch_col="payload", pattern=pattern, texts=True)


def prepared(rows: DataFrame) -> DataFrame:
    """The good ones of checked rows, the last of each key."""
    return dedupe_latest(rows.where("reject_reason is null"), F.col("batch_seq")).select(*SAMPLE_COLUMNS)


def applied(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store after a batch of unique keys: merged hours replace device rows, then device rows are put in."""
    merged = batch.where(F.col("source_device") == MERGED_SOURCE)
    return upserted(replace_merged_hours(store, merged), batch.where(F.col("source_device") != MERGED_SOURCE))


def _totalled(spark: SparkSession, store: str, fresh: DataFrame, totals: HourTotals, stream: str, batch: int) -> DataFrame:
    """Puts a batch's device rows into `devices` and gives the whole hours that they touch."""
    days = parted(fresh).select("metric_type", "day").distinct()
    put(spark, f"{store}/devices", lambda: (days, upserted(read_table(spark, f"{store}/devices", SAMPLES, days), fresh)), stream, batch)
    last = F.to_date(F.greatest(F.coalesce("ended_at", "started_at") - F.expr("INTERVAL 1 MICROSECOND"), F.col("started_at")))
    reach = 0 if totals.priority is None else MAX_INTERVAL_DAYS  # rows that begin so far away may overlap
    near = fresh.select("metric_type", F.explode(F.sequence(F.date_sub(F.to_date("started_at"), reach), F.date_add(last, reach))).alias("day")).distinct()
    return merged_hours(read_table(spark, f"{store}/devices", SAMPLES, near), fresh, totals.units, totals.not_before, totals.priority)


def ingest_stream(
    spark: SparkSession, payloads: str, store: str, checkpoint: str, user_id: str | None = None, merged_metrics: tuple[str, ...] = (), max_files: int = 1000,
    pattern: str | None = METRIC_PATTERN, mode: str = "row", totals: HourTotals | None = None,
):
    """Drains the payload folder into the store. A batch reads and rewrites the metrics' days that it touches.

    user_id stands for payloads without one; pattern is what metric types have to match (null: anything). Rejected rows go
    to the store's folder `rejected`, and counts of rows posted, rejected, inserted and replaced by metric to `batches`, both
    in a folder per stream and batch, so that a repeated delivery writes them again alike. The stream is known by its
    checkpoint. With totals, every hour that a batch's device rows touch is totalled anew and put in whole.
    """
    stream = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def add(batch: DataFrame, batch_id: int) -> None:
        s, at = batch.sparkSession, f"stream={stream}/batch={batch_id}"

        def made() -> tuple[DataFrame, DataFrame]:
            # The checked batch is written once: what a lost executor held is read again, not parsed again.
            checked(batch, user_id, merged_metrics, pattern, mode).write.mode("overwrite").parquet(f"{store}/checked/{stream}")
            rows = s.read.parquet(f"{store}/checked/{stream}")
            bad, new = rows.where("reject_reason is not null"), prepared(rows)
            bad.write.mode("overwrite").parquet(f"{store}/rejected/{at}")
            if totals is not None:
                own = (F.col("source_device") != MERGED_SOURCE) & F.col("metric_type").isin(*totals.metrics)
                new.where(own).write.mode("overwrite").parquet(f"{store}/checked/{stream}-fresh")
                merged = _totalled(s, store, s.read.schema(SAMPLES).parquet(f"{store}/checked/{stream}-fresh"), totals, stream, batch_id)
                new = new.where(~own).unionByName(merged.select(*SAMPLE_COLUMNS))
            touched = parted(new).select("metric_type", "day").distinct()
            old = read_table(s, store, SAMPLES, touched)
            report = batch_log(new.select(*KEY).withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad.select(*KEY, "reject_reason")), old)
            report.coalesce(1).write.mode("overwrite").json(f"{store}/batches/{at}")
            return touched, applied(old, new).select(*SAMPLE_COLUMNS)

        put(s, store, made, stream, batch_id)
        for folder in (f"{store}/checked/{stream}", f"{store}/checked/{stream}-fresh"):
            remove(s, folder)

    source = spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", max_files).json(payloads)
    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The samples of a store."""
    return read_table(spark, store, SAMPLES)


def rejected_rows(spark: SparkSession, store: str) -> DataFrame:
    """The rows that ingest has put aside, with reject_reason, stream and batch."""
    return spark.read.parquet(f"{store}/rejected")


def batch_reports(spark: SparkSession, store: str) -> DataFrame:
    """Counts by metric of every batch that ingest has taken in."""
    return spark.read.schema("metric_type string, posted long, rejected long, inserted long, replaced long, stream string, batch long").json(f"{store}/batches")


def hourly_counts_stream(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Running one-hour totals of a sample stream, exact repeats dropped inside the delay (update mode)."""
    seen = events.withWatermark("started_at", delay).dropDuplicatesWithinWatermark(list(KEY))
    return seen.groupBy("user_id", "metric_type", F.window("started_at", "1 hour").alias("hour")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("rows"))


def continuous_totals(spark: SparkSession, samples: DataFrame, out: str, checkpoint: str):
    """Drains a sample stream into `out`: each batch's changed hours, in a folder per batch, which a repeated batch writes again alike."""

    def put_hours(hours: DataFrame, batch_id: int) -> None:
        hours.select("user_id", "metric_type", F.col("hour.start").alias("started_at"), "value", "rows").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return hourly_counts_stream(samples).writeStream.outputMode("update").foreachBatch(put_hours).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """The newest total of each hour that continuous_totals has put out."""
    hours = spark.read.schema("user_id string, metric_type string, started_at timestamp, value double, rows long, batch long").parquet(out)
    return hours.groupBy("user_id", "metric_type", "started_at").agg(F.max_by(F.struct("value", "rows"), "batch").alias("s")).select("user_id", "metric_type", "started_at", "s.value", "s.rows")

"""Backfill, batch reports, repairs and the plan of a compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MERGED_SOURCE, SUMMARY_KEY
from .store import double_counted, replace_merged_hours, summarizable


def horizon_floor(as_of: Column, everything: bool = False) -> Column:
    """Where a backfill begins: twelve months ago, or with everything, and never before 2013."""
    first = F.lit("2013-01-01").cast("timestamp")
    return first if everything else F.greatest(F.add_months(as_of, -12).cast("timestamp"), first)


def backfill(samples: DataFrame, floor: Column, until: Column) -> DataFrame:
    """History in [floor, until). The bounds reach the scan."""
    return samples.where((F.col("started_at") >= floor) & (F.col("started_at") < until))


def _chunk(at: Column, floor: Column, days: int) -> Column:
    return F.floor((F.unix_micros(at) - F.unix_micros(floor)) / F.lit(days * 86400e6)).cast("int")


def chunks_pending(catalog: DataFrame, floor: Column, until: Column, done: DataFrame, days: int = 90) -> DataFrame:
    """Chunks (metric_type, chunk from 0) of `days` days in [floor, until) for every metric of the catalog, less those done.

    done: metric_type and chunk of earlier runs, so a run that stopped goes on where it was.
    """
    last = _chunk(until - F.expr("INTERVAL 1 MICROSECOND"), floor, days)
    every = catalog.select("metric_type", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))).alias("chunk"))
    return every.join(done.select("metric_type", "chunk"), ["metric_type", "chunk"], "left_anti")


def backfill_chunks(samples: DataFrame, pending: DataFrame, floor: Column, until: Column, days: int = 90) -> DataFrame:
    """Rows of the pending chunks, with their chunk."""
    rows = backfill(samples, floor, until).withColumn("chunk", _chunk(F.col("started_at"), floor, days))
    return rows.join(pending.select("metric_type", "chunk"), ["metric_type", "chunk"], "left_semi")


def chunk_log(rows: DataFrame, pending: DataFrame) -> DataFrame:
    """What a run did, a row for each pending chunk: rows stored, and done, from which the next run's pending chunks follow."""
    n = rows.groupBy("metric_type", "chunk").agg(F.count(F.lit(1)).alias("stored"))
    return pending.join(n, ["metric_type", "chunk"], "left").select("metric_type", "chunk", F.coalesce("stored", F.lit(0).cast("long")).alias("stored"))


def backfill_status(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """An outcome for every metric of the catalog (metric_type, always_expected), so one without rows is seen."""
    n = rows.groupBy("metric_type").agg(F.count(F.lit(1)).alias("stored"), F.unix_timestamp(F.min("started_at")).alias("earliest"), F.unix_timestamp(F.max("started_at")).alias("latest"))
    outcome = F.when(F.col("stored").isNotNull(), "stored").when(F.col("always_expected"), "empty but expected").otherwise("empty")
    return catalog.join(n, "metric_type", "left").select("metric_type", F.coalesce("stored", F.lit(0)).alias("stored"), "earliest", "latest", outcome.alias("outcome"))


def essentials(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of metrics that the catalog (metric_type, is_essential) marks as essential."""
    return samples.join(catalog.where("is_essential").select("metric_type"), "metric_type", "left_semi")


def compaction_plan(samples: DataFrame, cutoff: Column, merged_metrics: tuple[str, ...], kept_apart: tuple[str, ...] = ()) -> DataFrame:
    """What a compaction would touch: per metric rows and users before the cutoff, and recompute, compact or skip."""
    m = F.col("metric_type")
    mode = F.when(~summarizable(m) | m.isin(*kept_apart or ("",)), "skip").when(m.isin(*merged_metrics or ("",)), "recompute").otherwise("compact")
    return samples.where(F.col("started_at") < cutoff).groupBy("metric_type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users")).withColumn("mode", mode)


def changed_summaries(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New summaries that differ from the stored ones of their key or are not there; a second run gives none."""
    values = ("min_value", "max_value", "sum_value", "sample_count")
    old = stored.select(*SUMMARY_KEY, F.struct(*values).alias("_old"))
    same = F.struct(*values).eqNullSafe(F.col("_old"))
    return new.join(old, list(SUMMARY_KEY), "left").where(F.col("_old").isNull() | ~same).drop("_old")


def batch_log(validated: DataFrame, stored: DataFrame) -> DataFrame:
    """Per metric of a batch: rows posted, rejected, inserted, and those that replace a stored row of their key.

    validated: the batch's rows with reject_reason, unique by key. stored: the store before the batch.
    """
    key = ["user_id", "metric_type", "source_device", "started_at"]
    old = stored.select(*key).join(validated.select(*key), key, "left_semi").distinct().withColumn("_old", F.lit(True))
    ok, there = F.col("reject_reason").isNull(), F.col("_old").isNotNull()
    return validated.join(old, key, "left").groupBy("metric_type").agg(
        F.count(F.lit(1)).alias("posted"), F.count_if(~ok).alias("rejected"), F.count_if(ok & ~there).alias("inserted"), F.count_if(ok & there).alias("replaced"),
    )


def repair_hours(store: DataFrame) -> DataFrame:
    """Late device rows beside a merged hour go, by posting the merged rows of just those hours again."""
    late = double_counted(store).select("user_id", "metric_type", F.date_trunc("hour", "started_at").alias("started_at")).distinct()
    again = store.where(F.col("source_device") == MERGED_SOURCE).join(late, ["user_id", "metric_type", "started_at"], "left_semi")
    return replace_merged_hours(store, again.select(*store.columns))

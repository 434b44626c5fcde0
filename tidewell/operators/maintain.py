"""Summaries of merged metrics kept up by what a batch changes, without reading the days it leaves alone.

The state has a row per user, metric, local day and unit. A batch's old and new rows give differences of sums and counts.
Extremes can only be wrong where the old rows held one of them and the new ones don't reach it; these groups, and no
others, are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..schema import KEY, MERGED_SOURCE, SUMMARY_KEY
from .store import _points

STATE = ("min_value", "max_value", "sum_value", "sample_count", "rows", "device_rows")


def summary_state(samples: DataFrame, tz="UTC") -> DataFrame:
    """The state of all samples: extremes, sum and number of values, rows, and rows of single devices."""
    return _points(samples, tz).groupBy(*SUMMARY_KEY).agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), rounded(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("sum_value"), F.count("value").alias("sample_count"),
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("source_device") != MERGED_SOURCE).alias("device_rows"),
    )


def changed_rows(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of before that after lacks or has otherwise, rows of after that before lacks or has otherwise); keys are unique in each. For a batch: its touched partitions before and after."""
    same = lambda df: df.select(*KEY, F.struct("value", "unit").alias("_was"))
    other = lambda a, b: a.join(same(b), list(KEY), "left").where(F.col("_was").isNull() | ~F.struct("value", "unit").eqNullSafe(F.col("_was"))).drop("_was")
    return other(before, after), other(after, before)


def _differences(old: DataFrame, new: DataFrame, tz) -> DataFrame:
    rows = _points(old, tz).withColumn("_sign", F.lit(-1)).unionByName(_points(new, tz).withColumn("_sign", F.lit(1)))
    of = lambda sign: F.when(F.col("_sign") == sign, F.col("value"))
    device = (F.col("source_device") != MERGED_SOURCE).cast("int")
    return rows.groupBy(*SUMMARY_KEY).agg(
        F.coalesce(F.sum(F.col("_sign") * F.col("value")), F.lit(0.0)).alias("d_sum"), F.sum(F.when(F.col("value").isNotNull(), F.col("_sign")).otherwise(0)).alias("d_count"), F.sum("_sign").alias("d_rows"),
        F.sum(F.col("_sign") * device).alias("d_device"), F.min(of(-1)).alias("old_min"), F.max(of(-1)).alias("old_max"), F.min(of(1)).alias("new_min"), F.max(of(1)).alias("new_max"),
    )


def maintained(state: DataFrame, old: DataFrame, new: DataFrame, after: DataFrame, tz="UTC") -> DataFrame:
    """The state after a batch, equal to summary_state(after): old and new are the rows that the batch took away and put in.

    `after` is read for groups whose extremes were taken away only; give it by metric and day, so that this prunes its scan.
    Groups without rows go. An empty batch changes nothing.
    """
    both = state.join(_differences(old, new, tz), list(SUMMARY_KEY), "full")
    lost: Column = (F.col("old_min") <= F.col("min_value")) & ~F.coalesce(F.col("new_min") <= F.col("old_min"), F.lit(False))
    lost = lost | ((F.col("old_max") >= F.col("max_value")) & ~F.coalesce(F.col("new_max") >= F.col("old_max"), F.lit(False)))
    both = both.withColumn("_again", F.coalesce(lost, F.lit(False)))
    plus = lambda c, d: F.coalesce(c, F.lit(0)) + F.coalesce(d, F.lit(0))
    kept = both.where("not _again").select(
        *SUMMARY_KEY, F.least("min_value", "new_min").alias("min_value"), F.greatest("max_value", "new_max").alias("max_value"), rounded(plus("sum_value", "d_sum"), 6).alias("sum_value"),
        plus("sample_count", "d_count").alias("sample_count"), plus("rows", "d_rows").alias("rows"), plus("device_rows", "d_device").alias("device_rows"),
    )
    again = both.where("_again").select(*SUMMARY_KEY)
    read = _points(after, tz).join(again, list(SUMMARY_KEY), "left_semi")
    return kept.where("rows > 0").unionByName(summary_state(read.drop("summary_date"), tz).select(*kept.columns))


def clean_summaries(state: DataFrame) -> DataFrame:
    """Summaries of the days all of whose rows (of all units) are merged."""
    mixed = state.where("device_rows > 0").select("user_id", "metric_type", "summary_date").distinct()
    out = state.where("sample_count > 0").join(mixed, ["user_id", "metric_type", "summary_date"], "left_anti")
    return out.select(*SUMMARY_KEY, "min_value", "max_value", "sum_value", "sample_count", (F.col("sum_value") / F.col("sample_count")).alias("avg_value"))


def recompute_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per metric of two states, with mode: summaries written or removed (summary_rows), and days left out for rows of single devices (skipped_days)."""
    values = F.struct("min_value", "max_value", "sum_value", "sample_count")
    a, b = clean_summaries(before).select(*SUMMARY_KEY, values.alias("a")), clean_summaries(after).select(*SUMMARY_KEY, values.alias("b"))
    wrote = a.join(b, list(SUMMARY_KEY), "full").where(~F.col("a").eqNullSafe(F.col("b"))).groupBy("metric_type").agg(F.count(F.lit(1)).alias("summary_rows"))
    skipped = after.where("device_rows > 0").groupBy("metric_type").agg(F.count_distinct("user_id", "summary_date").alias("skipped_days"))
    metrics = after.select("metric_type").unionByName(before.select("metric_type")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return metrics.join(wrote, "metric_type", "left").join(skipped, "metric_type", "left").select("metric_type", F.lit("recompute").alias("mode"), zero("summary_rows"), zero("skipped_days"))

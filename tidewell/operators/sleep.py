"""Nights from sleep stage samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.time import minutes, night_key
from ..schema import ASLEEP, SLEEP_SOURCES, STAGES


def source_rank(device) -> F.Column:
    out = F.lit(len(SLEEP_SOURCES))
    for i, name in reversed(list(enumerate(SLEEP_SOURCES))):
        out = F.when(F.lower(device).contains(name), F.lit(i)).otherwise(out)
    return out


def stage_rows(sleep: DataFrame, tz="UTC") -> DataFrame:
    """Asleep segments of each night's best device: best rank, then most segments, then name."""
    rows = sleep.where(F.col("value").isin(*ASLEEP)).withColumn("night", night_key(F.col("started_at"), tz))
    n = rows.groupBy("user_id", "night", "source_device").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("user_id", "night").agg(F.min_by("source_device", F.struct(source_rank(F.col("source_device")), -F.col("n"), F.col("source_device"))).alias("source_device"))
    return rows.join(best, ["user_id", "night", "source_device"]).withColumn("minutes", minutes(F.col("started_at"), F.col("ended_at")))


def sleep_nights(sleep: DataFrame, tz="UTC") -> DataFrame:
    s = stage_rows(sleep, tz)
    of = lambda code: rounded(F.coalesce(F.sum(F.when(F.col("value") == code, F.col("minutes"))), F.lit(0.0)), 1)
    return s.groupBy("user_id", "night", "source_device").agg(
        rounded(F.sum("minutes"), 1).alias("total_minutes"), of(3.0).alias("core_minutes"), of(4.0).alias("deep_minutes"), of(5.0).alias("rem_minutes"), F.count(F.lit(1)).alias("segments")
    )


def segments(sleep: DataFrame, tz="UTC") -> DataFrame:
    name = F.create_map(*[x for k, v in STAGES.items() for x in (F.lit(float(k)), F.lit(v))])
    return stage_rows(sleep, tz).select("user_id", "night", name[F.col("value")].alias("stage"), F.unix_timestamp("started_at").alias("start_epoch"), rounded("minutes", 1).alias("duration_minutes"))


def sleep_review(nights: DataFrame) -> DataFrame:
    """Per user: nights, mean hours, stage shares, short-deep nights, best and worst night."""
    return nights.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("nights"), rounded(F.avg(F.when(F.col("total_minutes") > 0, F.col("total_minutes") / 60)), 1).alias("avg_hours"),
        rounded(F.sum("deep_minutes") / F.nullif(F.sum("total_minutes"), F.lit(0.0)), 3).alias("deep_share"), rounded(F.sum("rem_minutes") / F.nullif(F.sum("total_minutes"), F.lit(0.0)), 3).alias("rem_share"),
        F.count_if(F.col("deep_minutes") < 45).alias("low_deep_nights"),
        F.max_by("night", F.struct("total_minutes", "night")).alias("best_night"), F.min_by("night", F.struct("total_minutes", "night")).alias("worst_night"),
    )

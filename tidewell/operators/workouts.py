"""Workouts: their payload is in the metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded

_PAYLOAD = "workout_type string, duration_seconds double, total_distance_meters double, total_energy_burned_cal double"


def workouts(samples: DataFrame) -> DataFrame:
    """Payload fields beside the sample; an absent type is "unknown", an absent duration the sample's value."""
    p = F.from_json("metadata", _PAYLOAD)
    return samples.select(
        "user_id", "started_at", F.coalesce(p["workout_type"], F.lit("unknown")).alias("workout_type"), F.coalesce(p["duration_seconds"], "value").alias("duration_seconds"),
        p["total_distance_meters"].alias("distance_meters"), p["total_energy_burned_cal"].alias("energy_cal"), "source_device",
    )


def type_counts(rows: DataFrame) -> DataFrame:
    """Per user and type: sessions, mean duration, share of the user's sessions."""
    g = rows.groupBy("user_id", "workout_type").agg(F.count(F.lit(1)).alias("sessions"), rounded(F.avg("duration_seconds"), 1).alias("mean_seconds"))
    return g.withColumn("share", rounded(F.col("sessions") / F.sum("sessions").over(Window.partitionBy("user_id")), 4))


def weekly_volume(rows: DataFrame) -> DataFrame:
    """Weekly seconds with those of the week before (null where there was none)."""
    w = rows.groupBy("user_id", F.date_trunc("week", "started_at").cast("date").alias("week")).agg(rounded(F.sum("duration_seconds"), 1).alias("seconds"), F.count(F.lit(1)).alias("sessions"))
    before = w.select("user_id", F.date_add("week", 7).alias("week"), F.col("seconds").alias("previous_seconds"))
    return w.join(before, ["user_id", "week"], "left")


def preceding(flagged: DataFrame, rows: DataFrame, hours: int = 48) -> DataFrame:
    """Workouts that started in the `hours` before a flagged day's beginning: user_id, date, sessions, seconds."""
    days = -(-hours // 24)
    f = flagged.select("user_id", "date").distinct().withColumn("near", F.explode(F.sequence(F.date_sub("date", days), F.col("date"))))
    r = rows.select("user_id", F.to_date("started_at").alias("near"), "started_at", "duration_seconds")
    day = F.col("date").cast("timestamp")
    hit = f.join(r, ["user_id", "near"]).where((F.col("started_at") < day) & (F.col("started_at") >= day - F.expr(f"INTERVAL {hours} HOURS")))
    return hit.groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("sessions"), rounded(F.sum("duration_seconds"), 1).alias("seconds"))
